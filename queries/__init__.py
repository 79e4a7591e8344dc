"""Registered queries and the SQL each must agree with.

Every module holds ``QUERIES`` (name -> callable) and ``SQL`` (name -> DuckDB text).
"""


def registrar(queries: dict, sql: dict):
    """A decorator that files a query and, where there is one, its SQL."""

    def query(name: str, text: str | None = None):
        def add(fn):
            if name in queries:
                raise ValueError(f"registered twice: {name}")
            queries[name] = fn
            if text is not None:
                sql[name] = text
            return fn

        return add

    return query
