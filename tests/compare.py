"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(name: str) -> str:
    name = str(name).lower()
    for kinds, label in (
        (("bigint", "int", "smallint", "tinyint", "hugeint", "integer", "long"), "int"),
        (("double", "float"), "float"),
        (("varchar", "string"), "text"),
        (("timestamp", "timestamp_ntz"), "time"),
        (("boolean",), "bool"),
    ):
        if name in kinds:
            return label
    return name


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: _kind(d[1]) for d in cursor.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    for name, kind in df.dtypes:
        if _kind(kind) != types[name]:
            return f"type of {name}: {kind} / {types[name]}"
    order = sorted(names)
    want = [tuple(_norm(row[names.index(c)]) for c in order) for row in cursor.fetchall()]
    got = [tuple(_norm(row[c]) for c in order) for row in df.select(*order).collect()]
    if len(want) != len(got):
        return f"rows {len(got)} / {len(want)}"
    key = lambda row: tuple((v is None, str(v)) for v in row)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        if a != b:
            return f"{order}: {str(a)[:300]} / {str(b)[:300]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from leafsift.session import build_session
    from queries import registry

    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = build_session("compare", "local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = registry.oracle_sql()
    bad = 0
    for name, run in registry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                wrong = difference(df, con, sql[name])
            else:
                rows = df.collect()
                wrong = None
                print(f"     {name}: {len(rows)} rows, no SQL; first {str(rows[:1])[:200]}")
        except Exception as error:  # noqa: BLE001
            wrong = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += wrong is not None
        print(f"{'BAD ' if wrong else 'ok  '} {name} {time.time() - start:.1f}s {wrong or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
