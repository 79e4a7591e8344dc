"""Pages to node rows.

HTML nesting needs a stack, which no built-in expression offers, so one narrow
Arrow map turns each page into nested-set numbered rows, each with its range in the source and in the page's text. It only numbers nodes;
measures on them are column expressions, and subtrees are differences of their running sums (see ``blocks``). A page never leaves its
partition here and pages are read one Arrow batch at a time. What is held grows with a page's nodes, however deeply they nest.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "page_id bigint, pre int, last int, parent int, depth int, tag string, attrs string, text string, "
    "src_start int, src_end int, n_a int, has_a boolean, tail_of int, tail_tag string, "
    "captured boolean, text_start int, text_end int, tail_end int"
)

TEXT, COMMENT = "#text", "#comment"
BLOCK_TAGS = ("div", "section", "article")

# Public HTML facts.
VOID_TAGS = frozenset(
    "area base basefont br col embed frame hr img input isindex link meta param source track wbr".split()
)
HEAD_TAGS = frozenset("title meta link base script style".split())
RAW_TAGS = frozenset("script style".split())
_HEADINGS = "h1 h2 h3 h4 h5 h6"
_FONTS = "tt i b u s strike big small"
_CELL = "td th p span font a b i u"
# new tag -> open tags it ends, as long as they are innermost
CLOSES = {
    "p": f"p {_HEADINGS} {_FONTS}",
    "h1": f"p {_HEADINGS}",
    "h2": f"p {_HEADINGS}",
    "h3": f"p {_HEADINGS}",
    "h4": f"p {_HEADINGS}",
    "h5": f"p {_HEADINGS}",
    "h6": f"p {_HEADINGS}",
    "li": f"li p {_HEADINGS} dl address pre",
    "dt": "dt dd p",
    "dd": "dt dd p",
    "option": "option",
    "optgroup": "option",
    "a": "a",
    "td": _CELL,
    "th": _CELL,
    "tr": "td th tr caption col colgroup p",
    "tbody": "td th tr caption col colgroup thead tfoot tbody p",
    "tfoot": "td th tr caption col colgroup thead tbody p",
    "thead": "caption col colgroup",
    "table": f"p pre {_HEADINGS} a",
    "form": f"form p {_HEADINGS} dl ul ol menu address pre",
    "div": "p",
    "ul": "p",
    "ol": "p",
    "dl": "p",
    "menu": "p",
    "hr": "p",
    "pre": "p",
    "address": "p",
    "blockquote": "p",
    "fieldset": "p",
}
CLOSES = {tag: frozenset(names.split()) for tag, names in CLOSES.items()}
# an end tag is ignored if a stronger element is open above its match
END_STRENGTH = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5}

# comment | declaration | end tag | start tag | text | stray "<"
_TOKEN = re.compile(
    r"""<!--(.*?)(?:-->|\Z)|(<![^>]*>)|<\?([^>]*)>|</([a-zA-Z][^\s/>]*)[^>]*>"""
    r"""|<([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)""",
    re.S,
)

_PRE, _LAST, _PARENT, _DEPTH, _TAG, _ATTRS, _TXT, _START, _END, _NA, _HASA, _TAILOF, _TAILTAG, _CAP = range(14)


class _Tree:
    """Stack of open elements and the rows numbered so far."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.open: list[list] = []
        self.sibling: list[list | None] = []  # last child of each open element
        self.event = ""  # S start, T text, C comment, E end, U end that closed a captured text
        self.body_seen = self.head_seen = False

    def node(self, tag, attrs, text, start, end):
        top = self.open[-1] if self.open else None
        pre = len(self.rows)
        n_a = (top[_NA] if top else 0) + (tag == "a")
        row = [pre, pre, top[_PRE] if top else -1, len(self.open), tag, attrs, text, start, end, n_a]
        row += [False, None, None, False]
        self.rows.append(row)
        return row

    def push(self, tag, attrs, start, end):
        row = self.node(tag, attrs, None, start, end)
        if self.sibling:
            self.sibling[-1] = row
        self.event = "S"
        if tag not in VOID_TAGS:
            self.open.append(row)
            self.sibling.append(None)

    def pop(self, end):
        row = self.open.pop()
        self.sibling.pop()
        row[_LAST] = len(self.rows) - 1
        row[_END] = end
        if self.open and (row[_HASA] or row[_TAG] == "a"):
            self.open[-1][_HASA] = True
        if self.event == "T" and self.rows[-1][_TAG] == TEXT and self.rows[-1][_CAP] is None:
            self.rows[-1][_CAP] = True
            self.event = "U"
        else:
            self.event = "E"

    def place(self, tag, at):
        """Open or close head and body as ``tag`` requires."""
        in_head = len(self.open) > 1 and self.open[1][_TAG] == "head"
        if tag in HEAD_TAGS and not self.body_seen:
            if not in_head and not self.head_seen:
                self.head_seen = True
                self.push("head", "", at, at)
            return
        if in_head:
            while len(self.open) > 1:
                self.pop(at)
        if not self.body_seen:
            self.body_seen = True
            self.push("body", "", at, at)

    def start(self, tag, attrs, start, end):
        if tag == "html":
            self.rows[0][_ATTRS] = self.rows[0][_ATTRS] or attrs
            return
        if tag in ("head", "body"):
            seen = self.head_seen or self.body_seen if tag == "head" else self.body_seen
            if not seen:
                while len(self.open) > 1:
                    self.pop(start)
                self.head_seen = True
                self.body_seen = tag == "body"
                self.push(tag, attrs, start, end)
            return
        self.place(tag, start)
        closes = CLOSES.get(tag, ())
        while self.open[-1][_TAG] in closes:
            self.pop(start)
        self.push(tag, attrs, start, end)
        if attrs.endswith("/") and tag not in VOID_TAGS:
            self.pop(end)

    def end(self, tag, start, end):
        if tag in ("html", "body") or tag in VOID_TAGS:
            return
        strength = END_STRENGTH.get(tag, 0)
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.open[depth][_TAG]
            if name == tag:
                while len(self.open) > depth + 1:
                    self.pop(start)
                self.pop(end)
                return
            if END_STRENGTH.get(name, 0) > strength or name == "body":
                return

    def text(self, data, start, end):
        in_content = self.body_seen or (len(self.open) > 2)
        if not in_content:
            if not data.strip():
                return
            self.place(TEXT, start)
            self.push("p", "", start, start)
        if self.event == "T" and self.rows[-1][_TAG] == TEXT:
            self.rows[-1][_TXT] += data
            self.rows[-1][_END] = end
            return
        row = self.node(TEXT, None, data, start, end)
        before = self.sibling[-1]
        if before is not None:
            row[_TAILOF], row[_TAILTAG] = before[_PRE], before[_TAG]
        row[_CAP] = False if self.event == "U" else None
        self.event = "T"

    def comment(self, data, start, end):
        row = self.node(COMMENT, None, data, start, end)
        self.sibling[-1] = row
        self.event = "C"


def page_nodes(source: str) -> list[list]:
    """Nested-set rows of one page in document order."""
    tree = _Tree()
    tree.push("html", "", 0, len(source))
    raw = None
    for token in _TOKEN.finditer(source):
        at, to = token.span()
        comment, declaration, instruction, end_tag, tag, attrs, tag2, attrs2, text = token.groups()
        if raw and not (end_tag and end_tag.lower() == raw):
            tree.text(token.group(), at, to)
        elif text is not None:
            tree.text(html_lib.unescape(text) if "&" in text else text, at, to)
        elif end_tag:
            raw = None
            tree.end(end_tag.lower(), at, to)
        elif tag or tag2:
            name = (tag or tag2).lower()
            tree.start(name, attrs if tag else attrs2, at, to)
            raw = name if name in RAW_TAGS and tree.open[-1][_TAG] == name else None
        elif not declaration:
            tree.comment(comment if comment is not None else instruction, at, to)
    while tree.open:
        tree.pop(len(source))
    return tree.rows


def with_text_ranges(rows: list[list]) -> list[list]:
    """The rows with where each node's text lies in the page's text: first character, end, and end with the text run that follows the node."""
    at = [0]
    for row in rows:
        at.append(at[-1] + (len(row[_TXT]) if row[_TAG] == TEXT else 0))
    tails = {row[_TAILOF]: at[row[_PRE] + 1] for row in rows if row[_TAILOF] is not None}
    return [[*row, at[row[_PRE]], at[row[_LAST] + 1], tails.get(row[_PRE], at[row[_LAST] + 1])] for row in rows]


_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()),
        ("depth", pa.int32()), ("tag", pa.string()), ("attrs", pa.string()), ("text", pa.string()),
        ("src_start", pa.int32()), ("src_end", pa.int32()), ("n_a", pa.int32()),
        ("has_a", pa.bool_()), ("tail_of", pa.int32()), ("tail_tag", pa.string()), ("captured", pa.bool_()),
        ("text_start", pa.int32()), ("text_end", pa.int32()), ("tail_end", pa.int32()),
    ]
)

_ROWS_PER_BATCH = 20_000


def _batch(ids: list[int], rows: list[list], schema: pa.Schema = _ARROW) -> pa.RecordBatch:
    columns = [ids, *map(list, zip(*rows))]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(columns, schema)], schema=schema
    )


def _root(rows: list[list]) -> tuple[int | None, int | None]:
    """The first element in the body, and the last node below it."""
    body = next((r[_PRE] for r in rows if r[_TAG] == "body"), None)
    top = next((r for r in rows if r[_PARENT] == body and r[_TAG][0] != "#"), None) if body is not None else None
    return (top[_PRE], top[_LAST]) if top else (None, None)


def _parse_batches(batches: Iterator[pa.RecordBatch], roots: bool = False) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*_ARROW, ("root", pa.int32()), ("root_last", pa.int32())]) if roots else _ARROW
    ids: list[int] = []
    rows: list[list] = []
    for batch in batches:
        for page_id, source in zip(batch.column(0), batch.column(1)):
            if not source.is_valid:
                continue
            found = page_nodes(source.as_py())
            root = _root(found) if roots else ()
            found = [[*row, *root] for row in with_text_ranges(found)]
            ids.extend([page_id.as_py()] * len(found))
            rows.extend(found)
            if len(rows) >= _ROWS_PER_BATCH:
                yield _batch(ids, rows, schema)
                ids, rows = [], []
    if rows:
        yield _batch(ids, rows, schema)


def node_table(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", roots: bool = False) -> DataFrame:
    """One row per element, comment and text run of every page.

    ``pre``/``last`` bound the subtree, ``tail_of`` names the sibling a
    text run follows, ``n_a`` counts the links a node lies in. A node's text is characters ``text_start`` to ``text_end`` of the page's text, and to ``tail_end``
    with the run that follows it. ``roots`` adds the page's first element in the body and the last node below it, as ``root`` and ``root_last``.
    """
    source = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).alias("html"))
    schema = NODE_SCHEMA + (", root int, root_last int" if roots else "")
    return source.mapInArrow(lambda batches: _parse_batches(batches, roots), schema)


# name, and a value in double quotes, single quotes or none
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def attribute_map(attrs: str) -> dict[str, str]:
    """The decoded attributes of a start tag by lower-case name; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(attrs):
        found.setdefault(name.lower(), html_lib.unescape(double or single or bare))
    return found


PAGE_FIELDS = "title string, description string, hrefs array<string>, images array<struct<src:string,data_src:string>>"
_FIELD_TYPES = (
    pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("src", pa.string()), ("data_src", pa.string())]))
)


def page_record(source: str) -> tuple[str, str, list[str], list[dict]]:
    """Title, description, link targets and images of one page, as its tree has them."""
    rows = page_nodes(source)
    title = next((r[_PRE] for r in rows if r[_TAG] == "title"), None)
    text = "".join(r[_TXT] for r in rows if r[_PARENT] == title and r[_TAG] == TEXT) if title is not None else ""
    description, hrefs, images = None, [], []
    for row in rows:
        if row[_TAG] == "meta" and description is None:
            attrs = attribute_map(row[_ATTRS])
            if attrs.get("name") == "description":
                description = attrs.get("content", "")
        elif row[_TAG] == "a":
            href = attribute_map(row[_ATTRS]).get("href")
            if href is not None:
                hrefs.append(href)
        elif row[_TAG] == "img":
            attrs = attribute_map(row[_ATTRS])
            images.append({"src": attrs.get("src"), "data_src": attrs.get("data-src")})
    return text, description or "", hrefs, images


def with_page_fields(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``title, description, hrefs, images`` of every page, read from its tree in one narrow map. A null page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(batch.schema.get_field_index(html_col)).to_pylist()
            found = list(zip(*(page_record(s) if s is not None else ("", "", [], []) for s in sources))) or [[]] * 4
            columns = [*batch.columns, *(pa.array(list(c), kind) for c, kind in zip(found, _FIELD_TYPES))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "title", "description", "hrefs", "images"])

    plain = pages.drop("title", "description", "hrefs", "images")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{fields}, {PAGE_FIELDS}")


def element_html(nodes: DataFrame, pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Source HTML of the given element rows."""
    text = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("_html"))
    piece = F.substring(F.col("_html"), F.col("src_start") + 1, F.col("src_end") - F.col("src_start"))
    return nodes.join(text, "page_id").withColumn("html", piece).drop("_html")


def element_text(nodes: DataFrame, texts: DataFrame, with_tail: bool = True) -> DataFrame:
    """``page_id, pre, text`` of any of the nodes, nested or not: a piece of the page's text in ``texts(page_id, text)``.

    Only ranges move; the pieces are as long as the nodes asked for.
    """
    ranges = nodes.select("page_id", "pre", "text_start", F.col("tail_end" if with_tail else "text_end").alias("_end"))
    placed = ranges.join(texts.select("page_id", F.col("text").alias("_text")), "page_id")
    piece = F.substring(F.col("_text"), F.col("text_start") + 1, F.col("_end") - F.col("text_start"))
    return placed.select("page_id", "pre", piece.alias("text"))


def page_text(nodes: DataFrame) -> DataFrame:
    """Whole text of every page: all text runs in document order."""
    runs = F.when(F.col("tag") == TEXT, F.struct("pre", "text"))
    parts = F.transform(F.sort_array(F.collect_list(runs)), lambda r: r["text"])
    return nodes.groupBy("page_id").agg(F.array_join(parts, "").alias("text"))


class HtmlNodes:
    """Table function: the nodes of one page."""

    def eval(self, html: str):
        for row in page_nodes(html or ""):
            yield row[0], row[1], row[2], row[3], row[4], row[6]


def register_sql(spark: SparkSession) -> None:
    """Make ``html_nodes(html)`` known to SQL, for use with LATERAL."""
    schema = "pre int, last int, parent int, depth int, tag string, text string"
    spark.udtf.register("html_nodes", F.udtf(HtmlNodes, returnType=schema, useArrow=True))
