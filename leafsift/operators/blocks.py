"""DOM features of blocks, from node rows.

Nodes are measured by column expressions. A block is the nodes ``pre`` to ``last``, so every sum over it is a difference of two running sums over
``pre``; depths, captures and tags, which have no difference, are folded once per stretch between block edges and then upwards from the innermost block. The
nodes of a page arrive together and in order, so nothing is shuffled and each node is read once, however deeply blocks nest.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafsift.functions.text import bytes_without_spaces
from leafsift.operators.tree import BLOCK_TAGS, TEXT, VOID_TAGS, node_table

# The tags and substrings each feature counts.
PARAGRAPH_TAGS = ("p", "blockquote")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5")
FORM_TAGS = ("form", "input", "textarea")
LIST_TAGS = ("li", "ol")
PLAIN_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "blockquote", "span", "div", "table", "tr", "td", "th", "img", "br")
HIDDEN_WORDS = "none|hidden|hide"
SIDE_WORDS = "left|right|side"
MAIN_WORDS = "main|body|content"
NAV_WORDS = "nav"
DEPTH_CAP = 20

FEATURES = (
    "f_text_n f_p_n f_tag_n f_h_n f_link_density f_np_n f_img_n f_a_n f_form_element_n f_element_maxtextlen "
    "f_none_n f_side_n f_main_n f_child_div_n f_child_p_n f_nav_n f_li_n f_li_a_n f_h1_n f_dom_depth f_depth_to_p"
).split()
FEATURES_V1 = ("f_text_n", "f_p_n", "f_tag_n", "f_h_n", "f_link_density", "f_np_n")


def _one(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


SUMMED = (
    "tag_n bytes spaceless linked hid sid mai nav li_a paragraph heading other img a form li h1 block"
).split()
#: What a text run adds to the block it follows.
TAIL_SUMMED = "bytes spaceless hid sid mai nav".split()


def _measured(nodes: DataFrame, is_block: Column, tail: Column) -> DataFrame:
    """Per-node measures; ``is_block`` marks the nodes to sum below, ``tail`` the text runs that count for the block they follow."""
    tag, text = F.col("tag"), F.col("text")
    is_text = tag == TEXT
    is_element = ~F.startswith(tag, F.lit("#"))
    spaceless = F.when(is_text, bytes_without_spaces(text)).otherwise(0).cast("bigint")
    # Markup as written out again: start tag, then an end tag unless void.
    closing = F.when(~tag.isin(*VOID_TAGS), tag)
    markup = F.when(is_element, F.concat_ws(" ", tag, F.col("attrs"), closing)).otherwise(text)
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    escaped = F.replace(escaped, F.lit(">"), F.lit("&gt;"))
    named = lambda *tags: _one(is_element & tag.isin(*tags))
    sums = {
        "tag_n": _one(~is_text),
        "bytes": F.when(is_text, F.octet_length(text)).otherwise(0).cast("bigint"),
        "spaceless": spaceless,
        "linked": spaceless * F.col("n_a") + F.when(F.col("tail_tag") == "a", spaceless).otherwise(0),
        "li_a": _one(tag.isin(*LIST_TAGS) & F.col("has_a")),
        "paragraph": named(*PARAGRAPH_TAGS),
        "heading": named(*HEADING_TAGS),
        "other": _one(is_element & ~tag.isin(*PLAIN_TAGS)),
        "img": named("img"),
        "a": named("a"),
        "form": named(*FORM_TAGS),
        "li": named(*LIST_TAGS),
        "h1": named("h1"),
        "block": named(*BLOCK_TAGS),
    }
    for name, found in (("hid", HIDDEN_WORDS), ("sid", SIDE_WORDS), ("mai", MAIN_WORDS), ("nav", NAV_WORDS)):
        sums[name] = F.regexp_count(markup, F.lit(found)).cast("bigint")
    return nodes.select(
        "page_id", "pre", "last", "parent", "depth", "tag", "src_start", "src_end", "n_a",
        is_element.alias("is_element"),
        F.coalesce(is_block, F.lit(False)).alias("is_block"),
        F.when(tail, F.col("tail_of")).alias("tail_of"),
        F.when(F.col("captured"), bytes_without_spaces(escaped)).cast("bigint").alias("capture"),
        *[sums[name].alias(name) for name in SUMMED],
    )


def running_sums(values: np.ndarray) -> np.ndarray:
    """Sums of all entries before each place, and of all: entries i to j add up to the difference of places j + 1 and i."""
    out = np.zeros((len(values) + 1, *values.shape[1:]), np.int64)
    np.cumsum(values, axis=0, out=out[1:])
    return out


_ONE = {np.maximum: max, np.minimum: min, np.bitwise_or: operator.or_}  # the same for two numbers, of any size


def folded(pre: np.ndarray, last: np.ndarray, values: np.ndarray, fold: np.ufunc) -> np.ndarray:
    """``fold`` over values[pre[i]:last[i] + 1] of nested ranges in order: once over each stretch between their edges, then from inner to outer ranges."""
    one = _ONE[fold]
    if not len(pre):
        return values[:0]
    edges = np.unique(np.concatenate([pre, last + 1]))
    stretch = fold.reduceat(np.append(values, values[-1:]), edges)  # the last edge may be the end; its stretch is not used
    at, to = np.searchsorted(edges, pre), np.searchsorted(edges, last + 1)
    out: list = [None] * len(pre)
    open_: list[list] = []  # number, end, next stretch that is not folded yet
    parts = stretch.tolist()

    def close(until: int) -> None:
        while open_ and open_[-1][1] <= until:
            number, end, reached = open_.pop()
            for k in range(reached, end):
                out[number] = parts[k] if out[number] is None else one(out[number], parts[k])
            if open_:
                above = open_[-1]
                for k in range(above[2], int(at[number])):
                    out[above[0]] = parts[k] if out[above[0]] is None else one(out[above[0]], parts[k])
                out[above[0]] = out[number] if out[above[0]] is None else one(out[above[0]], out[number])
                above[2] = end

    for i in range(len(pre)):
        close(int(at[i]))
        open_.append([i, int(to[i]), int(at[i])])
    close(len(edges))
    return np.array(out, dtype=object if values.dtype == object else values.dtype)


_NEVER = 1 << 30


def _page_blocks(page: dict[str, np.ndarray], with_tags: bool) -> dict[str, np.ndarray] | None:
    """The blocks of one page, its nodes in order."""
    blk = np.flatnonzero(page["is_block"])
    if not len(blk):
        return None
    first = page["pre"][0]
    pre, last = page["pre"][blk] - first, page["last"][blk] - first
    sums = running_sums(np.stack([page[name] for name in SUMMED], axis=1))
    inside = dict(zip(SUMMED, (sums[last + 1] - sums[pre]).T))
    place = np.full(len(page["pre"]), -1)
    place[pre] = np.arange(len(blk))
    tails = np.flatnonzero(page["tail_of"] >= 0)
    owner = place[page["tail_of"][tails] - first]
    tails, owner = tails[owner >= 0], owner[owner >= 0]
    whole = dict(inside)
    for name in TAIL_SUMMED:
        whole[name] = inside[name] + np.bincount(owner, page[name][tails], len(blk)).astype(np.int64)
    parent = page["parent"] - first
    child = np.flatnonzero(parent >= 0)
    child = child[place[parent[child]] >= 0]
    below = {name: np.bincount(place[parent[child]], page[name][child], len(blk)).astype(np.int64) for name in ("block", "paragraph")}
    depth, element = page["depth"], page["is_element"]
    own = depth[blk]
    deepest = folded(pre, last, np.where(element, depth, -1), np.maximum)
    nearest = folded(pre, last, np.where(page["paragraph"] > 0, depth, _NEVER), np.minimum)
    linked = inside["linked"] - page["n_a"][blk] * inside["spaceless"]
    out = {
        "page_id": page["page_id"][blk],
        **{name: page[name][blk] for name in ("pre", "last", "src_start", "src_end")},
        "f_text_n": whole["bytes"],
        "f_p_n": inside["paragraph"],
        "f_tag_n": inside["tag_n"],
        "f_h_n": inside["heading"],
        "f_link_density": np.where(whole["spaceless"] == 0, 0.0, linked / np.maximum(whole["spaceless"], 1)),
        "f_np_n": inside["other"],
        "f_img_n": inside["img"],
        "f_a_n": inside["a"],
        "f_form_element_n": inside["form"],
        "f_element_maxtextlen": folded(pre, last, page["capture"], np.maximum),
        "f_none_n": whole["hid"],
        "f_side_n": whole["sid"],
        "f_main_n": whole["mai"],
        "f_child_div_n": below["block"],
        "f_child_p_n": below["paragraph"],
        "f_nav_n": whole["nav"],
        "f_li_n": inside["li"],
        "f_li_a_n": inside["li_a"],
        "f_h1_n": inside["h1"],
        "f_dom_depth": deepest - own,
        "f_depth_to_p": np.where(nearest < _NEVER, np.minimum(DEPTH_CAP, nearest - own), DEPTH_CAP),
    }
    if with_tags:
        # a set of tags is a number with a bit for each
        names = sorted(set(page["tag"][element].tolist()))
        bit = {name: 1 << i for i, name in enumerate(names)}
        bits = np.array([bit[t] if e else 0 for t, e in zip(page["tag"].tolist(), element)], dtype=object)
        held = folded(pre, last, bits, np.bitwise_or)
        lists = {number: [n for i, n in enumerate(names) if number >> i & 1] for number in set(held.tolist())}
        out["f_all_tags"] = [lists[number] for number in held.tolist()]
    return out


def block_features(
    nodes: DataFrame, with_tail: bool = True, with_tags: bool = False, is_block: Column | None = None, tail: Column | None = None
) -> DataFrame:
    """One row per div, section and article with the 21 numeric features.

    ``with_tail`` counts the text right after a block as part of it, as its
    serialised form does. ``with_tags`` adds the distinct tags as ``f_all_tags``. ``is_block`` and ``tail`` choose other nodes to
    measure and other runs that count for the node they follow. The nodes of a page must lie together and in order, as ``node_table`` returns them.
    """
    is_block = F.col("tag").isin(*BLOCK_TAGS) if is_block is None else is_block
    tail = F.lit(False) if not with_tail else F.col("tail_tag").isin(*BLOCK_TAGS) if tail is None else tail
    kinds = {"page_id": pa.int64(), **{n: pa.int32() for n in ("pre", "last", "src_start", "src_end")}, **{n: pa.int64() for n in FEATURES}}
    kinds["f_link_density"] = pa.float64()
    if with_tags:
        kinds["f_all_tags"] = pa.list_(pa.string())
    schema = pa.schema(list(kinds.items()))

    def blocks_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = {n: rows.column(n).to_numpy() for n in ("page_id", "pre", "last", "parent", "depth", "src_start", "src_end", "n_a", "is_element", "is_block", *SUMMED)}
        columns |= {n: rows.column(n).fill_null(-1).to_numpy().astype(np.int64) for n in ("tail_of", "capture")}
        columns["capture"] = np.maximum(columns["capture"], 0)
        columns["tag"] = np.array(rows.column("tag").to_pylist(), dtype=object) if with_tags else columns["page_id"]
        edges = [*np.flatnonzero(columns["pre"] == 0).tolist(), rows.num_rows]  # a page begins with its root
        found = [_page_blocks({n: c[a:b] for n, c in columns.items()}, with_tags) for a, b in zip(edges, edges[1:])]
        found = [f for f in found if f is not None]
        if found:
            joined = {n: [t for f in found for t in f[n]] if n == "f_all_tags" else np.concatenate([f[n] for f in found]) for n in kinds}
            yield pa.RecordBatch.from_arrays([pa.array(joined[n], kind) for n, kind in kinds.items()], schema=schema)

    fields = ["page_id bigint", *(f"{n} int" for n in ("pre", "last", "src_start", "src_end"))]
    fields += [f"{n} {'double' if n == 'f_link_density' else 'bigint'}" for n in FEATURES] + ["f_all_tags array<string>"] * with_tags
    return per_page(_measured(nodes, is_block, tail), blocks_of, ", ".join(fields))


def per_page(nodes: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on whole pages of nodes, which must lie together and in order as ``node_table`` returns them; a page begins with node 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("pre").to_numpy(zero_copy_only=False) == 0)
            if len(starts):
                # all pages but the last of this batch are whole
                if held or starts[-1]:
                    yield from work(pa.Table.from_batches([*held, batch.slice(0, starts[-1])]).combine_chunks())
                held = [batch.slice(starts[-1])]
            else:
                held.append(batch)
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return nodes.mapInArrow(run, schema)


def running_counts(nodes: DataFrame, condition: Column) -> DataFrame:
    """``page_id, pre, n``: how many nodes of the page up to and with this one meet ``condition``. A subtree's number is that of ``last`` less that before ``pre``."""

    def count(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        before = running_sums(rows.column("n").to_numpy())
        pre = rows.column("pre").to_numpy()
        starts = np.flatnonzero(pre == 0)
        n = before[1:] - before[np.repeat(starts, np.diff([*starts, len(pre)]))]
        yield pa.RecordBatch.from_arrays([rows.column("page_id").combine_chunks(), pa.array(pre), pa.array(n)], ["page_id", "pre", "n"])

    return per_page(nodes.select("page_id", "pre", _one(condition).alias("n")), count, "page_id bigint, pre int, n bigint")


def block_tags(nodes: DataFrame) -> DataFrame:
    """Distinct element tags of every block, one row each."""
    return block_features(nodes, with_tags=True).select("page_id", "pre", F.explode("f_all_tags").alias("tag"))


def fragment_features(fragments: DataFrame, id_col: str, html_col: str, root_mode: str = "element") -> DataFrame:
    """Features of stand-alone HTML fragments such as labelled blocks.

    ``element`` measures the fragment's first element of any name. ``document``
    measures the parsed document around it, html and body included, in which no
    node is a direct child of the measured one.
    """
    if root_mode not in ("element", "document"):
        raise ValueError(f"unknown root_mode {root_mode!r}")
    nodes = node_table(fragments, id_col, html_col, roots=root_mode == "element")
    if root_mode == "document":
        found = block_features(nodes, with_tail=False, with_tags=True, is_block=F.col("pre") == 0)
        zero = F.lit(0).cast("bigint")
        return found.withColumn("f_child_div_n", zero).withColumn("f_child_p_n", zero)
    # The root's tail counts as a block's tail does; no other tail does.
    return block_features(nodes, with_tags=True, is_block=F.col("pre") == F.col("root"), tail=F.col("tail_of") == F.col("root"))


def best_blocks(scored: DataFrame, min_text: int = 100, min_score: float = -0.1) -> DataFrame:
    """The best-scored block of each page; the first one wins ties."""
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), F.asc("pre"))
    ranked = scored.filter(F.col("f_text_n") > min_text).withColumn("_rank", F.row_number().over(order))
    return ranked.filter((F.col("_rank") == 1) & (F.col("score") >= min_score)).drop("_rank")


def ranked_blocks(scored: DataFrame) -> DataFrame:
    """All blocks of each page, best first."""
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), F.asc("pre"))
    return scored.withColumn("rank", F.row_number().over(order))
