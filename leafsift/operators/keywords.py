"""Keywords of documents: TF-IDF, co-occurrence rank, and the fallback between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.functions.text import keyword_csv, words
from leafsift.operators.vectors import corpus_idf, pieces, weighted_documents
from leafsift.session import stored

# Words that are never keywords of the co-occurrence rank.
STOP_WORDS = (
    "the of is and to in that we for an are by be as on with can if from which you it this then at have all not "
    "one has or"
).split()
# The English list of the second rank.
ENGLISH_STOP_WORDS = (
    "a about after all also an and any are as at be because been but by can could did do does for from had has have "
    "he her his how i if in into is it its may more most no not of on one only or other our out over she so some such "
    "than that the their them then there these they this to up was we were what when which who will with would you"
).split()

WIDE_SPAN, NARROW_SPAN = 5, 2
DAMPING, RANK_ROUNDS = 0.85, 10


def _ranked_words(docs: DataFrame, id_col: str, text_col: str, k: int, idf: DataFrame | None, complete: bool) -> DataFrame:
    """``id, kw``: the k words of highest TF-IDF in order, as (-weight, word); ties by word. Ordered inside the row, which is no larger than its text."""
    rows = weighted_documents(docs, id_col, text_col, idf, best=k, complete=complete)
    entry = F.transform("terms", lambda t, i: F.struct((-F.round(F.get("weights", i), 9)).alias("w"), t.alias("word")))
    return rows.select("id", F.slice(F.sort_array(entry), 1, k).alias("kw"))


def top_keywords(docs: DataFrame, id_col: str, text_col: str, k: int, idf: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """``id, word, weight, rank``: the k words of highest TF-IDF, ties by word. ``complete`` says that ``idf`` has all words of ``docs``."""
    rows = _ranked_words(docs, id_col, text_col, k, idf, complete).select("id", F.posexplode("kw").alias("at", "e"))
    return rows.select("id", F.col("e.word").alias("word"), (-F.col("e.w")).alias("weight"), (F.col("at") + 1).alias("rank"))


def keyword_lists(
    docs: DataFrame, id_col: str, text_col: str, k: int, name: str, idf: DataFrame | None = None, complete: bool = False
) -> DataFrame:
    """``id`` and the same k words as one comma-separated list."""
    return _ranked_words(docs, id_col, text_col, k, idf, complete).select("id", keyword_csv(F.col("kw.word")).alias(name))


def _near(doc: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all tokens that stand less than their document's ``width`` apart, the earlier one first."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gap in range(1, int(width.max(initial=1))):
        near = np.flatnonzero((doc[:-gap] == doc[gap:]) & (width[doc[gap:]] > gap))
        left.append(near)
        right.append(near + gap)
    return np.concatenate(left), np.concatenate(right)


def _edge_batches(span: int):
    entry = pa.struct([("dst", pa.string()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = lists.flatten().dictionary_encode()
            words = max(1, len(found.dictionary))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            nodes, at = np.unique(doc * words + found.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            a, b = (at[end] for end in _near(doc, np.full(len(sizes), span)))
            edge, weight = np.unique(np.concatenate([a * len(nodes) + b, b * len(nodes) + a]), return_counts=True)
            src, dst = np.divmod(edge, max(1, len(nodes)))
            word = lambda node: found.dictionary.take(pa.array(nodes[node] % words))
            first = np.flatnonzero(np.diff(src, prepend=-1))
            edges = pa.StructArray.from_arrays([word(dst), pa.array(weight.astype(np.int64))], fields=list(entry))
            offsets = pa.array(np.append(first, len(src)).astype(np.int32))
            columns = [batch.column(0).take(pa.array(nodes[src[first]] // words)), word(src[first]), pa.ListArray.from_arrays(offsets, edges)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "src", "edges"])

    return run


def cooccurrence_edges(docs: DataFrame, id_col: str, tokens: Column, span: int, grouped: bool = False) -> DataFrame:
    """``id, src, dst, weight``: how often two words stand less than ``span`` apart, both ways.

    ``grouped`` gives ``id, src, edges``: one row a word with the list of its (dst, weight). Edges are counted inside the row; only those of ids that
    several rows have are shuffled and summed. Jobs run while the frame is built.
    """
    again = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id")
    again = stored(again, "repeated")
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def counted(how: str) -> DataFrame:
        rows = docs.join(again, docs[id_col].eqNullSafe(again["_id"]), how) if how else docs
        schema = f"id {kind}, src string, edges array<struct<dst: string, weight: bigint>>"
        return rows.select(F.col(id_col).alias("id"), tokens.alias("_w")).mapInArrow(_edge_batches(span), schema)

    if not again.take(1):
        return counted("") if grouped else counted("").select("id", "src", F.inline("edges"))
    single = counted("left_anti")
    several = counted("left_semi").select("id", "src", F.inline("edges")).groupBy("id", "src", "dst").agg(F.sum("weight").alias("weight"))
    if not grouped:
        return single.select("id", "src", F.inline("edges")).unionByName(several)
    return single.unionByName(several.groupBy("id", "src").agg(F.collect_list(F.struct("dst", "weight")).alias("edges")))


def _rank_words(doc: np.ndarray, word: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, rank) of the words of many documents after a fixed number of rounds.

    ``doc`` and ``word`` number the documents and words of all tokens in order; ``width`` is the span of each document.
    """
    nodes, at = np.unique(doc * (int(word.max(initial=0)) + 1) + word, return_inverse=True)
    owner = nodes // (int(word.max(initial=0)) + 1)
    left, right = (at[end] for end in _near(doc, width))
    src, dst = np.concatenate([left, right]), np.concatenate([right, left])
    out = np.bincount(src, minlength=len(nodes))
    score = 1.0 / np.bincount(owner)[owner]
    for _ in range(RANK_ROUNDS):
        score = (1 - DAMPING) + DAMPING * np.bincount(dst, weights=score[src] / out[src], minlength=len(nodes))
    return owner, nodes % (int(word.max(initial=0)) + 1), score


def _rank_batches(k: int):
    names = ["id", "word", "weight", "rank", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            long_ = np.flatnonzero(sizes >= 2)
            batch = batch.take(pa.array(long_))
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            found = lists.flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(long_)), sizes[long_])
            span = batch.column(2).to_numpy(zero_copy_only=False)
            owner, word, score = _rank_words(doc, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), span)
            score = np.round(score, 9)
            # ties go to the word that sorts first
            alphabet = np.empty(len(found.dictionary), np.int64)
            alphabet[pc.array_sort_indices(found.dictionary).to_numpy()] = np.arange(len(found.dictionary))
            order = np.lexsort((alphabet[word], -score, owner))
            owner, word, score = owner[order], word[order], score[order]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner) + 1
            best = np.flatnonzero(rank <= k)
            columns = [
                batch.column(0).take(pa.array(owner[best])), found.dictionary.take(pa.array(word[best])), pa.array(score[best]),
                pa.array(rank[best].astype(np.int32)), pa.array(span[owner[best]].astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _without(tokens: Column, stop: list[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*stop))


def wide_tokens(text: Column) -> Column:
    return _without(words(text), STOP_WORDS)


def narrow_tokens(text: Column) -> Column:
    return _without(words(text), ENGLISH_STOP_WORDS)


def ranked_keywords(docs: DataFrame, id_col: str, tokens: Column, span: Column, k: int = 10) -> DataFrame:
    """``id, word, weight, rank`` by co-occurrence rank. One document is one row, so nothing is shuffled."""
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), tokens.alias("tokens"), span.alias("span"))
    return source.mapInArrow(_rank_batches(k), "id bigint, word string, weight double, rank int, span int")


def textrank(docs: DataFrame, id_col: str, text_col: str, k: int = 10) -> DataFrame:
    return ranked_keywords(docs, id_col, wide_tokens(F.col(text_col)), F.lit(WIDE_SPAN), k)


def english_textrank(docs: DataFrame, id_col: str, text_col: str, k: int = 10) -> DataFrame:
    return ranked_keywords(docs, id_col, narrow_tokens(F.col(text_col)), F.lit(NARROW_SPAN), k)


def tags_with_fallback(docs: DataFrame, id_col: str, text_col: str, k: int = 10, idf: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """``id, word, rank, source``: the first method that finds anything for a document.

    A rank needs two tokens, so the method is known per row before any work is done. ``idf`` is that of the
    whole article table, ``complete`` if it has all words of ``docs``; without it ``docs`` is the corpus.
    """
    text = F.col(text_col)
    routed = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    routed = routed.withColumn("_wide", wide_tokens(F.col("text"))).withColumn("_narrow", narrow_tokens(F.col("text")))
    source = F.when(F.size("_wide") >= 2, "wide").when(F.size("_narrow") >= 2, "narrow").otherwise("tfidf")
    routed = routed.withColumn("source", source)
    use_wide = F.col("source") == "wide"
    ranked = ranked_keywords(
        routed.filter(F.col("source") != "tfidf"), "id",
        F.when(use_wide, F.col("_wide")).otherwise(F.col("_narrow")),
        F.when(use_wide, WIDE_SPAN).otherwise(NARROW_SPAN), k,
    )
    rest = routed.filter(F.col("source") == "tfidf")
    plain = top_keywords(rest, "id", "text", k, idf=corpus_idf(docs, text_col, id_col) if idf is None else idf, complete=complete or idf is None)
    by_span = F.when(F.col("span") == WIDE_SPAN, "wide").otherwise("narrow")
    return ranked.select("id", "word", "rank", by_span.alias("source")).unionByName(
        plain.select("id", "word", "rank", F.lit("tfidf").alias("source"))
    )
