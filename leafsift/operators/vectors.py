"""Words of documents, their document frequencies, and TF-IDF vectors.

A document's words are counted inside its row. Weights are given inside the row as well: the frequent words and their idf are
a list of at most ``LIST_WORDS`` entries that is sent to the tasks, cut at a power of two of the document frequency. Words of one document only, most of any vocabulary, share one idf
and need no list where the documents are the corpus. Where the vocabulary is larger still, the rare words left, each in few documents, meet the rest of the list by a shuffle and go back
to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.functions.text import words
from leafsift.session import release, stored

#: Words sent to the tasks with their idf: some 125 MB at most.
LIST_WORDS = 6_000_000


def pieces(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The same rows with at most so many entries in the lists of the second column at once, one row at least."""
    for batch in batches:
        ends = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        lists = batch.column(1)
        others = batch.schema.names[2:]
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = lists.flatten().dictionary_encode()
        alphabet = pc.array_sort_indices(found.dictionary).to_numpy()
        place = np.empty(len(alphabet), np.int64)
        place[alphabet] = np.arange(len(alphabet))
        code = place[found.indices.to_numpy(zero_copy_only=False)]
        key, count = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(alphabet)) + code, return_counts=True)
        row, code = np.divmod(key, max(1, len(alphabet)))
        offsets = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32))
        terms = pa.ListArray.from_arrays(offsets, found.dictionary.take(pa.array(alphabet[code])))
        counts = pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), terms, counts, *batch.columns[2:]], ["id", "terms", "counts", *others])


def _and(rows: DataFrame, names: tuple[str, ...]) -> str:
    return "".join(f", `{name}` {rows.schema[name].dataType.simpleString()}" for name in names)


def document_words(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, terms, counts`` and the columns ``keep``: the distinct words of each text in order, and how often each stands there.

    One row a document, nothing is shuffled.
    """
    listed = docs.select(F.col(id_col).cast("bigint").alias("id"), words(F.col(text_col)).alias("w"), *keep)
    return listed.mapInArrow(_count_words, "id bigint, terms array<string>, counts array<int>" + _and(listed, keep))


def document_frequency(counted: DataFrame) -> DataFrame:
    """``word, df``."""
    return counted.select(F.explode("terms").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def word_idf(counted: DataFrame) -> DataFrame:
    """``word, df, idf`` with the smoothed inverse document frequency ln((1+n)/(1+df)) + 1."""
    n = counted.agg(F.count(F.lit(1)).alias("n")).scalar()
    return document_frequency(counted).withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def corpus_idf(docs: DataFrame, text_col: str, id_col: str = "id") -> DataFrame:
    """``word, df, idf`` of a whole table, stored: it is read once for each use."""
    return stored(word_idf(document_words(docs, id_col, text_col)), "idf")


def _frequent(idf: DataFrame, complete: bool) -> tuple[pa.Table, float, float | None]:
    """The words of document frequency 2 ** b and more with their idf, and 2 ** b: the smallest for which they are few enough.

    Then the idf of all other words, if those are just the words of one document.
    """
    level = F.floor(F.log2(F.greatest("df", F.lit(1)) + F.lit(0.5))).cast("int")
    sizes = idf.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.max("idf").alias("idf")).collect()  # at most 64 rows
    held, least, single = 0, 64, None
    for level, n, value in sorted(((r["level"], r["n"], r["idf"]) for r in sizes), reverse=True):
        if complete and level == 0:
            least, single = 1, value
            break
        if held + n > LIST_WORDS:
            break
        held, least = held + n, level
    else:
        least = 0
    return idf.filter(F.col("df") >= 2.0**least).select("word", "idf").toArrow(), 2.0**least, single


def _listed_idf(entries: pa.Array, names: pa.Array, values: np.ndarray, other: float) -> np.ndarray:
    """The idf of every entry, ``other`` where it is not listed.

    The few different words of the entries are the table that the list is looked up in: the list is the longer one and would be hashed for every batch.
    """
    found = entries.dictionary_encode()
    at = pc.index_in(names, value_set=found.dictionary)
    idf = np.full(len(found.dictionary), other)
    idf[at.drop_null().to_numpy(zero_copy_only=False)] = values[at.is_valid().to_numpy(zero_copy_only=False)]
    return idf[found.indices.to_numpy(zero_copy_only=False)]


def _leading(row: np.ndarray, sizes: np.ndarray, weight: np.ndarray, best: int) -> np.ndarray:
    """The entries of each row that can be among its ``best`` highest weights when these are rounded to nine digits."""
    kept = np.ones(len(row), bool)
    some = np.flatnonzero((sizes > best)[row])
    if len(some):
        order = np.lexsort((-weight[some], row[some]))
        ranked, owner = weight[some][order], row[some][order]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        least = np.zeros(len(sizes))
        least[owner[first]] = ranked[first + best - 1]
        kept[some] = weight[some] >= least[row[some]] - 2e-9
    return kept


def weighted_words(counted: DataFrame, idf: DataFrame, complete: bool = False, best: int | None = None) -> DataFrame:
    """``id, terms, weights`` and the other columns of ``counted``: count * idf of every word that ``idf`` has, terms in order.

    ``complete`` says that ``idf`` has all words of ``counted``. ``best`` leaves words out that cannot be among so many of highest rounded weight.
    """
    keep = tuple(c for c in counted.columns if c not in ("id", "terms", "counts"))
    frequent, least, single = _frequent(idf, complete)
    rare = idf.filter(F.col("df") < least) if least > 1 and single is None else None
    listed = counted.sparkSession.sparkContext.broadcast((frequent.column("word").combine_chunks(), frequent.column("idf").to_numpy()))
    whole = rare is None

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = listed.value
        for batch in pieces(batches, 2_000_000):
            terms, counts = batch.column(1), batch.column(2)
            sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
            entries, count = terms.flatten(), counts.flatten().to_numpy(zero_copy_only=False)
            idf_of = _listed_idf(entries, names, values, np.nan if single is None else single)
            known, weight = ~np.isnan(idf_of), count * idf_of
            row = np.repeat(np.arange(len(sizes)), sizes)
            left_over = ~known
            if best is not None:
                at = np.flatnonzero(known)
                known[at] = _leading(row[at], np.bincount(row[at], minlength=len(sizes)), weight[at], best)

            def lists(kept: np.ndarray, column: pa.Array) -> pa.ListArray:
                offsets = np.searchsorted(row[kept], np.arange(len(sizes) + 1)).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), column.filter(pa.array(kept)))

            columns = [batch.column(0), lists(known, entries), lists(known, pa.array(weight)), *batch.columns[3:]]
            if not whole:
                columns += [lists(left_over, entries), lists(left_over, pa.array(count))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "terms", "weights", *keep, "_rare", "_counts"][: len(columns)])

    counted = counted.select("id", "terms", "counts", *keep)
    schema = "id bigint, terms array<string>, weights array<double>" + _and(counted, keep)
    if whole:
        return counted.mapInArrow(weigh, schema)
    rows = stored(counted.mapInArrow(weigh, schema + ", _rare array<string>, _counts array<int>"), "weighted")
    left = rows.select("id", F.inline(F.arrays_zip(F.col("_rare").alias("word"), F.col("_counts").alias("n")))).join(rare.select("word", "idf"), "word")
    more = left.groupBy("id").agg(F.collect_list(F.struct("word", (F.col("n") * F.col("idf")).alias("w"))).alias("_more"))  # no more than the document's words
    joined = rows.drop("_rare", "_counts").join(more, "id", "left")
    entry = F.arrays_zip(F.col("terms").alias("word"), F.col("weights").alias("w"))
    every = F.when(F.col("_more").isNull(), entry).otherwise(F.array_sort(F.concat(entry, "_more")))
    return joined.select("id", every.alias("e"), *keep).select("id", F.col("e.word").alias("terms"), F.col("e.w").alias("weights"), *keep)


def weighted_documents(
    docs: DataFrame, id_col: str, text_col: str, idf: DataFrame | None = None, keep: tuple[str, ...] = (), best: int | None = None, complete: bool = False
) -> DataFrame:
    """``weighted_words`` of ``docs``. Without ``idf`` they are the corpus: their words are counted once and the result is a stored table."""
    counted = document_words(docs, id_col, text_col, keep)
    if idf is not None:
        return weighted_words(counted, idf, complete, best)
    counted = stored(counted, "words")
    idf = stored(word_idf(counted), "idf")
    out = stored(weighted_words(counted, idf, complete=True, best=best), "weighted")
    release(counted, idf)
    return out


def unit(weights: Column) -> Column:
    """The weights divided by their L2 norm, which is taken once a row: a projection of its own would be merged into the division and taken for every element."""
    length = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda s, w: s + w * w))
    return F.transform(F.array(length), lambda n: F.transform(weights, lambda w: w / n))[0]


def tfidf_vectors(docs: DataFrame, id_col: str, text_col: str, idf: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, terms, weights`` and the columns ``keep``: L2-normalised TF-IDF, terms in order.

    Documents without any word have no vector.
    """
    rows = weighted_documents(docs, id_col, text_col, idf, keep).filter(F.size("terms") > 0)
    return rows.select("id", "terms", unit(F.col("weights")).alias("weights"), *keep)


def vector_entries(vectors: DataFrame) -> DataFrame:
    """Long form ``id, word, weight``."""
    zipped = F.arrays_zip(F.col("terms").alias("word"), F.col("weights").alias("weight"))
    return vectors.select("id", F.inline(zipped))
