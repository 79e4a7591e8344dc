"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts are words (ASCII letters and digits and all non-ASCII characters, A-Z in lower case). A benchmark item's windows are its runs of
``span`` words; an item of fewer words is one window. A document's word is hit if any window of any item stands over it.

Winnowing keeps, of every run of ``span - gram + 1`` neighbouring k-grams (``gram`` words, hashed), the smallest hash. A window of
``span`` words is one such run, so documents and items that share a window have kept the same hash of it: joining the kept hashes misses no window.
Items shorter than a window cannot be winnowed; their whole run is one k-gram and all runs of that length of the documents
are kept, at each length below ``span`` that some item has (nothing is added where there is none).

Each joined hash is then extended to the windows it stands for: documents with joined hashes are read again, those of their windows whose kept
hash was joined are spelled out, and these are joined with the items' windows word for word. Hash collisions so cost time, not results.

Scale: a document is marked inside its row; its distinct kept hashes (about two in seven words) meet the items' by an equi-join that Spark broadcasts
only where the items' hashes are small, and whose other side is split where a passage is frequent. Only documents with joined hashes send
their text again, to one row of their own number. Windows of one document are the largest group.

Defined results: a null, empty or wordless text has no words and is clean; a null, empty or wordless item has no window. Items are told apart by item_id: rows
with the same one are parts of one item, and an item without id marks words but is not listed. Repeated documents each give their own row, doc_id may
be null, other columns are not read. Very long texts are held as one row's word array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.llm.batches import stored
from leafsift.llm.licenses import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of what is no word: ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(low: Column) -> Column:
    """The words of a text in lower case."""
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(hashes: Column, size: int) -> Column:
    """One hash for every run of ``size`` words, in order."""
    runs = F.transform(F.sequence(F.lit(1), F.size(hashes) - (size - 1)), lambda i: F.xxhash64(F.slice(hashes, i, size)))
    return F.when(F.size(hashes) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def winnowed(hashes: Column, span: int, gram: int) -> Column:
    """The smallest k-gram hash of every window of ``span`` words, in order."""
    held = span - gram + 1
    least = lambda g: F.transform(F.sequence(F.lit(1), F.size(g) - (held - 1)), lambda i: F.array_min(F.slice(g, i, held)))
    return let(grams(hashes, gram), lambda g: F.when(F.size(g) >= held, least(g)).otherwise(F.array().cast("array<bigint>")))


def _spelled(words: Column, starts: Column, size: int | Column) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(size).alias("size"), F.array_join(F.slice(words, i, size), " ").alias("words")))


def item_windows(items: DataFrame, span: int, gram: int) -> DataFrame:
    """(mark, size, words, items): each distinct window, the hash kept for it, and the sorted ids of the items that hold it."""
    read = items.select(F.col("item_id").cast("string").alias("item"), words_of(lowered(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    read = read.withColumn("h", hashed(F.col("w")))
    size = F.least(F.lit(span), F.size("w"))
    spelled = _spelled(F.col("w"), F.sequence(F.lit(1), F.size("w") - size + 1), size)
    marks = F.when(F.size("w") >= span, winnowed(F.col("h"), span, gram)).otherwise(F.array(F.xxhash64("h")))
    each = read.select("item", F.explode(F.arrays_zip(marks.alias("mark"), spelled.alias("window"))).alias("x"))
    rows = each.select("item", F.col("x.mark").alias("mark"), F.col("x.window.size").alias("size"), F.col("x.window.words").alias("words"))
    return rows.groupBy("mark", "size", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def scan(docs: DataFrame, items: DataFrame, span: int = 10, gram: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for every row of ``docs``: words inside windows of items, and those items' ids, sorted."""
    windows = stored(item_windows(items, span, gram), "decontamination-windows")
    shorter = sorted(r["size"] for r in windows.filter(F.col("size") < span).select("size").distinct().collect())  # fewer than ``span``

    def marked(words: Column) -> Column:
        def kept(h: Column) -> Column:
            return F.array_distinct(F.concat(winnowed(h, span, gram), *(grams(h, n) for n in shorter)))

        return F.struct(F.size(words).cast("long").alias("n_words"), let(hashed(words), kept).alias("marks"))

    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), lowered(F.col("text")).alias("low"))
    read = read.withColumn("m", let(words_of(F.col("low")), marked)).select("row", "doc_id", "low", "m.n_words", "m.marks")
    read = stored(read, "decontamination-documents")

    marks = stored(windows.select("mark").distinct(), "decontamination-marks")
    hits = read.select("row", F.explode("marks").alias("mark")).join(marks, "mark").groupBy("row").agg(F.collect_set("mark").alias("hits"))

    def near(words: Column) -> Column:
        """The windows whose kept hash was joined."""

        def at(h: Column) -> Column:
            runs = [(winnowed(h, span, gram), span), *((grams(h, n), n) for n in shorter)]
            hit = lambda kept: F.filter(F.transform(kept, lambda k, i: F.when(F.array_contains("hits", k), i + 1)), lambda i: i.isNotNull())
            return F.concat(*(_spelled(words, hit(kept), n) for kept, n in runs))

        return let(hashed(words), at)

    again = read.select("row", "low").join(hits, "row")
    places = again.select("row", F.explode(let(words_of(F.col("low")), near)).alias("x")).select("row", "x.start", "x.size", "x.words")
    found = places.join(windows.select("size", "words", "items"), ["size", "words"])
    found = found.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    nothing = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end"))
    add = lambda acc, r: F.struct((acc["hit"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], acc["end"]))).cast("long").alias("hit"), F.greatest(acc["end"], r["end"]).alias("end"))
    found = found.select("row", F.aggregate("runs", nothing, add)["hit"].alias("n_hit"), "items")
    out = read.select("row", "doc_id", "n_words").join(found, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
