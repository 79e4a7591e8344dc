"""Toxicity by class-conditional Kneser-Ney models of the characters in words.

Labelled texts are counted by class as n-grams of bytes inside words. Each class's
probability of a byte after its context takes an absolute discount off that class's counts and gives what is freed
to one backoff model that both classes share: Kneser-Ney continuation counts
of ever shorter contexts. A rare expression so gets nearly the same probability from both.
Under the shared backoff a byte not seen after a context differs between the classes by the context's freed
share alone, so scoring needs two tables: the log ratio of every n-gram
seen, and of every context. Both are Spark tables by the full n-gram and grow with the corpus.

Scoring reduces the texts to their distinct words, joins the n-grams of those by shuffle, scores every word once and
joins word scores back to documents. N-grams that make up at least 1 / ``HOT_GRAMS`` of the words' n-grams and words that make up
at least 1 / ``HOT_WORDS`` of the texts are sent to the tasks instead, so no shuffled key has more; there cannot be more of them than
that. Values are whole multiples of 1 / ``UNIT``, so that sums do not depend on their order.

The toxic and the ordinary log-likelihood of each word are compared per byte, and means over the words of a text
of what exceeds some thresholds go into a logistic curve fitted on a fold that was not counted: toxic passages are short,
and a mean over whole likelihoods drowns them (see the README for figures).

Defined results: null, empty and wordless texts have no word to compare and get the curve's value at zero. Without both
labels among the counted rows every score is the share of label 1 there (0 without any). Repeated rows each give
their own row; an id labelled twice counts with its smaller label. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.llm.batches import SLICE_BYTES, Bytes, Words, dense, release, slices, spread_repeats, stored, sums_between, texts_of, tidy
from leafsift.llm.quality_rules import labelled_ids, labelled_texts

#: Bytes of an n-gram.
ORDER = 7
#: The share of all rows (1 / n) from which an n-gram or a word is sent to the tasks.
HOT_GRAMS, HOT_WORDS = 1 << 12, 1 << 20
#: Steps of the values that are added up.
UNIT = 1 << 24
#: Rows held in a task before they are summed and handed on.
HELD_ROWS = 1 << 19
#: Marks the beginning of a word.
START = 1
TRIM = ".,;:!?\"'()[]{}*#$%&|<>-_"
FEATURES = 5
NAMES = [f"f{i}" for i in range(FEATURES)]


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, Words]:
    """The number of every token's word, the distinct words (trimmed, in lower case), and the batch's words as they stand."""
    words = Words.of(Bytes.of(texts))
    trimmed = pc.utf8_trim(pc.utf8_lower(words.distinct.cast(pa.large_string())), TRIM).dictionary_encode()
    return trimmed.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.ids], trimmed.dictionary, words


def grams_of(distinct: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each word with its closing blank, the word of every n-gram, and the bytes of every n-gram."""
    raw = Bytes.of(distinct)
    lengths = np.diff(raw.bounds) + 1
    data = np.full(int(lengths.sum()), 32, np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = spread_repeats(lengths)
    data[place < (lengths - 1)[owner]] = raw.data
    grams = np.zeros(len(data), np.int64)
    for back in range(order):
        earlier = np.full(len(data), START, np.int64)
        inside = np.flatnonzero(place >= back)
        earlier[inside] = data[inside - back]
        grams |= earlier << (8 * back)
    return lengths, owner, grams


@dataclass
class WordGrams:
    """The n-grams of the distinct words of a batch, trimmed and in lower case, each word closed by a blank."""

    word: np.ndarray  # number of the word of every token of the batch
    lengths: np.ndarray  # bytes of each word, with the blank
    owner: np.ndarray  # the word of every n-gram
    grams: np.ndarray  # the bytes of every n-gram, the last in the low bits
    words: Words

    @classmethod
    def of(cls, texts: pa.Array, order: int = ORDER) -> WordGrams:
        word, distinct, words = tokens_of(texts)
        lengths, owner, grams = grams_of(distinct, order)
        return cls(word, lengths, owner, grams, words)


def count_grams(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ordinary, toxic): how often every n-gram occurs in texts of each label, summed in each task first, a bounded number of rows at a time."""
    names = ["gram", "ordinary", "toxic"]

    def summed(held: list[pa.Table]) -> list[pa.RecordBatch]:
        total = pa.concat_tables(held).group_by("gram").aggregate([("ordinary", "sum"), ("toxic", "sum")])
        return total.rename_columns(names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches):
            found = WordGrams.of(part.column("text"), order)
            label = np.repeat(part.column("label").to_numpy(zero_copy_only=False), found.words.counts)
            by_word = [np.bincount(found.word[label == c], minlength=len(found.lengths)) for c in (0, 1)]
            ids, kinds = dense(found.grams)
            gram = np.empty(kinds, np.int64)
            gram[ids] = found.grams
            counts = [np.bincount(ids, n[found.owner], minlength=kinds).astype(np.int64) for n in by_word]
            held.append(pa.table(dict(zip(names, [gram, *counts]))))
            size += kinds
            if size >= HELD_ROWS:
                again = pa.Table.from_batches(summed(held))
                if again.num_rows > HELD_ROWS // 2:
                    yield from again.to_batches()
                    again = again.slice(0, 0)
                held, size = [again], again.num_rows
        if held:
            yield from summed(held)

    rows = labelled.select("text", "label").mapInArrow(run, "gram long, ordinary long, toxic long")
    return rows.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _discount(counts: DataFrame, column: str) -> float:
    """n1 / (n1 + 2 n2), from how many entries were counted once and twice."""
    one, two = counts.agg(F.sum((F.col(column) == 1).cast("long")), F.sum((F.col(column) == 2).cast("long"))).first()
    return float(min(0.95, max(0.1, (one or 0) / max(1, (one or 0) + 2 * (two or 0)))))


def shared_backoff(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(suffix, p): the shared probability of the last byte of every n-gram's suffix of order-1 bytes, by continuation counts."""
    suffix = lambda c, n: F.col(c).bitwiseAND(F.lit((1 << (8 * n)) - 1))
    levels, finer = [], grams.select("gram")
    for n in range(order - 1, 0, -1):
        finer = stored(finer.groupBy(suffix("gram", n).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "toxicity-level")
        levels.append((n, finer))
        finer = finer.select("gram")
    below = None
    for n, level in reversed(levels):
        counted = level
        d = _discount(level, "n")
        context = F.shiftright("gram", 8)
        totals = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(F.least(F.lit(d), "n")).alias("freed"))
        level = level.withColumn("context", context).join(totals, "context")
        if below is None:
            lower = F.lit(1 / 256)
        else:
            level = level.withColumn("lower", suffix("gram", n - 1)).join(below.withColumnRenamed("suffix", "lower"), "lower")
            lower = F.col("p")
        p = (F.greatest(F.col("n") - d, F.lit(0.0)) + F.col("freed") * lower) / F.col("total")
        coarser, below = below, stored(level.select(F.col("gram").alias("suffix"), p.alias("p")), "toxicity-backoff")
        release(counted, *([coarser] if coarser is not None else []))
    return below


def log_ratios(grams: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(key, value) of every n-gram and of every context, stored: log P(byte | context, toxic) - log P(byte | context, ordinary)."""
    classes = ("ordinary", "toxic")
    d = {c: _discount(grams, c) for c in classes}
    context = F.shiftright("gram", 8)
    sums = [F.sum(c).alias(f"total_{c}") for c in classes] + [F.sum(F.least(F.lit(d[c]), c)).alias(f"freed_{c}") for c in classes]
    contexts = stored(grams.groupBy(context.alias("context")).agg(*sums), "toxicity-contexts")
    seen = grams.withColumn("context", context).withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1)))
    backoff = shared_backoff(grams, order)
    seen = seen.join(backoff, "suffix").join(contexts, "context")

    def p(c: str) -> Column:
        own = (F.greatest(F.col(c) - d[c], F.lit(0.0)) + F.col(f"freed_{c}") * F.col("p")) / F.col(f"total_{c}")
        return F.when(F.col(f"total_{c}") > 0, own).otherwise(F.col("p"))

    share = lambda c: F.when(F.col(f"total_{c}") > 0, F.col(f"freed_{c}") / F.col(f"total_{c}")).otherwise(1.0)
    of_grams = seen.select(F.col("gram").alias("key"), (F.log(p("toxic")) - F.log(p("ordinary"))).alias("value"))
    of_contexts = contexts.select(F.col("context").alias("key"), (F.log(share("toxic")) - F.log(share("ordinary"))).alias("value"))
    ratios = stored(of_grams, "toxicity-ratios")
    release(backoff)
    out = ratios, stored(of_contexts, "toxicity-shares")
    release(contexts)
    return out


# ---------------------------------------------------------------- word scores


def _summed(parts: list[pa.Table], key: str) -> pa.Table:
    return pa.concat_tables(parts).group_by(key).aggregate([("n", "sum")]).rename_columns([key, "n"])


def _counted(rows: DataFrame, counts: Callable[[pa.RecordBatch], pa.Table], key: str, kind: str, column: str = "text") -> DataFrame:
    """(key, n): the sums of what ``counts`` finds in each slice, summed in each task first, a bounded number of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, column=column):
            held.append(counts(part))
            size += held[-1].num_rows
            if size >= HELD_ROWS:
                yield from _summed(held, key).to_batches()
                held, size = [], 0
        if held:
            yield from _summed(held, key).to_batches()

    return rows.mapInArrow(run, f"{key} {kind}, n long").groupBy(key).agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(id, word, n): every distinct word and how often it stands in the texts; the ids are stored."""

    def counts(part: pa.RecordBatch) -> pa.Table:
        word, distinct, _ = tokens_of(part.column("text"))
        return pa.table({"word": distinct.cast(pa.string()), "n": np.bincount(word, minlength=len(distinct)).astype(np.int64)})

    found = _counted(texts_of(docs).select("text"), counts, "word", "string")
    return stored(found.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "toxicity-words")


def gram_values(words: DataFrame, of_grams: DataFrame, of_contexts: DataFrame, order: int) -> DataFrame:
    """(gram, value, n) of the words' n-grams: its log ratio in units, that of its context if it was never seen, none if neither was; n words' places."""

    def counts(part: pa.RecordBatch) -> pa.Table:
        ids, kinds = dense(found := grams_of(part.column("word"), order)[2])
        gram = np.empty(kinds, np.int64)
        gram[ids] = found
        return pa.table({"gram": gram, "n": np.bincount(ids, minlength=kinds).astype(np.int64)})

    grams = _counted(words.select("word"), counts, "gram", "long", "word").withColumn("context", F.shiftright("gram", 8))
    grams = grams.join(of_grams.select(F.col("key").alias("gram"), F.col("value").alias("own")), "gram", "left")
    grams = grams.join(of_contexts.select(F.col("key").alias("context"), F.col("value").alias("other")), "context", "left")
    value = F.round(F.coalesce("own", "other", F.lit(0.0)) * UNIT).cast("long")
    return stored(grams.select("gram", value.alias("value"), "n"), "toxicity-values")


def _hot(rows: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose n is at least 1 / ``share`` of all n, at most ``share`` of them; and the others."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * share >= total
    return rows.filter(hot), rows.filter(~hot)


def word_features(words: DataFrame, values: DataFrame, order: int) -> DataFrame:
    """(word, n, f0 ..) for every word, in units: what its log ratio exceeds some thresholds by."""
    hot, cold = _hot(values, HOT_GRAMS)
    held = hot.select("gram", "value").toArrow().sort_by("gram")  # at most HOT_GRAMS rows
    known, value = (held.column(c).to_numpy() for c in ("gram", "value"))

    def places(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
        return at, (known[at] == grams) if len(known) else np.zeros(len(grams), bool)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES // 8, "word"):
            _, owner, grams = grams_of(part.column("word"), order)
            keep = ~places(grams)[1]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner[keep])), pa.array(grams[keep])], ["id", "gram"])

    rows = words.select("id", "word").mapInArrow(others, "id long, gram long")
    sums = rows.join(cold.filter("value <> 0").select("gram", "value"), "gram").groupBy("id").agg(F.sum("value").alias("rest"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column="word"):
            lengths, owner, grams = grams_of(part.column("word"), order)
            at, there = places(grams)
            whole = part.column("rest").to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(whole, owner[there], value[at[there]])
            by_word = thresholds(whole / UNIT, lengths)
            yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), *(pa.array(c) for c in by_word.T)], ["word", "n", *NAMES])

    whole = words.join(sums, "id", "left").select("word", "n", F.coalesce("rest", F.lit(0)).alias("rest"))
    return stored(whole.mapInArrow(finish, "word string, n long, " + ", ".join(f"{c} long" for c in NAMES)), "toxicity-word-features")


def thresholds(whole: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The features of words from their log ratios, one row each, in units."""
    per_byte = whole / lengths
    over = lambda x, least: np.maximum(x - least, 0)
    by_word = np.column_stack([over(whole, 2), over(per_byte, 0.25), over(per_byte, 0.5), over(per_byte, 0.75), np.clip(whole, -1, 1)])
    return np.rint(by_word * UNIT).astype(np.int64)


def document_features(docs: DataFrame, by_word: DataFrame) -> DataFrame:
    """(doc_id, f0 ..) for every row of ``docs``: means over the words of its text."""
    hot, cold = _hot(by_word, HOT_WORDS)
    held = hot.select("word", *NAMES).toArrow().combine_chunks()  # at most HOT_WORDS rows
    known = held.column("word").combine_chunks() if held.num_rows else pa.array([], pa.string())
    value = np.column_stack([*(held.column(c).to_numpy() for c in NAMES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for part in slices(batches):
            word, distinct, words = tokens_of(part.column("text"))
            at = pc.index_in(distinct.cast(pa.string()), value_set=known)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            own = np.zeros((len(distinct), FEATURES), np.int64)
            own[hit] = value[at.fill_null(0).to_numpy(zero_copy_only=False)[hit]]
            sums = sums_between(own[word], words.first)
            rare = np.flatnonzero(~hit[word])
            pairs, kinds = dense(words.text_of[rare] * len(distinct) + word[rare])
            pair = np.empty(kinds, np.int64)
            pair[pairs] = words.text_of[rare] * len(distinct) + word[rare]
            times = np.bincount(pairs, minlength=kinds).astype(np.int64)
            order = np.argsort(pair, kind="stable")
            text, word, times = pair[order] // max(1, len(distinct)), pair[order] % max(1, len(distinct)), times[order]
            bounds = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
            rows = np.arange(row, row + part.num_rows, dtype=np.int64)
            row += part.num_rows
            lists = [
                pa.ListArray.from_arrays(bounds, distinct.take(pa.array(word)).cast(pa.string())),
                pa.ListArray.from_arrays(bounds, pa.array(times)),
            ]
            columns = [pa.array(rows), part.column("doc_id"), pa.array(words.counts.astype(np.int64)), *(pa.array(c) for c in sums.T), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "words", *NAMES, "rare", "times"])

    kinds = "row long, doc_id long, words long, " + ", ".join(f"{c} long" for c in NAMES) + ", rare array<string>, times array<long>"
    rows = stored(texts_of(docs).mapInArrow(run, kinds), "toxicity-rows")  # row numbers must not change between the two uses
    pairs = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("word"), F.col("p.times").alias("times"))
    more = pairs.join(cold.drop("n"), "word").groupBy("row").agg(*(F.sum(F.col(c) * F.col("times")).alias(f"more_{c}") for c in NAMES))
    both = rows.select("row", "doc_id", "words", *NAMES).join(more, "row", "left")
    mean = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))) / F.lit(float(UNIT)) / F.greatest("words", F.lit(1))
    return both.select("doc_id", *(F.log1p(50 * mean(c)).alias(c) for c in NAMES[:4]), *(mean(c).alias(c) for c in NAMES[4:]))


@dataclass
class Model:
    grams: DataFrame | None  # (key, value): the log ratio of every n-gram, and of every context
    contexts: DataFrame | None
    order: int
    prior: float
    weights: np.ndarray | None = None

    def features(self, docs: DataFrame) -> DataFrame:
        """(doc_id, f0 ..) for every row of ``docs``; what it reads is stored, and no table of this model among it."""
        words = vocabulary(docs)
        tidy(docs.sparkSession)
        values = gram_values(words, self.grams, self.contexts, self.order)
        tidy(docs.sparkSession)
        by_word = word_features(words, values, self.order)
        release(words, values)
        return document_features(docs, by_word)

    def release(self) -> None:
        """Delete the model's tables; results of ``features`` and ``score`` already asked for stay whole."""
        release(*(t for t in (self.grams, self.contexts) if t is not None))


def fit_curve(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; weights of the rows as they are, the intercept first."""
    mean, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-9)
    x = np.column_stack([np.ones(len(rows)), (rows - mean) / scale])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6), x.T @ (p - labels) + penalty * w)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(size, 1e-9))
        if size < 1e-8:
            break
    return np.concatenate([[w[0] - (w[1:] * mean / scale).sum()], w[1:] / scale])


def train(docs: DataFrame, labels: DataFrame, count_rows: Column, curve_rows: Column, sample_rows: int = 20_000, order: int = ORDER) -> Model:
    """A model from all rows of ``labels`` that pass ``count_rows``; the curve from at most ``sample_rows`` that pass ``curve_rows``.

    Both conditions are on doc_id. The labels join the texts by shuffle, since neither is bounded.
    """
    texts = texts_of(docs)
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).dropna().filter(count_rows)
    ids = ids.groupBy("doc_id").agg(F.min("label").alias("label"))
    labelled = texts.filter(count_rows).join(ids, "doc_id")
    rows, toxic = ids.agg(F.count(F.lit(1)), F.sum("label")).first()
    model = Model(None, None, order, float(toxic or 0) / max(1, rows))
    if not 0 < model.prior < 1:
        return model
    counts = stored(count_grams(labelled, order), "toxicity-grams")
    tidy(docs.sparkSession)  # the labelled texts have been shuffled
    model.grams, model.contexts = log_ratios(counts, order)
    release(counts)
    sample = labelled_ids(labels, "toxic", sample_rows, curve_rows)
    rows = model.features(labelled_texts(docs, sample)).groupBy("doc_id").agg(F.min(F.struct(*NAMES)).alias("f")).select("doc_id", "f.*")  # one row an id
    found = rows.join(F.broadcast(sample), "doc_id").orderBy("doc_id").toPandas()
    if len(found) and found["label"].nunique() == 2:
        model.weights = fit_curve(found[NAMES].to_numpy(), found["label"].to_numpy())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""

    if model.weights is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(model.prior).alias("score"))
    parts = [F.col(c) * F.lit(float(w)) for c, w in zip(NAMES, model.weights[1:])]
    z = sum(parts, F.lit(float(model.weights[0])))
    return model.features(docs).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
