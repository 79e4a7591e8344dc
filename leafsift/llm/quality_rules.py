"""Quality rules: boosted trees over document statistics.

The statistics of a text are exact counts. Trees are grown on histograms of a
bounded sample of labelled documents, with the direction of chosen features
fixed, and flattened into numpy node arrays that score a batch of rows at once.

Defined results: a null text has no words, so it fails the base rule (fewer than
50 words); so does an empty one. Repeated rows each give their own row; a null
doc_id is kept as it is. Without any labelled row, or with one class only, there is
no forest and the base rule alone decides. Other columns of ``docs`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.llm.batches import IS_SPACE, Bytes, Words, dense, firsts, lengths_of, pack, per_slice, slices, sums_between, texts_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_bytes", "n_upper", "n_digits", "n_lines", "n_distinct_words", "n_stops", "n_short_words", "n_marks")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + MORE)

#: Features and the direction their effect on quality may take: -1 falling, +1 rising, 0 free.
FEATURES = {
    "words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "words_per_line": 0,
    "distinct_share": 0,
    "stop_share": 0,
    "short_share": 0,
    "mark_share": 0,
}


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SYMBOL = _table(b"#*$%&|<>")
UPPER = _table(bytes(range(65, 91)))
DIGIT = _table(bytes(range(48, 58)))
STOP = _table(b".!?")
MARK = _table(b",;:()\"'-")


def statistics(raw: Bytes) -> dict[str, np.ndarray]:
    """The counts of every text, by name."""
    words = Words.of(raw)
    n_texts = len(raw)
    lead = (raw.data & 0xC0) != 0x80
    per_text = lambda mask: sums_between(mask, raw.bounds)
    text_of = words.text_of
    sizes = lengths_of(words.distinct)
    out = {
        "n_words": words.counts,
        "word_chars": per_text(lead & ~IS_SPACE[raw.data]),
        "n_symbols": per_text(SYMBOL[raw.data]),
        "n_repeat_words": repeated_words(words),
        "n_bytes": np.diff(raw.bounds),
        "n_upper": per_text(UPPER[raw.data]),
        "n_digits": per_text(DIGIT[raw.data]),
        "n_stops": per_text(STOP[raw.data]),
        "n_marks": per_text(MARK[raw.data]),
        "n_short_words": sums_between(sizes[words.ids] <= 3, words.first),
    }
    out["n_distinct_words"] = sums_between(firsts(*dense(text_of * max(1, len(words.distinct)) + words.ids)), words.first)
    out["n_lines"], out["n_dup_lines"] = line_counts(raw, words, n_texts)
    return out


def repeated_words(words: Words, width: int = 3) -> np.ndarray:
    """Words inside windows of ``width`` words that occur twice or more in their text, all occurrences counted."""
    n = len(words.ids)
    covered = np.zeros(n + 1, dtype=np.int64)
    text_of = words.text_of
    if n >= width:
        begin = np.flatnonzero(text_of[width - 1 :] == text_of[: n - width + 1])
        kinds = len(words.distinct)
        code = words.ids[begin]
        for step in range(1, width):
            if kinds ** (step + 1) >= 2**62:  # only in very long texts
                code, _ = dense(code)
            code = code * kinds + words.ids[begin + step]
        code, _ = dense(code)
        code, kinds = dense(text_of[begin] * (len(code) + 1) + code)
        twice = begin[np.bincount(code, minlength=kinds)[code] >= 2]
        covered[twice] += 1  # the places are distinct
        covered[twice + width] -= 1
    return sums_between(np.cumsum(covered)[:n] > 0, words.first)


def line_counts(raw: Bytes, words: Words, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and those of them equal to an earlier line of the text."""
    breaks = raw.data == 10
    inner = raw.bounds[:-1]
    starts = np.union1d(inner[np.diff(raw.bounds) > 0], np.flatnonzero(breaks) + 1)
    starts = starts[starts < len(raw.data)]
    if not len(starts):
        return np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    ends = np.append(starts[1:], len(raw.data))
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    text_of = np.searchsorted(raw.bounds, starts, side="right") - 1
    kept = raw.data[~breaks]
    before = np.zeros(len(raw.data) + 1, dtype=np.int64)
    np.cumsum(~breaks, out=before[1:])
    lines = pack(kept, np.append(before[starts], len(kept)))
    lines = lines.filter(pa.array(full)).dictionary_encode()
    text_of = text_of[full]
    code = text_of * (len(lines.dictionary) + 1) + lines.indices.to_numpy(zero_copy_only=False)
    total = np.bincount(text_of, minlength=n_texts)
    distinct = np.bincount(text_of[firsts(*dense(code))], minlength=n_texts)
    return total, total - distinct


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row per document, columns as in FEATURES."""
    value = {k: np.asarray(v, dtype=np.float64) for k, v in counts.items()}
    share = lambda a, b: value[a] / np.maximum(1.0, value[b])
    columns = {
        "words": np.log1p(value["n_words"]),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "words_per_line": np.log1p(share("n_words", "n_lines")),
        "distinct_share": share("n_distinct_words", "n_words"),
        "stop_share": share("n_stops", "n_words"),
        "short_share": share("n_short_words", "n_words"),
        "mark_share": share("n_marks", "n_words"),
    }
    return np.column_stack([columns[name] for name in FEATURES])


@dataclass
class Forest:
    """Trees one after another in flat arrays; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        at_row = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                low = rows[at_row, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return total

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(rows)))


def fit_forest(
    rows: np.ndarray,
    labels: np.ndarray,
    directions: tuple[int, ...] = tuple(FEATURES.values()),
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 48,
    least_hessian: float = 2.0,
    ridge: float = 1.0,
) -> Forest | None:
    """Newton boosting of the logistic loss on binned features; None unless both classes occur.

    A split on a feature with a direction must order its two sides' values that
    way, and the values below it stay on their side of the middle between them, so each tree, and
    so their sum, is monotonic in the feature.
    """
    labels = np.asarray(labels, dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        return None
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in rows.T]
    binned = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, rows.T)])
    base = float(np.log(labels.mean() / (1 - labels.mean())))
    margin = np.full(len(labels), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - labels, p * (1 - p)

        def grow(at: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = grad[at].sum(), hess[at].sum()
            own = float(np.clip(-g / (h + ridge), low, high))
            number = len(nodes)
            nodes.append([0, 0.0, number, number, rate * own])
            best = (1e-6, None)
            if level < depth and h >= 2 * least_hessian:
                for f, direction in enumerate(directions):
                    if not len(cuts[f]):
                        continue
                    size = len(cuts[f]) + 1
                    gl = np.cumsum(np.bincount(binned[at, f], grad[at], size))[:-1]
                    hl = np.cumsum(np.bincount(binned[at, f], hess[at], size))[:-1]
                    gr, hr = g - gl, h - hl
                    vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                    # what the two clipped values take off the loss
                    gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2 + gr * vr + 0.5 * (hr + ridge) * vr**2) + (g * own + 0.5 * (h + ridge) * own**2)
                    fine = (hl >= least_hessian) & (hr >= least_hessian) & (direction * (vr - vl) >= 0)
                    gain = np.where(fine, gain, -np.inf)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, vl[k], vr[k]))
            if best[1] is None:
                margin[at] += rate * own
                return number
            f, k, vl, vr = best[1]
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[directions[f]]
            below = binned[at, f] <= k
            left = grow(at[below], level + 1, *bounds[0])
            right = grow(at[~below], level + 1, *bounds[1])
            nodes[number] = [f, float(cuts[f][k]), left, right, 0.0]
            return number

        roots.append(grow(np.arange(len(labels)), 0, -4.0, 4.0))
    flat = np.array(nodes)
    return Forest(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots), depth, base)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the exact counts of every text."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        counts = statistics(Bytes.of(part.column("text")))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.asarray(counts[c], np.int64)) for c in COUNTS + MORE)], ["doc_id", *COUNTS, *MORE])

    return per_slice(docs, work, STATS_SCHEMA)


def labelled_ids(labels: DataFrame, label: str, rows: int, learn: Column | None = None) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled ids, chosen by a hash of the id. An id labelled twice keeps its smaller label."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    if learn is not None:
        ids = ids.filter(learn)
    return ids.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the sampled ids: only those bounded ids are broadcast, and no text is shuffled."""
    return texts_of(docs).join(F.broadcast(ids), "doc_id")


def one_of_each(rows: DataFrame) -> DataFrame:
    """One row of each doc_id: the smallest by its other columns, so that the order of rows does not matter."""
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_row")).select("doc_id", "_row.*")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, **settings) -> Forest | None:
    """A forest from the counts of at most ``sample_rows`` labelled documents (only counts reach the driver)."""
    ids = labelled_ids(labels, "quality", sample_rows)
    counts = document_statistics(labelled_texts(docs, ids)).join(F.broadcast(ids), "doc_id")
    found = one_of_each(counts).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    if not len(found):
        return None
    passes = ~base_fails(found["n_words"].to_numpy(), found["n_repeat_words"].to_numpy())
    rows = features({c: found[c].to_numpy() for c in COUNTS + MORE})
    return fit_forest(rows[passes], found["label"].to_numpy()[passes], **settings)


def base_fails(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def verdicts(raw: Bytes, forest: Forest | None, least: float) -> dict[str, np.ndarray]:
    """All counts of the texts, whether the base rule fails, the forest's probability, and whether each is kept."""
    counts = statistics(raw)
    failed = base_fails(counts["n_words"], counts["n_repeat_words"])
    score = np.ones(len(raw)) if forest is None else forest.probability(features(counts))
    return counts | {"base_failed": failed, "score": score, "kept": ~failed & (score >= least)}


def judge(docs: DataFrame, forest: Forest | None, least: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, the forest's score and kept, for every row."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = verdicts(Bytes.of(part.column("text")), forest, least)
        names = [*COUNTS, "base_failed", "score", "kept"]
        kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "score": pa.float64()}
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[n], kinds.get(n, pa.int64())) for n in names)], ["doc_id", *names])

    return per_slice(docs, work, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")


def keep(docs: DataFrame, forest: Forest | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(verdicts(Bytes.of(pc.cast(part.column("text"), pa.string())), forest, least)["kept"]))

    return docs.mapInArrow(run, docs.schema)
