"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. A passage is encoded from the means of learned
vectors of its words (hashed) and of their shapes (runs of capitals, letters, digits, marks), and from how far its words repeat. Gated attention gives each
passage a weight, learned from document labels only, and the weighted
representation is scored. Parameters are fitted with Adam on a bounded sample of labelled documents.

Defined results: a null or wordless text is one passage without words; repeated rows each give their own row; an
id labelled twice counts with its smaller label. Without both labels in the sample every score is the share of label
1 there (0.5 without any). Columns other than doc_id and text are never looked at by ``score``, and are passed on by ``keep``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.llm.batches import Bytes, Words, dense, firsts, per_slice, slices, sums_between
from leafsift.llm.quality_rules import labelled_ids, labelled_texts, one_of_each

PASSAGE_WORDS = 64
WORD_BUCKETS, SHAPE_BUCKETS = 1 << 13, 1 << 9
#: Size of a passage's representation, and of the attention's hidden layer.
WIDTH, HIDDEN = 16, 12

_SHAPE = {ord(c): "9" for c in "0123456789"} | {c: "A" for c in range(65, 91)} | {c: "a" for c in range(97, 123)} | {c: "a" for c in range(0xC0, 0x250)}
_RUNS = re.compile(r"([^\n])\1+")


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The word bucket and the shape bucket of every distinct word."""
    text = words.distinct.cast(pa.large_string()).to_pylist()
    word = np.fromiter((zlib.crc32(w.lower().encode()) % WORD_BUCKETS for w in text), np.int64, len(text))
    joined = "\n".join(text).translate(_SHAPE)
    shapes = _RUNS.sub(r"\1", joined).split("\n") if text else []
    return word, np.fromiter((zlib.crc32(s.encode()) % SHAPE_BUCKETS for s in shapes), np.int64, len(shapes))


def passage_bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each passage's words begin and end, and the first passage of each text; every text has a passage."""
    counts = np.diff(first)
    n = np.maximum(1, -(-counts // PASSAGE_WORDS))
    at = np.concatenate([[0], np.cumsum(n)])
    nth = np.arange(at[-1]) - np.repeat(at[:-1], n)
    begin = np.repeat(first[:-1], n) + nth * PASSAGE_WORDS
    return np.append(begin, first[-1]), at


def repeats(word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each passage, the shares of its words that equal the word before, and that stood in it before."""
    sizes = np.diff(bounds)
    passage = np.repeat(np.arange(len(sizes)), sizes)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])
    again = ~firsts(*dense(passage * WORD_BUCKETS + word))
    return np.column_stack([sums_between(same, bounds), sums_between(again, bounds)]) / np.maximum(1, sizes)[:, None]


@dataclass
class Parameters:
    words: np.ndarray
    shapes: np.ndarray
    repeat: np.ndarray
    bias: np.ndarray
    value: np.ndarray  # V of the attention
    gate: np.ndarray  # U of the attention
    attend: np.ndarray
    out: np.ndarray
    last: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator, prior: float) -> Parameters:
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(
            draw(WORD_BUCKETS, WIDTH, scale=0.1),
            draw(SHAPE_BUCKETS, WIDTH, scale=0.5),
            draw(2, WIDTH, scale=0.5),
            np.zeros(WIDTH, np.float32),
            draw(HIDDEN, WIDTH, scale=WIDTH**-0.5),
            draw(HIDDEN, WIDTH, scale=WIDTH**-0.5),
            draw(HIDDEN, scale=HIDDEN**-0.5),
            draw(WIDTH, scale=WIDTH**-0.5),
            np.array([np.log(prior / (1 - prior))], np.float32),
        )

    def names(self) -> list[str]:
        return list(self.__dataclass_fields__)


def _softmax(scores: np.ndarray, bag: np.ndarray, n_bags: int) -> np.ndarray:
    """Weights within each bag."""
    top = np.full(n_bags, -np.inf)
    np.maximum.at(top, bag, scores)
    e = np.exp(scores - top[bag])
    return e / np.bincount(bag, e, minlength=n_bags)[bag]


def represent(p: Parameters, mean: np.ndarray, bag: np.ndarray, n_bags: int) -> dict[str, np.ndarray]:
    """All values from encoded passages to document scores."""
    h = np.tanh(mean + p.bias)
    t, g = np.tanh(h @ p.value.T), 1 / (1 + np.exp(-(h @ p.gate.T)))
    weight = _softmax((t * g) @ p.attend, bag, n_bags)
    z = np.column_stack([np.bincount(bag, weight * h[:, i], minlength=n_bags) for i in range(h.shape[1])])
    score = 1 / (1 + np.exp(-(z @ p.out + p.last[0])))
    return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "score": score}


def _means(p: Parameters, word: np.ndarray, shape: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = np.maximum(1, np.diff(bounds))[:, None]
    return sums_between(p.words[word] + p.shapes[shape], bounds) / n + repeats(word, bounds) @ p.repeat


def gradients(p: Parameters, word: np.ndarray, shape: np.ndarray, bounds: np.ndarray, bag: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of the bags."""
    v = represent(p, _means(p, word, shape, bounds), bag, len(labels))
    d = (v["score"] - labels) / len(labels)
    dz = d[:, None] * p.out
    da = (dz[bag] * v["h"]).sum(axis=1)
    ds = v["weight"] * (da - np.bincount(bag, v["weight"] * da, minlength=len(labels))[bag])
    dt = ds[:, None] * p.attend * v["g"] * (1 - v["t"] ** 2)
    dg = ds[:, None] * p.attend * v["t"] * v["g"] * (1 - v["g"])
    dh = v["weight"][:, None] * dz[bag] + dt @ p.value + dg @ p.gate
    dq = dh * (1 - v["h"] ** 2)
    sizes = np.diff(bounds)
    by_word = np.repeat(dq / np.maximum(1, sizes)[:, None], sizes, axis=0)
    columns = lambda ids, n: np.column_stack([np.bincount(ids, by_word[:, i], minlength=n) for i in range(WIDTH)])
    return {
        "words": columns(word, WORD_BUCKETS),
        "shapes": columns(shape, SHAPE_BUCKETS),
        "repeat": repeats(word, bounds).T @ dq,
        "bias": dq.sum(axis=0),
        "value": dt.T @ v["h"],
        "gate": dg.T @ v["h"],
        "attend": (ds[:, None] * v["t"] * v["g"]).sum(axis=0),
        "out": v["z"].T @ d,
        "last": np.array([d.sum()]),
    }


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 8, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Parameters | None:
    """Parameters from bags of (word buckets, shape buckets); None unless both labels occur."""
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    p = Parameters.fresh(rng, float(labels.mean()))
    first = {n: np.zeros_like(getattr(p, n), dtype=np.float64) for n in p.names()}
    second = {n: np.zeros_like(x) for n, x in first.items()}
    step = 0
    steps = max(200, rounds * -(-len(bags) // batch))
    while step < steps:
        order = rng.permutation(len(bags))
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            sizes = np.array([len(bags[i][0]) for i in chosen])
            bounds, at = passage_bounds(np.concatenate([[0], np.cumsum(sizes)]))
            word, shape = (np.concatenate([bags[i][k] for i in chosen]).astype(np.int64) for k in (0, 1))
            grads = gradients(p, word, shape, bounds, np.repeat(np.arange(len(chosen)), np.diff(at)), labels[chosen])
            step += 1
            pace = rate * (1 - step / (steps + batch))
            for n, g in grads.items():
                x = getattr(p, n)
                g = g + decay * x
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                x -= (pace * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(x.dtype)
            if step >= steps:
                break
    return p


@dataclass
class Model:
    parameters: Parameters | None
    prior: float

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score, number of the passage with the largest weight) of every text."""
        n = len(texts)
        if self.parameters is None:
            return np.full(n, self.prior), np.zeros(n, np.int64)
        p = self.parameters
        words = Words.of(Bytes.of(texts))
        word, shape = buckets(words)
        vectors = (p.words[word] + p.shapes[shape]).astype(np.float32)
        bounds, at = passage_bounds(words.first)
        mean = sums_between(vectors[words.ids], bounds) / np.maximum(1, np.diff(bounds))[:, None]
        mean = mean + repeats(word[words.ids], bounds) @ p.repeat
        bag = np.repeat(np.arange(n), np.diff(at))
        v = represent(p, mean, bag, n)
        order = np.lexsort((-np.arange(len(bag)), v["weight"], bag))  # the last of each bag has its largest weight
        return v["score"], order[at[1:] - 1] - at[:-1]


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = 6_000) -> Model:
    """A model from at most ``sample_rows`` labelled documents whose ids pass ``learn``. Only hashed words reach the driver."""
    sample = labelled_texts(docs, labelled_ids(labels, "quality", sample_rows, learn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words.of(Bytes.of(part.column("text")))
            out = []
            for found in buckets(words):
                flat = found.astype("<u2")[words.ids]
                out.append(pa.array([flat[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *out], ["doc_id", "label", "word", "shape"])

    found = one_of_each(sample.mapInArrow(run, "doc_id long, label int, word binary, shape binary")).orderBy("doc_id").toPandas()
    if not len(found):
        return Model(None, 0.5)
    bags = [(np.frombuffer(w, "<u2"), np.frombuffer(s, "<u2")) for w, s in zip(found["word"], found["shape"])]
    y = found["label"].to_numpy().astype(np.float64)
    return Model(fit(bags, y), float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, top_passage) for every row."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        value, top = model.scores(part.column("text"))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value.astype(np.float64)), pa.array(top)], ["doc_id", "score", "top_passage"])

    return per_slice(docs, work, "doc_id long, score double, top_passage long")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with at least that score, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            value, _ = model.scores(pc.cast(part.column("text"), pa.string()))
            yield part.filter(pa.array(value >= least))

    return docs.mapInArrow(run, docs.schema)
