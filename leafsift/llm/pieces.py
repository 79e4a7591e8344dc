"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut where no piece can reach across (before a run of blanks), and the distinct
words are joined into one text, a separator after each. Its suffix array is sorted as far as the
longest piece, and two binary searches for every piece of the model at once give the range of
its occurrences. Each occurrence is an edge from where it begins to where it ends. The edges are
sorted by position and relaxed: an edge is taken if its piece may follow the last piece on
the best way to its beginning. For a BPE model exactly one piece is so reached at
every end, because a sequence of pieces is an encoding if and only if each neighbouring
pair is one. Characters without a piece become edges of single bytes.

Defined results: null is the empty text and has no pieces; the model's blank character in a text is read as
a blank, as the library does; repeated rows each give their own row; other columns are not read. Decoding ids
that the model does not have raises an error; a null list decodes to the empty text.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.llm.batches import Bytes, HashTable, dense, lengths_of, pack, per_slice, ragged, slices, sums_between

BLANK = "▁"
#: Ends a word in the joined text; never a byte of UTF-8.
SEPARATOR = 0xFF
#: Tested pairs kept in a worker.
MOST_PAIRS = 1_000_000
#: Bytes of text matched at once; its edges take about a hundred times that.
MATCH_BYTES = 3 << 19


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` ordered by the bytes from there, as far as ``depth`` or the next separator.

    Sorted by seven bytes first; then places that are still equal, by five more at a time.
    """

    def key(places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        out, alive = np.zeros(len(places), np.int64), np.ones(len(places), bool)
        for i in range(width):
            byte = padded[places + i]
            out = out << 8 | np.where(alive, byte, 0)
            alive &= byte != SEPARATOR
        return out, alive

    n = len(text)
    padded = np.concatenate([text, np.full(depth + 8, SEPARATOR, np.uint8)])
    keys, alive = key(np.arange(n), 7)
    order = np.argsort(keys)
    keys, alive = keys[order], alive[order]
    slots, reach = np.arange(n), 7  # places in the order that are looked at
    while reach < depth and len(slots):
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        alone = fresh & np.concatenate([fresh[1:], [True]])
        open_ = np.flatnonzero(alive & ~alone)
        slots, group = slots[open_], np.cumsum(fresh)[open_]
        places = order[slots]
        more, alive = key(places + reach, 5)
        keys = dense(group)[0] << 40 | more if len(slots) < 1 << 22 else None
        if keys is None:  # too many groups for one number
            by = np.lexsort((more, group))
            keys = np.cumsum(np.concatenate([[True], (np.diff(group[by]) != 0) | (np.diff(more[by]) != 0)]))
        else:
            by = np.argsort(keys)
            keys = keys[by]
        order[slots] = places[by]
        alive, reach = alive[by], reach + 5
    return order


class Model:
    """A BPE model's pieces, with the blank as one byte."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        plain = [i for i in range(n) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        text = {i: library.id_to_piece(i) for i in plain}
        if any(BLANK in t.lstrip(BLANK) for t in text.values()):
            raise ValueError("words cannot be cut apart: a piece has a blank inside")
        self.ids = {text[i].replace(BLANK, " ").encode(): i for i in plain}
        self.score = {i: library.get_score(i) for i in plain}
        if missing := {c for t in text.values() for c in t.replace(BLANK, " ")} - {t.replace(BLANK, " ") for t in text.values()}:
            raise ValueError(f"characters of pieces that are no pieces: {sorted(missing)[:5]}")
        if library.normalize("Å Å  x") != f"{BLANK}Å{BLANK}Å{BLANK}{BLANK}x":
            raise ValueError("only models that normalise nothing are supported")
        self.byte_ids = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        order = sorted(self.ids.items())
        self.pieces = np.array([i for _, i in order], np.int64)
        self.sizes = np.array([len(b) for b, _ in order], np.int64)
        self.body = np.frombuffer(b"".join(b for b, _ in order), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.one_char = np.zeros(n, bool)
        self.one_char[[i for b, i in order if len(b.decode()) == 1]] = True
        self.bytes_of = {i: b for b, i in order}
        self.text_of = {i: b.decode() for b, i in order}
        self.of_text = {t: i for i, t in self.text_of.items()}
        # what each id decodes to
        out = {i: b for b, i in order} | {int(i): bytes([b]) for b, i in enumerate(self.byte_ids) if i != library.unk_id()}
        out[library.unk_id()] = library.decode([library.unk_id()]).encode()
        bodies = [out.get(i, b"") for i in range(n)]
        self.out_sizes = np.array([len(b) for b in bodies], np.int64)
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes
        self.out_body = np.frombuffer(b"".join(bodies), np.uint8)
        self.size = n
        self.follows = HashTable()

    def merged(self, text: str) -> list[int]:
        """Plain merging, best score first and then leftmost; used on a pair of pieces."""
        parts = list(text)
        while True:
            found = [(-self.score[i], at) for at, (a, b) in enumerate(zip(parts, parts[1:])) if (i := self.of_text.get(a + b)) is not None]
            if not found:
                return [self.of_text[p] for p in parts]
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may come after the last one (-1: after a byte, or nothing)."""
        keys = (last.astype(np.int64) + 1) * self.size + piece
        at = self.follows.find(keys)
        if (at < 0).any():
            for key in np.unique(keys[at < 0]).tolist():
                a, b = divmod(key, self.size)
                want = [b] if a == 0 else [a - 1, b]
                self.follows.add(key, self.merged("".join(self.text_of[i] for i in want)) == want)
            at = self.follows.find(keys)
        return self.follows.value[at] != 0

    # ------------------------------------------------------------ matching

    def ranges(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every piece, the range of the suffix array whose suffixes begin with it."""
        padded = np.concatenate([text, np.zeros(int(self.sizes.max()) + 8, np.uint8)])

        def bound(after: bool) -> np.ndarray:
            low, high = np.zeros(len(self.pieces), np.int64), np.full(len(self.pieces), len(order), np.int64)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    return low
                middle = (low[open_] + high[open_]) // 2
                place = order[middle]
                # compare byte by byte, as long as all bytes before are equal
                right = np.full(len(open_), after)  # equal: go on to the right of it only for the upper bound
                equal = np.arange(len(open_))
                for i in range(int(self.sizes[open_].max())):
                    equal = equal[self.sizes[open_[equal]] > i]
                    if not len(equal):
                        break
                    mine = self.body[self.bounds[open_[equal]] + i]
                    theirs = padded[place[equal] + i]
                    right[equal[theirs < mine]] = True
                    right[equal[theirs > mine]] = False
                    equal = equal[theirs == mine]
                low[open_[right]] = middle[right] + 1
                high[open_[~right]] = middle[~right]

        return bound(False), bound(True)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece) of every occurrence; bytes of characters without a piece have piece -1."""
        order = suffix_array(text, int(self.sizes.max()))
        low, high = self.ranges(text, order)
        counts = high - low
        begin = order[ragged(low, counts)]
        piece = np.repeat(self.pieces, counts)
        end = begin + np.repeat(self.sizes, counts)
        # characters that no piece stands for alone
        lead = np.flatnonzero(((text & 0xC0) != 0x80) & (text != SEPARATOR))
        known = np.zeros(len(text) + 1, bool)
        known[begin[self.one_char[piece]]] = True
        unknown = lead[~known[lead]]
        if len(unknown):
            lengths = 1 + (text[unknown] >= 0xC0).astype(np.int64) + (text[unknown] >= 0xE0) + (text[unknown] >= 0xF0)
            raw = ragged(unknown, lengths)
            begin, end = np.concatenate([begin, raw]), np.concatenate([end, raw + 1])
            piece = np.concatenate([piece, np.full(len(raw), -1)])
        return begin, end, piece

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all distinct words one after another, how many each has)."""
        raw = Bytes.of(words)
        n_words = len(raw)
        sizes = np.diff(raw.bounds)
        starts = raw.bounds[:-1] + np.arange(n_words)
        text = np.full(len(raw.data) + n_words, SEPARATOR, np.uint8)
        text[ragged(starts, sizes)] = raw.data
        begin, end, piece = self.edges(text)
        inside = np.arange(len(text)) - np.repeat(starts, sizes + 1)  # the place in its word
        position = inside[begin] + (end - begin)
        if len(position) and position.max() < 1 << 16:
            position = position.astype(np.uint16)  # sorted by radix
        order = np.argsort(position, kind="stable")
        begin, end, piece, position = (x[order].astype(np.int32) for x in (begin, end, piece, position))
        if self.follows.used > MOST_PAIRS:
            self.follows = HashTable()

        NONE = -2
        last = np.full(len(text) + 1, NONE, np.int32)  # the last piece of the way to each place; -1 a byte or nothing
        source = np.zeros(len(text) + 1, np.int32)
        number = np.zeros(len(text) + 1, np.int32)
        last[starts] = -1
        own = np.zeros(len(text) + 1, np.int32)
        steps = np.flatnonzero(np.concatenate([[True], position[1:] != position[:-1]])) if len(position) else np.zeros(0, np.int64)
        for a, b in zip(steps, [*steps[1:], len(position)]):
            x, y, p = begin[a:b], end[a:b], piece[a:b]
            before = last[x]
            fine = before != NONE
            x, y, p, before = x[fine], y[fine], p[fine], before[fine]
            fine = p < 0
            known = np.flatnonzero(~fine)
            fine[known] = self.may_follow(before[known], p[known])
            x, y, p = x[fine], y[fine], p[fine]
            last[y], source[y], number[y] = p, x, number[x] + 1
            own[y] = np.where(p < 0, self.byte_ids[text[x]], p)
        ends = starts + sizes
        counts = number[ends].astype(np.int64)
        ids = np.empty(int(counts.sum()), np.uint32)
        place, slot = ends.copy(), np.cumsum(counts) - 1
        open_ = np.flatnonzero(counts > 0)
        while len(open_):
            ids[slot[open_]] = own[place[open_]]
            place[open_] = source[place[open_]]
            slot[open_] -= 1
            open_ = open_[place[open_] > starts[open_]]
        return ids, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has)."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), BLANK, " ")
        raw = Bytes.of(texts)
        full = np.flatnonzero(np.diff(raw.bounds) > 0)
        data = np.insert(raw.data, raw.bounds[:-1][full], 32)  # the blank before every text
        shift = np.zeros(len(raw.bounds), np.int64)
        shift[full + 1] = 1
        bounds = raw.bounds + np.cumsum(shift)
        blank = data == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[bounds[:-1][full]] = True
        offsets = np.append(np.flatnonzero(begins), len(data))
        found = pack(data, offsets).dictionary_encode()
        word = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, counts = self.encode_words(found.dictionary)
        starts = np.cumsum(counts) - counts
        each = counts[word]
        return ids[ragged(starts[word], each)], sums_between(each, np.searchsorted(offsets[:-1], bounds))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of every run of ids."""
        ids = ids.astype(np.int64)
        if len(ids) and int(ids.max()) >= self.size:
            raise ValueError("an id beyond the model's")
        sizes = self.out_sizes[ids]
        data = self.out_body[ragged(self.out_starts[ids], sizes)]
        bounds = np.concatenate([[0], np.cumsum(sums_between(sizes, np.concatenate([[0], np.cumsum(counts)])))]).astype(np.int64)
        heads = bounds[:-1][bounds[1:] > bounds[:-1]]
        heads = heads[data[heads] == 32]  # the blank put before the text
        kept = np.ones(len(data), bool)
        kept[heads] = False
        before = np.concatenate([[0], np.cumsum(kept)])
        found = pack(data[kept], before[bounds])
        try:
            return found.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([b.decode("utf-8", "replace") for b in found.to_pylist()], pa.string())


@cache
def load(path: str) -> Model:
    """One model for each worker process."""
    return Model(path)


def _binary(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pack(ids.astype("<u4").view(np.uint8), 4 * np.concatenate([[0], np.cumsum(counts)])).cast(pa.binary())


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) for every row; ids are little-endian unsigned 32-bit numbers."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = load(model).encode(part.column("text"))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), _binary(ids, counts)], ["doc_id", "ids"])

    return per_slice(docs, work, "doc_id long, ids binary", MATCH_BYTES)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text) for every row of (doc_id, ids)."""

    def run(batches):
        for part in slices(batches, column="ids"):
            ids = pc.fill_null(part.column("ids"), b"")
            flat = np.frombuffer(b"".join(ids.to_pylist()), "<u4")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), load(model).decode(flat, lengths_of(ids) // 4)], ["doc_id", "ids", "text"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return rows.mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text) for every row: the text is decoded from the ids. One worker does both."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = load(model).encode(part.column("text"))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), _binary(ids, counts), load(model).decode(ids, counts)], ["doc_id", "ids", "text"])

    return per_slice(docs, work, "doc_id long, ids binary, text string", MATCH_BYTES)
