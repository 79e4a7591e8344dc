"""Token counts by deterministic finite-state transducers.

Two machines are run over the text. The first cuts a text at the places where the byte-level
tokenizer does. It has twelve states; every chunk of characters is turned into a map from
the state it begins in to the state it ends in, the maps are composed by a parallel
prefix scan, and with every chunk's first state known all chunks are run at once.

The second counts the tokens of a piece. Byte-pair encoding has the property that the last token of
each prefix is unique: it is the one that may follow the last token where it starts. So after any
prefix only those earlier places matter at which a longer token may still begin, with the last token
and the count there. These make up a state. A transition reads one byte and emits the change
of the count. States and transitions are compiled when they are first met, into hashed arrays that
all distinct pieces of a batch go through in step.

Defined results: null is the empty text and has no tokens; special strings inside a text are one token each, as
the library has it; repeated rows each give their own row; other columns are not read.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from leafsift.llm.batches import Bytes, HashTable, lengths_of, pack, per_slice, sums_between
from leafsift.llm.word_bpe import _byte_of

#: Characters in one chunk of the first machine.
CHUNK = 256
#: States of the second machine kept in a worker; beyond it, it is compiled anew.
MOST_STATES = 200_000

# ---------------------------------------------------------------- cutting texts into pieces

BEGIN, LETTERS, NUMBERS, MARKS, APOSTROPHE, AP_R, AP_V, AP_L, SPACE, BLANK, MORE_SPACE, MORE_BLANK = range(12)
# classes of characters: other letters, those that end a contraction alone, r, v, l, e, numbers, marks, ', blank, other white space, end of text
LETTER, ALONE, R, V, L, E, NUMBER, MARK, QUOTE, BLANK_CHAR, WHITE, END = range(12)
HERE, BEFORE = 1, 2  # a piece begins at this character; at the one before


def _fresh(kind: int) -> int:
    """The state after a first character of a piece."""
    if kind <= E:
        return LETTERS
    return {NUMBER: NUMBERS, MARK: MARKS, QUOTE: APOSTROPHE, BLANK_CHAR: SPACE, WHITE: BLANK, END: BEGIN}[kind]


def _step(state: int, kind: int) -> tuple[int, int]:
    """The next state, and where pieces begin."""
    letter, mark, white = kind <= E, kind in (MARK, QUOTE), kind in (BLANK_CHAR, WHITE)
    if state in (AP_R, AP_V, AP_L):
        if kind == (L if state == AP_L else E):
            return BEGIN, 0
        after, cut = _step(LETTERS, kind)
        return after, cut | BEFORE
    if state == APOSTROPHE:
        if kind == ALONE:
            return BEGIN, 0
        if kind in (R, V, L):
            return {R: AP_R, V: AP_V, L: AP_L}[kind], 0
        state = MARKS
    if state in (LETTERS, NUMBERS, MARKS):
        if (letter, kind == NUMBER, mark)[state - LETTERS]:
            return state, 0
    elif state in (SPACE, BLANK, MORE_SPACE, MORE_BLANK):
        if white:
            return (MORE_SPACE if kind == BLANK_CHAR else MORE_BLANK), 0
        if kind != END:
            cut = BEFORE if state in (MORE_SPACE, MORE_BLANK) else 0
            if state in (SPACE, MORE_SPACE):  # the blank belongs to what follows
                return (MARKS if mark else _fresh(kind)), cut
            return _fresh(kind), cut | HERE
    return _fresh(kind), HERE


#: Next state times twelve, and the cuts, by twelve times the state plus the class.
NEXT = np.array([_step(s, k)[0] * 12 for s in range(12) for k in range(12)], np.uint8)
CUTS = np.array([_step(s, k)[1] for s in range(12) for k in range(12)], np.uint8)


@cache
def classes() -> np.ndarray:
    """The class of every code point, as the tokenizer library's own expressions see it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    out = np.full(0x110000, MARK, np.uint8)
    for expression, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        split = Split(Regex(expression), "removed")
        for block in np.array_split(points, 64):  # the library needs much memory for each character
            inside = np.ones(len(block), bool)
            for _, (a, b) in split.pre_tokenize_str(block.astype("<u4").tobytes().decode("utf-32-le")):
                inside[a:b] = False
            out[block[inside]] = kind
    for chars, kind in (("stmd", ALONE), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE), (" ", BLANK_CHAR)):
        out[[ord(c) for c in chars]] = kind
    return out


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of maps [n, states] (states times twelve) under composition."""
    maps = maps // 12
    reach = 1
    while reach < len(maps):
        maps = np.concatenate([maps[:reach], np.take_along_axis(maps[reach:], maps[:-reach], axis=1)])
        reach *= 2
    return maps


def run_cutter(kinds: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character, for classes with an END after each text."""
    n = len(kinds)
    chunks = -(-n // CHUNK)
    steps = np.full(chunks * CHUNK, END, np.uint8)
    steps[:n] = kinds
    steps = np.ascontiguousarray(steps.reshape(chunks, CHUNK).T)
    state = np.repeat(np.arange(12, dtype=np.uint8)[None, :] * 12, chunks, axis=0)
    for row in steps:
        state = NEXT[state + row[:, None]]
    first = np.zeros(chunks, np.uint8)
    first[1:] = compose(state)[:-1, BEGIN] * 12
    cuts = np.empty((CHUNK, chunks), np.uint8)
    for i, row in enumerate(steps):
        at = first + row
        cuts[i] = CUTS[at]
        first = NEXT[at]
    cuts = cuts.T.ravel()[: n + 1]
    begins = (cuts[:n] & HERE) != 0
    begins[: len(cuts) - 1] |= (cuts[1:] & BEFORE) != 0
    return begins


def pieces_of(raw: Bytes) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, which tile their bytes; and the number of the first piece of each text."""
    points = np.frombuffer(raw.data.tobytes().decode().encode("utf-32-le"), "<u4")
    starts = np.concatenate([np.flatnonzero((raw.data & 0xC0) != 0x80), [len(raw.data)]])
    kinds = classes()[points]
    ends = np.searchsorted(starts, raw.bounds[1:])
    kinds = np.insert(kinds, ends, END)
    begins = run_cutter(kinds)[kinds != END] if len(kinds) else np.zeros(0, bool)
    offsets = np.append(starts[:-1][begins], len(raw.data))
    return pack(raw.data, offsets), np.searchsorted(offsets[:-1], raw.bounds)


# ---------------------------------------------------------------- counting the tokens of pieces


class Counter:
    """The compiled transducer of one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        byte_of = _byte_of()
        special = {t["content"] for t in model["added_tokens"]}
        self.special = sorted(special, key=len, reverse=True)
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        self.token = {as_bytes(t): n for t, n in model["model"]["vocab"].items() if t not in special}
        self.bytes_of = {n: t for t, n in self.token.items()}
        self.merge = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = as_bytes(a), as_bytes(b)
            self.merge[self.token[a], self.token[b]] = (rank, self.token[a + b])
        self.beginnings = {t[:n] for t in self.token for n in range(1, len(t))}
        self.follows: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all compiled states but the first: nothing read, with one place (at 0 bytes back, no last token, count 0)."""
        self.states = [((0, -1, 0),)]
        self.tails = [b""]
        self.number = {(b"", self.states[0]): 0}
        self.edges = HashTable()

    def encode(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first and then leftmost; used to compile, on a token or two."""
        parts = [self.token[piece[i : i + 1]] for i in range(len(piece))]
        while len(parts) > 1:
            found = min(((self.merge.get(p, (1 << 60, 0)), i) for i, p in enumerate(zip(parts, parts[1:]))), key=lambda x: (x[0][0], x[1]))
            (rank, new), i = found
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [new]
        return parts

    def may_follow(self, last: int, token: int) -> bool:
        if last < 0:
            if token not in self.whole:
                self.whole[token] = self.encode(self.bytes_of[token]) == [token]
            return self.whole[token]
        key = (last, token)
        if key not in self.follows:
            self.follows[key] = self.encode(self.bytes_of[last] + self.bytes_of[token]) == [last, token]
        return self.follows[key]

    def compile(self, state: int, byte: int) -> None:
        """The transition of ``state`` on ``byte``. A place is (bytes back, last token there, count there less the count here)."""
        tail, places = self.tails[state] + bytes([byte]), self.states[state]
        for back, last, count in places:  # the longest token first
            token = self.token.get(tail[len(tail) - back - 1 :])
            if token is not None and self.may_follow(last, token):
                emit = count + 1
                break
        else:
            raise ValueError("a byte without a token")
        kept = [(back + 1, last, count - emit) for back, last, count in places if tail[len(tail) - back - 1 :] in self.beginnings]
        kept.append((0, token, 0))
        new = (tail[len(tail) - kept[0][0] :], tuple(kept))
        number = self.number.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new[1])
            self.tails.append(new[0])
        self.edges.add(state * 256 + byte, number, emit)

    def count(self, pieces: pa.Array) -> np.ndarray:
        """Tokens of each of the distinct ``pieces``."""
        if len(self.states) > MOST_STATES:
            self.clear()
        if len(self.follows) > 4 * MOST_STATES:
            self.follows.clear()
        raw = Bytes.of(pieces)
        sizes = np.diff(raw.bounds)
        order = np.argsort(-sizes, kind="stable")  # those still running come first
        starts, sizes = raw.bounds[:-1][order], sizes[order]
        state = np.zeros(len(order), np.int64)
        total = np.zeros(len(order), np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -step, side="left"))  # sizes over step
            key = state[:n] * 256 + raw.data[starts[:n] + step]
            at = self.edges.find(key)
            if (at < 0).any():
                for missing in np.unique(key[at < 0]).tolist():
                    self.compile(*divmod(missing, 256))
                at = self.edges.find(key)
            state[:n] = self.edges.value[at]
            total[:n] += self.edges.extra[at]
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


@cache
def load(path: str) -> Counter:
    """One transducer for each worker process."""
    return Counter(path)


def token_numbers(texts: pa.Array, counter: Counter) -> np.ndarray:
    """Tokens of every text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    owner, extra = np.arange(len(texts)), np.zeros(len(texts), np.int64)
    for special in counter.special:
        if pc.any(pc.match_substring(texts, special)).as_py():
            parts = pc.split_pattern(texts, special)
            counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(extra, owner, counts - 1)
            owner, texts = np.repeat(owner, counts), parts.flatten()
    pieces, first = pieces_of(Bytes.of(texts))
    found = pieces.dictionary_encode()
    each = counter.count(found.dictionary)[found.indices.to_numpy(zero_copy_only=False)]
    return extra + np.bincount(owner, sums_between(each, first), minlength=len(extra)).astype(np.int64)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(part.column("text"), "")
        tokens = token_numbers(texts, load(tokenizer))
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(lengths_of(texts)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        )

    return per_slice(docs, work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
