"""Token ids of white-space separated words under a lower-casing word BPE, each distinct word encoded once.

The tokenizer drops white space, so the ids of a text are those of its words one after another. Words of plain Latin-1
letters, digits and marks go through tiktoken, all others through the tokenizer itself.
Its merges are given to tiktoken as ranks, a word's end being one more byte; merges and ranks agree on which pair comes first.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = "\x01"
#: Words with any other character, or that might hold a special token, are left to the tokenizer (RE2 syntax).
UNUSUAL = r"[^!-~À-ÖØ-öø-ÿ]|<\|"
PIECES = re.compile(r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+)")


@cache
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        suffix, special = model["model"]["end_of_word_suffix"], {t["content"] for t in model["added_tokens"]}
        byte_of, ranks = _byte_of(), {}
        for token, number in model["model"]["vocab"].items():
            if token not in special:
                body, end = (token[: -len(suffix)], END.encode()) if token.endswith(suffix) else (token, b"")
                ranks[bytes(byte_of[c] for c in body) + end] = number
        self.fast = tiktoken.Encoding("words", pat_str="[^\x01\n]+\x01|\n", mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n"]

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has)."""
        words = words.cast(pa.large_string())
        unusual = pc.match_substring_regex(words, UNUSUAL)
        plain = words.filter(pc.invert(unusual))
        ids, counts = self._plain(plain)
        if len(plain) == len(words):
            return ids, counts
        rest = self.slow.encode_batch_fast(words.filter(unusual).to_pylist(), add_special_tokens=False)
        rest = [e.ids for e in rest]
        all_counts = np.empty(len(words), np.int64)
        odd = unusual.to_numpy(zero_copy_only=False)
        all_counts[~odd] = counts
        all_counts[odd] = [len(x) for x in rest]
        out = np.empty(int(all_counts.sum()), np.uint32)
        at_odd = np.repeat(odd, all_counts)
        out[~at_odd] = ids
        out[at_odd] = np.fromiter((i for x in rest for i in x), np.uint32)
        return out, all_counts

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        text = PIECES.sub(r"\1" + END, "\n".join(words.to_pylist()).lower())
        ids = np.asarray(self.fast.encode_to_numpy(text), dtype=np.uint32)
        breaks = ids == self.line
        counts = np.diff(np.concatenate([[-1], np.flatnonzero(breaks), [len(ids)]])) - 1
        return ids[~breaks], counts


@cache
def load(path: str) -> WordBpe:
    """One encoder for each worker process."""
    return WordBpe(path)
