"""Secret scans: fixed patterns, and novelty under a dictionary-primed compressor.

Three kinds of pattern give the base spans. The method adds spans of kind ``novel``:
token-like strings (16 or more characters) within 40 code points of a sensitive
word, before or after it, that overlap no base span and that zstandard, primed
with an identifier dictionary and the text around the string, cannot shorten:
their marginal compressed bytes per byte reach ``novelty``. A string without a
digit must besides change case as often as random letters do, since a compressor
of short strings cannot tell names from noise.

Spans are code points, end exclusive, sorted by start and then by kind as in KINDS.
Defined results: a null text is empty and has no spans; repeated rows each give
their own row; a null doc_id is kept as it is; other columns are not read by
``find_secrets`` and are passed on unchanged by ``mask_secrets``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.llm.batches import slices, texts_of

KINDS = ("assign", "access", "hex", "novel")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run is the same with the length inside the pattern.
HEX = re.compile(r"[0-9a-f]{32,}")

SENSITIVE_WORDS = ("passw", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "private", "signature")
SENSITIVE = re.compile("|".join(SENSITIVE_WORDS), re.IGNORECASE | re.ASCII)
LEAST_CHARS = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
DIGIT = re.compile(r"[0-9]")
CASE_CHANGE = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")

#: What a text must hold before it is looked at closely (RE2 syntax); texts without it have no span of any kind.
WORTH = "(?i:" + "|".join(SENSITIVE_WORDS + ("passwd", "api_?key")) + ")|AKIA|[0-9a-f]{32}"

#: Names that code is full of; strings made of them are no news to the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret "
    "auth_token access_token refresh_token bearer authorization signature credentials username user_name session_id "
    "config settings default example placeholder changeme your_token_here string value number object function return "
    "import export const static class public private protected void null undefined true false self this "
    "https://www.example.com/index.html http://localhost:8080/api/v1/users github.com/ application/json text/html utf-8 "
    "0123456789abcdefghijklmnopqrstuvwxyz 0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000000000000000 xxxxxxxxxxxxxxxxxxxx"
)

SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Marginal compressed size of a string next to its surroundings."""

    def __init__(self, reach: int = 40, around: int = 400, least: float = 0.55):
        self.reach, self.around, self.least = reach, around, least
        words = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=6, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)

    def marginal(self, text: str, start: int, end: int) -> float:
        """Compressed bytes that text[start:end] adds to its surroundings, per byte of it."""
        around = (text[max(0, start - self.around) : start] + text[end : end + self.around]).encode("utf-8", "surrogatepass")
        own = text[start:end].encode()
        return (len(self.compressor.compress(around + own)) - len(self.compressor.compress(around))) / len(own)

    def needed(self, string: str) -> float:
        """The share that must stay: words are news to any compressor of short strings, so one without a digit must also change case as often as chance does."""
        if DIGIT.search(string) or len(CASE_CHANGE.findall(string)) >= 0.4 * (len(string) - 1):
            return self.least
        return float("inf")

    def spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        tokens = [m.span() for m in CANDIDATE.finditer(text)]
        ends = [end for _, end in tokens]
        near: set[tuple[int, int]] = set()
        for word in SENSITIVE.finditer(text):
            near.update(tokens[bisect_left(ends, word.start() - self.reach) : bisect_right(ends, word.start())])
            at, limit = word.end(), word.end() + self.reach
            while m := CANDIDATE.search(text, at, limit + LEAST_CHARS):
                m = CANDIDATE.match(text, m.start())
                near.add(m.span())
                at = m.end()
        found = []
        for start, end in sorted(near):
            if any(s < end and start < e for s, _, e in taken):
                continue
            if self.marginal(text, start, end) >= self.needed(text[start:end]):
                found.append((start, 3, end))
        return _apart(found)


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates found from words inside a token overlap it; the first stays."""
    out: list[tuple[int, int, int]] = []
    for span in spans:
        if not out or span[0] >= out[-1][2]:
            out.append(span)
    return out


def spans_of(texts: pa.Array, novelty: Novelty) -> list[list[tuple[int, int, int]]]:
    """All spans of each text of a batch."""
    texts = pc.fill_null(texts, "")
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for i in pc.indices_nonzero(pc.match_substring_regex(texts, WORTH)).to_pylist():
        text = texts[i].as_py()
        base = base_spans(text)
        out[i] = sorted(base + novelty.spans(text, base))
    return out


def find_secrets(docs: DataFrame, novelty: float = 0.55) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Novelty(least=novelty)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for part in slices(batches):
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in spans_of(part.column("text"), judge)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return texts_of(docs).mapInArrow(run, f"doc_id long, spans {SPANS}")


def mask_secrets(docs: DataFrame, novelty: float = 0.55, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; ``n_chars``, where there is one, follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Novelty(least=novelty)
        for part in slices(batches):
            texts = part.column("text")
            changed = {i: _masked(texts[i].as_py(), spans, mark) for i, spans in enumerate(spans_of(texts, judge)) if spans}
            if changed:
                new = pa.array([changed.get(i, old) for i, old in enumerate(texts.to_pylist())], texts.type)
                part = part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), new)
                if (at := part.schema.get_field_index("n_chars")) >= 0:
                    counts = [len(changed[i]) if i in changed else n for i, n in enumerate(part.column("n_chars").to_pylist())]
                    part = part.set_column(at, part.schema.field("n_chars"), pa.array(counts, part.schema.field("n_chars").type))
            yield part

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
