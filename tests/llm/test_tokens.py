import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from samples import ODD, by_id, docs
from tokenizers import Tokenizer

from leafsift.llm import pieces, token_counts
from leafsift.llm.batches import Bytes
from leafsift.llm.queries import QUERIES

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = (
    "' s t re ve ll d m r v l e the ing in 1 22 ² ٣ ! ? == aa a B é 中 文 😀 ́ <|endoftext|> <s> <0x41> 's 'll 're Ａ 梦 ▁ word Words"
).split() + [" ", "  ", "   ", "\n", "\t", " ", "　", "\x1c", "\x85", "\x00"]


@pytest.fixture(scope="module")
def texts():
    random.seed(11)
    made = ["".join(random.choice(PARTS) for _ in range(random.randint(0, 25))) for _ in range(4000)]
    return made + [t for _, t in ODD] + ["a" * 5000, " " * 700 + "x", "ab" * 2000]


# ---------------------------------------------------------------- counts


def test_counts_equal_the_library(texts):
    library = Tokenizer.from_file(BPE)
    found = token_counts.token_numbers(pa.array(texts), token_counts.load(BPE))
    assert found.tolist() == [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_forgetting_states_changes_nothing(texts, monkeypatch):
    counter = token_counts.Counter(BPE)
    want = token_counts.token_numbers(pa.array(texts[:300]), counter)
    monkeypatch.setattr(token_counts, "MOST_STATES", 0)
    assert (token_counts.token_numbers(pa.array(texts[:300]), counter) == want).all()


def test_prefix_scan_of_maps_equals_running_in_order():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 12, (37, 12)).astype(np.uint8)
    scanned = token_counts.compose(maps * 12)
    at = np.arange(12)
    for i in range(37):
        at = maps[i][at]
        assert (scanned[i] == at).all()


def test_chunks_do_not_matter(texts, monkeypatch):
    raw = Bytes.of(pa.array([t or "" for t in texts[:500]]))
    whole, first = token_counts.pieces_of(raw)
    monkeypatch.setattr(token_counts, "CHUNK", 3)
    again, first_again = token_counts.pieces_of(raw)
    assert whole.equals(again) and (first == first_again).all()


def test_count_rows(spark):
    rows = by_id(token_counts.count_tokens(docs(spark, ODD), BPE, limit=20))
    library = Tokenizer.from_file(BPE)
    for i, text in ODD:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert {(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows[i]} == {(len((text or "").encode()), n, n > 20)}
    assert len(rows[9]) == 2 and token_counts.count_tokens(docs(spark, []), BPE).count() == 0


def test_count_query(spark):
    sf, library = "/root/testdata/sf0.01", Tokenizer.from_file(BPE)
    rows = by_id(QUERIES["op9_token_counts"](spark, sf))
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(library.encode(r["text"], add_special_tokens=False).ids)
        assert rows[r["doc_id"]] == [{"doc_id": r["doc_id"], "n_bytes": len(r["text"].encode()), "n_tokens": n, "over_limit": n > 512}]


# ---------------------------------------------------------------- pieces


def test_pieces_equal_the_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    model = pieces.load(PIECE)
    ids, counts = model.encode(pa.array(texts))
    ends = np.cumsum(counts)
    decoded = model.decode(ids, counts).to_pylist()
    for text, a, b, back in zip(texts, ends - counts, ends, decoded):
        assert ids[a:b].tolist() == library.encode(text or ""), text
        assert back == (text or "").replace("▁", " ")


def test_suffix_array_orders_as_far_as_needed():
    rng = np.random.default_rng(0)
    text = rng.choice(np.array([97, 98, 255], np.uint8), 3000, p=[0.6, 0.3, 0.1])
    order = pieces.suffix_array(text, 25)
    body = text.tobytes() + b"\xff" * 40
    keys = [(body[i : i + 25].split(b"\xff")[0] + b"\xff")[:25] for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(3000)) and all(a <= b for a, b in zip(keys, keys[1:]))


def test_occurrence_ranges_by_brute_force():
    model = pieces.load(PIECE)
    text = np.frombuffer(" the thing in the inner".encode() + b"\xff", np.uint8)
    begin, end, piece = model.edges(text)
    found = {(int(a), int(b)) for a, b, p in zip(begin, end, piece) if p >= 0}
    body = text.tobytes()
    assert found == {(a, b) for a in range(len(body)) for b in range(a + 1, len(body)) if body[a:b] in model.ids}


def test_decoding_odd_ids(spark):
    model = pieces.load(PIECE)
    broken = np.array([3 + 0xC3, 261], np.uint32)  # a lone first byte, then a piece
    assert model.decode(broken, np.array([2])).to_pylist() == ["� t"]
    with pytest.raises(ValueError):
        model.decode(np.array([32_000]), np.array([1]))
    frame = spark.createDataFrame([(1, None), (2, b"")], "doc_id long, ids binary")
    assert {r["text"] for r in pieces.decode(frame, PIECE).collect()} == {""}


def test_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    encoded = pieces.encode(docs(spark, ODD), PIECE)
    rows = by_id(pieces.decode(encoded, PIECE))
    both = by_id(pieces.round_trip(docs(spark, ODD), PIECE))
    for i, text in ODD:
        for r, s in zip(rows[i], both[i]):
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode(text or "")
            assert r["text"] == s["text"] == (text or "").replace("▁", " ") and r["ids"] == s["ids"]
    assert pieces.encode(docs(spark, []), PIECE).count() == 0 and pieces.round_trip(docs(spark, []), PIECE).count() == 0


def test_piece_query(spark):
    sf, library = "/root/testdata/sf0.001", sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = by_id(QUERIES["op10_sentencepiece"](spark, sf))
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(library.encode(r["text"]), "<u4")
        want = {"n_pieces": len(ids), "ids_crc32": zlib.crc32(ids.tobytes()), "text_crc32": zlib.crc32(r["text"].encode())}
        assert rows[r["doc_id"]] == [{"doc_id": r["doc_id"]} | want]
