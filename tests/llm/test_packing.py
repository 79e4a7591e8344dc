import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from samples import LONG, ODD, docs
from tokenizers import Tokenizer

from leafsift.llm import packing, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def check_places(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_and_places(spark, capacity):
    table = packing.token_pieces(docs(spark, ODD), PATH, capacity)
    rows = [r.asDict() for r in packing.place(table, capacity, cell_rows=40).collect()]
    assert len(rows) == table.count()
    check_places(rows, capacity)
    for doc_id, text in ODD:
        ids = ids_of(text)
        mine = sorted((r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows if r["doc_id"] == doc_id)
        want = [(p, p * capacity, ids[p * capacity : (p + 1) * capacity]) for p in range(-(-len(ids) // capacity))]
        copies = sum(d == doc_id for d, _ in ODD)
        assert mine == sorted((p, s, len(x), np.array(x, "<u4").tobytes()) for p, s, x in want for _ in range(copies))


def test_sequences_hold_the_tokens(spark):
    placed = packing.place(packing.token_pieces(docs(spark, ODD), PATH, 256), 256, cell_rows=20)
    total = 0
    for r in packing.sequences(placed).collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) <= 256
        total += len(ids)
    assert total == sum(len(ids_of(t)) for _, t in ODD)


def test_packs_near_the_lower_bound_over_many_cells(spark):
    rng = np.random.default_rng(5)
    lengths = [int(x) for x in np.clip(rng.lognormal(6, 1, 3000), 1, 4096)]
    frame = spark.createDataFrame([(i, n, "kept") for i, n in enumerate(lengths)], "doc_id long, length long, row string").repartition(3)
    rows = packing.place(frame, 4096, cell_rows=400).collect()
    assert {r["row"] for r in rows} == {"kept"} and len(rows) == 3000
    used = len(check_places([r.asDict() for r in rows], 4096))
    assert used <= -(-sum(lengths) // 4096) * 1.01 + 1


def test_pieces_that_cannot_share(spark):
    frame = spark.range(500).select("id", F.lit(3000).cast("long").alias("length"))
    assert packing.place(frame, 4096, cell_rows=100).select("sequence_id").distinct().count() == 500


def test_empty_table(spark):
    assert packing.place(packing.token_pieces(docs(spark, []), PATH), 4096).count() == 0


def test_crossover_keeps_every_piece_once_and_injects_bins():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 200)
    one, other = (packing.beginning(lengths, 100, rng, first) for first in (True, False))
    for _ in range(30):
        child = packing.cross(one, other, lengths, 100, rng)
        assert len(child.bins) == 200 and child.fills.max() <= 100 and child.fills.sum() == lengths.sum()
        assert (np.bincount(child.bins, lengths) == child.fills).all()
        bins_of = lambda p: {frozenset(np.flatnonzero(p.bins == b).tolist()) for b in range(len(p.fills))}
        assert bins_of(child) & bins_of(other)


def test_evolution_improves_on_best_fit():
    lengths = np.array([6, 6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 3, 3, 3] * 4)
    rng = np.random.default_rng(0)
    first = packing.beginning(lengths, 15, rng, True)
    best = packing.evolve(lengths, 15, [first.bins], rng, generations=60, population=6)[0]
    assert len(best.fills) <= len(first.fills) and best.fills.max() <= 15


def test_word_ids_equal_the_library():
    slow = Tokenizer.from_file(PATH)
    words = [w for w in slow.get_vocab() if w.isascii()][:5000]
    words = [w.replace("</w>", "") + x for w, x in zip(words, ["", "s", "'ll", "é", "12", "!?"] * 1000)] + ["İx", "ªº", "µ", LONG.split()[0]]
    import pyarrow as pa

    ids, counts = word_bpe.load(PATH).encode(pa.array(words))
    ends = np.cumsum(counts)
    for word, a, b in zip(words, ends - counts, ends):
        assert ids[a:b].tolist() == slow.encode(word, add_special_tokens=False).ids, word


def test_query(spark):
    from leafsift.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in QUERIES["op1_best_fit_packing"](spark, sf).collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used = check_places(rows, 4096)
    want = {}
    for doc_id, text in texts.items():
        ids = ids_of(text)
        for p in range(-(-len(ids) // 4096)):
            x = ids[p * 4096 : (p + 1) * 4096]
            want[doc_id, p] = (p * 4096, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(used) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_lengths_that_allow_no_good_fill_share_what_cells_have_left(spark):
    pieces = spark.range(150).select("id", F.lit(1400).alias("length"))  # two to a sequence
    rows = packing.place(pieces, 4096, cell_rows=15).collect()
    assert len(rows) == 150 and len(check_places(rows, 4096)) == 75
