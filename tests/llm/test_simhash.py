import itertools
import re

import numpy as np
import pytest
import xxhash
from samples import ODD, by_id, docs

from leafsift.llm import simhash
from leafsift.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=3):
    """Smallest id reachable, by brute force; prints are (id, fingerprint)."""
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
            label[max(find(a), find(b))] = min(find(a), find(b))
    smallest = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            smallest[find(i)] = min(doc_id, smallest.get(find(i), doc_id))
    return [smallest.get(find(i)) for i in range(len(prints))]


def test_fingerprints_of_odd_texts(spark):
    rows = by_id(simhash.fingerprints(docs(spark, ODD)))
    for doc_id, text in ODD:
        for row in rows[doc_id]:
            assert row["fp"] % (1 << 64) == fingerprint(text)
    assert rows[5][0]["fp"] == rows[6][0]["fp"] and rows[1][0]["fp"] == 0


def test_golay_code_is_perfect_and_keys_cover_one_error():
    golay = simhash.Golay()
    assert set(golay.counts.tolist()) == {1, 6}
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 4000)
    keys, counts = golay.keys(words)
    for bit in range(23):
        other, _ = golay.keys(words ^ (1 << bit))
        for i in range(0, 4000, 7):
            assert other[i, 0] in keys[i, : counts[i]]


def test_every_pair_within_three_bits_shares_a_bucket():
    rng = np.random.default_rng(1)
    golay = simhash.Golay()
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= 1 << int(bit)
        fps = np.array([a, b], np.uint64).view(np.int64)
        places, codes = simhash.bucket_codes(fps, golay)
        primary = set((codes[(places == 0) & (codes & 1 == 0)] >> 1).tolist())
        assert primary & set((codes[places == 1] >> 1).tolist())


@pytest.mark.parametrize("limit", [simhash.BUCKET_ROWS, 3])
def test_components_equal_brute_force(spark, limit):
    """Chains, stars and dense groups; with a small limit the buckets are cut into parts."""
    rng = np.random.default_rng(limit)
    prints, doc_id = [], 0
    for base in rng.integers(0, 1 << 63, 12).tolist():
        at = base
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            new = (at if rng.random() < 0.5 else base) ^ sum(1 << int(f) for f in flips)
            prints.append((int(rng.integers(0, 10_000)) if doc_id % 40 else None, new))
            at, doc_id = new, doc_id + 1
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in prints]
    frame = spark.createDataFrame(signed, "doc_id long, fp long").repartition(3)
    found = sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in simhash.classes(frame, 3, limit).collect())
    want = sorted((str(i), f, str(g)) for (i, f), g in zip(signed, groups(prints)))
    assert found == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = [(i, fingerprint(t)) for i, t in sorted(texts.items())]
    want = {i: ("%016x" % f, g) for (i, f), g in zip(prints, groups(prints))}
    rows = QUERIES["op4_simhash"](spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want


def test_odd_rows_and_one_of_each_group(spark):
    rows = by_id(simhash.near_duplicates(docs(spark, ODD)))
    assert {r["component_id"] for i in (1, 2, 3) for r in rows[i]} == {1}
    assert rows[6][0]["component_id"] == 5 and len(rows[9]) == 2 and rows[None][0]["component_id"] is None
    kept = simhash.keep_one(docs(spark, ODD))
    assert kept.columns == docs(spark, ODD).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 7, 8, 9, 11, 12, None]))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.keep_one(docs(spark, [])).count() == 0


def test_one_row_of_each_group_with_repeated_and_missing_ids(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcde"]
    # one id with two unlinked texts, copies without an id beside one with, copies that are all without
    rows = [(7, words[0]), (7, words[1]), (8, words[0]), (None, words[2]), (3, words[2]), (None, words[3]), (None, words[3]), (None, words[4])]
    kept = simhash.keep_one(docs(spark, rows)).collect()
    assert sorted((r["text"], r["doc_id"]) for r in kept) == [(words[0], 7), (words[1], 7), (words[2], 3), (words[3], None), (words[4], None)]


def test_copies_of_one_text_by_the_thousand(spark):
    frame = docs(spark, [(i, "the same text every time it is seen") for i in range(100, 3000)] + [(5, "something else entirely is here")], 4)
    assert {(r["component_id"], r["count"]) for r in simhash.near_duplicates(frame).groupBy("component_id").count().collect()} == {(100, 2900), (5, 1)}


def test_radius_beyond_the_keys(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=4)
