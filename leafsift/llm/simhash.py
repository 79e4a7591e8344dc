"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is cut into three segments. Two fingerprints at most three bits
apart have either one equal segment and another at most one bit apart, or exactly one differing bit in each
segment. Every 23-bit word lies within three bits of exactly one codeword of the
binary Golay code; the codewords within four bits of it (one, or six) are its keys.
If two segments differ in at most one bit, the nearest codeword of one
is a key of the other. So each fingerprint gets about 60 keys made of an equal
segment and a codeword index, or of two codeword indices; fingerprints that share a key are
verified by their exact distance.

Only distinct fingerprints are compared, so copies cost nothing. A bucket emits the
edges of a spanning star of each of its linked groups, never all its pairs; a bucket
beyond ``BUCKET_ROWS`` is cut into parts, and each pair of parts is compared by itself.

Defined results: null and wordless texts have fingerprint zero and link like any
other. Repeated rows each give their own row. A row without doc_id gets
the smallest doc_id it reaches, null if there is none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.llm.batches import IS_SPACE, Bytes, dense, per_slice, ragged, stored, sums_between

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the [23, 12, 7] code.
GENERATOR = 0b110001110101
LENGTH, CHECK_BITS = 23, 11
#: (lowest bit, width) of the segments; each is padded with zeros to 23 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a bucket compared in one go; larger buckets are cut into parts of this size.
BUCKET_ROWS = 8192
#: Pairs compared at once.
PAIRS = 1 << 20
#: Fingerprints that more than one row in so many carries are joined by broadcast; there are fewer of them than this.
HOT = 1000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fingerprints_of(raw: Bytes, shingle: int) -> np.ndarray:
    """The 64-bit fingerprint of every text."""
    data = LOWER[raw.data]
    solid = ~IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = raw.bounds[:-1]
    edges = edges[edges < len(data)]
    begins[edges] = solid[edges]
    # one blank after each word that has one in its text: words of a text are then a single space apart
    kept = solid.copy()
    kept[1:] |= solid[:-1]
    place = np.cumsum(kept) - 1
    starts = np.flatnonzero(begins)
    ends_mask = solid.copy()
    ends_mask[:-1] &= ~solid[1:]
    last = raw.bounds[1:] - 1
    last = last[last >= 0]
    ends_mask[last] = solid[last]
    ends = place[np.flatnonzero(ends_mask)] + 1
    first = np.searchsorted(starts, raw.bounds)
    starts = place[starts]
    body = np.where(solid, data, 32).astype(np.uint8)[kept].tobytes()

    counts = np.diff(first)
    shingles = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
    head = ragged(first[:-1], shingles)
    tail = head + np.repeat(np.minimum(counts, shingle), shingles) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(body[a:b], 42) for a, b in zip(starts[head].tolist(), ends[tail].tolist())), np.uint64, len(head))
    return majority(hashes, shingles)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits set in over half of them."""
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = sums_between(bits, bounds)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) for every row."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = fingerprints_of(Bytes.of(part.column("text")), shingle)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return per_slice(docs, work, "doc_id long, fp long")


def _remainder(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator: its syndrome."""
    words = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - CHECK_BITS)), words)
    return words


class Golay:
    """Error patterns of at most four bits by syndrome: one of at most three bits first, then five of four bits, or none."""

    def __init__(self) -> None:
        ones = [1 << b for b in range(LENGTH)]
        patterns, layer = [np.zeros(1, np.int64)], {0}
        for _ in range(4):
            layer = {p | o for p in layer for o in ones if not p & o}
            patterns.append(np.array(sorted(layer), np.int64))
        self.patterns = np.zeros((1 << CHECK_BITS, 6), np.int64)
        self.counts = np.zeros(1 << CHECK_BITS, np.int64)
        for layer_patterns in patterns:
            syndromes = _remainder(layer_patterns)
            order = np.argsort(syndromes, kind="stable")
            syndromes, layer_patterns = syndromes[order], layer_patterns[order]
            nth = np.arange(len(order)) - np.searchsorted(syndromes, syndromes)
            self.patterns[syndromes, self.counts[syndromes] + nth] = layer_patterns
            self.counts += np.bincount(syndromes, minlength=len(self.counts))
        self.low = _remainder(np.arange(1 << 12))
        self.high = _remainder(np.arange(1 << 11) << 12)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword indices of each word, the nearest first, padded to six; and how many."""
        syndromes = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words[:, None] ^ self.patterns[syndromes]) >> CHECK_BITS, self.counts[syndromes]


def bucket_codes(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, code) of every key: code is twice the key, plus 1 unless it is made of nearest codewords only."""
    unsigned = fps.view(np.uint64)
    values = [((unsigned >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    found = [golay.keys(v) for v in values]
    places, codes = [], []
    family = 0
    for exact in range(3):
        for near in range(3):
            if near == exact:
                continue
            keys, counts = found[near]
            rows = np.repeat(np.arange(len(fps)), counts)
            nth = ragged(np.zeros(len(fps), np.int64), counts)
            key = (family << 40) | (values[exact][rows] << 12) | keys[rows, nth]
            places.append(rows)
            codes.append(key * 2 + (nth > 0))
            family += 1
    (one, n_one), (two, n_two) = found[0], found[1]
    rows = np.repeat(np.arange(len(fps)), n_one * n_two)
    nth = ragged(np.zeros(len(fps), np.int64), n_one * n_two)
    first, second = nth // n_two[rows], nth % n_two[rows]
    key = (family << 40) | (one[rows, first] << 12) | two[rows, second]
    places.append(rows)
    codes.append(key * 2 + ((first > 0) | (second > 0)))
    return np.concatenate(places), np.concatenate(codes)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number reachable from each of 0..n-1 over the edges a-b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def star_edges(fps: np.ndarray, left: np.ndarray, left_counts: np.ndarray, right_starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) that link the same groups as all close pairs of left[i] with the members right_starts[i]..+left_counts[i]."""
    ids, kinds = dense(fps)
    begin = 0
    ends = np.cumsum(left_counts)
    near_a, near_b = [], []
    while begin < len(left):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        a = np.repeat(left[begin:end], left_counts[begin:end])
        b = ragged(right_starts[begin:end], left_counts[begin:end])
        close = np.bitwise_count(fps[a].view(np.uint64) ^ fps[b].view(np.uint64)) <= radius
        a, b = ids[a[close]], ids[b[close]]
        other = a != b
        near_a.append(a[other])
        near_b.append(b[other])
        if sum(map(len, near_a)) > PAIRS:  # keep a forest of what has been found
            label = roots(np.concatenate(near_a), np.concatenate(near_b), kinds)
            moved = np.flatnonzero(label != np.arange(kinds))
            near_a, near_b = [moved], [label[moved]]
        begin = end
    label = roots(np.concatenate(near_a or [ids[:0]]), np.concatenate(near_b or [ids[:0]]), kinds)
    moved = np.flatnonzero(label != np.arange(kinds))
    value = np.empty(kinds, np.int64)
    value[ids] = fps
    return value[moved], value[label[moved]]


LINKS_SCHEMA = "a long, b long, bucket long, part long, members binary"


def _links_batch(a, b, bucket=None, part=None, members=None) -> pa.RecordBatch:
    n = len(a) if bucket is None else len(bucket)
    none = lambda kind: pa.nulls(n, kind)
    if bucket is None:
        columns = [pa.array(a), pa.array(b), none(pa.int64()), none(pa.int64()), none(pa.binary())]
    else:
        columns = [none(pa.int64()), none(pa.int64()), pa.array(bucket, pa.int64()), pa.array(part, pa.int64()), pa.array(members, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "bucket", "part", "members"])


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Star edges of rows (code, fp) sorted by code; the members of buckets over ``limit`` come out in parts instead."""
    codes, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut: tuple[int, int] | None = None  # the bucket being cut, and its parts so far

    def part(n: int) -> Iterator[pa.RecordBatch]:
        nonlocal cut, codes, fps
        bucket = int(codes[0] >> 1)
        number = cut[1] if cut and cut[0] == bucket else 0
        body = np.stack([codes[:n] & 1, fps[:n]]).tobytes()
        cut, codes, fps = (bucket, number + 1), codes[n:], fps[n:]
        yield _links_batch(None, None, [bucket], [number], [body])

    def whole(n: int) -> Iterator[pa.RecordBatch]:
        nonlocal codes, fps
        key, own, primary = codes[:n] >> 1, fps[:n], (codes[:n] & 1) == 0
        codes, fps = codes[n:], fps[n:]
        begin = np.searchsorted(key, key, side="left")
        size = np.searchsorted(key, key, side="right") - begin
        left = np.flatnonzero(primary & (size > 1))
        if len(left):
            a, b = star_edges(own, left, size[left], begin[left], radius)
            if len(a):
                yield _links_batch(a, b)

    def drain(final: bool) -> Iterator[pa.RecordBatch]:
        while len(codes):
            bucket = codes[0] >> 1
            size = int(np.searchsorted(codes, (bucket + 1) * 2))
            if size > limit or (cut and cut[0] == bucket):
                if size < len(codes) or final or size > limit:
                    yield from part(min(size, limit))
                    continue
                return
            # all buckets that end here and are small enough
            key = codes >> 1
            edges = np.flatnonzero(np.diff(key)) + 1
            bounds = np.concatenate([[0], edges, [len(codes)]] if final else [[0], edges])
            sizes = np.diff(bounds)
            over = np.flatnonzero(sizes > limit)
            n = int(bounds[over[0]] if len(over) else bounds[-1])
            if not n:
                return
            yield from whole(n)

    for batch in batches:
        codes = np.concatenate([codes, batch.column("code").to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False)])
        yield from drain(False)
    yield from drain(True)


def links(fps: DataFrame, radius: int = 3, limit: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) that connect the same groups as all pairs of the distinct fingerprints ``fp`` at most ``radius`` bits apart."""
    if not 0 <= radius <= 3:
        raise ValueError("the keys find pairs at most three bits apart")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            for begin in range(0, batch.num_rows, 20_000):
                own = batch.column("fp").slice(begin, 20_000).to_numpy(zero_copy_only=False)
                places, codes = bucket_codes(own, golay)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(own[places])], ["code", "fp"])

    rows = fps.select("fp").mapInArrow(keyed, "code long, fp long")
    rows = rows.repartition(F.shiftright("code", 1)).sortWithinPartitions("code")
    found = stored(rows.mapInArrow(lambda batches: bucket_links(batches, radius, limit), LINKS_SCHEMA), "simhash-links")
    edges = found.filter("bucket is null").select("a", "b")
    parts = found.filter("bucket is not null").select("bucket", "part", "members")
    if parts.isEmpty():
        return edges

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (side_a, a), (side_b, b) = (np.frombuffer(row[k], np.int64).reshape(2, -1) for k in ("members", "others"))
                own = np.concatenate([a, b])
                left_a, left_b = np.flatnonzero(side_a == 0), len(a) + np.flatnonzero(side_b == 0)
                left = np.concatenate([left_a, left_b])
                counts = np.concatenate([np.full(len(left_a), len(b)), np.full(len(left_b), len(a))]).astype(np.int64)
                starts = np.concatenate([np.full(len(left_a), len(a)), np.zeros(len(left_b), np.int64)]).astype(np.int64)
                x, y = star_edges(own, left, counts, starts, radius)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    others = parts.select("bucket", F.col("part").alias("other_part"), F.col("members").alias("others"))
    pairs = parts.join(others, "bucket").filter("part <= other_part").repartition("bucket", "part", "other_part")
    return edges.unionByName(pairs.select("members", "others").mapInArrow(compare, "a long, b long"))


def labels_of(edges: DataFrame) -> DataFrame:
    """(node, label): nodes of the edges (a, b) with the same label are connected.

    Each round points every node to its neighbour that comes first in a hashed order, follows
    these pointers twice, and contracts the edges; the hashed order keeps chains of pointers short.
    """
    ahead = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.least(F.min(ahead("b")), F.first(ahead("a")))["n"].alias("up")).withColumnRenamed("a", "node")
        parent = stored(parent, "simhash-parents")
        for _ in range(2):
            up = parent.select(F.col("node").alias("up"), F.col("up").alias("next"))
            parent = stored(parent.join(up, "up").select("node", F.col("next").alias("up")), "simhash-parents")
        if labels is None:
            labels = parent.withColumnRenamed("up", "label")
        else:
            step = parent.select(F.col("node").alias("label"), "up")
            labels = stored(labels.join(step, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "simhash-labels")
        a, b = (parent.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        moved = edges.join(a, "a").join(b, "b").filter("up_a <> up_b")
        edges = stored(moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "simhash-edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def classes(prints: DataFrame, radius: int = 3, limit: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``prints`` (doc_id, fp), which is read several times."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "simhash-distinct")
    labels = labels_of(links(distinct, radius, limit))
    member = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").filter("label is not null or rows > 1")
    member = member.select("fp", "first_id", "rows", F.coalesce("label", "fp").alias("label"))
    component = member.groupBy("label").agg(F.min("first_id").alias("component_id"))
    member = stored(member.join(component, "label").select("fp", "component_id", "rows"), "simhash-classes")
    total = distinct.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(member.filter(F.col("rows") * HOT > total).select("fp", "component_id"))  # fewer than HOT rows
    cold = member.filter(F.col("rows") * HOT <= total).select("fp", "component_id")
    busy = prints.join(hot, "fp").select("doc_id", "fp", "component_id")
    rest = prints.join(hot, "fp", "left_anti").join(cold, "fp", "left")
    return busy.unionByName(rest.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable over links of at most ``radius`` bits."""
    return classes(stored(fingerprints(docs, shingle), "simhash-prints"), radius)


ROW = "_simhash_row"


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with exactly one row of each group: that with the smallest doc_id, rows without one last; of rows with the same id any one, told apart by row number.

    Rows are numbered in a stored copy first, so a repeated or missing doc_id neither loses a group nor keeps two rows of one. The rows that go, far fewer than
    those that stay, are taken away by number.
    """
    numbered = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "simhash-rows")
    found = near_duplicates(numbered.select(F.col(ROW).alias("doc_id"), "text"), shingle, radius).select(F.col("doc_id").alias(ROW), "component_id")
    ids = numbered.select(ROW, F.col("doc_id").cast("long").alias("id"))
    named = found.join(ids, ROW)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", ROW))[ROW]
    first = named.groupBy("component_id").agg(best.alias("first"))
    gone = stored(found.join(first, "component_id").filter(F.col(ROW) != F.col("first")).select(ROW), "simhash-gone")
    return numbered.join(gone, ROW, "left_anti").select(docs.columns)
