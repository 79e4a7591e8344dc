"""The registered queries of this folder, one per operator, over whole tables.

Each applies its operator with production parameters and returns its full result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.llm import conversation_repair, decontamination, hard_negatives, impact_search, licenses, packing, passages, pieces, quality_rules, secret_scans, simhash, token_counts, toxicity

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    forest = quality_rules.train(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, forest)


@query
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scans.joined(base), 256).alias("base_sha256"),
        secret_scans.joined(F.col("spans")).alias("spans"),
    )


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=4096)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and decoded again from its ids."""
    found = pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def _fold(folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def _predictions(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold 0 is held out; folds 1 to 3 are counted, fold 4 sets the curve."""
    docs, fold = _table(spark, sf_dir, "documents"), _fold(5)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), count_rows=fold.isin(1, 2, 3), curve_rows=fold == 4)
    scored = toxicity.score(docs, model)
    model.release()
    return _predictions(scored, fold == 0)


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold 1 of three is held out."""
    docs, fold = _table(spark, sf_dir, "documents"), _fold(3)
    model = passages.train(docs, _table(spark, sf_dir, "labels"), learn=fold != 1)
    return _predictions(passages.score(docs, model), fold == 1)


SQL["op2_impact_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op2_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.search(_table(spark, sf_dir, "embeddings"), asks=F.col("vec_id") % 50 == 0, k=5, step=1 / 256)


def _license_sql(least: float = 0.8) -> str:
    """Exact containment in every window, without any retrieval."""
    rows = []
    for name, text in sorted(licenses.TEMPLATES.items()):
        words = re.findall("[a-z0-9]+", text.lower())
        runs = list(dict.fromkeys(" ".join(words[i : i + licenses.SHINGLE]) for i in range(len(words) - licenses.SHINGLE + 1)))
        pieces = [runs[i : i + licenses.PIECE] for i in range(0, len(runs), licenses.PIECE)]
        rows.append(f"('{name}', {len(runs)}, {pieces!r})")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH templates(name, total, pieces) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END AS s FROM w),
windows AS (SELECT doc_id, list_transform(range(0, greatest(1, len(s)), {licenses.PIECE}), lambda a: s[a + 1:a + {2 * licenses.PIECE}]) AS ws FROM s),
scored AS (
  SELECT doc_id, name, list_sum(list_transform(pieces, lambda p: list_max(list_transform(ws, lambda x: len(list_intersect(x, p)))))) / total::DOUBLE AS c
  FROM windows, templates
),
held AS (SELECT doc_id, name, c FROM scored WHERE c >= {least})
SELECT d.doc_id, count(h.name)::INTEGER AS n_licenses, coalesce(string_agg(h.name, ',' ORDER BY h.name), '') AS licenses, coalesce(max(h.c), 0)::DOUBLE AS containment
FROM documents d LEFT JOIN held h USING (doc_id) GROUP BY d.doc_id"""


SQL["op5_license_scans"] = _license_sql()


@query
def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"), least=0.8)
    names = F.array_join(F.transform("licenses", lambda f: f["name"]), ",")
    return found.select("doc_id", F.size("licenses").alias("n_licenses"), names.alias("licenses"), F.coalesce(F.array_max(F.transform("licenses", lambda f: f["containment"])), F.lit(0.0)).alias("containment"))


SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.r <> c.r
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT anchor, vec_id, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5
), n AS (
  SELECT s.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), label, asks=F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100, step=1 / 256)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every document against every window of every item, without fingerprints.
SQL["op12_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, words)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), span=10, gram=5)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): one hash over each conversation's lines, taken as they stream by. A hash is made in one place, but no conversation is held."""
    line = F.concat(F.when(F.col("place") > 0, "\n").otherwise(""), "role", F.lit(":"), "text").cast("binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []
        for batch in batches:
            for conv_id, text in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if digest is None or conv_id != key:
                    if digest is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = conv_id, hashlib.sha256()
                digest.update(text)
            yield _rows(done)
            done = []
        if digest is not None:
            yield _rows([(key, digest.hexdigest())])

    def _rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], ["conv_id", "repaired_sha256"])

    lines = repaired.select("conv_id", "place", line.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return lines.mapInArrow(run, "conv_id long, repaired_sha256 string")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations")
    summary, repaired = conversation_repair.repair(conversation_repair.damaged(table))
    every = table.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = conversation_repair.joined
    out = joined(joined(every, summary, "conv_id", how="left"), _digests(repaired), "conv_id", how="left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _repair_sql() -> str:
    """Row by row instead of by spans: the least (cost, audit) that reaches each state of the pattern after every row."""
    plus = lambda v, cost, edit: f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{edit}'}}"
    least = lambda *vs: f"list_min([{', '.join(vs)}])"
    closed = f"""SELECT *, {least("u", plus("o", 3, "I"), plus("s", 3, "I"), plus("a", 3, "I"))} AS xu"""
    drawn = "list_reduce(flatten([[4294967295]] || list_transform(range(1, len(k) + 1), lambda i: [ascii(k[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)"
    never = "{'c': 1000000000000, 'a': ''}"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE convs AS (SELECT conv_id, row_number() OVER () AS v FROM (SELECT DISTINCT conv_id FROM conversations)),
keyed AS (SELECT v, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
          FROM conversations c JOIN convs n ON c.conv_id IS NOT DISTINCT FROM n.conv_id),
drawn AS (SELECT *, xor({drawn}, 4294967295) % 20 AS d FROM keyed),
damaged AS (SELECT v, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
                   CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS one
            FROM drawn WHERE d <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY turn NULLS FIRST, role, left(text, 32), md5(text)) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY v, role, text ORDER BY i) AS nth, rtrim(text, {space}) AS body, left(role, 1) AS x FROM ordered),
faulty AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM seen),
pairs AS (SELECT *, lag(x) OVER (PARTITION BY v ORDER BY i) || x AS pair FROM faulty),
counts AS (SELECT v, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
                  count(*) FILTER (f = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM pairs GROUP BY v),
steps(v, i, o, s, u, a) AS (
  SELECT v, 0::BIGINT, {{'c': 0::BIGINT, 'a': ''}}, {never}, {never}, {never} FROM counts
  UNION ALL
  SELECT v, i, {plus("o", 4, "D")}, {least(plus("s", 4, "D"), f"CASE WHEN live AND x = 's' THEN {plus('o', 'more', 'K')} ELSE {never} END")},
         {least(plus("xu", 4, "D"), f"CASE WHEN NOT live THEN {never} WHEN x = 'u' THEN {plus(least('o', 's', 'xa'), 'more', 'K')} ELSE {plus(least('o', 's', 'xa'), '3 + more', 'R')} END")},
         {least(plus("xa", 4, "D"), f"CASE WHEN NOT live THEN {never} WHEN x = 'a' THEN {plus('xu', 'more', 'K')} ELSE {plus('xu', '3 + more', 'R')} END")}
  FROM (SELECT *, {least("a", plus("xu", 3, "I"))} AS xa FROM (
    {closed} FROM (SELECT p.v, f.i, o, s, u, a, x, f.f IN ('', 't') AS live, CASE WHEN f.f = 't' THEN 3 ELSE 0 END AS more FROM steps p JOIN faulty f ON f.v = p.v AND f.i = p.i + 1)))
),
done AS (SELECT v, {least("o", "a", plus("xu", 3, "I"))} AS best FROM ({closed} FROM steps JOIN counts USING (v) WHERE i = n)),
letters AS (SELECT v, unnest(range(1, len(best.a) + 1)) AS p, best.a AS audit FROM done),
edits AS (SELECT v, p, audit[p] AS e, count(*) FILTER (audit[p] <> 'I') OVER w AS i, count(*) FILTER (audit[p] <> 'D') OVER w - 1 AS place, count(*) FILTER (audit[p] <> 'D') OVER (PARTITION BY v) AS size
          FROM letters WINDOW w AS (PARTITION BY v ORDER BY p)),
lines AS (SELECT e.v, place, CASE WHEN e = 'K' THEN role WHEN (place - size % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line
          FROM edits e LEFT JOIN faulty f ON f.v = e.v AND f.i = e.i WHERE e <> 'D'),
texts AS (SELECT v, string_agg(line, chr(10) ORDER BY place) AS body FROM lines GROUP BY v)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM convs LEFT JOIN counts USING (v) LEFT JOIN done USING (v) LEFT JOIN texts USING (v)"""


SQL["op11_conversation_repair"] = _repair_sql()
