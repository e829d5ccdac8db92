"""Registered queries of the training-data operators, with SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, brown, centroids, collision, linededup, mixing, multiindex, ordermin, packing, phrases, sharding, toxicity, warc
from ._common import load

SHARDS, OLD_SHARDS = 40, 32


def op1_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents lie in 32 shards by key and move to 40 of near-equal bytes; digests are of the rewritten files."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    old = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    rows, _ = sharding.reshard(docs, old, SHARDS)
    rows = rows.select("doc_id", F.col("_size").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "_shard", "_chunk", "_h")
    return sharding.number_slots(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_collision_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.near_duplicates(load(spark, sf_dir, "embeddings"))


def op3_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the smallest doc_id of its near-duplicate class."""
    return bagminhash.dedup(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op4_suffix_array_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with what is left of its text once later copies of repeated runs of 50 words or more are deleted."""
    return linededup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(load(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), held_out=toxicity.held_out())
    scored = toxicity.score(docs, model, keep_text=False)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op7_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(load(spark, sf_dir, "documents").select("doc_id", "text"), brown.held_out())


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found by inner product of every vector whose id is divisible by 20."""
    return multiindex.search(load(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_linear_grouping_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, keep_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_suffix_array_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return phrases.collocations(load(spark, sf_dir, "documents"))


def op12_exact_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return centroids.cluster(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return ordermin.fingerprints(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {f.__name__: f for f in (op1_flow_resharding, op2_collision_near_dedup, op3_bagminhash_near_dedup, op4_suffix_array_line_dedup, op5_warc_index_merge, op6_ftrl_toxicity, op7_brown_class_lm, op8_inverted_multi_index, op9_subset_sum_mix, op10_linear_grouping_pack, op11_suffix_array_phrases, op12_exact_centroids, op13_order_minhash)}

_DIGIT = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {10 * k + 1}, 10))::BIGINT >> {35 - 5 * j}) & 31)::INT + 1, 1)" for k in range(4) for j in range(8))


def _rounds(n: int) -> str:
    """Assignments and new centroids, round by round: c0 are the first centroids, a_i the assignments to c_i."""
    near = "a{i} AS MATERIALIZED (SELECT row, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c ON v.pos = c.pos GROUP BY ALL) GROUP BY row)"
    move = "c{j} AS MATERIALIZED (SELECT c.cluster, c.pos, coalesce(s.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT a.cluster, v.pos, (sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{i} a JOIN v ON a.row = v.row GROUP BY ALL) s ON c.cluster = s.cluster AND c.pos = s.pos)"
    return ",\n".join([near.format(i=0), *[x.format(i=i, j=i + 1) for i in range(n) for x in (move, near.replace("{i}", "{j}"))]])


ORACLES = {
    "op11_suffix_array_phrases": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
z AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
k AS (SELECT unnest(range(1, 6)) AS k),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS g FROM p, k WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT f.lang, f.k, f.g, f.f AS a, z.n, unnest(range(1, f.k)) AS cut FROM f JOIN z USING (lang) WHERE f.k > 1),
s AS (SELECT c.*, l.f AS l, r.f AS r, CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM c
  JOIN f l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, cut) JOIN f r ON r.lang = c.lang AND r.g = list_slice(c.g, cut + 1, c.k)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
m AS (SELECT lang, sub, max(f) AS most FROM (SELECT lang, f, unnest(list_transform(range(1, k - n + 2), lambda i: list_slice(g, i, i + n - 1))) AS sub
  FROM (SELECT *, unnest(range(2, k)) AS n FROM f WHERE k > 2)) GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN m ON m.lang = b.lang AND m.sub = b.g WHERE m.most IS NULL OR 100 * m.most < 100 * a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM o) WHERE rank <= 2000""",
    "op12_exact_centroids": f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS place FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT row, unnest(range(64)) AS pos, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e),
c0 AS MATERIALIZED (SELECT CAST(place AS INT) AS cluster, pos, x FROM e JOIN v USING (row) WHERE place < 8),
{_rounds(10)},
h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c10 GROUP BY cluster),
i AS (SELECT cluster, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a10 GROUP BY cluster)
SELECT e.vec_id, a.cluster, CAST(a.d AS BIGINT) AS distance, i.cluster_inertia, CAST((SELECT sum(d) FROM a10) AS BIGINT) AS inertia, h.centroid_sha256
FROM e JOIN a10 a USING (row) JOIN h USING (cluster) JOIN i USING (cluster)""",
    "op2_collision_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op5_warc_index_merge": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_DIGIT} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f""",
}
