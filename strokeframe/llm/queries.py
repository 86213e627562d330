"""The registered queries of this subpackage, and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeframe.tables import read_table

from . import cross_polytope, decontaminate, fingerprint, hard_negatives, lang_id, lm, merkle, near_dup, quality, sentencepiece_codec, sharding, toxicity, url_filter
from .training import labelled_texts, remainder

#: The rules that op3 applies: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
SHARDS = 16


#: Labelled rows of each label, and documents of each language, that a model is fitted on at most (about).
QUALITY_ROWS, TOXIC_ROWS, LANG_ROWS = 2000, 2500, 1200


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the public BPE model and decoded again."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.round_trip(docs, sentencepiece_codec.read_model(spark))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by nearest-neighbour voting."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.fit(labelled_texts(docs, labels, "quality", 4, 2, QUALITY_ROWS))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= quality.ACCEPTED).cast("int").alias("predicted")
    )


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how alike they and the next document's are."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = fingerprint.rarity_ranks(docs)
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return fingerprint.compare_with_edits(docs, ranks, sharding.id_ranges(docs, "doc_id", sharding.ranges_for(rows, size or 0)))


def op5_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = read_table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.select("doc_id", "text", "lang").where(remainder(F.col("doc_id"), 4) != 2), "lang", LANG_ROWS)
    found = lang_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; the language that sets the threshold is predicted from the text."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    languages = lang_id.fit(docs.select("doc_id", "text", "lang").where(remainder(F.col("doc_id"), 3) != 1), "lang", LANG_ROWS)
    model = toxicity.fit(labelled_texts(docs, labels, "toxic", 3, 1, TOXIC_ROWS), languages)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "lang_pred",
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows of 13 words."""
    docs, bench = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    hits = decontaminate.find_hits(docs, bench, 13)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 1
    model, words = lm.fit(docs.where(~held_out).select("text"))
    scored = lm.score(docs, model, words)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by jump consistent hashing of their doc_id (the law ``key``)."""
    text = F.coalesce("text", F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    dealt = sharding.shard_rows(docs, "doc_id", SHARDS).withColumn("law", F.lit("key"))
    slotted = sharding.gapless_slots(dealt, "shard", ["doc_id", "size", "text_crc32"])
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: shingles of 4 words, similarity 0.8 or more."""
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), 4, 80)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents by language, with rows that are tampered with where 7 divides the crc32."""
    docs = read_table(spark, sf_dir, "documents")
    tampers = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return merkle.verify_documents(docs, F.coalesce(tampers, F.lit(False)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th embedding; every 7th has its label moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine(rows, "vec_id % 50 = 0")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th embedding, among all embeddings."""
    return cross_polytope.nearest(read_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_quality": op2_quality,
        "op3_url_filter": op3_url_filter,
        "op4_fingerprint": op4_fingerprint,
        "op5_lang_id": op5_lang_id,
        "op6_decontamination": op6_decontamination,
        "op7_lm": op7_lm,
        "op8_sharding": op8_sharding,
        "op9_near_dup": op9_near_dup,
        "op10_toxicity": op10_toxicity,
        "op11_merkle": op11_merkle,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_neighbours": op13_neighbours,
    }


_OP3 = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT page_id, rh || rp AS rule, rv,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
  FROM p JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(rv, 'allow') AS verdict
FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND k = 1
"""

_OP6 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS key
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS key
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.key = bw.key AND dw.n = bw.n),
cover AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP8 = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc),
d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (
  SELECT doc_id, size, CAST(xor(list_reduce(range(0, size - 1), lambda a, i:
      xor(a >> 8, crc[(xor(a, CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)) & 255) + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32
  FROM d, t),
walk AS (
  SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(doc_id AS HUGEINT) AS k, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM documents, range(16, 18) r(n)
  UNION ALL
  SELECT doc_id, n, k2, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / ((k2 >> 33) + 1))) AS BIGINT)
  FROM (SELECT doc_id, n, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM walk WHERE j < n)),
s AS (SELECT doc_id, CAST(max(b) FILTER (n = 16) AS INTEGER) AS shard, CAST(max(b) FILTER (n = 17) AS INTEGER) AS grown_shard FROM walk GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM c JOIN s USING (doc_id)
"""

_OP11 = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc),
d AS (
  SELECT doc_id, lang, n_chars, hex(encode(CAST(doc_id AS VARCHAR))) AS x,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM documents),
c AS (
  SELECT *, xor(list_reduce(range(0, len(x) // 2), lambda a, i:
      xor(a >> 8, crc[(xor(a, CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)) & 255) + 1]), 4294967295), 4294967295) % 7 = 0 AS tampered FROM d, t),
leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(len(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS h,
    CASE WHEN tampered AND n_chars IS NOT NULL THEN sha256(head || len(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS th FROM c),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS slot FROM leaf),
lists AS (SELECT lang, list(h ORDER BY slot) AS hs FROM placed GROUP BY lang),
levels AS (
  SELECT lang, 0 AS lvl, hs FROM lists
  UNION ALL
  SELECT lang, lvl + 1, list_transform(range(0, len(hs), 2), lambda i: sha256(hs[i + 1] || coalesce(hs[i + 2], ''))) FROM levels WHERE len(hs) > 1),
subroots AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS place FROM levels WHERE len(hs) = 1),
tops AS (
  SELECT 0 AS lvl, list(subroot ORDER BY place) AS hs FROM subroots
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, len(hs), 2), lambda i: sha256(hs[i + 1] || coalesce(hs[i + 2], ''))) FROM tops WHERE len(hs) > 1),
siblings AS (
  SELECT p.lang, p.slot, v.lvl, (p.slot >> v.lvl) & 1 AS on_right, coalesce(v.hs[xor(p.slot >> v.lvl, 1) + 1], '') AS s
  FROM placed p JOIN levels v ON p.lang IS NOT DISTINCT FROM v.lang WHERE len(v.hs) > 1
  UNION ALL
  SELECT p.lang, p.slot, 1000 + v.lvl, (r.place >> v.lvl) & 1, coalesce(v.hs[xor(r.place >> v.lvl, 1) + 1], '')
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang, tops v WHERE len(v.hs) > 1),
path AS (SELECT lang, slot, list({'on_right': on_right, 's': s} ORDER BY lvl) AS p FROM siblings GROUP BY lang, slot),
fold AS (
  SELECT p.lang, p.slot, 0 AS k, coalesce(th, h) AS node, coalesce(p, []) AS p FROM placed p LEFT JOIN path q ON p.lang IS NOT DISTINCT FROM q.lang AND p.slot = q.slot
  UNION ALL
  SELECT lang, slot, k + 1, CASE WHEN p[k + 1].on_right = 1 THEN sha256(p[k + 1].s || node) ELSE sha256(node || p[k + 1].s) END, p FROM fold WHERE k < len(p))
SELECT p.doc_id, p.h AS leaf, r.subroot, root, sha256(array_to_string(list_transform(f.p, lambda e: e.s), '')) AS proof_sha256,
  f.node AS folded_root, f.node = root AS verified
FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang
  JOIN fold f ON p.lang IS NOT DISTINCT FROM f.lang AND p.slot = f.slot AND f.k = len(f.p), (SELECT hs[1] AS root FROM tops WHERE len(hs) = 1)
"""

_OP12 = r"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (
  SELECT ar, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS k
  FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.ar, k ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.ar = s.ar AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": _OP3, "op6_decontamination": _OP6, "op8_sharding": _OP8, "op11_merkle": _OP11, "op12_hard_negatives": _OP12}
