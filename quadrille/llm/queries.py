"""The registered queries of the operators and, where SQL can say the same, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, crc_mod, materialize, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_vecdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vecdedup import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE_SQL["op2_vecdedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), sound AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM v
  UNION
  SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.node
), least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


@query
def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_languages, predicted

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = fit_languages(docs.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), predicted(model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, toxicity

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    labels = read_table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), toxicity(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import features, with_media

    docs = read_table(bounded(spark), sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    # the images are a column of a table, and all that follows is read back from it
    table = materialize(with_media(docs, F.col("text")).select("doc_id", n_bytes, "media"), "media", compression="none")
    stored = table.select("doc_id", "n_bytes", features(F.col("media")).alias("f"))
    parts = [F.col(f"f.{c}").alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")]
    return stored.select("doc_id", "n_bytes", *parts, F.lower(F.hex("f.low_hash")).alias("feature"), F.col("f.low_hash").alias("low_hash"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: Sources by cap for their weight: those before the first that is not full have their cap, the others share what is left.
ORACLE_SQL["op8_mixing"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), w AS (SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), o AS (SELECT *, 3 * n AS cap, row_number() OVER (ORDER BY 3 * n / weight, source NULLS LAST) AS k FROM w
), t AS (SELECT *, (SELECT sum(n) FROM w) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM o
), f AS (SELECT k AS k0, rest AS left_, weights AS of_ FROM t WHERE cap * weights > rest * weight ORDER BY k LIMIT 1
), share AS (SELECT source, n, (CASE WHEN k0 IS NULL OR k < k0 THEN cap ELSE left_ * weight END)::BIGINT AS a, (CASE WHEN k0 IS NULL OR k < k0 THEN 1 ELSE of_ END)::BIGINT AS b FROM t LEFT JOIN f ON true
), plan AS (SELECT source, n, a::DOUBLE / b AS target, a // b + CASE WHEN 2 * (a % b) > b OR (2 * (a % b) = b AND a // b % 2 = 1) THEN 1 ELSE 0 END AS take FROM share
), rows_ AS (SELECT doc_id, size, n, target, CASE WHEN n > 0 THEN take // n ELSE 0 END AS passes, CASE WHEN n > 0 THEN take % n ELSE 0 END AS want,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(md5('0:' || doc_id), 1, 15))::BIGINT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN plan ON plan.source IS NOT DISTINCT FROM d.source
), taken AS (SELECT *, (passes * size + greatest(0, least(size, want - before)))::BIGINT AS taken FROM rows_)
SELECT doc_id, size, n AS source_size, target, taken, CASE WHEN size > 0 THEN taken // size ELSE 0 END::INT AS copies FROM taken
"""


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import place

    return place(read_table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"))


def _sharding_sql() -> str:
    from .sharding import SHARDS, SLOTS

    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE shards AS (
  SELECT i, name, 1 + {number.format("name || ':step'")} % {SLOTS - 1} AS a, {number.format("name || ':offset'")} % {SLOTS} AS b
  FROM (SELECT unnest(range({len(SHARDS)})) AS i, unnest([{", ".join(f"'{s}'" for s in SHARDS)}]) AS name)
), fill AS (
  SELECT 0::BIGINT AS t, NULL::BIGINT AS slot, range({SLOTS}) AS free
  UNION ALL
  SELECT t + 1, p, list_filter(free, lambda s: s <> p) FROM (
    SELECT t, free, list_min(list_transform(free, lambda s: ((a * s + b) % {SLOTS}) * {SLOTS} + s)) % {SLOTS} AS p
    FROM fill JOIN shards ON shards.i = fill.t % {len(SHARDS)} WHERE t < {SLOTS})
), slots AS (SELECT slot, name AS shard FROM fill JOIN shards ON shards.i = (fill.t - 1) % {len(SHARDS)} WHERE t > 0)
SELECT doc_id, d.slot, shard FROM (SELECT doc_id, {number.format("coalesce(doc_id::VARCHAR, '')")} % {SLOTS} AS slot FROM documents) d JOIN slots USING (slot)
"""


ORACLE_SQL["op9_sharding"] = _sharding_sql()

#: The dated list of op5_urllist beside the rule for hosts: entry, added, removed (days of 2024 from 0; None: never).
_URL_ENTRIES = [("example.net", 31, 60), ("example.org", 227, 244), ("example.com/fr", 121, 152), ("example.com/en", 300, None), ("example.net/de", 10, 20), ("example.net", 180, 185)]
_EPOCH = 1_704_067_200


@query
def op5_urllist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages have no fetch time and come with no list, so both follow rules: page n is fetched in minute 7919 n modulo a
    year of 2024; a quarter of the hosts, by MD5, is listed for up to 90 days, some of those later once more for good."""
    from .urllist import active_entries, host_of

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("at", F.lit(_EPOCH) + F.col("page_id") * 7919 % 525_600 * 60)
    hosts = pages.select(host_of(F.col("url")).alias("entry")).where("entry is not null").distinct()
    x = F.conv(F.substring(F.md5("entry"), 1, 8), 16, 10).cast("long")
    day = lambda d: F.lit(_EPOCH) + d * 86_400
    listed = hosts.withColumn("x", x).where("x % 4 = 0").withColumn("d", F.floor(F.col("x") / 7) % 300)
    dated = F.array(
        F.struct(F.lit(True).alias("add"), day(F.col("d")).alias("at")),
        F.struct(F.lit(False).alias("add"), day(F.col("d") + 1 + F.floor(F.col("x") / 11) % 90).alias("at")),
        F.struct(F.lit(True).alias("add"), F.when(F.col("x") % 16 == 0, day(F.col("d") + 200)).alias("at")),
    )
    events = listed.select("entry", F.explode(dated).alias("e")).select("entry", "e.add", F.col("e.at").cast("long").alias("at"))
    fixed = [(e, add, _EPOCH + d * 86_400) for e, since, until in _URL_ENTRIES for add, d in ((True, since), (False, until)) if d is not None]
    rows = F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(a).alias("add"), F.lit(t).cast("long").alias("at")) for e, a, t in fixed])
    events = events.unionByName(spark.range(1).select(F.inline(rows)))
    return active_entries(captures, events).withColumnsRenamed({"id": "page_id", "at": "fetched_at"})


ORACLE_SQL["op5_urllist"] = f"""
WITH c AS (
  SELECT page_id, {_EPOCH} + page_id * 7919 % 525600 * 60 AS ts,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]*)', 1), '\\.+$', ''), '') AS host,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS segment
  FROM pages
), h AS (SELECT entry, x, x // 7 % 300 AS d FROM (SELECT DISTINCT host AS entry, ('0x' || substr(md5(host), 1, 8))::BIGINT AS x FROM c WHERE host IS NOT NULL) WHERE x % 4 = 0
), events AS (
  SELECT entry, true AS add, {_EPOCH} + d * 86400 AS ts FROM h
  UNION SELECT entry, false, {_EPOCH} + (d + 1 + x // 11 % 90) * 86400 FROM h
  UNION SELECT entry, true, {_EPOCH} + (d + 200) * 86400 FROM h WHERE x % 16 = 0
  UNION SELECT * FROM (VALUES {", ".join(f"('{e}', {str(a).lower()}, {_EPOCH + d * 86_400})" for e, s, u in _URL_ENTRIES for a, d in ((True, s), (False, u)) if d is not None)})
), states AS (SELECT entry, ts, bool_or(add) AS add FROM events GROUP BY entry, ts
), flips AS (SELECT * FROM (SELECT *, lag(add) OVER w AS before FROM states WINDOW w AS (PARTITION BY entry ORDER BY ts)) WHERE add <> coalesce(before, false)
), spans AS (SELECT * FROM (SELECT entry, add, ts AS since, lead(ts) OVER (PARTITION BY entry ORDER BY ts) AS until FROM flips) WHERE add
), keys AS (
  SELECT page_id, ts, domain AS entry, segment FROM (
    SELECT page_id, ts, segment, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))) AS domain
    FROM c WHERE host IS NOT NULL)
), asked AS (SELECT page_id, ts, entry FROM keys UNION ALL SELECT page_id, ts, entry || '/' || segment FROM keys WHERE segment IS NOT NULL
), hits AS (
  SELECT a.page_id, count(*) AS n, max(struct_pack(l := length(s.entry), entry := s.entry, since := s.since)) AS top
  FROM asked a JOIN spans s ON s.entry = a.entry AND s.since <= a.ts AND (s.until IS NULL OR a.ts < s.until) GROUP BY a.page_id
)
SELECT c.page_id, c.host, c.ts::BIGINT AS fetched_at, coalesce(n, 0) > 0 AS blocked, coalesce(n, 0)::BIGINT AS n_active, top.entry AS entry, top.since::BIGINT AS since
FROM c LEFT JOIN hits ON hits.page_id = c.page_id
"""


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op7_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import read_tokens, write_tokens

    return read_tokens(write_tokens(read_table(spark, sf_dir, "documents"), _tokenizer())).withColumnRenamed("id", "doc_id")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), _tokenizer()).withColumnRenamed("id", "doc_id")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
