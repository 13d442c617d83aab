"""The registered queries of this package and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import stage, staging_root
from . import (conversation_repair, decontamination, packing, pairwise_quality, quality_rules,
               secret_scan, simhash_dedup, substring_dedup, suffix_dedup, token_alignment,
               token_counts, toxicity, trie_bpe)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn
    return register


def _spans_sql(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one rule: the texts between matches and the matches, summed in turn."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {place} AS place,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
         length(m[i]) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m,
                     regexp_extract_all(t, '{p}', {group}) AS g,
                     string_split_regex(t, '{p}') AS gaps FROM d))
  WHERE length(g[i]) >= {least}"""


# fixed values: the rules of the contract
_ASSIGN = ("(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?"
           "([A-Za-z0-9+/_.=-]+)")
SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_spans_sql(0, 'assign', _ASSIGN, 2, 6)}
  UNION ALL {_spans_sql(1, 'access', 'AKIA[A-Z0-9]+', 0, 20)}
  UNION ALL {_spans_sql(2, 'hex', '[0-9a-f]{24,}', 0, 24)}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
             count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ','
                        ORDER BY s, place) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


@query("op1_secret_scans", SECRETS_SQL)
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = f"{staging_root(spark)}/barloom-{uuid.uuid4().hex}/blob-ledger"
    found = secret_scan.scan_versions(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                      ledger)
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    return found.select(
        "doc_id", *(secret_scan.count_kind("spans", k).alias(f"n_{k}") for k in kinds),
        F.sha2(secret_scan.span_text(F.col("spans"), kinds).cast("binary"), 256)
        .alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"))


@query("op2_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_texts(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


@query("op3_quality_rules")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("score", 6).alias("score"))


SUBSTRING_SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''),
                  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS low FROM v)
      WHERE low < doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(13) AS t(k)),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w)
SELECT w.doc_id, len(any_value(w.w)) AS n_words, count(c.i) AS n_removed,
       sha256(coalesce(string_agg(e.x, ' ' ORDER BY e.i) FILTER (c.i IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN e ON e.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = e.doc_id AND c.i = e.i
GROUP BY w.doc_id"""


@query("op4_substring_dedup", SUBSTRING_SQL)
def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op5_simhash_dedup")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op6_quality_classifier")
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.score_texts(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "labels"))


@query("op7_suffix_dedup")
def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans",
                       F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_token_counts")
def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = stage(token_counts.token_blocks(table(spark, sf_dir, "documents")), "token-files")
    return token_counts.count_tokens(blocks).select(F.col("key").alias("doc_id"), "n_tokens")


@query("op9_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


@query("op10_decontamination")
def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))


@query("op11_bpe")
def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie_bpe.round_trip(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the damage of the contract."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" "))
                              for c in ("conv_id", "turn")))
    hit = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    times = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn",
        F.when(hit == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text)
        .alias("text"), F.explode(F.array_repeat(F.lit(1), times))).drop("col")


@query("op12_conversation_repair")
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(original)
    edits = conversation_repair.plan_repairs(rows)
    numbers = conversation_repair.summary(rows, edits)
    audits = conversation_repair.audits(rows, edits)
    out = original.select("conv_id").distinct()
    for part in (numbers, audits):
        out = (out.join(part.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")),
                        "left").drop("c"))
    zero = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
            for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))
                      .alias("repaired_sha256"))


@query("op13_token_alignment")
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    kept = stage(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return token_alignment.score_links(kept, token_alignment.link_counts(kept)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
        "n_overlaps")
