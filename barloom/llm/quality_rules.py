"""Quality rules: word counts, repetition, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed n-grams: one of trusted documents, one of the
whole corpus.  A document's score is the mean log ratio over its n-grams (so length does not
matter), and every document whose score reaches ``threshold`` is kept: no draw is involved.

n-grams are of tokens, a token being a run of letters and digits or a run of other visible
characters, in their case.  Single tokens and pairs of neighbours are hashed to buckets.  Their
number follows the corpus: the power of two from twice the square root of its characters on
(:func:`bucket_count`), so the model grows with the input while the table that reaches the tasks,
one array literal, stays small: 512 kB at 1 GB of text, 128 MB at 50 TB.  A table joined by n-gram
would grow in proportion, but moves every n-gram of every document.

Everything here is DataFrame expressions; nothing runs in Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import after, barrier, whole, words

LEAST_BUCKETS = 1 << 14
SMOOTHING = 1.0          # added to both counts of every bucket
TARGET_ROWS = 20_000     # bound on trusted documents; fits the broadcast of their ids
THRESHOLD = -0.25        # mean log ratio (nats per n-gram) below which a text is rejected
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "[^#*$%&|<>]+"
TOKENS = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]+"


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """Buckets for a corpus: a power of two; one number reaches the driver."""
    chars = docs.agg(F.sum(F.length(F.col(text))).alias("n")).first()["n"] or 0
    return max(LEAST_BUCKETS, 1 << math.ceil(math.log2(2 * math.sqrt(chars) + 1)))


def ngrams(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """``docs`` with the bucket numbers of single tokens and of pairs of neighbours (``_grams``).

    Neighbours are paired by ``zip_with``: a lambda that looked into the array would make the
    optimizer's inlining quadratic.
    """
    hashed = docs.withColumn("_t", F.transform(
        F.regexp_extract_all(whole(F.col(text)), F.lit(TOKENS), F.lit(0)),
        lambda t: F.xxhash64(t)))
    number = lambda h: h.bitwiseAND(F.lit(buckets - 1)).cast("int")
    pairs = F.zip_with(F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0))),
                       after(F.col("_t"), 1), lambda a, b: number(F.xxhash64(a, b)))
    return hashed.withColumn("_grams", F.concat(F.transform("_t", number), pairs)).drop("_t")


def trusted(labels: DataFrame, key: str = "doc_id", quality: str = "quality",
            rows: int = TARGET_ROWS) -> DataFrame:
    """At most ``rows`` ids of documents labelled good: those of least hash."""
    return (labels.where(F.col(quality) == 1).select(F.col(key).alias("_id")).distinct()
            .orderBy(F.xxhash64("_id"), "_id").limit(rows))


def model(docs: DataFrame, target_ids: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """One row, one array: the log ratio of every bucket.

    The corpus counts cover every document; the target counts the documents of
    ``target_ids`` (bounded, so it is broadcast).
    """
    grams = (ngrams(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", buckets)
             .drop("_text").join(F.broadcast(target_ids.select("_id", F.lit(1).alias("_hit"))),
                   F.col("_key") == F.col("_id"), "left")
             .select(F.col("_hit").isNotNull().cast("bigint").alias("hit"),
                     F.explode_outer("_grams").alias("b")))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("hit").alias("hit"))
    every = Window.partitionBy()  # a row per bucket
    share = lambda c: F.log((F.coalesce(c, F.lit(0)) + SMOOTHING)
                            / (F.coalesce(F.sum(c).over(every), F.lit(0)) + SMOOTHING * buckets))
    ratios = (docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
              .join(counts, "b", "left")
              .select("b", (share(F.col("hit")) - share(F.col("raw"))).alias("ratio")))
    return (ratios.agg(F.sort_array(F.collect_list(F.struct("b", "ratio"))).alias("r"))
            .select(F.col("r.ratio").alias("ratio")))


def _fives(items: Column, join) -> Column:
    """Five neighbouring items joined, from each place that has as many (pairs, fours, fives)."""
    two = F.zip_with(items, after(items, 1), join)
    four = F.zip_with(two, after(two, 2), join)
    return F.slice(F.zip_with(four, after(items, 4), join), 1,
                   F.greatest(F.size(items) - (WINDOW - 1), F.lit(0)))


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Whole texts; a null text counts as empty and gives zeros.  Windows of five words are
    compared by a hash of the words' hashes.  Only texts with equal hashes sort them, and the
    windows whose hash is found again are then compared word by word, so the count is exact.
    Columns of these names are replaced.
    """
    t = whole(F.col(text))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    out = docs.withColumn("_w", barrier(words(t))).withColumns({
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace(t, SYMBOLS, "")).cast("bigint"),
        "_l": lines,
        "_h": F.transform("_w", lambda x: F.xxhash64(x))})
    mixed = lambda a, b: F.shiftleft(a, 7).bitwiseXOR(b)
    out = out.withColumn("_v", barrier(_fives(F.col("_h"), mixed)))
    repeats = F.size(F.array_distinct("_v")) < F.size("_v")
    out = out.withColumn("_s", F.when(repeats, F.sort_array(F.transform(
        "_v", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    # the windows whose hash is found again, word by word
    window = lambda i: F.array_join(F.slice("_w", i + 1, WINDOW), " ")
    out = out.withColumn("_s", F.sort_array(F.transform(
        _alike(F.col("_s"), "struct<x:bigint,i:int>"),
        lambda e: F.struct(window(e["i"]).alias("x"), e["i"].alias("i")))))
    out = out.withColumn("_p", F.sort_array(F.transform(
        _alike(F.col("_s"), "struct<x:string,i:int>"), lambda e: e["i"])))
    covered = F.aggregate(
        "_p", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"),
                              p.alias("last")))["n"]
    return out.withColumns({
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
    }).drop("_w", "_l", "_h", "_v", "_s", "_p")


def _alike(items: Column, kind: str) -> Column:
    """Of sorted (x, i) those whose x is that of the one before or behind."""
    before = F.concat(F.array(F.lit(None).cast(kind)), items)
    beside = F.zip_with(
        F.zip_with(items, before, lambda e, b: F.struct(e.alias("e"), (e["x"] == b["x"]).alias("t"))),
        after(items, 1),
        lambda p, n: F.struct(p["e"].alias("e"), F.coalesce(
            p["t"] | (p["e"]["x"] == n["x"]), p["t"], p["e"]["x"] == n["x"]).alias("t")))
    return F.transform(F.filter(beside, lambda e: e["t"]), lambda e: e["e"])


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def judge_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """(row, n_words ... n_repeat_words, score, base_failed, kept): ``row`` is the untouched input
    row as a struct, so its columns may have any names.

    Repeated rows are judged alike.  A null text is an empty one; a text without tokens has score
    0 (and fails the base rule); a row with a null key is judged like others but never trusted.
    Without trusted documents all ratios only reflect smoothing.  An empty table gives no rows.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(text).alias("_text"))
    buckets = bucket_count(docs, text)
    ratio = model(docs, trusted(labels, key), key, text, buckets)
    grams = ngrams(rule_counts(rows, "_text"), "_text", buckets).withColumn("_ratio", ratio.scalar())
    total = F.aggregate("_grams", F.lit(0.0), lambda a, b: a + F.get(F.col("_ratio"), b))
    return (grams.withColumn("score", F.coalesce(total / F.nullif(F.size("_grams"), F.lit(0)),
                                                 F.lit(0.0)))
            .drop("_grams", "_ratio", "_text")
            .withColumn("base_failed", barrier(base_failed()))
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """As :func:`judge_rows` with the input's columns in place of ``row``.

    An input column with the name of a result (``score``, ``kept``, ...) gives way to it.
    """
    found = judge_rows(docs, labels, key, text, threshold)
    mine = {c.lower() for c in found.columns} - {"row"}
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in mine],
                        *[c for c in found.columns if c != "row"])


def kept_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    found = judge_rows(docs, labels, key, text, threshold).where("kept")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
