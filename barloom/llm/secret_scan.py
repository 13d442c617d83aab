"""Secret scans over every version of every text through an incremental blob ledger.

* A *blob* is a distinct text, named by its SHA-256.  Any number of paths (rows, historical
  versions) may carry one blob.
* The *ledger* is a table in a shared folder with a row per scanned blob: the rules it was
  scanned with (each rule carries its version) and the spans found.
* A scan looks at the distinct blobs, takes out what the ledger already holds for the wanted
  rule versions, runs only the missing rules on the unseen blobs, appends the outcome, and
  joins the findings of all blobs back to all paths.

Copies meet in a partial aggregation on the blob name, so a text carried by a third of all
rows is moved once per task and scanned once.  The join back moves names only.

All of it is DataFrame expressions; nothing runs in Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import barrier, whole


@dataclass(frozen=True)
class Rule:
    """A pattern without look-around; ``group`` of a match has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values: the rules of the contract, in their order
BASE_RULES = (
    Rule("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?"
                   "([A-Za-z0-9+/_.=-]+)", group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}", least=24),  # maximal runs, so the bound may be in the pattern
)
LEDGER = "blob binary, rules array<string>, spans array<struct<rule:string,start:int,stop:int>>"


def blob_name(text: str):
    return F.unhex(F.sha2(whole(F.col(text)).cast("binary"), 256))


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger at ``path``; empty if nothing was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as e:  # noqa: BLE001 - only a missing path means an empty ledger
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def _pieces(todo: str, rule: Rule, place: int):
    """Per match of a rule: characters before it since the last match, its length, valid."""
    text = F.col("text")
    all_of = lambda g: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g))
    gaps = F.split(text, rule.pattern, -1)
    each = F.zip_with(
        F.zip_with(all_of(0), all_of(rule.group), lambda m, g: F.struct(
            F.length(m).alias("n"), (F.length(g) >= rule.least).alias("ok"))),
        gaps, lambda m, gap: F.struct(
            F.lit(place).alias("place"), F.length(gap).alias("gap"),
            m["n"].alias("n"), m["ok"].alias("ok")))
    found = F.array_contains(F.col(todo), rule.name) & text.rlike(rule.pattern)
    return F.when(found, F.filter(each, lambda e: e["n"].isNotNull()))


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules, spans) of blobs (blob, text, todo): runs each blob's missing rules.

    Offsets are running sums of the pieces between matches: linear in the text and right for
    any pattern.  The pieces are few rows, on the partitioning of the blobs.
    """
    nothing = F.array().cast("array<struct<place:int,gap:int,n:int,ok:boolean>>")
    pieces = blobs.select("blob", "todo", F.flatten(F.array(*(
        F.coalesce(_pieces("todo", r, i), nothing) for i, r in enumerate(rules)))).alias("p"))
    rows = pieces.select("blob", "todo", F.posexplode_outer("p").alias("at", "p"))
    so_far = (Window.partitionBy("blob", "p.place").orderBy("at")
              .rowsBetween(Window.unboundedPreceding, 0))
    stop = F.sum(F.col("p.gap") + F.col("p.n")).over(so_far).cast("int")
    names = F.array(*(F.lit(r.name) for r in rules))
    span = F.when(F.col("p.ok"), F.struct(
        F.get(names, F.col("p.place")).alias("rule"), (stop - F.col("p.n")).alias("start"),
        stop.alias("stop")))
    return (rows.select("blob", "todo", span.alias("span"))
            .groupBy("blob").agg(F.first("todo").alias("rules"),
                                 F.collect_list("span").alias("spans")))


def scan_versions(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE_RULES,
                  text: str = "text") -> DataFrame:
    """Update the ledger with the blobs of ``docs`` and return ``docs`` with their findings.

    ``docs``: one row per path and version; all columns stay, ``blob`` and ``spans`` (sorted
    by start, then by the order of the rules) are added; an input column of either name gives way.
    A null text is the empty blob.
    Running it again on the same rows scans nothing; a rule with a new version, or a new
    rule, is run on all blobs, and only that rule.
    """
    spark = docs.sparkSession
    names = [r.name for r in rules]
    wanted = F.array(*map(F.lit, names))
    seen = (read_ledger(spark, ledger).groupBy("blob")
            .agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done")))
    blobs = (docs.select(blob_name(text).alias("blob"), whole(F.col(text)).alias("text"))
             .groupBy("blob").agg(F.first("text").alias("text")))
    unseen = (blobs.join(seen, "blob", "left")
              .withColumn("todo", F.array_except(wanted, F.coalesce(
                  "done", F.array().cast("array<string>"))))
              .where(F.size("todo") > 0))
    _scan(unseen, rules).write.mode("append").parquet(ledger)
    order = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))))
    current = F.filter(F.flatten(F.collect_list("spans")), lambda s: F.array_contains(wanted, s["rule"]))
    findings = (read_ledger(spark, ledger).groupBy("blob").agg(current.alias("s"))
                .select("blob", F.transform(F.array_sort(F.transform("s", lambda s: F.struct(
                    s["start"], order[s["rule"]], s["stop"], s["rule"]))), lambda s: F.struct(
                        s["rule"].alias("rule"), s["start"].alias("start"),
                        s["stop"].alias("stop"))).alias("spans")))
    own = [c for c in docs.columns if c.lower() not in ("blob", "spans") or c == text]
    return (docs.select(*[F.col(f"`{c}`") for c in own], blob_name(text).alias("blob"))
            .join(findings, "blob", "left"))


def span_text(spans, kinds: list[str] | None = None):
    """``kind:start:end`` comma-joined, of all spans or of some kinds."""
    kept = spans if kinds is None else F.filter(
        spans, lambda s: F.split_part(s["rule"], F.lit("@"), F.lit(1)).isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(
        ":", F.split_part(s["rule"], F.lit("@"), F.lit(1)), s["start"], s["stop"])), ",")


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["rule"].startswith(kind + "@"))).cast("bigint")


def mask_secrets(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE_RULES,
                 text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span (overlaps merged) replaced by ``mask``.

    All columns and rows stay, whatever their names; only ``text`` changes, and a null text stays
    null.  Repeated rows are masked alike; an empty table stays empty.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(text).alias("text"))
    found = scan_versions(rows, ledger, rules, "text")
    # merged spans in order: pieces of text between them, then joined by the mask
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    t = F.col("text")
    step = lambda a, s: F.when(s["stop"] < a["at"], a).otherwise(F.struct(
        F.greatest(s["stop"] + 1, a["at"]).alias("at"),
        F.when(s["start"] + 1 < a["at"], a["out"]).otherwise(F.concat(
            a["out"], F.substring(t, a["at"], s["start"] + 1 - a["at"]), F.lit(mask))).alias("out")))
    done = F.aggregate("spans", start, step, lambda a: F.concat(
        a["out"], F.substring(t, a["at"], F.length(t))))
    masked = F.when(F.size("spans") > 0, barrier(done)).otherwise(t)
    return found.select("row", masked.alias("text")).select(*[
        F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
