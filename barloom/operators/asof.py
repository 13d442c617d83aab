"""Point-in-time lookups of filings: what was known on a given day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.filings import period_index

# Fixed value: how many quarters back a profit streak is counted.
STREAK_LIMIT = 8


def _payload(filings: DataFrame, columns: list[str] | None) -> list[str]:
    skip = {"code", "year", "quarter", "disclosed_at"}
    return [c for c in (columns or filings.columns) if c not in skip]


def as_of(probes: DataFrame, filings: DataFrame, date: str = "date",
          columns: list[str] | None = None, prefix: str = "") -> DataFrame:
    """For every probe (code, date): the newest fiscal period disclosed on or before the date.

    Ties on the period go to the latest disclosure; rows without a disclosure date are never
    visible.  One union and one running ``max(struct)`` per symbol: a single exchange on
    ``code`` and linear work, instead of a range join that pairs each probe with every
    earlier filing.
    """
    cols = _payload(filings, columns)
    filing = F.struct("year", "quarter", "disclosed_at", *cols)
    keep = probes.columns
    none = F.lit(None)
    left = filings.where(F.col("disclosed_at").isNotNull()).select(
        "code", F.col("disclosed_at").alias("_at"), F.lit(0).alias("_side"),
        filing.alias("_filing"), none.cast(probes.select(F.struct(*keep)).schema[0].dataType)
        .alias("_probe"))
    right = probes.select(
        "code", F.col(date).alias("_at"), F.lit(1).alias("_side"),
        none.cast(left.schema["_filing"].dataType).alias("_filing"),
        F.struct(*keep).alias("_probe"))
    w = (Window.partitionBy("code").orderBy("_at", "_side")
         .rowsBetween(Window.unboundedPreceding, 0))
    seen = left.unionByName(right).withColumn("_seen", F.max("_filing").over(w))
    return (seen.where("_side = 1").select(
        *[F.col(f"_probe.{c}").alias(c) for c in keep],
        *[F.col(f"_seen.{c}").alias(prefix + c) for c in
          ["year", "quarter", "disclosed_at", *cols]]))


def as_of_range_join(probes: DataFrame, filings: DataFrame, date: str = "date",
                     columns: list[str] | None = None) -> DataFrame:
    """The same result from an aggregated range join; kept as the differential check."""
    cols = _payload(filings, columns)
    f = filings.select(F.col("code").alias("_code"), F.struct(
        "year", "quarter", "disclosed_at", *cols).alias("_filing"))
    joined = probes.join(f, (F.col("code") == F.col("_code"))
                         & (F.col("_filing.disclosed_at") <= F.col(date)), "left")
    best = joined.groupBy(*probes.columns).agg(F.max("_filing").alias("_seen"))
    return best.select(*probes.columns, *[F.col(f"_seen.{c}").alias(c) for c in
                                          ["year", "quarter", "disclosed_at", *cols]])


def as_of_panel(filings: DataFrame, date, codes: DataFrame | None = None,
                columns: list[str] | None = None) -> DataFrame:
    """One row per symbol as known on one date; symbols without a filing are absent."""
    seen = filings.where(F.col("disclosed_at") <= F.lit(date).cast("date"))
    if codes is not None:
        seen = seen.join(codes.select("code").distinct(), "code", "left_semi")
    cols = _payload(filings, columns)
    best = seen.groupBy("code").agg(
        F.max(F.struct("year", "quarter", "disclosed_at", *cols)).alias("f"))
    return best.select("code", "f.*")


def profit_streaks(filings: DataFrame, value: str = "op_income_quarter",
                   limit: int = STREAK_LIMIT) -> DataFrame:
    """Profit streak after every disclosure: (code, disclosed_at, profit_quarters).

    The streak only changes when something is disclosed, so it is computed once per
    disclosure day instead of once per probe: the filings known on that day are kept as a map
    period -> value (latest disclosure wins) and walked back from the newest period.  The map
    only needs the last ``limit`` periods, and a symbol files four times a year.
    """
    p = period_index()
    known = filings.where(F.col("disclosed_at").isNotNull() & p.isNotNull()).select(
        "code", "disclosed_at", F.struct(
            p.alias("p"), F.col("disclosed_at").alias("at"), F.col(value).alias("v")).alias("f"))
    upto = (Window.partitionBy("code").orderBy("disclosed_at")
            .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    seen = known.select("code", "disclosed_at", F.max("f.p").over(upto).alias("top"),
                        F.collect_list("f").over(upto).alias("fs")).dropDuplicates(
        ["code", "disclosed_at"])
    # newest period first, of a period the latest disclosure first: one walk finds the streak
    recent = F.sort_array(F.filter("fs", lambda f: f["p"] > F.col("top") - limit), asc=False)
    walk = """aggregate(_fs, named_struct('next', top, 'n', 0, 'open', true),
        (s, f) -> IF(NOT s.open OR f.p > s.next, s, IF(f.p = s.next AND coalesce(f.v > 0, false),
            named_struct('next', s.next - 1, 'n', s.n + 1, 'open', true),
            named_struct('next', s.next, 'n', s.n, 'open', false))), s -> s.n)"""
    return (seen.select("code", "disclosed_at", "top", recent.alias("_fs")).select(
        "code", "disclosed_at",
        F.expr(f"IF(_fs[0].v IS NOT NULL, {walk}, NULL)").cast("int").alias("profit_quarters")))


def consecutive_profit_quarters(probes: DataFrame, filings: DataFrame, date: str = "date",
                                limit: int = STREAK_LIMIT) -> DataFrame:
    """Streak known at every probe date: the one of the last disclosure on or before it."""
    steps = profit_streaks(filings, limit=limit)
    keep = probes.columns
    at = F.col(date)
    left = steps.select("code", F.col("disclosed_at").alias("_at"), F.lit(0).alias("_side"),
                        F.struct("disclosed_at", "profit_quarters").alias("_s"),
                        F.lit(None).cast(probes.select(F.struct(*keep)).schema[0].dataType)
                        .alias("_probe"))
    right = probes.select("code", at.alias("_at"), F.lit(1).alias("_side"),
                          F.lit(None).cast(left.schema["_s"].dataType).alias("_s"),
                          F.struct(*keep).alias("_probe"))
    w = (Window.partitionBy("code").orderBy("_at", "_side")
         .rowsBetween(Window.unboundedPreceding, 0))
    return (left.unionByName(right).withColumn("_s", F.max("_s").over(w)).where("_side = 1")
            .select(*[F.col(f"_probe.{c}").alias(c) for c in keep],
                    F.col("_s.profit_quarters").alias("profit_quarters")))


def first_day_on_or_after(dates: DataFrame, cal: DataFrame, date: str = "date") -> DataFrame:
    """Forward as-of: index of the first trading day on or after each date.

    The calendar is a date -> index step function; it is unrolled to every civil day (bounded
    by the calendar span) and joined on equality, so no range join is needed.
    """
    w = Window.orderBy("date")
    steps = cal.select(F.date_add(F.coalesce(F.lag("date").over(w), F.date_sub("date", 1)), 1)
                       .alias("_from"), F.col("date").alias("_to"), "day_idx")
    days = steps.select(F.explode(F.sequence("_from", "_to")).alias("_day"), "day_idx")
    # any earlier date maps to the first trading day
    first = cal.agg(F.min("date").alias("_first"), F.min("day_idx").alias("_first_idx"))
    out = dates.join(F.broadcast(days), F.col(date) == F.col("_day"), "left").crossJoin(
        F.broadcast(first))
    return out.withColumn("day_idx", F.when(F.col(date) < F.col("_first"), F.col("_first_idx"))
                          .otherwise(F.col("day_idx"))).drop("_day", "_first", "_first_idx")
