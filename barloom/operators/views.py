"""Chart, search and ledger views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import symbol_window

# Default and largest number of search results.
SEARCH_DEFAULT = 50
# Fixed value: margin of the price axis on either side.
AXIS_PADDING = 0.06


def chart_arrays(bars: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per symbol with parallel arrays, sorted by date; halted prices become NULL.

    Arrays hold one element per trading day, which bounds a row.
    """
    fields = {k: F.when(~F.col("halted"), F.col(c)) if c in ("open", "high", "low", "close")
              else F.col(c) for k, c in columns.items()}
    row = F.struct(F.date_format("date", "yyyyMMdd").cast("int").alias("t"),
                   *[c.alias(k) for k, c in fields.items()])
    packed = bars.groupBy("code").agg(F.sort_array(F.collect_list(row)).alias("_r"))
    return packed.select("code", *[F.expr(f"transform(_r, x -> x.`{k}`)").alias(k)
                                   for k in ("t", *columns)])


def downsample(bars: DataFrame, columns: int) -> DataFrame:
    """OHLC per pixel column: bar i of n goes to bucket floor(i * columns / n).

    Halted bars keep their place but give no price.  Two aggregations; the bar number comes
    from the shared per-symbol window.
    """
    w = symbol_window()
    n = F.count(F.lit(1)).over(Window.partitionBy("code"))
    b = bars.withColumn("bucket", F.floor((F.row_number().over(w) - 1) * columns / n)
                        .cast("int")).where(~F.col("halted"))
    out = b.groupBy("code", "bucket").agg(
        F.min("date").alias("first_date"), F.min_by("open", "date").alias("open"),
        F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"), F.max("amount").alias("amount"))
    return out.withColumn("up", F.col("close") >= F.col("open"))


def price_range(bars: DataFrame, overlays: list[str] = ()) -> DataFrame:
    """Lowest and highest value on screen per symbol, padded."""
    live = bars.where(~F.col("halted"))
    low = F.min(F.least("low", *overlays) if overlays else F.col("low"))
    high = F.max(F.greatest("high", *overlays) if overlays else F.col("high"))
    pad = (F.col("hi") - F.col("lo")) * AXIS_PADDING
    return (live.groupBy("code").agg(low.alias("lo"), high.alias("hi"))
            .select("code", (F.col("lo") - pad).alias("axis_low"),
                    (F.col("hi") + pad).alias("axis_high")))


def search_rank(query: str) -> Column:
    """0 code equal, 1 name equal, 2 name prefix, 3 code prefix, 4 name part, 5 code part."""
    q = query.strip().upper()
    code, name = F.upper("code"), F.upper("name")
    return (F.when(code == q, 0).when(name == q, 1).when(name.startswith(q), 2)
            .when(code.startswith(q), 3).when(name.contains(q), 4).when(code.contains(q), 5))


def search_symbols(snapshot: DataFrame, query: str = "", limit: int = SEARCH_DEFAULT) -> DataFrame:
    """Best matches first; an empty query lists the largest symbols.

    ``total`` counts all matches.  The top rows come from a bounded sort, the total from an
    aggregation, so no global window is needed.
    """
    limit = max(1, int(limit))
    size = F.col("marcap_eok")
    if not query.strip():
        ranked = snapshot.withColumn("rank", F.lit(0))
        order = [size.desc_nulls_last(), F.col("code")]
    else:
        ranked = snapshot.withColumn("rank", search_rank(query)).where(F.col("rank").isNotNull())
        order = [F.col("rank"), F.coalesce(size, F.lit(0)).desc(), F.col("code")]
    total = ranked.agg(F.count(F.lit(1)).alias("total"))
    return ranked.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))


def symbols_by_size(snapshot: DataFrame) -> DataFrame:
    return snapshot.orderBy(F.col("marcap_eok").desc_nulls_last(), "code")


def default_symbol(snapshot: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """First traded symbol of a run, else the largest one."""
    largest = symbols_by_size(snapshot).limit(1).select("code", F.lit(1).alias("o"))
    if ledger is None:
        return largest.select("code")
    first = (ledger.orderBy("exit_date", "code").limit(1)
             .select("code", F.lit(0).alias("o")))
    return first.unionByName(largest).orderBy("o").limit(1).select("code")


def top_contributors(by_stock: DataFrame, n: int = 12) -> DataFrame:
    return by_stock.orderBy(F.desc("pnl"), "code").limit(n)


def group_sorted(ledger: DataFrame, key: str = "pnl", descending: bool = True) -> DataFrame:
    """Sort whole trade groups; the parts of a group stay together in their own order."""
    parts = Window.partitionBy("group_id")
    value = (F.sum("pnl").over(parts) if key == "pnl"
             else F.first(key).over(parts.orderBy("part").rowsBetween(
                 Window.unboundedPreceding, Window.unboundedFollowing)))
    rep = F.col("rep").desc() if descending else F.col("rep").asc()
    return ledger.withColumn("rep", value).orderBy(rep, "group_id", "part")


def last_per_symbol(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Newest ``n`` rows of every symbol."""
    w = Window.partitionBy("code").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def prepend_history(older: DataFrame, current: DataFrame) -> DataFrame:
    """Older chunk in front of the current one; where they overlap the current rows count."""
    start = current.groupBy("code").agg(F.min("date").alias("_from"))
    kept = older.join(start, "code", "left").where(
        F.col("_from").isNull() | (F.col("date") < F.col("_from"))).drop("_from")
    return kept.unionByName(current, allowMissingColumns=True)


def holding_bars(bars: DataFrame, ledger: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Bars of every holding period.

    A sweep per symbol: trades stand at their first day, and every bar carries the trades that
    are open on it.  One position is open at a time (its parts end on different days), so what
    is carried is the newest group's parts, at most one per exit rule; each bar is unrolled over
    those that have not ended.  Work follows the bars and the output, not the days.
    """
    parts = ledger.groupBy("code", "group_id").agg(
        F.min("entry_date").alias("date"),
        F.collect_list(F.struct("part", "entry_date", "exit_date", *carry)).alias("_parts"))
    names = [c for c in bars.columns if c not in ("code", "date")]
    row = F.struct(*names)
    left = parts.select("code", "date", F.lit(0).alias("_side"),
                        F.struct("date", "group_id", "_parts").alias("_group"),
                        F.lit(None).cast(bars.select(row).schema[0].dataType).alias("_bar"))
    right = bars.select("code", "date", F.lit(1), F.lit(None).cast(left.schema["_group"].dataType),
                        row)
    so_far = (Window.partitionBy("code").orderBy("date", "_side")
              .rowsBetween(Window.unboundedPreceding, 0))
    open_ = left.union(right).withColumn("_group", F.last("_group", ignorenulls=True).over(so_far))
    held = (open_.where("_side = 1").select("code", "date", "_group.group_id", "_bar.*",
                                            F.explode("_group._parts").alias("_p"))
            .where(F.col("date") <= F.col("_p.exit_date")))
    return held.select("code", "date", "group_id", "_p.*", *names)


def trade_markers(bars: DataFrame, ledger: DataFrame) -> DataFrame:
    """Reference, fill and exit marks of trades on the bar index of their symbol.

    A position that the end of the run closes is marked on the symbol's last bar.
    """
    first = ledger.where("part = 1")
    ref = first.select("code", "group_id", F.col("ref_date").alias("date"),
                       F.lit("reference").alias("mark"), F.col("ref_open").alias("price"))
    fills = ledger.groupBy("code", "group_id").agg(F.max_by("fills", "part").alias("fills"))
    buy = fills.select("code", "group_id", F.explode("fills").alias("f")).select(
        "code", "group_id", F.col("f.date").alias("date"), F.lit("buy").alias("mark"),
        F.col("f.price").alias("price"))
    last = bars.groupBy("code").agg(F.max("date").alias("_last"))
    sell = ledger.join(last, "code").select(
        "code", "group_id", F.least("exit_date", "_last").alias("date"), F.lit("sell").alias("mark"),
        F.col("exit_price").alias("price"))
    marks = ref.unionByName(buy).unionByName(sell)
    return marks.join(bars.select("code", "date", "idx"), ["code", "date"])


def holding_bands(bars: DataFrame, ledger: DataFrame) -> DataFrame:
    """First-fill index to exit index (or the last bar) of every position."""
    marks = trade_markers(bars, ledger)
    return marks.where("mark <> 'reference'").groupBy("code", "group_id").agg(
        F.min(F.when(F.col("mark") == "buy", F.col("idx"))).alias("from_idx"),
        F.max("idx").alias("to_idx"))
