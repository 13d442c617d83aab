"""Signal-to-trade matching as joins and windows, independently per symbol.

Every symbol trades with a fixed notional per position; no cash or slot is shared.  The
building block is :func:`first_crossing`: the first bar from a start bar on where a price
crosses a level, for any number of (start, level) probes, without pairing probes with all
later bars.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import symbol_window
from ..functions.predicates import known, reference_gate
from ..sources.bars import with_day_index
from ..sources.staging import stage
from .crossing import KINDS, crossings, probe

HIT_PRICES = ("open", "high", "low", "close", "next_open", "next_date")


def index_bars(bars: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """Adds ``idx`` (bar number of the symbol), ``day_idx`` (trading day number) and the next
    bar's open and date.

    ``cal`` (date, day_idx) is the calendar of the market; by default the days of ``bars``.
    A reference expires by trading days, whether or not its symbol traded on them.
    """
    w = symbol_window()
    out = bars.withColumns({"idx": F.row_number().over(w), "next_open": F.lead("open").over(w),
                            "next_date": F.lead("date").over(w)})
    return with_day_index(out, cal)


def active_reference(bars: DataFrame, valid_days: int = 60,
                     fields: tuple[str, ...] = ("date", "idx", "day_idx", "open", "high", "low",
                                                "close", "volume", "amount")) -> DataFrame:
    """Live bars that watch a reference: the last event strictly before the bar, still valid.

    A bar that is itself an event replaces the reference, so it never watches one.
    """
    before = symbol_window().rowsBetween(Window.unboundedPreceding, -1)
    ref = F.last(F.when(F.col("is_event"), F.struct(*fields)), ignorenulls=True).over(before)
    return bars.withColumn("ref", ref).where(
        F.col("ref").isNotNull() & ~F.col("halted") & ~F.col("is_event")
        & (F.col("day_idx") - F.col("ref.day_idx") <= valid_days))


def touch_price(target: Column, direction: str, open_: Column | None = None, at=F.col) -> Column:
    """Fill at the target, at the open when the bar opened beyond it; no target: the close.

    ``at`` gives the bar's prices by name.
    """
    o = open_ if open_ is not None else at("open")
    beyond = o <= target if direction == "down" else o >= target
    inside = F.least(F.greatest(target, at("low")), at("high"))
    return F.when(target.isNull(), at("close")).when(beyond, o).otherwise(inside)


# ------------------------------------------------------------------ first crossing


def first_crossing(bars: DataFrame, probes: DataFrame, trailing: bool = False) -> DataFrame:
    """First live bar in [start_idx, end_idx] where a price condition holds.

    ``probes``: code, probe (unique within the code), kind, level, start_idx, end_idx and, for
    ``trailing`` searches, peak_idx.  Kinds: ``up`` (high >= level), ``down`` (low <= level)
    and ``trail`` (low <= level x highest high since ``peak_idx``).  Returns code, probe,
    hit_idx, the level at the hit and the prices of the hit bar; probes that never cross are
    absent.

    Bars and probes meet once, on the symbol (:mod:`.crossing`): probes never meet all later
    bars as rows, and the answer is exact without any horizon.
    """
    kind = F.when(F.col("kind") == "up", KINDS["up"])
    if trailing:
        kind = kind.when(F.col("kind") == "trail", KINDS["trail"])
    asked = probe(kind.otherwise(KINDS["down"]), F.col("level"), F.col("start_idx"), F.col("end_idx"),
                  F.col("peak_idx") if trailing else None)
    rows = (probes.where(F.col("level").isNotNull() & (F.col("start_idx") <= F.col("end_idx")))
            .select("code", "probe", F.array(asked).alias("probes")))
    return (crossings(bars, rows, HIT_PRICES).select("code", "probe", F.get("hits", F.lit(0)).alias("hit"))
            .where(F.col("hit").isNotNull()).select("code", "probe", "hit.*"))


# ------------------------------------------------------------------ rules


@dataclass(frozen=True)
class Entry:
    """One buy rule.

    ``when`` is a bar condition that may use the watched reference as ``ref.<field>``;
    ``target`` the price aimed at (NULL or None: the close).

    Further rules (a ladder) wait for the fills of the rules they ``requires`` - any of the
    plan's other rules, by default the one before.  Such a rule has either ``drop_pct``: it buys
    once the price is that far below the fill of ``drop_from`` (by default the last rule it
    requires), or ``when``: the first bar on which that condition holds, bought at ``target``;
    both use columns of the bar only.
    """

    id: str
    when: Column | None = None
    target: Column | None = None
    drop_pct: float | None = None
    size_pct: float = 100.0
    requires: tuple[str, ...] | None = None
    drop_from: str | None = None


@dataclass(frozen=True)
class Exit:
    """One sell rule, by kind:

    ``take_profit`` / ``stop_loss``: price ``pct`` above / below the average cost;
    ``trailing_stop``: ``pct`` below the highest high since entry; ``time_exit``: ``bars``
    held; ``condition``: a boolean bar column ``flag`` with an optional price column
    ``target`` met in ``direction``.
    """

    id: str
    kind: str
    pct: float | None = None
    bars: int | None = None
    flag: str | None = None
    target: str | None = None
    direction: str = "down"
    size_pct: float = 100.0


@dataclass(frozen=True)
class Plan:
    """Rules and costs of a run.

    Of several exits on one bar the one named first in ``priority`` sells first; rules that it
    does not name follow in the order of ``exits``.
    """

    entries: tuple[Entry, ...]
    exits: tuple[Exit, ...]
    gate: str | None = None
    pullback_pct: float | None = None
    valid_days: int = 60
    fill: str = "touch"              # touch | close | next_open
    same_day_exit: str = "loss_only"  # always | never | loss_only
    notional: float = 10_000_000.0
    fixed_qty: int | None = None
    slippage: float = 0.001
    fee: float = 0.0023
    priority: tuple[str, ...] = ()

    def __post_init__(self):
        rank = {name: n for n, name in reversed(list(enumerate(self.priority)))}
        ordered = sorted(self.exits, key=lambda e: rank.get(e.id, len(rank)))  # stable
        object.__setattr__(self, "exits", tuple(ordered))

    def ladder(self) -> list[tuple[int, list[int], int]]:
        """(rule, rules it requires, rule its drop is measured from), required rules first."""
        place = {e.id: n for n, e in enumerate(self.entries)}
        waits = {}
        for n, rule in list(enumerate(self.entries))[1:]:
            names = rule.requires if rule.requires else (self.entries[n - 1].id,)
            if (rule.drop_pct is None) == (rule.when is None):
                raise ValueError(f"rule {rule.id} needs either a drop or a condition")
            start = rule.drop_from or names[-1]
            if unknown := {*names, start} - {*place} | {*names, start} & {rule.id}:
                raise ValueError(f"rule {rule.id} cannot require {sorted(unknown)}")
            waits[n] = sorted({place[x] for x in names} | {place[start]}), place[start]
        out, done = [], {0}
        while waits:
            ready = [n for n, (needs, _) in waits.items() if done.issuperset(needs)]
            if not ready:
                raise ValueError("rules require each other")
            for n in ready:
                out.append((n, *waits.pop(n)))
                done.add(n)
        return out


def _quantity(plan: Plan, price: Column, size_pct: float) -> Column:
    share = size_pct / 100.0
    if plan.fixed_qty is not None:
        return F.lit(int(plan.fixed_qty * share)).cast("bigint")
    return F.floor(F.try_divide(F.lit(plan.notional * share), price)).cast("bigint")


def entry_candidates(bars: DataFrame, plan: Plan) -> DataFrame:
    """First fill per watched reference: the first live bar where gate and condition hold.

    ``bars`` needs code, date, idx, day_idx, prices, halted and is_event.
    """
    first = plan.entries[0]
    watched = active_reference(bars, plan.valid_days)
    gate = reference_gate(plan.gate, pullback_pct=plan.pullback_pct, probe=plan.fill)
    when = known(first.when) if first.when is not None else F.lit(True)
    price = _entry_price(plan, first.target)
    hits = (watched.where(gate & when).withColumn("px", price)
            .withColumn("qty", _quantity(plan, _paid(plan, F.col("px")), first.size_pct))
            .where((F.col("px") > 0) & (F.col("qty") > 0)))
    hit = F.struct(_fill_idx(plan).alias("idx"), _fill_date(plan).alias("date"), "px", "qty", "ref")
    return (hits.groupBy("code", F.col("ref.idx").alias("ref_idx"))
            .agg(F.min_by(hit, "idx").alias("e"))
            .select("code", "ref_idx", F.col("e.ref").alias("ref"),
                    F.col("e.idx").alias("idx0"), F.col("e.date").alias("date0"),
                    F.col("e.px").alias("px0"), F.col("e.qty").alias("qty0")))


def ladder_fills(bars: DataFrame, trades: DataFrame, plan: Plan) -> DataFrame:
    """Adds idx/date/px/qty/rule of all fills, numbered in the order in which they happen.

    A further rule watches from the latest fill of the rules it requires on - that bar itself
    too, unless a rule that comes later in the plan was filled there.  Drops are looked up by
    :func:`first_crossing`, conditions in a next-true-bar index; no fill meets all later bars.
    """
    out = trades
    for k, needs, base in plan.ladder():
        rule = plan.entries[k]
        filled = reduce(lambda a, b: a & b, [F.col(f"idx{r}").isNotNull() for r in needs])
        starts = [F.col(f"idx{r}") + (1 if r > k else 0) for r in needs]
        start = F.greatest(*starts) if len(starts) > 1 else starts[0]
        level = F.col(f"px{base}") * (1.0 + (rule.drop_pct or 0.0) / 100.0)
        probes = out.where(filled).select(
            "code", F.col("ref_idx").alias("probe"), F.lit("down").alias("kind"),
            level.alias("level"), start.alias("start_idx"), F.lit(2 ** 31 - 1).alias("end_idx"))
        usable = _sellable(bars, plan)
        hit = (first_crossing(usable, probes) if rule.drop_pct is not None
               else _next_true(usable, probes, rule, plan))
        hit = hit.withColumns({"idx": F.col("hit_idx"), "date": F.col("hit_date")})
        price = _entry_price(plan, F.col("target") if rule.drop_pct is not None or
                             rule.target is not None else None)
        hit = hit.withColumn("px", price)
        hit = hit.select("code", F.col("probe").alias("ref_idx"),
                         _fill_idx(plan).alias(f"idx{k}"), _fill_date(plan).alias(f"date{k}"),
                         F.col("px").alias(f"px{k}"),
                         _quantity(plan, _paid(plan, F.col("px")), rule.size_pct).alias(f"qty{k}"))
        hit = hit.where((F.col(f"px{k}") > 0) & (F.col(f"qty{k}") > 0))
        out = stage(out.join(hit, ["code", "ref_idx"], "left"), f"fill{k}")
    names = ("idx", "date", "px", "qty")
    fills = F.array_sort(F.filter(F.array(*[
        F.struct(F.col(f"idx{k}").alias("idx"), F.lit(k).alias("rule"),
                 *[F.col(f"{c}{k}").alias(c) for c in names[1:]])
        for k in range(len(plan.entries))]), lambda f: f["idx"].isNotNull()))
    kept = [c for c in out.columns if c.rstrip("0123456789") not in names or c == "ref_idx"]
    return out.select(*kept, fills.alias("_f")).select(*kept, *[
        F.get("_f", F.lit(k))[c].alias(f"{c}{k}") for k in range(len(plan.entries))
        for c in (*names, "rule")])


def _next_true(bars: DataFrame, probes: DataFrame, rule: Entry, plan: Plan) -> DataFrame:
    """First live bar from the start bar on where the rule's condition holds, if any."""
    target = rule.target if rule.target is not None else F.lit(None)
    hits = _next_flagged(bars, probes, {"hit": (known(rule.when), target)})
    return hits.where(F.col("hit").isNotNull()).select("code", "probe", "hit.*")


def _next_flagged(bars: DataFrame, probes: DataFrame,
                  flags: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds to every probe (code, start_idx) one column per flag: the first live bar from the
    start bar on where the flag holds.

    Flags are (boolean, target price) columns of the bars.  Only bars with a flag are moved, in
    one union with the probes: the next one is a running minimum over descending bars, so no
    probe joins the whole table.
    """
    def at(holds: Column, target: Column) -> Column:
        bar = F.struct(F.col("idx").alias("hit_idx"), F.col("date").alias("hit_date"),
                       target.cast("double").alias("target"), *HIT_PRICES)
        return F.when(holds & ~F.col("halted"), bar)

    marks = bars.select("code", F.col("idx").alias("_at"), F.lit(0).alias("_side"),
                        *[at(*f).alias(n) for n, f in flags.items()])
    marks = marks.where(reduce(lambda p, q: p | q, [F.col(n).isNotNull() for n in flags]))
    row = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    asks = probes.select("code", F.col("start_idx").alias("_at"), F.lit(1).alias("_side"),
                         *[F.lit(None).cast(marks.schema[n].dataType).alias(n) for n in flags],
                         row.alias("_probe"))
    marks = marks.withColumn("_probe", F.lit(None).cast(asks.schema["_probe"].dataType))
    # a bar comes before the probes that start on it
    down = (Window.partitionBy("code").orderBy(F.desc("_at"), "_side")
            .rowsBetween(Window.unboundedPreceding, 0))
    return (marks.unionByName(asks)
            .withColumns({n: F.min(n).over(down) for n in flags})
            .where("_side = 1").select("_probe.*", *flags))


def _sellable(bars: DataFrame, plan: Plan) -> DataFrame:
    """Bars on which an order can be filled: an order for the next open needs one."""
    return bars.where(F.col("next_open") > 0) if plan.fill == "next_open" else bars


def _paid(plan: Plan, px: Column) -> Column:
    return px * (1.0 + plan.slippage)


def _entry_price(plan: Plan, target: Column | None) -> Column:
    if plan.fill == "next_open":
        return F.col("next_open")
    if plan.fill == "close" or target is None:
        return F.col("close")
    return touch_price(target, "down")


def _fill_idx(plan: Plan) -> Column:
    """A fill at the next open belongs to the next bar."""
    return F.col("idx") + 1 if plan.fill == "next_open" else F.col("idx")


def _fill_date(plan: Plan) -> Column:
    return F.col("next_date") if plan.fill == "next_open" else F.col("date")


# ------------------------------------------------------------------ exits


def _exit_price(plan: Plan, rule: Exit, at=F.col) -> Column:
    if rule.kind == "time_exit":
        return at("close")
    if rule.kind == "trailing_stop":
        return touch_price(at("target"), "down", at=at)
    if plan.fill == "close":
        return at("close")
    if plan.fill == "next_open":
        return at("next_open")
    if rule.kind == "condition" and rule.target is None:
        return at("close")
    direction = {"take_profit": "up", "stop_loss": "down"}.get(rule.kind, rule.direction)
    return touch_price(at("target"), direction, at=at)


def _exit_level(rule: Exit) -> tuple[str, Column]:
    """The kind of a levelled rule's search and its level, from a position's ``avg``."""
    if rule.kind == "take_profit":
        return "up", F.col("avg") * (1.0 + rule.pct / 100.0)
    if rule.kind == "stop_loss":
        return "down", F.col("avg") * (1.0 - rule.pct / 100.0)
    if rule.kind == "trailing_stop":
        return "trail", F.lit(1.0 - rule.pct / 100.0)
    # time exit: any live bar is low enough; only the start bar matters
    return "down", F.lit(float("inf"))


def _spans(plan: Plan) -> list[tuple[bool, Column, Column]]:
    """(same day, first bar, last bar) of the searches in a segment.

    The bar of the latest fill is probed apart from the later ones, because a sale on it depends
    on the same-day policy and on its own net result.
    """
    at_close = plan.fill == "close" or (plan.fill != "next_open"
                                        and plan.entries[0].target is None)
    out = [(False, F.col("seg_start") + 1, F.col("seg_end"))]
    if not at_close and plan.same_day_exit != "never":
        out.insert(0, (True, F.col("seg_start"), F.least("seg_start", "seg_end")))
    return out


def _sale(plan: Plan, n: int, same_day: bool, at) -> Column:
    """The hit of a rule as (hit_idx, rule, exit_date, px); NULL where it sells nothing."""
    rule = plan.exits[n]
    px = _exit_price(plan, rule, at)
    own_day = plan.fill != "next_open" or rule.kind in ("time_exit", "trailing_stop")
    usable = px > 0
    if same_day and plan.same_day_exit == "loss_only":
        usable = usable & (px * (1.0 - plan.slippage) * (1.0 - plan.fee) - F.col("avg") <= 0)
    return F.when(usable, F.struct(
        at("hit_idx").alias("hit_idx"), F.lit(n).alias("rule"),
        at("hit_date" if own_day else "next_date").alias("exit_date"), px.alias("px")))


def _condition_sales(bars: DataFrame, segments: DataFrame, rules: list[tuple[int, Exit]],
                     plan: Plan) -> DataFrame:
    """(code, ref_idx, hits): the first usable bar of every rule with a flag, one in a row."""
    flags = {}
    for n, rule in rules:
        holds = known(F.col(rule.flag))
        if plan.fill == "next_open":
            holds = holds & known(F.col("next_open") > 0)
        flags[f"next_{n}"] = (holds, F.col(rule.target) if rule.target else F.lit(None))
    spans = F.array(*[F.struct(F.lit(same).alias("same_day"), start.alias("start_idx"),
                               end.alias("end_idx")) for same, start, end in _spans(plan)])
    asks = segments.select("code", "ref_idx", "avg", "done", F.inline(spans)).where("start_idx <= end_idx")
    hit = _next_flagged(bars, asks, flags)
    sales = []
    for n, _ in rules:
        at = lambda c, n=n: F.col(f"next_{n}.{c}")
        open_ = ~F.array_contains("done", F.lit(n)) & (at("hit_idx") <= F.col("end_idx"))
        sales += [F.when(open_ & (F.col("same_day") == same), _sale(plan, n, same, at))
                  for same in (True, False)]
    found = hit.select("code", "ref_idx", F.explode(F.array(*sales)).alias("h")).where("h IS NOT NULL")
    return (found.groupBy("code", "ref_idx", "h.rule").agg(F.min("h").alias("h"))
            .select("code", "ref_idx", F.array("h").alias("hits")))


def exit_hits(bars: DataFrame, open_trades: DataFrame, plan: Plan) -> DataFrame:
    """(code, ref_idx, hits): every exit rule's first usable hit inside the segment of a position,
    (hit_idx, rule, exit_date, px) in the order of bars and priority.  Rules without one are NULL
    and come first.

    ``open_trades``: code, ref_idx, seg_start, seg_end, entry_idx, avg, done.  Positions and bars
    meet once for all rules, so no position becomes several rows.
    """
    rules = list(enumerate(plan.exits))
    flagged = [(n, r) for n, r in rules if r.kind == "condition"]
    # trailing stops and time exits never wait for the next open
    own_price = [n for n, r in rules if r.kind in ("trailing_stop", "time_exit")]
    priced = [n for n, r in rules if r.kind in ("take_profit", "stop_loss")]
    waits = plan.fill == "next_open"
    groups = [(bars, own_price), (_sellable(bars, plan), priced)] if waits else [(bars, own_price + priced)]
    prices = tuple(c for c in HIT_PRICES if waits or not c.startswith("next_"))
    parts = []
    for usable, numbers in groups:
        if not numbers:
            continue
        probes, sales = [], []
        for n in numbers:
            kind, level = _exit_level(plan.exits[n])
            either = []
            for same_day, start, end in _spans(plan):
                if plan.exits[n].kind == "time_exit":
                    start = F.greatest(start, F.col("entry_idx") + plan.exits[n].bars)
                either.append(_sale(plan, n, same_day, lambda c, k=len(probes): F.get("hits", F.lit(k))[c]))
                open_ = ~F.array_contains("done", F.lit(n)) & (start <= end)
                probes.append(probe(F.lit(KINDS[kind]), F.when(open_, level), start, end,
                                    F.col("entry_idx") if kind == "trail" else None))
            sales.append(F.coalesce(*either))
        rows = open_trades.select("code", "ref_idx", "avg", F.array(*probes).alias("probes"))
        parts.append(crossings(usable, rows, prices).select(
            "code", "ref_idx", F.sort_array(F.array(*sales)).alias("hits")))
    if flagged:
        parts.append(_condition_sales(bars, open_trades, flagged, plan))
    if len(parts) == 1 and not flagged:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy("code", "ref_idx").agg(
        F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))


def _sell(plan: Plan) -> str:
    """SQL fold over the hits of a segment in (bar, priority) order: each rule sells its share
    of what is still held."""
    shares = ", ".join(f"{r.size_pct / 100.0!r}D" for r in plan.exits)
    sold = f"""IF(element_at(array({shares}), h.rule + 1) >= 1D, s.qty,
        CAST(floor(s.qty * element_at(array({shares}), h.rule + 1)) AS BIGINT))"""
    return f"""aggregate(hits, named_struct('qty', qty, 'out', CAST(array() AS
        ARRAY<STRUCT<rule: INT, idx: INT, date: DATE, px: DOUBLE, qty: BIGINT, avg: DOUBLE,
                     fills: INT>>)),
        (s, h) -> IF(h IS NULL OR {sold} <= 0, s, named_struct('qty', s.qty - {sold}, 'out', concat(s.out,
          array(named_struct('rule', h.rule, 'idx', h.hit_idx, 'date', h.exit_date, 'px', h.px,
                             'qty', {sold}, 'avg', avg, 'fills', seg_no))))))"""


def close_positions(bars: DataFrame, trades: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``sales`` (array of exit events), ``qty`` still held and ``exit_idx``.

    A ladder fill changes the average cost, so exits are matched segment by segment between
    fills; the number of segments is the number of buy rules of the plan.
    """
    empty = ("CAST(array() AS ARRAY<STRUCT<rule: INT, idx: INT, date: DATE, px: DOUBLE, "
             "qty: BIGINT, avg: DOUBLE, fills: INT>>)")
    t = trades.withColumns({
        "qty": F.lit(0).cast("bigint"), "cost": F.lit(0.0), "sales": F.expr(empty),
        "closed": F.lit(False)})
    n = len(plan.entries)
    for k in range(n):
        live = F.col(f"idx{k}").isNotNull() & ~F.col("closed")
        to_last = F.lit(2 ** 31 - 1)
        end = F.coalesce(F.col(f"idx{k + 1}") - 1, to_last) if k + 1 < n else to_last
        paid = F.col(f"qty{k}") * _paid(plan, F.col(f"px{k}"))
        t = t.withColumns({
            "qty": F.when(live, F.col("qty") + F.col(f"qty{k}")).otherwise(F.col("qty")),
            "cost": F.when(live, F.col("cost") + paid).otherwise(F.col("cost"))})
        t = t.withColumn("avg", F.try_divide(F.col("cost"), F.col("qty")))
        seg = t.where(live).select(
            "code", "ref_idx", F.col(f"idx{k}").alias("seg_start"), end.alias("seg_end"),
            F.col("idx0").alias("entry_idx"), "avg",
            F.transform("sales", lambda x: x["rule"]).alias("done"))
        t = t.join(exit_hits(bars, seg, plan), ["code", "ref_idx"], "left").withColumn(
            "hits", F.coalesce("hits", F.expr("CAST(array() AS ARRAY<STRUCT<hit_idx: INT, "
                                              "rule: INT, exit_date: DATE, px: DOUBLE>>)")))
        t = t.withColumn("seg_no", F.lit(k + 1)).withColumn("_r", F.expr(_sell(plan)))
        t = t.withColumns({
            "sales": F.concat("sales", "_r.out"), "qty": F.col("_r.qty"),
            "cost": F.coalesce(F.col("avg") * F.col("_r.qty"), F.lit(0.0)),
            "closed": F.col("closed") | (live & (F.col("_r.qty") == 0))}).drop("hits", "_r",
                                                                              "seg_no")
        t = stage(t, f"segment{k}")
    # what is still open is sold on the run's last day, at the symbol's last close
    last = bars.groupBy("code").agg(
        F.max("idx").alias("last_idx"), F.max_by("close", "date").alias("last_close"))
    last = last.withColumn("last_date", bars.agg(F.max("date")).scalar())
    t = t.join(last, "code")
    fills = sum((F.when(F.col(f"idx{k}").isNotNull(), 1).otherwise(0) for k in range(n)),
                F.lit(0))
    forced = F.struct(F.lit(-1).alias("rule"), F.col("last_idx").alias("idx"),
                      F.col("last_date").alias("date"), F.col("last_close").alias("px"),
                      F.col("qty"), F.col("avg"), fills.cast("int").alias("fills"))
    t = t.withColumn("sales", F.when(F.col("qty") > 0, F.concat("sales", F.array(forced)))
                     .otherwise(F.col("sales")))
    # a forced close leaves no room for another trade of the symbol
    return t.withColumn("exit_idx", F.when(F.col("qty") > 0, F.lit(2 ** 31 - 1)).otherwise(
        F.array_max(F.transform("sales", lambda x: x["idx"]))))


KEPT = 256    # kept references are moved to a finished list in portions of this size


def non_overlapping(trades: DataFrame) -> DataFrame:
    """One position at a time: the next trade needs a reference after the previous exit.

    A greedy fold over the symbol's candidate (reference, exit) pairs, which are at most as
    many as its bars; the wide trade rows are not gathered.  What is kept grows in portions: an
    append copies at most ``KEPT`` numbers, so the work is linear in the candidates.
    """
    pairs = trades.groupBy("code").agg(
        F.sort_array(F.collect_list(F.struct("ref_idx", "exit_idx"))).alias("c"))
    kept = pairs.select("code", F.expr(f"""explode(aggregate(c,
        named_struct('x', -1, 'some', CAST(array() AS ARRAY<INT>),
                     'full', CAST(array() AS ARRAY<ARRAY<INT>>)),
        (s, t) -> IF(t.ref_idx <= s.x, s, IF(size(s.some) < {KEPT},
          named_struct('x', t.exit_idx, 'some', concat(s.some, array(t.ref_idx)), 'full', s.full),
          named_struct('x', t.exit_idx, 'some', array(t.ref_idx),
                       'full', concat(s.full, array(s.some))))),
        s -> flatten(concat(s.full, array(s.some)))))""").alias("ref_idx"))
    return trades.join(kept, ["code", "ref_idx"], "left_semi")


def match_trades(bars: DataFrame, plan: Plan, end=None, staged: bool = False) -> DataFrame:
    """Positions of every symbol: fills, sales and references, one row per position.

    ``bars`` comes from :func:`index_bars` with an ``is_event`` flag.  Bars, candidates and
    each matched segment are written once, because several joins read them.  The run goes to
    the last trading day of ``bars``, or the last one up to ``end``: no later bar is looked at,
    and what is then still held is sold on that day at the symbol's last close.
    """
    if end is not None:
        until = F.lit(end).cast("date")
        later = F.col("next_date") > until
        bars = bars.where(F.col("date") <= until).withColumns({
            c: F.when(~F.coalesce(later, F.lit(False)), F.col(c)) for c in ("next_open", "next_date")})
    bars = bars if staged else stage(bars, "bars")
    cand = ladder_fills(bars, stage(entry_candidates(bars, plan), "candidates"), plan)
    return non_overlapping(close_positions(bars, cand, plan))


def trade_ledger(positions: DataFrame, plan: Plan) -> DataFrame:
    """One row per exit event with costs, return and profit."""
    n = len(plan.entries)
    log = F.filter(F.array(*[
        F.struct(F.element_at(F.array(*[F.lit(e.id) for e in plan.entries]), F.col(f"rule{k}") + 1)
                 .alias("rule"), F.col(f"date{k}").alias("date"),
                 _paid(plan, F.col(f"px{k}")).alias("price"),
                 F.col(f"qty{k}").alias("qty")) for k in range(n)]),
        lambda f: f["date"].isNotNull())
    ids = [e.id for e in plan.exits]
    x = positions.select(
        "code", "ref", "date0", log.alias("_log"), F.posexplode("sales").alias("_pos", "x"))
    rule = F.when(F.col("x.rule") < 0, F.lit("EOD")).otherwise(
        F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("x.rule") + 1))
    sell = F.col("x.px") * (1.0 - plan.slippage)
    basis = F.col("x.avg") * F.col("x.qty")
    pnl = sell * F.col("x.qty") * (1.0 - plan.fee) - basis
    return x.select(
        "code",
        F.concat_ws("-", "code", F.date_format("ref.date", "yyyy-MM-dd"),
                    F.date_format("date0", "yyyy-MM-dd")).alias("group_id"),
        (F.col("_pos") + 1).alias("part"),
        F.col("ref.date").alias("ref_date"), F.col("ref.amount").alias("ref_amount"),
        F.col("ref.open").alias("ref_open"),
        F.slice("_log", 1, F.col("x.fills")).alias("fills"),
        F.col("date0").alias("entry_date"), F.col("x.qty").alias("qty"),
        F.col("x.avg").alias("avg_price"), F.col("x.date").alias("exit_date"),
        sell.alias("exit_price"), rule.alias("exit_rule"),
        F.when(F.col("x.rule") < 0, F.lit("period end")).otherwise(rule).alias("exit_reason"),
        F.datediff(F.col("x.date"), F.col("date0")).alias("hold_days"),
        (F.try_divide(pnl, basis) * 100.0).alias("return_pct"), pnl.alias("pnl"))


def position_fills(ledger: DataFrame) -> DataFrame:
    """(code, f): every buy once.

    Every sale logs the fills so far; a fill belongs to the first sale that shows it.
    """
    prev = Window.partitionBy("code", "group_id").orderBy("part")
    seen = F.coalesce(F.lag(F.size("fills")).over(prev), F.lit(0))
    return (ledger.select("code", "fills", seen.alias("seen"))
            .select("code", F.explode(F.expr(
                "slice(fills, seen + 1, greatest(size(fills) - seen, 0))")).alias("f")))


def activity_log(bars: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events, fills and results as one long table (date, level, code, text)."""
    match = bars.where("is_event").select(
        "date", F.lit("MATCH").alias("level"), "code",
        F.concat(F.lit("reference day, amount "), F.round("amount", 0).cast("bigint"))
        .alias("text"))
    fills = position_fills(ledger).select(
        F.col("f.date").alias("date"), F.lit("FILL").alias("level"), "code",
        F.concat_ws(" ", F.lit("buy"), F.col("f.rule"), F.col("f.qty")).alias("text"))
    sales = ledger.select(
        F.col("exit_date").alias("date"), F.lit("FILL").alias("level"), "code",
        F.concat_ws(" ", F.lit("sell"), "exit_rule", "qty").alias("text"))
    results = ledger.select(
        F.col("exit_date").alias("date"), F.lit("PNL").alias("level"), "code",
        F.concat_ws(" ", F.lit("held"), "hold_days", F.lit("days")).alias("text"))
    return match.unionByName(fills).unionByName(sales).unionByName(results)
