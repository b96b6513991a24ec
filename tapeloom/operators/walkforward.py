"""Walk-forward search by prefix moments: no bar is copied into windows, whatever their number or length.

A rule looks back a fixed number of bars, so inside a slice of bars its position is the one it has over the whole
series from some bar on, its first *held* bar: the bar where the look-back fits into the slice, or, for a rule that keeps its last event, the
first event from there on. Before that the slice is flat. Net returns of a slice are thus
those of the whole series, but for the bar after the first held one (it pays for entering from flat) and the slice's last
bar under ``next_open`` (there is no next open inside the slice). So every parameter set is run once over each
series, running sums of its net returns are kept per bar, and the moments of a slice are differences of two
of those rows, corrected for at most two bars. The work is linear in bars times parameter sets, plus a few rows per
window and parameter set; anchored windows cost the same as rolling ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import clock, maths
from tapeloom.operators.signals import Strategy
from tapeloom.plans.joins import asof_join
from tapeloom.plans.scan import carry_scan, running
from tapeloom.plans.stage import stage
from tapeloom.plans.tiles import TILE_ROWS, index_rows, tile

Combos = Sequence[tuple[int, Mapping[str, Any]]]


@dataclass(frozen=True)
class Moments:
    """What a score may use of a slice's net returns; ``moved`` counts the bars whose return is not zero."""

    n: Column
    total: Column
    squares: Column
    moved: Column
    trades: Column

    @property
    def mean(self) -> Column:
        return self.total / self.n

    @property
    def deviation(self) -> Column:
        """Sample standard deviation; exactly 0 for a slice that never moved."""
        rest = F.greatest(F.lit(0.0), self.squares - self.total * self.total / self.n)
        return F.when((self.n >= 2) & (self.moved == 0), F.lit(0.0)).when(self.n >= 2, F.sqrt(rest / (self.n - 1)))


Score = Callable[[Moments], Column]


def sharpe_score(bars_per_year: int) -> Score:
    def score(m: Moments) -> Column:
        usable = (m.n >= 2) & (m.moved > 0) & ~maths.is_flat(m.mean, m.deviation)
        return F.when(usable, maths.div(m.mean, m.deviation) * F.lit(math.sqrt(bars_per_year)))

    return score


def _checked_gross(t, execution: str) -> Column:
    if execution == "next_open":
        gross = maths.div(t.lead("open"), F.col("open")) - 1
    else:
        gross = maths.div(F.col("close"), t.lag("close")) - 1
    bad = (F.col("close") <= 0) | (F.col("open") <= 0)
    return F.when(bad, F.raise_error(F.lit("non-positive price")).cast("double")).otherwise(F.coalesce(gross, F.lit(0.0)))


def running_moments(
    bars: DataFrame, strategy: Strategy, combos: Combos, cost: float, execution: str, *, key: Sequence[str], size: int = TILE_ROWS
) -> DataFrame:
    """Per (key, combo_id, rn) of the whole series: lagged position, gross and net return, running sums, and ``held``,
    the first bar from this one on whose position a slice shares."""
    params = [p for _, p in combos]
    longest = max([strategy.lookback(**p) for p in params], default=0)
    t = tile(bars, key, before=max(longest, 1), after=1, size=size)
    df = strategy.indicators(t.with_df(t.df.withColumn("gross", _checked_gross(t, execution))), params)
    sets = [F.struct(F.lit(i).alias("combo_id"), F.when(strategy.ready(**p), strategy.event(**p)).alias("event")) for i, p in combos]
    by = [*key, "combo_id"]
    rows = t.core(df).select(*key, "rn", "_tile", "gross", F.inline(F.array(*sets)))
    if strategy.latched:
        rows = carry_scan(rows, by, "_tile", ("rn",), {"raw": running("last", "event")})
        back = rows.withColumns({"_back": -F.col("rn"), "_back_tile": -F.col("_tile")})
        at = F.when(F.col("event").isNotNull(), F.col("rn"))
        rows = carry_scan(back, by, "_back_tile", ("_back",), {"held": running("last", at)}).drop("_back", "_back_tile")
    else:
        rows = rows.withColumns({"raw": F.col("event"), "held": F.col("rn")})
    beyond = F.raise_error(F.lit("position outside [-1, 1]")).cast("double")
    raw = F.coalesce(F.col("raw"), F.lit(0.0))
    rows = rows.withColumn("raw", F.when(F.abs(raw) > 1, beyond).otherwise(raw)).drop("_tile", "event")

    two = tile(rows, by, before=2, size=size)
    lagged, earlier = (F.coalesce(two.lag("raw", k), F.lit(0.0)) for k in (1, 2))
    df = two.df.withColumns({"lagged": lagged, "change": F.abs(lagged - earlier), "opened": (F.signum(lagged) != F.signum(earlier)) & (lagged != 0)})
    df = two.core(df).withColumn("net", F.col("lagged") * F.col("gross") - F.lit(cost) * F.col("change"))
    net = F.col("net")
    sums = {"total": net, "squares": net * net, "moved": (net != 0).cast("long"), "trades": F.col("opened").cast("long")}
    out = carry_scan(df, by, "_tile", ("rn",), {n: running("sum", c) for n, c in sums.items()})
    return out.select(*by, "rn", "held", "lagged", "gross", "change", "net", *sums)


def slice_bounds(bars: DataFrame, windows: DataFrame, *, key: Sequence[str], bucket: str = "1d") -> DataFrame:
    """(key, window_id, role, first, last): the row numbers of both slices of every window, ends included."""
    like = clock.ts_type(windows, "train_start")
    before = lambda c: clock.from_micros(clock.micros(c) - 1, like)
    ends = F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(end).alias("side"), at.alias("ts"))
        for role in ("train", "test") for end, at in (("first", before(f"{role}_start")), ("last", F.col(f"{role}_end")))
    ])
    asked = windows.select(*key, "window_id", F.inline(ends))
    found = asof_join(asked, bars, ["rn"], key=key, bucket=bucket)
    return (
        found.groupBy(*key, "window_id", "role")
        .agg((F.coalesce(F.max(F.when(F.col("side") == "first", F.col("rn"))), F.lit(-1)) + 1).alias("first"), F.max(F.when(F.col("side") == "last", F.col("rn"))).alias("last"))
        .where("last >= first")
    )


def slice_moments(moments: DataFrame, bounds: DataFrame, warm: Mapping[int, int], cost: float, execution: str, *, key: Sequence[str]) -> DataFrame:
    """n, total, squares, moved and trades of every (slice, parameter set); ``warm`` has the look-back of each set."""
    by = [*key, "combo_id"]
    sets = F.array(*[F.struct(F.lit(i).alias("combo_id"), F.lit(w).cast("long").alias("warm")) for i, w in warm.items()])
    asked = bounds.select("*", F.inline(sets)).withColumn("rn", F.col("first") + F.col("warm"))
    asked = asked.join(moments.select(*by, "rn", "held"), [*by, "rn"], "left").drop("rn", "warm")
    entry = moments.select(*by, (F.col("rn") - 1).alias("held"), *[F.col(c).alias(f"e_{c}") for c in ("lagged", "gross", "total", "squares", "moved", "trades")])
    final = moments.select(*by, F.col("rn").alias("last"), *[F.col(c).alias(f"l_{c}") for c in ("change", "net", "total", "squares", "moved", "trades")])
    rows = asked.join(entry, [*by, "held"], "left").join(final, [*by, "last"], "left")
    active = F.coalesce(F.col("held") < F.col("last"), F.lit(False))  # the bar after the first held one lies in the slice
    more = active & (F.col("held") + 1 < F.col("last"))
    open_end = execution == "next_open"
    paid = F.lit(cost) * F.abs("e_lagged")
    first = F.when(active, F.when(more | F.lit(not open_end), F.col("e_lagged") * F.col("e_gross") - paid).otherwise(-paid)).otherwise(0.0)
    final_net = F.when(more, -F.lit(cost) * F.col("l_change")).otherwise(0.0) if open_end else F.lit(0.0)

    def between(name: str, of_last: Column) -> Column:
        whole = F.col(f"l_{name}") - F.col(f"e_{name}")
        return F.when(more, whole - of_last if open_end else whole).otherwise(0)

    last = F.col("l_net")
    return rows.withColumns({"_first": first, "_final": final_net}).select(
        *key, "window_id", "role", "combo_id",
        (F.col("last") - F.col("first") + 1).alias("n"),
        (between("total", last) + F.col("_first") + F.col("_final")).alias("total"),
        (between("squares", last * last) + F.col("_first") * F.col("_first") + F.col("_final") * F.col("_final")).alias("squares"),
        (between("moved", (last != 0).cast("long")) + (F.col("_first") != 0).cast("long") + (F.col("_final") != 0).cast("long")).alias("moved"),
        F.when(active, (F.col("e_lagged") != 0).cast("long") + F.col("l_trades") - F.col("e_trades")).otherwise(0).alias("trades"),
    )


def scored_slices(
    bars: DataFrame, windows: DataFrame, strategy: Strategy, combos: Combos, score: Score, cost: float, execution: str, *,
    key: Sequence[str], size: int = TILE_ROWS, bucket: str = "1d",
) -> DataFrame:
    """(key, window_id, role, combo_id, score, trades) of every slice and parameter set."""
    needed = [c for c in bars.columns if c in {*key, "ts", "rn", *strategy.columns}]
    rows = bars.select(*needed) if "rn" in bars.columns else stage(index_rows(bars.select(*needed), key, bucket=bucket), "rows")
    if not combos:
        return windows.select(*key, "window_id", F.lit("").alias("role"), F.lit(0).alias("combo_id"), F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("trades")).limit(0)
    moments = stage(running_moments(rows, strategy, combos, cost, execution, key=key, size=size), "moments")
    bounds = stage(slice_bounds(rows.select(*key, "ts", "rn"), windows, key=key, bucket=bucket), "bounds")
    warm = {i: strategy.lookback(**p) for i, p in combos}
    out = slice_moments(moments, bounds, warm, cost, execution, key=key)
    m = Moments(*[F.col(c) for c in ("n", "total", "squares", "moved", "trades")])
    return out.select(*key, "window_id", "role", "combo_id", score(m).alias("score"), "trades")


__all__ = ["Moments", "running_moments", "scored_slices", "sharpe_score", "slice_bounds", "slice_moments"]
