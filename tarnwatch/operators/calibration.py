"""Thresholds and weights from calibration data: per regime, with fallbacks and their reasons,
by folds over time, and what follows from them for leaves and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions import opinions as O
from ..functions.times import seconds
from . import metrics as M
from .joins import small_side
from .segments import SEGMENT, meet, numbered

#: Least rows for a group's own thresholds; with fewer, those of all its rows count.
LEAST_ROWS = 10


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], margin: float = 0.001) -> DataFrame:
    """by, n and q0, q1, ...: exact interpolated quantiles of a value in each group.

    Approximate quantiles a margin below and above each share bracket it; only the distinct values
    inside, about two margins of a group, are then ordered, after the count and the largest of
    the rows below. So no task orders a whole group, however many rows one key has; a group of fewer
    than 4 / margin rows, where a margin may be less than one row, is its own bracket. Nulls are left out."""
    known = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    accuracy = int(10 / margin)
    ends = [F.percentile_approx("_v", F.array(F.lit(max(0.0, s - margin)), F.lit(min(1.0, s + margin))), accuracy).alias(f"_e{i}") for i, s in enumerate(shares)]
    bounds = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(F.min("_v"), F.max("_v")).alias("_all"), *ends)
    bounds = bounds.withColumns({f"_e{i}": F.when(F.col("n") < 4 / margin, F.col("_all")).otherwise(F.col(f"_e{i}")) for i in range(len(shares))}).drop("_all")
    joined = meet(known, bounds, by)
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("n") - 1)).alias("pos"), F.get(f"_e{i}", F.lit(0)).alias("low"), F.get(f"_e{i}", F.lit(1)).alias("high")) for i, s in enumerate(shares)])).alias("_c")
    # One row for each distinct value inside a bracket and one for all below it, from each task. A
    # quantile lies at the largest of those below at the lowest.
    slot = F.when(F.col("_v") < F.col("_c.low"), None).otherwise(F.col("_v"))
    cells = joined.select(*by, "n", "_v", at).filter(F.col("_v") <= F.col("_c.high")).groupBy(*by, "n", F.col("_c.i").alias("_i"), F.col("_c.pos").alias("_at"), slot.alias("_s")).agg(F.count(F.lit(1)).alias("_k"), F.max("_v").alias("_top"))
    w = Window.partitionBy(*by, "_i").orderBy(F.col("_s").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = cells.withColumn("_upto", F.sum("_k").over(w))
    pick = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_top")))
    parts = upto.groupBy(*by, "n", "_i", "_at").agg(pick(F.floor("_at")).alias("_a"), pick(F.ceil("_at")).alias("_b"))
    q = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))
    return parts.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("_i") == i, q)).alias(f"q{i}") for i in range(len(shares))])


def directed(df: DataFrame, residual: str, direction: Column) -> DataFrame:
    """df with branch and e: a residual's size in the directions that its leaf looks at (pos, neg,
    both or sym); both gives a row for pos and one for neg. Only the part on the side of a branch
    counts; sym takes the absolute value."""
    r = F.col(residual)
    one = lambda name, e: F.struct(F.lit(name).alias("branch"), e.alias("e"))
    pos, neg = one("pos", F.when(r > 0, r)), one("neg", F.when(r < 0, -r))
    branches = F.when(direction == "pos", F.array(pos)).when(direction == "neg", F.array(neg)).when(direction == "both", F.array(pos, neg)).otherwise(F.array(one("sym", F.abs(r))))
    return df.withColumn("_b", F.explode(branches)).select(*df.columns, "_b.branch", "_b.e").filter("e IS NOT NULL")


def sides(df: DataFrame, by: Sequence[str], residual: str, direction: Column, least: int = LEAST_ROWS) -> DataFrame:
    """df with branch and e, as directed() has them, zeros included (on the positive side where a leaf
    looks at both). A side with fewer than least rows takes the sizes of all rows of its leaf."""
    r = F.col(residual)
    df = df.filter(r.isNotNull() & ~F.isnan(r)).withColumn("_way", direction)
    below = F.when(F.col("_way") == "both", r < 0).otherwise(r <= 0)
    counts = df.groupBy(*by).agg(F.sum((r >= 0).cast("long")).alias("_up"), F.sum(below.cast("long")).alias("_down"))
    rows = meet(df, counts, by)
    one = lambda name, has, n: F.struct(F.lit(name).alias("branch"), F.when(has | (F.col(n) < least), F.abs(r)).alias("e"))
    pos, neg = one("pos", r >= 0, "_up"), one("neg", below, "_down")
    every = F.struct(F.lit("sym").alias("branch"), F.abs(r).alias("e"))
    branches = F.when(F.col("_way") == "pos", F.array(pos)).when(F.col("_way") == "neg", F.array(neg)).when(F.col("_way") == "both", F.array(pos, neg)).otherwise(F.array(every))
    return rows.withColumn("_b", F.explode(branches)).select(*[c for c in df.columns if c != "_way"], "_b.branch", "_b.e").filter("e IS NOT NULL")


def thresholds_with_reason(df: DataFrame, by: Sequence[str], e: str, q_susp: float = 0.9, q_atk: float = 0.97, ratio: float = 1.1, base: float = 0.9, least: int = LEAST_ROWS, few: tuple[float, float] = (1.0, 2.0)) -> DataFrame:
    """by, n, t_susp, t_atk, t_base and reason: empirical quantiles; too few rows give the stated
    pair, a suspect threshold of zero the floor. reason says which, null where none applies."""
    q = quantiles(df, by, e, [q_susp, q_atk])
    scarce, flat = F.col("n") < least, F.col("q0") <= 1e-9
    susp = F.when(scarce, F.lit(float(few[0]))).otherwise(F.greatest("q0", F.lit(1e-9)))
    atk = F.when(scarce, F.lit(float(few[1]))).otherwise(F.greatest(F.col("q1"), ratio * susp))
    return q.select(*by, "n", susp.alias("t_susp"), atk.alias("t_atk"), (base * susp).alias("t_base"), F.when(scarce, "few rows").when(flat, "no spread").alias("reason"))


def thresholds_by_regime(df: DataFrame, leaf: str, ts: str, e: str, holidays: Sequence[str] = (), q_susp: float = 0.9, q_atk: float = 0.97, least: int = LEAST_ROWS) -> DataFrame:
    """leaf, regime, n, t_susp, t_atk, t_base, source: the thresholds of each regime, or, with
    fewer than least rows in it, those of the whole leaf (source says own or leaf). Every leaf has
    a row for ACTIVE and one for QUIET."""
    rows = df.withColumn("regime", calendar.regime_of(F.col(ts), holidays))
    own = thresholds_with_reason(rows, [leaf, "regime"], e, q_susp, q_atk, least=least)
    whole = thresholds_with_reason(rows, [leaf], e, q_susp, q_atk, least=least).select(leaf, *[F.col(c).alias(f"_{c}") for c in ("t_susp", "t_atk", "t_base")])
    every = whole.withColumn("regime", F.explode(F.array(F.lit("ACTIVE"), F.lit("QUIET"))))
    joined = every.join(own, [leaf, "regime"], "left")
    enough = F.coalesce(F.col("n") >= least, F.lit(False))
    return joined.select(leaf, "regime", F.coalesce("n", F.lit(0)).alias("n"), *[F.when(enough, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("t_susp", "t_atk", "t_base")], F.when(enough, "own").otherwise("leaf").alias("source"))


def with_regime_thresholds(df: DataFrame, thresholds: DataFrame, leaf: str, ts: str, holidays: Sequence[str] = ()) -> DataFrame:
    """df with the thresholds of its leaf and of the regime of its time."""
    t = thresholds.select(leaf, "regime", "t_susp", "t_atk", "t_base")
    return df.withColumn("regime", calendar.regime_of(F.col(ts), holidays)).join(small_side(t), [leaf, "regime"], "left")


def gap_ratio(thresholds: DataFrame, by: Sequence[str]) -> DataFrame:
    return thresholds.select(*by, F.try_divide(F.col("t_atk") - F.col("t_susp"), F.col("t_susp")).alias("gap_ratio"))


def reliability(windows: DataFrame, by: Sequence[str], susp: str, atk: str, least: int = 10, floor: float = 0.05, default: float = 0.3) -> DataFrame:
    """by, n_suspect, reliability: one less the share of suspect windows without any attack mass,
    in [floor, 1]; the default with fewer than least suspect windows."""
    s = F.col(susp) + F.col(atk) > 0
    blind = F.sum((s & (F.col(atk) <= 0)).cast("long"))
    n = F.sum(s.cast("long"))
    return windows.groupBy(*by).agg(n.alias("n_suspect"), blind.alias("_b")).select(*by, "n_suspect", F.when(F.col("n_suspect") < least, default).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(floor), 1 - F.col("_b") / F.col("n_suspect")))).alias("reliability"))


# Folds over time. A model of means by season is a sum and a count, so each fold's sums come from
# the sums of the periods before it: rows are read once, whatever the number of folds.


def rolling_r2(df: DataFrame, by: Sequence[str], ts: str, y: str, season: Sequence[str], initial_days: int = 14, step_days: int = 3, horizon_days: int = 1) -> DataFrame:
    """by, n_folds, n, r2: rolling origins from initial_days after the start on, every step_days;
    each predicts the horizon by the means of season before its origin (the mean of all, where a
    season has none). r2 is 1 - mse / variance over all predictions; null without any."""
    day = F.floor(seconds(ts) / 86400).cast("long")
    rows = df.filter(F.col(y).isNotNull()).select(*by, *season, day.alias("_d"), F.col(y).cast("double").alias("_y"))
    s = Window.partitionBy(*by, *season).orderBy("_d")
    a = Window.partitionBy(*by).orderBy("_d")
    # Sums by day and season; a day's window ends on the day before its fold's origin.
    cells = rows.groupBy(*by, *season, "_d").agg(F.sum("_y").alias("_s"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("_y") * F.col("_y")).alias("_q"))
    first = F.min("_d").over(Window.partitionBy(*by))
    cells = cells.withColumn("_off", F.col("_d") - first - initial_days)
    k = F.pmod(F.col("_off"), F.lit(step_days))
    cells = cells.withColumn("_k", k).withColumn("_test", (F.col("_off") >= 0) & (F.col("_k") < horizon_days))
    cells = cells.select("*", *[F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, -1 - j)).alias(f"_{n}{c}{j}") for w, n in ((s, "own"), (a, "all")) for c in ("_s", "_n") for j in range(horizon_days)])
    pick = lambda name: F.coalesce(*[F.when(F.col("_k") == j, F.col(f"{name}{j}")) for j in range(horizon_days)])
    yhat = F.coalesce(F.try_divide(pick("_own_s"), pick("_own_n")), F.try_divide(pick("_all_s"), pick("_all_n")))
    t = cells.filter("_test").withColumn("_h", yhat).filter("_h IS NOT NULL")
    n = F.sum("_n")
    error = F.sum(F.col("_q") - 2 * F.col("_h") * F.col("_s") + F.col("_n") * F.col("_h") * F.col("_h"))
    spread = F.sum("_q") - F.sum("_s") * F.sum("_s") / n
    folds = F.count_distinct(F.floor(F.col("_off") / step_days))
    return t.groupBy(*by).agg(folds.alias("n_folds"), n.alias("n"), F.try_divide(error, F.when(spread > 1e-12, spread)).alias("_r")).select(*by, "n_folds", "n", (1 - F.col("_r")).alias("r2"))


def expanding_r2(df: DataFrame, by: Sequence[str], order: str, x: str, y: str, folds: int = 5, rows: int = SEGMENT) -> DataFrame:
    """by, n, r2: rows by order in folds + 1 parts of equal size; each part but the first is
    predicted by the least-squares line through the origin of the parts before it. r2 is the mean
    over folds of 1 - mse / variance."""
    part = numbered(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), by, order, "_i", rows=rows)
    part = meet(part, part.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")), by)
    # Parts of equal size, the first ones longer by one where the rows don't divide, as ntile() has them.
    size, longer = F.floor(F.col("_m") / (folds + 1)), F.col("_m") % (folds + 1)
    edge = longer * (size + 1)
    k = F.when(F.col("_i") < edge, F.floor(F.col("_i") / (size + 1))).otherwise(longer + F.floor((F.col("_i") - edge) / F.greatest(size, F.lit(1)))) + 1
    part = part.select(*by, "_x", "_y", k.alias("_k"))
    x_, y_ = F.col("_x"), F.col("_y")
    sums = part.groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("n"), F.sum(x_ * y_).alias("xy"), F.sum(x_ * x_).alias("xx"), F.sum(y_ * y_).alias("yy"), F.sum("_y").alias("s"))
    before = Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    b = sums.withColumn("_b", F.try_divide(F.sum("xy").over(before), F.sum("xx").over(before)))
    error = F.col("yy") - 2 * F.col("_b") * F.col("xy") + F.col("_b") * F.col("_b") * F.col("xx")
    spread = F.col("yy") - F.col("s") * F.col("s") / F.col("n")
    scored = b.withColumn("_r", 1 - F.try_divide(error, F.when(spread > 1e-12, spread)))
    return scored.groupBy(*by).agg(F.sum("n").alias("n"), F.avg(F.when(F.col("_k") > 1, F.col("_r"))).alias("r2"))


def mean_fallback(scores: DataFrame, r2: str = "r2", allowed: Column | None = None) -> DataFrame:
    """scores with use_mean and r2: a model worse than the mean gives way to it, with r2 zero."""
    bad = F.coalesce(F.col(r2) < 0, F.lit(True)) & (F.lit(True) if allowed is None else allowed)
    return scores.withColumn("use_mean", bad).withColumn(r2, F.when(F.col("use_mean"), 0.0).otherwise(F.col(r2)))


def calibration_source(df: DataFrame, by: Sequence[str], held_out: Column, least: int = 30) -> DataFrame:
    """The rows that calibrate a group: those held out if there are at least least, else the rest."""
    n = df.groupBy(*by).agg(F.sum(held_out.cast("long")).alias("_n"))
    return meet(df, n, by).filter(F.when(F.col("_n") >= least, held_out).otherwise(~held_out)).drop("_n")


def missing_models(models: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """The expected keys without a model; a run must not start while there are any."""
    return expected.select(key).distinct().join(models.select(key), key, "left_anti")


def expected_leaves(metrics: Sequence[str], relations: Sequence[str]) -> list[str]:
    """The leaves that a configuration asks for: a forecast for each metric, a reconstruction for
    each relation; names without arrows."""
    return [f"forecast_{m}" for m in metrics] + [f"reconst_{r.replace('->', '_to_')}" for r in relations]


# Weights and discounts of leaves and groups.

WEIGHTS = ("uniform", "r2_static", "interval", "online_rmse")


def leaf_weight(mode: str, r2: Column, width: Column | None = None, rmse: Column | None = None, forecast: Column | None = None) -> Column:
    """A leaf's weight in fusion: one; its r2; for a forecast one over the width of its interval;
    or one over its running error. Where that isn't known, its r2."""
    if mode not in WEIGHTS:
        raise ValueError(f"unknown weight {mode}; known: {WEIGHTS}")
    if mode == "uniform":
        return F.lit(1.0)
    if mode == "interval":
        return F.when((forecast if forecast is not None else F.lit(True)) & (width > 1e-6), F.try_divide(F.lit(1.0), width)).otherwise(r2)
    if mode == "online_rmse":
        return F.when(rmse.isNotNull(), F.try_divide(F.lit(1.0), rmse)).otherwise(r2)
    return r2


def method_discount(df: DataFrame, grp: str, alphas: dict[str, float]) -> DataFrame:
    """df (an opinion a row) with the attack mass of stated groups discounted; 1 and more leave it."""
    op, alpha = O.Opinion.of(), F.lit(1.0)
    for name, a in alphas.items():
        alpha = F.when(F.col(grp) == name, F.lit(float(a))).otherwise(alpha)
    changed = O.either(alpha < 1 - 1e-6, O.contextual_discount(op, (1.0, 1.0, alpha)), op)
    return df.select(*[c for c in df.columns if c not in O.FIELDS], *changed.columns())


def five_states(ev: Column, sides: dict[str, Column], rates: dict[str, Column | float], w: float = O.W) -> dict[str, Column]:
    """Projected probabilities of the four directed states (susp_pos, atk_pos, susp_neg, atk_neg)
    from one window's evidence: ev is its whole sum. Null where a side isn't known."""
    d = ev + w
    return {s: F.try_divide(r, d) + O.lit(rates[s]) * F.try_divide(F.lit(w), d) for s, r in sides.items()}


def refused(leaves: DataFrame, keys: Sequence[str], regime: Column, volumetric: Column, alphas: Sequence[float]) -> DataFrame:
    """keys, alpha, proj_atk: opinions of leaves fused once for each stated alpha, the attack mass of
    volumetric leaves in the ACTIVE regime discounted by it."""
    from .fusion import fuse

    op = O.Opinion.of()
    at = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    rows = leaves.select("*", regime.alias("_reg"), volumetric.alias("_vol"), at)
    cut = F.when((F.col("_reg") == "ACTIVE") & F.col("_vol"), F.col("alpha")).otherwise(1.0)
    rows = rows.select(*keys, "alpha", "leaf", *O.contextual_discount(op, (1.0, 1.0, cut)).columns())
    return fuse(rows, [*keys, "alpha"]).select(*keys, "alpha", O.Opinion.of().projected()[2].alias("proj_atk"))


def alpha_rates(fused: DataFrame, y: str, regime: str, delta: float) -> DataFrame:
    """alpha, fpr_active, fpr_quiet, recall, f1, mcc over rows of fused with their truth and regime."""
    p = (F.col("proj_atk") >= delta).cast("int")
    quiet = lambda r: F.avg(F.when((F.col(y) == 0) & (F.col(regime) == r), p.cast("double")))
    g = fused.groupBy("alpha").agg(quiet("ACTIVE").alias("fpr_active"), quiet("QUIET").alias("fpr_quiet"), *M.confusion(F.col(y), p))
    return M.with_rates(g).select("alpha", "fpr_active", "fpr_quiet", "recall", "f1", "mcc")


def n_fraction(p: Column, s: Column, n: Column, window: float) -> Column:
    """Attack share of the evidence; over the window's size where there is none."""
    total = p + s + n
    return F.when(total > 0, F.try_divide(n, total)).otherwise(n / window)


def static_vote(df: DataFrame, win: str, n: str, weight: str, window: float = 10.0, vote: float = 0.9) -> DataFrame:
    """win, score: the weighted share of leaves whose attack evidence is over the vote."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    hit = (F.col(n) / window > vote).cast("double")
    return df.groupBy(win).agg(M.ratio(F.sum(w * hit), F.sum(w)).alias("score"))


def decluster_shift(grid: DataFrame, by: Sequence[str], run: str, threshold: str) -> DataFrame:
    """by, run, shift: a threshold less that of the shortest run, over the latter."""
    base = F.first(threshold).over(Window.partitionBy(*by).orderBy(run))
    return grid.select(*by, run, F.try_divide(F.col(threshold) - base, base).alias("shift"))
