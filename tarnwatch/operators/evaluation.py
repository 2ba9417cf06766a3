"""Evaluation against catalogs of events: protocols, base rates, repeats, intervals by bootstrap."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.distributions import erfc
from ..functions.lineage import cut
from ..functions.times import micros
from . import metrics as M
from .joins import interval_join, interval_label
from .segments import framed, meet, numbered


def window_votes(df: DataFrame, keys: Sequence[str], vote: str, score: str, label: str, least: int) -> DataFrame:
    """keys, n, votes, score (largest), y and p (1 from least votes on) from finer slices."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(vote).cast("long")).alias("votes"), F.max(score).alias("score"), F.max(label).alias("y"))
    return out.withColumn("p", (F.coalesce("votes", F.lit(0)) >= least).cast("int"))


def label_windows(df: DataFrame, keys: Sequence[str], sums: Sequence[str], means: Sequence[str]) -> DataFrame:
    """Evidence of fine windows in coarser ones: sums add up, widths and errors are averaged."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means])


def outage_parts(catalog: DataFrame, *names: str) -> DataFrame:
    """catalog with is_outage from the stated columns of names."""
    return catalog.withColumn("is_outage", calendar.outage(*[F.col(n) for n in names]))


def marked(df: DataFrame, catalog: DataFrame, ts: str) -> DataFrame:
    """df with in_attack and in_outage (0 or 1) from catalog (start, end, is_outage)."""
    df = interval_label(df, ts, catalog.filter("NOT is_outage"), "in_attack")
    return interval_label(df, ts, catalog.filter("is_outage"), "in_outage")


def two_protocols(df: DataFrame, catalog: DataFrame, ts: str, score: str, threshold: float) -> DataFrame:
    """Two rows of counts and rates: outages left out (unless an attack holds them too), and
    outages as positives."""
    p = (F.col(score) >= threshold).cast("int")
    rows = marked(df, catalog, ts).select(p.alias("p"), "in_attack", "in_outage")
    kinds = F.explode(F.array(
        F.struct(F.lit("outages excluded").alias("protocol"), F.when((F.col("in_outage") == 1) & (F.col("in_attack") == 0), None).otherwise(F.col("in_attack")).alias("y")),
        F.struct(F.lit("outages positive").alias("protocol"), F.greatest("in_attack", "in_outage").alias("y")),
    )).alias("k")
    rows = rows.select("p", kinds).select("p", "k.*").filter("y IS NOT NULL")
    return M.rates_by(rows, ["protocol"], F.col("y"), F.col("p"))


def global_stats(df: DataFrame, catalog: DataFrame, ts: str, gate: str) -> DataFrame:
    """One row: n_attack, n_outage and n_normal windows, open gates in each, detection rate, false
    alarm rate, mcc (outages left out) and the share of open gates in outages."""
    open_ = F.coalesce(F.col(gate).cast("int"), F.lit(0))
    part = F.when(F.col("in_attack") == 1, "attack").when(F.col("in_outage") == 1, "outage").otherwise("normal")
    rows = marked(df, catalog, ts).select(open_.alias("_g"), part.alias("_p"))
    kinds = ("attack", "outage", "normal")
    out = rows.agg(*[F.coalesce(F.sum((F.col("_p") == k).cast("long")), F.lit(0)).alias(f"n_{k}") for k in kinds], *[F.coalesce(F.sum(F.when(F.col("_p") == k, F.col("_g").cast("long"))), F.lit(0)).alias(f"open_{k}") for k in kinds])
    tp, fp = F.col("open_attack").cast("double"), F.col("open_normal").cast("double")
    fn, tn = F.col("n_attack") - tp, F.col("n_normal") - fp
    mcc = M.ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    return out.select("*", M.ratio(tp, tp + fn).alias("detection_rate"), M.ratio(fp, F.col("n_normal")).alias("false_alarm_rate"), mcc.alias("mcc"), M.ratio(F.col("open_outage"), F.col("n_outage")).alias("outage_rate"))


# Events are told apart by their spans: several may have one name. Events of equal spans have equal
# rows, so each span is joined once.


def _in_events(df: DataFrame, catalog: DataFrame, ts: str) -> DataFrame:
    """The rows of df inside an event, with its span as _s and _e; once for each span that holds them."""
    spans = catalog.select("start", "end", F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    return interval_join(df, ts, spans, ["_s", "_e"])


def _to_events(catalog: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """The stated columns of every event with what was found for its span."""
    return meet(catalog.select(*columns, F.col("start").alias("_s"), F.col("end").alias("_e")), found, ["_s", "_e"]).drop("_s", "_e")


def base_rates(df: DataFrame, catalog: DataFrame, ts: str, score: str, before_s: float = 1800, after_s: float = 1800) -> DataFrame:
    """For each event: the last score before it, largest and mean during, mean in the time after.
    Events without rows have nulls."""
    t = micros(ts)
    spans = catalog.select("start", "end").distinct()
    wide = spans.select(F.col("start").alias("_s"), F.col("end").alias("_e"), (F.col("start") - F.expr(f"interval {int(before_s)} seconds")).alias("start"), (F.col("end") + F.expr(f"interval {int(after_s)} seconds")).alias("end"))
    rows = interval_join(df.select(ts, score), ts, wide, ["_s", "_e"])
    a, b = micros("_s"), micros("_e")
    v = F.col(score)
    out = rows.groupBy("_s", "_e").agg(
        F.max_by(F.when(t < a, v), F.when(t < a, t)).alias("before"), F.max(F.when((t >= a) & (t < b), v)).alias("max_during"),
        F.avg(F.when((t >= a) & (t < b), v)).alias("mean_during"), F.avg(F.when(t >= b, v)).alias("mean_after"),
    )
    return meet(catalog.select("name", F.col("start").alias("_s"), F.col("end").alias("_e")), out, ["_s", "_e"]).drop("_s", "_e")


def learning(df: DataFrame, catalog: DataFrame, ts: str, score: str, threshold: float) -> DataFrame:
    """family, occurrence, name, n, coverage, ttd_s of the families that occur twice or more."""
    s = M.attack_summary(df, catalog, ts, score, threshold)
    fam = s.withColumns({"family": calendar.family(F.col("name")), "occurrence": calendar.occurrence(F.col("name"))})
    many = fam.groupBy("family").agg(F.count(F.lit(1)).alias("_c")).filter("_c >= 2").select("family")
    return fam.join(many, "family").select("family", "occurrence", "name", "n", "coverage", "ttd_s")


def ppv_table(df: DataFrame, catalog: DataFrame, ts: str, p: str, y: str, target: float = 0.8) -> DataFrame:
    """For each event: n, base_rate, tpr with its interval, the operating fpr, Bayes ppv and the
    fpr that the target ppv would need. Events without rows have n 0, and nulls."""
    sums = df.agg(F.count(F.lit(1)).alias("_all"), M.ratio(F.sum(((F.col(p) == 1) & (F.col(y) == 0)).cast("long")), F.sum((F.col(y) == 0).cast("long"))).alias("fpr"))  # one row
    rows = _in_events(df.select(ts, p), catalog, ts)
    each = rows.groupBy("_s", "_e").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(p) == 1).cast("long")).alias("_k"))
    out = _to_events(catalog, each, "name").join(F.broadcast(sums), F.lit(True))
    n = F.col("n").cast("double")
    rate, tpr = F.try_divide(n, F.col("_all")), F.try_divide(F.col("_k").cast("double"), n)
    low, high = M.wilson(F.col("_k"), n)
    return out.select(
        "name", F.coalesce("n", F.lit(0)).alias("n"), rate.alias("base_rate"), tpr.alias("tpr"), F.when(n > 0, low).alias("tpr_low"), F.when(n > 0, high).alias("tpr_high"), "fpr",
        F.when(n > 0, M.bayes_ppv(tpr, F.col("fpr"), rate)).alias("ppv"), M.required_fpr(F.lit(target), tpr, rate).alias("needed_fpr"),
    )


def median_run(df: DataFrame, by: Sequence[str], order: str, y: str) -> int:
    """The median length of the runs of y = 1, rounded up; 0 without any."""
    from .timeseries import runs

    got = runs(df, by, order, y).groupBy("n").count().collect()  # as many rows as there are lengths
    lengths = sorted((int(r["n"]), int(r["count"])) for r in got)
    total = sum(c for _, c in lengths)

    def at(i: int) -> int:
        for n, c in lengths:
            i -= c
            if i < 0:
                return n
        return 0

    return math.ceil((at((total - 1) // 2) + at(total // 2)) / 2) if total else 0


def vus_summary(df: DataFrame, by: Sequence[str], order: str, y: str, score: str, p: str, most: int | None = None, steps: int = 11) -> DataFrame:
    """One row: vus_roc, vus_pr, existence recall and the largest buffer, by default the median
    length of the true runs."""
    most = median_run(df, by, order, y) if most is None else most
    roc, pr = (M.vus(df, by, order, y, score, most, steps, kind) for kind in ("roc", "pr"))
    recall = M.existence_recall(df, by, order, y, p)
    return roc.join(pr, F.lit(True)).join(recall, F.lit(True)).withColumn("most", F.lit(most))  # one row each


def triviality(df: DataFrame, y: str, p: str, metrics: Sequence[str], train: Column, limit: float = 3.0, floor: float = 0.9) -> DataFrame:
    """One row: f1 of p, f1 of a detector that calls any |z| beyond the limit, and whether that
    reaches the floor times f1."""
    s = df.filter(train).agg(*[F.avg(m).alias(f"_m_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"_d_{m}") for m in metrics])  # one row
    hit = F.lit(False)
    for m in metrics:
        hit = hit | F.coalesce(F.abs(F.try_divide(F.col(m) - F.col(f"_m_{m}"), F.col(f"_d_{m}"))) > limit, F.lit(False))
    rows = df.filter(~train).join(F.broadcast(s), F.lit(True)).select(F.col(y).alias("y"), F.col(p).alias("p"), hit.cast("int").alias("z"))
    f1 = lambda c: M.ratio(2 * F.sum(((F.col("y") == 1) & (F.col(c) == 1)).cast("long")), F.sum((F.col("y") == 1).cast("long")) + F.sum((F.col(c) == 1).cast("long")))
    return rows.agg(f1("p").alias("f1"), f1("z").alias("f1_trivial")).withColumn("trivial", F.col("f1_trivial") >= floor * F.col("f1"))


def best_of_runs(sweeps: DataFrame, run: str = "run", by: str = "f1", tie: str = "threshold") -> DataFrame:
    """The row of each run with the largest value, of equals that of the smallest tie."""
    rest = [c for c in sweeps.columns if c != run]
    best = F.max_by(F.struct(*rest), F.struct(F.col(by), -F.col(tie)))
    return sweeps.groupBy(run).agg(best.alias("_b")).select(run, "_b.*")


def at_operating_point(sweeps: DataFrame, threshold: float, run: str = "run") -> DataFrame:
    """The row of each run whose threshold is nearest to the stated one."""
    rest = [c for c in sweeps.columns if c != run]
    near = F.min_by(F.struct(*rest), F.struct(F.abs(F.col("threshold") - threshold), F.col("threshold")))
    return sweeps.groupBy(run).agg(near.alias("_b")).select(run, "_b.*")


def recommend(headline: DataFrame, run: str = "run", f1: str = "f1", fpr: str = "fpr", most_fpr: float = 0.05) -> DataFrame:
    """One row: the run of the largest f1 among those within the fpr, else among all."""
    fits = (F.col(fpr) <= most_fpr).cast("int")
    return headline.orderBy(fits.desc(), F.col(f1).desc(), run).limit(1).select(run, f1, fpr, (fits == 1).alias("within"))


# Intervals by bootstrap. A statistic is a function of the counts of the codes of rows (2y + p, or
# 4y + 2a + b for pairs), so rows are counted once and never move again.

Statistic = Callable[[np.ndarray], np.ndarray]


def f1_of(counts: np.ndarray) -> np.ndarray:
    """Of counts of 2y + p in the last axis; zero where it isn't defined."""
    c = np.asarray(counts, dtype=float)
    d = 2 * c[..., 3] + c[..., 1] + c[..., 2]
    return np.divide(2 * c[..., 3], d, out=np.zeros_like(d), where=d > 0)


def f1_gain(counts: np.ndarray) -> np.ndarray:
    """f1 of a less f1 of b, of counts of 4y + 2a + b."""
    c = np.asarray(counts, dtype=float).reshape(*np.shape(counts)[:-1], 2, 2, 2)
    return f1_of(c.sum(axis=-1).reshape(*c.shape[:-3], 4)) - f1_of(c.sum(axis=-2).reshape(*c.shape[:-3], 4))


def bca_endpoints(theta: float, draws: np.ndarray, left_out: np.ndarray, times: np.ndarray, alpha: float = 0.05) -> tuple[float, float]:
    """Bias-corrected and accelerated ends. left_out holds the statistic without one row, times
    how often each value of it occurs."""
    draws = draws[np.isfinite(draws)]
    if not len(draws):
        return math.nan, math.nan
    normal = NormalDist()
    share = min(max(float((draws < theta).mean()), 1e-9), 1 - 1e-9)
    z0, a, n = normal.inv_cdf(share), 0.0, float(times.sum())
    if n >= 3:
        gap = (times * left_out).sum() / n - left_out
        bottom = 6 * float((times * gap**2).sum()) ** 1.5
        a = float((times * gap**3).sum()) / bottom if bottom > 1e-24 else 0.0
    ends = []
    for q in (alpha / 2, 1 - alpha / 2):
        z = z0 + normal.inv_cdf(q)
        d = 1 - a * z
        ends.append(min(max(share if abs(d) < 1e-12 else normal.cdf(z0 + z / d), 1e-6), 1 - 1e-6))
    if ends[0] > ends[1]:
        ends = [alpha / 2, 1 - alpha / 2]
    return tuple(float(x) for x in np.quantile(draws, ends))


def _codes(y: str, predictions: Sequence[str]) -> Column:
    code = F.col(y).cast("int")
    for p in predictions:
        code = 2 * code + F.col(p).cast("int")
    return code


#: Rows that one task puts in order while blocks are counted; kinds of blocks that one task draws from.
BLOCK_ROWS, KINDS = 500_000, 20_000


def block_kinds(df: DataFrame, pos: str, code: Column, codes: int, length: int, step: int = 1) -> DataFrame:
    """(c0, c1, ..., times): the counts of the codes in blocks of so many neighbouring rows, and how
    many blocks have them. step 1 gives every start whose block is whole; a step of length cuts the
    rows into blocks one after the other, the last one short. pos numbers the rows 0, 1, ..."""
    names = [f"c{i}" for i in range(codes)]
    ones = df.select(F.col(pos).cast("long").alias("_at"), *[(code == i).cast("long").alias(n) for i, n in enumerate(names)])
    if step == 1:
        ahead = lambda w: {n: F.sum(n).over(w.rowsBetween(0, length - 1)) for n in names}
        blocks = framed(ones, [], "_at", 0, length - 1, ahead, rows=BLOCK_ROWS)
        blocks = blocks.filter(sum((F.col(n) for n in names), F.lit(0)) == length)
    else:
        blocks = ones.groupBy(F.floor(F.col("_at") / length)).agg(*[F.sum(n).alias(n) for n in names])
    return blocks.groupBy(*names).agg(F.count(F.lit(1)).alias("times"))


def drawn_blocks(kinds: DataFrame, codes: int, draws: int, replicates: int, seed: int, group_rows: int = KINDS) -> np.ndarray:
    """Counts of the codes in so many blocks drawn with replacement, for each replicate.

    Blocks of equal counts are alike, so a replicate is a multinomial draw over kinds of blocks;
    their number is bounded by the block's length, not by the table's. The kinds are dealt into
    groups: how often each group is drawn is decided first, what is drawn inside a group by a
    task for it (a multinomial in two steps). One row of counts for each replicate comes back."""
    names = [f"c{i}" for i in range(codes)]
    kinds = cut(kinds)
    n = kinds.count()
    groups = max(1, -(-n // group_rows))
    kinds = kinds.withColumn("_g", F.pmod(F.xxhash64(*names), F.lit(groups)).cast("int"))
    totals = {r["_g"]: r["t"] for r in kinds.groupBy("_g").agg(F.sum("times").alias("t")).collect()}
    share = np.array([totals.get(g, 0) for g in range(groups)], dtype=float)
    each = np.random.default_rng(seed).multinomial(draws, share / share.sum(), size=replicates)  # replicates x groups numbers

    def work(pdf):
        pdf = pdf.sort_values(names)
        g = int(pdf["_g"].iloc[0])
        rng, p = np.random.default_rng([seed, g]), pdf["times"].to_numpy(dtype=float)
        counts, p = pdf[names].to_numpy(dtype=np.int64), p / p.sum()
        out = np.stack([rng.multinomial(k, p) @ counts if k else np.zeros(codes, np.int64) for k in each[:, g]])
        import pandas as pd

        return pd.DataFrame({"rep": np.arange(replicates), **{c: out[:, i] for i, c in enumerate(names)}})

    parts = kinds.groupBy("_g").applyInPandas(work, "rep long, " + ", ".join(f"{c} long" for c in names))
    rows = parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in names]).orderBy("rep").collect()
    return np.array([r[1:] for r in rows], dtype=float)


def bca_interval(df: DataFrame, y: str, predictions: Sequence[str], statistic: Statistic, order: str | None = None, block: int = 1, replicates: int = 2000, alpha: float = 0.05, seed: int = 42) -> dict:
    """value, low and high. Rows with a null label or prediction are left out first. With block 1,
    rows are drawn apart: their counts are multinomial, so one aggregate is all that the table
    gives. Else blocks of neighbours are drawn, in the order of a column whose values are distinct
    (the known rows are numbered anew by it), and the acceleration comes from leaving out
    one block after the other."""
    codes = 2 ** (1 + len(predictions))
    known = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (y, *predictions)))
    code = _codes(y, predictions)
    got = {r["c"]: r["n"] for r in known.groupBy(code.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.array([got.get(i, 0) for i in range(codes)], dtype=float)
    n = int(counts.sum())
    if not n:
        return {"value": math.nan, "low": math.nan, "high": math.nan}
    theta = float(statistic(counts))
    if block <= 1:
        draws = np.random.default_rng(seed).multinomial(n, counts / n, size=replicates)
        held = np.flatnonzero(counts)
        left_out, times = statistic(counts - np.eye(codes)[held]), counts[held]
    else:
        if order is None:
            raise ValueError("blocks need an order")
        block = min(block, n)
        rows = known.select(F.col(order).alias("_order"), code.cast("int").alias("_code"))
        rows = cut(numbered(rows, [], "_order", "_pos", rows=BLOCK_ROWS))
        whole, rest = divmod(n, block)
        draws = drawn_blocks(block_kinds(rows, "_pos", F.col("_code"), codes, block), codes, whole, replicates, seed)
        if rest:  # the last block of a replicate is cut short
            short = rows.filter(F.col("_pos") < n - block + rest)  # its starts are those of whole blocks
            draws = draws + drawn_blocks(block_kinds(short, "_pos", F.col("_code"), codes, rest), codes, 1, replicates, seed + 1)
        out = np.array([tuple(r) for r in block_kinds(rows, "_pos", F.col("_code"), codes, block, block).orderBy(*[f"c{i}" for i in range(codes)]).collect()], dtype=float)
        stays = counts - out[:, :-1]
        keep = stays.sum(axis=1) >= 2
        left_out, times = statistic(stays[keep]), out[keep, -1]
    low, high = bca_endpoints(theta, statistic(draws), left_out, times, alpha)
    return {"value": theta, "low": low, "high": high}


def mcnemar_p(n01: Column, n10: Column, exact_below: int = 25) -> Column:
    """Two-sided p of McNemar's test: the binomial below so many discordant pairs, else chi
    squared with a continuity correction. Both as column expressions."""
    m = (n01 + n10).cast("int")
    low = F.least(n01, n10).cast("int")
    term = lambda i: F.exp(F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(0.0), lambda a, j: a + F.when(j <= i, F.ln((m - j + 1) / j)).otherwise(0.0)) - m * math.log(2))
    exact = F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0), low), F.lit(0.0), lambda a, i: a + term(i)))
    d = F.greatest(F.abs(n01 - n10) - 1, F.lit(0)).cast("double")
    return F.when(m == 0, 1.0).when(m < exact_below, exact).otherwise(erfc(F.sqrt(d * d / m) / math.sqrt(2)))


def group_independence(df: DataFrame, win: str, grp: str, states: Sequence[str]) -> DataFrame:
    """(grp_x, grp_y, state_x, state_y, n, rho): for each pair of groups the pair of states of the
    largest |correlation| over windows. Groups are few: a window gives a row for each pair."""
    cols = [F.struct(F.lit(s).alias("state"), F.col(s).alias("v")) for s in states]
    long = df.select(win, F.col(grp).alias("g"), F.explode(F.array(*cols)).alias("c")).select(win, "g", "c.*")
    a, b = long.select(win, *[F.col(c).alias(f"{c}_x") for c in ("g", "state", "v")]), long.select(win, *[F.col(c).alias(f"{c}_y") for c in ("g", "state", "v")])
    rho = F.try_divide(F.covar_samp("v_x", "v_y"), F.stddev_samp("v_x") * F.stddev_samp("v_y"))
    r = a.join(b, win).filter("g_x < g_y").groupBy("g_x", "g_y", "state_x", "state_y").agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))
    best = F.max_by(F.struct("state_x", "state_y", "n", "rho"), F.struct(F.abs(F.coalesce("rho", F.lit(0.0))), F.col("state_x"), F.col("state_y")))
    return r.groupBy(F.col("g_x").alias("grp_x"), F.col("g_y").alias("grp_y")).agg(best.alias("b")).select("grp_x", "grp_y", "b.*")


def first_correct(df: DataFrame, events: DataFrame, ts: str, named: str) -> DataFrame:
    """(name, ttq_s): seconds from an event's start to its first row of the expected name."""
    spans = events.select("expected", "start", "end", F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    rows = interval_join(df.select(ts, named), ts, spans, ["expected", "_s", "_e"])
    first = rows.filter(F.col(named) == F.col("expected")).groupBy("expected", "_s", "_e").agg((F.min(micros(ts) - micros("_s")) / 1e6).alias("ttq_s"))
    all_ = events.select("name", "expected", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return meet(all_, first, ["expected", "_s", "_e"]).select("name", "ttq_s")


def suspects(df: DataFrame, ts: str, flags: Sequence[str], top: int = 50) -> DataFrame:
    """The rows of most flags (ties by time): ts, n_flags and severity high (3 or more), medium, low."""
    n = sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags), F.lit(0))
    rows = df.select(ts, n.alias("n_flags")).filter("n_flags > 0").orderBy(F.desc("n_flags"), ts).limit(top)
    return rows.withColumn("severity", F.when(F.col("n_flags") >= 3, "high").when(F.col("n_flags") == 2, "medium").otherwise("low"))


def metric_votes(df: DataFrame, ts: str, width: str, metric: str, vote: str, least: int) -> DataFrame:
    """(win, n, label): in windows of that width, the metrics that vote (any of their rows does),
    and 1 from least metrics on."""
    each = df.groupBy(F.window(ts, width)["start"].alias("win"), metric).agg(F.max(F.col(vote).cast("int")).alias("_v"))
    return each.groupBy("win").agg(F.sum("_v").alias("n")).withColumn("label", (F.col("n") >= least).cast("int"))


def outage_check(df: DataFrame, train: Column, events: DataFrame, ts: str, metrics: Sequence[str]) -> DataFrame:
    """(name, metric, n, z, direction): the mean of each metric during an event, in deviations of
    the training rows; down below -1, up above 1, else flat."""
    s = df.filter(train).agg(*[F.avg(m).alias(f"_m_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"_d_{m}") for m in metrics])  # one row
    each = _in_events(df.select(ts, *metrics), events, ts).groupBy("_s", "_e").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])
    means = _to_events(events, each, "name").filter("n IS NOT NULL").join(F.broadcast(s), F.lit(True))
    z = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.try_divide(F.col(m) - F.col(f"_m_{m}"), F.col(f"_d_{m}")).alias("z")) for m in metrics])).alias("c")
    out = means.select("name", "n", z).select("name", "n", "c.*")
    return out.withColumn("direction", F.when(F.col("z") < -1, "down").when(F.col("z") > 1, "up").otherwise("flat"))


def leaf_profile(df: DataFrame, events: DataFrame, ts: str, leaf: str, value: str) -> DataFrame:
    """(name, leaf, n, first, mean, most): how a leaf's value goes during an event; events of one
    name have rows of their own."""
    rows = _in_events(df.select(ts, leaf, value), events, ts)
    each = rows.groupBy("_s", "_e", leaf).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, ts).alias("first"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    return _to_events(events, each, "name").filter("n IS NOT NULL").select("name", leaf, "n", "first", "mean", "most")


def regime_verdict(exceedance: DataFrame, regime: str, leaf: str, rate: str, busy: str = "ACTIVE", quiet: str = "QUIET", factor: float = 2.0) -> DataFrame:
    """(leaf, busy, quiet, verdict): the rates of the two regimes side by side; busy if that of the
    busy regime is more than factor times the other's, quiet the other way, else even."""
    w = exceedance.groupBy(leaf).pivot(regime, [busy, quiet]).agg(F.first(rate))
    a, b = F.coalesce(F.col(busy), F.lit(0.0)), F.coalesce(F.col(quiet), F.lit(0.0))
    return w.select(leaf, a.alias("busy"), b.alias("quiet"), F.when(a > factor * b, "busy").when(b > factor * a, "quiet").otherwise("even").alias("verdict"))


def previous_row(df: DataFrame, by: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """df with the values of the row at the same position of the series before (row alignment)."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({f"{v}_before": F.lag(v).over(w) for v in values})
