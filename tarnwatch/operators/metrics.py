"""Evaluation: confusion counts and what follows from them, episodes, ranks, range metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(y: Column, p: Column) -> list[Column]:
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return [one((y == 1) & (p == 1)).alias("tp"), one((y == 0) & (p == 1)).alias("fp"), one((y == 0) & (p == 0)).alias("tn"), one((y == 1) & (p == 0)).alias("fn")]


def with_rates(df: DataFrame) -> DataFrame:
    """df with tp, fp, tn, fn gets precision, recall, fpr, f1, f1_neg, f1_macro, accuracy, mcc."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    f1, f1n = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    mcc = ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn), "f1": f1, "f1_neg": f1n, "f1_macro": (f1 + f1n) / 2, "accuracy": ratio(tp + tn, tp + tn + fp + fn), "mcc": mcc})


def sweep(df: DataFrame, thresholds: Sequence[float], score: str = "score", y: str = "y") -> DataFrame:
    """Rates at every threshold. A row counts once, in the bucket of the stated thresholds that its
    score reaches; the buckets then add up from above. Rows with a null label or score count
    nowhere."""
    cuts = sorted({float(t) for t in thresholds})
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda t: t <= F.col(score)))
    one = lambda v: F.sum((F.col(y) == v).cast("long"))
    counts = df.filter(F.col(score).isNotNull() & F.col(y).isin(0, 1)).groupBy(reached.alias("_b")).agg(one(1).alias("_p"), one(0).alias("_n"))
    packed = counts.agg(F.collect_list(F.struct("_b", "_p", "_n")).alias("_l"))  # as many entries as thresholds
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i).alias("i")) for i, t in enumerate(cuts)])).alias("c")
    total = lambda field, over: F.aggregate(F.filter("_l", lambda x: (x["_b"] > F.col("i")) if over else (x["_b"] <= F.col("i"))), F.lit(0).cast("long"), lambda a, x: a + x[field])
    rows = packed.filter(F.size("_l") > 0).select("_l", at).select("_l", "c.*")
    return with_rates(rows.select("threshold", total("_p", True).alias("tp"), total("_n", True).alias("fp"), total("_n", False).alias("tn"), total("_p", False).alias("fn")))


def best_row(df: DataFrame, by: str, tie: str) -> DataFrame:
    """The row of the largest value, of equals that of the smallest tie."""
    return df.orderBy(F.col(by).desc(), tie).limit(1)


def attack_summary(df: DataFrame, catalog: DataFrame, ts: str, score: str, threshold: float) -> DataFrame:
    """One row for each row of catalog (name, start, end): n, n_detected, coverage, ttd_s, max and
    mean score. An event without rows has n 0 and nulls; events of one name stay apart."""
    from .joins import interval_join

    hit = F.col(score) >= threshold
    spans = catalog.select("start", "end", F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    joined = interval_join(df.select(ts, score), ts, spans, ["_s", "_e"])
    first = F.min(F.when(hit, micros(ts) - micros("_s"))) / 1e6
    sums = joined.groupBy("_s", "_e").agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("long")).alias("n_detected"), F.avg(hit.cast("double")).alias("coverage"), first.alias("ttd_s"), F.max(score).alias("max_score"), F.avg(score).alias("mean_score"))
    out = catalog.select("name", "start", "end").join(sums, (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")), "left")
    return out.select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_detected", F.lit(0)).alias("n_detected"), "coverage", "ttd_s", "max_score", "mean_score")


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, p_observed, p_expected, kappa; null labels count as one label."""
    x, y = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (a, b))
    pairs = df.groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"))  # labels squared at most
    n = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left, right = (pairs.groupBy(F.col(c).alias("k")).agg(F.sum("n").alias(c + "n")) for c in ("x", "y"))
    cross = left.join(right, "k").agg(F.sum(F.col("xn").cast("double") * F.col("yn")).alias("cross"))
    out = n.crossJoin(F.broadcast(cross))
    po, pe = F.col("same") / F.col("n"), F.coalesce("cross", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return out.select("n", po.alias("p_observed"), pe.alias("p_expected"), F.when(pe < 1, F.try_divide(po - pe, 1 - pe)).otherwise(1.0).alias("kappa"))


def mcnemar(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """One row: n00, n01, n10, n11 by correctness, and the continuity-corrected statistic."""
    ca, cb = (F.col(c) == F.col(y) for c in (a, b))
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    out = df.agg(count(~ca & ~cb, "n00"), count(~ca & cb, "n01"), count(ca & ~cb, "n10"), count(ca & cb, "n11"))
    d = F.abs(F.col("n01") - F.col("n10")) - 1
    return out.withColumn("chi2", ratio(F.greatest(d, F.lit(0)) * F.greatest(d, F.lit(0)), F.col("n01") + F.col("n10")))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, z2 = ratio(k, n), z * z
    centre, spread = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(centre - spread, F.lit(0.0)), F.least(centre + spread, F.lit(1.0))


def agresti_coull(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    m = n + z * z
    p = (k + z * z / 2) / m
    spread = z * F.sqrt(p * (1 - p) / m)
    return F.greatest(p - spread, F.lit(0.0)), F.least(p + spread, F.lit(1.0))


def bayes_ppv(tpr: Column, fpr: Column, rate: Column) -> Column:
    return ratio(tpr * rate, tpr * rate + fpr * (1 - rate))


def required_fpr(ppv: Column, tpr: Column, rate: Column) -> Column:
    return F.try_divide(tpr * rate * (1 - ppv), ppv * (1 - rate))


def required_tpr(ppv: Column, fpr: Column, rate: Column) -> Column:
    return F.try_divide(ppv * fpr * (1 - rate), rate * (1 - ppv))


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """Counts at each distinct score; what follows orders these, not the rows."""
    return df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))


#: Ranges that a running sum is cut into at most: each row is compared with that many bounds.
MOST_RANGES = 1000


def running(df: DataFrame, order: str, columns: Sequence[str], descending: bool = False) -> DataFrame:
    """df with run_<c> for each column: the sum over all rows of the table up to this one.

    No task holds the whole order: rows meet in ranges between approximate quantiles of the
    order (one row or less for each shuffle partition comes to the driver), and the totals of
    the ranges before, as few rows, are broadcast and added. The order is a number; its values
    are distinct, nulls lie at the low end, NaN at the high end.
    """
    ranges = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    cuts = sorted(set(df.select(F.col(order).cast("double")).approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.5 / ranges))) if ranges > 1 else []
    bounds = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    df = df.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col(order))))
    way = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    ahead = Window.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    before = totals.select("_range", *[F.coalesce(F.sum(f"_sum_{c}").over(ahead), F.lit(0)).alias(f"_before_{c}") for c in columns])
    own = Window.partitionBy("_range").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(F.broadcast(before), "_range").withColumns({f"run_{c}": F.col(f"_before_{c}") + F.sum(c).over(own) for c in columns})
    return out.drop("_range", *[f"_before_{c}" for c in columns])


def running_by(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], ranges: int = 64) -> DataFrame:
    """df with run_<c> for each column: the sum over the rows of the same key up to this one, as
    running() has it for a whole table. Each key is cut into ranges at approximate quantiles of the
    order, so that a key of very many rows is ordered by as many tasks; the order's values are
    distinct within a key."""
    cuts = df.groupBy(*by).agg(F.percentile_approx(F.col(order).cast("double"), [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts"))
    df = df.join(cuts, list(by)).withColumn("_range", F.size(F.filter("_cuts", lambda b: b < F.col(order)))).drop("_cuts")
    totals = df.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])  # ranges rows a key
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_sum_{c}").over(ahead), F.lit(0)).alias(f"_before_{c}") for c in columns])
    own = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(before, [*by, "_range"]).withColumns({f"run_{c}": F.col(f"_before_{c}") + F.sum(c).over(own) for c in columns})
    return out.drop("_range", *[f"_before_{c}" for c in columns])


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row with auc: tie-aware, from the counts at distinct scores; null if one class lacks."""
    c = running(_by_score(df, y, score).withColumn("neg", F.col("n") - F.col("pos")), "s", ["neg"])
    hits = F.sum(F.col("pos") * (F.col("run_neg") - F.col("neg") / 2))
    return c.agg(F.try_divide(hits.cast("double"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    c = running(_by_score(df, y, score), "s", ["pos", "n"], descending=True)
    return c.agg(F.try_divide(F.sum(F.col("pos") * F.col("run_pos") / F.col("run_n")), F.sum("pos").cast("double")).alias("ap"))


def threshold_at_most(df: DataFrame, score: str, target: float) -> DataFrame:
    """One row: the smallest score that at most the target share of rows reach."""
    c = running(df.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n")), "s", ["n"], descending=True)
    n = df.agg(F.count(F.lit(1)).alias("m"), F.max(score).alias("top"))
    fits = c.crossJoin(F.broadcast(n)).groupBy().agg(F.min(F.when(F.col("run_n") <= target * F.col("m"), F.col("s"))).alias("t"), F.max("top").alias("top"))
    return fits.select(F.coalesce("t", F.col("top") + F.greatest(F.abs("top"), F.lit(1.0)) * 2.220446049250313e-16).alias("threshold"))


def best_cut(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: the score of the largest recall less false-positive rate (of equals the
    largest score), and that difference; none if one class lacks."""
    c = running(_by_score(df, y, score).withColumn("neg", F.col("n") - F.col("pos")), "s", ["pos", "neg"], descending=True)
    n = c.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))  # one row
    gap = F.try_divide(F.col("run_pos").cast("double"), F.col("_p")) - F.try_divide(F.col("run_neg").cast("double"), F.col("_q"))
    return c.crossJoin(F.broadcast(n)).select(F.col("s").alias("threshold"), gap.alias("youden")).filter("youden IS NOT NULL").orderBy(F.desc("youden"), F.desc("threshold")).limit(1)


def existence_recall(df: DataFrame, by: Sequence[str], order: str, y: str, p: str) -> DataFrame:
    """One row: the runs of y = 1, those with a row of p = 1, and their share."""
    w = Window.partitionBy(*by).orderBy(order)
    truth = df.withColumn("_n", F.row_number().over(w)).filter(F.col(y) == 1)
    truth = truth.withColumn("_run", F.col("_n") - F.row_number().over(w))
    hit = truth.groupBy(*by, "_run").agg(F.max((F.col(p) == 1).cast("long")).alias("_hit"))
    out = hit.agg(F.count(F.lit(1)).alias("n_runs"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("n_hit"))
    return out.withColumn("recall", ratio(F.col("n_hit"), F.col("n_runs")))


def rates_by(df: DataFrame, keys: Sequence[str], y: Column, p: Column) -> DataFrame:
    """Confusion counts and rates of each key alone, such as of each leaf."""
    return with_rates(df.groupBy(*keys).agg(*confusion(y, p)))


def window_scores(df: DataFrame, win: str, score: str, weight: str, vote: float) -> DataFrame:
    """Scores without opinions of each window over its leaves (a stated, small set): mean, max,
    mean of the three largest, weighted mean and share of leaves from vote on. Null scores
    count nowhere; without a score the row is null, without a weight weighted is zero."""
    s, w = F.col(score), F.when(F.col(score).isNotNull(), F.col(weight))
    top = F.slice(F.sort_array(F.collect_list(score), False), 1, 3)
    return df.groupBy(win).agg(
        F.avg(s).alias("mean"), F.max(s).alias("max"), F.try_divide(F.aggregate(top, F.lit(0.0), lambda a, x: a + x), F.size(top)).alias("top3"),
        ratio(F.sum(w * s), F.sum(w)).alias("weighted"), F.avg((s >= vote).cast("double")).alias("votes"),
    )


def range_auc(df: DataFrame, by: Sequence[str], order: str, y: str, score: str, rows: int, kind: str = "roc") -> DataFrame:
    from .timeseries import dilate

    wide = dilate(df, by, order, y, reach=rows)
    return roc_auc(wide, "dilated", score) if kind == "roc" else average_precision(wide, "dilated", score)


def vus(df: DataFrame, by: Sequence[str], order: str, y: str, score: str, most: int, steps: int = 11, kind: str = "roc") -> DataFrame:
    """One row: the area under range AUC over buffers 0..most by the trapezoid rule, over the span.

    Each row gets its distance to the nearest true row once, by two window functions; a buffer's
    labels follow from it. Counts at each distinct score hold one number for each buffer, so one
    order serves all of them."""
    buffers = sorted({round(most * i / (steps - 1)) for i in range(steps)})
    w = Window.partitionBy(*by).orderBy(order)
    at = df.select(*by, order, score, y).withColumn("_i", F.row_number().over(w)).withColumn("_y", F.when(F.col(y) == 1, F.col("_i")))
    far = F.least(F.col("_i") - F.last("_y", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("_y", True).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("_i"))
    near = at.select(F.col(score).alias("s"), F.coalesce(far, F.lit(buffers[-1] + 1)).alias("_far"))
    names = [f"p{i}" for i in range(len(buffers))]
    counts = near.groupBy("s").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("_far") <= b).cast("long")).alias(p) for b, p in zip(buffers, names, strict=True)])
    upto = running(counts, "s", ["n", *names], descending=kind != "roc")
    if kind == "roc":
        value = lambda p: F.try_divide(F.sum(F.col(p) * ((F.col("run_n") - F.col(f"run_{p}")) - (F.col("n") - F.col(p)) / 2)).cast("double"), (F.sum(p) * (F.sum("n") - F.sum(p))).cast("double"))
    else:
        value = lambda p: F.try_divide(F.sum(F.col(p) * F.col(f"run_{p}") / F.col("run_n")), F.sum(p).cast("double"))
    one = upto.agg(*[value(p).alias(p) for p in names])
    all_ = one.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("b"), F.col(p).alias("v")) for b, p in zip(buffers, names, strict=True)])).alias("r")).select("r.*")
    w = Window.orderBy("b")  # steps rows
    areas = all_.withColumn("area", (F.col("v") + F.lag("v").over(w)) / 2 * (F.col("b") - F.lag("b").over(w)))
    return areas.agg((F.sum("area") / (buffers[-1] - buffers[0]) if len(buffers) > 1 else F.first("v")).alias(f"vus_{kind}"))


def entropy(p: Column) -> Column:
    """Of an array of weights, over log2 of its length; uniform if they sum to zero."""
    s = F.aggregate(p, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    h = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / s * F.log2(x / s)).otherwise(0.0))
    return F.when(s <= 1e-12, 1.0).otherwise(h / F.log2(F.size(p).cast("double")))
