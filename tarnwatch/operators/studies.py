"""Studies: the same plan over a dimension of settings, on given or on synthetic tables. A setting is
a column, so one job covers all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as D
from . import attribution as A
from . import metrics as M
from .qualification import top_by_trial

#: Laws of the noise on signatures.
LAWS = ("normal", "student", "cauchy")
#: How an attack changes metrics in synthetic tables, in deviations: fixed values.
KINDS = {"volumetric": 4.0, "subtle": 1.0, "slowloris": 0.5}


def synthetic_pair(spark: SparkSession, n_train: int = 2880, n_test: int = 1440, n_metrics: int = 5, kind: str = "volumetric", severity: float = 1.0, seed: int = 0) -> DataFrame:
    """i, train, y, clean_0.. and m_0..: normal noise with a daily wave, and the same with an attack
    in the middle tenth of the test rows. Equal seeds give equal tables on equal partitions."""
    wave = 0.5 * F.sin(2 * 3.141592653589793 * F.col("i") / 288)
    df = spark.range(n_train + n_test).select(F.col("id").alias("i"))
    middle, width = n_train + n_test // 2, max(1, n_test // 20)
    df = df.withColumns({"train": F.col("i") < n_train, "y": F.col("i").between(middle - width, middle + width - 1).cast("int")})
    df = df.withColumns({f"clean_{k}": wave + F.randn(seed * 1000 + k) for k in range(n_metrics)})
    return df.withColumns({f"m_{k}": F.col(f"clean_{k}") + F.col("y") * (KINDS[kind] * severity / (k + 1)) for k in range(n_metrics)})


def correlated_residuals(spark: SparkSession, n: int = 5000, groups: Sequence[str] = ("forecast", "reconst"), each: int = 3, leakage: float = 0.4, seed: int = 0) -> DataFrame:
    """i and <group>_<k>: residuals that share a factor within a group and, by the leakage, one
    across groups."""
    df = spark.range(n).select(F.col("id").alias("i"), F.randn(seed).alias("_all"), *[F.randn(seed + 1 + g).alias(f"_g{g}") for g in range(len(groups))])
    cols = {}
    for g, name in enumerate(groups):
        for k in range(each):
            cols[f"{name}_{k}"] = leakage * F.col("_all") + (1 - leakage) * F.col(f"_g{g}") + 0.5 * F.randn(seed + 100 + 10 * g + k)
    return df.withColumns(cols).select("i", *cols)


def signature_noise(groups: DataFrame, templates: DataFrame, win: str, truth: str, sigmas: Sequence[float], repetitions: int, seed: int = 1, law: str = "normal", degrees: float = 3.0) -> DataFrame:
    """(sigma, n, accuracy): how often the best type is still the true one when the group states
    p_safe, p_susp, p_atk get noise of each size, cut at zero and scaled to one. Its law is normal,
    student (t of the stated degrees of freedom) or cauchy, all at the same scale; it is drawn by hash
    of the keys, so a repeated task draws the same. A group whose states all fall to zero keeps them."""
    if law not in LAWS:
        raise ValueError(f"unknown law {law}; known: {LAWS}")
    cells = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("sigma"), F.lit(r).alias("rep")) for s in sigmas for r in range(repetitions)])).alias("_c")
    rows = groups.select("*", cells).select(win, "grp", truth, *[f"p_{s}" for s in A.STATES], "_c.sigma", "_c.rep")

    def deviate(k: int) -> Column:
        u, v = (D.uniform(win, "grp", "sigma", "rep", F.lit(seed), F.lit(2 * k + i)) for i in (0, 1))
        return D.normal_deviate(u, v) if law == "normal" else D.student_deviate(u, v, degrees) if law == "student" else D.cauchy_deviate(u)

    moved = [F.greatest(F.col(f"p_{s}") + F.col("sigma") * deviate(k), F.lit(0.0)).alias(f"_{s}") for k, s in enumerate(A.STATES)]
    rows = rows.select("*", *moved)
    total = F.col("_safe") + F.col("_susp") + F.col("_atk")
    rows = rows.select(win, "grp", truth, "sigma", "rep", *[F.when(total > 1e-12, F.try_divide(F.col(f"_{s}"), total)).otherwise(F.col(f"p_{s}")).alias(f"p_{s}") for s in A.STATES])
    key = F.concat_ws("|", F.col(win).cast("string"), "sigma", "rep")
    flat = rows.withColumn("_win", key)
    top = top_by_trial(flat, templates.withColumn("trial", F.lit(0)), "_win").select("_win", "top1_type")
    each = flat.groupBy("_win", "sigma").agg(F.max(truth).alias("_truth")).join(top, "_win")
    return each.groupBy("sigma").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_truth") == F.col("top1_type")).cast("double")).alias("accuracy"))


def attacked(df: DataFrame, train: Column, hit: Column, metrics: Sequence[str], kind: str, severity: float) -> DataFrame:
    """df with y, and its metrics raised where hit holds: by the kind's deviations of the training
    rows, each further metric by less."""
    y = F.coalesce(hit, F.lit(False)).cast("int")
    scale = df.filter(train).agg(*[F.coalesce(F.stddev_pop(m), F.lit(0.0)).alias(f"_d_{m}") for m in metrics])  # one row
    out = df.withColumn("y", y).join(F.broadcast(scale), F.lit(True))
    return out.withColumns({m: F.col(m) + F.col("y") * F.col(f"_d_{m}") * (KINDS[kind] * severity / (k + 1)) for k, m in enumerate(metrics)}).drop(*[f"_d_{m}" for m in metrics])


def severity_study(df: DataFrame, train: Column, hit: Column, metrics: Sequence[str], kinds: Sequence[str] = tuple(KINDS), severities: Sequence[float] = (0.5, 1.0, 2.0), limit: float = 3.0) -> DataFrame:
    """(kind, severity, f1, f1_trivial, trivial, ks, p, realism): for each setting an attack is put
    into the rows of df after training where hit holds. A detector over all metrics (their summed
    deviations beyond the limit) is held against one over the first alone; ks says how far the
    first one's distribution moves, p how likely that is by chance, and realism what follows: weak
    (p over 0.05), outlier (ks over 0.9), else realistic."""
    from .audit import ks_distance
    from .evaluation import triviality

    out = None
    for kind in kinds:  # stated settings
        for s in severities:
            rows = attacked(df, train, ~train & hit, metrics, kind, s)
            scale = rows.filter(train).agg(*[F.avg(m).alias(f"_m_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"_d_{m}") for m in metrics])  # one row
            size = sum((F.coalesce(F.abs(F.try_divide(F.col(m) - F.col(f"_m_{m}"), F.col(f"_d_{m}"))), F.lit(0.0)) for m in metrics), F.lit(0.0))
            rows = rows.join(F.broadcast(scale), F.lit(True)).withColumn("p", (size > limit).cast("int")).drop(*[f"_{x}_{m}" for x in "md" for m in metrics])
            t = triviality(rows, "y", "p", [metrics[0]], train)
            ks = ks_distance(rows.filter(~train), metrics[0], F.col("y") == 1)
            part = t.join(ks, F.lit(True)).select(F.lit(kind).alias("kind"), F.lit(float(s)).alias("severity"), "f1", "f1_trivial", "trivial", "ks", "p")  # one row each
            out = part if out is None else out.unionByName(part)
    return out.withColumn("realism", F.when(F.col("p") > 0.05, "weak").when(F.col("ks") > 0.9, "outlier").otherwise("realistic"))


def smoothing_study(df: DataFrame, key: str, order: str, states: Sequence[str], truth: str, transition: Sequence[Sequence[float]]) -> DataFrame:
    """One row: n, accuracy of the best state as it is, and after smoothing."""
    from .ageing import smooth

    def best(columns: Sequence[str]) -> Column:
        top = F.greatest(*[F.col(c) for c in columns])
        return F.coalesce(*[F.when(F.col(c) == top, F.lit(s)) for c, s in zip(columns, states, strict=True)])

    after = smooth(df.select(key, order, *states), key, order, states, transition)
    both = df.select(key, order, truth, best(states).alias("_a")).join(after.select(key, order, best([f"smooth_{s}" for s in states]).alias("_b")), [key, order])
    right = lambda c: F.avg((F.col(c) == F.col(truth)).cast("double"))
    return both.agg(F.count(F.lit(1)).alias("n"), right("_a").alias("accuracy"), right("_b").alias("accuracy_smooth"))


def run_seeds(build, seeds: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """(metric, n, mean, std, low, high) over runs: build(seed) gives a table of one row."""
    from .audit import over_runs

    out = None
    for s in seeds:  # stated seeds, planned as one job
        row = build(s).select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("r")).select("r.*")
        out = row if out is None else out.unionByName(row)
    return over_runs(out, "metric", "value")


def variants(df: DataFrame, y: str, scores: dict[str, Column], thresholds: Sequence[float]) -> DataFrame:
    """(run, threshold, tp, fp, tn, fn and rates) of several ways to score the same rows: an ablation.
    A row counts once for each way, in the bucket of thresholds that its score reaches."""
    cuts = sorted({float(t) for t in thresholds})
    way = F.explode(F.array(*[F.struct(F.lit(n).alias("run"), c.cast("double").alias("score")) for n, c in scores.items()])).alias("w")
    rows = df.select(F.col(y).alias("y"), way).select("y", "w.*").filter("score IS NOT NULL AND y IN (0, 1)")
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda t: t <= F.col("score")))
    counts = rows.groupBy("run", "y", reached.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i).alias("i")) for i, t in enumerate(cuts)])).alias("c")
    cells = counts.select("run", "y", "b", "n", at).select("run", "y", "n", "c.threshold", (F.col("b") > F.col("c.i")).alias("p"))
    one = lambda yy, pp: F.coalesce(F.sum(F.when((F.col("y") == yy) & (F.col("p") == pp), F.col("n"))), F.lit(0))
    return M.with_rates(cells.groupBy("run", "threshold").agg(one(1, True).alias("tp"), one(0, True).alias("fp"), one(0, False).alias("tn"), one(1, False).alias("fn")))


def lost_window_rates(evidence: DataFrame, win: str, y: str, draw: Column, shares: Sequence[float], delta: float, mode: str = "wbf") -> DataFrame:
    """(share, tp, fp, tn, fn and rates): how well fused decisions stand up to lost windows. Of the rows
    (win, leaf, ev_p, ev_s, ev_n, y) those without an attack whose draw, in [0, 1), is below the share
    lose their evidence; leaves are fused for each share and a window alarms from delta on."""
    from ..functions import opinions as O
    from .fusion import fuse

    at = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    rows = evidence.select("*", draw.alias("_draw"), at)
    lost = (F.col(y) == 0) & (F.col("_draw") < F.col("share"))
    ev = tuple(F.when(lost, 0.0).otherwise(F.col(c)) for c in ("ev_p", "ev_s", "ev_n"))
    op = rows.select(win, "leaf", "share", F.col(y).alias("_y"), *O.from_evidence(ev).columns())
    system = fuse(op, [win, "share", "_y"], mode).select("share", "_y", (O.Opinion.of().projected()[2] >= delta).cast("int").alias("_p"))
    return M.rates_by(system, ["share"], F.col("_y"), F.col("_p"))


def recalibrated_modes(opinions: DataFrame, win: str, y: str, calibration: Column, modes: Sequence[str], fpr: float = 0.05) -> DataFrame:
    """(mode, delta, tp, fp, tn, fn and rates): each way of fusing is judged at a threshold of its own,
    the 1 - fpr quantile of its scores over the calibration windows without an attack; rates are those
    of the other windows."""
    from ..functions import opinions as O
    from .calibration import quantiles
    from .fusion import fuse

    rows = opinions.withColumn("_calib", calibration)
    scores = None
    for mode in modes:  # stated modes
        part = fuse(rows, [win, y, "_calib"], mode).select(F.lit(mode).alias("mode"), y, "_calib", O.Opinion.of().projected()[2].alias("_score"))
        scores = part if scores is None else scores.unionByName(part)
    cut = quantiles(scores.filter(F.col("_calib") & (F.col(y) == 0)), ["mode"], "_score", [1 - fpr]).select("mode", F.col("q0").alias("delta"))
    judged = scores.filter(~F.col("_calib")).join(cut, "mode")
    return M.rates_by(judged, ["mode", "delta"], F.col(y), (F.col("_score") >= F.col("delta")).cast("int"))
