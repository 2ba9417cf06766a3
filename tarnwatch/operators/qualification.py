"""Naming the cause of an alarm: gate, types, novelty, status; and how good the names are.

A window is qualified from the scores of its groups against each type's template. Everything
but the temporal prior is a partial aggregate by window; the prior is a fold by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros
from . import attribution as A
from .ageing import fold
from .calibration import quantiles
from .joins import interval_join, small_side
from .metrics import ratio
from .segments import meet

#: Statuses of a window: fixed values.
CLOSED, NO_GROUPS, NOVEL, QUALIFIED = "normal", "no_groups", "autre_anomalie", "qualified"


def maximised(beliefs: DataFrame, win: str, b: str = "b", u: str = "u") -> DataFrame:
    """beliefs (win, type, b, u) with b_um and u_um: the same projection, base rate 1/K, with the
    largest uncertainty."""
    w = Window.partitionBy(win)
    k = F.count(F.lit(1)).over(w).cast("double")
    df = beliefs.withColumn("_k", k).withColumn("_p", F.col(b) + F.col(u) / F.col("_k"))
    df = df.withColumn("u_um", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min(F.col("_p") * F.col("_k")).over(w))))
    return df.withColumn("b_um", F.greatest(F.col("_p") - F.col("u_um") / F.col("_k"), F.lit(0.0))).drop("_k", "_p")


def novelty_ratio(evidence: DataFrame, win: str, value: str = "evidence") -> DataFrame:
    """(win, novelty_lr): mean over max of the types' evidence; one where all is zero."""
    return evidence.groupBy(win).agg(F.coalesce(F.try_divide(F.avg(value), F.max(value)), F.lit(1.0)).alias("novelty_lr"))


def qualify(system: DataFrame, scores: DataFrame, win: str, delta: float, novelty: float = 0.82, scale: float = 3.0, p: str = "proj_atk") -> DataFrame:
    """One row for each window of system (win, p): gate_open, qual_status, top1_type, top1_b,
    top1_proj, u_raw, u and novelty_lr. scores is (win, type, type_idx, grp, score); a window
    without scores has no groups, and u 1. A null p keeps the gate closed."""
    b = A.beliefs(scores, win, scale)
    best = F.max_by("type", F.struct(F.col("b_um"), -F.col("type_idx")))
    top = b.groupBy(win).agg(
        best.alias("_type"), F.max("b_um").alias("_b"), F.first("u").alias("_raw"), F.first("u_um").alias("_um"), F.count(F.lit(1)).alias("_k"),
        F.coalesce(F.try_divide(F.avg("evidence"), F.max("evidence")), F.lit(1.0)).alias("_lr"),
    )
    open_ = F.coalesce(F.col(p) >= delta, F.lit(False))
    df = system.select(win, F.col(p), open_.alias("gate_open")).join(top, win, "left")
    named = F.col("gate_open") & F.col("_k").isNotNull()
    status = F.when(~F.col("gate_open"), CLOSED).when(F.col("_k").isNull(), NO_GROUPS).when(F.col("_raw") > novelty, NOVEL).otherwise(QUALIFIED)
    full = lambda c: F.when(F.col("gate_open"), F.coalesce(c, F.lit(1.0)))
    return df.select(
        win, p, "gate_open", status.alias("qual_status"), F.when(named, F.col("_type")).alias("top1_type"), F.when(named, F.col("_b")).alias("top1_b"),
        F.when(named, F.col("_b") + F.col("_um") / F.col("_k")).alias("top1_proj"), full(F.col("_raw")).alias("u_raw"), full(F.col("_um")).alias("u"), full(F.col("_lr")).alias("novelty_lr"),
    )


def with_memory(beliefs_wide: DataFrame, key: str, order: str, types: Sequence[str], gate: str, transition: Sequence[Sequence[float]], decay: float = 0.9, share: float = 0.3) -> DataFrame:
    """key, order and the types' beliefs and u after the temporal prior. The last opinion behind an
    open gate is moved by the transition, discounted by decay to the power of the windows since
    then, and averaged in with the share. Windows with a closed gate give nulls and count as one
    window each. beliefs_wide holds the types' beliefs, u and the gate (0 or 1)."""
    n = len(types)

    def step(state: list[float], now: list[float]) -> tuple[list[float], list[float | None]]:
        *b, u, open_ = now
        if not open_:
            return ([*state[:-1], state[-1] + 1] if state else state), [None] * (n + 1)
        b, u = [x or 0.0 for x in b], 1.0 if u is None else u
        if state:
            d = decay ** state[-1]
            moved = [d * sum(transition[i][j] * state[i] for i in range(n)) for j in range(n)]
            before = 1 - d * (1 - state[n])
            b = [(1 - share) * x + share * m for x, m in zip(b, moved, strict=True)]
            u = (1 - share) * u + share * before
        return [*b, u, 1.0], [*b, u]

    return fold(beliefs_wide, key, order, [*types, "u", gate], list, step, [*[f"{t}_prior" for t in types], "u_prior"])


def qualified(df: DataFrame) -> Column:
    """Rows that carry a name: gate open and groups present. A table without qual_status counts
    every open gate, one without gate_open none."""
    if "gate_open" not in df.columns:
        return F.lit(False)
    open_ = F.coalesce(F.col("gate_open"), F.lit(False))
    return open_ & (F.coalesce(F.col("qual_status"), F.lit("")) != NO_GROUPS) if "qual_status" in df.columns else open_


def split_rows(df: DataFrame) -> DataFrame:
    """df with part: qualified, no_groups or closed, one of the three for each row."""
    none = F.coalesce(F.col("gate_open"), F.lit(False)) if "gate_open" in df.columns else F.lit(False)
    return df.withColumn("part", F.when(qualified(df), "qualified").when(none, "no_groups").otherwise("closed"))


def metrics_by_attack(df: DataFrame, catalog: DataFrame, ts: str, closed: bool = False, beta: float = 2.0) -> DataFrame:
    """For each attack of catalog (name, expected, start, end): n windows, n_detected (open
    gates), n_qualified, n_correct, dr, qp, f1, fb (beta), ttq_min (minutes to the first correct
    name). df is a table as qualify() gives. Attacks without windows have zeros. closed counts
    the end as inside too, as older tables do."""
    cat = catalog.select("name", "expected", "start", "end")
    spans = cat.select("expected", "start", "end", F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    rows = interval_join(df.withColumn("_q", qualified(df)), ts, spans, ["expected", "_s", "_e"], "inner", closed)
    rows = rows.select("expected", "_s", "_e", ts, F.coalesce(F.col("gate_open"), F.lit(False)).alias("_open"), "_q", (F.col("_q") & F.coalesce(F.col("top1_type") == F.col("expected"), F.lit(False))).alias("_ok"))
    one = lambda c: F.sum(c.cast("long"))
    sums = rows.groupBy("expected", "_s", "_e").agg(F.count(F.lit(1)).alias("n"), one(F.col("_open")).alias("n_detected"), one(F.col("_q")).alias("n_qualified"), one(F.col("_ok")).alias("n_correct"), F.min(F.when(F.col("_ok"), micros(ts))).alias("_first"))
    out = meet(cat.withColumns({"_s": F.col("start"), "_e": F.col("end")}), sums, ["expected", "_s", "_e"]).na.fill(0, ["n", "n_detected", "n_qualified", "n_correct"])
    out = out.withColumn("dr", ratio(F.col("n_detected"), F.col("n"))).withColumn("qp", ratio(F.col("n_correct"), F.col("n_qualified")))
    return out.select("name", "expected", "n", "n_detected", "n_qualified", "n_correct", "dr", "qp", *_f("dr", "qp", beta), ((F.col("_first") - micros("start")) / 6e7).alias("ttq_min"))


def _f(dr: str, qp: str, beta: float) -> list[Column]:
    d, q = F.col(dr), F.col(qp)
    return [ratio(2 * d * q, d + q).alias("f1"), ratio((1 + beta**2) * d * q, beta**2 * d + q).alias("fb")]


def summary(attacks: DataFrame, beta: float = 2.0) -> DataFrame:
    """Two rows: macro (attacks weigh the same) and micro (windows do) dr, qp, f1, fb."""
    macro = attacks.agg(F.lit("macro").alias("kind"), *[F.avg(c).alias(c) for c in ("dr", "qp", "f1", "fb")])
    t = attacks.agg(*[F.sum(c).alias(c) for c in ("n", "n_detected", "n_correct")])
    micro = t.select(F.lit("micro").alias("kind"), ratio(F.col("n_detected"), F.col("n")).alias("dr"), ratio(F.col("n_correct"), F.col("n_detected")).alias("qp"))
    return macro.unionByName(micro.select("kind", "dr", "qp", *_f("dr", "qp", beta)))


def type_performance(df: DataFrame, truth: str = "expected", named: str = "top1_type") -> DataFrame:
    """type, n (rows of that truth), n_named, tp, recall, precision over qualified rows."""
    rows = df.filter(qualified(df)).select(F.col(truth).alias("t"), F.col(named).alias("p"))
    pairs = rows.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))  # types squared
    sides = pairs.select(F.col("t").alias("type"), "n", F.lit(0).alias("named"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")).unionByName(pairs.select(F.col("p").alias("type"), F.lit(0).cast("long").alias("n"), F.col("n").alias("named"), F.lit(0).cast("long").alias("tp")))
    out = sides.filter("type IS NOT NULL").groupBy("type").agg(F.sum("n").alias("n"), F.sum("named").alias("n_named"), F.sum("tp").alias("tp"))
    return out.withColumns({"recall": ratio(F.col("tp"), F.col("n")), "precision": ratio(F.col("tp"), F.col("n_named"))})


def novelty_auc(df: DataFrame, novel: str, value: str) -> DataFrame:
    """One row: auc of the value for rows of novel attacks (1) against known ones (0), and the
    threshold of the largest recall less false-positive rate; for reports, not for tuning."""
    from .metrics import best_cut, roc_auc

    rows = df.filter(F.col(novel).isin(0, 1) & F.col(value).isNotNull())
    return roc_auc(rows, novel, value).join(best_cut(rows, novel, value), F.lit(True), "left")  # one row each


def perturbed(templates: DataFrame, by: float = 0.05) -> DataFrame:
    """templates with trial: each of the three states moved by +-by in turn, cut at zero; the
    states of a trial are scaled to one where they are scored. Trial 0 is the table itself."""
    moves = [(0.0, 0.0, 0.0), *[tuple(s * by if i == k else 0.0 for i in range(3)) for k in range(3) for s in (1, -1)]]
    trial = F.explode(F.array(*[F.struct(F.lit(i).alias("trial"), *[F.lit(float(m)).alias(f"d_{s}") for m, s in zip(move, A.STATES, strict=True)]) for i, move in enumerate(moves)])).alias("_t")
    df = templates.select("*", trial)
    return df.select("type", "type_idx", "grp", "_t.trial", *[F.greatest(F.col(f"c_{s}") + F.col(f"_t.d_{s}"), F.lit(0.0)).alias(f"c_{s}") for s in A.STATES])


def top_by_trial(groups: DataFrame, templates: DataFrame, win: str, trial: str = "trial") -> DataFrame:
    """(trial, win, top1_type, evidence) for templates of several trials; the stated templates
    are few and multiply the rows of a window, not the windows with each other."""
    t = templates.select("type", "type_idx", "grp", trial, *[F.col(f"c_{s}") for s in A.STATES])
    total = F.col("c_safe") + F.col("c_susp") + F.col("c_atk")
    score = sum((F.col(f"p_{s}") * F.when(total > 0, F.try_divide(F.col(f"c_{s}"), total)).otherwise(1 / 3) for s in A.STATES), F.lit(0.0))
    e = groups.join(t, "grp").groupBy(trial, win, "type", "type_idx").agg(F.sum(F.greatest(score - 1 / 3, F.lit(0.0)) * 3.0).alias("evidence"))
    # Evidence that is equal to nine places is a tie, which the first template wins.
    return e.groupBy(trial, win).agg(F.max_by("type", F.struct(F.round("evidence", 9), -F.col("type_idx"))).alias("top1_type"), F.max("evidence").alias("evidence"))


def sensitivity(groups: DataFrame, templates: DataFrame, win: str, by: float = 0.05) -> DataFrame:
    """(trial, stable): the share of windows whose best type is that of the unmoved templates."""
    top = top_by_trial(groups, perturbed(templates, by), win)
    base = top.filter("trial = 0").select(win, F.col("top1_type").alias("_base"))
    return top.filter("trial > 0").join(base, win).groupBy("trial").agg(F.avg((F.col("top1_type") == F.col("_base")).cast("double")).alias("stable"))


def leave_one_out(groups: DataFrame, templates: DataFrame, win: str) -> DataFrame:
    """(dropped, win, top1_type, evidence): the best type when each type's template is left out in
    turn, and, with dropped null, with all of them."""
    types = templates.select(F.col("type").alias("dropped")).distinct()
    kept = templates.join(small_side(types), F.col("type") != F.col("dropped"))  # types squared
    every = templates.withColumn("dropped", F.lit(None).cast("string"))
    t = kept.unionByName(every.select(*kept.columns)).withColumn("trial", F.coalesce("dropped", F.lit("")))
    top = top_by_trial(groups, t, win)
    return top.select(F.when(F.col("trial") != "", F.col("trial")).alias("dropped"), win, "top1_type", "evidence")


def parameter_grid(scores: DataFrame, win: str, scales: Sequence[float], limits: Sequence[float], floor: float = 1 / 3) -> DataFrame:
    """(scale, u_limit, n, n_novel): windows, and those called novel, for each pair of stated
    values. Evidence is in proportion to the scale, so a window is summed once for all of them."""
    e = scores.groupBy(win, "type").agg(F.sum(F.greatest(F.col("score") - floor, F.lit(0.0))).alias("e")).groupBy(win).agg(F.sum("e").alias("e"), F.greatest(F.count(F.lit(1)), F.lit(2)).alias("k"))
    cells = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("scale"), F.lit(float(u)).alias("u_limit")) for s in scales for u in limits])).alias("c")
    df = e.select("e", "k", cells).select("c.*", (F.col("k") / (F.col("e") * F.col("c.scale") + F.col("k"))).alias("u"))
    return df.groupBy("scale", "u_limit").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("u") > F.col("u_limit")).cast("long")).alias("n_novel"))


def agreement(a: DataFrame, b: DataFrame, win: str) -> DataFrame:
    """One row over windows that both qualified: n, n_same and the share of equal names."""
    left, right = (x.filter(qualified(x)).select(win, F.col("top1_type").alias(n)) for x, n in ((a, "_a"), (b, "_b")))
    both = left.join(right, win)
    same = F.coalesce(F.sum(F.col("_a").eqNullSafe(F.col("_b")).cast("long")), F.lit(0))
    return both.agg(F.count(F.lit(1)).alias("n"), same.alias("n_same")).withColumn("share", ratio(F.col("n_same"), F.col("n")))


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, mean, std, q25, median, q75 and most of a value such as uncertainty."""
    q = quantiles(df, keys, value, [0.25, 0.5, 0.75])
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.max(value).alias("most"))
    return meet(out, q.select(*keys, *[F.col(f"q{i}").alias(c) for i, c in enumerate(("q25", "median", "q75"))]), keys).select(*keys, "n", "mean", "std", "q25", "median", "q75", "most")


def scorecard(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b"), margin: float = 0.01, minutes: float = 1.0) -> DataFrame:
    """One row for each of recall, precision and minutes to qualify: the macro values of two
    tables of metrics_by_attack(), and the winner by more than the margin, else tie."""
    part = lambda df, x: df.agg(F.avg("dr").alias(f"{x}_recall"), F.avg("qp").alias(f"{x}_precision"), F.avg("ttq_min").alias(f"{x}_minutes"))
    both = part(a, "x").join(part(b, "y"), F.lit(True))  # one row each
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"x_{m}").alias(names[0]), F.col(f"y_{m}").alias(names[1]), F.lit(d).alias("_m"), F.lit(s).alias("_s")) for m, d, s in (("recall", margin, 1), ("precision", margin, 1), ("minutes", minutes, -1))])).alias("r")
    df = both.select(rows).select("r.*")
    gap = (F.col(names[0]) - F.col(names[1])) * F.col("_s")
    return df.select("metric", *names, F.when(gap > F.col("_m"), names[0]).when(-gap > F.col("_m"), names[1]).otherwise("tie").alias("winner"))


def opinion_sanity(df: DataFrame, beliefs: Sequence[str], u: str) -> DataFrame:
    """One row: n, the largest |sum of beliefs + u - 1|, and how many rows leave [0, 1]."""
    total = sum((F.col(b) for b in beliefs), F.lit(0.0)) + F.col(u)
    out = F.lit(False)
    for c in (*beliefs, u):
        out = out | (F.col(c) < 0) | (F.col(c) > 1)
    return df.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(total - 1)).alias("worst"), F.coalesce(F.sum(out.cast("long")), F.lit(0)).alias("n_outside"))
