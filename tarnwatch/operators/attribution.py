"""Injection of synthetic events into evidence, and attribution of alarms to causes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import joins
from .joins import overlap_join, small_side, started_inside

EPS = 1e-12
STATES = ("safe", "susp", "atk")


def ramp(i: Column, n: Column, fraction: float | Column) -> Column:
    """Weight of window i (from 1) of n: up, level, down again, each over n * fraction windows."""
    steps = F.greatest(F.floor(n * fraction), F.lit(1)).cast("double")
    return F.least(F.lit(1.0), i / steps, (n - i + 1) / steps)


def inject(evidence: DataFrame, events: DataFrame, key: str, ts: str, size: float) -> DataFrame:
    """evidence (key, ts, ev_p, ev_s, ev_n) overwritten by events (name, start, end, leaf,
    ramp_frac, sig_p, sig_s, sig_n): signatures are scaled to size (an all-zero one is safe)
    and come and go by the ramp. Events of one leaf must not overlap."""
    s = F.col("sig_p") + F.col("sig_s") + F.col("sig_n")
    part = lambda c, rest: F.when(s > 0, F.try_divide(F.col(c) * size, s)).otherwise(rest)
    e = events.select("name", "start", "end", F.col("leaf").alias("_leaf"), "ramp_frac", part("sig_p", size).alias("_p"), part("sig_s", 0.0).alias("_s"), part("sig_n", 0.0).alias("_n"))
    joined = evidence.join(small_side(e), (F.col(key) == F.col("_leaf")) & (F.col(ts) >= F.col("start")) & (F.col(ts) < F.col("end")), "left")
    group = Window.partitionBy(key, "name")
    i, n = F.row_number().over(group.orderBy(ts)), F.count(F.lit(1)).over(group)
    joined = joined.withColumn("_w", F.when(F.col("name").isNotNull(), ramp(i, n, F.col("ramp_frac"))))
    new = {"ev_p": (1 - F.col("_w")) * size + F.col("_w") * F.col("_p"), "ev_s": F.col("_w") * F.col("_s"), "ev_n": F.col("_w") * F.col("_n")}
    return joined.select(*[F.when(F.col("_w").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in evidence.columns], F.col("name").alias("event"))


def overlapping(events: DataFrame) -> DataFrame:
    """Pairs of events that overlap; a valid catalog has none. In a large catalog the event that
    starts later (of equal starts, the one of the greater name) meets the other once, then the
    two are put in the order of their names."""
    names = ("name", "start", "end")
    a, b = (events.select(*[F.col(c).alias(f"{c}_{k}") for c in names]) for k in (1, 2))
    if events.limit(joins.BROADCAST_ROWS + 1).count() <= joins.BROADCAST_ROWS:
        return overlap_join(a, b, ("start_1", "end_1"), ("start_2", "end_2")).filter("name_1 < name_2")
    kept = cut(events.select(*names))  # read several times
    a, b = (kept.select(*[F.col(c).alias(f"{c}_{k}") for c in names]) for k in (1, 2))
    later = F.expr("start_2 > start_1 AND name_2 <> name_1 OR start_2 = start_1 AND name_2 > name_1")
    met = started_inside(a, b, ("start_1", "end_1"), ("start_2", "end_2"), later)
    ordered = F.col("name_1") < F.col("name_2")
    pick = lambda c, k: F.when(ordered, F.col(f"{c}_{k}")).otherwise(F.col(f"{c}_{3 - k}")).alias(f"{c}_{k}")
    return met.select(*[pick(c, k) for k in (1, 2) for c in names])


def pooled(projections: DataFrame, keys: Sequence[str], prefix: str = "p_") -> DataFrame:
    """Geometric mean of each state over the rows of a group, to sum one."""
    means = projections.groupBy(*keys).agg(*[F.exp(F.avg(F.ln(F.greatest(F.col(prefix + s), F.lit(EPS))))).alias(f"_{s}") for s in STATES])
    total = F.col("_safe") + F.col("_susp") + F.col("_atk")
    return means.select(*keys, *[F.try_divide(F.col(f"_{s}"), total).alias(prefix + s) for s in STATES])


def template_scores(groups: DataFrame, templates: DataFrame, win: str, prefix: str = "p_") -> DataFrame:
    """(win, type, type_idx, grp, score): dot product of a group's state with each type's template."""
    t = templates.select("type", "type_idx", "grp", *[F.col(f"c_{s}") for s in STATES])
    total = F.col("c_safe") + F.col("c_susp") + F.col("c_atk")
    score = sum((F.col(prefix + s) * F.when(total > 0, F.try_divide(F.col(f"c_{s}"), total)).otherwise(1 / 3) for s in STATES), F.lit(0.0))
    return groups.join(small_side(t), "grp").select(win, "type", "type_idx", "grp", F.greatest(score, F.lit(EPS)).alias("score"))


def contrast(scores: DataFrame, win: str) -> DataFrame:
    mean = F.avg("score").over(Window.partitionBy(win, "grp"))
    return scores.withColumn("score", F.col("score") - mean)


def divergence_weights(templates: DataFrame) -> DataFrame:
    """(grp, weight): Jensen-Shannon divergence of the types' templates, scaled to mean one."""
    h = lambda cs: sum((F.when(c > 0, -c * F.log2(c)).otherwise(0.0) for c in cs), F.lit(0.0))
    total = F.col("c_safe") + F.col("c_susp") + F.col("c_atk")
    t = templates.select("grp", *[(F.col(f"c_{s}") / total).alias(f"c_{s}") for s in STATES])
    g = t.groupBy("grp").agg((h([F.avg(f"c_{s}") for s in STATES]) - F.avg(h([F.col(f"c_{s}") for s in STATES]))).alias("jsd"))
    mean = g.agg(F.avg("jsd").alias("m"))  # one row
    return g.crossJoin(F.broadcast(mean)).select("grp", F.when(F.col("m") > 0, F.col("jsd") / F.col("m")).otherwise(1.0).alias("weight"))


def beliefs(scores: DataFrame, win: str, scale: float = 3.0, floor: float = 1 / 3) -> DataFrame:
    """(win, type, type_idx, evidence, b, u, b_um, u_um): evidence above the floor, summed over
    groups, becomes an opinion over the types; then the one of largest uncertainty."""
    e = scores.groupBy(win, "type", "type_idx").agg(F.sum(F.greatest(F.col("score") - floor, F.lit(0.0)) * scale).alias("evidence"))
    w = Window.partitionBy(win)
    k = F.greatest(F.count(F.lit(1)).over(w), F.lit(2)).cast("double")
    e = e.withColumn("_k", k).withColumn("_d", F.sum("evidence").over(w) + F.col("_k"))
    e = e.withColumn("b", F.col("evidence") / F.col("_d")).withColumn("u", F.col("_k") / F.col("_d"))
    p = F.col("b") + F.col("u") / F.col("_k")
    e = e.withColumn("_p", p).withColumn("u_um", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min(F.col("_p") * F.col("_k")).over(w))))
    return e.withColumn("b_um", F.greatest(F.col("_p") - F.col("u_um") / F.col("_k"), F.lit(0.0))).drop("_k", "_d", "_p")


def top_type(beliefs: DataFrame, win: str, belief: str = "b") -> DataFrame:
    """The best type of each window, the first template of equals, with novelty (mean over max)."""
    best = F.max_by("type", F.struct(F.col(belief), -F.col("type_idx")))
    return beliefs.groupBy(win).agg(best.alias("top1_type"), F.max(belief).alias("top1_b"), F.first("u").alias("u_raw"), F.coalesce(F.try_divide(F.avg("evidence"), F.max("evidence")), F.lit(1.0)).alias("novelty_lr"))


def argmax_baseline(scores: DataFrame, win: str) -> DataFrame:
    """(win, top1_type, p): softmax over types of the mean log score."""
    m = scores.groupBy(win, "type", "type_idx").agg(F.avg(F.ln("score")).alias("l"))
    p = F.exp("l") / F.sum(F.exp("l")).over(Window.partitionBy(win))
    m = m.withColumn("p", p)
    return m.groupBy(win).agg(F.max_by("type", F.struct(F.col("p"), -F.col("type_idx"))).alias("top1_type"), F.max("p").alias("p"))


def transition_matrix(types: Sequence[str], stay: float = 0.8, chain: dict[tuple[str, str], float] | None = None) -> list[list[float]]:
    """Rows to sum one: stay on the diagonal, stated steps of a chain, the rest shared out."""
    out = []
    for a in types:
        row = [stay if a == b else (chain or {}).get((a, b), (1 - stay) / max(1, len(types) - 1)) for b in types]
        out.append([x / sum(row) for x in row])
    return out


def with_temporal_prior(beliefs_wide: DataFrame, key: str, order: str, types: Sequence[str], transition: Sequence[Sequence[float]], decay: float = 0.9, share: float = 0.3) -> DataFrame:
    """Each window's beliefs averaged with the moved and discounted beliefs before it."""
    from .ageing import fold

    n = len(types)

    def step(state: list[float], now: list[float]) -> tuple[list[float], list[float]]:
        now = [x or 0.0 for x in now]
        if not state:
            return now, now
        moved = [decay * sum(transition[i][j] * state[i] for i in range(n)) for j in range(n)]
        new = [(1 - share) * x + share * m for x, m in zip(now, moved, strict=True)]
        return new, new

    return fold(beliefs_wide, key, order, types, list, step, [f"{t}_smooth" for t in types])
