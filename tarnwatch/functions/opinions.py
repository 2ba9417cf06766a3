"""Multinomial opinions over (safe, suspect, attack) as Column expressions.

An opinion is belief, uncertainty and base rate, with sum(b) + u = 1. All functions here are
scalar expressions that Catalyst compiles; fusing many rows is in operators.fusion.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

W = 3.0
DOGMATIC = 1e-9
TINY = 1e-12
FIELDS = ("b_safe", "b_susp", "b_atk", "u", "a_safe", "a_susp", "a_atk")
Three = tuple[Column, Column, Column]


def lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def total(xs) -> Column:
    first, *rest = xs
    for x in rest:
        first = first + x
    return first


def simplex(v: Three, fallback: Three | None = None) -> Three:
    """v clipped at zero and scaled to sum one; the fallback (else uniform) if nothing is left."""
    v = tuple(F.greatest(x, F.lit(0.0)) for x in v)
    s = total(v)
    other = fallback or (F.lit(1 / 3),) * 3
    return tuple(F.when(s > TINY, F.try_divide(x, s)).otherwise(o) for x, o in zip(v, other, strict=True))


class Opinion(NamedTuple):
    b: Three
    u: Column
    a: Three

    @classmethod
    def of(cls, prefix: str = "") -> Opinion:
        """From columns named prefix + FIELDS, or the fields of a struct column ("x.")."""
        c = [F.col(prefix + f) for f in FIELDS]
        return cls(tuple(c[:3]), c[3], tuple(c[4:]))

    @classmethod
    def vacuous(cls, a: Three | None = None) -> Opinion:
        return cls((F.lit(0.0),) * 3, F.lit(1.0), a or (F.lit(1 / 3),) * 3)

    def struct(self) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip((*self.b, self.u, *self.a), FIELDS, strict=True)])

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip((*self.b, self.u, *self.a), FIELDS, strict=True)]

    def projected(self) -> Three:
        return tuple(b + a * self.u for b, a in zip(self.b, self.a, strict=True))

    def confidence(self) -> Column:
        return 1 - self.u

    def normalised(self) -> Opinion:
        s = total(self.b) + self.u
        return Opinion(tuple(F.try_divide(x, s) for x in self.b), F.try_divide(self.u, s), self.a)


def either(condition: Column, yes: Opinion, no: Opinion) -> Opinion:
    pick = lambda x, y: F.when(condition, x).otherwise(y)
    return Opinion(tuple(map(pick, yes.b, no.b)), pick(yes.u, no.u), tuple(map(pick, yes.a, no.a)))


def from_evidence(r: Three, w: float | Column = W, a: Three | None = None) -> Opinion:
    d = total(r) + lit(w)
    return Opinion(tuple(F.when(d > 0, F.try_divide(x, d)).otherwise(0.0) for x in r), F.when(d > 0, F.try_divide(lit(w), d)).otherwise(1.0), a or (F.lit(1 / 3),) * 3)


def to_evidence(op: Opinion, w: float = W) -> Three:
    """W b / u; below the dogmatic bound the evidence is capped."""
    return tuple(F.when(op.u < DOGMATIC, F.least(b * w / DOGMATIC, F.lit(w * 1e4))).otherwise(F.try_divide(w * b, op.u)) for b in op.b)


def uncertainty_maximised(op: Opinion) -> Opinion:
    """The opinion of the same projection with the largest uncertainty."""
    p = op.projected()
    u = clip(F.least(*[F.when(a > TINY, F.try_divide(x, a)).otherwise(F.lit(float("inf"))) for x, a in zip(p, op.a, strict=True)]))
    return Opinion(tuple(F.greatest(x - a * u, F.lit(0.0)) for x, a in zip(p, op.a, strict=True)), u, op.a)


def trust_discount(op: Opinion, t: float | Column) -> Opinion:
    return Opinion(tuple(x * lit(t) for x in op.b), 1 - lit(t) * (1 - op.u), op.a)


def contextual_discount(op: Opinion, alpha: tuple) -> Opinion:
    b = tuple(x * lit(k) for x, k in zip(op.b, alpha, strict=True))
    return Opinion(b, 1 - total(b), op.a)


def boost(op: Opinion, ratio: float, w: float = W) -> Opinion:
    if ratio <= 0 or abs(ratio - 1) < 1e-8:
        return op
    return from_evidence(tuple(x * ratio for x in to_evidence(op, w)), w, op.a)


def conflict_escalation(x: Three, y: Three) -> Column:
    """Mass that moves between safe and attack either way, or one step up."""
    return clip(x[0] * y[2] + x[2] * y[0] + x[0] * y[1] + x[1] * y[2])


def conflict_canonical(x: Three, y: Three) -> Column:
    return clip(total(x) * total(y) - total(p * q for p, q in zip(x, y, strict=True)))


def conflict_projected(x: Opinion, y: Opinion) -> Column:
    return conflict_escalation(x.projected(), y.projected())


def conflict_kl(x: Opinion, y: Opinion, tau: float = 1.0, eps: float = 1e-12) -> Column:
    """1 - exp(-(KL(p, q) + KL(q, p)) / tau) of the projections."""
    p, q = (simplex(tuple(F.greatest(v, F.lit(eps)) for v in o.projected())) for o in (x, y))
    return clip(1 - F.exp(-total((a - b) * F.ln(a / b) for a, b in zip(p, q, strict=True)) / tau))


def mean_rate(x: Opinion, y: Opinion, wx: Column | float = 1.0, wy: Column | float = 1.0) -> Three:
    wx, wy = F.greatest(lit(wx), F.lit(0.0)), F.greatest(lit(wy), F.lit(0.0))
    none = wx + wy < TINY
    wx, wy = F.when(none, 1.0).otherwise(wx), F.when(none, 1.0).otherwise(wy)
    return simplex(tuple(wx * p + wy * q for p, q in zip(x.a, y.a, strict=True)), x.a)


def _half(x: Opinion, y: Opinion, u: Column) -> Opinion:
    return Opinion(tuple((p + q) / 2 for p, q in zip(x.b, y.b, strict=True)), u, tuple((p + q) / 2 for p, q in zip(x.a, y.a, strict=True)))


def wbf(x: Opinion, y: Opinion) -> Opinion:
    """Weighted belief fusion of two: each weighs its confidence times the other's doubt."""
    cx, cy = x.confidence(), y.confidence()
    d = cx * y.u + cy * x.u
    b = tuple(F.try_divide(cx * y.u * p + cy * x.u * q, d) for p, q in zip(x.b, y.b, strict=True))
    a = simplex(tuple(F.when(cx + cy < TINY, (p + q) / 2).otherwise(F.try_divide(cx * p + cy * q, cx + cy)) for p, q in zip(x.a, y.a, strict=True)))
    usual = Opinion(b, F.try_divide((cx + cy) * x.u * y.u, d), a)
    blank = (x.u >= 1 - TINY) & (y.u >= 1 - TINY)
    return either(d < TINY, _half(x, y, F.when(blank, 1.0).otherwise((x.u + y.u) / 2)), usual)


def cbf(x: Opinion, y: Opinion) -> Opinion:
    """Cumulative belief fusion of two: the evidence adds up."""
    d = x.u + y.u - x.u * y.u
    mean = tuple((p + q) / 2 for p, q in zip(x.a, y.a, strict=True))
    a = simplex(tuple(clip(F.try_divide(p * y.u + q * x.u - m * x.u * y.u, d)) for p, q, m in zip(x.a, y.a, mean, strict=True)), mean)
    usual = Opinion(tuple(F.try_divide(p * y.u + q * x.u, d) for p, q in zip(x.b, y.b, strict=True)), F.try_divide(x.u * y.u, d), a)
    cx, cy = x.confidence(), y.confidence()
    g = F.when(cx + cy > TINY, F.try_divide(cx, cx + cy)).otherwise(0.5)
    certain = Opinion(*[tuple(g * p + (1 - g) * q for p, q in zip(v, w, strict=True)) if i != 1 else F.lit(0.0) for i, (v, w) in enumerate(zip(x, y, strict=True))])
    return either(((x.u < DOGMATIC) & (y.u < DOGMATIC)) | (d < TINY), certain, usual)


def abf(x: Opinion, y: Opinion) -> Opinion:
    """Averaging belief fusion of two; dogmatic opinions outweigh all others."""
    d = x.u + y.u
    rate = mean_rate(x, y)
    usual = Opinion(tuple(F.try_divide(p * y.u + q * x.u, d) for p, q in zip(x.b, y.b, strict=True)), F.try_divide(2 * x.u * y.u, d), rate)
    both = Opinion(_half(x, y, F.lit(0.0)).b, F.lit(0.0), rate)
    dx, dy = x.u < DOGMATIC, y.u < DOGMATIC
    return either(dx & dy, both, either(dx, Opinion(x.b, F.lit(0.0), x.a), either(dy, Opinion(y.b, F.lit(0.0), y.a), usual)))


def bcf(x: Opinion, y: Opinion) -> Opinion:
    """Belief constraint fusion (Dempster's rule); vacuous under total conflict."""
    d = 1 - (total(x.b) * total(y.b) - total(p * q for p, q in zip(x.b, y.b, strict=True)))
    a = mean_rate(x, y, x.confidence(), y.confidence())
    usual = Opinion(tuple(F.try_divide(p * q + p * y.u + x.u * q, d) for p, q in zip(x.b, y.b, strict=True)), F.try_divide(x.u * y.u, d), a)
    return either(d <= TINY, Opinion.vacuous(a), usual)


def ccf(x: Opinion, y: Opinion) -> Opinion:
    """Consensus and compromise: what both believe stays, conflicting rests split by base rate."""
    a = tuple((p + q) / 2 for p, q in zip(x.a, y.a, strict=True))  # of two simplexes
    agreed = tuple(F.least(p, q) for p, q in zip(x.b, y.b, strict=True))
    rx, ry = (tuple(F.greatest(p - c, F.lit(0.0)) for p, c in zip(o.b, agreed, strict=True)) for o in (x, y))
    b = []
    for i in range(3):
        gained = agreed[i] + rx[i] * y.u + ry[i] * x.u + rx[i] * ry[i]
        for j in range(3):
            if i != j:
                part = F.when(a[i] + a[j] > TINY, F.try_divide(a[i], a[i] + a[j])).otherwise(0.5)
                gained = gained + (rx[i] * ry[j] + rx[j] * ry[i]) * part
        b.append(gained)
    u = x.u * y.u
    s = total(b) + u
    fused = either(s <= TINY, Opinion.vacuous(a), Opinion(tuple(F.try_divide(v, s) for v in b), F.try_divide(u, s), a))
    near = lambda p, q: F.abs(p - q) <= 1e-12 + 1e-5 * F.abs(q)
    same = near(x.u, y.u)
    for p, q in zip((*x.b, *x.a), (*y.b, *y.a), strict=True):
        same = same & near(p, q)
    return either(same, x, fused)


def minbf(x: Opinion, y: Opinion) -> Opinion:
    b = tuple(F.least(p, q) for p, q in zip(x.b, y.b, strict=True))
    return Opinion(b, F.greatest(1 - total(b), F.lit(0.0)), mean_rate(x, y))


def maxbf(x: Opinion, y: Opinion) -> Opinion:
    b = tuple(F.greatest(p, q) for p, q in zip(x.b, y.b, strict=True))
    s = total(b)
    return Opinion(tuple(F.when(s > 1, F.try_divide(v, s)).otherwise(v) for v in b), F.greatest(1 - s, F.lit(0.0)), mean_rate(x, y))


PAIRWISE = {"wbf": wbf, "cbf": cbf, "abf": abf, "bcf": bcf, "ccf": ccf, "minbf": minbf, "maxbf": maxbf}


def trapezoid(residual: Column, susp: Column, atk: Column, base: Column | None = None, direction: str = "sym") -> Three:
    """(safe, suspect, attack) mass of a residual. Safe up to the base (0.9 of susp by default),
    then to suspect at susp, then to attack at atk. Null residuals give nulls."""
    base = 0.9 * susp if base is None else base
    e = {"pos": residual, "neg": -residual, "sym": F.abs(residual)}[direction]
    up = lambda low, high: F.when(high > low, F.try_divide(e - low, high - low)).otherwise(1.0)
    rise, fall = up(base, susp), up(susp, atk)
    safe = F.when(e.isNull(), None).when((e <= base) | (e <= 0), 1.0).when(e < susp, 1 - rise).otherwise(0.0)
    attack = F.when(e.isNull(), None).when((e <= susp) | (e <= 0), 0.0).when(e < atk, fall).otherwise(1.0)
    return safe, 1 - safe - attack, attack


def trapezoid_relative(size: Column, susp: Column, atk: Column, transition: float = 0.1) -> Three:
    """(safe, suspect, attack) mass of a size relative to its thresholds: safe up to the transition
    below susp, then to suspect at susp, then to attack at atk. Null sizes give nulls."""
    low = susp * (1 - transition)
    rise, fall = (size - low) / (susp - low + 1e-9), (size - susp) / (atk - susp + 1e-9)
    safe = F.when(size < low, 1.0).when(size < susp, 1 - rise).when(size.isNotNull(), 0.0)
    attack = F.when(size < susp, 0.0).when(size < atk, fall).when(size.isNotNull(), 1.0)
    return safe, 1 - safe - attack, attack
