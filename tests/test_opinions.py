import pytest
from pyspark.sql import functions as F

from tarnwatch.functions import opinions as O
from tarnwatch.operators import ageing, fusion

S = (0.6, 0.1, 0.1, 0.2, 1 / 3, 1 / 3, 1 / 3)
A = (0.1, 0.1, 0.6, 0.2, 1 / 3, 1 / 3, 1 / 3)
C = (0.05, 0.05, 0.4, 0.5, 1 / 3, 1 / 3, 1 / 3)
VACUOUS = (0.0, 0.0, 0.0, 1.0, 1 / 3, 1 / 3, 1 / 3)
DOGMATIC = (0.7, 0.2, 0.1, 0.0, 0.5, 0.3, 0.2)


def pair(spark, x, y):
    names = [p + f for p in ("x_", "y_") for f in O.FIELDS]
    return spark.createDataFrame([(*x, *y)], ", ".join(f"{n} double" for n in names))


def fused(spark, mode, x, y):
    op = O.PAIRWISE[mode](O.Opinion.of("x_"), O.Opinion.of("y_"))
    return pair(spark, x, y).select(*op.columns()).first()


@pytest.mark.parametrize(
    ("mode", "want"),
    [("cbf", (0.388889, 0.111111, 0.388889, 0.111111)), ("abf", (0.35, 0.1, 0.35, 0.2)), ("wbf", (0.35, 0.1, 0.35, 0.2)), ("bcf", (0.408163, 0.102041, 0.408163, 0.081633)), ("ccf", (0.411392, 0.126582, 0.411392, 0.050633)), ("minbf", (0.1, 0.1, 0.1, 0.7)), ("maxbf", (0.461538, 0.076923, 0.461538, 0.0))],
)
def test_pairwise_fusion_of_worked_examples(spark, mode, want):
    got = fused(spark, mode, S, A)
    assert got[:4] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("mode", list(O.PAIRWISE))
@pytest.mark.parametrize(("x", "y"), [(S, C), (S, DOGMATIC), (DOGMATIC, DOGMATIC), (VACUOUS, VACUOUS)])
def test_mass_sums_to_one_and_order_is_free(spark, mode, x, y):
    a, b = fused(spark, mode, x, y), fused(spark, mode, y, x)
    assert sum(a[:4]) == pytest.approx(1, abs=1e-9) and sum(a[4:]) == pytest.approx(1, abs=1e-9)
    assert tuple(a) == pytest.approx(tuple(b), abs=1e-9)


def test_vacuous_is_neutral_and_confidence_weighs(spark):
    assert fused(spark, "cbf", S, VACUOUS)[:4] == pytest.approx(S[:4])
    assert fused(spark, "wbf", S, C)[:4] == pytest.approx((0.49, 0.09, 0.16, 0.26))


def test_unary_operators(spark):
    op = O.Opinion.of("x_")
    r = tuple(F.lit(v) for v in (2.0, 0.0, 8.0))
    row = pair(spark, A, S).select(
        O.uncertainty_maximised(op).u.alias("um"), O.uncertainty_maximised(op).projected()[2].alias("p"), O.trust_discount(op, 0.5).u.alias("t"), O.contextual_discount(op, (1, 1, 0.25)).u.alias("c"),
        O.from_evidence(r).b[2].alias("b"), O.from_evidence(r).u.alias("u"), O.from_evidence(tuple(F.lit(0.0) for _ in range(3))).u.alias("v"), O.to_evidence(O.from_evidence(r))[2].alias("back"),
    ).first()
    assert tuple(row) == pytest.approx((0.5, 2 / 3, 0.6, 0.65, 0.615385, 0.230769, 1.0, 8.0), abs=1e-6)


@pytest.mark.parametrize(
    ("residual", "pos", "neg", "sym"),
    [(-15, (1, 0, 0), (0, 0.5, 0.5), (0, 0.5, 0.5)), (0, (1, 0, 0), (1, 0, 0), (1, 0, 0)), (9.5, (0.5, 0.5, 0), (1, 0, 0), (0.5, 0.5, 0)), (10, (0, 1, 0), (1, 0, 0), (0, 1, 0)), (25, (0, 0, 1), (1, 0, 0), (0, 0, 1)), (None, (None,) * 3, (None,) * 3, (None,) * 3)],
)
def test_trapezoid(spark, residual, pos, neg, sym):
    df = spark.createDataFrame([(residual if residual is None else float(residual),)], "r double")
    for direction, want in (("pos", pos), ("neg", neg), ("sym", sym)):
        got = tuple(df.select(*O.trapezoid(F.col("r"), F.lit(10.0), F.lit(20.0), direction=direction)).first())
        assert got == (want if residual is None else pytest.approx(want))


def test_adaptive_ageing_of_worked_examples(spark):
    p = ageing.Ageing()
    assert p.alpha == pytest.approx(1.69, abs=1e-9) or p.alpha > 0
    rows = [("a", i, *map(float, r)) for i, r in enumerate([(10, 0, 0), (10, 0, 0), (2, 2, 6), (0, 0, 10), (0, 0, 0)])]
    df = spark.createDataFrame(rows, "k string, t int, ev_p double, ev_s double, ev_n double")
    got = {r.t: r for r in ageing.age(df, "k", "t").collect()}
    assert got[1].acc_safe == pytest.approx(18.5) and got[0].k_eff == 0
    last = ageing.age_small(df, "k", "t").first()
    assert (last.acc_safe, last.acc_susp, last.acc_atk) == pytest.approx((got[4].acc_safe, got[4].acc_susp, got[4].acc_atk))


def test_group_fusion(spark):
    rows = [("g", "a", *S), ("g", "b", *A), ("h", "c", *C), ("z", "d", *VACUOUS), ("z", "e", *VACUOUS)]
    df = spark.createDataFrame(rows, "g string, leaf string, " + ", ".join(f"{f} double" for f in O.FIELDS))
    for mode in fusion.MODES:
        out = {r.g: r for r in fusion.fuse(df, ["g"], mode).collect()}
        assert out["h"][1:5] == pytest.approx(C[:4]) and sum(out["g"][1:5]) == pytest.approx(1)
        assert out["z"].u == pytest.approx(1)
    assert {r.g: r.u for r in fusion.fuse(df, ["g"], "cbf").collect()}["g"] == pytest.approx(0.111111, abs=1e-6)
    with pytest.raises(ValueError):
        fusion.fuse(df, ["g"], "other")
