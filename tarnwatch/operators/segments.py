"""Scans of a series by as many tasks as its length asks for.

A window function by key orders a whole key in one task. That is the plan as long as no key has
more than SEGMENT rows, which is counted first. Beyond it a key is cut into ranges of its order,
each range is scanned by a task of its own, and what a scan carries over a border (a count, a
sum, the last known value) is one row a range: those rows are scanned in turn and joined back.
Frames of a fixed number of rows need no carried state: each block of rows takes the rows of
the frame that lie beyond its borders along. Either way the result is that of the window.

The order is a number, a date or a time. Rows of equal order stay in one range; like in a window
function, their order among themselves is open. Nulls of the order come first, null keys are a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Most rows of a key that one task orders.
SEGMENT = 4_000_000
#: A key is cut into so many ranges at most.
CUTS = 256


def exceeds(df: DataFrame, by: Sequence[str], rows: int) -> bool:
    """Has a key more than so many rows? One number comes back."""
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > rows


def as_number(df: DataFrame, order: str) -> Column:
    kind = dict(df.dtypes)[order]
    if kind.startswith("timestamp"):
        return F.col(order).cast("timestamp").cast("double")
    return F.unix_date(order).cast("double") if kind == "date" else F.col(order).cast("double")


def meet(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the columns of side, which has one row for each keys; null keys meet too."""
    if not keys:
        return df.join(F.broadcast(side), F.lit(True))  # one row
    right = side.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return df.join(right, same, "left").drop(*[f"_key_{k}" for k in keys])


def segmented(df: DataFrame, by: Sequence[str], order: str, rows: int = SEGMENT) -> DataFrame:
    """df with _seg: the number of the range of its key's order, ranges of about so many rows."""
    at = as_number(df, order)
    cuts = df.groupBy(*by).agg(F.least(F.lit(CUTS), F.ceil(F.count(F.lit(1)) / rows)).alias("_parts"), F.percentile_approx(at, [i / CUTS for i in range(1, CUTS)], 10 * CUTS).alias("_cuts"))
    share = lambda i: F.floor(i * F.col("_parts") / CUTS)
    kept = F.filter("_cuts", lambda _, i: share(i + 1) > share(i))
    cuts = cuts.select(*by, F.coalesce(kept, F.array().cast("array<double>")).alias("_cuts"))
    return meet(df, cuts, by).withColumn("_seg", F.size(F.filter("_cuts", lambda c: c < at))).drop("_cuts")


def _order(order: str, ties: Sequence[str]) -> list[str]:
    return [order, *ties]


def numbered(df: DataFrame, by: Sequence[str], order: str, name: str = "_pos", ties: Sequence[str] = (), rows: int = SEGMENT) -> DataFrame:
    """df with the rows of each key numbered 0, 1, ... by order."""
    if not exceeds(df, by, rows):
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*_order(order, ties))) - 1).cast("long"))
    cut = segmented(df, by, order, rows)
    ahead = Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*by, "_seg").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select(*by, "_seg", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*by, "_seg").orderBy(*_order(order, ties))
    return meet(cut, before, [*by, "_seg"]).withColumn(name, F.row_number().over(own) - 1 + F.col("_before")).drop("_seg", "_before")


def blocks(df: DataFrame, by: Sequence[str], order: str, before: int, after: int, ties: Sequence[str] = (), rows: int = SEGMENT) -> DataFrame:
    """df with _pos, _block and _own: blocks of so many rows of a key, each with before rows more
    from the block before it and after rows from the next one, for which _own is false."""
    size = max(rows, before, after, 1)
    df = numbered(df, by, order, "_pos", ties, rows)
    at, inside = F.floor(F.col("_pos") / size), F.col("_pos") % size
    also = [F.when(inside >= size - before, at + 1)] * (before > 0) + [F.when((inside < after) & (at > 0), at - 1)] * (after > 0)
    return df.withColumn("_block", F.explode(F.array_compact(F.array(at, *also)))).withColumn("_own", F.col("_block") == at)


def framed(df: DataFrame, by: Sequence[str], order: str, before: int, after: int, make: Callable[[WindowSpec], dict[str, Column]], ties: Sequence[str] = (), rows: int = SEGMENT) -> DataFrame:
    """df with the columns that make gives of an ordered window, whose frames reach at most before
    rows back and after rows ahead."""
    if not exceeds(df, by, rows):
        return df.withColumns(make(Window.partitionBy(*by).orderBy(*_order(order, ties))))
    cut = blocks(df, by, order, before, after, ties, rows)
    return cut.withColumns(make(Window.partitionBy(*by, "_block").orderBy("_pos"))).filter("_own").drop("_pos", "_block", "_own")


def known(df: DataFrame, by: Sequence[str], order: str, values: dict[str, Column], ahead: bool = False, ties: Sequence[str] = (), rows: int = SEGMENT) -> DataFrame:
    """df with, under each name, the last value that isn't null at or before a row; with ahead,
    the first at or after it."""
    frame = (0, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, 0)
    pick = F.first if ahead else F.last
    if not exceeds(df, by, rows):
        w = Window.partitionBy(*by).orderBy(*_order(order, ties)).rowsBetween(*frame)
        return df.withColumns({n: pick(c, ignorenulls=True).over(w) for n, c in values.items()})
    cut = segmented(df, by, order, rows)
    best = F.min_by if ahead else F.max_by
    place = F.struct(*_order(order, ties))
    ends = cut.groupBy(*by, "_seg").agg(*[best(c, F.when(c.isNotNull(), place)).alias(f"_end_{n}") for n, c in values.items()])
    beyond = Window.partitionBy(*by).orderBy("_seg").rowsBetween(*((1, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -1)))
    carried = ends.select(*by, "_seg", *[pick(f"_end_{n}", ignorenulls=True).over(beyond).alias(f"_carry_{n}") for n in values])
    own = Window.partitionBy(*by, "_seg").orderBy(*_order(order, ties)).rowsBetween(*frame)
    out = meet(cut, carried, [*by, "_seg"])
    out = out.withColumns({n: F.coalesce(pick(c, ignorenulls=True).over(own), F.col(f"_carry_{n}")) for n, c in values.items()})
    return out.drop("_seg", *[f"_carry_{n}" for n in values])


def summed(df: DataFrame, by: Sequence[str], order: str, values: dict[str, Column], lows: bool = False, ties: Sequence[str] = (), rows: int = SEGMENT) -> DataFrame:
    """df with, under each name, the sum up to a row; with lows also <name>_low, the smallest such
    sum up to the row."""
    w = Window.partitionBy(*by).orderBy(*_order(order, ties)).rowsBetween(Window.unboundedPreceding, 0)
    low = lambda n: f"{n}_low"
    if not exceeds(df, by, rows):
        out = df.withColumns({n: F.sum(c).over(w) for n, c in values.items()})
        return out.withColumns({low(n): F.min(n).over(w) for n in values}) if lows else out
    own = Window.partitionBy(*by, "_seg").orderBy(*_order(order, ties)).rowsBetween(Window.unboundedPreceding, 0)
    cut = segmented(df, by, order, rows).withColumns({f"_v_{n}": c for n, c in values.items()})
    cut = cut.withColumns({n: F.sum(f"_v_{n}").over(own) for n in values})
    if lows:
        cut = cut.withColumns({low(n): F.min(n).over(own) for n in values})
    ends = cut.groupBy(*by, "_seg").agg(*[F.sum(f"_v_{n}").alias(f"_sum_{n}") for n in values], *[F.min(n).alias(f"_min_{n}") for n in values])
    ahead = Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("*", *[F.sum(f"_sum_{n}").over(ahead).alias(f"_carry_{n}") for n in values])
    carried = carried.withColumns({f"_floor_{n}": F.min(F.coalesce(F.col(f"_carry_{n}"), F.lit(0)) + F.col(f"_min_{n}")).over(ahead) for n in values})
    carried = carried.drop(*[f"_{k}_{n}" for k in ("sum", "min") for n in values])
    out = meet(cut, carried, [*by, "_seg"])
    plus = lambda a, b: F.coalesce(F.col(a) + F.col(b), F.col(a), F.col(b))
    new = {n: plus(n, f"_carry_{n}") for n in values}
    if lows:
        new |= {low(n): F.least(plus(low(n), f"_carry_{n}"), F.col(f"_floor_{n}")) for n in values}
    return out.withColumns(new).drop("_seg", *[f"_{k}_{n}" for k in ("v", "carry", "floor") for n in values])
