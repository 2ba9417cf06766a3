"""Calendar expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def holiday(ts: Column, days: Sequence[str]) -> Column:
    return F.to_date(ts).isin([F.lit(d).cast("date") for d in days]) if days else F.lit(False)


def weekend(ts: Column, holidays: Sequence[str] = ()) -> Column:
    return (F.weekday(ts) >= 5) | holiday(ts, holidays)


def regime_of(ts: Column, holidays: Sequence[str] = (), first: int = 8, last: int = 18) -> Column:
    """ACTIVE on working days from hour first to before last, else QUIET."""
    busy = ~weekend(ts, holidays) & (F.hour(ts) >= first) & (F.hour(ts) < last)
    return F.when(busy, "ACTIVE").otherwise("QUIET")


def outage(*names: Column) -> Column:
    """Any of the names is NETWORK_OUTAGE or begins with NETWORK_OUTAGE_, tags _R<n> aside."""
    clean = lambda c: F.regexp_replace(F.upper(F.trim(c)), r"_R\d+$", "")
    one = lambda c: F.coalesce((clean(c) == "NETWORK_OUTAGE") | clean(c).startswith("NETWORK_OUTAGE_"), F.lit(False))
    out = F.lit(False)
    for n in names:
        out = out | one(n)
    return out


def family(name: Column) -> Column:
    return F.regexp_replace(name, r"_R\d+$", "")


def occurrence(name: Column) -> Column:
    n = F.regexp_extract(name, r"_R(\d+)$", 1)
    return F.when(n == "", 1).otherwise(F.try_to_number(n, F.lit("999999999")).cast("int"))
