"""Numeric, time and geography expressions. Everything here is a native Spark column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
NUDGE = 1e-9
SECOND = 1_000_000  # microseconds

# Merchant category risk. -------------------------------------------------------------
MERCHANT_CATEGORY_RISK = {
    "JEWELRY_LUXURY": 0.85,
    "DIGITAL_WALLET_TRANSFER": 0.80,
    "ELECTRONICS": 0.75,
    "GAMING_CASINO": 0.70,
    "DEPARTMENT_STORE": 0.35,
    "GAS_STATION": 0.20,
    "UTILITIES": 0.15,
    "GROCERY": 0.10,
    "RESTAURANT": 0.10,
}
UNKNOWN_CATEGORY_RISK = 0.3
ABSENT_CATEGORY = "DEPARTMENT_STORE"
# ---------------------------------------------------------------------------------------------------


def rounded(value: Column, digits: int) -> Column:
    """Round once, at the output. The nudge keeps half-way ties identical across engines."""
    return F.round(value + F.lit(NUDGE), digits)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2.0
    half_dlon = F.radians(lon2 - lon1) / 2.0
    h = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def merchant_risk(category: Column) -> Column:
    """Risk of a merchant category; an unknown one is 0.3, an absent one counts as a department store."""
    table = F.create_map(*[F.lit(x) for pair in MERCHANT_CATEGORY_RISK.items() for x in pair])
    return F.coalesce(table[F.coalesce(category, F.lit(ABSENT_CATEGORY))], F.lit(UNKNOWN_CATEGORY_RISK))


def hour_is_unusual(hour: Column, start: Column | None = None, end: Column | None = None) -> Column:
    first = F.lit(8) if start is None else F.coalesce(start, F.lit(8))
    last = F.lit(22) if end is None else F.coalesce(end, F.lit(22))
    return ((hour < first) | (hour > last)).cast("int")


def edge_index(value: str, edges: list[float]) -> Column:
    """How many of the ascending ``edges`` are <= the column ``value``.

    A balanced CASE tree: log2(n) comparisons per row, inside whole-stage codegen, with the edges as
    exact double literals (so 0.3 falls below 0.30000000000000004, as an explicit comparison would).
    """

    def literal(x: float) -> str:
        return f"{float(x)!r}D"

    def search(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"CASE WHEN {value} >= {literal(edges[mid])} THEN {search(mid + 1, high)} ELSE {search(low, mid)} END"

    return F.expr(search(0, len(edges)))


def linspace(start: float, stop: float, n: int) -> list[float]:
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [stop]


def parse_timestamp(raw: Column) -> Column:
    """Epoch seconds (a number as text) or ISO text, with or without a trailing Z. Null when unreadable."""
    number = raw.try_cast("double")
    return F.coalesce(
        F.timestamp_micros((number * F.lit(SECOND)).cast("long")),
        F.try_to_timestamp(raw),
    )
