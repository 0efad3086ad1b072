"""Rounding and click-through functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Organic click-through rate by position 0..10.
CTR = (0.0, 0.28, 0.15, 0.11, 0.08, 0.06, 0.05, 0.04, 0.032, 0.028, 0.025)


def js_round(x: Column, digits: int = 0) -> Column:
    """Half towards positive infinity on binary doubles (Spark's round is half away from zero)."""
    f = float(10**digits)
    return F.floor(x.cast("double") * f + 0.5) / F.lit(f)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def ctr_for_position(position: Column) -> Column:
    """By rounded position up to 10, then in bands."""
    at = F.floor(position + 0.5).cast("int")
    table = F.element_at(F.array(*[F.lit(x) for x in CTR]), at + 1)
    return F.when(position < 1, 0.0).when(position <= 10, table).when(position <= 20, 0.011).when(position <= 30, 0.005).when(position <= 50, 0.002).otherwise(0.0005)


def estimate_clicks(volume: Column, position: Column) -> Column:
    """Expected monthly clicks at a position."""
    return F.floor(volume * ctr_for_position(position) + 0.5).cast("bigint")


def sql_round(x: str, digits: int = 0) -> str:
    f = float(10**digits)
    return f"(floor(({x})::DOUBLE * {f}::DOUBLE + 0.5::DOUBLE) / {f}::DOUBLE)"


def sql_ctr(p: str) -> str:
    """DuckDB text of ``ctr_for_position``."""
    table = ", ".join(f"{x}::DOUBLE" for x in CTR)
    return f"(CASE WHEN ({p}) < 1 THEN 0::DOUBLE WHEN ({p}) <= 10 THEN [{table}][floor(({p}) + 0.5::DOUBLE)::INT + 1] WHEN ({p}) <= 20 THEN 0.011::DOUBLE WHEN ({p}) <= 30 THEN 0.005::DOUBLE WHEN ({p}) <= 50 THEN 0.002::DOUBLE ELSE 0.0005::DOUBLE END)"
