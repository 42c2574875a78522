"""Exact integer rounding, as SQL fragments usable in ``F.expr``.

Percentages are whole tenths of a percent. The arithmetic runs in ``decimal(38,0)`` so it neither
loses digits nor overflows on very large sums.
"""

from __future__ import annotations


def _d(x: str) -> str:
    return f"CAST({x} AS DECIMAL(38,0))"


def ratio_half_up(num: str, den: str, scale: int = 1000) -> str:
    """``scale·num/den`` rounded half away from zero; NULL on a zero denominator."""
    n, d = _d(num), _d(den)
    return (
        f"CASE WHEN ({den}) = 0 THEN NULL ELSE CAST(sign({n}) * sign({d}) AS BIGINT) * "
        f"(({2 * scale} * abs({n}) + abs({d})) div (2 * abs({d}))) END"
    )


def ratio_half_even(num: str, den: str, scale: int = 1000) -> str:
    """``scale·num/den`` rounded half to even; NULL on a zero denominator."""
    t, d = f"({scale} * abs({_d(num)}))", f"abs({_d(den)})"
    q = f"({t} div {d})"
    r2 = f"(2 * ({t} % {d}))"
    up = f"CASE WHEN {r2} > {d} OR ({r2} = {d} AND {q} % 2 = 1) THEN 1 ELSE 0 END"
    return (
        f"CASE WHEN ({den}) = 0 THEN NULL ELSE "
        f"CAST(sign({_d(num)}) * sign({_d(den)}) AS BIGINT) * ({q} + {up}) END"
    )


def pct_change(cur: str, prev: str) -> str:
    """(cur − prev)/|prev| in tenths of a percent, half up; NULL on a zero base."""
    return ratio_half_up(f"(({cur}) - ({prev}))", f"abs({prev})")
