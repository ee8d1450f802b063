"""Tail probabilities of named columns.

They run over one row per tested factor.  Series and continued fractions have
a known number of terms, so no Python worker is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SERIES_TERMS = 80
_FRACTION_TERMS = 120
_BETA_TERMS = 300


def _erfc_sql(x: str) -> str:
    z = f"abs({x})"
    # erf(z) = 2/sqrt(pi) exp(-z^2) (z + 2z^3/3 + 4z^5/15 + ...), all terms positive
    series = f"""aggregate(sequence(1, {_SERIES_TERMS}), named_struct('term', {z}, 'total', {z}),
        (acc, k) -> named_struct(
            'term', acc.term * 2D * {z} * {z} / (2D * k + 1D),
            'total', acc.total + acc.term * 2D * {z} * {z} / (2D * k + 1D)),
        acc -> acc.total)"""
    # erfc(z) = exp(-z^2)/sqrt(pi) / (z + (1/2)/(z + (2/2)/(z + ...)))
    fraction = f"aggregate(sequence({_FRACTION_TERMS}, 1, -1), {z}, (acc, k) -> {z} + k / 2D / acc)"
    upper = f"""CASE WHEN {z} < 2D THEN 1D - 2D / sqrt(pi()) * exp(-{z} * {z}) * {series}
        ELSE exp(-{z} * {z}) / sqrt(pi()) / {fraction} END"""
    return f"CASE WHEN {x} < 0D THEN 2D - ({upper}) ELSE {upper} END"


def erfc(x: str) -> Column:
    """Complementary error function."""
    return F.expr(_erfc_sql(f"`{x}`"))


def normal_tail(z: str) -> Column:
    """P(N > z)."""
    return F.expr(f"0.5D * ({_erfc_sql(f'(`{z}` / sqrt(2D))')})")


def chi2_tail_df1(h: str) -> Column:
    """P(X > h) for chi-square with one degree of freedom."""
    return F.expr(f"CASE WHEN `{h}` IS NOT NULL THEN {_erfc_sql(f'sqrt(greatest(`{h}`, 0D) / 2D)')} END")


def kolmogorov_tail(t: str) -> Column:
    """P(K > t) for the limiting distribution of the Kolmogorov statistic."""
    t = f"`{t}`"
    far = f"""2D * aggregate(sequence(1, 100), 0D,
        (acc, k) -> acc + if(k % 2 = 1, 1D, -1D) * exp(-2D * k * k * {t} * {t}))"""
    # The same function for small t, where the series above converges slowly.
    near = f"""1D - sqrt(2D * pi()) / {t} * aggregate(sequence(1, 100), 0D,
        (acc, k) -> acc + exp(-(2D * k - 1D) * (2D * k - 1D) * pi() * pi() / (8D * {t} * {t})))"""
    return F.expr(f"""CASE WHEN {t} IS NULL THEN NULL WHEN {t} <= 0D THEN 1D
        WHEN {t} < 1D THEN least(1D, {near}) ELSE greatest(0D, {far}) END""")


def _half_step_sql(a: str) -> str:
    """Logarithm of Gamma(a + 1/2) / Gamma(a), without the loss of a difference of two large logarithms."""
    w = f"({a} + 8D)"
    # asymptotic series after moving the argument up by eight
    far = f"0.5D * ln({w}) - 1D / (8D * {w}) + 1D / (192D * pow({w}, 3)) - 1D / (640D * pow({w}, 5)) + 17D / (14336D * pow({w}, 7))"
    near = " + ".join(f"log1p(-0.5D / ({a} + {i + 0.5}D))" for i in range(8))
    return f"({far} + {near})"


def _beta_fraction_sql(x: str, a: str, b: str, terms: str) -> str:
    # continued fraction of the incomplete beta function, evaluated from its far end
    m = "floor(j / 2D)"
    odd = f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2D * {m}) * ({a} + 2D * {m} + 1D))"
    even = f"{m} * ({b} - {m}) * {x} / (({a} + 2D * {m} - 1D) * ({a} + 2D * {m}))"
    return f"""(1D / aggregate(sequence({terms}, 1, -1), 1D,
        (acc, j) -> 1D + if(j % 2 = 1, {odd}, {even}) / acc))"""


def f_tail_df1(f: str, df2: str) -> Column:
    """P(F > f) for one and ``df2`` degrees of freedom.

    One formula for any ``df2``: the terms of the fraction grow with its root.
    """
    f, df2 = f"`{f}`", f"`{df2}`"
    a, x, rest = f"({df2} / 2D)", f"({df2} / ({df2} + {f}))", f"({f} / ({df2} + {f}))"
    terms = f"(2 * cast(4D * sqrt({df2}) as int) + {_BETA_TERMS})"
    front = f"""exp({_half_step_sql(a)} - 0.5D * ln(pi()) - {a} * log1p({f} / {df2}) + 0.5D * ln({rest}))"""
    tail = f"""CASE WHEN {x} < ({a} + 1D) / ({a} + 2.5D) THEN {front} * {_beta_fraction_sql(x, a, '0.5D', terms)} / {a}
        ELSE 1D - {front} * {_beta_fraction_sql(rest, '0.5D', a, terms)} / 0.5D END"""
    return F.expr(f"""CASE WHEN {f} IS NULL OR {df2} IS NULL OR {df2} <= 0D THEN NULL
        WHEN {f} <= 0D THEN 1D WHEN {f} = double('Infinity') THEN 0D
        ELSE greatest(0D, least(1D, {tail})) END""")
