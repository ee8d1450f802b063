"""Exact tail probabilities of two-sample statistics for small groups, as SQL expressions.

Both are recurrences over arrays.  All terms are positive probabilities, so small results keep their digits.  The columns named are
whole numbers; the first group of ``u_distribution`` should be the smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u_distribution(m: str, n: str) -> Column:
    """P(U = u) for u = 0 .. m * n, U counting pairs of groups of ``m`` and ``n`` members without ties.

    The last of all members is in the first group with probability m / (m + n); it then adds n to U:
    p(u; m, n) = m / (m + n) * p(u - n; m - 1, n) + n / (m + n) * p(u; m, n - 1).
    """
    return F.expr(f"""aggregate(
        sequence(1, {n}),
        transform(sequence(0, {m}), i -> transform(sequence(0, {m} * {n}), u -> CASE WHEN u = 0 THEN 1D ELSE 0D END)),
        (rows, j) -> aggregate(sequence(1, {m}), slice(rows, 1, 1), (done, i) -> concat(done, array(transform(rows[i], (p, u) ->
            p * j / (i + j) + CASE WHEN u >= j THEN done[i - 1][u - j] * i / (i + j) ELSE 0D END)))),
        rows -> rows[{m}])""")


def upper_tail(distribution: str, u: str) -> Column:
    """P(U >= u) from an array of probabilities; missing where either is."""
    return F.expr(f"aggregate(slice({distribution}, int(round({u})) + 1, size({distribution})), 0D, (a, p) -> a + p, a -> least(1D, a))")


def distance_tail(m: str, n: str, least: str) -> Column:
    """P(max |i / m - j / n| * m * n >= least) over all orders of groups of ``m`` and ``n`` members.

    A path on the lattice steps right with probability (m - i) / (members left), else up; mass that leaves the
    strip is added up and goes no further.
    """
    # names that no column has: a lambda's variable hides a column of its name
    after = f"""transform(state_.inside, (mass_, at_) -> (mass_ * ({n} - step_ + at_) + CASE WHEN at_ > 0 THEN state_.inside[at_ - 1] * ({m} - at_ + 1) ELSE 0D END) / ({m} + {n} - step_))"""
    out = f"abs(at_ * {n} - (step_ + 1 - at_) * {m}) >= {least}"
    return F.expr(f"""CASE WHEN {least} <= 0 THEN 1D ELSE aggregate(
        sequence(0, {m} + {n} - 1),
        named_struct('inside', transform(sequence(0, {m}), at_ -> CASE WHEN at_ = 0 THEN 1D ELSE 0D END), 'gone', 0D),
        (state_, step_) -> named_struct(
            'inside', transform({after}, (mass_, at_) -> CASE WHEN {out} THEN 0D ELSE mass_ END),
            'gone', state_.gone + aggregate(transform({after}, (mass_, at_) -> CASE WHEN {out} THEN mass_ ELSE 0D END), 0D, (sum_, mass_) -> sum_ + mass_)),
        state_ -> least(1D, state_.gone)) END""")
