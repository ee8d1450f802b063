"""Two-sample statistics on weighted histograms.

A histogram has one row per (factor, x) with the number of members of group a
and of group b that have the value x.  Ranks and distribution functions come
from ``running_totals``, so no factor has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repometrics.functions import chi2_tail_df1, distance_tail, f_tail_df1, kolmogorov_tail, normal_tail, u_distribution, upper_tail
from repometrics.operators.ordering import most_significant_first, running_totals

#: The exact distribution of U takes time in proportion to the square of the pairs: half a second for as many as these.
EXACT_PAIRS = 2_000


def two_group_histogram(df: DataFrame, factor: Column | str, value: Column | str, is_a: Column) -> DataFrame:
    """(factor, x, a, b) from one row per member; missing values are left out."""
    factor = F.col(factor) if isinstance(factor, str) else factor
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(factor.alias("factor"), value.cast("double").alias("x"), is_a.alias("_in_a"))
    return (
        rows.filter(F.col("factor").isNotNull() & F.col("x").isNotNull() & F.col("_in_a").isNotNull())
        .groupBy("factor", "x")
        .agg(F.count_if("_in_a").alias("a"), F.count_if(~F.col("_in_a")).alias("b"))
    )


def _ranked(hist: DataFrame) -> DataFrame:
    rows = running_totals(
        hist, ["factor"], ["x"],
        {"a": F.col("a"), "b": F.col("b")},
        {"ax": F.expr("a * x"), "bx": F.expr("b * x")},
    )
    return rows.selectExpr(
        "*",
        "a + b AS ties",
        # members before this value, plus the middle of those that share it
        "before_a + before_b + (a + b + 1) / 2D AS rank",
        "try_divide(before_a + a, total_a) AS ecdf_a",
        "try_divide(before_b + b, total_b) AS ecdf_b",
    )


def average_rank(hist: DataFrame) -> DataFrame:
    """Tie-averaged rank of every pooled value."""
    return _ranked(hist).select("factor", "x", "a", "b", "ties", "rank")


def ecdf(hist: DataFrame) -> DataFrame:
    """Both groups' empirical distribution functions at every pooled value."""
    return _ranked(hist).select("factor", "x", "ecdf_a", "ecdf_b")


def _summarise(hist: DataFrame) -> DataFrame:
    """One row per factor with everything the tests need."""
    totals = []
    for g in ("a", "b"):
        mean, spot = f"try_divide(total_{g}x, total_{g})", f"(total_{g} - 1) / 2D"
        present = f"CASE WHEN {g} > 0 THEN x END"

        def at(rank: str) -> str:
            return f"max(CASE WHEN before_{g} <= {rank} AND {rank} < before_{g} + {g} THEN x END)"

        totals += [
            f"max(total_{g}) AS n_{g}",
            f"max({mean}) AS raw_mean_{g}",
            f"sum({g} * (x - {mean}) * (x - {mean})) AS raw_ss_{g}",
            f"min({present}) AS min_{g}",
            f"max({present}) AS max_{g}",
            f"({at(f'floor({spot})')} + {at(f'ceil({spot})')}) / 2D AS med_{g}",
            f"sum({g} * rank) AS ranks_{g}",
        ]
    totals += [
        "sum(pow(ties, 3) - ties) AS tie_term",
        "max(abs(ecdf_a - ecdf_b)) AS ks_stat",
    ]
    summed = _ranked(hist).groupBy("factor").agg(*[F.expr(t) for t in totals])
    # Rounding in the mean must not turn constant data into varying data.
    return summed.selectExpr(
        "*",
        *[f"CASE WHEN min_{g} < max_{g} THEN raw_mean_{g} ELSE min_{g} END AS mean_{g}" for g in "ab"],
        *[f"CASE WHEN min_{g} < max_{g} THEN raw_ss_{g} ELSE 0D END AS ss_{g}" for g in "ab"],
        "n_a > 0 AND n_b > 0 AS both",
        "double(n_a) AS na", "double(n_b) AS nb", "double(n_a + n_b) AS n",
    ).selectExpr("*", "1D - try_divide(tie_term, n * n * n - n) AS correction")


_SUMMARY = [
    sql
    for g in "ab"
    for sql in (
        f"mean_{g} AS mean{g}",
        f"med_{g} AS med{g}",
        f"CASE WHEN n_{g} > 1 THEN sqrt(ss_{g} / (n_{g} - 1)) END AS std{g}",
    )
]


def _with_anova(s: DataFrame) -> DataFrame:
    between = s.selectExpr(
        "*", "n - 2D AS df2", "ss_a + ss_b AS within",
        "CASE WHEN both THEN na * nb / n * (mean_a - mean_b) * (mean_a - mean_b) END AS between_groups",
    )
    stat = between.selectExpr("*", """CASE WHEN NOT both OR df2 <= 0D THEN NULL
        WHEN within > 0D THEN between_groups / within * df2
        WHEN between_groups > 0D THEN double('Infinity') END AS f_stat""")
    return stat.withColumn("f_pval", f_tail_df1("f_stat", "df2"))


def _with_kruskal(s: DataFrame) -> DataFrame:
    stat = s.selectExpr("*", """CASE WHEN both AND correction > 0D THEN 12D / (n * (n + 1D)) / correction
        * (na * pow(ranks_a / na - (n + 1D) / 2D, 2) + nb * pow(ranks_b / nb - (n + 1D) / 2D, 2)) END AS k_stat""")
    return stat.withColumn("k_pval", chi2_tail_df1("k_stat"))


def _with_mann_whitney(s: DataFrame, exact_up_to: int = 0) -> DataFrame:
    asymptotic = _with_normal_tails(s)
    if not exact_up_to:
        return asymptotic
    small = F.expr(f"both AND tie_term = 0 AND least(n_a, n_b) <= {exact_up_to} AND n_a * n_b <= {EXACT_PAIRS}")
    sized = asymptotic.withColumns({"_few": F.when(small, F.least("n_a", "n_b")).cast("int"), "_many": F.when(small, F.greatest("n_a", "n_b")).cast("int")})
    sized = sized.withColumn("_ways", F.when(F.col("_few").isNotNull(), u_distribution("_few", "_many")))
    tails = sized.withColumns({
        "_two": upper_tail("_ways", "greatest(u_stat, na * nb - u_stat)"), "_less": upper_tail("_ways", "na * nb - u_stat"), "_greater": upper_tail("_ways", "u_stat")})
    return tails.withColumns({
        "u_pval": F.coalesce(F.expr("CASE WHEN _two > 0.5D THEN 1D ELSE 2D * _two END"), "u_pval"),
        "u_pval_less": F.coalesce("_less", "u_pval_less"),
        "u_pval_greater": F.coalesce("_greater", "u_pval_greater"),
    })


def _with_normal_tails(s: DataFrame) -> DataFrame:
    stat = s.selectExpr(
        "*",
        "CASE WHEN both AND correction > 0D THEN ranks_a - na * (na + 1D) / 2D END AS u_stat",
        "CASE WHEN both AND correction > 0D THEN sqrt(correction * na * nb * (n + 1D) / 12D) END AS sd",
    )
    # The normal deviate of a count, half a step towards the middle.
    deviate = "({} - na * nb / 2D - 0.5D) / sd AS {}"
    return (
        stat.selectExpr(
            "*",
            deviate.format("greatest(u_stat, na * nb - u_stat)", "z_two"),
            deviate.format("(na * nb - u_stat)", "z_less"),
            deviate.format("u_stat", "z_greater"),
        )
        .withColumns({
            "tail_two": normal_tail("z_two"),
            "u_pval_less": normal_tail("z_less"),
            "u_pval_greater": normal_tail("z_greater"),
        })
        .selectExpr("*", "CASE WHEN tail_two IS NOT NULL THEN least(1D, 2D * tail_two) END AS u_pval")
    )


def two_group_summary(hist: DataFrame) -> DataFrame:
    """Mean, median and sample deviation of both groups per factor."""
    return _summarise(hist).selectExpr("factor", *_SUMMARY)


def anova_f(hist: DataFrame) -> DataFrame:
    """One-way F test of two groups; constant data gives no result."""
    return _with_anova(_summarise(hist)).select("factor", "f_stat", "f_pval")


def kruskal_h(hist: DataFrame) -> DataFrame:
    """Kruskal-Wallis test of two groups with tie correction."""
    return _with_kruskal(_summarise(hist)).select("factor", "k_stat", "k_pval")


def mann_whitney_u(hist: DataFrame, exact_up_to: int = 0) -> DataFrame:
    """Mann-Whitney U of group a, two- and one-sided probabilities.

    Normal ones; exact ones for factors without ties whose smaller group has at most ``exact_up_to`` members and whose groups make
    at most ``EXACT_PAIRS`` pairs.
    """
    return _with_mann_whitney(_summarise(hist), exact_up_to).select(
        "factor", "u_stat", "u_pval", "u_pval_less", "u_pval_greater"
    )


def ks_two_sample(hist: DataFrame, exact_pairs: int = 0) -> DataFrame:
    """Largest distance of the two distribution functions and its probability.

    Asymptotic; exact for factors whose groups make at most ``exact_pairs`` pairs (with ties that is an upper bound).
    """
    rows = _summarise(hist).selectExpr("*", "sqrt(try_divide(na * nb, n)) * ks_stat AS t")
    pval = kolmogorov_tail("t")
    if exact_pairs:
        small = F.expr(f"both AND n_a * n_b <= {exact_pairs}")
        rows = rows.withColumns({"_m": F.when(small, F.col("n_a")).cast("int"), "_n": F.when(small, F.col("n_b")).cast("int")})
        rows = rows.withColumn("_far", F.expr("bigint(round(ks_stat * _m * _n))"))
        pval = F.when(F.col("_far").isNotNull(), distance_tail("_m", "_n", "_far")).otherwise(pval)
    return rows.select("factor", "n_a", "n_b", "ks_stat", pval.alias("ks_pval"))


def significance_table(hist: DataFrame, exact_up_to: int = 0) -> DataFrame:
    """All tests for every factor in one pass, most significant first; ``exact_up_to`` as of ``mann_whitney_u``."""
    tested = _with_mann_whitney(_with_kruskal(_with_anova(_summarise(hist))), exact_up_to)
    table = tested.selectExpr(
        "factor", *_SUMMARY,
        "f_stat", "f_pval", "k_stat", "k_pval",
        "u_stat", "u_pval", "u_pval_less", "u_pval_greater",
    )
    return most_significant_first(table)
