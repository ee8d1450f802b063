"""Lint warnings per line of code, compared between groups of repositories.

The lint table stays long.  A (repository, symbol) cell exists only where the
symbol was reported; a file or repository without it counts as zero, and those
zeros enter histograms as one weighted row per symbol and group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repometrics import constants as C
from repometrics.operators.aggregates import describe_counted
from repometrics.operators.curves import survival_curve_by_category, survival_curve_clipped
from repometrics.operators.filters import clean_lint_rows
from repometrics.operators.joins import semi_by_ids
from repometrics.operators.stats import ks_two_sample, significance_table
from repometrics.session import settle


def lint_cells(
    lint: DataFrame,
    loc: DataFrame,
    labels: DataFrame,
    ds_ids: DataFrame,
    by_category: bool = False,
    repos: DataFrame | None = None,
    include_clean_files: bool = False,
) -> DataFrame:
    """(repo, [cat,] is_ml_repo, symbol, value, loc, is_first) for symbols that occur.

    ``value`` counts messages in files with ``loc > 0``; ``loc`` is the size of
    all such files of the repository (and category), null if it has none;
    ``is_first`` marks one cell per repository (and category).  Files without
    any message take no part unless ``include_clean_files``.
    """
    rows = clean_lint_rows(lint)
    if not include_clean_files:
        rows = rows.filter(F.col("symbol").isNotNull() & F.col("message_id").isNotNull())
    keys = ["repo", "path"]
    # The raw messages shrink here, before any join.
    counts = rows.groupBy(*keys, "symbol").agg(F.count("message_id").alias("n"))
    if repos is not None:
        counts = semi_by_ids(counts, repos)
    files = counts.join(loc.select(*keys, F.col("nonblank_loc").alias("loc")), keys, "left")
    unit = ["repo"]
    if by_category:
        files = files.join(labels.select(*keys, "cat"), keys, "left").withColumn(
            "cat", F.coalesce("cat", F.lit("0"))
        )
        unit = ["repo", "cat"]
    in_file = Window.partitionBy(*keys).orderBy("symbol")
    kept = F.coalesce(F.col("loc") > 0, F.lit(False))
    sized = files.withColumn("_once", F.row_number().over(in_file) == 1).select(
        *unit, "symbol",
        F.when(kept, F.col("n")).otherwise(0).alias("n"),
        F.when(kept & F.col("_once"), F.col("loc")).alias("_loc"),
    )
    cells = sized.groupBy(*unit, "symbol").agg(F.sum("n").alias("value"), F.sum("_loc").alias("_loc"))
    # From here a repository has at most one row per symbol and category.
    in_unit = Window.partitionBy(*unit)
    cells = cells.select(
        *unit, "symbol", "value",
        F.sum("_loc").over(in_unit).alias("loc"),
        (F.row_number().over(in_unit.orderBy("symbol")) == 1).alias("is_first"),
    )
    # A repository without labels has no profile and counts as "other".
    # Labels shrink to one row per repository before they meet the ids.
    labelled = labels.select("repo").distinct()
    ml_repos = (
        ds_ids.select(F.col("id").alias("repo")).distinct()
        .join(labelled, "repo", "left_semi")
        .withColumn("is_ml_repo", F.lit(True))
    )
    return cells.join(ml_repos, "repo", "left").withColumn(
        "is_ml_repo", F.coalesce("is_ml_repo", F.lit(False))
    )


def _densities(cells: DataFrame, unit: Sequence[str], dense: bool, symbols: Sequence[str] | None) -> DataFrame:
    if not dense:
        return cells.filter(F.col("value") > 0).select(
            *unit, F.concat(F.lit(C.LINT_PREFIX), "symbol").alias("variable"), "value", "loc",
            (F.col("value") / F.col("loc")).alias("normval"),
        )
    if symbols is None:
        cells = settle(cells)
        # the linter's vocabulary, not the data, bounds this list
        names = cells.agg(F.array_sort(F.collect_set("symbol"))).scalar()
    else:
        names = F.array(*[F.lit(s) for s in symbols])
    # One row per unit holding its own symbols, then one row per symbol of the list.
    packed = cells.filter(F.col("loc") > 0).groupBy(*unit, "loc").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("symbol").isNotNull(), F.struct("symbol", "value")))
        ).alias("_values")
    )
    spread = packed.select(*unit, "loc", "_values", F.explode(names).alias("symbol"))
    value = F.coalesce(F.try_element_at("_values", F.col("symbol")), F.lit(0))
    return spread.select(
        *unit, F.concat(F.lit(C.LINT_PREFIX), "symbol").alias("variable"), value.alias("value"), "loc",
        (value / F.col("loc")).alias("normval"),
    )


def lint_density_by_repo(
    lint: DataFrame,
    loc: DataFrame,
    labels: DataFrame,
    ds_ids: DataFrame,
    dense: bool = False,
    symbols: Sequence[str] | None = None,
    include_clean_files: bool = False,
) -> DataFrame:
    """Messages, lines and messages per line by repository and symbol.

    ``dense=True`` adds the zero rows of symbols a repository never shows.
    """
    cells = lint_cells(lint, loc, labels, ds_ids, include_clean_files=include_clean_files)
    return _densities(cells, ["repo", "is_ml_repo"], dense, symbols)


def lint_density_by_category(
    lint: DataFrame,
    loc: DataFrame,
    labels: DataFrame,
    ds_ids: DataFrame,
    dense: bool = False,
    symbols: Sequence[str] | None = None,
    include_clean_files: bool = False,
) -> DataFrame:
    """The same by repository, file category and symbol."""
    cells = lint_cells(
        lint, loc, labels, ds_ids, by_category=True, include_clean_files=include_clean_files
    )
    return _densities(cells, ["repo", "is_ml_repo", "cat"], dense, symbols)


def _histogram(cells: DataFrame, groups: Mapping[str, Column]) -> DataFrame:
    """(factor, x, one count column per group) with the zeros added as weights."""
    sized = F.col("loc") > 0
    seen = sized & (F.col("value") > 0)
    x = F.when(seen, F.col("value") / F.col("loc")).otherwise(F.lit(0.0))
    counted = settle(
        cells.groupBy(F.concat(F.lit(C.LINT_PREFIX), "symbol").alias("factor"), x.alias("x")).agg(
            *[F.count_if(seen & member).alias(g) for g, member in groups.items()],
            *[F.count_if(sized & F.col("is_first") & member).alias(f"_all_{g}") for g, member in groups.items()],
        )
    )
    everyone = counted.agg(F.struct(*[F.sum(f"_all_{g}").alias(g) for g in groups])).scalar()
    named = counted.filter(F.col("factor").isNotNull())
    zeros = named.groupBy("factor").agg(
        F.lit(0.0).alias("x"), *[(everyone[g] - F.sum(f"`{g}`")).alias(g) for g in groups]
    )
    shown = named.filter(F.col("x") > 0).select("factor", "x", *[F.col(f"`{g}`") for g in groups])
    return shown.unionByName(zeros)


def repo_histogram(cells: DataFrame) -> DataFrame:
    """Histogram of warnings per line: a is the data-science group, b the other."""
    return _histogram(cells, {"a": F.col("is_ml_repo"), "b": ~F.col("is_ml_repo")})


def deep_cells(cells: DataFrame, cats: Sequence[str] = C.CATEGORIES) -> DataFrame:
    """Category cells of repositories that have sized files in every category."""
    # a repository has one row per symbol and category here
    in_repo = Window.partitionBy("repo")
    sized = F.col("loc") > 0
    deep = F.lit(True)
    for cat in cats:
        deep = deep & F.bool_or(F.coalesce(sized & (F.col("cat") == cat), F.lit(False))).over(in_repo)
    return cells.withColumn("_deep", deep).filter(F.col("_deep")).drop("_deep")


def category_histogram(cells: DataFrame, is_ml: bool, cats: Sequence[str] = C.CATEGORIES) -> DataFrame:
    """Histogram of warnings per line with one count column per file category."""
    rows = deep_cells(cells, cats).filter(F.col("is_ml_repo") == F.lit(is_ml))
    return _histogram(rows, {c: F.col("cat") == c for c in cats})


def lint_significance(
    lint: DataFrame,
    loc: DataFrame,
    labels: DataFrame,
    ds_ids: DataFrame,
    nonds_ids: DataFrame,
    include_clean_files: bool = False,
) -> DataFrame:
    """Which warnings differ between the two groups of selected repositories."""
    tagged = ds_ids.select("id", F.lit(True).alias("in_ds")).unionAll(
        nonds_ids.select("id", F.lit(False).alias("in_ds"))
    )
    # Ids usually come from a selection over whole tables; it runs once, not once per use.
    chosen = settle(tagged.groupBy("id").agg(F.bool_or("in_ds").alias("in_ds")))
    cells = lint_cells(
        lint, loc, labels, chosen.filter("in_ds"), repos=chosen, include_clean_files=include_clean_files
    )
    return significance_table(repo_histogram(cells))


def deep_sizes(cells: DataFrame, cats: Sequence[str] = C.CATEGORIES) -> DataFrame:
    """Sizes of deep repositories by group and category.

    Each size stands once per symbol, as in the dense table.
    """
    symbols = cells.agg(F.countDistinct("symbol")).scalar()
    sizes = (
        deep_cells(cells, cats)
        .filter(F.col("is_first") & (F.col("loc") > 0))
        .groupBy("is_ml_repo", "cat", F.col("loc").cast("double").alias("x"))
        .agg((F.count(F.lit(1)) * symbols).alias("n"))
    )
    return describe_counted(sizes, ["is_ml_repo", "cat"])


def density_summary(cells: DataFrame) -> DataFrame:
    """Summary of warnings per line over all cells, zeros included."""
    counted = _histogram(cells, {"n": F.lit(True)}).groupBy("x").agg(F.sum("n").alias("n"))
    return describe_counted(counted.filter(F.col("n") > 0), [])


class Results(Mapping):
    """Frames by name, each built once, when it is first looked up."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders, self._built = dict(builders), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def lint_curves(
    cells: DataFrame, caps: Mapping[str, float] | None = None
) -> dict[str, Callable[[], DataFrame]]:
    """Curves of warnings per line of both repository groups, and a test per symbol, each built when called.

    ``caps`` names the dims and where their curves end; without it the usual
    symbols, all at ``CURVE_CAP``.
    """
    caps = caps if caps is not None else {f"{C.LINT_PREFIX}{s}": C.CURVE_CAP for s in C.LINT_DIMENSIONS}

    @cache
    def hist() -> DataFrame:
        return settle(repo_histogram(cells).filter(F.col("factor").isin(*caps)))

    return {
        "curves": lambda: survival_curve_clipped(hist(), cap=caps),
        "tests": lambda: ks_two_sample(hist()),
    }


def lint_by_category(
    lint: DataFrame,
    loc: DataFrame,
    labels: DataFrame,
    ds_ids: DataFrame,
    dims: Sequence[str] | None = None,
    cap: float = C.CURVE_CAP,
) -> Mapping[str, DataFrame]:
    """Densities by file category, sizes of deep repositories, curves of both groups.

    Deep repositories have sized files in every category; sizes and curves
    look at those only.  A result is built, and its jobs run, when it is first asked for.
    """

    @cache
    def cells() -> DataFrame:
        return settle(lint_cells(lint, loc, labels, ds_ids, by_category=True))

    return Results({
        "density": lambda: _densities(cells(), ["repo", "is_ml_repo", "cat"], dense=False, symbols=None),
        "density_summary": lambda: density_summary(cells()),
        "deep_repos": lambda: deep_cells(cells()).select("repo").distinct(),
        "deep_sizes": lambda: deep_sizes(cells()),
        "curves_ds": lambda: survival_curve_by_category(category_histogram(cells(), True), dims, cap),
        "curves_nonds": lambda: survival_curve_by_category(category_histogram(cells(), False), dims, cap),
    })
