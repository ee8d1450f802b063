"""Between long and wide lint tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repometrics import constants as C
from repometrics.operators.aggregates import mean_complexity_by_file, repo_label_profile
from repometrics.operators.filters import clean_lint_rows
from repometrics.operators.joins import attach_repo_profile, enrich_files, membership_flag
from repometrics.operators.ordering import row_numbers
from repometrics.session import settle

#: So many counters a row is a grouping compiled for.
COUNTERS = 64


def lint_counts(lint: DataFrame) -> DataFrame:
    """Messages per file and symbol: the long form everything else starts from."""
    return _messages(lint).groupBy("repo", "path", "symbol").agg(F.count(F.lit(1)).alias("n"))


def _messages(lint: DataFrame) -> DataFrame:
    return lint.filter(F.col("symbol").isNotNull() & F.col("message_id").isNotNull())


def lint_pivot(lint: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """One row per file with messages, one ``lint_<symbol>`` column per symbol.

    Up to ``COUNTERS`` named symbols are counted side by side, so a task holds a row per file and the messages are
    shuffled once; longer lists are pivoted.  Without ``symbols`` Spark looks the symbols up first; the counts are then
    written once so that the messages are read once.
    """
    if symbols and len(symbols) <= COUNTERS:
        counters = [F.nullif(F.count_if(F.col("symbol") == s), F.lit(0)).alias(s) for s in symbols]
        wide = _messages(lint).groupBy("repo", "path").agg(*counters)
    elif symbols:
        wide = _messages(lint).groupBy("repo", "path").pivot("symbol", list(symbols)).agg(F.count(F.lit(1)))
    else:
        counts = lint_counts(lint)
        if symbols is None:
            counts = settle(counts)
        wide = counts.groupBy("repo", "path").pivot("symbol").agg(F.first("n"))
    return wide.select(
        "repo", "path",
        *[F.col(f"`{c}`").alias(C.LINT_PREFIX + c) for c in wide.columns if c not in ("repo", "path")],
    )


def lint_features(lint: DataFrame) -> DataFrame:
    """One row per file with messages: ``lint``, a map of symbol to count.

    No list of all symbols is needed, so the vocabulary may grow; a file's map holds its own symbols only.
    """
    pairs = F.array_sort(F.collect_list(F.struct("symbol", "n")))
    return lint_counts(lint).groupBy("repo", "path").agg(F.map_from_entries(pairs).alias("lint"))


def widen_features(sparse: DataFrame, symbols: Sequence[str], features: str = "lint") -> DataFrame:
    """The chosen symbols of a map column as ``lint_<symbol>`` columns, as ``lint_pivot`` has them; no shuffle."""
    kept = [F.col(f"`{c}`") for c in sparse.columns if c != features]
    return sparse.select(*kept, *[F.try_element_at(features, F.lit(s)).alias(C.LINT_PREFIX + s) for s in symbols])


def feature_index(sparse: DataFrame, features: str = "lint") -> DataFrame:
    """``symbol, index, files``: every symbol of a map column in sorted order, numbered from 0."""
    used = sparse.select(F.explode(F.map_keys(features)).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("files"))
    return row_numbers(used, ["symbol"]).select("symbol", (F.col("row_number") - 1).alias("index"), "files")


def feature_arrays(sparse: DataFrame, index: DataFrame, keys: Sequence[str] = ("repo", "path"), features: str = "lint") -> DataFrame:
    """``keys``, ``indices`` (ascending) and ``values`` as doubles: the rows of a sparse matrix.

    Symbols meet the index as (key, symbol) rows, so neither has to fit into memory; a symbol that the index lacks is
    left out, and a row whose map is empty has empty arrays.
    """
    long = sparse.select(*keys, F.explode_outer(features).alias("symbol", "n"))
    found = long.join(index.select("symbol", "index"), "symbol", "left")
    entry = F.when(F.col("index").isNotNull(), F.struct("index", F.col("n").cast("double").alias("value")))
    rows = found.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return rows.select(*keys, F.transform("_e", lambda e: e["index"]).alias("indices"), F.transform("_e", lambda e: e["value"]).alias("values"))


def melt_features(df: DataFrame, ids: Sequence[str] = ("repo", "path", "cat", "loc", "is_ml_repo")) -> DataFrame:
    """Wide features as (ids, variable, value) rows; values become doubles."""
    features = [f for f in df.schema.fields if f.name not in ids]
    kept = [f.name for f in features if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    numbers = [
        (F.col(f"`{f.name}`").cast("int") if isinstance(f.dataType, T.BooleanType) else F.col(f"`{f.name}`"))
        .cast("double").alias(f.name)
        for f in features if f.name in kept
    ]
    flat = df.select(*ids, *numbers)
    return flat.unpivot(list(ids), [F.col(f"`{c}`") for c in kept], "variable", "value")


def feature_table(
    lint: DataFrame,
    loc: DataFrame,
    labels: DataFrame,
    cc: DataFrame,
    ds_ids: DataFrame,
    symbols: Sequence[str] | None = None,
) -> DataFrame:
    """All features of a file in one row, for export."""
    return _enriched(lint_pivot(clean_lint_rows(lint), symbols), loc, labels, cc, ds_ids)


def sparse_feature_table(lint: DataFrame, loc: DataFrame, labels: DataFrame, cc: DataFrame, ds_ids: DataFrame) -> DataFrame:
    """``feature_table`` with the message counts of a file in one map column, for any number of symbols."""
    return _enriched(lint_features(clean_lint_rows(lint)), loc, labels, cc, ds_ids)


def _enriched(rows: DataFrame, loc: DataFrame, labels: DataFrame, cc: DataFrame, ds_ids: DataFrame) -> DataFrame:
    files = enrich_files(rows, loc, labels, mean_complexity_by_file(cc))
    profile = membership_flag(repo_label_profile(labels), ds_ids, name="is_ml_repo")
    return attach_repo_profile(files, profile)
