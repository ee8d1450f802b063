"""Manifests, bucketed tables, observed probes, repeatable runs, sketches and sparse features."""

import random

import pytest
from pyspark.sql import functions as F

from repometrics import sources
from repometrics.operators import aggregates, filters, joins, reshape
from repometrics.sources import manifest


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tree(tmp_path):
    files = {"11/pkg/__init__.py": b"", "11/pkg/a.py": b"x = 1\n", "11/_b/c d.py": b"caf\xc3\xa9 \xff\n", "12/a+b %20c.py": b"y" * 5000, "12/notes.txt": b"no", "13/z.py": b"z", "top.py": b"t", "x/y.py": b"u"}
    for path, data in files.items():
        file = tmp_path / "corpus" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    return str(tmp_path / "corpus"), files


@pytest.mark.parametrize("batch", [4_000, 10_000, 64_000_000])
def test_files_of_a_manifest(spark, tree, values, batch):
    """Every batch size reads each file once; no file index is in the plan."""
    root, files = tree
    listed = sources.list_source_files(spark, root)
    assert values(listed) == sorted((p, len(d)) for p, d in files.items() if p.endswith(".py"))
    rows = sources.scan_source_files(spark, root, manifest=listed, batch_bytes=batch)
    assert values(rows, "path", "content") == sorted((p, d.decode("utf-8", "replace")) for p, d in files.items() if p.endswith(".py"))
    assert {r.repo for r in rows.collect()} == {11, 12, 13, None}
    plan = plan_of(rows)
    assert "listed_files" in plan and "binaryFile" not in plan and "FileScan" not in plan


def test_manifest_of_some_repositories(spark, tree, make, values):
    """Only the folders of the ids are listed, only their files opened; what is not there has no content."""
    root, _ = tree
    ids = make([(12,), (13,), (99,), (None,), (13,)], "id bigint")
    assert values(sources.list_source_files(spark, f"file://{root}/", ids), "path") == [("12/a+b %20c.py",), ("13/z.py",)]
    assert values(sources.list_source_files(spark, root, ids, suffix=".txt"), "path") == [("12/notes.txt",)]
    named = make([("12/gone.py",), ("13/z.py",), ("13/z.py",), ("11/pkg/a.py",), ("12/notes.txt",), (None,)], "path string")
    rows = sources.scan_source_files(spark, root, ids, manifest=named)
    assert values(rows) == [(12, "12/gone.py", None), (13, "13/z.py", "z")]
    assert sources.scan_source_files(spark, root, manifest=named.filter("false")).count() == 0


def test_one_large_file_among_small_ones(spark, tmp_path, make):
    """A file larger than a batch is a batch of its own; the numbers it spans are empty."""
    (tmp_path / "1").mkdir()
    for k in range(30):
        (tmp_path / "1" / f"{k:02}.py").write_text("a" * (3_000_000 if k == 7 else 10))
    rows = sources.scan_source_files(spark, str(tmp_path), manifest=sources.list_source_files(spark, str(tmp_path)), batch_bytes=50_000)
    assert sorted(r.n for r in rows.select(F.length("content").alias("n")).collect()) == [10] * 29 + [3_000_000]
    assert rows.rdd.getNumPartitions() > 10


def test_very_many_small_batches(spark, tmp_path, values, monkeypatch):
    """Batches are made larger where there would be over 500 tasks and folders, up to a bound; every file is read once."""
    (tmp_path / "1").mkdir()
    for k in range(700):
        (tmp_path / "1" / f"{k:03}.py").write_text(f"a{k}")
    listed = spark.createDataFrame(sources.list_source_files(spark, str(tmp_path)).collect(), "path string, bytes bigint")
    rows = sources.scan_source_files(spark, str(tmp_path), manifest=listed, batch_bytes=4_000)
    assert 300 < rows.rdd.getNumPartitions() <= manifest.BATCHES
    assert values(rows) == [(1, f"1/{k:03}.py", f"a{k}") for k in range(700)]
    monkeypatch.setattr(manifest, "FULL", 4_200)
    bounded = sources.scan_source_files(spark, str(tmp_path), manifest=listed, batch_bytes=4_000)
    assert 600 < bounded.rdd.getNumPartitions() <= 700
    few = sources.scan_source_files(spark, str(tmp_path), manifest=listed.limit(30), batch_bytes=4_000)
    assert 25 <= few.rdd.getNumPartitions() <= 31


def lint_rows(n=3000):
    rng = random.Random(4)
    return [(rng.randint(1, 9), f"f{rng.randint(1, 60)}.py", rng.choice(["a", "b", "c-d", "é", None]), "M1") for _ in range(n)]


LINT = "repo bigint, path string, symbol string, message_id string"


def test_bucketed_tables_join_without_a_shuffle(spark, make, values, tmp_path):
    lint = make(lint_rows(), LINT)
    loc = make([(r, f"f{p}.py", p, False) for r in range(1, 9) for p in range(1, 50)], "repo bigint, path string, nonblank_loc bigint, internal_error boolean")
    labels = make([(r, f"f{p}.py", "ml0") for r in range(1, 9) for p in range(20, 60)], "repo bigint, path string, cat string")
    cc = make([(r, f"f{p}.py", "function", p) for r in range(1, 9) for p in range(1, 60, 3)], "repo bigint, path string, type string, complexity int")
    stored = [sources.write_bucketed(df, f"bucketed_{k}", str(tmp_path / str(k)), buckets=4) for k, df in enumerate((lint, loc, labels, cc))]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        def joined(a, b, c, d):
            return joins.enrich_files(reshape.lint_counts(a), b, c, aggregates.mean_complexity_by_file(d))

        plan = plan_of(joined(*stored))
        assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 3, plan
        assert values(joined(*stored)) == values(joined(lint, loc, labels, cc))
        assert plan_of(joined(lint, loc, labels, cc)).count("Exchange") >= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for k in range(4):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{k}")


def test_buckets_follow_the_rows(spark, make, values, tmp_path):
    """The largest table decides for all; a task reads no more rows when there are more, and nothing is shuffled."""
    none = make([], LINT)
    assert sources.bucket_count([none]) == 8 and sources.bucket_count([none], least=1) == 1
    for rows in (2_000, 8_000):
        lint = make(lint_rows(rows), LINT).withColumn("path", F.concat("path", F.monotonically_increasing_id().cast("string")))
        loc = lint.select("repo", "path", F.lit(1).alias("nonblank_loc")).limit(50)
        buckets = sources.bucket_count([loc, lint], rows=100)
        assert buckets == rows // 100
        stored = [sources.write_bucketed(df, f"following_{k}", str(tmp_path / f"{rows}-{k}"), buckets=buckets) for k, df in enumerate((lint, loc))]
        try:
            joined = reshape.lint_pivot(stored[0], ["a", "b"]).hint("merge").join(stored[1], ["repo", "path"], "left")
            assert "Exchange" not in plan_of(joined)
            assert values(joined) == values(reshape.lint_pivot(lint, ["a", "b"]).join(loc, ["repo", "path"], "left"))
            most = stored[0].groupBy(F.col("_metadata.file_path").alias("bucket")).count().agg(F.max("count")).first()[0]
            assert most <= 200
        finally:
            for k in range(2):
                spark.sql(f"DROP TABLE IF EXISTS following_{k}")


def test_probes_come_from_the_tasks_that_write(spark, make, values, tmp_path):
    """One scan writes and counts; the counts are those of a pass of their own."""
    rows = make([(k, None if k % 3 else "x") for k in range(1000)], "id bigint, name string")
    sources.write_table(rows, str(tmp_path / "in"))
    read = spark.read.parquet(str(tmp_path / "in"))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    checks = {"no name": F.col("name").isNull(), "large`id": F.col("id") > 900, "none": F.lit(None).cast("boolean")}
    probes = sources.write_with_probes(read.mapInArrow(counted, read.schema), str(tmp_path / "out"), checks)
    assert values(probes) == values(filters.quality_probes(rows, {k.replace("`", ""): c for k, c in checks.items()}).withColumn(
        "probe", F.replace("probe", F.lit("largeid"), F.lit("large`id"))), "probe", "hits", "total")
    assert seen.value == 1000 and spark.read.parquet(str(tmp_path / "out")).count() == 1000
    empty = sources.write_with_probes(rows.filter("false"), str(tmp_path / "none"), checks)
    assert values(empty, "hits", "total") == [(0, 0)] * 3


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_a_run_written_twice_is_there_once(spark, make, values, tmp_path, fmt):
    path = str(tmp_path / "runs")

    def stored():
        return values(spark.read.format(fmt).schema("id bigint, run string").options(header="true").load(path), "run", "id")

    sources.append_run(make([(1,), (2,)], "id bigint"), path, "a", fmt)
    sources.append_run(make([(3,)], "id bigint"), path, "b/ %", fmt)
    once = stored()
    sources.append_run(make([(1,), (2,)], "id bigint"), path, "a", fmt)
    assert stored() == once == [("a", 1), ("a", 2), ("b/ %", 3)]
    sources.append_run(make([(5,)], "id bigint"), path, "a", fmt)
    assert stored() == [("a", 5), ("b/ %", 3)]


def test_cardinality_sketches(spark, make, values):
    """Exact for few values, within the bound for many, the same whichever way chunks are merged; one row per row read."""
    rows = spark.range(200_000).select(
        F.col("id"), (F.col("id") % 7).alias("few"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("é"), F.col("id") % 30_000)).alias("half"),
        F.lit(None).cast("string").alias("none"), (F.col("id") % 20).alias("chunk"))
    columns = ["id", "few", "half", "none"]
    by_chunk = aggregates.cardinality_sketches(rows, columns, ["chunk"])
    found = {r.column: r for r in aggregates.sketched_cardinality(by_chunk).collect()}
    for name, known, exact in (("id", 200_000, 200_000), ("few", 200_000, 7), ("half", 100_000, 15_000), ("none", 0, 0)):
        assert found[name].known == known
        assert abs(found[name].distinct_values - exact) <= 4 * 0.83 / 64 * exact, name
    assert found["few"].distinct_values == 7
    whole = {r.column: r.distinct_values for r in aggregates.sketched_cardinality(aggregates.cardinality_sketches(rows, columns)).collect()}
    assert all(abs(whole[c] - found[c].distinct_values) <= 0.02 * whole[c] + 1 for c in columns)
    assert "Expand" not in aggregates.cardinality_sketches(rows, columns)._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]
    assert aggregates.sketched_cardinality(aggregates.cardinality_sketches(rows.filter("false"), columns)).filter("distinct_values > 0").count() == 0


def test_named_symbols_are_counted_in_one_grouping(make, values):
    """One shuffle of one row per file and task, two aggregates; the rows are those of a pivot, also for long lists."""
    rows = [*lint_rows(), (1, "f1.py", "x=1,y", "M"), (2, "only.py", None, "M"), (3, "none.py", "a", None), (4, "other.py", "rare", "M"), (None, None, "a", "M"), (None, None, "a", "M")]
    symbols = ["a", "b", "c-d", "x=1,y", "é", "absent"]
    lint = make(rows, LINT)
    counted = {}
    for repo, path, symbol, message in rows:
        if symbol is not None and message is not None:
            counted.setdefault((repo, path), dict.fromkeys(symbols))
            if symbol in symbols:
                counted[repo, path][symbol] = (counted[repo, path][symbol] or 0) + 1
    expected = {(*key, *found.values()) for key, found in counted.items()}
    wide = reshape.lint_pivot(lint, symbols)
    assert {tuple(r) for r in wide.collect()} == expected and wide.count() == len(expected)
    assert (4, "other.py", *[None] * 6) in expected and (None, None, 2, *[None] * 5) in expected
    plan = plan_of(wide).split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("HashAggregate(") == 2, plan
    long = reshape.lint_pivot(lint, [*symbols, *[f"s{k}" for k in range(reshape.COUNTERS)]])
    assert {tuple(r)[:8] for r in long.collect()} == expected and long.count() == len(expected)
    assert [t for _, t in wide.dtypes] == [t for _, t in long.dtypes][:8] == ["bigint", "string", *["bigint"] * 6]


def test_sparse_features_are_the_wide_ones(make, values):
    lint = make([*lint_rows(), (1, "f1.py", "x=1,y", "M"), (2, "only.py", None, "M"), (3, "f3.py", "a", None)], LINT)
    symbols = ["a", "b", "c-d", "x=1,y", "é", "absent"]
    sparse = reshape.lint_features(lint)
    wide = reshape.lint_pivot(lint, symbols)
    assert values(reshape.widen_features(sparse, symbols)) == values(wide)
    assert reshape.widen_features(sparse, symbols).columns == wide.columns
    index = reshape.feature_index(sparse)
    assert [(r.symbol, r["index"]) for r in index.orderBy("index").collect()] == [(s, k) for k, s in enumerate(sorted(symbols[:-1], key=str.encode))]
    names = sorted(symbols[:-1], key=str.encode)
    for r in reshape.feature_arrays(sparse, index).join(wide, ["repo", "path"]).collect():
        assert [(names[i], v) for i, v in zip(r.indices, r["values"], strict=True)] == [(s, float(r[f"lint_{s}"])) for s in names if r[f"lint_{s}"] is not None]
    # a symbol that is not in the index, and a row without any
    few = reshape.feature_arrays(sparse, index.filter("symbol = 'é'")).collect()
    assert len(few) == sparse.count() and all(r.indices in ([], [4]) for r in few)


def test_any_vocabulary_without_a_pivot(spark):
    """More symbols than a pivot takes; the plan has no column for each."""
    rows = spark.range(40_000).select((F.col("id") % 50).alias("repo"), F.lit("p").alias("path"), F.concat(F.lit("s"), F.col("id")).alias("symbol"), F.lit("M").alias("message_id"))
    sparse = reshape.lint_features(rows)
    assert len(sparse.columns) == 3
    arrays = reshape.feature_arrays(sparse, reshape.feature_index(sparse))
    assert {(len(r.indices), r.indices == sorted(r.indices)) for r in arrays.collect()} == {(800, True)}
    assert arrays.select(F.explode("indices")).distinct().count() == 40_000
