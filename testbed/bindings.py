"""Logical tables derived from the star-schema test tables.

customer = repository, order = file, line item = lint message, block or import.
``ctes`` in ``oracles.py`` states the same bindings in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repometrics.functions import epoch_iso, py_version_label
from repometrics.operators.aggregates import version_table
from repometrics.operators.reports import commit_span
from repometrics.session import scratch_path, settle
from repometrics.sources.manifest import file_system

DS_SEGMENT = "MACHINERY"
LIBS = ("blue", "hot", "red", "small")
TESTS = ("new", "old")
SYMBOLS = ("AF", "AO", "NF", "NO", "RF", "RO")
TERMS = ("license", "data", "hesh")
#: Before and after a word, and where in the line its tag begins if that is in a comment; the lines follow each other.
QUOTED = (
    ("x = 1  # TODO ", ""), ('x = "# TODO ', '"'), ("x = '# TODO ", "' # fixme: 'again'"), ('"""# TODO ', ""), ("# XXX ", ""),
    ("it's \\\"\"\" # TODO ", ""), ('closed """ # XXX ', ""), ("y = '''# TODO ", "''' + \"a'b\"  # TODO \"c"), ("# todo ", ' """ open'), ("z = '\\\\' # XXX '", ""),
)


class Tables:
    """Logical tables of one data folder, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- repositories ------------------------------------------------------

    def meta(self) -> DataFrame:
        per_repo = self.raw("orders").groupBy("o_custkey").agg(
            F.min("o_orderdate").alias("created_at"),
            F.max("o_orderdate").alias("updated_at"),
            F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("pushed_at"),
            F.count_if(F.col("o_orderstatus") == "O").alias("open_issues_count"),
            F.count(F.lit(1)).alias("watch"),
        )
        return self.raw("customer").join(per_repo, F.col("c_custkey") == F.col("o_custkey"), "left").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.floor("c_acctbal").alias("stars"),
            "created_at", "updated_at", "pushed_at",
            F.floor(F.abs("c_acctbal") * 10).alias("size"),
            F.col("c_mktsegment").alias("language"),
            F.col("c_nationkey").cast("bigint").alias("forks_count"),
            "open_issues_count", "watch",
            F.least(F.col("watch"), F.lit(30)).cast("int").alias("number_of_contributors"),
        )

    def ds_ids(self) -> DataFrame:
        rows = self.raw("customer").filter(F.col("c_mktsegment") == DS_SEGMENT)
        return rows.select(F.col("c_custkey").alias("id"))

    def nonds_ids(self) -> DataFrame:
        rows = self.raw("customer").filter(F.col("c_mktsegment") != DS_SEGMENT)
        return rows.select(F.col("c_custkey").alias("id"))

    def ds_meta(self) -> DataFrame:
        return self.meta().filter(F.col("language") == DS_SEGMENT)

    def nonds_meta(self) -> DataFrame:
        return self.meta().filter(F.col("language") != DS_SEGMENT)

    def commits(self) -> DataFrame:
        day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint")
        committed = day * 86400
        authored = committed - F.floor("o_totalprice")
        return self.raw("orders").select(
            F.col("o_custkey").alias("repo"),
            (-(day * 10_000_000_000 + F.col("o_orderkey"))).alias("traversal_order"),
            committed.alias("committed_epoch"), epoch_iso(committed).alias("committed_iso"),
            authored.alias("authored_epoch"), epoch_iso(authored).alias("authored_iso"),
        )

    def git(self) -> DataFrame:
        return commit_span(self.commits(), self.raw("customer").select(F.col("c_custkey").alias("id")))

    # --- files -------------------------------------------------------------

    def versions(self) -> DataFrame:
        label = py_version_label(F.col("o_orderstatus") != "F", F.col("o_orderpriority") != "1-URGENT")
        return self.raw("orders").select(*_file(), label.alias("ver"))

    def version_tab(self) -> DataFrame:
        return version_table(self.versions())

    def loc(self) -> DataFrame:
        price = F.col("o_totalprice")
        lines = F.when(price >= 20000, F.floor(price / 100)).when(price >= 5000, F.lit(0).cast("bigint"))
        return self.raw("orders").select(
            *_file(), lines.alias("nonblank_loc"), (price < 5000).alias("internal_error")
        )

    def labels(self) -> DataFrame:
        cat = (
            F.when(F.col("o_orderstatus") == "F", "ml0")
            .when(F.col("o_orderstatus") == "O", "no-ml-dependency")
            .otherwise("test")
        )
        labelled = self.raw("orders").filter(F.col("o_orderpriority") != "5-LOW")
        return labelled.select(*_file(), cat.alias("cat"))

    def _lines(self, how: str = "inner") -> DataFrame:
        return self.raw("orders").join(
            self.raw("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), how
        )

    def lint(self) -> DataFrame:
        flag, symbol = F.col("l_returnflag"), F.concat("l_returnflag", "l_linestatus")
        kind = (
            F.when(flag == "A", "convention").when(flag == "N", "warning")
            .when(flag == "R", F.when(F.col("l_tax") >= 0.08, "fatal").otherwise("error"))
        )
        syntax = (flag == "R") & (F.col("l_quantity") >= 49)
        return self._lines("left").select(
            *_file(), kind.alias("type"), symbol.alias("symbol"),
            F.when(syntax, "E0001").otherwise(F.concat(F.lit("M"), symbol)).alias("message_id"),
            F.col("l_linenumber").alias("line"),
            F.coalesce(F.col("l_quantity") == 50, F.lit(False)).alias("parse_error"),
            F.coalesce(F.col("l_discount") >= 0.1, F.lit(False)).alias("internal_error"),
        )

    def cc(self) -> DataFrame:
        flag = F.col("l_returnflag")
        kind = F.when(flag == "A", "method").when(flag == "N", "function").otherwise("class")
        return self._lines().select(
            *_file(), kind.alias("type"), F.col("l_quantity").cast("int").alias("complexity")
        )

    def imports(self) -> DataFrame:
        name = F.when(F.col("l_discount") > 0, F.col("p_name"))
        return self._lines().join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            *_file(), F.col("p_type").alias("module_name"), name.alias("import_name"),
            (F.col("l_tax") >= 0.08).alias("parse_error"),
        )

    # --- text --------------------------------------------------------------

    def source(self) -> DataFrame:
        return self.raw("documents").select(
            F.substring("source", 4, 10).cast("bigint").alias("repo"),
            F.col("doc_id").cast("string").alias("path"),
            F.col("text").alias("content"),
        )

    def source_tree(self) -> tuple[str, DataFrame]:
        """The documents as files ``<repo>/[_pkg/]<name>.py`` of a folder, written by tasks; the folder and the paths."""
        root = scratch_path(self.spark, f"tree-{uuid.uuid4().hex}")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, top = file_system(root)
            made = set()
            for batch in batches:
                for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (folder := path.rpartition("/")[0]) not in made:
                        fs.create_dir(f"{top}/{folder}", recursive=True)
                        made.add(folder)
                    with fs.open_output_stream(f"{top}/{path}") as file:
                        file.write(content)
                yield batch.select(["path"])

        rows = self.raw("documents").select(
            F.concat(
                F.substring("source", 4, 10), F.when(F.col("doc_id") % 5 == 0, "/_pkg/__init__").otherwise("/m "),
                F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 11 == 0, ".txt").otherwise(".py")).alias("path"),
            F.encode(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.coalesce("text", F.lit(""))), "UTF-8").alias("content"))
        return root, settle(rows.mapInArrow(write, "path string"))

    def quoted_source(self) -> DataFrame:
        """Python files with tags in comments and in strings, one line of each kind for a word of a document."""
        words = F.slice(F.split("text", "[^A-Za-z]+"), 1, 8)
        lines = F.array_join(F.flatten(F.transform(words, lambda w: F.transform(
            F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in QUOTED)), lambda q: F.concat(q["a"], w, q["b"])))), "\n")
        return self.raw("documents").select(
            F.substring("source", 4, 10).cast("bigint").alias("repo"), F.col("doc_id").cast("string").alias("path"), lines.alias("content"))

    def pages(self) -> DataFrame:
        return self.raw("pages").select(
            F.col("page_id").alias("repo"), F.col("url").alias("path"), F.col("html").alias("content")
        )

    def projects(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("id"), F.col("source").alias("name"),
            F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("url"),
            F.col("text").alias("description"), F.col("lang").alias("language"),
            F.when(F.col("n_chars") > 6000, F.col("doc_id") - 1).alias("forked_from"),
        )

    def watchers(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").alias("repo_id"), F.col("event_id").alias("user_id")
        )

    # --- reports: the output a tool would have printed ---------------------

    def lint_reports(self) -> DataFrame:
        kind, number = F.col("event_type"), F.floor("value").cast("int")
        message = F.struct(
            F.lit("convention").alias("type"), F.lit("m").alias("module"), F.lit("").alias("obj"),
            number.alias("line"), F.lit(0).alias("column"), F.lit("m.py").alias("path"),
            F.concat(F.lit("sym-"), kind).alias("symbol"), F.concat(F.lit("say \"x\"\n"), kind).alias("message"),
            F.when(number > 50, "E0001").otherwise("C0103").alias("message-id"),
        )
        again = F.struct(*[
            (F.lit("W0611") if n == "message-id" else F.lit("unused-import") if n == "symbol" else message[n]).alias(n)
            for n in ("type", "module", "obj", "line", "column", "path", "symbol", "message", "message-id")
        ])
        stdout = (
            F.when(kind == "click", F.to_json(F.array(message, again)))
            .when(kind == "view", F.to_json(F.array(message)))
            .when(kind == "purchase", "").when(kind == "signup", "[]").otherwise("not { json")
        )
        stderr = F.when(F.col("value") > 30, "Using config file /x\n\n").when(
            F.col("value") > 20, "Using config file /x\nwarning: odd file"
        ).otherwise("")
        return self._events(stdout, stderr)

    def block_reports(self) -> DataFrame:
        kind, number = F.col("event_type"), F.floor("value").cast("int")
        block = F.struct(
            F.lit("method").alias("type"), F.lit("A").alias("rank"), number.alias("lineno"),
            kind.alias("name"), F.lit(4).alias("col_offset"), (number + 1).alias("complexity"),
            (number + 9).alias("endline"),
            F.transform(F.sequence(F.lit(1), number % 3 + 1), lambda i: F.struct(i.alias("lineno"))).alias("methods"),
        )
        plain = F.struct(*[
            block[n].alias(n) for n in ("type", "rank", "lineno", "name", "col_offset", "complexity", "endline")
        ])
        inner = F.concat(F.col("event_id").cast("string"), F.lit(".py"))
        stdout = (
            F.when(kind == "click", _keyed(inner, F.to_json(F.array(block))))
            .when(kind == "view", _keyed(inner, F.concat(
                F.lit("["), F.to_json(plain), F.lit(","), F.to_json(block), F.lit("]"))))
            .when(kind == "purchase", _keyed(inner, F.lit('{"error": "invalid syntax"}')))
            .when(kind == "signup", _keyed(inner, F.lit("[]")))
            .otherwise("{}")
        )
        stderr = F.when(F.col("value") > 40, "  \n").when(F.col("value") > 25, "oops").otherwise("")
        return self._events(stdout, stderr, suffix=".py")

    def counter_reports(self) -> DataFrame:
        kind, number = F.col("event_type"), F.floor("value").cast("int")
        counters = F.to_json(F.struct(
            number.alias("loc"), (number + 1).alias("lloc"), (number + 2).alias("sloc"),
            F.lit(3).alias("comments"), F.lit(4).alias("multi"), F.lit(5).alias("blank"),
            F.lit(6).alias("single_comments"),
        ))
        inner = F.concat(F.col("event_id").cast("string"), F.lit(".py"))
        stdout = (
            F.when(kind == "purchase", _keyed(inner, F.lit('{"error": "invalid syntax"}')))
            .when(kind == "error", "broken").otherwise(_keyed(inner, counters))
        )
        return self._events(stdout, F.when(F.col("value") > 30, "oops").otherwise(""), suffix=".py")

    def import_listings(self) -> DataFrame:
        kind, key = F.col("event_type"), F.col("event_id").cast("string")
        stdout = (
            F.when(kind == "click", F.concat(F.lit("pkg.m"), key, F.lit(":\n  os.path\n  numpy.linalg \n\n")))
            .when(kind == "view", F.concat(F.lit(" m"), key, F.lit(" :\n")))
            .when(kind == "purchase", "").otherwise("  lost\n")
        )
        return self._events(stdout, F.lit(""))

    def diff_reports(self) -> DataFrame:
        kind = F.col("event_type")
        body = F.concat(
            F.lit("--- a\n+++ a\n@@ -1 +1 @@\n-print x\n+print(x)\n same\n"),
            F.when(F.col("value") > 20, "-old\n").otherwise(""),
        )
        stdout = F.when(kind == "click", body).when(kind == "view", "--- only\n").otherwise("")
        stderr = F.when(kind == "error", "RefactoringTool: Can't parse x.py").otherwise("fine")
        return self._events(stdout, stderr)

    def count_reports(self) -> DataFrame:
        kind = F.col("event_type")
        number = F.concat(F.floor("value").cast("string"), F.lit("\n"))
        stdout = F.when(kind == "error", "no file").when(kind == "view", "").otherwise(number)
        return self._events(stdout, F.when(F.col("value") > 30, "oops").otherwise(" \n"))

    def _events(self, stdout: Column, stderr: Column, suffix: str = "") -> DataFrame:
        repo = F.col("user_id")
        path = F.concat_ws("/", repo.cast("string"), F.concat(F.col("event_id").cast("string"), F.lit(suffix)))
        return self.raw("events").select(
            repo.alias("repo"), path.alias("path"), stdout.alias("stdout"), stderr.alias("stderr")
        )

    def responses(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.when(kind.isin("click", "view"), F.concat(F.lit("r"), F.col("user_id").cast("string"))).alias("name"),
            F.when(kind == "error", "API rate limit exceeded").when(kind == "signup", "Not Found").alias("message"),
        )

    def repo_json(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.concat_ws("/", "c_mktsegment", "c_name").alias("full_name"),
            F.concat(F.lit("https://x/"), F.col("c_custkey").cast("string")).alias("url"),
            F.concat(F.lit("https://y/"), F.col("c_custkey").cast("string")).alias("html_url"),
            F.floor("c_acctbal").alias("stargazers_count"),
            F.lit("2016-01-01T00:00:00Z").alias("created_at"),
            F.lit("2017-01-01T00:00:00Z").alias("updated_at"),
            F.lit("2018-01-01T00:00:00Z").alias("pushed_at"),
            F.floor(F.abs("c_acctbal") * 10).alias("size"),
            F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment")).alias("language"),
            F.col("c_nationkey").cast("bigint").alias("forks_count"),
            F.lit(7).cast("bigint").alias("open_issues_count"),
            F.col("c_nationkey").cast("bigint").alias("subscribers_count"),
            F.concat(F.lit('say "hi",\n'), "c_name").alias("description"),
        )

    def contributors(self) -> DataFrame:
        people = F.transform(
            F.sequence(F.lit(1), F.col("c_nationkey") + 8), lambda i: F.struct(i.cast("string").alias("login"))
        )
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"), F.to_json(people).alias("contributors")
        )


def _file() -> list[Column]:
    return [F.col("o_custkey").alias("repo"), F.col("o_orderkey").cast("string").alias("path")]


def _keyed(key: Column, body: Column) -> Column:
    return F.concat(F.lit('{"'), key, F.lit('": '), body, F.lit("}"))
