"""Tool reports and API responses as rows.

A report is one row (repo, path, stdout, stderr).  Each operator is a
projection plus at most one explode, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repometrics import constants as C
from repometrics.functions import nonblank_lines, strip

_LINT_JSON = (
    "array<struct<type:string,module:string,obj:string,line:int,column:int,path:string,"
    "symbol:string,message:string,`message-id`:string>>"
)
_BLOCK_JSON = (
    "array<struct<type:string,rank:string,lineno:int,name:string,col_offset:int,complexity:int,"
    "endline:int,methods:array<string>,closures:array<string>>>"
)
_COUNTER_JSON = "struct<loc:int,lloc:int,sloc:int,comments:int,multi:int,blank:int,single_comments:int>"
_COUNTERS = ("loc", "lloc", "sloc", "comments", "multi", "blank", "single_comments")


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _has_text(text: str) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def nonblank_loc(files: DataFrame) -> DataFrame:
    """Nonblank lines per file; an unreadable file (no content) has no count."""
    return files.select(
        "repo", "path",
        nonblank_lines("content").alias("nonblank_loc"),
        F.col("content").isNull().alias("internal_error"),
    )


def line_count_rows(reports: DataFrame) -> DataFrame:
    """The count a line-counting tool printed; noise or no number is an error."""
    printed = strip("stdout").try_cast("bigint")
    failed = _has_text("stderr") | printed.isNull()
    return reports.select(
        "repo", "path",
        F.when(~failed, printed).alias("nonblank_loc"),
        failed.alias("internal_error"),
    )


def lint_report_rows(reports: DataFrame) -> DataFrame:
    """One row per lint message; a file without messages keeps one empty row."""
    noise = F.exists(
        _lines("stderr"), lambda line: ~line.startswith(C.CONFIG_NOTICE) & (strip(line) != "")
    )
    # Empty output means no message; unreadable output is an error.
    unreadable = (F.coalesce("stdout", F.lit("")) != "") & F.col("_messages").isNull()
    syntax = F.exists("_messages", lambda m: m["message-id"].eqNullSafe(C.SYNTAX_ERROR_ID))
    parsed = reports.withColumn("_messages", F.from_json("stdout", _LINT_JSON))
    # Flags come before the explode, so that no row repeats the whole report.
    flagged = parsed.select(
        "repo", "path",
        F.coalesce(syntax, F.lit(False)).alias("parse_error"),
        (noise | unreadable).alias("internal_error"),
        "_messages",
    )
    message = F.col("m")
    return flagged.select(
        "repo", "path", "parse_error", "internal_error", F.explode_outer("_messages").alias("m")
    ).select(
        "repo", "path",
        message["type"].alias("type"), message["module"].alias("module"), message["obj"].alias("obj"),
        message["line"].alias("line"), message["column"].alias("column"),
        message["path"].alias("lint_path"), message["symbol"].alias("symbol"),
        message["message"].alias("message"), message["message-id"].alias("message_id"),
        "parse_error", "internal_error",
    )


def _keyed_report(reports: DataFrame) -> DataFrame:
    # The report is an object keyed by the path inside the repository.
    folder = F.concat(F.col("repo").cast("string"), F.lit("/"))
    inner = F.when(
        F.startswith("path", folder), F.substr("path", F.length(folder) + 1)
    ).otherwise(F.col("path"))
    by_path = F.from_json("stdout", "map<string,string>")
    return reports.withColumn("_body", F.try_element_at(by_path, inner)).select(
        "*",
        (_has_text("stderr") | F.col("_body").isNull()).alias("internal_error"),
        # Only an object can hold an error; a list of blocks has no such field.
        F.coalesce(F.get_json_object("_body", "$.error").isNotNull(), F.lit(False)).alias("parse_error"),
    )


def _readable() -> Column:
    return ~F.col("internal_error") & ~F.col("parse_error")


def cc_report_rows(reports: DataFrame) -> DataFrame:
    """One row per complexity block; files without blocks keep one empty row."""
    blocks = F.when(_readable(), F.from_json("_body", _BLOCK_JSON))
    block = F.col("b")

    def members(name: str) -> Column:
        return F.when(block.isNotNull(), F.coalesce(F.size(block[name]), F.lit(0)))

    parsed = _keyed_report(reports).select(
        "repo", "path", "parse_error", "internal_error", blocks.alias("_blocks")
    )
    return parsed.select(
        "repo", "path", "parse_error", "internal_error", F.explode_outer("_blocks").alias("b")
    ).select(
        "repo", "path",
        *[block[f].alias(f) for f in ("type", "rank", "lineno", "name", "col_offset", "complexity", "endline")],
        members("methods").alias("methods_count"), members("closures").alias("closures_count"),
        "parse_error", "internal_error",
    )


def raw_report_rows(reports: DataFrame) -> DataFrame:
    """One row of size counters per file."""
    counters = F.when(_readable(), F.from_json("_body", _COUNTER_JSON))
    return _keyed_report(reports).withColumn("_c", counters).select(
        "repo", "path", *[F.col("_c")[f].alias(f) for f in _COUNTERS], "parse_error", "internal_error"
    )


def import_listing_rows(reports: DataFrame, flag_headings: bool = False) -> DataFrame:
    """One row per listed import; a file without imports keeps one row with ''.

    A listing should have one heading; the first one names the module.  ``flag_headings`` adds ``several_headings``, so
    that listings with more can be looked at.
    """
    lines = F.filter(_lines("stdout"), lambda line: line != "")
    heads = F.filter("_lines", lambda line: line.endswith(":"))
    names = F.transform(F.filter("_lines", lambda line: ~line.endswith(":")), strip)
    head = F.get(heads, F.lit(0))
    module = F.coalesce(strip(F.substr(head, F.lit(1), F.length(head) - 1)), F.lit(""))
    listed = reports.withColumn("_lines", lines).select(
        "repo", "path", module.alias("module_name"), names.alias("_names"), (F.size(heads) > 1).alias("several_headings")
    )
    flags = ["several_headings"] if flag_headings else []
    return listed.select(
        "repo", "path", "module_name", *flags, F.explode_outer("_names").alias("import_name")
    ).select(
        "repo", "path", "module_name",
        F.coalesce("import_name", F.lit("")).alias("import_name"),
        (F.col("module_name") == "").alias("parse_error"), *flags,
    )


def diff_line_counts(reports: DataFrame) -> DataFrame:
    """Changed lines of a diff, and whether its header is as expected."""
    headers = F.size(F.filter("_lines", lambda line: line.startswith("---")))
    changed = F.size(F.filter("_lines", lambda line: line.rlike(r"^(-(?!--)|\+(?!\+\+))")))
    return reports.withColumn("_lines", _lines("stdout")).select(
        "repo", "path", changed.alias("diffcount"),
        F.coalesce(F.col("stderr").contains(C.PARSE_NOTICE), F.lit(False)).alias("parse_error"),
        headers.alias("_headers"),
    ).select(
        "repo", "path", "diffcount", "parse_error",
        (F.col("_headers") == F.when(F.col("diffcount") > 0, 1).otherwise(0)).alias("header_ok"),
    )


def commit_span(commits: DataFrame, repos: DataFrame) -> DataFrame:
    """First and last commit per repository; none found is ``git_error``.

    ``traversal_order`` is 0 for the newest commit and grows with age.
    """
    commit = F.struct("committed_epoch", "committed_iso", "authored_epoch", "authored_iso")
    ends = commits.groupBy("repo").agg(
        F.max_by(commit, "traversal_order").alias("first"),
        F.min_by(commit, "traversal_order").alias("last"),
    )
    key = "id" if "id" in repos.columns else "repo"
    wanted = repos.select(F.col(key).alias("repo")).distinct()
    parts = (("committed", "epoch", "date"), ("committed", "iso", "datetime"),
             ("authored", "epoch", "date"), ("authored", "iso", "datetime"))
    return wanted.join(ends, "repo", "left").select(
        "repo",
        *[
            F.col(end)[f"{who}_{field}"].alias(f"{end}_{who}_{suffix}")
            for end in ("first", "last")
            for who, field, suffix in parts
        ],
        F.col("first").isNull().alias("git_error"),
    )


def repo_meta_flatten(json_df: DataFrame) -> DataFrame:
    """Metadata columns of the nested repository object."""
    return json_df.select(
        "id", "name", "full_name", "url", "html_url",
        F.col("stargazers_count").alias("stars"),
        "created_at", "updated_at", "pushed_at", "size", "language",
        "forks_count", "open_issues_count",
        F.col("subscribers_count").alias("watch"),
        "description",
    )


def contributor_count(json_df: DataFrame, column: str = "contributors") -> DataFrame:
    """Contributors on the one page that was fetched; a full page means "or more"."""
    people = F.size(F.from_json(column, "array<struct<login:string>>"))
    return json_df.select(
        "id",
        people.alias("number_of_contributors"),
        (people >= C.CONTRIBUTOR_PAGE).alias("contributors_capped"),
    )


def repo_meta_full(json_df: DataFrame, contributors: DataFrame) -> DataFrame:
    """``repo_meta_flatten`` with the number of contributors of the same repository, missing where none was fetched."""
    return repo_meta_flatten(json_df).join(contributor_count(contributors), "id", "left")


def fetch_outcome(responses: DataFrame) -> DataFrame:
    """Add ``outcome``: json, api-limit or not-present."""
    return responses.withColumn(
        "outcome",
        F.when(F.col("name").isNotNull(), "json")
        .when(F.col("message").contains(C.RATE_LIMIT_NOTICE), "api-limit")
        .otherwise("not-present"),
    )
