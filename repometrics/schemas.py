"""Explicit schemas of the logical tables, as Spark DDL."""

REPO_META = (
    "id bigint, name string, full_name string, url string, html_url string, stars bigint, "
    "created_at timestamp, updated_at timestamp, pushed_at timestamp, size bigint, language string, "
    "forks_count bigint, open_issues_count bigint, watch bigint, description string, "
    "number_of_contributors int"
)

REPO_JSON = (
    "id bigint, name string, full_name string, "
    "owner struct<login:string,id:bigint,type:string>, html_url string, url string, "
    "description string, fork boolean, created_at timestamp, updated_at timestamp, "
    "pushed_at timestamp, size bigint, stargazers_count bigint, language string, "
    "forks_count bigint, open_issues_count bigint, "
    "license struct<key:string,name:string,spdx_id:string>, subscribers_count bigint"
)

FETCH_RESPONSE = (
    REPO_JSON + ", message string, documentation_url string, "
    "block struct<reason:string,created_at:timestamp,html_url:string>"
)

ID_LIST = "id bigint"

LINT_MESSAGES = (
    "repo bigint, path string, type string, module string, obj string, line int, column int, "
    "lint_path string, symbol string, message string, message_id string, "
    "parse_error boolean, internal_error boolean"
)

CC_BLOCKS = (
    "repo bigint, path string, type string, rank string, lineno int, name string, col_offset int, "
    "complexity int, endline int, methods_count int, closures_count int, "
    "parse_error boolean, internal_error boolean"
)

RAW_METRICS = (
    "repo bigint, path string, loc int, lloc int, sloc int, comments int, multi int, blank int, "
    "single_comments int, parse_error boolean, internal_error boolean"
)

FILE_LOC = "repo bigint, path string, nonblank_loc bigint, internal_error boolean"

IMPORTS = "repo bigint, path string, module_name string, import_name string, parse_error boolean"

PY_VERSION = "repo bigint, path string, ver string"

DIFF_2TO3 = "repo bigint, path string, diffcount int, parse_error boolean"

GIT_DATES = (
    "repo bigint, first_committed_date bigint, first_committed_datetime string, "
    "first_authored_date bigint, first_authored_datetime string, "
    "last_committed_date bigint, last_committed_datetime string, "
    "last_authored_date bigint, last_authored_datetime string, git_error boolean"
)

PROJ_LABELS = "repo bigint, path string, cat string"

#: Metric tables by the name used in ``read_metric_csv``.
METRIC_TABLES = {
    "lint_messages": LINT_MESSAGES,
    "cc_blocks": CC_BLOCKS,
    "raw_metrics": RAW_METRICS,
    "file_loc": FILE_LOC,
    "imports": IMPORTS,
    "py_version": PY_VERSION,
    "diff_2to3": DIFF_2TO3,
    "git_dates": GIT_DATES,
    "proj_labels": PROJ_LABELS,
}
