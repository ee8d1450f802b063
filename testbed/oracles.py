"""The registered queries as SQL, written from the definitions.

Statistics use plain per-row windows, densities the dense symbol table, and
curves a count over all edges: other formulations than the Spark plans.
"""

from __future__ import annotations

import re

from repometrics.constants import EXCLUDED_TERMS
from testbed.bindings import DS_SEGMENT, LIBS, QUOTED, SYMBOLS, TERMS, TESTS

ORACLES: dict[str, str] = {}


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


EPOCH_DAY = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"
KEY = "o_custkey AS repo, CAST(o_orderkey AS VARCHAR) AS path"


def _iso(epoch: str) -> str:
    return f"strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds({epoch}), '%Y-%m-%dT%H:%M:%S') || '+00:00'"


CTES = {
    "meta": """
        SELECT c_custkey AS id, c_name AS name, CAST(floor(c_acctbal) AS BIGINT) AS stars,
               created_at, updated_at, pushed_at, CAST(floor(abs(c_acctbal) * 10) AS BIGINT) AS size,
               c_mktsegment AS language, CAST(c_nationkey AS BIGINT) AS forks_count,
               open_issues_count, watch, CAST(least(watch, 30) AS INTEGER) AS number_of_contributors
        FROM customer LEFT JOIN (
            SELECT o_custkey, min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at,
                   max(o_orderdate) FILTER (o_orderstatus = 'F') AS pushed_at,
                   count(*) FILTER (o_orderstatus = 'O') AS open_issues_count, count(*) AS watch
            FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "ds_ids": f"SELECT c_custkey AS id FROM customer WHERE c_mktsegment = '{DS_SEGMENT}'",
    "commits": f"""
        SELECT o_custkey AS repo, o_orderkey AS k, {EPOCH_DAY} AS d,
               {EPOCH_DAY} * 86400 AS committed,
               {EPOCH_DAY} * 86400 - CAST(floor(o_totalprice) AS BIGINT) AS authored FROM orders""",
    "git": f"""
        SELECT c_custkey AS repo,
               f.committed AS first_committed_date, {_iso('f.committed')} AS first_committed_datetime,
               f.authored AS first_authored_date, {_iso('f.authored')} AS first_authored_datetime,
               l.committed AS last_committed_date, {_iso('l.committed')} AS last_committed_datetime,
               l.authored AS last_authored_date, {_iso('l.authored')} AS last_authored_datetime,
               f.repo IS NULL AS git_error
        FROM customer
        LEFT JOIN (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY repo ORDER BY d, k) = 1) f
            ON f.repo = c_custkey
        LEFT JOIN (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY repo ORDER BY d DESC, k DESC) = 1) l
            ON l.repo = c_custkey""",
    "versions": f"""
        SELECT {KEY}, CASE WHEN o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT' THEN 'either'
            WHEN o_orderstatus <> 'F' THEN 'python2' WHEN o_orderpriority <> '1-URGENT' THEN 'python3'
            ELSE 'neither' END AS ver FROM orders""",
    "version_counts": """
        SELECT repo, count(*) FILTER (ver = 'either') AS either, count(*) FILTER (ver = 'neither') AS neither,
               count(*) FILTER (ver = 'python2') AS python2, count(*) FILTER (ver = 'python3') AS python3
        FROM versions GROUP BY repo""",
    "version_truth": """
        SELECT * FROM (VALUES
            (false, false, false, false, 'empty', false), (true, false, false, false, 'either', true),
            (false, false, true, false, 'only2', false), (true, false, true, false, 'only2', true),
            (false, false, false, true, 'only3', true), (true, false, false, true, 'only3', true),
            (false, false, true, true, 'mix', true), (true, false, true, true, 'mix', true),
            (false, true, false, false, 'neither', false), (true, true, false, false, 'neither', true),
            (false, true, true, false, 'neither', false), (true, true, true, false, 'neither', true),
            (false, true, false, true, 'neither', true), (true, true, false, true, 'neither', true),
            (false, true, true, true, 'neither', true), (true, true, true, true, 'neither', true)
        ) AS truth(has_either, has_neither, has_2, has_3, summary, usable)""",
    "version_tab": """
        SELECT c.*, summary, usable AND python3 >= python2 AS "select" FROM version_counts c JOIN version_truth
            ON has_either = (either > 0) AND has_neither = (neither > 0) AND has_2 = (python2 > 0) AND has_3 = (python3 > 0)""",
    "loc": f"""
        SELECT {KEY}, CASE WHEN o_totalprice < 5000 THEN NULL WHEN o_totalprice < 20000 THEN 0
            ELSE CAST(floor(o_totalprice / 100) AS BIGINT) END AS nonblank_loc,
            o_totalprice < 5000 AS internal_error FROM orders""",
    "labels": f"""
        SELECT {KEY}, CASE o_orderstatus WHEN 'F' THEN 'ml0' WHEN 'O' THEN 'no-ml-dependency' ELSE 'test' END AS cat
        FROM orders WHERE o_orderpriority <> '5-LOW'""",
    "lint": f"""
        SELECT {KEY}, CASE WHEN l_returnflag = 'A' THEN 'convention' WHEN l_returnflag = 'N' THEN 'warning'
            WHEN l_returnflag = 'R' AND l_tax >= 0.08 THEN 'fatal' WHEN l_returnflag = 'R' THEN 'error' END AS type,
            l_returnflag || l_linestatus AS symbol,
            CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN 'E0001'
                 ELSE 'M' || l_returnflag || l_linestatus END AS message_id,
            l_linenumber AS line, coalesce(l_quantity = 50, false) AS parse_error,
            coalesce(l_discount >= 0.1, false) AS internal_error
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
    "clean": """
        SELECT * FROM lint WHERE NOT parse_error AND NOT internal_error AND type IS DISTINCT FROM 'fatal'""",
    "cc": f"""
        SELECT {KEY}, CASE l_returnflag WHEN 'A' THEN 'method' WHEN 'N' THEN 'function' ELSE 'class' END AS type,
            CAST(l_quantity AS INTEGER) AS complexity
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "imports": f"""
        SELECT {KEY}, p_type AS module_name, CASE WHEN l_discount > 0 THEN p_name END AS import_name,
            coalesce(CASE WHEN l_discount > 0 THEN split_part(p_name, ' ', 1) END, '') AS short
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "projects": """
        SELECT doc_id AS id, source AS name, source || '/' || doc_id AS url, text AS description, lang AS language,
            CASE WHEN n_chars > 6000 THEN doc_id - 1 END AS forked_from FROM documents""",
    "reports": """
        SELECT user_id AS repo, user_id || '/' || event_id AS path, event_id, event_type AS kind, value,
            CAST(floor(value) AS INTEGER) AS number FROM events""",
    # --- derived tables that several oracles share
    "counts": "SELECT repo, path, symbol, count(*) AS n FROM clean WHERE symbol IS NOT NULL GROUP BY ALL",
    "wide": "SELECT repo, path, "
        + ", ".join(f"CAST(sum(n) FILTER (symbol = '{s}') AS BIGINT) AS \"lint_{s}\"" for s in SYMBOLS)
        + " FROM counts GROUP BY repo, path",
    "complexity": """
        SELECT repo, path, avg(complexity) AS complexity FROM cc WHERE type IN ('method', 'function')
        GROUP BY repo, path""",
    "profile": """
        SELECT *, ml0 / total AS frac_ml FROM (
            SELECT repo, count(DISTINCT path) FILTER (cat = 'ml0') AS ml0,
                count(DISTINCT path) FILTER (cat = 'no-ml-dependency') AS "no-ml-dependency",
                count(DISTINCT path) FILTER (cat = 'test') AS test, count(DISTINCT path) AS total
            FROM labels GROUP BY repo)""",
    "features": """
        SELECT w.*, f.nonblank_loc AS loc, b.cat, x.complexity, p.ml0, p."no-ml-dependency", p.test, p.total,
            p.frac_ml, CASE WHEN p.repo IS NOT NULL THEN w.repo IN (SELECT id FROM ds_ids) END AS is_ml_repo
        FROM wide w LEFT JOIN loc f USING (repo, path) LEFT JOIN labels b USING (repo, path)
        LEFT JOIN complexity x USING (repo, path) LEFT JOIN profile p USING (repo)""",
    "ml_repos": "SELECT DISTINCT repo FROM labels WHERE repo IN (SELECT id FROM ds_ids)",
    "files": """
        SELECT w.repo, w.path, f.nonblank_loc AS loc, coalesce(b.cat, '0') AS cat,
            w.repo IN (SELECT repo FROM ml_repos) AS is_ml_repo
        FROM (SELECT DISTINCT repo, path FROM counts) w LEFT JOIN loc f USING (repo, path)
        LEFT JOIN labels b USING (repo, path) WHERE f.nonblank_loc > 0""",
    "all_files": """
        SELECT w.repo, w.path, f.nonblank_loc AS loc, w.repo IN (SELECT repo FROM ml_repos) AS is_ml_repo
        FROM (SELECT DISTINCT repo, path FROM clean) w JOIN loc f USING (repo, path) WHERE f.nonblank_loc > 0""",
    "symbols": "SELECT DISTINCT symbol FROM counts",
    "dense_cat": """
        SELECT repo, is_ml_repo, cat, 'lint_' || symbol AS variable, CAST(sum(coalesce(n, 0)) AS BIGINT) AS value,
            CAST(sum(loc) AS BIGINT) AS loc, sum(coalesce(n, 0)) / sum(loc) AS normval
        FROM files CROSS JOIN symbols LEFT JOIN counts USING (repo, path, symbol)
        GROUP BY repo, is_ml_repo, cat, symbol""",
    "dense_repo": """
        SELECT repo, is_ml_repo, variable, CAST(sum(value) AS BIGINT) AS value, CAST(sum(loc) AS BIGINT) AS loc,
            sum(value) / sum(loc) AS normval FROM dense_cat GROUP BY repo, is_ml_repo, variable""",
    "dense_clean": """
        SELECT repo, is_ml_repo, 'lint_' || symbol AS variable, CAST(sum(coalesce(n, 0)) AS BIGINT) AS value,
            CAST(sum(loc) AS BIGINT) AS loc, sum(coalesce(n, 0)) / sum(loc) AS normval
        FROM all_files CROSS JOIN symbols LEFT JOIN counts USING (repo, path, symbol)
        GROUP BY repo, is_ml_repo, symbol""",
    "deep": """
        SELECT repo FROM dense_cat WHERE cat IN ('ml0', 'test', 'no-ml-dependency') GROUP BY repo
        HAVING count(DISTINCT cat) = 3""",
    "repo_loc": "SELECT repo, CAST(coalesce(sum(nonblank_loc), 0) AS BIGINT) AS loc FROM loc GROUP BY repo",
    "repo_cc": "SELECT repo, avg(complexity) AS complexity FROM cc WHERE type IN ('method', 'function') GROUP BY repo",
    "enriched": """
        SELECT m.*, (g.last_committed_date - g.first_committed_date) / 86400 AS age, v.summary, v."select",
            s.loc, c.complexity
        FROM meta m LEFT JOIN git g ON g.repo = m.id LEFT JOIN version_tab v ON v.repo = m.id
        LEFT JOIN repo_loc s ON s.repo = m.id LEFT JOIN repo_cc c ON c.repo = m.id""",
    "nonds_chosen": """
        SELECT * FROM enriched WHERE id NOT IN (SELECT id FROM ds_ids) AND created_at >= TIMESTAMP '1995-03-01'
        AND pushed_at >= created_at AND age < 2200 AND age >= 0 AND "select" """,
}

_NEEDS = {
    name: [n for n in CTES if n != name and re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql)]
    for name, sql in CTES.items()
}


def _with(needed: list[str], sql: str, extra: str = "") -> str:
    """``sql`` below the tables it names, each after those it is built from."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in _NEEDS[name]:
            visit(other)
        order.append(name)

    for name in needed:
        visit(name)
    parts = [f"{n} AS ({CTES[n].strip()})" for n in order] + ([extra] if extra else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()


def oracle(name: str, needed: str, sql: str, extra: str = "") -> None:
    ORACLES[name] = _with(needed.split(), sql, extra)


def _plain(name: str, source: str) -> None:
    oracle(name, source, f"SELECT * FROM {source}")


# --- imports ---------------------------------------------------------------

SETS = f"""sets AS (SELECT repo, coalesce(string_agg(DISTINCT short, ',' ORDER BY short)
    FILTER (short IN {_list(LIBS)}), '') AS importset FROM imports GROUP BY repo)"""
LABELLED = f"""labelled AS (SELECT repo, path, CASE WHEN bool_or(short IN {_list(TESTS)}) THEN 'test'
    WHEN bool_or(short IN {_list(LIBS)}) THEN 'ml0' ELSE 'no-ml-dependency' END AS cat
    FROM imports GROUP BY repo, path)"""

oracle("popular_imports", "imports",
       "SELECT short AS import_short_name, count(DISTINCT repo) AS num_repos FROM imports GROUP BY short")
oracle("library_sets", "imports", "SELECT * FROM sets", SETS)
oracle("library_set_popularity", "imports",
       "SELECT importset, count(*) AS num_repos FROM sets GROUP BY importset", SETS)
oracle("popular_libraries", "imports", f"""SELECT short AS import_short_name, count(DISTINCT repo) AS num_repos
    FROM imports WHERE short IN {_list(LIBS)} GROUP BY short""")
oracle("column_cardinality", "imports", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM imports"
    for c in ("repo", "path", "module_name", "import_name")))
oracle("cardinality_sketches", "", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS known, count(DISTINCT {c}) AS exact, true AS within FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_extendedprice")))
oracle("category_labels", "imports", "SELECT * FROM labelled", LABELLED)
oracle("label_counts", "imports", "SELECT cat, count(*) AS n FROM labelled GROUP BY cat", LABELLED)
oracle("test_name_match", "imports", """SELECT DISTINCT path FROM imports
    WHERE path LIKE '%ring%' OR import_name LIKE '%ring%'""")
oracle("library_in_list", "imports", f"""SELECT DISTINCT repo, path, short AS import_short_name
    FROM imports WHERE short IN {_list(LIBS)}""")
oracle("dedupe_labels", "imports", "SELECT DISTINCT repo, path FROM imports")

oracle("import_short_name", "imports", """SELECT repo, short AS import_short_name, count(*) AS n
    FROM imports GROUP BY repo, short""")
oracle("import_analysis", "imports", "SELECT * FROM sets", SETS)

# --- versions --------------------------------------------------------------

_plain("py_version_label", "versions")
oracle("count_by_repo_version", "versions", "SELECT repo, ver, count(*) AS vercnt FROM versions GROUP BY repo, ver")
_plain("version_pivot", "version_counts")
_plain("version_summary", "version_tab")
oracle("version_summary_counts", "version_tab", "SELECT summary, count(*) AS num_repos FROM version_tab GROUP BY summary")
oracle("version_select", "version_tab", 'SELECT "select", count(*) AS num_repos FROM version_tab GROUP BY "select"')

oracle("version_analysis", "version_tab", "SELECT summary, count(*) AS num_repos FROM version_tab GROUP BY summary")

# --- filters, joins, sets --------------------------------------------------

ACTIVE = "active AS (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 400000)"
oracle("restrict_to_repos", "loc ds_ids", "SELECT * FROM loc WHERE repo IN (SELECT id FROM ds_ids)")
oracle("exclude_repos", "loc ds_ids", "SELECT * FROM loc WHERE repo NOT IN (SELECT id FROM ds_ids)")
oracle("membership_flag", "labels ds_ids", "SELECT *, repo IN (SELECT id FROM ds_ids) AS is_ml_repo FROM labels")
_plain("merge_result_chunks", "loc")
METRICS = {"loc": "nonblank_loc, internal_error", "versions": "ver", "labels": "cat", "cc": "type, complexity",
           "lint": "type, symbol, message_id, line, parse_error, internal_error",
           "imports": "module_name, import_name"}
oracle("merged_metrics", " ".join(METRICS), " UNION ALL ".join(
    f"SELECT '{table}' AS metric, repo, path, concat_ws('|', {columns}) AS fields FROM {table}"
    for table, columns in METRICS.items()))
oracle("semi_by_ids", "labels", "SELECT * FROM labels WHERE repo IN (SELECT id FROM active)", ACTIVE)
oracle("anti_by_ids", "labels", "SELECT * FROM labels WHERE repo NOT IN (SELECT id FROM active)", ACTIVE)
oracle("three_way_intersection", "labels", " INTERSECT ".join(
    f"SELECT repo AS id FROM labels WHERE cat = '{c}'" for c in ("ml0", "no-ml-dependency", "test")))
oracle("id_union", "ds_ids", "SELECT id FROM ds_ids UNION SELECT id FROM active", ACTIVE)
oracle("id_intersection", "ds_ids", "SELECT id FROM ds_ids INTERSECT SELECT id FROM active", ACTIVE)
oracle("set_sizes", "ds_ids", """SELECT (SELECT count(*) FROM active) AS rows_a,
    (SELECT count(DISTINCT id) FROM active) AS ids_a, (SELECT count(*) FROM ds_ids) AS rows_b,
    (SELECT count(DISTINCT id) FROM ds_ids) AS ids_b,
    (SELECT count(DISTINCT id) FROM active WHERE id IN (SELECT id FROM ds_ids)) AS overlap""", ACTIVE)
oracle("created_since", "meta", """SELECT id, strftime(created_at, '%Y-%m-%d') AS created_at FROM meta
    WHERE created_at >= TIMESTAMP '1995-06-01'""")
oracle("drop_push_before_create", "meta", """SELECT id, strftime(created_at, '%Y-%m-%d') AS created_at,
    strftime(pushed_at, '%Y-%m-%d') AS pushed_at FROM meta WHERE NOT pushed_at < created_at""")
AGE = "round((last_committed_date - first_committed_date) / 86400, 6)"
oracle("age_between", "git", f"SELECT repo, {AGE} AS age FROM git WHERE {AGE} >= 0 AND {AGE} < 2000")
oracle("repo_age_days", "git", f"SELECT repo, git_error, {AGE} AS age FROM git")
oracle("days_between_dates", "meta", """SELECT id, round(date_diff('day', created_at, pushed_at) * 1.0::DOUBLE, 6) AS days
    FROM meta""")
oracle("project", "lint", "SELECT repo, path, symbol, message_id FROM lint")
oracle("derive_rename", "loc", "SELECT repo, path AS file, nonblank_loc, internal_error, nonblank_loc AS loc FROM loc")
oracle("keep_selected", "version_tab", 'SELECT repo, summary FROM version_tab WHERE "select"')
_plain("clean_lint_rows", "clean")
oracle("syntax_error_files", "lint", """SELECT repo, parse_error, count(*) AS n FROM (
    SELECT repo, coalesce(bool_or(message_id = 'E0001') OVER (PARTITION BY repo, path), false) AS parse_error FROM lint)
    GROUP BY repo, parse_error""")
oracle("function_blocks", "cc", "SELECT * FROM cc WHERE type <> 'class'")
oracle("nonempty_files", "loc", "SELECT repo, path, nonblank_loc AS loc, internal_error FROM loc WHERE nonblank_loc > 0")


def _unlike(column: str, terms) -> str:
    return " AND ".join(f"lower({column}) NOT LIKE '%{t}%'" for t in terms)


oracle("keyword_exclusion", "projects", f"SELECT id, language FROM projects WHERE {_unlike('description', TERMS)}")
oracle("keyword_exclusion_default_terms", "projects",
       f"SELECT id, language FROM projects WHERE {_unlike('description', EXCLUDED_TERMS)}")
oracle("base_repo_predicate", "projects", """SELECT id, name FROM projects WHERE forked_from IS NULL
    AND language = 'en' AND description IS NOT NULL AND description <> ''""")
oracle("star_join", "", """SELECT doc_id AS id, source AS name, count(event_id) AS stars
    FROM documents LEFT JOIN events ON user_id = doc_id GROUP BY doc_id, source""")
oracle("starred_repos", "projects", """SELECT p.id, p.name, p.language, count(e.event_id) AS stars
    FROM projects p LEFT JOIN events e ON e.user_id = p.id GROUP BY p.id, p.name, p.url, p.description, p.language
    HAVING count(e.event_id) >= 60""")
oracle("candidate_repos", "projects", f"""SELECT p.id, p.name, p.url, CAST(length(p.description) AS INTEGER) AS description_length,
    count(e.event_id) AS stars FROM projects p LEFT JOIN events e ON e.user_id = p.id
    WHERE p.forked_from IS NULL AND p.language = 'en' AND p.description <> '' AND {_unlike('p.description', TERMS)}
    GROUP BY p.id, p.name, p.url, p.description, p.language HAVING count(e.event_id) >= 60""")
oracle("quality_probes", "lint", " UNION ALL ".join(
    f"SELECT count(*) AS total, '{n}' AS probe, count(*) FILTER ({c}) AS hits FROM lint" for n, c in (
        ("parse_error", "parse_error"), ("internal_error", "internal_error"),
        ("error_with_message", "internal_error AND type IS NOT NULL"), ("fatal", "type = 'fatal'"),
        ("no_message", "symbol IS NULL"))))
oracle("repo_probes", "enriched", " UNION ALL ".join(
    f"SELECT count(*) AS total, '{n}' AS probe, count(*) FILTER ({c}) AS hits FROM enriched" for n, c in (
        ("unknown_select", '"select" IS NULL'), ("no_lines", "coalesce(loc, 0) <= 0"),
        ("no_complexity", "coalesce(complexity, 0) <= 0"), ("negative_age", "age < 0"))))
oracle("error_probes", "loc", " UNION ALL ".join(
    f"SELECT count(*) AS total, '{n}' AS probe, count(*) FILTER ({c}) AS hits FROM loc" for n, c in (
        ("internal_error", "internal_error"), ("own_internal_error", "internal_error AND repo % 3 <> 0"))))
oracle("fill_missing", "loc", "SELECT repo, path, coalesce(nonblank_loc, 0) AS nonblank_loc, internal_error FROM loc")
_plain("commit_span", "git")
COLS = """id, name, stars, size, language, forks_count, open_issues_count, watch, number_of_contributors,
    round(age, 6) AS age, summary, loc, round(complexity, 6) AS complexity"""
oracle("enrich_repos", "enriched", f'SELECT {COLS}, "select" FROM enriched')
oracle("select_ds", "enriched ds_ids", f"""SELECT {COLS} FROM enriched
    WHERE id IN (SELECT id FROM ds_ids) AND id <> 31 AND "select" """)
oracle("select_nonds", "nonds_chosen", f"SELECT {COLS} FROM nonds_chosen")

# --- size, complexity, labels ----------------------------------------------

_plain("loc_by_repo", "repo_loc")
oracle("mean_complexity_by_repo", "repo_cc", "SELECT repo, round(complexity, 6) AS complexity FROM repo_cc")
oracle("mean_complexity_by_file", "complexity", "SELECT repo, path, round(complexity, 6) AS complexity FROM complexity")
oracle("repo_label_profile", "profile", "SELECT * REPLACE (round(frac_ml, 6) AS frac_ml) FROM profile")
oracle("repos_with_all_categories", "labels", "SELECT repo FROM labels GROUP BY repo HAVING count(DISTINCT cat) = 3")
oracle("value_counts", "loc", "SELECT nonblank_loc, count(*) AS n FROM loc GROUP BY nonblank_loc")
oracle("value_share", "", """SELECT c_mktsegment AS language, round(count(*) / (SELECT count(*) FROM customer), 6) AS share
    FROM customer WHERE c_nationkey > 3 GROUP BY c_mktsegment""")


def _describe(x: str) -> str:
    return f"""count({x}) AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std,
    round(CAST(min({x}) AS DOUBLE), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS q25,
    round(quantile_cont({x}, 0.5), 6) AS q50, round(quantile_cont({x}, 0.75), 6) AS q75,
    round(CAST(max({x}) AS DOUBLE), 6) AS max"""


oracle("describe_numeric", "loc", f"SELECT {_describe('nonblank_loc')} FROM loc")
oracle("describe_grouped", "loc labels", f"""SELECT cat, {_describe('nonblank_loc')}
    FROM labels JOIN loc USING (repo, path) GROUP BY cat""")
oracle("describe_time", "meta", """SELECT count(updated_at) AS count, strftime(min(updated_at), '%Y-%m-%d') AS min,
    strftime(max(updated_at), '%Y-%m-%d') AS max FROM meta""")

# --- ordering --------------------------------------------------------------

oracle("popular_first", "imports", "SELECT module_name, count(*) AS n FROM imports GROUP BY module_name")
oracle("recent_first", "meta", "SELECT id, strftime(created_at, '%Y-%m-%d') AS created_at FROM meta")


def _chunks(source: str, size: int) -> str:
    return f"""SELECT *, lpad(CAST(chunk * {size} + 1 AS VARCHAR), 6, '0') || '-' ||
        lpad(CAST(least((chunk + 1) * {size}, total) AS VARCHAR), 6, '0') AS label FROM (
        SELECT id, row_number, (row_number - 1) // {size} AS chunk, total FROM (
        SELECT id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS row_number, count(*) OVER () AS total
        FROM ({source})))"""


oracle("chunk_list", "meta",
       f"SELECT id, row_number, chunk, label FROM ({_chunks('SELECT * FROM meta', 40)})")
oracle("slice_rows", "meta", f"""SELECT id, row_number FROM
    ({_chunks('SELECT * FROM meta', 40)}) WHERE row_number > 40 AND row_number <= 110""")
_ds = f"SELECT * FROM meta WHERE language = '{DS_SEGMENT}'"
_non = "SELECT * FROM meta WHERE created_at >= TIMESTAMP '1995-03-01'"
oracle("extraction_lists", "meta", f"""SELECT 'ds' AS grp, id, label FROM ({_chunks(_ds, 100)})
    UNION ALL SELECT 'nonds' AS grp, id, label FROM ({_chunks(_non, 100)})
    UNION ALL SELECT 'duplicates' AS grp, id, NULL AS label FROM ({_non}) WHERE language = '{DS_SEGMENT}'""")
oracle("sorted_distinct", "lint", """SELECT CAST(0 AS BIGINT) AS part,
    string_agg(DISTINCT message_id, ', ' ORDER BY message_id) AS listing FROM lint""")
oracle("sorted_distinct_repos", "labels", """SELECT part, string_agg(CAST(repo AS VARCHAR), ', ' ORDER BY repo) AS listing
    FROM (SELECT repo, (row_number() OVER (ORDER BY repo) - 1) // 50 AS part FROM labels GROUP BY repo
          HAVING count(DISTINCT cat) = 3) GROUP BY part""")

# --- text ------------------------------------------------------------------


def _nonblank(text: str) -> str:
    return f"len(list_filter(string_split({text}, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r\\n\\f\\v]')))"


SOURCE = "CAST(substr(source, 4) AS BIGINT) AS repo, CAST(doc_id AS VARCHAR) AS path"
oracle("nonblank_loc", "", f"""SELECT {SOURCE}, {_nonblank('text')} AS nonblank_loc,
    text IS NULL AS internal_error FROM documents""")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _textlint(source: str, longest: int, most: int) -> str:
    return f"""src AS ({source}),
    lines AS (SELECT repo, path, content, closed, unnest(parts) AS txt,
            generate_subscripts(parts, 1) AS line, len(parts) - CASE WHEN closed THEN 1 ELSE 0 END AS last
        FROM (SELECT *, string_split(content, chr(10)) AS parts, ends_with(content, chr(10)) AS closed
              FROM src WHERE content <> '')),
    body AS (SELECT *, rtrim(txt, chr(13)) AS t FROM lines WHERE line <= last),
    hits AS (
        SELECT repo, path, line, 'line-too-long' AS symbol, 'C0301' AS message_id,
            'Line too long (' || length(t) || '/{longest})' AS message FROM body
            WHERE length(t) > {longest} AND NOT regexp_matches(t, '^\\s*(# )?<?https?://\\S+>?$')
        UNION ALL SELECT repo, path, line, 'trailing-whitespace', 'C0303', 'Trailing whitespace' FROM body
            WHERE regexp_matches(t, '[ \\t\\r\\v]$')
        UNION ALL SELECT repo, path, line, 'fixme', 'W0511',
            regexp_extract(t, '(?i)#\\s*(FIXME|XXX|TODO)\\b.*') FROM body
            WHERE regexp_matches(t, '(?i)#\\s*(FIXME|XXX|TODO)\\b')
        UNION ALL SELECT repo, path, line, 'missing-final-newline', 'C0304', 'Final newline missing' FROM body
            WHERE line = last AND NOT closed
        UNION ALL SELECT repo, path, line, 'trailing-newlines', 'C0305', 'Trailing newlines' FROM body
            WHERE line = last AND closed AND regexp_matches(t, '^[ \\t\\r\\v]*$')
        UNION ALL SELECT repo, path, 1, 'too-many-lines', 'C0302',
            'Too many lines in module (' || last || '/{most})' FROM body WHERE line = last AND last > {most})"""


_docs = f"SELECT {SOURCE}, text AS content FROM documents"
_pages = "SELECT page_id AS repo, url AS path, html AS content FROM pages"
oracle("text_lint_rules", "", "SELECT repo, path, CAST(line AS INTEGER) AS line, symbol, message_id, message FROM hits", _textlint(_docs, 100, 1000))
oracle("text_lint_rules_pages", "", "SELECT repo, CAST(line AS INTEGER) AS line, symbol, message_id FROM hits", _textlint(_pages, 80, 2))
# the lines of QUOTED with a tag in a comment, numbered from 1, and the comment
NOTES = ((1, "# TODO ", ""), (3, "# fixme: 'again'", None), (7, "# XXX ", ""), (8, '# TODO "c', None), (9, "# todo ", ' """ open'), (10, "# XXX '", ""))
oracle("text_lint_strings", "", " UNION ALL ".join(
    f"SELECT repo, path, CAST({len(QUOTED)} * (k - 1) + {line} AS INTEGER) AS line, " + (f"{_text(before)} || w || {_text(after)}" if after is not None else _text(before)) + " AS message FROM words"
    for line, before, after in NOTES), f"""words AS (SELECT {SOURCE}, unnest(w[1:8]) AS w, generate_subscripts(w[1:8], 1) AS k
        FROM (SELECT source, doc_id, regexp_split_to_array(text, '[^A-Za-z]+') AS w FROM documents))""")
oracle("text_lint_counts", "", """SELECT symbol, count(*) AS messages, count(DISTINCT (repo, path)) AS files
    FROM hits GROUP BY symbol""", _textlint(_docs, 100, 1000))

# --- reports ---------------------------------------------------------------

LINT_ROWS = """
    SELECT repo, path, CASE WHEN m.i > 0 THEN 'convention' END AS type, CASE WHEN m.i > 0 THEN 'm' END AS module,
        CASE WHEN m.i > 0 THEN '{obj}' END AS obj, CASE WHEN m.i > 0 THEN number END AS line,
        CASE WHEN m.i > 0 THEN 0 END AS "column", CASE WHEN m.i > 0 THEN 'm.py' END AS lint_path,
        CASE m.i WHEN 1 THEN 'sym-' || kind WHEN 2 THEN 'unused-import' END AS symbol,
        CASE WHEN m.i > 0 THEN 'say "x"' || chr(10) || kind END AS message,
        CASE m.i WHEN 1 THEN CASE WHEN number > 50 THEN 'E0001' ELSE 'C0103' END WHEN 2 THEN 'W0611' END AS message_id,
        m.i > 0 AND number > 50 AS parse_error, kind = 'error' OR (value > 20 AND value <= 30) AS internal_error
    FROM reports JOIN (VALUES ('click', 1), ('click', 2), ('view', 1), ('purchase', 0), ('signup', 0), ('error', 0))
        AS m(k, i) ON m.k = kind"""
oracle("lint_report_rows", "reports", LINT_ROWS.replace("{obj}", ""))
# an empty field and a missing one are the same in CSV
oracle("read_metric_csv", "reports", LINT_ROWS.replace("'{obj}'", "CAST(NULL AS VARCHAR)"))
oracle("cc_report_rows", "reports", """
    SELECT repo, path || '.py' AS path, CASE WHEN ok THEN 'method' END AS type, CASE WHEN ok THEN 'A' END AS rank,
        CASE WHEN ok THEN number END AS lineno, CASE WHEN ok THEN kind END AS name,
        CASE WHEN ok THEN 4 END AS col_offset, CASE WHEN ok THEN number + 1 END AS complexity,
        CASE WHEN ok THEN number + 9 END AS endline,
        CASE WHEN ok THEN CASE WHEN i = 1 THEN number % 3 + 1 ELSE 0 END END AS methods_count,
        CASE WHEN ok THEN 0 END AS closures_count, kind = 'purchase' AS parse_error, noisy AS internal_error
    FROM (SELECT *, NOT noisy AND i > 0 AS ok FROM (
        SELECT *, kind = 'error' OR (value > 25 AND value <= 40) AS noisy FROM reports)
        JOIN (VALUES ('click', 1), ('view', 1), ('view', 2), ('purchase', 0), ('signup', 0), ('error', 0))
            AS m(k, i) ON k = kind WHERE NOT (noisy AND i = 2))""")
oracle("raw_report_rows", "reports", """
    SELECT repo, path || '.py' AS path, CASE WHEN ok THEN number END AS loc, CASE WHEN ok THEN number + 1 END AS lloc,
        CASE WHEN ok THEN number + 2 END AS sloc, CASE WHEN ok THEN 3 END AS comments, CASE WHEN ok THEN 4 END AS multi,
        CASE WHEN ok THEN 5 END AS blank, CASE WHEN ok THEN 6 END AS single_comments,
        kind = 'purchase' AS parse_error, kind = 'error' OR value > 30 AS internal_error
    FROM (SELECT *, kind NOT IN ('purchase', 'error') AND value <= 30 AS ok FROM reports)""")
oracle("import_listing_rows", "reports", """
    SELECT repo, path, CASE kind WHEN 'click' THEN 'pkg.m' || event_id WHEN 'view' THEN 'm' || event_id ELSE '' END
        AS module_name, import_name, kind NOT IN ('click', 'view') AS parse_error
    FROM reports JOIN (VALUES ('click', 'os.path'), ('click', 'numpy.linalg'), ('view', ''), ('purchase', ''),
        ('signup', 'lost'), ('error', 'lost')) AS m(k, import_name) ON k = kind""")
oracle("diff_line_counts", "reports", """
    SELECT repo, path, CASE WHEN kind = 'click' THEN 2 + CASE WHEN value > 20 THEN 1 ELSE 0 END ELSE 0 END AS diffcount,
        kind = 'error' AS parse_error, kind <> 'view' AS header_ok FROM reports""")
oracle("line_count_rows", "reports", """
    SELECT repo, path, CASE WHEN NOT failed THEN CAST(number AS BIGINT) END AS nonblank_loc, failed AS internal_error
    FROM (SELECT *, kind IN ('error', 'view') OR value > 30 AS failed FROM reports)""")
OUTCOME = """CASE WHEN event_type IN ('click', 'view') THEN 'json' WHEN event_type = 'error' THEN 'api-limit'
    ELSE 'not-present' END"""
oracle("fetch_outcome", "", f"SELECT event_id AS id, {OUTCOME} AS outcome FROM events")
oracle("repo_meta_flatten", "", """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment || '/' || c_name AS full_name, 'https://x/' || c_custkey AS url,
        'https://y/' || c_custkey AS html_url, CAST(floor(c_acctbal) AS BIGINT) AS stars, '2016-01-01' AS created_at,
        '2017-01-01' AS updated_at, '2018-01-01' AS pushed_at, CAST(floor(abs(c_acctbal) * 10) AS BIGINT) AS size,
        CASE WHEN c_nationkey > 3 THEN c_mktsegment END AS language, CAST(c_nationkey AS BIGINT) AS forks_count,
        CAST(7 AS BIGINT) AS open_issues_count, CAST(c_nationkey AS BIGINT) AS watch,
        'say "hi",' || chr(10) || c_name AS description FROM customer""")
oracle("contributor_count", "", """SELECT c_custkey AS id, c_nationkey + 8 AS number_of_contributors,
    c_nationkey + 8 >= 30 AS contributors_capped FROM customer""")

# --- sources and sinks -----------------------------------------------------

_plain("read_id_list", "ds_ids")
ORACLES["read_repo_json"] = ORACLES["repo_meta_flatten"]
ORACLES["repo_meta_full"] = f"""SELECT f.*, number_of_contributors, contributors_capped
    FROM ({ORACLES['repo_meta_flatten']}) f LEFT JOIN ({ORACLES['contributor_count']}) c USING (id)"""
oracle("write_chunks", "meta", f"SELECT id, label FROM ({_chunks('SELECT * FROM meta', 40)})")
oracle("read_repo_meta", "meta", """SELECT id, name, name AS full_name, CAST(NULL AS VARCHAR) AS url, 'h' AS html_url, stars,
    strftime(created_at, '%Y-%m-%d') AS created_at, strftime(updated_at, '%Y-%m-%d') AS updated_at, strftime(pushed_at, '%Y-%m-%d') AS pushed_at,
    size, language, forks_count, open_issues_count, watch, 'a "b", c' || chr(10) || name AS description, number_of_contributors FROM meta""")
oracle("read_result_chunks", "loc ds_ids", """SELECT *, CASE WHEN repo IN (SELECT id FROM ds_ids) THEN 'ds-1'
    ELSE 'nonds-1' END AS chunk FROM loc""")
oracle("append_rows", "", "SELECT c_custkey AS id FROM customer")
oracle("append_run", "", f"SELECT CASE WHEN c_mktsegment = '{DS_SEGMENT}' THEN 'ds' ELSE 'nonds' END AS run, c_custkey AS id FROM customer")
oracle("write_with_probes", "lint", " UNION ALL ".join(
    f"SELECT '{n}' AS probe, count(*) FILTER ({c}) AS hits, count(*) AS total, {k} AS n FROM lint" for n, c, k in (
        ("parse_error", "parse_error", "NULL"), ("fatal", "type = 'fatal'", "NULL"), ("no_message", "symbol IS NULL", "NULL"), ("rows read back", "true", "count(*)"))))
TREE = """tree AS (SELECT CAST(substr(source, 4) AS BIGINT) AS repo, substr(source, 4) || CASE WHEN doc_id % 5 = 0 THEN '/_pkg/__init__' ELSE '/m ' END
        || doc_id || '.py' AS path, CASE WHEN doc_id % 7 = 0 THEN '' ELSE coalesce(text, '') END AS content FROM documents WHERE doc_id % 11 <> 0)"""
oracle("scan_source_files", "", "SELECT repo, path, CAST(length(content) AS INTEGER) AS n_chars, md5(content) AS md5 FROM tree", TREE)
oracle("scan_source_files_of_repos", "", """SELECT repo, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS n_chars, count(*) FILTER (content = '') AS empty
    FROM tree WHERE repo IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0) GROUP BY repo""", TREE)
oracle("list_source_files", "", """SELECT path, CAST(strlen(content) AS BIGINT) AS bytes
    FROM tree WHERE repo IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0)""", TREE)
oracle("write_by_outcome", "", f"""SELECT {OUTCOME} AS outcome, count(*) AS n,
    count(*) FILTER (event_type IN ('click', 'view')) AS named FROM events GROUP BY 1""")
oracle("read_intermediate", "labels", "SELECT cat, count(*) AS n FROM labels GROUP BY cat")
oracle("write_table", "version_tab", 'SELECT repo, either, python3, summary, "select" FROM version_tab')
oracle("scan_warehouse", "", "SELECT user_id AS repo_id, count(*) AS stars FROM events GROUP BY user_id")

# --- lint per line ---------------------------------------------------------

_plain("lint_counts", "counts")
_plain("lint_pivot", "wide")
oracle("cast_value", "lint", """SELECT repo, path, symbol, CAST(count(*) AS DOUBLE) AS value FROM lint
    WHERE symbol IS NOT NULL GROUP BY ALL""")
oracle("enrich_files", "features",
       'SELECT repo, path, "lint_AF", loc, cat, round(complexity, 6) AS complexity FROM features')
ORACLES["enrich_files_bucketed"] = ORACLES["enrich_files"]
ORACLES["widen_features"] = ORACLES["lint_pivot"]
oracle("lint_features", "counts", "SELECT repo, path, string_agg(symbol || '=' || n, ',' ORDER BY symbol) AS lint FROM counts GROUP BY repo, path")
NUMBERED = 'numbered AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS "index", count(*) AS files FROM counts GROUP BY symbol)'
oracle("feature_index", "counts", "SELECT * FROM numbered", NUMBERED)
oracle("feature_arrays", "counts", """SELECT repo, path, string_agg(CAST("index" AS VARCHAR), ',' ORDER BY "index") AS indices,
    string_agg(CAST(n AS VARCHAR), ',' ORDER BY "index") AS values FROM counts JOIN numbered USING (symbol) GROUP BY repo, path""", NUMBERED)
oracle("attach_repo_profile", "loc profile", """SELECT l.*, p.* EXCLUDE (repo) REPLACE (round(frac_ml, 6) AS frac_ml)
    FROM loc l LEFT JOIN profile p USING (repo)""")
oracle("feature_table", "features", """SELECT * REPLACE (round(complexity, 6) AS complexity,
    round(frac_ml, 6) AS frac_ml) FROM features""")
ORACLES["sparse_feature_table"] = ORACLES["feature_table"]
MELTED = "melted AS (" + " UNION ALL ".join(
    f"SELECT repo, path, cat, loc, is_ml_repo, '{c}' AS variable, round(CAST(\"{c}\" AS DOUBLE), 6) AS value FROM features"
    for c in [f"lint_{s}" for s in SYMBOLS] + ["complexity", "ml0", "no-ml-dependency", "test", "total", "frac_ml"]
) + ")"
oracle("melt_features", "features", "SELECT * FROM melted", MELTED)
oracle("variable_prefix", "features", """SELECT variable, count(*) AS n, sum(value) AS total FROM melted
    WHERE variable LIKE 'lint%' GROUP BY variable""", MELTED)


def _rounded_density(source: str, where: str = "") -> str:
    return f"SELECT * REPLACE (round(normval, 6) AS normval) FROM {source} {where}"


oracle("lint_density_by_repo", "dense_repo", _rounded_density("dense_repo", "WHERE value > 0"))
oracle("lint_density_by_repo_dense", "dense_repo", _rounded_density("dense_repo"))
oracle("lint_density_with_clean_files", "dense_clean", _rounded_density("dense_clean", "WHERE value > 0"))
oracle("lint_density_by_category", "dense_cat", _rounded_density("dense_cat", "WHERE value > 0"))
oracle("lint_density_by_category_dense", "dense_cat", _rounded_density("dense_cat"))
oracle("lint_by_category", "dense_cat", _rounded_density("dense_cat", "WHERE value > 0"))

# --- two-sample statistics -------------------------------------------------
# rows: (factor, x, in_a), one per member

MEASURES = "members AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, {c} AS x, l_returnflag = 'R' AS in_a FROM lineitem"
    for f, c in (("quantity", "l_quantity"), ("discount", "l_discount"), ("price", "l_extendedprice"))) + ")"

RANKED = """,
ranked AS (SELECT *, rank() OVER (PARTITION BY factor ORDER BY x)
        + (count(*) OVER (PARTITION BY factor, x) - 1) / 2 AS r,
    count(*) OVER (PARTITION BY factor, x) AS t FROM members),
base AS (SELECT factor, count(*) FILTER (in_a) AS na, count(*) FILTER (NOT in_a) AS nb,
    count(*) AS n, sum(r) FILTER (in_a) AS ra, sum(r) FILTER (NOT in_a) AS rb,
    sum(CAST(t AS DOUBLE) * t - 1) AS ties, min(x) AS lo, max(x) AS hi,
    avg(x) FILTER (in_a) AS ma, avg(x) FILTER (NOT in_a) AS mb, avg(x) AS m,
    median(x) FILTER (in_a) AS qa, median(x) FILTER (NOT in_a) AS qb,
    stddev_samp(x) FILTER (in_a) AS sa, stddev_samp(x) FILTER (NOT in_a) AS sb,
    var_pop(x) FILTER (in_a) * count(*) FILTER (in_a) + var_pop(x) FILTER (NOT in_a) * count(*) FILTER (NOT in_a) AS ssw
    FROM ranked GROUP BY factor),
stat AS (SELECT *, 1 - ties / (CAST(n AS DOUBLE) * n * n - n) AS c,
    (na * (ma - m) * (ma - m) + nb * (mb - m) * (mb - m)) / (ssw / (n - 2)) AS f,
    ra - CAST(na AS DOUBLE) * (na + 1) / 2 AS u FROM base WHERE lo < hi),
tested AS (SELECT *, (12.0 / (CAST(n AS DOUBLE) * (n + 1)) * (ra * ra / na + rb * rb / nb) - 3.0 * (n + 1)) / c AS h,
    sqrt(c * na * nb * (n + 1) / 12.0) AS sd, CAST(na AS DOUBLE) * nb AS pairs FROM stat),
deviates AS (SELECT *, (greatest(u, pairs - u) - pairs / 2 - 0.5) / sd AS z2,
    (pairs - u - pairs / 2 - 0.5) / sd AS zl, (u - pairs / 2 - 0.5) / sd AS zg,
    sqrt(f) AS tt, n - 2 AS df2 FROM tested)"""


def _erfc(z: str) -> str:
    # 1 - exp(-z^2) * sum z^(2k+1) / gamma(k + 3/2), odd in z; a continued fraction where that would cancel
    return f"""(CASE WHEN ({z}) < 2 THEN 1 - exp(-({z}) * ({z})) * list_sum(list_transform(range(0, 100),
        lambda k: pow({z}, 2 * k + 1) / exp(lgamma(k + 1.5))))
        ELSE exp(-({z}) * ({z})) / sqrt(pi()) / list_reduce(list_prepend(CAST({z} AS DOUBLE), list_transform(range(90, 0, -1), lambda k: k / 2.0)),
            lambda x, k: ({z}) + k / x) END)"""


def _digits(p: str, name: str) -> str:
    """The decimal logarithm of a probability, six places."""
    return f"(SELECT CASE WHEN p > 1e-300 THEN round(log10(p), 6) END FROM (SELECT {p} AS p)) AS {name}"


def _sf(z: str) -> str:
    return f"(0.5 * {_erfc(f'({z}) / sqrt(2.0)')})"


# twice the tail of Student's t by Simpson's rule: one less what lies between 0 and t, or what lies beyond t = tt + s / (1 - s) / tt
_DENSITY = "exp(lgamma((df2 + 1) / 2) - lgamma(df2 / 2) - 0.5 * ln(df2 * pi()) - (df2 + 1) / 2 * ln(1 + ({x}) * ({x}) / df2))"
_WEIGHT = "CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
F_TAIL = f"""CASE WHEN tt < 1 THEN 1 - 2 * tt / 6000 * list_sum(list_transform(range(0, 2001), lambda k:
        {_WEIGHT} * {_DENSITY.format(x='k * tt / 2000')}))
    ELSE 2 / tt / 6000 * list_sum(list_transform(range(0, 2000), lambda k:
        {_WEIGHT} * {_DENSITY.format(x='tt + k / (2000.0 - k) / tt')} / pow(1 - k / 2000.0, 2))) END"""
K_TAIL = _erfc("sqrt(greatest(h, 0) / 2)")

SUMMARY = """round(ma, 6) AS meana, round(qa, 6) AS meda, round(sa, 6) AS stda,
    round(mb, 6) AS meanb, round(qb, 6) AS medb, round(sb, 6) AS stdb"""
ANOVA = f"round(f, 6) AS f_stat, {_digits(F_TAIL, 'f_pval')}"
KRUSKAL = f"round(h, 6) AS k_stat, {_digits(K_TAIL, 'k_pval')}"
U_TWO = f"least(1, 2 * {_sf('z2')})"
WHITNEY = f"round(u, 6) AS u_stat, {_digits(U_TWO, 'u_pval')}, {_digits(_sf('zl'), 'u_pval_less')}, {_digits(_sf('zg'), 'u_pval_greater')}"
FULL = f"SELECT b.factor, {SUMMARY}, {ANOVA}, {KRUSKAL}, {WHITNEY} FROM base b LEFT JOIN deviates d USING (factor)"
for _c in ("ma", "qa", "sa", "mb", "qb", "sb"):
    FULL = FULL.replace(f"round({_c},", f"round(b.{_c},")

STEPS = """,
steps AS (SELECT factor, x, a, b, sum(a) OVER w / sum(a) OVER p AS ecdf_a, sum(b) OVER w / sum(b) OVER p AS ecdf_b,
    sum(a) OVER p AS na, sum(b) OVER p AS nb
    FROM (SELECT factor, x, count(*) FILTER (in_a) AS a, count(*) FILTER (NOT in_a) AS b FROM members GROUP BY factor, x)
    WINDOW p AS (PARTITION BY factor), w AS (PARTITION BY factor ORDER BY x))"""
KS = """SELECT factor, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, round(d, 6) AS ks_stat,
    """ + _digits("""CASE WHEN t <= 0.05 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(1, 400),
        lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * t * t)))) END""", "ks_pval") + """
    FROM (SELECT *, sqrt(CAST(na AS DOUBLE) * nb / (na + nb)) * d AS t
          FROM (SELECT factor, na, nb, max(abs(ecdf_a - ecdf_b)) AS d FROM steps GROUP BY factor, na, nb))"""

oracle("average_rank", "", """SELECT factor, round(x, 6) AS x, count(*) FILTER (in_a) AS a,
    count(*) FILTER (NOT in_a) AS b, any_value(t) AS ties, round(any_value(r), 6) AS rank
    FROM ranked GROUP BY factor, x""", MEASURES + RANKED)
oracle("ecdf", "", """SELECT factor, round(x, 6) AS x, round(ecdf_a, 6) AS ecdf_a, round(ecdf_b, 6) AS ecdf_b
    FROM steps""", MEASURES + STEPS)
oracle("two_group_summary", "", f"SELECT factor, {SUMMARY} FROM base", MEASURES + RANKED)
oracle("anova_f", "", f"SELECT factor, {ANOVA} FROM deviates", MEASURES + RANKED)
oracle("kruskal_h", "", f"SELECT factor, {KRUSKAL} FROM deviates", MEASURES + RANKED)
oracle("mann_whitney_u", "", f"SELECT factor, {WHITNEY} FROM deviates", MEASURES + RANKED)
oracle("ks_two_sample", "", KS, MEASURES + STEPS)
SMALL = "members AS (SELECT o_custkey AS factor, o_totalprice AS x, o_orderstatus = 'F' AS in_a FROM orders)"
# every order of two groups, one member after the other: how many there are with i and j members and u pairs
ORDERS = """,
sizes AS (SELECT DISTINCT least(na, nb) AS m, greatest(na, nb) AS n FROM tested WHERE ties = 0),
ways(m, n, i, j, u, w) AS (SELECT m, n, 0, 0, 0, CAST(1 AS DOUBLE) FROM sizes UNION ALL
    SELECT m, n, i + first, j + 1 - first, u + first * j, sum(w) FROM ways, (VALUES (0), (1)) AS s(first)
    WHERE (first = 1 AND i < m) OR (first = 0 AND j < n) GROUP BY ALL),
ends AS (SELECT m, n, u, sum(w) OVER (PARTITION BY m, n ORDER BY u DESC) / sum(w) OVER (PARTITION BY m, n) AS tail FROM ways WHERE i = m AND j = n),
pvals AS (SELECT factor, u, CASE WHEN h.tail IS NULL THEN """ + U_TWO + """ ELSE least(1, 2 * h.tail) END AS two,
    coalesce(l.tail, """ + _sf("zl") + """) AS less, coalesce(g.tail, """ + _sf("zg") + """) AS greater
    FROM (SELECT *, least(na, nb) AS few, greatest(na, nb) AS n2 FROM deviates WHERE na > 0 AND nb > 0) d
    LEFT JOIN (SELECT m, n, u AS v, tail FROM ends) h ON ties = 0 AND h.m = few AND h.n = n2 AND h.v = greatest(u, pairs - u)
    LEFT JOIN (SELECT m, n, u AS v, tail FROM ends) l ON ties = 0 AND l.m = few AND l.n = n2 AND l.v = pairs - u
    LEFT JOIN (SELECT m, n, u AS v, tail FROM ends) g ON ties = 0 AND g.m = few AND g.n = n2 AND g.v = u)"""
oracle("mann_whitney_u_exact", "", f"""SELECT factor, u AS u_stat, {_digits('two', 'u_pval')}, {_digits('less', 'u_pval_less')}, {_digits('greater', 'u_pval_greater')}
    FROM pvals""", SMALL + RANKED + ORDERS)
ORACLES["mann_whitney_u_exact"] = ORACLES["mann_whitney_u_exact"].replace("WITH", "WITH RECURSIVE", 1)
# paths that stay nearer than the distance found
PATHS = """,
apart AS (SELECT factor, na, nb, max(abs(ecdf_a - ecdf_b)) AS d, CAST(round(max(abs(ecdf_a - ecdf_b)) * na * nb) AS BIGINT) AS far
    FROM steps WHERE na > 0 AND nb > 0 GROUP BY factor, na, nb),
inside(m, n, far, i, j, w) AS (SELECT DISTINCT na, nb, far, 0, 0, CAST(1 AS DOUBLE) FROM apart UNION ALL
    SELECT m, n, far, i + first, j + 1 - first, sum(w * CASE WHEN first = 1 THEN m - i ELSE n - j END / (m + n - i - j)) FROM inside, (VALUES (0), (1)) AS s(first)
    WHERE (first = 1 AND i < m AND abs((i + 1) * n - j * m) < far) OR (first = 0 AND j < n AND abs(i * n - (j + 1) * m) < far) GROUP BY ALL)"""
oracle("ks_two_sample_exact", "", f"""SELECT factor, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, round(d, 6) AS ks_stat,
    {_digits('1 - coalesce(w, 0)', 'ks_pval')}
    FROM apart LEFT JOIN inside ON i = m AND j = n AND m = na AND n = nb AND inside.far = apart.far""", SMALL + STEPS + PATHS)
ORACLES["ks_two_sample_exact"] = ORACLES["ks_two_sample_exact"].replace("WITH", "WITH RECURSIVE", 1)
LINT_MEMBERS = "members AS (SELECT variable AS factor, normval AS x, is_ml_repo AS in_a FROM dense_repo)"
oracle("significance_table", "dense_repo", FULL, LINT_MEMBERS + RANKED)
oracle("most_significant_first", "dense_repo",
       f"SELECT factor, {_digits(U_TWO, 'u_pval')} FROM base LEFT JOIN deviates USING (factor)",
       LINT_MEMBERS + RANKED)
# The selected data-science ids decide the group, the selected ids of both groups the rows.
CHOSEN = """ds_chosen AS (SELECT id FROM enriched WHERE id IN (SELECT id FROM ds_ids) AND id <> 858127 AND "select"),
members AS (SELECT variable AS factor, normval AS x,
        repo IN (SELECT id FROM ds_chosen) AND repo IN (SELECT repo FROM labels) AS in_a
    FROM dense_repo WHERE repo IN (SELECT id FROM ds_chosen UNION SELECT id FROM nonds_chosen))"""
oracle("lint_significance", "dense_repo nonds_chosen enriched labels", FULL, CHOSEN + RANKED)

# --- curves and comparisons ------------------------------------------------


def _curve(values: str, log: bool = False) -> str:
    """Curve of (dim, grp, x): the share of values in bin b or above, for all 999 bins."""
    lo, hi = ("log10(min(x))", "log10(max(x)) + 0.001") if log else ("min(x)", "max(x) + 0.001")
    edge = "pow(10, lo + k * (hi - lo) / 999)" if log else "lo + k * ((hi - lo) / 999)"
    return f"""vals AS ({values}),
    lim AS (SELECT dim, {lo} AS lo, {hi} AS hi FROM vals GROUP BY dim),
    cnt AS (SELECT dim, grp, x, count(*) AS n FROM vals GROUP BY dim, grp, x),
    placed AS (SELECT dim, grp, n, greatest(0, least(998, len(list_filter(range(0, 1000),
        lambda k: {edge} <= x)) - 1)) AS bin FROM cnt JOIN lim USING (dim)),
    binned AS (SELECT dim, grp, bin, sum(n) AS n FROM placed GROUP BY dim, grp, bin),
    grid AS (SELECT dim, grp, lo, hi, total, unnest(range(0, 999)) AS k
        FROM (SELECT dim, grp, sum(n) AS total FROM cnt GROUP BY dim, grp) JOIN lim USING (dim)),
    curve AS (SELECT g.dim, g.grp, g.k AS bin, round({edge}, 6) AS edge,
        round(sum(coalesce(b.n, 0)) OVER (PARTITION BY g.dim, g.grp ORDER BY g.k DESC) / g.total, 6) AS survival
        FROM grid g LEFT JOIN binned b ON b.dim = g.dim AND b.grp = g.grp AND b.bin = g.k)"""


GRP = f"CASE WHEN language = '{DS_SEGMENT}' THEN 'DS' ELSE 'non-DS' END AS grp"
FLOOR = "CASE WHEN {0} > 0.9 THEN CAST({0} AS DOUBLE) ELSE 0.9 END AS x"
oracle("survival_curve_log", "meta", "SELECT * FROM curve",
       _curve(f"SELECT 'stars' AS dim, {GRP}, {FLOOR.format('stars')} FROM meta", log=True))
oracle("survival_curve_linear", "meta", "SELECT * FROM curve", _curve(
    f"""SELECT 'number_of_contributors' AS dim, {GRP}, CAST(number_of_contributors AS DOUBLE) AS x
    FROM meta WHERE number_of_contributors IS NOT NULL"""))
oracle("survival_curve_clipped", "dense_repo", "SELECT * FROM curve", _curve(
    """SELECT variable AS dim, CASE WHEN is_ml_repo THEN 'DS' ELSE 'non-DS' END AS grp,
    CASE WHEN normval > 0.0002 THEN 0.0002 ELSE normval END AS x FROM dense_repo"""))


def _by_category(is_ml: str) -> str:
    return _curve(f"""SELECT variable AS dim, cat AS grp, CASE WHEN normval > 0.0005 THEN 0.0005 ELSE normval END AS x
        FROM dense_cat WHERE repo IN (SELECT repo FROM deep) AND cat <> '0' AND is_ml_repo = {is_ml}""")


oracle("survival_curve_by_category", "dense_cat deep", "SELECT * FROM curve", _by_category("false"))
oracle("lint_by_category_curves", "dense_cat deep", "SELECT * FROM curve", _by_category("true"))
LOG_DIMS = ("stars", "size", "forks_count", "open_issues_count", "watch", "loc", "complexity")
LINEAR_DIMS = ("age", "number_of_contributors")
BOTH = """both_groups AS (
    SELECT *, 'DS' AS grp FROM enriched WHERE id IN (SELECT id FROM ds_ids) AND id <> 31 AND "select"
    UNION ALL SELECT *, 'non-DS' AS grp FROM nonds_chosen)"""
TALL = " UNION ALL ".join(
    f"SELECT '{d}' AS dim, grp, CAST({d} AS DOUBLE) AS x FROM both_groups" for d in (*LOG_DIMS, *LINEAR_DIMS))
SELECTED = "enriched ds_ids nonds_chosen"
oracle("compare_distributions_tests", SELECTED, KS,
       f"{BOTH}, members AS (SELECT dim AS factor, x, grp = 'DS' AS in_a FROM ({TALL}) WHERE x IS NOT NULL)" + STEPS)
for _name, _group in (("compare_distributions", "non-DS"), ("compare_distributions_languages_ds", "DS")):
    oracle(_name, SELECTED, f"""SELECT language, round(count(*) / sum(count(*)) OVER (), 6) AS share
        FROM both_groups WHERE grp = '{_group}' GROUP BY language""", BOTH)
oracle("compare_distributions_summary", SELECTED,
       f"SELECT dim, grp, {_describe('x')} FROM ({TALL}) GROUP BY dim, grp HAVING count(x) > 0", BOTH)
oracle("compare_distributions_curves", SELECTED, "SELECT * FROM curve", BOTH + ", " + _curve(" UNION ALL ".join(
    f"SELECT '{d}' AS dim, grp, {FLOOR.format(d)} FROM both_groups" for d in LOG_DIMS), log=True))
oracle("compare_distributions_curves_linear", SELECTED, "SELECT * FROM curve", BOTH + ", " + _curve(" UNION ALL ".join(
    f"SELECT '{d}' AS dim, grp, CAST({d} AS DOUBLE) AS x FROM both_groups WHERE {d} IS NOT NULL" for d in LINEAR_DIMS)))
CAPS = {"lint_AF": 0.0001, "lint_NO": 0.0004, "lint_RF": 1.0}
_CAP = "CASE variable " + " ".join(f"WHEN '{d}' THEN {c}" for d, c in CAPS.items()) + " END"
oracle("lint_curves", "dense_repo", "SELECT * FROM curve", _curve(
    f"""SELECT variable AS dim, CASE WHEN is_ml_repo THEN 'DS' ELSE 'non-DS' END AS grp,
    least(normval, {_CAP}) AS x FROM dense_repo WHERE variable IN {_list(CAPS)}"""))
oracle("lint_curve_tests", "dense_repo", KS,
       f"members AS (SELECT variable AS factor, normval AS x, is_ml_repo AS in_a FROM dense_repo WHERE variable IN {_list(CAPS)})" + STEPS)
oracle("lint_by_category_sizes", "dense_cat deep", f"""SELECT is_ml_repo, cat, {_describe('loc')} FROM dense_cat
    WHERE repo IN (SELECT repo FROM deep) GROUP BY is_ml_repo, cat""")
oracle("lint_by_category_summary", "dense_cat", f"SELECT {_describe('normval')} FROM dense_cat")
oracle("lint_by_category_repos", "deep", "SELECT repo FROM deep")
