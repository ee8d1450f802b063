"""Tool reports, responses and line checks as rows."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from repometrics.operators import reports, textlint

REPORT = "repo bigint, path string, stdout string, stderr string"


def lint_json(*ids):
    return json.dumps([
        {"type": "convention", "module": "m", "obj": "", "line": i, "column": 0, "path": "m.py",
         "symbol": f"s{i}", "message": 'quote " and\nnewline', "message-id": code}
        for i, code in enumerate(ids)
    ])


def test_lint_reports(make):
    rows = make([
        (1, "ok", lint_json("C1", "C2"), ""),
        (1, "empty", "", "Using config file /x/rc\n\n"),
        (1, "none", "[]", ""),
        (1, "bad", "{oops", ""),
        (1, "noise", lint_json("C1"), "Using config file /x\nTraceback"),
        (1, "syntax", lint_json("C1", "E0001"), None),
        (1, "null", None, None),
    ], REPORT)
    got = reports.lint_report_rows(rows).collect()
    by = {}
    for r in got:
        by.setdefault(r.path, []).append(r)
    assert len(by["ok"]) == 2 and by["ok"][1].message_id == "C2" and by["ok"][0].lint_path == "m.py"
    assert by["ok"][0].message == 'quote " and\nnewline'
    for path, internal in (("empty", False), ("none", False), ("bad", True), ("null", False)):
        (row,) = by[path]
        assert row.symbol is None and row.internal_error is internal and row.parse_error is False
    assert by["noise"][0].internal_error and by["noise"][0].symbol == "s0"
    assert [r.parse_error for r in by["syntax"]] == [True, True]


def test_complexity_reports(make):
    block = {"type": "method", "rank": "A", "lineno": 1, "name": "f", "col_offset": 0, "complexity": 3, "endline": 4,
             "closures": [{"x": 1}, {"x": 2}]}
    cls = {**block, "type": "class", "methods": [block]}
    rows = make([
        (7, "7/a.py", json.dumps({"a.py": [block, cls]}), " \n"),
        (7, "7/b.py", json.dumps({"b.py": {"error": "bad"}}), ""),
        (7, "7/c.py", json.dumps({"c.py": []}), ""),
        (7, "7/d.py", json.dumps({"other.py": [block]}), ""),
        (7, "7/e.py", "{}", ""),
        (7, "7/f.py", "nope", ""),
        (7, "7/g.py", json.dumps({"g.py": [block]}), "warning"),
        (7, "h.py", json.dumps({"h.py": [block]}), ""),
    ], REPORT)
    got = {}
    for r in reports.cc_report_rows(rows).collect():
        got.setdefault(r.path, []).append((r.type, r.complexity, r.methods_count, r.closures_count, r.parse_error, r.internal_error))
    assert got["7/a.py"] == [("method", 3, 0, 2, False, False), ("class", 3, 1, 2, False, False)]
    nothing = (None, None, None, None)
    assert got["7/b.py"] == [(*nothing, True, False)]
    assert got["7/c.py"] == [(*nothing, False, False)]
    for path in ("7/d.py", "7/e.py", "7/f.py", "7/g.py"):
        assert got[path] == [(*nothing, False, True)], path
    assert got["h.py"][0][:2] == ("method", 3)


def test_counter_reports(make):
    counters = {"loc": 9, "lloc": 8, "sloc": 7, "comments": 6, "multi": 5, "blank": 4, "single_comments": 3}
    rows = make([
        (1, "1/a.py", json.dumps({"a.py": counters}), ""),
        (1, "1/b.py", json.dumps({"b.py": {"error": "x"}}), ""),
        (1, "1/c.py", "", ""),
    ], REPORT)
    got = {r.path: tuple(r)[2:] for r in reports.raw_report_rows(rows).collect()}
    assert got["1/a.py"] == (9, 8, 7, 6, 5, 4, 3, False, False)
    assert got["1/b.py"] == (*[None] * 7, True, False)
    assert got["1/c.py"] == (*[None] * 7, False, True)


def test_import_listings(make, values):
    rows = make([(1, "a", "pkg.mod :\n  os.path\n  numpy \n\n", ""), (1, "b", "m:\n", ""), (1, "c", "", ""), (1, "d", "  x\n", "")], REPORT)
    assert values(reports.import_listing_rows(rows), "path", "module_name", "import_name", "parse_error") == [
        ("a", "pkg.mod", "numpy", False), ("a", "pkg.mod", "os.path", False),
        ("b", "m", "", False), ("c", "", "", True), ("d", "", "x", True),
    ]


def test_diffs(make, values):
    diff = "--- a\n+++ a\n@@ -1,2 +1,2 @@\n-print x\n+print(x)\n same\n"
    rows = make([(1, "a", diff, ""), (1, "b", "", "RefactoringTool: Can't parse b"), (1, "c", diff + diff, "x"), (1, "d", "--- a", None)], REPORT)
    assert values(reports.diff_line_counts(rows), "path", "diffcount", "parse_error", "header_ok") == [
        ("a", 2, False, True), ("b", 0, True, True), ("c", 4, False, False), ("d", 0, False, False),
    ]


def test_line_counts(make, values):
    rows = make([(1, "a", "12\n", " \n"), (1, "b", "x", ""), (1, "c", "5", "no such file"), (1, "d", "0\n", None)], REPORT)
    assert values(reports.line_count_rows(rows), "path", "nonblank_loc", "internal_error") == [
        ("a", 12, False), ("b", None, True), ("c", None, True), ("d", 0, False)]


def test_nonblank_loc_of_unreadable_file(make, values):
    rows = make([(1, "a", "x\n\ny"), (1, "b", None)], "repo bigint, path string, content string")
    assert values(reports.nonblank_loc(rows), "path", "nonblank_loc", "internal_error") == [("a", 2, False), ("b", None, True)]


def test_commit_span(make):
    commits = make([
        (1, 0, 300, "c300", 30, "a30"), (1, 2, 100, "c100", 10, "a10"), (1, 1, 900, "c900", 90, "a90"), (5, 0, 7, "c7", 7, "a7"),
    ], "repo bigint, traversal_order bigint, committed_epoch bigint, committed_iso string, authored_epoch bigint, authored_iso string")
    got = {r.repo: r for r in reports.commit_span(commits, make([(1,), (2,), (5,)], "id bigint")).collect()}
    # ends of the traversal, not extremes of the dates
    assert (got[1].first_committed_date, got[1].last_committed_date) == (100, 300)
    assert (got[1].first_authored_datetime, got[1].last_committed_datetime) == ("a10", "c300")
    assert got[2].git_error and got[2].first_committed_date is None
    assert got[5].first_committed_date == got[5].last_committed_date == 7 and not got[5].git_error


def test_fetch_outcome(make):
    rows = make([("r", None), (None, "API rate limit exceeded"), (None, "Not Found"), (None, None)], "name string, message string")
    assert [r.outcome for r in reports.fetch_outcome(rows).collect()] == ["json", "api-limit", "not-present", "not-present"]


@pytest.mark.parametrize("people, capped", [(0, False), (29, False), (30, True)])
def test_contributor_page_n16(make, people, capped):
    text = json.dumps([{"login": str(i)} for i in range(people)])
    row = reports.contributor_count(make([(1, text)], "id bigint, contributors string")).first()
    assert (row.number_of_contributors, row.contributors_capped) == (people, capped)


def test_text_lint(make):
    text = "x" * 101 + "\n" + "# see http\n" + "  # https://e.org/" + "y" * 120 + "\n" + "a = 1 \n\t\n#todo: later\nb\r\n"
    files = make([(1, "a", text), (1, "b", "ok"), (1, "c", "ok\n\n\n"), (1, "d", ""), (1, "e", "q\n" * 1001)],
                 "repo bigint, path string, content string")
    got = {(r.path, r.line, r.symbol) for r in textlint.text_lint_rules(files).collect()}
    assert got == {
        ("a", 1, "line-too-long"), ("a", 4, "trailing-whitespace"), ("a", 5, "trailing-whitespace"), ("a", 6, "fixme"),
        ("b", 1, "missing-final-newline"), ("c", 3, "trailing-newlines"), ("e", 1, "too-many-lines"),
    }
    assert textlint.text_lint_rules(files).filter(F.col("path") == "a").count() == 4


def test_exploded_rows_do_not_repeat_the_report(make):
    """A report with n messages must cost n rows, not n copies of the report."""
    files = make([(1, "1/a", "x", "")], "repo bigint, path string, content string, stderr string")
    tool = files.withColumnRenamed("content", "stdout")
    for df in (textlint.text_lint_rules(files), reports.lint_report_rows(tool), reports.cc_report_rows(tool),
               reports.import_listing_rows(tool)):
        physical = df._jdf.queryExecution().executedPlan().toString()
        kept = re.findall(r"Generate [a-z]*explode\(_\w+#\d+\), \[([^\]]*)\]", physical)
        assert kept and not any(re.search(r"_lines|_messages|_blocks|_names|stdout|content", k) for k in kept), physical


def test_listings_with_several_headings(make, values):
    rows = make([(1, "a", "pkg.a:\n  os\npkg.b:\n  re\n", ""), (1, "b", "m:\n  os\n", ""), (1, "c", "", "")], REPORT)
    assert values(reports.import_listing_rows(rows, flag_headings=True), "path", "module_name", "import_name", "several_headings") == [
        ("a", "pkg.a", "os", True), ("a", "pkg.a", "re", True), ("b", "m", "os", False), ("c", "", "", False)]
    assert "several_headings" not in reports.import_listing_rows(rows).columns


def test_tags_in_strings_are_no_notes(make, values):
    """Strings in one line and over several, escapes, quotes in comments; the state ends with the file."""
    text = [
        'x = "# TODO a"', "y = '# TODO b' # TODO c", '"""doc', "# TODO d", 'it\'s \\""" # TODO e', '""" # TODO f', "# it's TODO",
        "z = '''one # TODO g''' # XXX h", r"s = 'it\'s # TODO i'", '# TODO """ j', "t = r'''", "# TODO k''' # FIXME l",
        r"v = '\\' # TODO m", 'w = "" # TODO n', 'a = """b""" + """', "# TODO o", '"""', "don't # TODO p", "# TODO q",
    ]
    files = make([(1, "a", "\n".join(text) + "\n"), (1, "b", '# TODO r\n"""\n'), (1, "c", "# TODO s\n"), (1, "d", '"""\n\n\n# TODO')], "repo bigint, path string, content string")
    found = textlint.text_lint_rules(files).filter("symbol = 'fixme'")
    assert values(found, "path", "line", "message") == [
        ("a", 2, "# TODO c"), ("a", 6, "# TODO f"), ("a", 8, "# XXX h"), ("a", 10, '# TODO """ j'), ("a", 12, "# FIXME l"), ("a", 13, "# TODO m"),
        ("a", 14, "# TODO n"), ("a", 18, "# TODO p"), ("a", 19, "# TODO q"), ("b", 1, "# TODO r"), ("c", 1, "# TODO s")]


def test_long_lines_and_many_strings(make, values):
    """A line of a million characters of quotes and escapes, and a file of many strings in triple quotes."""
    long = "x = '" + r"\'a" * 300_000 + "' # TODO end"
    many = '"""\n# TODO no\n"""\n# TODO yes\n' * 2_000
    files = make([(1, "a", long), (1, "b", many)], "repo bigint, path string, content string")
    found = textlint.text_lint_rules(files).filter("symbol = 'fixme'")
    assert values(found.groupBy("path", "message").count()) == [("a", "# TODO end", 1), ("b", "# TODO yes", 2_000)]
