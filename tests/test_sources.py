"""Readers and writers on files as other tools write them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from repometrics import sources
from repometrics.operators import ordering, reports


def test_lint_csv_with_two_path_columns_n9_n10(spark, tmp_path, values):
    (tmp_path / "lint.csv").write_text(
        "repo,path,type,module,obj,line,column,path,symbol,message,message-id,parse_error,internal_error\n"
        '1,1/a.py,convention,m,,3,0,a.py,bad-name,"say ""hi"",\nthen go",C0103,False,False\n'
        "1,1/b.py,,,,,,,,,,False,True\n"
    )
    rows = sources.read_metric_csv(spark, str(tmp_path / "lint.csv"), "lint_messages")
    assert values(rows) == [
        (1, "1/a.py", "convention", "m", None, 3, 0, "a.py", "bad-name", 'say "hi",\nthen go', "C0103", False, False),
        (1, "1/b.py", None, None, None, None, None, None, None, None, None, False, True),
    ]


def test_only_empty_text_is_missing_n20(spark, tmp_path, values):
    (tmp_path / "i.csv").write_text("repo,path,module_name,import_name,parse_error\n1,a,m,NA,False\n1,a,m,null,False\n1,a,m,,True\n")
    rows = sources.read_metric_csv(spark, str(tmp_path / "i.csv"), "imports")
    assert values(rows, "import_name") == [("NA",), ("null",), (None,)]


def test_repo_meta(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "id,name,full_name,url,html_url,stars,created_at,updated_at,pushed_at,size,language,forks_count,"
        "open_issues_count,watch,description,number_of_contributors\n"
        '5,n,o/n,u,h,7,2015-01-30T16:20:43Z,2020-03-02T05:36:26Z,2018-08-20T10:30:47Z,1,,2,3,4,"two\nlines",30\n'
    )
    row = sources.read_repo_meta(spark, str(tmp_path / "m.csv")).first()
    assert (row.id, row.stars, row.language, row.description) == (5, 7, None, "two\nlines")
    assert row.created_at.isoformat() == "2015-01-30T16:20:43"


def test_id_list(spark, tmp_path, values):
    (tmp_path / "ids.csv").write_text("id\n3\n1\n")
    assert values(sources.read_id_list(spark, str(tmp_path / "ids.csv"))) == [(1,), (3,)]


def test_repo_json_and_failures(spark, tmp_path, values):
    ok = {"id": 1, "name": "n", "full_name": "o/n", "owner": {"login": "o", "id": 2, "type": "User"}, "url": "u",
          "html_url": "h", "license": None, "language": None, "stargazers_count": 5, "subscribers_count": 6,
          "created_at": "2009-01-30T16:20:43Z", "extra": {"ignored": True}}
    licensed = {**ok, "id": 2, "license": {"key": "mit", "name": "MIT", "spdx_id": "MIT"}}
    gone = {"message": "Repository access blocked", "block": {"reason": "dmca", "created_at": "2015-08-16T22:05:15Z"}}
    for i, doc in enumerate((ok, licensed, gone)):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=4))
    rows = sources.read_repo_json(spark, str(tmp_path / "*.json"), responses=True)
    out = reports.fetch_outcome(rows)
    assert values(out, "id", "license.key", "outcome") == [(1, None, "json"), (2, "mit", "json"), (None, None, "not-present")]
    flat = reports.repo_meta_flatten(sources.read_repo_json(spark, str(tmp_path / "[01].json")))
    assert values(flat, "id", "stars", "watch") == [(1, 5, 6), (2, 5, 6)]
    sources.write_by_outcome(out.select("id", "message", "outcome"), str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("outcome=*")} == {"outcome=json", "outcome=not-present"}


def test_source_scan(spark, tmp_path, make, values):
    for path, data in {"11/pkg/a.py": b"x = 1\n", "11/b c.py": b"caf\xc3\xa9 \xff\n", "12/a.py": b"", "12/a+b %20c.py": b"", "12/notes.txt": b""}.items():
        file = tmp_path / "corpus" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    listed = make([(p,) for p in ("11/pkg/a.py", "11/b c.py", "12/a.py", "12/a+b %20c.py", "12/notes.txt")], "path string")
    assert sources.scan_source_files(spark, str(tmp_path / "corpus")).count() == 2
    rows = sources.scan_source_files(spark, str(tmp_path / "corpus"), manifest=listed)
    assert values(rows) == [(11, "11/b c.py", "café \ufffd\n"), (11, "11/pkg/a.py", "x = 1\n"), (12, "12/a+b %20c.py", ""), (12, "12/a.py", "")]
    some = sources.scan_source_files(spark, f"file://{tmp_path}/corpus/", make([(12,)], "id bigint"), manifest=listed)
    assert values(some, "path") == [("12/a+b %20c.py",), ("12/a.py",)]


def test_chunks_append_and_tables(spark, tmp_path, make, values):
    header = "repo,path,nonblank_loc,internal_error\n"
    for chunk, line in (("ds-1", "1,a,5,False\n"), ("nonds-1", "2,b,,True\n")):
        (tmp_path / chunk).mkdir()
        (tmp_path / chunk / "loc.csv").write_text(header + line)
    rows = sources.read_result_chunks(spark, [str(tmp_path / "ds-1"), str(tmp_path / "nonds-1")], "loc.csv", "file_loc")
    assert values(rows) == [(1, "a", 5, False, "ds-1"), (2, "b", None, True, "nonds-1")]
    ids = str(tmp_path / "ids")
    sources.append_rows(make([(1,)], "id bigint"), ids)
    sources.append_rows(make([(2,)], "id bigint"), ids)
    assert values(sources.read_id_list(spark, ids)) == [(1,), (2,)]
    sources.write_table(rows, str(tmp_path / "t"))
    assert sources.read_intermediate(spark, str(tmp_path / "t")).count() == 2
    make([(1, 2)], "repo_id bigint, user_id bigint").createOrReplaceTempView("w")
    assert values(sources.scan_warehouse(spark, "w")) == [(1, 2)]


def test_chunk_folders(spark, tmp_path, make):
    rows = ordering.chunk_list(make([(i,) for i in range(7)], "id bigint"), ["id"], 3)
    sources.write_chunks(rows.select("id", "label"), str(tmp_path / "c"))
    assert {p.name for p in (tmp_path / "c").glob("label=*")} == {
        "label=000001-000003", "label=000004-000006", "label=000007-000007"}


def test_id_lists_split_into_tasks(spark, tmp_path):
    """Tables without free text are not multi-line, so one file is several tasks."""
    (tmp_path / "ids.csv").write_text("id\n" + "\n".join(str(i) for i in range(200_000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        ids = sources.read_id_list(spark, str(tmp_path / "ids.csv"))
        assert ids.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and ids.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
