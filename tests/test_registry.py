"""Every registered query against its SQL on the smallest test tables."""

from __future__ import annotations

import ast
from pathlib import Path

import pytest

import __spark_entry__ as contract
from testbed.compare import compare, connect
from testbed.oracles import ORACLES
from testbed.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_each_query_has_sql():
    assert set(REGISTRY) == set(ORACLES) and set(REGISTRY) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, SF_DIR) is None


def test_comparison_sees_differences(spark, con, monkeypatch):
    sql = contract.oracle_sql()["loc_by_repo"]
    for wrong in (f"SELECT * FROM ({sql}) WHERE repo > 5", f"SELECT repo, loc + 1 AS loc FROM ({sql})", f"SELECT repo FROM ({sql})"):
        monkeypatch.setitem(ORACLES, "loc_by_repo", wrong)
        assert compare(spark, con, "loc_by_repo", SF_DIR)


def test_entry_has_rows(spark):
    rows = contract.entry(spark).collect()
    assert {r.factor for r in rows} == {f"lint_{s}" for s in ("AF", "AO", "NF", "NO", "RF", "RO")}


def test_no_driver_side_rows_or_udfs_in_the_library():
    banned = {"collect", "toPandas", "toLocalIterator", "localCheckpoint", "crossJoin", "udf", "pandas_udf", "rdd"}
    root = Path(__file__).resolve().parents[1] / "repometrics"
    for file in (f for f in root.rglob("*.py") if f.relative_to(root).parts[0] != "llm"):
        used = {n.attr for n in ast.walk(ast.parse(file.read_text())) if isinstance(n, ast.Attribute)}
        assert not used & banned, (file, used & banned)
