"""Language-version rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_version_label(py2_ok: Column, py3_ok: Column) -> Column:
    """Which interpreters accept a file."""
    return (
        F.when(py2_ok & py3_ok, "either")
        .when(py2_ok, "python2")
        .when(py3_ok, "python3")
        .otherwise("neither")
    )


def version_summary(either: Column, neither: Column, python2: Column, python3: Column) -> Column:
    """One word for a repository's file counts per version."""
    two, three = python2 > 0, python3 > 0
    return (
        F.when(neither > 0, "neither")
        .when(two & three, "mix")
        .when(two, "only2")
        .when(three, "only3")
        .when(either > 0, "either")
        .otherwise("empty")
    )


def version_select(either: Column, neither: Column, python2: Column, python3: Column) -> Column:
    """Is the repository usable from Python 3?  ``neither`` is not looked at: unreadable files do not matter."""
    return ((either > 0) | (python3 > 0)) & (python3 >= python2)
