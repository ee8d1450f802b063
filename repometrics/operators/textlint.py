"""Line-level lint checks over source text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repometrics import constants as C


def _message(line: Column, kind: str, symbol: str, message: Column, code: str) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), line.cast("int").alias("line"), F.lit(symbol).alias("symbol"),
        message.alias("message"), F.lit(code).alias("message_id"),
    )


def _closing(quote: str) -> str:
    """What is left of a string in triple quotes, up to its end."""
    return rf"[^\\{quote}]*+(?:(?:\\.|{quote}(?!{quote}{quote}))[^\\{quote}]*+)*+{quote * 3}"


_TRIPLES = ('"' * 3, "'" * 3)
_QUOTES = {t: f"^{_closing(t[0])}" for t in _TRIPLES}
#: Tokens of a line, in the order in which they are tried: whole strings in triple quotes, one that stays open (group 1),
#: strings in single quotes, a comment (group 2).
_TOKENS = "|".join([
    *(t + _closing(t[0]) for t in _TRIPLES),
    f"({'|'.join(_TRIPLES)}).*",
    *(rf"{q}[^\\{q}]*+(?:\\.[^\\{q}]*+)*+{q}" for q in "\"'"),
    "(#.*)",
])


def _bare(line: Column, state: Column) -> Column:
    """A line without its strings: code, then the comment or the quotes that stay open; missing if a string goes on.

    ``state``: the quotes of the string in which the line begins, or nothing.
    """
    rest = F.when(state == "", line)
    for quote, closing in _QUOTES.items():
        rest = rest.when((state == quote) & line.rlike(closing), F.regexp_replace(line, F.lit(closing), F.lit("")))
    return F.regexp_replace(rest, F.lit(_TOKENS), F.lit("$1$2"))


def _state_after(line: Column, state: Column) -> Column:
    return F.coalesce(F.regexp_extract(_bare(line, state), rf"^[^#]*?({'|'.join(_TRIPLES)})$", 1), state)


def _open_strings(lines: Column) -> Column:
    """``pos, state`` after every line with triple quotes; the state is carried from one such line to the next."""
    entry = F.transform(lines, lambda x, i: F.when(x.rlike("|".join(_TRIPLES)), F.struct(i.alias("pos"), x.alias("line"))))
    return F.aggregate(
        F.array_compact(entry), F.array().cast("array<struct<pos:int,state:string>>"),
        lambda known, m: F.concat(known, F.array(F.struct(m["pos"].alias("pos"), _state_after(m["line"], _last_state(known)).alias("state")))),
    )


def _last_state(known: Column) -> Column:
    return F.coalesce(F.try_element_at(known, F.lit(-1))["state"], F.lit(""))


def text_lint_rules(
    files: DataFrame,
    max_line: int = C.MAX_LINE_LENGTH,
    max_lines: int = C.MAX_MODULE_LINES,
    notes: Sequence[str] = C.NOTE_TAGS,
) -> DataFrame:
    """One lint row per finding in (repo, path, content).

    Lines stream out of one generator; only lines with a finding go on.  A tag counts in a comment only, not
    in a string: whether a line begins inside one is carried through the lines of a file that have triple quotes.
    """
    note = r"(?i)#\s*(" + "|".join(notes) + r")\b"
    # A line break at the very end closes the last line and opens no new one.
    closed = F.endswith("content", F.lit("\n"))
    last = F.size("_lines") - F.when(F.col("_closed"), 1).otherwise(0)
    split = (
        files.filter(F.col("content") != "")
        .select("repo", "path", closed.alias("_closed"), F.split("content", "\n").alias("_lines"))
        .select("repo", "path", "_closed", last.alias("_last"), "_lines")
    )
    split = split.withColumn("_open", _open_strings(F.col("_lines")))
    marked = F.transform("_lines", lambda x, i: F.struct(
        x.alias("raw"), F.when(x.rlike(note), _last_state(F.filter("_open", lambda s: s["pos"] < i))).alias("state")))
    # The text and its lines end here: only single lines are repeated per row.
    numbered = split.select(
        "repo", "path", "_closed", "_last", F.posexplode_outer(marked).alias("_pos", "_line")
    ).filter(F.col("_pos") < F.col("_last")).select("repo", "path", "_closed", "_last", "_pos", F.col("_line.raw").alias("_raw"), F.col("_line.state").alias("_state"))
    line = F.col("_pos") + 1
    is_last = line == F.col("_last")
    text = F.rtrim(F.col("_raw"), F.lit("\r"))
    tail = F.rtrim(text, F.lit(" \t\r\n\x0b"))
    length = F.length(text)
    comment = F.regexp_extract(_bare(text, F.col("_state")), "#.*", 0)
    findings = F.array(
        F.when(
            (length > max_line) & ~text.rlike(C.LONG_LINE_EXCEPTION),
            _message(line, "convention", "line-too-long",
                     F.concat(F.lit("Line too long ("), length.cast("string"), F.lit(f"/{max_line})")), "C0301"),
        ),
        F.when(
            tail != text,
            _message(line, "convention", "trailing-whitespace", F.lit("Trailing whitespace"), "C0303"),
        ),
        F.when(
            F.col("_state").isNotNull() & comment.rlike(note),
            _message(line, "warning", "fixme", F.regexp_extract(comment, note + r".*", 0), "W0511"),
        ),
        F.when(
            is_last & ~F.col("_closed"),
            _message(line, "convention", "missing-final-newline", F.lit("Final newline missing"), "C0304"),
        ),
        F.when(
            is_last & F.col("_closed") & (tail == ""),
            _message(line, "convention", "trailing-newlines", F.lit("Trailing newlines"), "C0305"),
        ),
        F.when(
            is_last & (F.col("_last") > max_lines),
            _message(F.lit(1), "convention", "too-many-lines",
                     F.concat(F.lit("Too many lines in module ("), F.col("_last").cast("string"),
                              F.lit(f"/{max_lines})")), "C0302"),
        ),
    )
    return numbered.select("repo", "path", F.inline(F.array_compact(findings))).select(
        "repo", "path", "type",
        F.lit(None).cast("string").alias("module"), F.lit(None).cast("string").alias("obj"),
        "line", F.lit(0).alias("column"), F.col("path").alias("lint_path"),
        "symbol", "message", "message_id",
        F.lit(False).alias("parse_error"), F.lit(False).alias("internal_error"),
    )
