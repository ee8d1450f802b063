"""Operator 11: a Merkle tree over a dataset, with a proof for every document.

A leaf is the hash of a row; rows of a source, in ascending ``doc_id``, form its tree, and the
roots of the sources, in ascending order of their names (a missing one first), form the tree above.
``fanout`` neighbours become one node; the last run of a level may be shorter.

Slot pivot: a level is one grouping by tree and parent.  Conditional aggregates spread the children of a
parent into ``fanout`` columns.  The columns joined together hash to the parent; without a
child's own column they are its siblings, those before it and those after it.  Neighbours are dealt in blocks, so one shuffle serves
``STEP`` levels; a node carries at most ``fanout ** STEP`` nodes with their paths within the block.  On the way down these paths
are joined with those from the block upwards.  Positions come from running totals over ranges, so a source may hold any share of the
rows.  Only the number of levels goes to the driver.

A missing value of a leaf counts as ``-``; a text, however long, is hashed in place and not shuffled.  A missing
``doc_id`` comes first in its source; rows with equal ``doc_id`` follow each other in the order of their leaves, and
repeated rows have a leaf each.  Rows without ``doc_id`` are not tampered with.  An empty table has no rows.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import running_totals
from ..session import settle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one shuffle serves: nodes are dealt by blocks of ``fanout ** STEP`` neighbours.
STEP = 4
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    """Hash of the values, each ``-`` if missing, else its length in bytes, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def pivot(nodes: DataFrame, k: int, fanout: int) -> DataFrame:
    """The level above ``nodes`` (``tree, block, height, pos, hash, members``) of level ``k``, in the same columns.

    A parent's members are those of its children, each path longer by the child's siblings.  The root of
    a lower tree moves up as it is.
    """
    slot = F.pmod("pos", F.lit(fanout))
    spread = [F.first(F.when(slot == i, F.col(c)), ignorenulls=True).alias(f"{c}_{i}") for i in range(fanout) for c in ("hash", "members")]
    level = nodes.groupBy("tree", "block", "height", F.floor(F.col("pos") / fanout).cast("long").alias("pos")).agg(*spread)
    own = [F.coalesce(F.col(f"hash_{i}"), F.lit("")) for i in range(fanout)]

    def longer(i: int) -> Column:
        # without the own column: the siblings on both sides
        step = F.array(F.struct(F.concat(F.lit(""), *own[:i]).alias("before"), F.concat(F.lit(""), *own[i + 1:]).alias("after")))
        return F.transform(F.coalesce(F.col(f"members_{i}"), F.array()), lambda m: F.struct(m["carried"].alias("carried"), F.concat(m["path"], step).alias("path")))

    grows = F.col("height") > k
    return level.select(
        "tree", "block", "height", "pos", F.when(grows, digest(*own)).otherwise(own[0]).alias("hash"),
        F.when(grows, F.concat(*(longer(i) for i in range(fanout)))).otherwise(F.col("members_0")).alias("members"))


def build(nodes: DataFrame, order: Sequence[str], carried: Sequence[str], fanout: int) -> list[DataFrame]:
    """Trees over ``nodes`` (``tree, hash``, columns to carry along); several trees grow side by side.

    Each frame holds the nodes ``STEP`` levels above those of the one before, ``tree, height, pos, hash`` and ``members``, the nodes
    below them with their paths so far; the last one holds the roots.
    """
    placed = running_totals(nodes, ["tree"], [F.asc_nulls_first(c) for c in order], {"n": F.lit(1)})
    reach = F.array(*(F.lit(fanout**k) for k in range(int(63 / math.log2(fanout)))))
    current = placed.select(
        "tree", F.size(F.filter(reach, lambda p: p < F.col("total_n"))).alias("height"), F.col("before_n").alias("pos"), "hash", F.struct(*carried).alias("carried"))
    levels, k, top = [], 0, 1
    while k < top:
        member = F.struct("carried", F.array().cast(PATH).alias("path"))
        dealt = current.select("tree", F.floor(F.col("pos") / fanout**STEP).cast("long").alias("block"), "height", "pos", "hash", F.array(member).alias("members"))
        dealt = dealt.repartition("tree", "block")
        for level in range(k, k + STEP):
            dealt = pivot(dealt, level, fanout)
        k += STEP
        levels.append(settle(dealt.drop("block")))
        if k == STEP:
            top = levels[0].agg(F.max("height")).first()[0] or 0
        current = levels[-1].select("tree", "height", "pos", "hash", F.struct("pos").alias("carried"))
    return levels


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The columns carried by each node that ``build`` was given, its ``path``, and what ``above`` has for its tree.

    ``above``: ``tree``, ``path`` from the root of a tree upwards, more columns.  A path holds ``before`` and ``after``, the
    siblings on both sides, from the lowest level to the highest.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    here = levels[-1].join(above, "tree")
    for k in reversed(range(len(levels))):
        if k < len(levels) - 1:
            here = levels[k].join(here, ["tree", "pos"])
        here = here.select("tree", *more, F.col("path").alias("_up"), F.explode("members").alias("_m"))
        here = here.select("tree", "_m.carried.*", F.concat("_m.path", "_up").alias("path"), *more)
    return here


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


def proof_of(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def proofs(docs: DataFrame, fanout: int = 3) -> DataFrame:
    """``doc_id, leaf, other, subroot, root, path`` of every row.

    ``other``: the leaf of the row with its text as ``text_after`` of ``docs`` has it, where there is such a column.
    """
    values = {c: docs[c] for c in COLUMNS}
    other = leaf_of([*(values[c] for c in COLUMNS[:-1]), docs["text_after"]]) if "text_after" in docs.columns else leaf_of([*values.values()])
    # a missing source sorts before an empty one
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), values["source"].cast("string")), F.lit("0")).alias("tree"),
        values["doc_id"].cast("long").alias("doc_id"), leaf_of([*values.values()]).alias("hash"), other.alias("other"))
    rows = settle(rows)
    sources = build(rows.select("*", F.col("hash").alias("leaf")), ["doc_id", "hash"], ["doc_id", "leaf", "other"], fanout)
    named = sources[-1].select(F.lit("").alias("tree"), "hash", F.col("tree").alias("name"), F.col("hash").alias("subroot"))
    dataset = build(named, ["name"], ["name", "subroot"], fanout)
    whole = dataset[-1].select("tree", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))
    above = paths(dataset, whole).select(F.col("name").alias("tree"), "subroot", "root", "path")
    return paths(sources, above).select("doc_id", "leaf", "other", "subroot", "root", "path")


def verify(docs: DataFrame, tampered: Column, text: Column, fanout: int = 3) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Where ``tampered`` holds, the row's text has become ``text`` when it is verified.
    """
    after = F.when(F.coalesce(tampered, F.lit(False)), text).otherwise(docs["text"])
    found = proofs(docs.select(*COLUMNS, after.alias("text_after")), fanout=fanout)
    folded = found.withColumn("folded_root", fold(F.col("other"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_of(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
