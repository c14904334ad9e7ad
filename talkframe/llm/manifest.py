"""Merkle manifest of a table: every row is a leaf, every source a subtree, and the sources' roots one tree above them.

A digest is the lowercase hexadecimal SHA-256 of its inputs, concatenated. A leaf digests the fields doc_id, source, lang,
n_chars and text, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. While a level has several nodes, every
``ARITY`` consecutive ones (the last run may be shorter) become their digest.

Each level is one window over blocks of consecutive positions, a multiple of a run long: ``lag`` and ``lead`` columns of the
fixed offsets 1 to 15, masked by the slot in the run and by the run's length, are the siblings, and the rows of slot 0 hash
the parents. Levels are written to the shared folder and shrink by 16; paths are handed down from parents to children. A
source with a third of all rows is cut into ranges of equal depth for its positions and into blocks for its windows, so no
task holds it. Only the depth of the trees reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.llm.common import settle

ARITY = 16
BLOCK = ARITY ** 2  # positions per window partition
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: Mapping[str, Column]) -> Column:
    """Digest of a row's fields, in the given order."""
    def coded(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return digest(*[coded(c) for c in fields.values()])


def positions(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``pos`` (dense, from 0) and ``n`` per ``keys`` in ascending ``order`` (nulls first), whatever the values' spread.

    Ranges of equal depth are cut from all rows and settled with their number, so a recomputed task cannot move a border.
    """
    ranged = settle(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), name)
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    parts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(group).alias("n"))
    return (
        ranged.withColumn("_local", local).join(offsets, [*keys, "_range"])
        .withColumn("pos", F.col("_before") + F.col("_local")).drop("_range", "_local", "_before")
    )


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds ``left`` and ``right``: the digests of a node's run before and after it. ``nodes``: tree, pos, n, hash."""
    window = Window.partitionBy("tree", F.expr(f"pos div {BLOCK}")).orderBy("pos")
    slot = F.col("pos") % ARITY
    run = F.least(F.lit(ARITY), F.col("n") - F.col("pos") + slot)
    none = F.lit("")
    left = [F.when(slot >= k, F.lag("hash", k).over(window)).otherwise(none) for k in range(ARITY - 1, 0, -1)]
    right = [F.when(slot + k < run, F.lead("hash", k).over(window)).otherwise(none) for k in range(1, ARITY)]
    return nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def parents(nodes: DataFrame) -> DataFrame:
    """The next level, hashed by each run's first child."""
    first = nodes.filter((F.col("n") > 1) & (F.col("pos") % ARITY == 0))
    return first.select("tree", F.expr(f"pos div {ARITY}").alias("pos"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"),
                        digest(F.col("hash"), F.col("right")).alias("hash"))


def grow(leaves: DataFrame, name: str) -> list[DataFrame]:
    """All levels of all trees, leaves first, each settled. Trees of one node stop; the rest go on."""
    levels = [settle(with_siblings(leaves), name)]
    deepest = levels[0].agg(F.max("n")).first()[0] or 0
    while deepest > 1:
        levels.append(settle(with_siblings(parents(levels[-1])), name))
        deepest = -(-deepest // ARITY)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of the trees' last nodes."""
    out = None
    for level in levels:
        last = level.filter("n = 1").select("tree", "hash")
        out = last if out is None else out.union(last)
    return out


def handed_down(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Leaves with ``path`` (siblings level by level up to the tree's root, then ``above.path``) and the columns of ``above``.

    ``above``: tree, path and any columns to attach, one row per tree.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]
    upper = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        done = level.filter("n = 1").join(above, "tree")
        if upper is not None:
            up = upper.select("tree", F.col("pos").alias("_up"), F.col("path").alias("_path"), *extra)
            climbed = level.filter("n > 1").withColumn("_up", F.expr(f"pos div {ARITY}")).join(up, ["tree", "_up"])
            climbed = climbed.withColumn("path", F.concat(F.array(F.struct("left", "right")), F.col("_path")))
            done = done.unionByName(climbed.select(*done.columns))
        upper = settle(done.select("tree", "pos", "path", *extra), "paths") if k else done
    return upper


def manifest(docs: DataFrame, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, pos and n in the source, leaf, subroot, root, path, and the columns of ``carry``.

    ``path`` lists (left, right) sibling digests from the leaf to the root; ``fold`` and ``proof`` use it. Missing fields count as
    null. A null source is a tree of its own, first in order; leaves ascend by doc_id (null first), then by leaf digest, so
    repeated rows stand beside each other and any order of them gives the same root. Null and empty texts have different leaves;
    a text of any length is digested whole. A table of one row has its leaf as root and an empty path; an empty table gives an
    empty result. Other columns are not read, and names in ``docs`` cannot clash with those used here. Runs jobs while built.
    """
    have = {c: F.col(c) if c in docs.columns else F.lit(None) for c in FIELDS}
    tree = F.coalesce(F.concat(F.lit("1"), have["source"].cast("string")), F.lit("0"))  # null first, then bytewise
    kept = {f"c_{name}": column for name, column in (carry or {}).items()}
    rows = docs.select(have["doc_id"].alias("doc_id"), tree.alias("tree"), leaf(have).alias("hash"), *[c.alias(n) for n, c in kept.items()])
    levels = grow(positions(rows, ["tree"], ["doc_id", "hash"], "leaves"), "tree")
    subroots = roots(levels).withColumnRenamed("tree", "of").withColumn("tree", F.lit("all"))
    tops = grow(positions(subroots, ["tree"], ["of"], "subroots"), "sources")
    root = roots(tops).select("tree", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root"))
    above = settle(handed_down(tops, root).select(F.col("of").alias("tree"), "path", F.col("hash").alias("subroot"), "root"), "above")
    out = handed_down(levels, above)
    source = F.when(F.col("tree") != "0", F.substring("tree", 2, 1 << 30))
    return out.select("doc_id", source.alias("source"), "pos", "n", F.col("hash").alias("leaf"), "subroot", "root", "path",
                      *[F.col(n).alias(n[2:]) for n in kept])


def fold(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf_digest, lambda acc, step: digest(step["left"], acc, step["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)
