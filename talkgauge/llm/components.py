"""Connected components of an undirected graph given by its links, all in DataFrames.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014) turn every component into a star around its smallest node. No step gathers a node's
neighbours: minima are aggregated with partial sums on the map side and joined back to the links, where
adaptive execution can split a node with very many links. Every step ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgauge.llm.common import written

#: Links up to which a step's table (16 bytes a row) is written as a few files, however many partitions exchanges have.
FEW_LINKS, FEW_FILES = 1 << 20, 8


def _written(df: DataFrame, few: bool) -> DataFrame:
    return written(df.coalesce(FEW_FILES) if few else df)


def _star(links: DataFrame, minima: DataFrame, few: bool) -> DataFrame:
    """Every (u, v) with u's minimum m."""
    return links.join(_written(minima.withColumnRenamed("u", "of"), few), F.col("u") == F.col("of"))


def _is_forest_of_stars(ends: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then v is the component of u."""
    if not ends.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return ends.join(ends.select(F.col("v").alias("top")), F.col("u") == F.col("top"), "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a and b, long); component is its smallest node.

    Links with a null end and links of a node to itself are ignored; repeated links count once. Without
    links the result is empty.
    """
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    ends = written(ends)
    few = ends.count() <= FEW_LINKS
    while not _is_forest_of_stars(ends):
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both.filter("v > u"), both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), few)
        ends = _written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), few)
        small = _star(ends, ends.groupBy("u").agg(F.min("v").alias("m")), few)
        pulled = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        ends = _written(pulled.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), few)
    nodes = ends.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return _written(nodes.unionByName(ends.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), few)


def labelled(rows: DataFrame, column: str, label: str, groups: DataFrame) -> DataFrame:
    """``rows`` with the component of ``column``; a node without links is its own component."""
    joined = rows.join(groups.select(F.col("node").alias("of"), F.col("component").alias("in")), F.col(column) == F.col("of"), "left")
    return joined.withColumn(label, F.coalesce("in", column)).drop("of", "in")


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``groups`` after ``links`` (a, b) are added: only components are linked, not all nodes again."""
    if links.isEmpty():
        return groups
    between = labelled(labelled(links, "a", "in_a", groups), "b", "in_b", groups).select(F.col("in_a").alias("a"), F.col("in_b").alias("b"))
    moved = components(between).select(F.col("node").alias("was"), F.col("component").alias("now"))
    old = groups.join(moved, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    new = moved.join(groups, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return _written(old.unionByName(new), max(groups.count(), moved.count()) <= FEW_LINKS)
