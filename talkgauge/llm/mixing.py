"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target: its share, by weight, of all words, but at most ``most`` times its own size; the
excess is shared again by weight until no target is above its limit. A document of a source is taken
target/size times on average. Rows that are alike (same id, text and source) are one unit; the whole part of
a unit's copies is taken for certain, the fractional part by dependent rounding. Rounding pairs two
fractional units and moves words from one to the other, in a random direction with odds that keep
every unit's expectation, until one of the two is taken wholly or not at all. The words taken from a
source thus stay the same throughout, up to one last fractional unit per source.

Units are counted on the map side first, so an id or a text that many rows share is one unit; they are dealt
to chunks of bounded size by a hash of id and text, so a source of any size is rounded in parallel; each
chunk leaves at most one fractional unit, and those go through a reduction tree of bounded fan-in, level by
level. Random numbers hang on id, text and seed alone: reruns agree however the rows are partitioned. A
unit's copies are dealt evenly to its rows, which differ by one copy at most.

A null text has size 0 and takes 0 words; null sources are one source, last in order. A null id is an id:
rows with it and with different texts are different units. Empty tables give empty results. A source without
words has target 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgauge.llm.common import POSITION, broadcast_if_small, positioned, scratch, written

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
SEED = 7
#: Units that one task rounds together, about; and residues that one node of the tree combines.
CHUNK = 4096
FAN_IN = 64

#: What rows of one unit have in common (the source by its rank).
_UNIT = ("source_at", "id_key", "text_key")


def word_count(text: Column) -> Column:
    """Matches of ``[^\\x20\\x09-\\x0D]+``; null: 0. Counted as word starts, without making the words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n) with source_at (rank), weight and target.

    Sources at their limit are those with the least limit per weight, so with sources in that order the
    level at which the rest share is found by running sums; nothing is iterated. The windows run over
    one row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_at", (F.row_number().over(order) - 1).cast("int"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(listed, (F.col("source_at") % len(weights) + 1).cast("int"))).withColumn("limit", most * F.col("source_size").cast("double"))
    by_ratio = W.orderBy((F.col("limit") / F.col("weight")).asc(), "source_at")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The first source, in that order, whose limit is above the level there sets the level for all that follow.
    leveled = ranked.withColumn("level", level)
    leveled = leveled.withColumn("share", F.min(F.when(F.col("limit") >= F.col("weight") * F.col("level"), F.struct(F.col("limit") / F.col("weight"), "source_at", "level"))).over(every)["level"])
    target = F.least("limit", F.col("weight") * F.coalesce("share", F.lit(0.0)))
    return leveled.withColumn("target", target).drop("level", "share", "limit")


def pivot(size: np.ndarray, part: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Parts in [0, 1] rounded in order, keeping sum(size * part) until one fractional document is left."""
    part, held = part.copy(), -1
    for i in np.flatnonzero((part > 0) & (part < 1)).tolist():
        if held < 0:
            held = i
            continue
        a, b, p, q = float(size[held]), float(size[i]), float(part[held]), float(part[i])
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)  # words that can move to the held one, or from it
        if draws[i] * (up + down) < down:  # gain `up` with odds down : up, so that the mean stays
            gain_p, gain_q = up / a, -up / b
            p, q = (1.0 if (1 - p) * a <= q * b else p + gain_p), (0.0 if q * b <= (1 - p) * a else q + gain_q)
        else:
            p, q = (0.0 if p * a <= (1 - q) * b else p - down / a), (1.0 if (1 - q) * b <= p * a else q + down / b)
        part[held], part[i] = p, q
        held = i if 0 < q < 1 else held if 0 < p < 1 else -1
    return part


def _draws(first: pd.Series, second: pd.Series, salt: int) -> np.ndarray:
    """Uniform numbers that hang on the two keys and the salt alone."""
    with np.errstate(over="ignore"):
        x = first.to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.to_numpy(np.int64).view(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(salt)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        return ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _rounding(salt: int, last: bool):
    """A node of the tree: rounds its units from the largest to the smallest, so that a small one is left over."""

    def run(units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["size", "id_key", "text_key"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        draws = _draws(units["id_key"], units["text_key"], salt)
        part = pivot(units["size"].to_numpy(), units["part"].to_numpy(float), draws)
        if last:
            part = np.where((part > 0) & (part < 1), (draws < part).astype(float), part)
        units["part"] = part
        return units

    return run


def _rounded(units: DataFrame, most_units: int, chunk: int, seed: int) -> DataFrame:
    """``units`` with part rounded to 0 or 1, by the reduction tree."""
    # Units without words, and sources taken a whole number of times, have nothing to round.
    settled = (F.col("size") == 0) | (F.col("part") == 0)
    fractional = (F.col("part") > 0) & (F.col("part") < 1)
    done = units.filter(settled)
    level, width, height = units.filter(~settled), -(-most_units // chunk), 0
    while True:
        last = width <= 1
        level = written(level.groupBy("source_at", "node").applyInPandas(_rounding(seed + height, last), units.schema))
        if last:
            return done.unionByName(level)
        done = done.unionByName(level.filter(~fractional))
        level = level.filter(fractional).withColumn("node", F.floor(F.col("node") / FAN_IN))
        width, height = -(-width // FAN_IN), height + 1


def _dealt(rows: DataFrame, several: DataFrame) -> DataFrame:
    """POSITION and copies of the rows in units of several rows: even shares, and one more for the first rows.

    A unit's rows are numbered slice by slice, a slice being about CHUNK of them by a hash of the position, so
    no unit is one task's work.
    """
    own = rows.join(several, list(_UNIT)).withColumn("slice", F.pmod(F.xxhash64(*POSITION), F.ceil(F.col("rows") / CHUNK)))
    own = written(own.select(*POSITION, *_UNIT, "rows", "copies", "slice"))
    before = W.partitionBy(*_UNIT).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = own.groupBy(*_UNIT, "slice").agg(F.count(F.lit(1)).alias("held"))
    slices = slices.select(*_UNIT, "slice", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("earlier"))
    number = F.col("earlier") + F.row_number().over(W.partitionBy(*_UNIT, "slice").orderBy(*POSITION))
    share = F.floor(F.col("copies") / F.col("rows"))
    more = F.when(number <= F.col("copies") - share * F.col("rows"), 1).otherwise(0)
    return own.join(slices, [*_UNIT, "slice"]).select(*POSITION, (share + more).cast("int").alias("copies"))


def _mixed(docs: DataFrame, weights, most, seed, chunk, text_col, source_col, id_col) -> DataFrame:
    """For every row of positioned ``docs``: POSITION, doc_id, size, source, source_size, target, copies."""
    sized = written(
        docs.select(
            *POSITION,
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("id_key"),
            F.xxhash64(F.col(text_col)).alias("text_key"),
        )
    )
    sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    dim = broadcast_if_small(sources.withColumnRenamed("source", "of"), F.octet_length("of"))
    rows = sized.join(dim, F.col("source").eqNullSafe(F.col("of"))).drop("of", "weight")
    times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    units = rows.groupBy(*_UNIT).agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("size"), F.max(times).alias("times"), F.min(F.struct(*POSITION)).alias("first"))
    units = written(units.select(*_UNIT, "size", "rows", (F.col("times") * F.col("rows")).alias("total"), "first.*"))
    counts = written(units.filter("size > 0").groupBy("source_at").agg(F.count(F.lit(1)).alias("n_units")))
    most_units = counts.agg(F.max("n_units")).first()[0] or 0
    chunks = F.coalesce(F.ceil(F.col("n_units") / chunk), F.lit(1))
    dealt = units.join(broadcast_if_small(counts), "source_at", "left").select(
        *_UNIT,
        "size",
        "rows",
        F.floor("total").alias("whole"),
        (F.col("total") - F.floor("total")).alias("part"),
        *POSITION,
        F.pmod(F.xxhash64("id_key", "text_key"), chunks).alias("node"),
    )
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("part").cast("long")).otherwise(0)
    rounded = _rounded(dealt, most_units, chunk, seed).withColumn("copies", copies)
    settled = rounded.filter("rows = 1").select(*POSITION, F.col("copies").cast("int").alias("copies"))
    several = written(rounded.filter("rows > 1").select(*_UNIT, "rows", "copies"))
    if not several.isEmpty():
        settled = settled.unionByName(_dealt(rows, several))
    return rows.join(written(settled), list(POSITION)).select(*POSITION, "doc_id", "size", "source", "source_size", "target", "copies")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
    chunk: int = CHUNK,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, copies, taken."""
    with scratch(docs.sparkSession) as keep:
        mixed = keep(_mixed(positioned(docs.select(id_col, text_col, source_col)), weights, most, seed, chunk, text_col, source_col, id_col))
    return mixed.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
    chunk: int = CHUNK,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    Rows are found again by their place in the files that they are read from, so repeated and null ids are told apart.
    """
    docs_at = positioned(docs)
    with scratch(docs.sparkSession) as keep:
        copies = _mixed(docs_at, weights, most, seed, chunk, text_col, source_col, id_col).filter("copies > 0")
        copies = keep(copies.select(*[F.col(c).alias(f"_of{c}") for c in POSITION], F.col("copies").alias("_of_copies")))
    same = [F.col(c) == F.col(f"_of{c}") for c in POSITION]
    taken = docs_at.join(copies, same[0] & same[1] & same[2])
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_of_copies")))).select(*[docs_at[c] for c in docs.columns])
