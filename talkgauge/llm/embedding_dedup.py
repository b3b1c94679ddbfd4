"""Near copies among embeddings, by an exact tiled comparison in the order of principal components.

Unit vectors are rotated to their principal axes (an orthogonal map, which keeps cosines), fitted on a
bounded sample; the fit decides how much work is saved, never the result. In that order the leading
dimensions of two vectors bound their cosine: what is left of the product is at most the product of the
norms of the suffixes. Vectors are dealt to tiles along the first axis; two tiles, or two blocks of their
vectors, that lie further apart there than similar vectors can are not compared; in a block, dimensions are
accumulated from the leading ones on, and pairs stop as soon as the bound says that they cannot reach the
threshold. Cosines within rounding of the threshold are decided on the given vectors in double precision.

Equal vectors are compared once, by a number of their own. A tile has a bounded number of vectors: a stretch of
the axis that holds more (many near copies of one vector) is split by a hash of that number. Which tiles
meet is found by an equi-join over cells of the axis. Tasks return counts and the links of a spanning
forest, never all pairs. The number of tile pairs, and so the work, grows with the square of the number of vectors where
the first axis tells them apart badly: that is the price of an exact result.

Vectors that are null or empty, zero, or hold null or non-finite components link with nothing; so do vectors
of different lengths with each other. Null ids are no ids: such rows have no links and a null component. Rows
that repeat an id are copies of each other only if their vectors link; links and components are the vector's,
not the id's. Ties go to the smallest id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgauge.llm.common import mapped, scratch, written
from talkgauge.llm.components import components

#: Vectors of the sample on which axes and tile borders are fitted, about.
SAMPLE = 8192
#: Most vectors in a tile, about; least tiles, so that small tables still use several tasks.
TILE, LEAST_TILES = 32_768, 5
#: Vectors in a block, and dimensions accumulated between two looks at the bound.
BLOCK, STEP = 1024, 16
_SLACK, _COARSE_SLACK = 1e-9, 1e-4


def _usable(column: str):
    """Vectors with only finite components, not all zero."""
    v = F.col(column)
    limit = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component, so that nothing overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocks(ids: np.ndarray, x: np.ndarray, axes: np.ndarray):
    """Unit vectors in the order of the first axis: ids, vectors, rotated vectors."""
    u = unit(x)
    y = u @ axes
    order = np.argsort(y[:, 0], kind="stable")
    return ids[order], u[order], y[order]


def linked_pairs(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with a cosine of at least the threshold: rotated blocks a and b, unit vectors ua and ub.

    Dimensions are accumulated STEP by STEP, and only pairs that can still reach the threshold go on; where most pairs can, all
    dimensions are multiplied at once.
    """
    dim = a.shape[1]
    tail = [np.sqrt(np.maximum((x * x)[:, ::-1].cumsum(1)[:, ::-1], 0)) for x in (a, b)]
    tail = [np.concatenate([x, np.zeros((len(x), 1))], axis=1) for x in tail]
    # The first look is in single precision, with slack for its rounding: what it lets through is looked at again.
    at = min(STEP, dim)
    reach = a[:, :at].astype(np.float32) @ b[:, :at].astype(np.float32).T
    reach += np.multiply.outer(tail[0][:, at].astype(np.float32), tail[1][:, at].astype(np.float32))
    i, j = np.nonzero(reach >= np.float32(threshold - _COARSE_SLACK))
    if len(i) * 8 < reach.size:
        some, at = np.zeros(len(i)), 0
        while at < dim and len(i):
            to = min(at + STEP, dim)
            some = some + np.einsum("ij,ij->i", a[i, at:to], b[j, at:to])
            at = to
            go = some + tail[0][i, at] * tail[1][j, at] >= threshold - _SLACK
            i, j, some = i[go], j[go], some[go]
    else:
        dots = a @ b.T
        i, j = np.nonzero(dots >= threshold - _SLACK)
        some = dots[i, j]
    close = np.abs(some - threshold) <= _SLACK
    if close.any():
        exact = np.einsum("ij,ij->i", ua[i[close]], ub[j[close]])
        some[close] = np.where(exact >= threshold, threshold, -1)
    keep = some >= threshold
    return i[keep], j[keep]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        now = root.copy()
        np.minimum.at(now, i, low)
        np.minimum.at(now, j, low)
        np.minimum.at(now, root[i], low)
        np.minimum.at(now, root[j], low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _compare(axes: np.ndarray, threshold: float, gap: float):
    """A task: the vectors of one tile, or of two. Returns (a, b, w): links of a forest (w null), or w links of a (b null)."""

    def run(key, table):
        ids, copies = (np.asarray(table.column(c)).astype(np.int64) for c in ("key", "copies"))
        side, x = np.asarray(table.column("side")), _matrix(table.column("embedding"))
        at = [np.flatnonzero(side == s) for s in (0, 1)]
        one = key[0].as_py() == key[1].as_py()
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "w": pa.array([], pa.int64())})
        if not len(at[0]) or not (one or len(at[1])):
            return empty
        left = _blocks(at[0], x[at[0]], axes)
        right = left if one else _blocks(at[1], x[at[1]], axes)
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        for p in range(0, len(left[0]), BLOCK):
            ia, ua, ya = (v[p : p + BLOCK] for v in left)
            for q in range(p if one else 0, len(right[0]), BLOCK):
                ib, ub, yb = (v[q : q + BLOCK] for v in right)
                if yb[0, 0] - ya[-1, 0] > gap or ya[0, 0] - yb[-1, 0] > gap:
                    continue
                i, j = linked_pairs(ya, yb, ua, ub, threshold)
                if one and p == q:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    i, j = ia[i], ib[j]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    local, where = np.unique(np.concatenate([root[i], root[j]]), return_inverse=True)
                    joined = np.arange(len(ids))
                    joined[local] = local[_forest(len(local), where[: len(i)], where[len(i) :])]
                    root = joined[root]
        has, own = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
        return pa.table(
            {
                "a": pa.array(np.concatenate([ids[own], ids[has]])),
                "b": pa.array(np.concatenate([ids[root[own]], np.zeros(len(has), np.int64)]), mask=np.concatenate([np.zeros(len(own), bool), np.ones(len(has), bool)])),
                "w": pa.array(np.concatenate([np.zeros(len(own), np.int64), links[has]])),
            }
        )

    return run


def _stretches_of(axes: np.ndarray, borders: np.ndarray):
    """Batches with the stretch of the first axis that a vector lies in, and its place there."""

    def run(batches):
        for b in batches:
            x = unit(_matrix(b.column(b.schema.get_field_index("embedding")))) @ axes[:, :1]
            stretch = np.searchsorted(borders, x[:, 0], "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(stretch), pa.array(x[:, 0].copy())], names=[*b.schema.names, "stretch", "lead"])

    return run


def near_copies(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id (smallest id reachable), kept."""
    with scratch(vectors.sparkSession) as keep:
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
        vector = F.when(_usable("embedding") & F.col("vec_id").isNotNull(), F.col("embedding"))
        distinct = rows.select("vec_id", vector.alias("embedding")).filter("embedding IS NOT NULL")
        distinct = distinct.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        distinct = written(distinct.withColumn("key", F.monotonically_increasing_id()))
        found = None
        for (dim,) in distinct.select(F.size("embedding")).distinct().collect():
            of_dim = _links_of(distinct.filter(F.size("embedding") == dim), dim, threshold, tile)
            found = of_dim if found is None else found.unionByName(of_dim)
        if found is None:
            none = F.lit(0).cast("long").alias("n_links")
            return keep(rows.select("vec_id", none, F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")))
        found = written(found)
        groups = components(found.filter("b IS NOT NULL").select("a", "b"))
        counts = found.filter("b IS NULL").groupBy("a").agg(F.sum("w").alias("w"))
        known = distinct.join(counts, F.col("key") == F.col("a"), "left").join(groups, F.col("key") == F.col("node"), "left")
        known = written(known.select("embedding", "key", "first", (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "key").alias("component")))
        # Only components of several vectors need their smallest id looked up.
        least = known.groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("component").alias("in"), "least")
        named = known.join(least, F.col("component") == F.col("in"), "left").select(F.col("embedding").alias("of"), "links", F.coalesce("least", "first").alias("least"))
        joined = rows.select("vec_id", vector.alias("vector")).join(named, F.col("vector") == F.col("of"), "left")
        component = F.coalesce("least", "vec_id")
        return keep(
            joined.select(
                "vec_id",
                F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                component.alias("component_id"),
                F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
            )
        )


def _links_of(distinct: DataFrame, dim: int, threshold: float, tile: int) -> DataFrame:
    n = distinct.count()
    drawn = distinct.filter(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(max(n, 1))) < SAMPLE).select("embedding").toArrow()
    sample = unit(_matrix(drawn.column("embedding"))) if drawn.num_rows else np.eye(dim)
    axes = np.ascontiguousarray(np.linalg.eigh(sample.T @ sample)[1][:, ::-1])
    wanted = max(LEAST_TILES, -(-n // tile))
    lead = np.sort((sample @ axes[:, :1])[:, 0])
    borders = np.unique(lead[np.linspace(0, len(lead) - 1, min(wanted, len(lead)) + 1).astype(int)[1:-1]])
    gap = float(np.sqrt(2 - 2 * threshold)) + 1e-9 if threshold > 0 else 3.0
    placed = written(mapped(distinct.select("embedding", "key", "copies"), _stretches_of(axes, borders), "embedding array<double>, key long, copies long, stretch int, lead double"))
    # A stretch is sliced into tiles of bounded size; a tile knows the stretch of the axis that it lies in.
    most = max(tile, -(-n // wanted) * 2)
    spans = placed.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"), F.min("lead").alias("lo"), F.max("lead").alias("hi"))
    spans = written(spans.withColumn("slices", F.ceil(F.col("n") / most).cast("int")))
    tiles = spans.select("stretch", "slices", "lo", "hi", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    order = F.struct("lo", "stretch", "slice")
    # Tiles meet in the cells of the axis, as wide as the gap, that they reach; a pair counts in the first that both reach.
    cell = lambda x: F.floor(x / gap)
    tiles = written(tiles.withColumn("place", order).withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") + gap)))))
    p = tiles.select("cell", *[F.col(c).alias(f"{c}_p") for c in ("stretch", "slice", "lo", "hi", "place")])
    q = tiles.select("cell", *[F.col(c).alias(f"{c}_q") for c in ("stretch", "slice", "lo", "hi", "place")])
    first = F.col("cell") == cell(F.greatest("lo_p", "lo_q"))
    pairs = p.join(q, "cell").filter((F.col("place_p") <= F.col("place_q")) & (F.col("lo_q") - F.col("hi_p") <= gap) & first)
    pair = F.struct("stretch_p", "slice_p", "stretch_q", "slice_q").alias("pair")
    one = (F.col("stretch_p") == F.col("stretch_q")) & (F.col("slice_p") == F.col("slice_q"))
    sides = [F.struct(F.col(f"stretch_{s}").alias("stretch"), F.col(f"slice_{s}").alias("slice"), F.lit(k).alias("side")) for k, s in enumerate("pq")]
    plan = written(pairs.select(pair, F.explode(F.when(one, F.array(sides[0])).otherwise(F.array(*sides))).alias("of")).select("pair.*", "of.*"))
    mine = placed.join(spans.select("stretch", "slices"), "stretch").withColumn("slice", F.pmod(F.xxhash64("key", F.lit(2)), F.col("slices")).cast("int"))
    mine = mine.join(plan, ["stretch", "slice"])
    tile_of = lambda s: F.struct(F.col(f"stretch_{s}").alias("stretch"), F.col(f"slice_{s}").alias("slice")).alias(s)
    return mine.select(tile_of("p"), tile_of("q"), "side", "key", "copies", "embedding").groupBy("p", "q").applyInArrow(_compare(axes, threshold, gap), "a long, b long, w long")
