"""Exact self-join of texts on the Jaccard similarity of their word n-grams.

Prefix filtering, rare n-grams first (Chaudhuri et al. 2006; PPJoin+, Xiao et al. 2011): under one global
order of n-grams, two sets that are similar enough share an n-gram among the first few of both. The order
is by how many texts hold an n-gram, rare first, read from a count sketch over all texts (any order is right;
the sketch, whose size follows the texts' up to a bound, makes common n-grams come last), then by hash. Texts are joined on the
prefix n-grams; the length filter and the positional filter drop pairs in the join, the suffix filter
drops those whose suffixes, split at fixed pivots into more parts the larger they are, differ in too many places by the sizes of the parts,
and each pair that is left is verified once on the whole sets.

Pairs within a group of copies are not all made. First every text is paired with a few leaders of its
prefix n-grams in its band of lengths, and the links found are closed to components. Then, for n-grams that still hold
several components, exactly the pairs across components are made, so that no link between components is
lost; texts of one component need no further link to each other. The components are those of all links.

Null texts and texts without words have an empty set (0) and link with nothing: their component is their
own id. Rows of one id are one node, linked by any of its texts. A null id has a null component and links with
nothing. Ties between leaders go to the smallest id. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgauge.llm.common import mapped, scratch, without, written
from talkgauge.llm.components import components, labelled, merged
from talkgauge.llm.shingles import Shingler, mixed

#: Counters of the n-gram sketch: one for so many characters of text, within fixed bounds (the greater is 16 MB broadcast).
LEAST_SKETCH, MOST_SKETCH, CHARS_A_COUNTER = 1 << 14, 1 << 22, 600
#: Counters that travel in one row. A task's counters are bytes; one that is full counts as that many.
SKETCH_BLOCK = 1 << 14
#: Bits of the filter over the ids whose sets are wanted: a fixed size.
FILTER_BITS = 1 << 23
#: Parts into which the suffix filter splits a set: so many at least, and one for so many n-grams at least.
LEAST_PARTS, GRAMS_A_PART = 128, 8
#: n-grams are exchanged in so many rounds, by the first bits of their hash, so that the exchange takes this part of the room.
SLICES = 4
#: Times that the best pair between two components is tried before all that are left are verified.
ROUNDS = 2


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    valid = np.asarray(column.is_valid())
    return np.asarray(column.fill_null(0)).astype(np.int64), valid


def _features(k: int, size: int):
    """For every text its id, set size, signature and part sizes; then the task's part of the sketch."""

    def run(batches):
        shingler, counts = Shingler(k), np.zeros(size, np.int32)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        names = ["doc_id", "n", "sig1", "sig2", "parts", "block", "counts"]
        for b in batches:
            n, sig, parts = [], [], []
            for s in shingler.sets(b.column(1)):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    sig.append((mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mixed(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)))
                bits = max(LEAST_PARTS, len(s) // GRAMS_A_PART).bit_length() - 1
                parts.append(np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes())
                np.add.at(counts, (s & np.uint64(size - 1)).astype(np.int64), 1)
            sig = np.array(sig, np.uint64).reshape(-1, 2).view(np.int64)
            none = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n, kinds[1]), pa.array(np.ascontiguousarray(sig[:, 0])), pa.array(np.ascontiguousarray(sig[:, 1])), pa.array(parts, pa.binary()), pa.nulls(none, kinds[5]), pa.nulls(none, kinds[6])],
                names=names,
            )
        bytes_ = np.minimum(counts, 255).astype(np.uint8)
        for block in range(0, size // SKETCH_BLOCK):
            own = bytes_[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK]
            if own.any():
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in kinds[:5]], pa.array([block], pa.int32()), pa.array([own.tobytes()])], names=names)

    return run


def _block_sums(key, table):
    """The counters of one block, added up over the tasks."""
    total = np.zeros(SKETCH_BLOCK, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), np.uint8)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, (1 << 31) - 1).astype(np.int32).tobytes()])], names=["block", "counts"])


def _prefixes(k: int, percent: int, sketch):
    """The prefix n-grams of every text, with their places in the rare-first order (from 1)."""

    def run(batches):
        shingler, texts_of = Shingler(k), sketch.value
        for b in batches:
            ids, valid = _ids(b.column(0))
            held: list[tuple] = []
            size = 0

            def batch(held=held):
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), *map(pa.array, cols[1:])], names=["gram", "doc_id", "n", "place"])

            for i, s in enumerate(shingler.sets(b.column(1))):
                if not len(s) or not valid[i]:
                    continue
                p = len(s) - (percent * len(s) + 99) // 100 + 1
                first = np.argsort(texts_of[(s & np.uint64(len(texts_of) - 1)).astype(np.int64)], kind="stable")[:p]
                held.append((s[first], np.full(p, ids[i]), np.full(p, len(s), np.int32), np.arange(1, p + 1, dtype=np.int32)))
                size += p
                if size > 200_000:
                    yield batch()
                    held.clear()
                    size = 0
            if held:
                yield batch()

    return run


def _wanted_sets(k: int, bits):
    def run(batches):
        shingler, wanted = Shingler(k), np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        for b in batches:
            ids, valid = _ids(b.column(0))
            use = valid & wanted[(mixed(ids.view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
            own = b.filter(pa.array(use))
            held, at, size = [], [], 0
            for i, s in zip(np.flatnonzero(use), shingler.sets(own.column(1)), strict=True):
                held.append(s.tobytes())
                at.append(ids[i])
                size += len(held[-1])
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held, pa.binary())], names=["of", "set"])
                    held, at, size = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held, pa.binary())], names=["of", "set"])

    return run


def _filter_bits(ids: DataFrame) -> bytes:
    """FILTER_BITS bits, set where an id hashes to: aggregated to words, so what is collected is of fixed size."""

    def run(batches):
        for b in batches:
            at = (mixed(np.asarray(b.column(0)).astype(np.int64).view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.left_shift(1, at & 31))], names=["word", "bit"])

    out = np.zeros(FILTER_BITS >> 5, np.uint32)
    words = mapped(ids, run, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    out[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).astype(np.uint32)
    return out.tobytes()


def _differing(x: np.ndarray, y: np.ndarray) -> int:
    """The least number of n-grams that only one of two sets holds, by the sizes of their parts; halves of a part are added up where one set has more parts."""
    n = min(len(x), len(y))
    x, y = (v.reshape(n, -1).sum(1, dtype=np.int64) for v in (x, y))
    return int(np.abs(x - y).sum())


def _suffix_filter(percent: int):
    """Keeps pairs that may be similar: says whether they are the same set, and drops those whose parts differ too much."""

    def run(batches):
        for b in batches:
            n, m = (np.asarray(b.column(c)).astype(np.int64) for c in ("n_a", "n_b"))
            same = np.asarray(b.column("same"))
            parts = ([np.frombuffer(x.as_buffer(), np.uint8) for x in b.column(c)] for c in ("parts_a", "parts_b"))
            apart = np.array([_differing(x, y) for x, y in zip(*parts, strict=True)], np.int64)
            room = n + m - 2 * -(-percent * (n + m) // (100 + percent)) - apart
            keep = same | (room >= 0) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(same), pa.array(room / np.maximum(n + m, 1))], names=["a", "b", "same", "room"]).filter(pa.array(keep))

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


class _Join:
    def __init__(self, texts: DataFrame, k: int, percent: int):
        self.texts, self.k, self.percent = texts, k, percent
        chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        size = LEAST_SKETCH
        while size < MOST_SKETCH and size * CHARS_A_COUNTER < chars:
            size *= 2
        first = written(mapped(texts, _features(k, size), "doc_id long, n int, sig1 long, sig2 long, parts binary, block int, counts binary"))
        self.features = first.filter("block is null").drop("block", "counts")
        blocks = first.filter("block is not null").select("block", "counts").groupBy("block").applyInArrow(_block_sums, "block int, counts binary").collect()
        sketch = np.zeros(size, np.int32)
        for r in blocks:
            sketch[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] = np.frombuffer(r.counts, np.int32)
        self.sketch = texts.sparkSession.sparkContext.broadcast(sketch)

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) that the suffix filter leaves, with whether the sets are the same, and the room the filter leaves."""
        feature = lambda x: self.features.select(F.col("doc_id").alias(f"of_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "sig1", "sig2", "parts")])
        known = pairs.join(feature("a"), F.col("a") == F.col("of_a")).join(feature("b"), F.col("b") == F.col("of_b"))
        same = (F.col("n_a") == F.col("n_b")) & (F.col("sig1_a") == F.col("sig1_b")) & (F.col("sig2_a") == F.col("sig2_b"))
        known = known.select("a", "b", "n_a", "n_b", "parts_a", "parts_b", same.alias("same"))
        return written(mapped(known, _suffix_filter(self.percent), "a long, b long, same boolean, room double"))

    def sets_of(self, pairs: DataFrame) -> DataFrame | None:
        """(of, set) of every text in ``pairs`` (and of some others, as the filter over ids lets through); None without pairs."""
        rest = pairs.filter("not same")
        bits = _filter_bits(rest.select("a").unionByName(rest.select(F.col("b").alias("a"))).distinct())
        if not any(bits):
            return None
        shared = self.texts.sparkSession.sparkContext.broadcast(bits)
        return written(mapped(self.texts, _wanted_sets(self.k, shared), "of long, set binary"))

    def verified(self, pairs: DataFrame, sets: DataFrame | None) -> DataFrame:
        """The (a, b) of likely ``pairs`` that are similar."""
        good = pairs.filter("same").select("a", "b")
        if sets is None:
            return good
        rest = pairs.filter("not same").select("a", "b").distinct()
        with_b = rest.join(sets.withColumnRenamed("set", "set_b"), F.col("b") == F.col("of")).drop("of")
        both = with_b.join(sets.withColumnRenamed("set", "set_a"), F.col("a") == F.col("of")).drop("of")
        return written(good.unionByName(mapped(both, _verify(self.percent), "a long, b long")))

    def groups(self) -> DataFrame:
        """(node, component) of every text that has a link."""
        spark = self.texts.sparkSession
        with scratch(spark) as keep:
            # Copies with the same set: one link to the first of them each.
            sets = ["n", "sig1", "sig2"]
            whole = self.features.filter("n > 0 and doc_id is not null")
            firsts = written(whole.groupBy(*sets).agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("texts")).filter("texts > 1").drop("texts"))
            groups = keep(components(whole.join(firsts, sets).select("a", F.col("doc_id").alias("b")).filter("a <> b")))
        with scratch(spark) as keep:
            prefixes = written(mapped(self.texts, _prefixes(self.k, self.percent, self.sketch), "gram long, doc_id long, n int, place int"))
            active = None
            for number in range(SLICES):
                with scratch(spark):
                    own = prefixes.filter(F.pmod(F.shiftrightunsigned("gram", 32), F.lit(SLICES)) == number)
                    shared = written(own.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("gram"))
                    part = keep(own.join(shared, "gram"))
                active = part if active is None else active.unionByName(part)
        with scratch(spark) as keep:
            pairs = self.likely(written(self._apart(self._led(active), groups).select("a", "b")))
            groups = keep(merged(groups, self.verified(pairs, self.sets_of(pairs))))
        with scratch(spark) as keep:
            pairs = keep(self._across(active, groups))
        with scratch(spark) as keep:
            pairs = self.likely(pairs)
            wanted = self.sets_of(pairs)
            # Of the pairs between two components, first that which leaves most room: one link makes the others needless.
            for _ in range(ROUNDS):
                apart = written(self._apart(pairs, groups))
                best = apart.groupBy(F.least("in_a", "in_b"), F.greatest("in_a", "in_b")).agg(F.max(F.struct("room", "a", "b", "same")).alias("best")).select("best.*")
                good = self.verified(written(best), wanted)
                if good.isEmpty():
                    break
                groups = merged(groups, good)
            return keep(merged(groups, self.verified(written(self._apart(pairs, groups)), wanted)))

    def _led(self, active: DataFrame) -> DataFrame:
        """Every text with a few leaders of its n-grams in its band of lengths."""
        band = lambda shift: F.floor(F.log(F.col("n").cast("double")) / math.log(100 / self.percent) + shift).cast("int")
        # The first text of a band is often what the others were copied from; another, drawn by hash, helps where it isn't.
        lead = [F.min("doc_id").alias("first"), F.min(F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id"))["doc_id"].alias("drawn")]
        found = []
        for shift in (0.0, 0.5):
            rows = active.select("gram", band(shift).alias("band"), "doc_id")
            leaders = written(rows.groupBy("gram", "band").agg(*lead, F.count(F.lit(1)).alias("texts")).filter("texts > 1").drop("texts"))
            own = rows.withColumnRenamed("doc_id", "b").join(leaders, ["gram", "band"])
            own = own.select("b", F.posexplode(F.array("first", "drawn")).alias("kind", "a")).filter("a <> b").groupBy("b", "kind", "a").agg(F.count(F.lit(1)).alias("grams"))
            # Of a text's leaders of one kind, the one with which it shares the most n-grams.
            best = own.groupBy("b", "kind").agg(F.max(F.struct("grams", "a"))["a"].alias("a"))
            found.append(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        return found[0].unionByName(found[1]).distinct()

    def _apart(self, pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs of different components, with these."""
        return labelled(labelled(pairs, "a", "in_a", groups), "b", "in_b", groups).filter("in_a <> in_b")

    def _across(self, active: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs that share a prefix n-gram, lie in different components and pass the length and the positional filter.

        For each n-gram, the component with the most texts is at home: every other text is paired with the
        texts at home, and with those of other components once.
        """
        t = self.percent
        rows = written(labelled(active.select("gram", "doc_id", "n", "place"), "doc_id", "group", groups))
        sizes = rows.groupBy("gram", "group").agg(F.count(F.lit(1)).alias("texts"))
        homes = sizes.groupBy("gram").agg(F.max(F.struct("texts", "group"))["group"].alias("home"), F.count(F.lit(1)).alias("groups"))
        homes = written(homes.filter("groups > 1").select("gram", "home"))
        mixed_rows = written(rows.join(homes, "gram"))
        x = mixed_rows.filter("group <> home").select("gram", *[F.col(c).alias(f"{c}_x") for c in ("doc_id", "n", "place", "group")])
        y = mixed_rows.select(F.col("gram").alias("gram_y"), *[F.col(c).alias(f"{c}_y") for c in ("doc_id", "n", "place", "group")], "home")
        once = (F.col("group_y") == F.col("home")) | (F.col("group_x") < F.col("group_y"))
        length = 100 * F.least("n_x", "n_y") >= t * F.greatest("n_x", "n_y")
        need = F.ceil((t * (F.col("n_x") + F.col("n_y"))) / F.lit(100.0 + t) - 1e-9)
        place = 1 + F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) >= need
        pairs = x.join(y, (F.col("gram") == F.col("gram_y")) & (F.col("group_x") != F.col("group_y")) & once & length & place)
        pairs = pairs.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b"))
        return written(pairs.distinct())


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    with scratch(docs.sparkSession) as keep:
        join = _Join(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), k, percent)
        groups = join.groups().select(F.col("node").alias("of"), "component")
        rows = join.features.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
        joined = rows.join(groups, F.col("doc_id") == F.col("of"), "left")
        return keep(joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


#: A column of row numbers, where ids don't tell the rows apart.
_NODE = "_node"


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest id; null ids come last.

    Where ids are null or repeated, rows are told apart by a number of their own (kept in a table), so rows of
    one id with unlike texts all stay, and of rows with one id and one text one does. Rows without words, null
    texts included, are near copies of nothing and stay.
    """
    with scratch(docs.sparkSession) as keep:
        ids = docs.select(F.col(id_col).cast("long").alias("id"))
        told_apart = ids.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty()
        rows, node = (docs, id_col) if told_apart else (keep(without(docs, _NODE).withColumn(_NODE, F.monotonically_increasing_id())), _NODE)
        groups = jaccard_components(rows, k, percent, text_col, node)
        if told_apart:
            gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
        else:
            linked = written(groups.groupBy("component_id").count().filter("count > 1").select(F.col("component_id").alias("of")))
            order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(_NODE).alias("node"))
            named = rows.select(F.col(_NODE).alias("at"), order.alias("place"))
            among = groups.join(linked, F.col("component_id") == F.col("of")).join(named, F.col("doc_id") == F.col("at"))
            firsts = written(among.groupBy("component_id").agg(F.min("place").alias("least")).select(F.col("least.node").alias("first")))
            gone = among.select(F.col("doc_id").alias("_gone")).join(firsts, F.col("_gone") == F.col("first"), "left_anti")
        gone = keep(gone)
    return rows.join(gone, F.col(node).cast("long") == F.col("_gone"), "left_anti").select(*[rows[c] for c in docs.columns])
