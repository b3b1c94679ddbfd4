"""Binary training rows: token ids packed into fixed rows by best-fit decreasing.

A document is its token ids and an end mark. A document longer than a row is split
losslessly: every piece carries its document, its number and whether it is the last. Pieces are packed
best-fit decreasing: longest first, each into the row with the least room that still holds it, found
by descending a segment tree over the possible capacities. A row's binary column holds its ids as little-endian
integers (16 bits if the vocabulary allows, else 32), beside the cumulative segment lengths (for attention that
stays in a segment) and the columns at which positions start again at zero.

Documents are dealt to windows of at most about ``window_ids`` ids by a hash of their id and tokens, and come to a window in
the order of both: rows depend on the documents alone, not on how they are stored or partitioned. A window is packed by itself,
so memory is bounded, a lost task is repeated alone, and at most one part-filled row a size class is left per
window. Windows end early at twice their size, so rows that repeat one document very often make several. The one exchange
moves the ids, in 16 bits where the vocabulary allows.

Null and empty documents become a single end mark; null ids are kept. Repeated rows are packed each for itself. Ties
between pieces of one length go to the first, and between rows with one capacity to the latest opened. Empty tables
give no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm.common import mapped, without

ROW = 2048
WINDOW_IDS = 1 << 20


class Capacities:
    """A segment tree over capacities 0..row: how many open rows have each, and the least one that suffices."""

    def __init__(self, row: int):
        self.leaves = 1 << row.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, need: int) -> int | None:
        """The least capacity >= need that an open row has: climb to the first right sibling in use, then descend left."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit(lengths: np.ndarray, row: int) -> tuple[np.ndarray, int]:
    """For each piece the number of its row, and how many rows there are. No length exceeds ``row``."""
    tree, open_rows, out, rows = Capacities(row), [[] for _ in range(row + 1)], np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if need == row:
            out[i], rows = rows, rows + 1
            continue
        if (room := tree.least(need)) is None:
            room, own, rows = row, rows, rows + 1
        else:
            own = open_rows[room].pop()
            tree.add(room, -1)
        out[i] = own
        if room > need:
            open_rows[room - need].append(own)
            tree.add(room - need, 1)
    return out, rows


def pack_window(ids: list[np.ndarray], docs: list, row: int, pad: int, kind: np.dtype):
    """Packed rows of one window: (ids, cu_seqlens, resets, doc_ids, pieces, last) each."""
    piece_doc, piece_no, spans = [], [], []
    for d, x in enumerate(ids):
        for k, at in enumerate(range(0, len(x), row)):
            piece_doc.append(d)
            piece_no.append(k)
            spans.append((at, min(at + row, len(x))))
    lengths = np.array([b - a for a, b in spans], np.int64)
    where, n = best_fit(lengths, row)
    order = np.argsort(where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(n + 1))
    for r in range(n):
        own = order[bounds[r] : bounds[r + 1]].tolist()
        line = np.full(row, pad, kind)
        ends, at = [0], 0
        for i in own:
            a, b = spans[i]
            line[at : at + b - a] = ids[piece_doc[i]][a:b]
            at += b - a
            ends.append(at)
        yield line.tobytes(), ends, ends[:-1], [docs[piece_doc[i]] for i in own], [piece_no[i] for i in own], [spans[i][1] == len(ids[piece_doc[i]]) for i in own]


def id_type(vocabulary: int) -> np.dtype:
    """The integers of packed rows: they hold the vocabulary, its end mark and its padding."""
    return np.dtype("<u2" if vocabulary + 2 <= 1 << 16 else "<u4")


def tokenise(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` instead of its text: token ids of type ``id_type``, by the tiktoken library; null texts have none."""
    parts, key, kind = docs.sparkSession.sparkContext.broadcast(ranks), uuid.uuid4().hex, id_type(len(ranks))
    docs = without(docs, ids_col)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    at, schema = docs.columns.index(text_col), T.StructType([*rest, T.StructField(ids_col, T.BinaryType())])

    def run(batches):
        import tiktoken

        # This module travels by value: what a worker keeps hangs on a library that it imports.
        held = getattr(tiktoken, "_kept_encoding", None)
        if held is None or held[0] != key:
            tiktoken._kept_encoding = held = (key, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parts.value, special_tokens={}))
        encode = held[1].encode_ordinary
        for b in batches:
            ids = [None if t is None else np.array(encode(t), kind).tobytes() for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at], pa.array(ids, pa.binary())], names=[f.name for f in schema.fields])

    return mapped(docs, run, schema)


def pack(tokens: DataFrame, vocabulary: int, row: int = ROW, window_ids: int = WINDOW_IDS, most_ids: int | None = None, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """One line a packed row: ids (binary), n_ids, cu_seqlens, resets, doc_ids, pieces, last.

    ``ids_col`` holds a document's ids below ``vocabulary`` as little-endian integers of ``id_type``; ``vocabulary`` itself ends a
    document, and the number after it pads. ``most_ids`` is a bound of all ids together, end marks included, by which windows are numbered;
    without it the ids are counted first, which reads ``tokens`` once more.
    """
    names = ["ids", "n_ids", "cu_seqlens", "resets", "doc_ids", "pieces", "last"]
    kinds = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
    kind, end, pad = id_type(vocabulary), vocabulary, vocabulary + 1

    def lines(ids, owners):
        rows = []
        for made in pack_window(ids, owners, row, pad, kind):
            rows.append((made[0], made[1][-1], *made[1:]))
            if len(rows) == 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        ids, owners, size, current = [], [], 0, None
        for b in batches:
            for window, doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if window != current or size >= 2 * window_ids:
                    if ids:
                        yield from lines(ids, owners)
                    ids, owners, size, current = [], [], 0, window
                own = np.frombuffer(raw.as_buffer() if raw.is_valid else b"", kind)
                if len(own) and int(own.max()) >= vocabulary:
                    raise ValueError(f"an id of document {doc} is not in a vocabulary of {vocabulary}")
                x = np.full(len(own) + 1, end, kind)
                x[:-1] = own
                ids.append(x)
                owners.append(doc)
                size += len(x)
        if ids:
            yield from lines(ids, owners)

    if most_ids is None:
        most_ids = int(tokens.agg(F.sum(F.coalesce(F.octet_length(ids_col), F.lit(0)) / kind.itemsize + 1)).first()[0] or 0)
    windows = max(1, -(-most_ids // window_ids))
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(ids_col))
    dealt = tokens.select(F.pmod(key, F.lit(windows)).alias("window"), F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"), key.alias("key"))
    dealt = dealt.repartition("window").sortWithinPartitions("window", "doc_id", "key").drop("key")
    return mapped(dealt, run, "ids binary, n_ids int, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, pieces array<int>, last array<boolean>")


def unpack(packed_rows: list, vocabulary: int) -> dict:
    """Doc id to token ids, from collected packed rows: the inverse of ``pack`` for ids that are not repeated."""
    parts: dict = {}
    for r in packed_rows:
        line = np.frombuffer(r["ids"], id_type(vocabulary))
        for k, (doc, piece) in enumerate(zip(r["doc_ids"], r["pieces"], strict=True)):
            parts.setdefault(doc, {})[piece] = line[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]]
    return {d: np.concatenate([p[k] for k in sorted(p)])[:-1] for d, p in parts.items()}


def fill(packed: DataFrame, row: int = ROW) -> float:
    """The share of the rows' places that hold ids; 1 without rows."""
    held, rows = packed.agg(F.sum("n_ids"), F.count(F.lit(1))).first()
    return held / (rows * row) if rows else 1.0
