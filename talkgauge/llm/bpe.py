"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

The vocabulary is a list of byte strings with ranks. Each byte is mapped to one printable character, so
every token is a piece of text; a piece's score is its negative rank, so the best-scored merge of
sentencepiece is the lowest-ranked merge of the rank file. Normalisation is the identity. Texts are cut
into pre-tokens by the tokenizer's pattern, each pre-token is encoded for itself, and ids are decoded by
the inverse mapping. No tokenizer is trained and no vocabulary is copied: the rank file is a parameter.

Nulls are empty texts: no ids, no bytes. Very long texts and very long pre-tokens are encoded whole. Equal texts
give equal ids; repeated rows are encoded each. Ties between merges go to the leftmost. An empty table gives an
empty result. Columns of the table's own that an operator adds are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talkgauge.llm.common import mapped, without

#: A worker forgets pre-tokens beyond so many, or so many characters, all but the first half: those that came early are the frequent ones.
CACHE_SIZE, CACHE_CHARS = 300_000, 8 << 20
#: Bytes of ids in one outgoing batch.
BATCH_BYTES = 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def byte_alphabet() -> str:
    """256 characters: byte b is written as the b-th. Printable Latin-1 bytes stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field."""

    def varint(n: int) -> bytes:
        n &= (1 << 64) - 1
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> tuple[bytes, list[bytes]]:
    """A sentencepiece BPE model and, by piece id, the tokens' bytes. Piece 0 is the unknown piece.

    The unknown piece's name is outside the byte alphabet, so no text can spell it.
    """
    letters = byte_alphabet()
    order = sorted(ranks, key=ranks.get)
    unknown = "⁇".encode()
    pieces = [_field(1, unknown) + _field(2, 0.0) + _field(3, 2)]
    for token in order:
        mapped = token.decode("latin-1").translate(dict(enumerate(letters)))
        pieces.append(_field(1, mapped.encode()) + _field(2, float(-ranks[token])) + _field(3, 1))
    trainer = b"".join(
        (_field(3, 2), _field(4, len(pieces)), _field(40, 0), _field(41, -1), _field(42, -1), _field(43, -1), _field(45, unknown))
    )
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    model = b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)
    return model, [b"", *order]


class Codec:
    """Encodes texts to rank ids and decodes them."""

    def __init__(self, model: bytes, tokens: list[bytes], ranks: list[int], pattern: str):
        self.model, self.pattern, self.sp = model, pattern, None
        self.to_letters = dict(enumerate(byte_alphabet()))
        self.ranks = ranks
        self.whole = dict(zip(tokens[1:], ranks[1:], strict=True))
        self.bytes_of = dict(zip(ranks[1:], tokens[1:], strict=True))
        self.seen: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, pretokens: set[str]) -> None:
        rest = []
        for t in pretokens:
            raw = t.encode()
            if (rank := self.whole.get(raw)) is not None:  # a whole token is its own id
                self.seen[t] = struct.pack("<I", rank)
            else:
                rest.append((t, raw.decode("latin-1").translate(self.to_letters)))
        # Pre-tokens are encoded in one call. A line break is outside the byte alphabet: it is the unknown
        # piece (id 0), which no merge crosses.
        at, own = 0, []
        for i in [*self.sp.encode("\n".join(m for _, m in rest)), 0] if rest else ():
            if i:
                own.append(self.ranks[i])
            else:
                self.seen[rest[at][0]] = struct.pack(f"<{len(own)}I", *own)
                at, own = at + 1, []

    def encode(self, text: str | None) -> bytes:
        """The ids, four little-endian bytes each."""
        if not text:
            return b""
        if self.sp is None:
            import regex
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            self.split = regex.compile(self.pattern).findall
        cut = self.split(text)
        try:
            return b"".join(map(self.seen.__getitem__, cut))
        except KeyError:
            if len(self.seen) > CACHE_SIZE or self.held > CACHE_CHARS:
                self.seen = dict(itertools.islice(self.seen.items(), CACHE_SIZE // 2)) if self.held <= CACHE_CHARS else {}
                self.held = sum(map(len, self.seen))
            new = {t for t in cut if t not in self.seen}
            self.held += sum(map(len, new))
            self._learn(new)
            return b"".join(map(self.seen.__getitem__, cut))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def _codec(parts, key: str) -> Codec:
    """One codec a worker process and vocabulary, kept from task to task.

    This module travels by value, so its globals are a task's own; what a worker keeps hangs on a library that it imports.
    """
    import sentencepiece

    held = getattr(sentencepiece, "_kept_codec", None)
    if held is None or held[0] != key:
        sentencepiece._kept_codec = held = (key, Codec(*parts.value))
    return held[1]


def _shipped(df: DataFrame, ranks_path: str, pattern: str):
    """The codec's parts, read on the driver and broadcast: their size is the vocabulary's, a few MB."""
    ranks = read_ranks(ranks_path)
    model, tokens = serialise_model(ranks)
    return df.sparkSession.sparkContext.broadcast((model, tokens, [0, *(ranks[t] for t in tokens[1:])], pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the text's token ids as unsigned 32-bit little-endian integers."""
    parts, key = _shipped(docs, ranks_path, pattern), uuid.uuid4().hex
    docs = without(docs, ids_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.BinaryType())])
    at = docs.columns.index(text_col)

    def run(batches):
        codec = _codec(parts, key)
        for b in batches:
            start, size, ids = 0, 0, []
            for i, text in enumerate(b.column(at).to_pylist()):
                ids.append(codec.encode(text))
                size += len(ids[-1])
                if size >= BATCH_BYTES or i == b.num_rows - 1:
                    part = b.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*b.schema.names, ids_col])
                    start, size, ids = i + 1, 0, []

    return mapped(docs, run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_cols: list[str], ids_col: str = "ids") -> DataFrame:
    """``id_cols`` with n_tokens, ids_sha256 (of the decimal ids joined by a space), the decoded bytes and their sha256."""
    parts, key = _shipped(encoded, ranks_path, pattern), uuid.uuid4().hex
    kept = encoded.select(*id_cols, ids_col)
    schema = T.StructType(
        [
            *kept.schema.fields[:-1],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded", T.BinaryType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches):
        codec = _codec(parts, key)
        names = [f.name for f in schema.fields]
        for b in batches:
            start, size, rows = 0, 0, []
            for i, ids in enumerate(b.column(b.num_columns - 1).to_pylist()):
                ids = ids or b""
                raw = codec.decode(ids)
                said = " ".join(map(str, memoryview(ids).cast("I"))).encode()
                rows.append((len(ids) // 4, hashlib.sha256(said).hexdigest(), raw, hashlib.sha256(raw).hexdigest()))
                size += len(raw)
                if size >= BATCH_BYTES or i == b.num_rows - 1:
                    part = b.slice(start, i + 1 - start)
                    own = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *own], names=names)
                    start, size, rows = i + 1, 0, []

    return mapped(kept, run, schema)
