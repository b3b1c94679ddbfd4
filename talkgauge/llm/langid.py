"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone. An n-gram's vector binds
(multiplies) its letters' vectors, each rotated by its place; a text's vector bundles (adds) those of its
n-grams; a language's prototype bundles those of its training texts, each scaled to the same length, so that one
very long text doesn't outweigh the others. A text belongs to the language whose
prototype has the greatest cosine with it. Only letters count: texts are lower-cased, and every run of
anything else is one blank, with a blank before the first word and after the last.

A score says little by itself: short texts have few n-grams, so their cosines are low. What a language can
be expected to reach is measured (``expected``): the exact median score of all training texts, by the binary logarithm of
their letters. A text is in no learned language (``rejects``) if its score is below a share of that, or
within the noise of random vectors.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the first language in code
point order. Empty training data teaches nothing: every text is then ``und``. Rows that repeat a document count
and are judged each. Very long texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm.common import mapped, scratch, without, written

DIM = 1024
NGRAM = 3
SEED = 20_817
UNDETERMINED = "und"
#: Texts whose n-grams are looked at together, in characters (one longer text is taken alone).
BLOCK_CHARS = 200_000
#: n-grams whose vectors are bound and bundled together.
BLOCK_GRAMS = 2048
#: Scaled text vectors are added as whole numbers of this fraction of their length: sums are the same in any order.
FIXED_POINT = 1 << 20
#: Cells into which ``medians_of`` cuts the range that holds a median.
CELLS = 1024
#: Share of the expected score that a text must reach; and standard deviations of a random cosine.
LEAST_SHARE, NOISE = 0.25, 2.5


class Letters:
    """Random letter vectors and the n-grams they bind."""

    def __init__(self, dim: int, n: int):
        self.dim, self.n = dim, n
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((0, dim), np.int8)

    def _rows(self, points: np.ndarray) -> np.ndarray:
        new = [int(p) for p in points if int(p) not in self.row]
        if new:
            drawn = [np.random.default_rng((SEED, p)).integers(0, 2, self.dim, np.int8) * 2 - 1 for p in new]
            self.vectors = np.concatenate([self.vectors, np.array(drawn, np.int8)])
            for p in new:
                self.row[p] = len(self.row)
        return np.array([self.row[int(p)] for p in points], np.int64)

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of n-grams, each coded as 21 bits a letter."""
        out = np.ones((len(grams), self.dim), np.int8)
        for place in range(self.n):
            points, inverse = np.unique(grams >> np.uint64(21 * (self.n - 1 - place)) & np.uint64(0x1FFFFF), return_inverse=True)
            rows = self._rows(points)
            out *= np.roll(self.vectors[rows], self.n - 1 - place, axis=1)[inverse]
        return out

    def bundle(self, owner: np.ndarray, gram: np.ndarray, times: np.ndarray, grams: np.ndarray, rows: int) -> np.ndarray:
        """For each of ``rows`` rows, the sum of its n-grams' vectors: (owner, gram, times) by gram, gram a place in ``grams``.

        Counts are spread out for BLOCK_GRAMS n-grams at a time, so memory does not grow with their number.
        """
        out = np.zeros((rows, self.dim), np.float32)
        for lo in range(0, len(grams), BLOCK_GRAMS):
            own = slice(*np.searchsorted(gram, (lo, lo + BLOCK_GRAMS)))
            width = min(BLOCK_GRAMS, len(grams) - lo)
            counts = np.zeros((rows, width), np.float32)
            counts[owner[own], gram[own] - lo] = times[own]
            out += counts @ self.bind(grams[lo : lo + width]).astype(np.float32)
        return out


def counted(code: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, gram, times) of the n-grams of every row, by gram, and the distinct n-grams that gram numbers."""
    grams, inverse = np.unique(code, return_inverse=True)
    pairs, times = np.unique(inverse * rows + owner, return_counts=True)
    return pairs % rows, pairs // rows, times, grams


def is_letter(points: np.ndarray, known: dict[int, bool]) -> np.ndarray:
    kinds, inverse = np.unique(points, return_inverse=True)
    return np.array([known.setdefault(int(p), chr(int(p)).isalpha()) for p in kinds], bool)[inverse]


def grams_of(texts: list[str], n: int, known: dict[int, bool]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of the texts together, and for each the number of its text. Texts without a letter have none."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in lowered])
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(letter_table(known, points))
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # A blank stands before a letter that begins a word, and after the last letter of a text.
    own = owner[at]
    begins = np.ones(len(at), bool)
    begins[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
    lasts = np.ones(len(at), bool)
    lasts[:-1] = own[1:] != own[:-1]
    place = np.arange(len(at)) + np.cumsum(begins) + np.concatenate([[0], np.cumsum(lasts)[:-1]])
    total = int(place[-1]) + 2
    line, line_owner = np.full(total, 32, np.uint64), np.empty(total, np.int64)
    line[place] = points[at]
    line_owner[place] = own
    line_owner[place[begins] - 1] = own[begins]
    line_owner[place[lasts] + 1] = own[lasts]
    code = np.zeros(total - n + 1, np.uint64)
    for i in range(n):
        code = code << np.uint64(21) | line[i : total - n + 1 + i]
    same = line_owner[: total - n + 1] == line_owner[n - 1 :]
    return code[same], line_owner[: total - n + 1][same]


def letter_table(known: dict[int, bool], points: np.ndarray) -> np.ndarray:
    """As is_letter, by a table over the low code points, which nearly all texts stay in."""
    if -1 not in known:
        known[-1] = np.array([chr(p).isalpha() for p in range(0x3000)], bool)
    low = points < 0x3000
    out = np.zeros(len(points), bool)
    out[low] = known[-1][points[low]]
    if not low.all():
        rest = {k: v for k, v in known.items() if k >= 0}
        out[~low] = is_letter(points[~low], rest)
        known.update(rest)
    return out


def blocks(texts: list, limit: int = BLOCK_CHARS):
    """(start, end) of runs of at most 256 texts with at most ``limit`` characters, or one longer text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and (size + n > limit or i - start == 256):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, n: int = NGRAM) -> dict[str, np.ndarray]:
    """Prototypes by language from all rows with text and language. The result has ``dim`` numbers a language."""

    def run(batches):
        letters, known = Letters(dim, n), {}
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in blocks(texts):
                code, owner = grams_of(texts[lo:hi], n, known)
                if not len(code):
                    continue
                vectors = letters.bundle(*counted(code, owner, hi - lo), hi - lo)
                vectors *= FIXED_POINT / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                names, which = np.unique(np.array(langs[lo:hi], object).astype(str), return_inverse=True)
                for k, name in enumerate(names.tolist()):
                    sums[name] = sums.get(name, 0) + np.rint(vectors[which == k]).astype(np.int64).sum(0)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], names=["name", "k", "v"])

    rows = mapped(labelled.select(text_col, lang_col).dropna(), run, "name string, k int, v long")
    out: dict[str, np.ndarray] = {}
    for name, k, v in rows.groupBy("name", "k").agg(F.sum("v").alias("v")).collect():
        out.setdefault(name, np.zeros(dim))[k] = v
    return {k: v / max(np.linalg.norm(v), 1e-9) for k, v in sorted(out.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dim: int = DIM, n: int = NGRAM) -> DataFrame:
    """``docs`` with lang_pred and score, the cosine (0 to 1) with the best prototype."""
    docs = without(docs, "lang_pred", "score")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = list(prototypes)
    proto = np.array([prototypes[k] for k in names], np.float64).reshape(len(names), dim)

    def run(batches):
        letters, known = Letters(dim, n), {}
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            pred, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            for lo, hi in blocks(texts) if names else ():
                code, owner = grams_of(texts[lo:hi], n, known)
                if not len(code):
                    continue
                vectors = letters.bundle(*counted(code, owner, hi - lo), hi - lo).astype(np.float64)
                size = np.linalg.norm(vectors, axis=1)
                cosine = (vectors @ proto.T) / np.maximum(size, 1e-9)[:, None]
                has = np.bincount(owner, minlength=hi - lo) > 0
                best = cosine.argmax(1)
                pred[lo:hi] = np.where(has, np.array(names, object)[best], UNDETERMINED)
                score[lo:hi] = np.where(has, np.clip(cosine[np.arange(hi - lo), best], 0, 1), 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred.tolist(), pa.string()), pa.array(score)], names=[f.name for f in schema.fields])

    return mapped(docs, run, schema)


def _length_class(text: Column) -> Column:
    """The binary logarithm of a text's letters, rounded down; -1 without letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.when(letters > 0, F.floor(F.log2(letters))).otherwise(-1).cast("int")


def expected(labelled: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dim: int = DIM, n: int = NGRAM) -> dict[int, float]:
    """The median score of training texts by length class (there are at most 32), from all of them."""
    texts = labelled.select(F.col(text_col).alias("text")).filter("text IS NOT NULL")
    judged = identify(texts, prototypes, "text", dim, n).select(_length_class(F.col("text")).alias("class"), "score")
    with scratch(labelled.sparkSession):
        return medians_of(written(judged.filter("class >= 0")))


def medians_of(scores: DataFrame, cells: int = CELLS) -> dict[int, float]:
    """The exact median score (of two, the lower) by class: columns class and score.

    The range of scores that holds a class's median is cut into ``cells`` equal cells, and the cell that holds it is the next
    range, until it is one score. So the driver gets at most ``cells`` counts a class at once, however many rows there are.
    """
    sums = (F.min("score").alias("low"), F.max("score").alias("high"), F.count("score").alias("n"))
    found = {r["class"]: (r.low, r.high, (r.n + 1) // 2) for r in scores.groupBy("class").agg(*sums).collect()}
    while wide := {c: f for c, f in found.items() if f[0] < f[1]}:
        low, high = (F.element_at(F.create_map(*[F.lit(x) for c, f in wide.items() for x in (c, f[i])]), F.col("class")) for i in (0, 1))
        inside = scores.filter(F.col("class").isin(*wide)).filter(F.col("score").between(low, high))
        cell = F.least(F.floor((F.col("score") - low) / (high - low) * cells), F.lit(cells - 1)).alias("cell")
        left = {c: rank for c, (_, _, rank) in wide.items()}
        for r in sorted(inside.groupBy("class", cell).agg(*sums).collect()):
            if 0 < left[r["class"]] <= r.n:
                found[r["class"]] = (r.low, r.high, left[r["class"]])
            left[r["class"]] -= r.n
    return {c: low for c, (low, _, _) in found.items()}


def rejects(text: Column, lang_pred: Column, score: Column, medians: dict[int, float], share: float = LEAST_SHARE, noise: float = NOISE, dim: int = DIM) -> Column:
    """Whether a judged text is in no learned language. A length class that no training text had is held to the noise alone."""
    least = noise / dim**0.5
    listed = [F.lit(x) for c, m in sorted(medians.items()) for x in (c, max(least, share * m))]
    bound = F.coalesce(F.element_at(F.create_map(*listed), _length_class(text)), F.lit(least)) if listed else F.lit(least)
    return (lang_pred == UNDETERMINED) | (score < bound)


def train_split(doc_id: str = "doc_id", folds: int = 5):
    """True for the held-out fold: crc32 of the id as text, modulo ``folds``, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))
