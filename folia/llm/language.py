"""Operator 3, language identification with string kernels.

A text is the set of its character n-grams for n = 1 to 3 over folded characters (lower case;
everything that isn't a letter is one boundary sign, runs of it count once), as a 0/1 vector: the
blended-spectrum presence kernel k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|). Characters fold to
64 classes by a fixed rule (a-z apart, other letters by code point), so a text's set is a bitmap of
fixed size and nothing about the alphabet is learned. Of a long text the regression values are the
mean over equal pieces of at most PIECE characters, all of them: sets of more would hold most n-grams
of any language.

Training: a bounded sample of labelled rows, TRAIN per language and SAMPLE in all (the lowest hashes of
doc_id; with many languages each has fewer, none is left out), of which LANDMARKS per language are
landmarks, fewer where their matrix would exceed MODEL_BYTES. Executors fold the whole texts; the
driver gets sets of n-gram codes only, each bounded by the number of codes. Nystroem features are
K(x, landmarks) times the inverse root of the landmarks' kernel; kernel ridge regression in them, one
language against the rest. Scoring multiplies presence rows by the landmark matrix, slab by slab, then
by the weights. The score is the winning regression value, clipped to 0 to 1; the margin is how much
greater it is than the next language's, as a share of it, which doesn't shrink with a text's length
as the score does. Ties go to the first language by name.

Edge cases: null text, or one without letters, is `und` with score and margin 0; null labels and
keys aren't learned from; without any labelled row all is `und`; with one language the margin is 1; of very long
texts every piece counts; an empty table gives an empty table; repeated rows are predicted each; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folia.llm.batches import in_python
from folia.llm.common import table

CLASSES = 64
CODES = CLASSES + CLASSES**2 + CLASSES**3
UNKNOWN = "und"
#: Bounds of the training sample: rows and landmarks per language, rows in all; of the landmark matrix.
TRAIN, LANDMARKS, SAMPLE, RIDGE = 300, 40, 6000, 1e-2
MODEL_BYTES = 64 << 20
#: Characters of a piece: longer ones have nearly all n-grams of any language in them.
PIECE = 8192


@cache
def fold_table() -> np.ndarray:
    """Class of each code point of the basic plane: 0 boundary, 1-26 a-z, 27-63 other letters."""
    out = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        if chr(i).isalpha():
            out[i] = i - 96 if 97 <= i <= 122 else 27 + i % 37
    return out


def folded(text: str) -> np.ndarray:
    """Classes of a text's characters, between boundaries, runs of boundaries once."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) and points.max() >= 1 << 16:
        astral = points >= 1 << 16
        kinds = fold_table()[np.where(astral, 0, points)]
        kinds[astral] = [27 + int(p) % 37 if chr(p).isalpha() else 0 for p in points[astral]]
    else:
        kinds = fold_table()[points]
    return kinds[np.concatenate(([True], (kinds[1:] != 0) | (kinds[:-1] != 0)))].astype(np.int32)


def codes(text: str | None) -> np.ndarray | None:
    """n-gram codes of a text, with repeats; None if it has no letter."""
    if not text:
        return None
    x = folded(text)
    if not x.any():
        return None
    two = x[:-1] * CLASSES + x[1:]
    three = two[:-1] * CLASSES + x[2:]
    return np.concatenate((x, two + CLASSES, three + CLASSES + CLASSES**2))


def pieces_of(text: str | None) -> list[str]:
    """A text in equal pieces of at most PIECE characters."""
    if not text:
        return []
    n = -(-len(text) // PIECE)
    return [text[i * len(text) // n : (i + 1) * len(text) // n] for i in range(n)]


class Presence:
    """Sets of codes, by one reused bitmap."""

    def __init__(self):
        self.seen = np.zeros(CODES, np.bool_)

    def distinct(self, c: np.ndarray) -> int:
        self.seen[c] = True
        n = int(np.count_nonzero(self.seen))
        self.seen[c] = False
        return n


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    place: np.ndarray  # of a code among those of the landmarks, from 1; 0 elsewhere
    landmarks: np.ndarray  # places x landmarks, 1 / sqrt(|G(landmark)|) where present
    weights: np.ndarray  # landmarks x languages

    def predict(self, texts: list[str | None], presence: Presence, slab: int = 256) -> tuple[list[str], np.ndarray, np.ndarray]:
        rows, norm = np.zeros((slab, len(self.landmarks)), np.float32), np.ones((slab, 1), np.float32)
        value, pieces = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        owner: list[int] = []

        def multiply() -> None:
            rows[:, 0] = 0
            here = ((rows[: len(owner)] @ self.landmarks) * norm[: len(owner)]).astype(np.float64) @ self.weights
            np.add.at(value, owner, here)
            np.add.at(pieces, owner, 1)
            rows[: len(owner)] = 0
            owner.clear()

        for i, t in enumerate(texts):
            for piece in pieces_of(t):
                if (c := codes(piece)) is not None:
                    rows[len(owner), self.place[c]] = 1
                    norm[len(owner)] = presence.distinct(c) ** -0.5
                    owner.append(i)
                    if len(owner) == slab:
                        multiply()
        if owner:
            multiply()
        known = pieces > 0
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        value /= np.maximum(pieces, 1)[:, None]
        at = np.arange(len(texts))
        best = value.argmax(1)
        top = value[at, best]
        value[at, best] = -np.inf
        margin = np.where(top > 0, 1 - np.maximum(value.max(1, initial=0), 0) / np.where(top > 0, top, 1), 0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.clip(top, 0, 1) * known, margin * known


def chosen(labelled: DataFrame, label: str, key: str, train: int, sample: int) -> DataFrame:
    """(label, key, _n): the rows with the lowest hashes of their key, up to `train` of each label and
    `sample` in all. A threshold from the labels' counts leaves few rows to rank."""
    ids = labelled.where(F.col(label).isNotNull()).select(F.col(label), F.col(key), F.xxhash64(F.col(key).cast("string")).alias("_h"))
    counts = ids.groupBy(label).agg(F.count("*").alias("_c"))
    each = max(1, min(train, sample // max(1, counts.count())))
    # Twice as many as needed, and some: that fewer pass than are needed has a chance below 1e-9.
    share = F.least(F.lit(1.0), (2.0 * each + 60) / F.col("_c"))
    near = ids.join(F.broadcast(counts.orderBy(F.desc("_c"), label).limit(sample)), label)
    near = near.where(F.shiftrightunsigned("_h", 11) / float(1 << 53) <= share)
    rank = F.row_number().over(W.partitionBy(label).orderBy("_h", key))
    return near.select(label, key, rank.alias("_n")).where(F.col("_n") <= each)


def solve(sets: list[np.ndarray], labels: list[str], marks: list[int], ridge: float) -> Model:
    """Landmarks are sets[marks]. Kernel rows are gathered set by set: no dense matrix of all rows."""
    names = sorted(set(labels))
    union = np.unique(np.concatenate([sets[i] for i in marks]))
    place = np.zeros(CODES, np.int32)
    place[union] = np.arange(1, len(union) + 1)
    matrix = np.zeros((len(union) + 1, len(marks)), np.float32)
    for j, i in enumerate(marks):
        matrix[place[sets[i]], j] = len(sets[i]) ** -0.5
    kernel = np.stack([matrix[place[s]].sum(0, dtype=np.float64) * len(s) ** -0.5 for s in sets])
    own = kernel[marks]
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # the inverse root of the landmarks' kernel
    z = kernel @ root
    y = np.array([[float(k == n) for n in names] for k in labels])
    w = np.linalg.solve(z.T @ z + ridge * len(sets) / len(names) * np.eye(z.shape[1]), z.T @ y)
    return Model(tuple(names), place, matrix, root @ w)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", train: int = TRAIN, marks: int = LANDMARKS, ridge: float = RIDGE, sample: int = SAMPLE) -> Model:
    """labelled: rows to learn from. Sampling is by hash of the key, ties by text."""
    picked = chosen(labelled, label, key, train, sample).select(F.col(key).alias("_key"), "_n").collect()
    order = {r["_key"]: r["_n"] for r in picked}  # SAMPLE keys at most
    rows = labelled.where(F.col(key).isin([k for k in order if k is not None]) & F.col(label).isNotNull()) if order else labelled.limit(0)
    schema = f"`{key}` {labelled.schema[key].dataType.simpleString()}, label string, codes array<int>"

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [None if (c := codes(t)) is None else np.unique(c) for t in b.column(2).to_pylist()]
            return pa.record_batch([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int32()))], [key, "label", "codes"])

        return work

    found = in_python(rows.select(key, F.col(label).cast("string").alias("label"), text), make, schema).where("codes IS NOT NULL").limit(4 * sample).collect()  # repeated keys have several rows
    if not found:
        return Model((), np.zeros(CODES, np.int32), np.zeros((1, 0), np.float32), np.zeros((0, 0)))
    found = sorted((r["label"], order[r[key]], r[key], r["codes"]) for r in found)
    labels, sets = [r[0] for r in found], [np.array(r[3], np.int32) for r in found]
    within = [i - labels.index(k) for i, k in enumerate(labels)]
    while True:  # the matrix is broadcast: its size is checked
        landmarks = [i for i, n in enumerate(within) if n < marks]
        if marks == 1 or len(landmarks) * 4 * len(np.unique(np.concatenate([sets[i] for i in landmarks]))) <= MODEL_BYTES:
            return solve(sets, labels, landmarks, ridge)
        marks //= 2


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without its text, with lang_pred, score and margin; text is the only input."""
    docs = docs.drop("lang_pred", "score", "margin")
    keep = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about MODEL_BYTES at most
    slab = max(1, min(256, MODEL_BYTES // (4 * len(model.landmarks))))

    def make():
        known, presence = shared.value, Presence()

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            names, scores, margins = known.predict(b.column(text).to_pylist(), presence, slab)
            return pa.record_batch([*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], [*keep, "lang_pred", "score", "margin"])

        return work

    return in_python(docs.select(*keep, text), make, f"{schema}, lang_pred string, score double, margin double", rows=slab)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("margin")
