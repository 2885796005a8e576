"""Quality by ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector over hashed features is shared by all grades and ordered thresholds t1 <= t2 <= ... cut its
score: P(grade > g) = sigmoid(w.x - t_g). Features of a text: each distinct word (lower case), and the share of
its words that have each shape, where a shape is the word with runs of letters and digits collapsed. The fit is
FTRL-proximal with L1, so words that say nothing keep weight zero, and it uses at most ``sample`` labelled rows,
the first by a hash of their id, each once (of different texts under one id the smallest); those texts are read
whole. Scoring covers every row.

Grades from the label table: 0 toxic, 1 not toxic but of low quality, 2 neither.

Defined results: a null or empty text has no features and gets the grade of the intercept; repeated rows
are scored each; rows without label are scored, labels without row are ignored, a null label is no label; with no usable label every
text gets the middle grade and is kept; an empty table gives an empty result; other columns are passed on, and where
one has the name of a column in OUT, the new one gets underscores before it (``named``).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHES, private, small_batches, table, tidy, utf8

DIM = 1 << 18
SHAPES = 1 << 12
#: Labelled rows that the fit may use at most.
SAMPLE = 6_000
GRADES = 3
OUT = ("expected_grade", "p_top", "keep")
_LETTERS, _DIGITS = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+")
_UPPER = re.compile(rb"[A-Z]{2,}")

#: Words whose features a worker keeps.
CACHE = 100_000
_slots: dict[bytes, tuple[int, int]] = {}
CACHES.append(_slots)


def _slot(word: bytes) -> tuple[int, int]:
    """(word feature, shape feature) of one word."""
    low = word.lower()
    shape = _DIGITS.sub(b"0", _LETTERS.sub(b"a", _UPPER.sub(b"A", word).replace(b"A", b"\x01").lower()))
    return zlib.crc32(low.strip(b".,;:!?\"'()[]")) % DIM, DIM + zlib.crc32(shape) % SHAPES


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    if len(_slots) > CACHE:
        _slots.clear()
    try:
        pairs = list(map(_slots.__getitem__, words))
    except KeyError:
        for w in set(words):
            if w not in _slots:
                _slots[w] = _slot(w)
        pairs = list(map(_slots.__getitem__, words))
    both = np.array(pairs, dtype=np.int64)
    own = np.unique(both[:, 0])
    shape, count = np.unique(both[:, 1], return_counts=True)
    return np.concatenate([own, shape]), np.concatenate([np.ones(len(own)), 4 * count / len(words)])


class CumulativeLink:
    """Shared sparse weights and ordered thresholds, fitted by FTRL-proximal."""

    def __init__(self, grades: int = GRADES, dim: int = DIM + SHAPES, alpha: float = 0.3, l1: float = 6.0, l2: float = 1.0):
        self.w, self.z, self.n = np.zeros(dim), np.zeros(dim), np.zeros(dim)
        self.t = np.arange(grades - 1) - (grades - 1) / 2 + 0.5
        self.alpha, self.l1, self.l2 = alpha, l1, l2

    def tails(self, score) -> np.ndarray:
        """P(grade > g) for each threshold g."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(score)[..., None] - self.t, -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3, seed: int = 1) -> CumulativeLink:
        grades = np.array([g for _, _, g in rows])
        for g in range(len(self.t)):
            p = np.clip((grades > g).mean(), 1e-3, 1 - 1e-3)
            self.t[g] = -np.log(p / (1 - p))
        rng = np.random.default_rng(seed)
        step = 0.02
        for _ in range(epochs):
            for r in rng.permutation(len(rows)):
                i, x, g = rows[r]
                if not len(i):
                    continue
                z, n = self.z[i], self.n[i]
                w = np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((1 + np.sqrt(n)) / self.alpha + self.l2))
                # -log P(g) with P(g) = P(> g - 1) - P(> g): its slope in the score is the two tails' sum less one
                up = self.tails(w @ x)
                above, below = (up[g] if g < len(up) else 0.0), (up[g - 1] if g else 1.0)
                slope = above - (1 - below)
                grad = slope * x
                sigma = (np.sqrt(n + grad * grad) - np.sqrt(n)) / self.alpha
                self.z[i] = z + grad - sigma * w
                self.n[i] = n + grad * grad
                self.w[i] = w
                p, rate = max(below - above, 1e-3), step
                if g:
                    self.t[g - 1] -= rate * below * (1 - below) / p
                if g < len(self.t):
                    self.t[g] += rate * above * (1 - above) / p
                self.t.sort()
            step *= 0.5
        z, n = self.z, self.n
        self.w = np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((1 + np.sqrt(n)) / self.alpha + self.l2))
        return self


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the label table: 0 toxic, 1 low quality, 2 good; one row per id, the worst grade."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, grades: int = GRADES, id_col: str = "doc_id", text_col: str = "text") -> CumulativeLink:
    """Fit on at most ``sample`` labelled rows; texts become features on the executors."""
    small_batches(docs.sparkSession)
    order = ratings.select(F.col("doc_id"), "grade").filter("grade IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).join(F.broadcast(order), "doc_id")
    named = named.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))

    def run(batches):
        for b in batches:
            got = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.astype("<i4").tobytes() for g, _ in got], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in got], pa.binary()), b.column(2)], names=["doc_id", "i", "x", "grade"])

    drawn = named.select("doc_id", "text", F.col("grade").cast("int")).mapInArrow(tidy(run), "doc_id long, i binary, x binary, grade int").collect()
    drawn.sort(key=lambda r: r.doc_id)
    rows = [(np.frombuffer(r.i, "<i4").astype(np.int64), np.frombuffer(r.x, "<f4").astype(float), r.grade) for r in drawn]
    model = CumulativeLink(grades)
    return model.fit(rows) if rows else model


def named(docs: DataFrame) -> tuple[str, str, str]:
    """The names under which ``scored`` adds its columns to ``docs``."""
    return tuple(private(docs, c) for c in OUT)


def scored(docs: DataFrame, model: CumulativeLink, text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """``docs`` with three more columns: expected grade, the highest grade's tail probability, and whether to keep.

    The model's non-zero weights go out with the task: at most as many as there are feature slots.
    """
    small_batches(docs.sparkSession)
    grade, top, keep = named(docs)
    at = np.flatnonzero(model.w)
    weights, t, dim = model.w[at].astype(np.float32), model.t, len(model.w)

    def run(batches):
        w = np.zeros(dim)
        w[at] = weights
        frozen = CumulativeLink(len(t) + 1, 1)
        frozen.t = t
        for b in batches:
            scores = []
            for text in b.column(b.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist():
                i, x = features(text)
                scores.append(float(w[i] @ x))
            up = frozen.tails(np.array(scores))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(up.sum(axis=1)), pa.array(up[:, -1])], names=[*b.schema.names, grade, top])

    schema = T.StructType([*docs.schema.fields, T.StructField(grade, T.DoubleType()), T.StructField(top, T.DoubleType())])
    return docs.mapInArrow(tidy(run), schema).withColumn(keep, F.col(top) >= keep_at)


def kept(docs: DataFrame, model: CumulativeLink, text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose chance of the best grade is at least ``keep_at``."""
    return scored(docs, model, text_col, keep_at).filter(F.col(named(docs)[2])).select(*docs.columns)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs, ratings = table(spark, sf_dir, "documents"), graded(table(spark, sf_dir, "labels"))
    model = fit(docs, ratings)
    return scored(docs.select("doc_id", "text"), model).select("doc_id", *OUT)
