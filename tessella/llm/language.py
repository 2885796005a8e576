"""Language identification by prediction by partial matching over bytes.

For each language a context tree of orders 0 to 3 is counted on a bounded sample of its documents and then
frozen. A byte seen after the longest context costs its count's share there; an unseen one costs an escape
(method C: the number of distinct followers over total plus distinct) and goes to the next shorter context,
down to a uniform byte. A text's code length in a language is the sum over all its bytes; the language with
the shortest code wins and its score is the posterior under equal priors. Texts are folded to lower case
(A-Z) and start after three spaces, so every byte has a full context.

The fit reads at most ``SAMPLE_DOCS`` documents and about ``SAMPLE_BYTES`` bytes per language, the first by a
hash of their id, each read whole; repeated rows of an id count toward the bounds and are learned once. Rows and
bytes per bucket of that hash are summed first, so that only the buckets which the sample reaches are put in
order. Prediction covers every byte of every text.

Defined results: a null text or one without a letter is ``und`` with score 0, so is every text when nothing
could be learned; equal code lengths take the language first in alphabetical order; a null id counts as not
held out; repeated rows are predicted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import small_batches, table, utf8

SAMPLE_DOCS, SAMPLE_BYTES = 2_000, 3_000_000
ORDER = 3
_PAD = b" " * ORDER
_ASCII = re.compile(rb"[A-Za-z]")
_DENSE = 1 << 22
_BUCKET_BITS = 12


def has_letter(text: bytes | None) -> bool:
    """Whether a UTF-8 text has a character of a Unicode letter category (L); numbers such as one half have none."""
    return bool(text) and (_ASCII.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace"))))


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """All n-grams of bytes as numbers, the last byte lowest."""
    out = np.zeros(max(0, len(data) - n + 1), dtype=np.uint32)
    for i in range(n):
        out = (out << np.uint32(8)) | data[i : len(data) - n + 1 + i]
    return out


class Tree:
    """One language's frozen context tree: log2 costs per seen (context, byte) and per escape."""

    def __init__(self, texts: list[bytes]):
        counts = []
        for n in range(1, ORDER + 2):
            parts = [grams(np.frombuffer(_PAD + t.lower(), dtype=np.uint8)[ORDER + 1 - n :], n) for t in texts if t]
            counts.append(np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
        keys, c = counts[0]
        zero = np.zeros(256)
        zero[keys] = c
        total, distinct = zero.sum(), (zero > 0).sum()
        p0 = np.where(zero > 0, zero, distinct / 256) / max(1, total + distinct) if total else np.full(256, 1 / 256)
        one = np.zeros((256, 256))
        one.reshape(-1)[counts[1][0]] = counts[1][1]
        total, distinct = one.sum(axis=1, keepdims=True), (one > 0).sum(axis=1, keepdims=True)
        shorter = np.where(total > 0, distinct / np.maximum(1, total + distinct), 1.0) * p0
        self.first = np.log2(np.where(one > 0, one / np.maximum(1, total + distinct), shorter)).reshape(-1)
        self.seen, self.escape = [], []
        for keys, c in counts[2:]:
            contexts, start = np.unique(keys >> np.uint32(8), return_index=True)
            total = np.add.reduceat(c, start) if len(c) else c
            distinct = np.diff(np.append(start, len(keys)))
            self.escape.append((contexts, np.log2(distinct / (total + distinct)) if len(c) else np.zeros(0)))
            self.seen.append((keys, np.log2(c / np.repeat(total + distinct, distinct)) if len(c) else np.zeros(0)))

    @staticmethod
    def _find(table, keys):
        known, cost = table
        if not len(known):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[at] == keys, cost[at]

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """log2 probability of each 4-gram's last byte after its first three."""
        out = self.first[keys & np.uint32(0xFFFF)]
        for n, seen, escape in ((3, self.seen[0], self.escape[0]), (4, self.seen[1], self.escape[1])):
            own = keys & np.uint32(2 ** (8 * n) - 1)
            here, price = self._find(seen, own)
            some, leave = self._find(escape, own >> np.uint32(8))
            out = np.where(here, price, out + np.where(some, leave, 0.0))
        return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse for 4-grams, without a sort where their byte pairs are few."""
    high, low = keys >> np.uint32(16), keys & np.uint32(0xFFFF)
    there = np.zeros(65536, dtype=bool)
    there[high] = True
    there[low] = True
    pairs = np.flatnonzero(there)
    n = len(pairs)
    if n * n > _DENSE:
        return np.unique(keys, return_inverse=True)
    number = np.zeros(65536, dtype=np.int64)
    number[pairs] = np.arange(n)
    at = number[high] * n + number[low]
    used = np.zeros(n * n, dtype=bool)
    used[at] = True
    found = np.flatnonzero(used)
    place = np.zeros(n * n, dtype=np.int32)
    place[found] = np.arange(len(found))
    return (pairs[found // n].astype(np.uint32) << np.uint32(16)) | pairs[found % n].astype(np.uint32), place[at]


class Classifier:
    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        self.trees = [Tree(texts[x]) for x in self.languages]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) log2 probabilities; no text may be empty."""
        data = np.frombuffer(b"".join(_PAD + t.lower() for t in texts), dtype=np.uint8)
        sizes = np.array([len(t) + ORDER for t in texts])
        ends = np.cumsum(sizes)
        keys = grams(data, ORDER + 1)
        known, place = _distinct(keys)
        skip = np.zeros(len(keys) + 1, dtype=bool)  # grams that reach over a text's start
        for d in range(1, ORDER + 1):
            skip[np.minimum(ends[:-1] - d, len(keys))] = True
        out = np.empty((len(texts), len(self.languages)))
        first = ends - sizes
        for j, tree in enumerate(self.trees):
            per = tree.cost(known)[place]
            per[skip[:-1]] = 0.0
            out[:, j] = np.add.reduceat(per, first)
        return out

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        ask = [k for k, t in enumerate(texts) if has_letter(t)]
        if ask and self.languages:
            bits = self.bits([texts[k] for k in ask])
            best = bits.argmax(axis=1)
            share = 1 / np.exp2(np.maximum(bits - bits.max(axis=1, keepdims=True), -1000)).sum(axis=1)
            for k, b, s in zip(ask, best, share, strict=True):
                out[k] = (self.languages[b], float(s))
        return out


def remainder(id_col: str, n: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def _first(groups: DataFrame, order: list[str]) -> DataFrame:
    """Of groups of ``c`` rows and ``s`` bytes, those that start within a language's bounds."""
    w = W.partitionBy("l").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = groups.withColumns({"rows_before": F.coalesce(F.sum("c").over(w), F.lit(0)), "bytes_before": F.coalesce(F.sum("s").over(w), F.lit(0))})
    return sums.filter((F.col("rows_before") < SAMPLE_DOCS) & (F.col("bytes_before") < SAMPLE_BYTES))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Classifier:
    """Learn from the rows of ``docs`` that have a language."""
    docs = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), utf8(text_col).alias("t"))
    rows = docs.select("i", "l", F.octet_length("t").cast("long").alias("n"), F.xxhash64("i").alias("h"))
    rows = rows.withColumn("b", F.shiftright("h", 64 - _BUCKET_BITS))
    # Rows and bytes per bucket of the hash tell which buckets the sample reaches: only their rows are ordered.
    reached = _first(rows.groupBy("l", "b").agg(F.count("*").alias("c"), F.sum("n").alias("s")), ["b"]).select("l", "b")
    few = rows.join(F.broadcast(reached), ["l", "b"], "left_semi").groupBy("l", "i", "n", "h").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    chosen = _first(few, ["h", "i", "n"]).select(F.col("i").alias("ci"), F.col("l").alias("cl"), F.col("n").alias("cn"))
    same = F.col("i").eqNullSafe(F.col("ci")) & (F.col("l") == F.col("cl")) & (F.octet_length("t") == F.col("cn"))
    found = docs.join(F.broadcast(chosen), same, "left_semi").groupBy("i", "l", F.octet_length("t").alias("n")).agg(F.min("t").alias("t"))
    texts: dict[str, list[bytes]] = {}
    for r in found.select("l", "t").toLocalIterator():
        texts.setdefault(r.l, []).append(bytes(r.t))
    return Classifier({k: sorted(v) for k, v in texts.items()})


def identify(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, held) for every row; held is the id's remainder by 4."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = model.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, 4) == 2).alias("held_out"), utf8(text_col))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.filter(remainder("doc_id", 4) != 2)))
