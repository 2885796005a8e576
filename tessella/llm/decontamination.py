"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Alignment: +1 for an equal word, -1 for a different one or a gap. ``LEAST`` of the item's own score makes a leak: 0.6
is an identity of 0.8 where words were replaced. Words are lower case, ASCII punctuation separates them.

Which seeds join. An alignment that reaches the score can spend (1 - LEAST) of the item's words on edits. One that
costs 1 destroys two 3-grams at most (a word put in), so an item of n 3-grams keeps all but ``broken`` of them.
Of any ``broken + NEED`` of its seeds at least NEED are left (NEED shrinks where the item has no more). So the item's
rarest ``broken + NEED`` seeds, by the number of documents that hold each, join it to the documents, and a pair
must share NEED of them: frequent seeds never join, and no pair that reaches the score is lost. Items too short
for that with 3-grams use 2-grams, an item of one word that word.

Data flow: a bitmap of fixed size (``BITMAP``), built from all items' seeds, goes out with one scan of the documents,
which writes every document's seeds and words near them. What else meets, meets in joins: seeds with their counts, items
with documents, and stretches with items. A seed in the bitmap by chance finds no item and is dropped by the join.

Defined results: null or wordless texts and items match nothing; repeated rows count as one document by id, and a
row without id is reported under a null id; repeated items count once, and different texts under one item id count as
one item, the better match; an empty table on either side gives no pairs; ties between stretches take the
higher score, then the earlier one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise, small_batches, table, tidy, utf8
from .pitman_yor import hashes

SEED = 3
LEAST = 0.6
#: Seeds that a document must share with an item's rarest, where the item has as many to spare.
NEED = 3
#: Bits of the seeds' bitmap, as a power of two: 8 MB.
BITMAP = 26
#: Groups that a document's items are dealt into, so that one that meets many items is no hot row.
SALTS = 32
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> np.ndarray:
    """64-bit numbers of a text's words."""
    return np.array(hashes(text.translate(_FOLD).split()) if text else [], dtype=np.uint64)


def seeds(own: np.ndarray, k: int) -> np.ndarray:
    """64-bit numbers of all k-grams of words."""
    n = max(0, len(own) - k + 1)
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ h >> np.uint64(29)) * _MIX + own[i : i + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def rule(m: int, least: float = LEAST) -> tuple[int, int, int, int]:
    """(k, spare, broken, need) of an item of m words: seed width, edits it can bear, seeds they destroy, seeds that must be shared."""
    spare = int((1 - least) * m + 1e-9)
    for k in range(min(SEED, m), 0, -1):
        broken = max(1, k - 1) * spare
        if m - k + 1 > broken:
            return k, spare, broken, min(NEED, m - k + 1 - broken)
    return 1, spare, m - 1, 1


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of an item to a stretch of ids; end exclusive."""
    n = len(text)
    ramp = np.arange(1, n + 1)
    h, begin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diag = h[:-1] + np.where(text == w, 1, -1)
        up = h[1:] - 1
        first = np.where(diag >= up, begin[:-1], begin[1:])
        new = np.maximum(np.maximum(diag, up), 0)
        first = np.where(new == 0, ramp, first)
        lifted = new + ramp
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, np.arange(n), 0))
        row = np.maximum(run - ramp, 0)
        first = np.where(row > new, first[source], first)
        h, begin = np.concatenate([[0], row]), np.concatenate([[0], first])
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(first[j]), j + 1)
    return best


def bound(item: np.ndarray, text: np.ndarray) -> int:
    """At least the score of any local alignment: an item's word that the text lacks costs 1 wherever it is passed."""
    gain = np.concatenate([[0], np.cumsum(np.where(np.isin(item, text), 1, -1))])
    return int((gain - np.minimum.accumulate(gain)).max())


def windows(diagonals: list[int], m: int, spare: int, n: int) -> list[tuple[int, int]]:
    """The stretches [lo, hi) of n words that alignments through matches on these diagonals can reach."""
    out: list[list[int]] = []
    for d in sorted(diagonals):
        lo, hi = max(0, d - spare), min(n, d + m + spare)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _rows(names: list[str], kinds: list, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _items(benchmark: DataFrame, least: float, item_col: str, item_text: str) -> DataFrame:
    """(item_id, item, m, words, seeds) of each different item that has words; ``item`` is a number of its own."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for item, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = words(text)
                if len(own):
                    for c, v in zip(out, (item, key, len(own), own.astype("<u4").tobytes(), seeds(own, rule(len(own), least)[0]).view(np.int64)), strict=True):
                        c.append(v)
            yield _rows(["item_id", "item", "m", "words", "seeds"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())], out)

    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), utf8(item_text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()
    return rows.select("i", F.xxhash64("i", "t"), "t").mapInArrow(tidy(run), "item_id long, item long, m int, words binary, seeds array<long>")


def _bitmap(items: DataFrame) -> np.ndarray:
    """The seeds' bitmap, added up on the executors: at most 2^BITMAP bits come to the driver."""
    slot = F.col("seed").bitwiseAND(F.lit((1 << BITMAP) - 1))
    bit = F.expr("shiftleft(1L, CAST(seed & 63 AS int))")
    found = items.select(F.explode("seeds").alias("seed")).groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), dtype=np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _hits(docs: DataFrame, bitmap: np.ndarray, widths: list[int], reach: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, lo, words, seeds, places) of every document that holds a seed; words are those within ``reach`` of one."""
    low, bits = np.uint64((1 << BITMAP) - 1), np.uint64(63)

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = words(text)
                found, at = [], []
                for k in widths:
                    s = seeds(own, k)
                    slot = s & low
                    p = np.flatnonzero(bitmap[slot >> np.uint64(6)] >> (slot & bits) & np.uint64(1))
                    found.append(s[p].view(np.int64))
                    at.append(p)
                places = np.concatenate(at).astype(np.int32)
                if len(places):
                    lo, hi = max(0, int(places.min()) - reach), int(places.max()) + reach
                    for c, v in zip(out, (row, doc, lo, own[lo:hi].astype("<u4").tobytes(), np.concatenate(found), places), strict=True):
                        c.append(v)
                    row += 1
            yield _rows(["row", "doc_id", "lo", "words", "seeds", "places"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())], out)

    schema = "row long, doc_id long, lo int, words binary, seeds array<long>, places array<int>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col)).mapInArrow(tidy(run), schema)


def _chosen(items: DataFrame, hits: DataFrame, least: float) -> DataFrame:
    """(item, q, seed, need): each item's rarest seeds, by the documents that hold them."""
    held = hits.select(F.explode(F.array_distinct("seeds")).alias("seed")).groupBy("seed").agg(F.count("*").alias("held"))
    at = items.select("item", "m", F.posexplode("seeds").alias("q", "seed")).join(held, "seed", "left")
    by = W.partitionBy("item").orderBy(F.coalesce("held", F.lit(0)), "seed", "q")
    sizes = [r.m for r in items.select("m").distinct().collect()]
    rules = items.sparkSession.createDataFrame([(m, broken + need, need) for m in sizes for _, _, broken, need in [rule(m, least)]], "m int, take int, need int")
    return at.withColumn("rank", F.row_number().over(by)).join(F.broadcast(rules), "m").filter("rank <= take AND held IS NOT NULL").select("item", "q", "seed", "need")


def _stretches(hits: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(doc_id, item, start, ids) of the stretches of documents that share enough rare seeds with an item."""
    chosen = _chosen(items, hits, least)
    met = hits.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("row", F.col("x.seeds").alias("seed"), F.col("x.places").alias("p")).join(chosen, "seed")
    pairs = met.groupBy("row", "item").agg(F.collect_set("q").alias("q"), F.collect_set(F.col("p") - F.col("q")).alias("diagonals"), F.first("need").alias("need")).filter(F.size("q") >= F.col("need"))
    pairs = pairs.join(items.select("item", "m"), "item")
    asked = pairs.groupBy("row", F.pmod(F.xxhash64("item"), F.lit(SALTS)).alias("salt")).agg(F.collect_list(F.struct("item", "m", "diagonals")).alias("asked"))

    def cut(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for doc, lo, own, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(own, "<u4")
                for a in asked:
                    spare = rule(a["m"], least)[1]
                    for i, j in windows([d - lo for d in a["diagonals"]], a["m"], spare, len(ids)):
                        for c, v in zip(out, (doc, a["item"], lo + i, ids[i:j].tobytes()), strict=True):
                            c.append(v)
            yield _rows(["doc_id", "item", "start", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()], out)

    return hits.select("row", "doc_id", "lo", "words").join(asked, "row").select("doc_id", "lo", "words", "asked").mapInArrow(tidy(cut), "doc_id long, item long, start long, ids binary")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start, end): each document's best alignment to each item it leaks; places count words."""
    spark = docs.sparkSession
    small_batches(spark)
    items = materialise(_items(benchmark, least, item_col, item_text), "items")
    sizes = [r.m for r in items.select("m").distinct().collect()]
    widths = sorted({rule(m, least)[0] for m in sizes})
    reach = max((m + rule(m, least)[1] for m in sizes), default=0)
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, start long, end long")
    hits = materialise(_hits(docs, _bitmap(items), widths, reach, id_col, text_col), "hits")

    def aligned(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, item, start, ids, own, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = np.frombuffer(own, "<u4"), np.frombuffer(ids, "<u4")
                k, _, broken, _ = rule(m, least)
                shared = np.isin(seeds(x.astype(np.uint64), k), seeds(y.astype(np.uint64), k))
                if shared.sum() < m - k + 1 - broken or bound(x, y) < least * m:
                    continue
                score, lo, hi = align(x, y)
                if score >= least * m:
                    for c, v in zip(out, (doc, item, score / m, start + lo, start + hi), strict=True):
                        c.append(v)
            yield _rows(["doc_id", "item_id", "score", "start", "end"], [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()], out)

    both = _stretches(hits, items, least).join(items.select("item", "item_id", "words", "m"), "item")
    found = both.select("doc_id", "item_id", "start", "ids", "words", "m").mapInArrow(tidy(aligned), "doc_id long, item_id long, score double, start long, end long")
    best = F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.start", "b.end")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
