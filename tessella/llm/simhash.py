"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has bit b set if more than half of its 3-word shingles' XXH64 values have it.
Two fingerprints link at ``max_bits`` or fewer differing bits. The distinct fingerprints form a binary trie:
its top is cut where a subtree holds few enough of them, pairs of subtrees whose paths differ in too many
bits are dropped, and each remaining pair is one unit of work that walks both subtrees together. A unit
returns a spanning forest of its links, never the links themselves, so its output is linear in its input.
The forests meet in a distributed large-star/small-star connected-components loop.

``similar_dropped`` joins texts alike by ``LEAST`` (Jaccard similarity of five-word shingles), where 64 bits and a few errors are
too few, and loses no link. Shingles have one order for all sets, frequent ones last (a bounded sample says which these are; any
order gives the same links). Sets that are similar share the first ``COMMON`` of their common shingles within a prefix of each,
so sets meet in the buckets of their prefixes' shingles. In buckets of at most ``SMALL`` sets all pairs meet, and those that
share ``COMMON`` of them or fewer for short sets are candidates. In larger ones every set first meets one of them; what these links
do not join is compared in blocks, each set first with its nearest outside its component, then all that are still in different
components. Candidates must be within what the parities of their shingles' hash classes allow, a lower bound of the shingles in
which two sets differ, and are compared set by set at last.

Defined results: a null or wordless text has fingerprint zero; fewer than three words make one shingle;
equal fingerprints share a component; rows are never dropped, not even repeated ones; a null doc_id keeps
its row and its component is the smallest doc_id that is not null (null if there is none); an empty table
gives an empty result; columns besides the id and the text are ignored. Of similar texts the smallest id stays, rows
without id last, and one of its repeated rows; null and wordless texts are alike; fewer than five words make one shingle.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, parallelism, private, small_batches, table, tidy, utf8
from .pitman_yor import hashes

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Most fingerprints in a subtree of the cut, and fewest that are worth a cut.
SUBTREE_MOST, SUBTREE_LEAST = 1 << 18, 1 << 11
_STEP = 1 << 16
#: Salts that a star's rows are dealt by, so that a hot centre is no hot task.
SALTS = 8

#: Similar texts: words of a shingle, least Jaccard similarity.
WIDTH, LEAST = 5, 0.8
#: Shingles that two sets share in their prefixes, the largest bucket of which all pairs are taken at once, sets of a block of a larger one.
COMMON, SMALL, BLOCK = 5, 64, 1024
#: Documents whose shingles tell the frequent ones, and how many of those are told.
ORDER_DOCS, ORDER_MOST = 8000, 1 << 16
#: Most bits of a set's parities.
PARITY_BITS = 1 << 16
#: A join by chance, which the pipeline does not use: fingerprints of a set, chance to meet at LEAST, keys of a set.
CODE, RECALL = 8, 0.99
TABLES, TABLE_BITS = 2 * CODE, 4
#: Bits of a leaf's path beyond the logarithm of the number of texts.
SPARE = 6
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Errors that are allowed in a key's leading bits: (number of bits, errors), rising in both.
Steps = list[tuple[int, int]]


def fingerprint(text: bytes | None) -> int:
    """The SimHash of one UTF-8 text, as an unsigned 64-bit number."""
    words = text.lower().split() if text else []
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    if n < 2:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _STEP):
        part = hashes[i : i + _STEP]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): each row's fingerprint as a signed 64-bit number."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col)).mapInArrow(run, "doc_id long, fp long")


def _allowed(steps: Steps) -> list[int]:
    """The errors allowed in the first d bits, for d from 0 to 64."""
    return [next(e for n, e in steps if n >= d) for d in range(65)]


def linked_pairs(a: np.ndarray, b: np.ndarray, same: bool, steps: Steps, leaf: int = 64, chunk: int = 1 << 13):
    """Walk the tries of two sorted arrays of distinct fingerprints together; yields arrays (i, j) of links.

    A node is a range of its array. The walk goes down one bit at a time, counts the bits in which the two
    paths differ and leaves a pair of nodes when the count exceeds its budget. ``same``: a is b, each link once.
    """
    if not len(a) or not len(b):
        return
    allowed = _allowed(steps)
    first = tuple(np.array([x], dtype=np.int64) for x in (0, len(a), 0, len(b), 0))
    stack = [(63, first)]
    while stack:
        bit, node = stack.pop()
        if len(node[0]) > chunk:
            stack += [(bit, tuple(x[i : i + chunk] for x in node)) for i in range(0, len(node[0]), chunk)]
            continue
        alo, ahi, blo, bhi, differ = node
        small = ((ahi - alo) * (bhi - blo) <= leaf) if bit >= 0 else np.ones(len(alo), dtype=bool)
        if small.any():
            nb = (bhi - blo)[small]
            size = (ahi - alo)[small] * nb
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            nb = np.repeat(nb, size)
            i, j = np.repeat(alo[small], size) + within // nb, np.repeat(blo[small], size) + within % nb
            x = a[i] ^ b[j]
            near = np.bitwise_count(x) <= steps[-1][1]
            for n, errors in steps[:-1]:
                near &= np.bitwise_count(x >> np.uint64(64 - n)) <= errors
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        alo, ahi, blo, bhi, differ = (x[~small] for x in node)
        if not len(alo):
            continue
        one = np.uint64(1) << np.uint64(bit)
        above = ~((one << np.uint64(1)) - np.uint64(1)) if bit < 63 else np.uint64(0)
        amid = np.searchsorted(a, (a[alo] & above) | one)
        bmid = np.searchsorted(b, (b[blo] & above) | one)
        children = []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            c = [(alo, amid)[x], (amid, ahi)[x], (blo, bmid)[y], (bmid, bhi)[y], differ + (x != y)]
            keep = (c[1] > c[0]) & (c[3] > c[2]) & (c[4] <= allowed[64 - bit])
            if same and (x, y) == (1, 0):  # a node with itself: the mirror of (0, 1)
                keep &= alo != blo
            children.append([v[keep] for v in c])
        stack.append((bit - 1, tuple(np.concatenate(v) for v in zip(*children, strict=True))))


def forest(n: int, links) -> np.ndarray:
    """The smallest index linked to each of n nodes, straight or through others."""
    label = np.arange(n)
    found = list(links)
    if not found:
        return label
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _cut(nodes: DataFrame, most: int) -> list[tuple[int, int, int]]:
    """The trie's top as (prefix, depth, count), cut where a subtree has at most ``most`` fingerprints.

    Only counts come to the driver: 256 for each subtree that is still too large.
    """
    total = nodes.count()
    done, open_ = [], [(0, 0, total)] if total else []
    depth = 0
    while open_ and depth < 64:
        large = [p for p, _, n in open_ if n > most]
        done += [x for x in open_ if x[2] <= most]
        if not large:
            return done
        hot = nodes.withColumn("p", F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long"))
        if depth:
            chosen = nodes.sparkSession.createDataFrame([(_signed(p),) for p in large], "p long")
            hot = hot.join(chosen, "p", "left_semi")
        counts = hot.groupBy(F.shiftrightunsigned("fp", 56 - depth).alias("q")).count().collect()
        depth += 8
        by = {int(r.q) & (2**64 - 1): r["count"] for r in counts}
        open_ = _merge(by, depth, most)
    return done + open_


def _merge(counts: dict[int, int], depth: int, most: int) -> list[tuple[int, int, int]]:
    """The largest subtrees of at most ``most``, from counts at ``depth`` up to eight levels above; larger ones at ``depth`` stay."""
    full = {depth: counts}
    for d in range(depth, depth - 8, -1):
        up: dict[int, int] = {}
        for p, n in full[d].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        full[d - 1] = up
    out = []
    for d in range(depth, depth - 9, -1):
        for p, n in full[d].items():
            if n <= most and (d == depth - 8 or full[d - 1][p >> 1] > most) or d == depth and n > most:
                out.append((p, d, n))
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _near_subtrees(cut: list[tuple[int, int, int]], steps: Steps) -> list[tuple[int, int]]:
    """Pairs of subtrees whose shared path differs in no more bits than allowed, found by walking the cut's trie with itself."""
    allowed = _allowed(steps)
    names = {(p, d): i for i, (p, d, _) in enumerate(cut)}
    inner = {(p >> k, d - k) for p, d, _ in cut for k in range(1, d + 1)}
    there = set(names) | inner
    out, stack = [], [((0, 0), (0, 0), 0)] if (0, 0) in there else []
    while stack:
        a, b, differ = stack.pop()
        if a in names and b in names:
            out.append((names[a], names[b]))
            continue
        xs = [a] if a in names else [(a[0] << 1 | x, a[1] + 1) for x in (0, 1)]
        ys = [b] if b in names else [(b[0] << 1 | y, b[1] + 1) for y in (0, 1)]
        for x in xs:
            for y in ys:
                if x not in there or y not in there or (a == b and x > y):
                    continue
                d = differ
                if min(x[1], y[1]) > min(a[1], b[1]):
                    short = min(x[1], y[1])
                    d += (x[0] >> (x[1] - short) & 1) != (y[0] >> (y[1] - short) & 1)
                if d <= allowed[min(x[1], y[1])]:
                    stack.append((x, y, d))
    return out


def _spanning(a: np.ndarray, b: np.ndarray, same: bool, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tries: each linked fingerprint and the smallest it reaches."""
    both = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    root = forest(len(both), ((i, j + shift) for i, j in linked_pairs(a, b, same, steps)))
    to = np.flatnonzero(root != np.arange(len(both)))
    return both[to], both[root[to]]


def links(nodes: DataFrame, steps: Steps) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints in each unit, as signed numbers."""
    spark = nodes.sparkSession
    total = nodes.count()
    most = int(min(SUBTREE_MOST, max(SUBTREE_LEAST, total // 64)))
    cut = _cut(nodes, most)
    if not cut:
        return spark.createDataFrame([], "a long, b long")
    depths = sorted({d for _, d, _ in cut})
    names = spark.createDataFrame([(_signed(p), d, i) for i, (p, d, _) in enumerate(cut)], "p long, d int, tree int")
    paths = F.array(*(F.struct((F.shiftrightunsigned("fp", 64 - d) if d else F.lit(0).cast("long")).alias("p"), F.lit(d).alias("d")) for d in depths))
    trees = nodes.select("fp", F.explode(paths).alias("x")).select("fp", "x.p", "x.d").join(names, ["p", "d"]).groupBy("tree").agg(F.collect_list("fp").alias("fps"))
    units = spark.createDataFrame(_near_subtrees(cut, steps), "s int, t int")
    work = units.join(trees.select(F.col("tree").alias("s"), F.col("fps").alias("a")), "s").join(trees.select(F.col("tree").alias("t"), F.col("fps").alias("b")), "t")

    def run(batches):
        for batch in batches:
            same = [x == y for x, y in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True)]
            for k in range(batch.num_rows):
                a, b = (np.sort(batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64)) for c in "ab")
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in _spanning(a, b, same[k], steps)], names=["a", "b"])

    return work.select("s", "t", "a", "b").repartition(parallelism(spark)).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b); nodes without edges are absent.

    Large-star and small-star rounds, each written to the shared folder, until a round changes nothing.
    """
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        return salted.join(least.select("a", "m", salts), ["a", "salt"]).select("a", "b", "m")

    e = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(e)
    while before[0]:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = with_least(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = with_least(large, least)
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        older, e = e, materialise(small.distinct(), "edges")
        discard(older)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs``; root is the component's smallest fingerprint."""
    fps = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), [(64, max_bits)])).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(named.join(least, "root").select("fp", "root", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "root", "component_id")


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct numbers of a text's ``WIDTH``-word shingles."""
    words = np.array(hashes(text.lower().split()) if text else [], dtype=np.uint64)
    width = min(WIDTH, len(words))
    h = np.zeros(len(words) - width + 1 if width else 0, dtype=np.uint64)
    for i in range(width):
        h = h * _MIX + words[i : i + len(h)]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ h >> np.uint64(29))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def differing(least: float) -> float:
    """The chance that a fingerprint's bit differs between sets of equal size with this Jaccard similarity."""
    return math.acos(2 * least / (1 + least)) / math.pi


def _at_most(n: int, p: float) -> list[float]:
    """P(at most e of n bits differ), for e from 0 to n."""
    one = [math.comb(n, e) * p**e * (1 - p) ** (n - e) for e in range(n + 1)]
    return [sum(one[: e + 1]) for e in range(n + 1)]


def budgets(n: int, least: float = LEAST) -> tuple[int, Steps]:
    """Bits of a leaf's path for n texts, and the errors allowed in a key: in its table's number, the path and all of it."""
    path, p = min(40, max(1, n).bit_length() + SPARE), differing(least)
    rest = 64 - TABLE_BITS - path
    tail = _at_most(rest, p)
    more = next(e for e, x in enumerate(tail) if x >= 0.98)
    head = _at_most(path, p)
    errors = next(e for e, x in enumerate(head) if (1 - x * tail[more]) ** TABLES <= 1 - RECALL)
    return path, [(TABLE_BITS, 0), (TABLE_BITS + path, errors), (64, errors + more)]


class Order:
    """One order of all shingles: those told frequent last, by their number in the sample, the others by their hash."""

    def __init__(self, shingle: np.ndarray, count: np.ndarray):
        at = np.argsort(shingle)
        self.shingle, self.level = shingle[at], np.minimum(8 * np.log2(count[at]) + 1, 255).astype(np.uint64)

    def tokens(self, shingle: np.ndarray) -> np.ndarray:
        """A number for each shingle that rises in this order."""
        out = shingle >> np.uint64(8)
        if len(self.shingle):
            at = np.minimum(np.searchsorted(self.shingle, shingle), len(self.shingle) - 1)
            out |= np.where(self.shingle[at] == shingle, self.level[at], np.uint64(0)) << np.uint64(56)
        return out

    def prefix(self, shingle: np.ndarray, least: float) -> np.ndarray:
        """The first of a set's tokens, which hold ``common`` of those it shares with any similar set."""
        n = len(shingle)
        keep = n - math.ceil(least * n - 1e-9) + common(n, least)
        tokens = self.tokens(shingle)
        return np.partition(tokens, keep - 1)[:keep] if keep < n else tokens


def common(n: int, least: float) -> int:
    """Shingles that a set of n shares with a similar one in their prefixes: ``COMMON``, or all it must share if these are fewer."""
    return min(COMMON, math.ceil(least * n - 1e-9))


def frequent(docs: DataFrame, id_col: str, text_col: str) -> Order:
    """The order of shingles, from about ``ORDER_DOCS`` documents; it decides how much work the join is, not what it finds."""
    every = max(1, docs.count() // ORDER_DOCS)
    sample = docs.filter(F.pmod(_key(id_col, text_col), F.lit(every)) == 0).select(utf8(text_col))

    def run(batches):
        for b in batches:
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["shingle"])

    rows = sample.mapInArrow(tidy(run), "shingle long").groupBy("shingle").count().filter("count > 3").orderBy(F.desc("count"), "shingle").limit(ORDER_MOST).collect()
    return Order(np.array([r.shingle for r in rows], dtype=np.int64).view(np.uint64), np.array([r["count"] for r in rows], dtype=np.float64))


def parities(shingle: np.ndarray) -> np.ndarray:
    """Whether each hash class holds an odd number of the set's shingles, two to four classes a shingle."""
    bits = min(PARITY_BITS, max(64, 1 << (2 * len(shingle)).bit_length()))
    odd = np.bincount((shingle & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(parity: np.ndarray, size: int) -> np.ndarray:
    """Parities (the last axis) of ``size`` numbers, as if the set had fewer classes."""
    while parity.shape[-1] > size:
        half = parity.shape[-1] // 2
        parity = parity[..., :half] ^ parity[..., half:]
    return parity


def most_differing(m, n, least: float):
    """The most shingles in which similar sets of m and n differ."""
    return (m + n) * (1 - least) / (1 + least) + 1e-9


def may_be_similar(a: list[np.ndarray], b: list[np.ndarray], m: np.ndarray, n: np.ndarray, other: np.ndarray, least: float):
    """For each set of a (its parities, size) the sets of b that may be similar, and the differing classes; ``other`` says which pairs count."""
    kinds: dict[int, np.ndarray] = {}
    for size in {len(x) for x in b}:
        kinds[size] = np.array([j for j, x in enumerate(b) if len(x) == size])
    stacked = {(size, w): folded(np.stack([b[j] for j in at]), w) for size, at in kinds.items() for w in {min(size, len(x)) for x in a}}
    for i, x in enumerate(a):
        for size, at in kinds.items():
            fits = other[i, at] & (n[at] >= least * m[i] - 1e-9) & (m[i] >= least * n[at] - 1e-9)
            if not fits.any():
                continue
            w = min(size, len(x))
            j = at[fits]
            apart = np.bitwise_count(stacked[size, w][fits] ^ folded(x, w)).sum(axis=1, dtype=np.int64)
            near = apart <= most_differing(m[i], n[j], least)
            if near.any():
                yield i, j[near], apart[near]


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def _sets(docs: DataFrame, order: Order, least: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, node, size, parity, tokens): a row's number, its set's number, its size, parities and prefix."""

    def run(batches):
        for b in batches:
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            size = np.array([len(s) for s in sets], dtype=np.int32)
            tokens = [order.prefix(s, least).view(np.int64) for s in sets]
            arrays = [b.column(0), b.column(1), pa.array(node), pa.array(size), pa.array([parities(s).tobytes() for s in sets], pa.binary()), pa.array(tokens, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "node", "size", "parity", "tokens"])

    schema = "doc_id long, key long, node long, size int, parity binary, tokens array<long>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(id_col, text_col), utf8(text_col)).mapInArrow(tidy(run), schema)


def _within_sizes(x: str, y: str, least: float) -> Column:
    return (F.col(x) >= F.col(y) * least - 1e-9) & (F.col(y) >= F.col(x) * least - 1e-9)


def compared(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): the distinct pairs of sets that are similar, by their parities and then in full."""
    own = lambda side: nodes.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("parity").alias(f"parity_{side}"))

    def near(batches):
        for batch in batches:
            a, b, m, n, p, q = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                x, y = np.frombuffer(p[i], "<u8"), np.frombuffer(q[i], "<u8")
                w = min(len(x), len(y))
                keep.append(int(np.bitwise_count(folded(x, w) ^ folded(y, w)).sum(dtype=np.int64)) <= most_differing(m[i], n[i], least))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (a, b)], names=["a", "b"])

    both = pairs.join(own("a"), "a").join(own("b"), "b").filter(_within_sizes("size_a", "size_b", least))
    pairs = materialise(both.select("a", "b", "size_a", "size_b", "parity_a", "parity_b").mapInArrow(tidy(near), "a long, b long"), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key"), "node")
    sets = materialise(texts.join(asked, "key").dropDuplicates(["node"]).select("node", "text"), "sets")

    def run(batches):
        for batch in batches:
            a, b, s, t = (c.to_pylist() for c in batch.columns)
            near = [jaccard(shingles(x), shingles(y)) >= least for x, y in zip(s, t, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, n in zip(c, near, strict=True) if n], pa.int64()) for c in (a, b)], names=["a", "b"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("text").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("text").alias("t")), "b")
    return materialise(both.select("a", "b", "s", "t").mapInArrow(tidy(run), "a long, b long"), "similar")


def across(large: DataFrame, nodes: DataFrame, roots: DataFrame, least: float, nearest: bool) -> DataFrame:
    """(a, b): pairs of the large buckets' sets in different components that may be similar; for each set its nearest, or all."""
    named = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = named.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("token")
    rows = named.join(several, "token").join(nodes.select("node", "parity"), "node").withColumn("chunk", F.floor((F.col("at") - 1) / BLOCK))
    chunks = rows.groupBy("token", "chunk").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.collect_list(F.struct("node", "size", "root", "parity")).alias("rows"))
    chunks = materialise(chunks, "chunks")
    side = lambda x: chunks.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("chunk", "lo", "hi", "rows")))
    work = side("s").join(side("t"), "token").filter((F.col("chunk_s") <= F.col("chunk_t")) & (F.col("lo_t") * least - 1e-9 <= F.col("hi_s")))

    def opened(rows: list[dict]):
        node, size, root = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("node", "size", "root"))
        return node, size, root, [np.frombuffer(r["parity"], "<u8") for r in rows]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (node, m, root, p), (other, n, roots, q) = (opened(batch.column(c)[k].as_py()) for c in (0, 1))
                a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, j, apart in may_be_similar(p, q, m, n, root[:, None] != roots[None], least):
                    j = j[[apart.argmin()]] if nearest else j
                    a.append(np.minimum(node[i], other[j]))
                    b.append(np.maximum(node[i], other[j]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return work.select("rows_s", "rows_t").repartition(parallelism(large.sparkSession)).mapInArrow(tidy(run), "a long, b long").distinct()


def similar(nodes: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, root): the components of similar sets. ``nodes``: (node, key, size, parity, tokens); ``texts``: (key, text)."""
    by = Window.partitionBy("token")
    entries = nodes.select("node", "size", F.explode("tokens").alias("token"))
    ranked = entries.withColumn("at", F.row_number().over(by.orderBy("size", "node"))).withColumn("n", F.count("*").over(by))
    buckets = materialise(ranked.filter("n > 1"), "buckets")
    few = buckets.filter(F.col("n") <= SMALL)
    side = lambda x: few.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "at")))
    met = side("a").join(side("b"), "token").filter((F.col("at_a") < F.col("at_b")) & _within_sizes("size_a", "size_b", least))
    # the smaller set, which comes first, must share the fewer
    met = met.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).agg(F.count("*").alias("shared"), F.min("size_a").alias("size"))
    met = met.filter(F.col("shared") >= F.least(F.lit(COMMON), F.ceil(F.col("size") * least - 1e-9))).select("a", "b")
    large = buckets.filter(F.col("n") > SMALL)
    centre = large.groupBy("token").agg(F.min("node").alias("a"))
    star = large.join(centre, "token").filter("a <> node").select("a", F.col("node").alias("b"))
    found = compared(met.union(star).distinct(), nodes, texts, least)
    roots = materialise(components(found), "roots")
    if large.isEmpty():
        return roots
    for nearest in (True, False):
        more = materialise(across(large, nodes, roots, least, nearest), "across")
        if more.isEmpty():
            break
        found = found.union(compared(more, nodes, texts, least))
        roots = materialise(components(found), "roots")
    return roots


def similar_dropped(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts: the smallest id, rows without id last; of equal rows any."""
    small_batches(docs.sparkSession)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("k")
    sets = _sets(docs, frequent(docs, id_col, text_col), least, id_col, text_col)
    nodes = sets.groupBy("node").agg(first, *(F.first(c).alias(c) for c in ("size", "parity", "tokens")))
    nodes = materialise(nodes.select("node", "k", "k.key", "size", "parity", "tokens"), "nodes")
    texts = docs.select(_key(id_col, text_col).alias("key"), utf8(text_col).alias("text"))
    roots = similar(nodes, texts, least)
    key = private(docs, "key")
    wins = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k")).select(F.col("k.key").alias(key))
    kept = docs.withColumn(key, _key(id_col, text_col)).join(wins, key, "left_semi")
    return kept.dropDuplicates([key]).select(*docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
