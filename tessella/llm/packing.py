"""Packing of tokenised documents into sequences: best fit, then swap-based local search.

Documents are tokenised with a public tokenizer file and get one end id each. Only a document that is longer
than a sequence is cut. Pieces are dealt into groups of bounded size and each group is packed by itself: best fit in
order of arrival first, then a local search over its underfull bins. A step moves one document to a fuller bin, or
exchanges one for a shorter one, two for one shorter than both, or one for two shorter than it; of the steps of the least
filled bin the one that raises the sum of squared fills most is taken, the next kind only where the one before has none.
Bins so run empty, until as few are left as the tokens need, or until no step of any bin raises the sum any more.

Defined results: a null or empty text is the end id alone; repeated rows are packed as separate documents;
ties take the earlier bin; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, materialise, small_batches, table, utf8

ROOM = 4096
END = 1
#: Pieces in a packing group; a group's loss is at most about one sequence.
GROUP = 20_000
CACHE = 400_000

_LATIN = re.compile("([a-zß-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")


class WordTokenizer:
    """Ids of a text by a word-level BPE file whose pre-tokens never cross ASCII white space.

    Each distinct run between spaces is encoded once and kept. A run of Latin letters with trailing ASCII
    punctuation goes to a merge table in byte form; anything else goes to the library's own encoder.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        raw = lambda s: bytes(byte_of[c] for c in s.removesuffix("</w>")) + b"\xff" * s.endswith("</w>")
        ranks: dict[bytes, int] = {}
        for unit in (*(bytes([b]) for b in range(256)), *(bytes([b, 255]) for b in range(256)), *(raw(a) + raw(b) for a, b in model["merges"])):
            ranks.setdefault(unit, len(ranks))
        self.ids = [-1] * len(ranks)
        for token, i in model["vocab"].items():
            if not token.startswith("<|"):
                self.ids[ranks[raw(token)]] = i
        self.piece = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[bytes, bytes] = {}

    def _encode(self, run: bytes) -> bytes:
        s = run.decode("utf-8", "replace")
        if m := _LATIN.fullmatch(s.lower()):
            ids = [self.ids[r] for r in self.piece(m[1].encode() + b"\xff")]
            if min(ids) >= 0:
                if m[2]:
                    key = m[2].encode()
                    if key not in self.known:
                        self.known[key] = self._ids(m[2])
                    return np.array(ids, dtype="<u4").tobytes() + self.known[key]
                return np.array(ids, dtype="<u4").tobytes()
        return self._ids(s)

    def _ids(self, s: str) -> bytes:
        return np.array(self.slow.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: bytes | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        runs = text.split() if b"<|" in text else text.lower().split()  # special tokens are spelt in lower case only
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        try:
            return b"".join(map(known.__getitem__, runs))
        except KeyError:
            for r in set(runs):
                if r not in known:
                    known[r] = self._encode(r)
            return b"".join(map(known.__getitem__, runs))


#: Kept from task to task of packing, as it takes longest to open; other operators' tasks drop it.
_open: dict[str, WordTokenizer] = {}
CACHES.append(_open)


def tokenizer(path: str) -> WordTokenizer:
    if path not in _open:
        _open[path] = WordTokenizer(path)
    return _open[path]


def pieces(docs: DataFrame, path: str, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        t, end = tokenizer(path), np.array([END], dtype="<u4").tobytes()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = t.encode(text) + end
                for k, i in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[i : i + 4 * room]
                    for c, v in zip(out, (doc, k, i // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col)).mapInArrow(run, schema)


def best_fit(lengths: list[int], room: int = ROOM) -> list[list[int]]:
    """Bins of indices: each piece in turn into the fullest bin that has room."""
    bins: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(room + 1)]  # by room left
    mask = 0
    for i, n in enumerate(lengths):
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            k = open_[left].pop()
            if not open_[left]:
                mask &= ~(1 << left)
            bins[k].append(i)
        else:
            left, k = room, len(bins)
            bins.append([i])
        left -= n
        if left:
            open_[left].append(k)
            mask |= 1 << left
    return bins


class Bins:
    """Bins under local search. Indices of documents are ``i``, of bins ``k``; ``s`` is the bin that gives."""

    def __init__(self, bins: list[list[int]], lengths: list[int], room: int = ROOM):
        self.room, self.n = room, np.asarray(lengths, dtype=np.int64)
        self.bin = np.empty(len(lengths), dtype=np.int64)
        for k, b in enumerate(bins):
            self.bin[b] = k
        self.members = [set(b) for b in bins]
        self.fill = np.bincount(self.bin, self.n, len(bins)).astype(np.int64)
        self.fewest = -(-int(self.n.sum()) // room)
        self.order = np.argsort(self.n, kind="stable")
        self.sorted = self.n[self.order]
        self.of: dict[int, np.ndarray] = {}
        self.pairs: tuple | None = None

    def _gain(self, s: int, give: int, sums: np.ndarray, ks: np.ndarray) -> tuple[int, int]:
        """(rise of the sum of squares, which) of the best bin of ``ks`` to take ``give`` tokens for ``sums``."""
        g, fill = give - sums, self.fill[ks]
        rise = np.where((g > 0) & (fill + g <= self.room) & (ks != s) & (fill > 0), g * (fill - self.fill[s] + g), 0)
        at = int(rise.argmax()) if len(rise) else 0
        return (int(rise[at]), at) if len(rise) else (0, 0)

    def _doubles(self, k: int) -> np.ndarray:
        """(sum, i, j) of a bin's pairs of documents, one for each two lengths: their number has a bound in the room."""
        if k not in self.of:
            by: dict[int, list[int]] = {}
            for i in sorted(self.members[k]):
                by.setdefault(int(self.n[i]), []).append(i)
            sizes = sorted(by)
            found = [(2 * u, by[u][0], by[u][1]) for u in sizes if len(by[u]) > 1]
            found += [(u + v, by[u][0], by[v][0]) for a, u in enumerate(sizes) for v in sizes[a + 1 :]]
            self.of[k] = np.array(found, dtype=np.int64).reshape(-1, 3)
        return self.of[k]

    def _all_doubles(self, under: np.ndarray) -> tuple:
        """All pairs of underfull bins by their sum, as (sums, documents, bins)."""
        if self.pairs is None:
            every = [self._doubles(k) for k in under.tolist()]
            found, ks = np.concatenate(every), np.repeat(under, [len(x) for x in every])
            order = np.argsort(found[:, 0], kind="stable")
            self.pairs = found[order, 0], found[order, 1:], ks[order]
        return self.pairs

    def step(self, s: int) -> bool:
        """Take the best step of bin s, if it has one."""
        under = np.flatnonzero((self.fill < self.room) & (self.fill > 0))
        others = under[under != s]
        if not len(others):
            return False
        most = self.room - int(self.fill[others].min())
        one: dict[int, tuple[int, ...]] = {}
        for i in sorted(self.members[s]):
            one.setdefault(int(self.n[i]), (i,))
        two: dict[int, tuple[int, ...]] = {}

        def best(gives: dict[int, tuple[int, ...]], sums: np.ndarray, take, ks) -> tuple:
            top: tuple = (0,)
            for size, give in gives.items():
                lo, hi = np.searchsorted(sums, [size - most, size])
                if lo < hi:
                    rise, at = self._gain(s, size, sums[lo:hi], ks(lo, hi))
                    if rise > top[0]:
                        top = (rise, int(ks(lo, hi)[at]), give, take(lo + at))
            return top

        singles = (self.sorted, lambda at: (int(self.order[at]),), lambda lo, hi: self.bin[self.order[lo:hi]])
        top = best(one, np.zeros(len(others), dtype=np.int64), lambda at: (), lambda lo, hi: others[lo:hi])
        top = max(top, best(one, *singles), key=lambda x: x[0])
        if not top[0]:
            for size, i, j in self._doubles(s).tolist():
                two.setdefault(size, (i, j))
            top = best(two, *singles)
        if not top[0]:
            sums, docs, ks = self._all_doubles(under)
            top = best(one, sums, lambda at: tuple(docs[at].tolist()), lambda lo, hi: ks[lo:hi])
        if top[0]:
            self._shift(s, *top[1:])
        return top[0] > 0

    def _shift(self, s: int, k: int, give: tuple[int, ...], take: tuple[int, ...]) -> None:
        for a, b, docs in ((s, k, give), (k, s, take)):
            self.members[a] -= set(docs)
            self.members[b] |= set(docs)
            self.bin[list(docs)] = b
        self.fill[s], self.fill[k] = (sum(int(self.n[i]) for i in self.members[x]) for x in (s, k))
        self.pairs = None
        for x in (s, k):
            self.of.pop(x, None)

    def search(self) -> Bins:
        """Steps of the least filled bins until the fewest possible are left or no bin has a step."""
        better = True
        while better and (self.fill > 0).sum() > self.fewest:
            better, done = False, np.zeros(len(self.fill), dtype=bool)
            while (self.fill > 0).sum() > self.fewest:
                open_ = np.flatnonzero((self.fill > 0) & (self.fill < self.room) & ~done)
                if not len(open_):
                    break
                s = int(open_[self.fill[open_].argmin()])
                while self.fill[s] and self.step(s):
                    better = True
                done[s] = True
        return self


def local_search(bins: list[list[int]], lengths: list[int], room: int = ROOM) -> list[list[int]]:
    """The bins that are left by the search."""
    return [sorted(b) for b in Bins(bins, lengths, room).search().members if b]


def pack(docs: DataFrame, path: str, room: int = ROOM, group: int = GROUP) -> DataFrame:
    """Every piece with its sequence and its place there."""
    cut = materialise(pieces(docs, path, room).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def run(pdf):
        pdf = pdf.sort_values("row", ignore_index=True)
        lengths = pdf.length.tolist()
        bins = local_search(best_fit(lengths, room), lengths, room)
        sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = k, at
                at += lengths[i]
        return pdf.assign(sequence_id=(pdf.group.to_numpy() << 32) + sequence, offset=offset).drop(columns=["row", "group"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(run, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
