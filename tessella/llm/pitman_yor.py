"""A hierarchical Pitman-Yor language model, seated by Gibbs sampling.

Three levels: a uniform base over the vocabulary and one unknown word, a word restaurant, and a restaurant for each
context, the word before (the end token before a text's first), all of which share the word restaurant as their parent.
Every word that stands before another has a restaurant of its own, however many there are (words are their 64-bit hashes).
The customers of a context restaurant are the training tokens; each table there sends one customer to the parent.
A sweep seats the customers of every dish anew, one after the other, by the Chinese-restaurant probabilities given
the parent's predictive probability and the restaurant's tables before the sweep, then seats the parent's. After a burn-in
sweep, SAMPLES sweeps are kept and a token's probability is the mean of their predictive probabilities. From the
``SINGLE``th customer of a dish on, runs of a sixteenth of those seated share one probability and their number of new
tables is one binomial draw; all others are seated singly.

Data flow: documents become blocks; a block's tokens are summed to (word, context, document, count) and dealt
by word range into parts, whose number follows from the bytes of text. A part holds all of a word's dishes and is written
once; passes exchange only sums, exact after the counting, the burn-in and the samples. A part sends its contexts' customers and
tables by range of contexts, where they are added up, and gets the sums of its own contexts back, in its own order; the driver
gets the parent's numbers only. After the burn-in only contexts with a dish of several customers are sent. Random numbers are hashes
of word, context, sweep and customer, so the model is one model however the rows and parts lie. Words frequent in a block
send only their counts to their part; it sends back one probability per context for the block's entries, so no part holds a
hot word's tokens.

Defined results: a null or empty text is the end token alone; a null id counts as not held out; repeated rows
are learned from and scored each; with nothing to learn from every token is the unknown word; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, materialise, released, small_batches, table, utf8
from .language import remainder

SAMPLES = 3
#: (discount, strength) of the context restaurants and of the word restaurant.
LOWER, UPPER = (0.8, 1.0), (0.6, 1.0)
#: Customers of a dish that are seated singly.
SINGLE = 128
BLOCK_BYTES, BLOCK_DOCS = 3_000_000, 32_000
#: Bytes of text whose tokens make a part.
PART_BYTES = 12_000_000
#: A word with this share of a block's tokens is frequent there.
HOT = 0.004
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
_known: dict[bytes, int] = {}
CACHES.append(_known)


def hashes(words: list[bytes]) -> list[int]:
    """64-bit numbers of words, the same in every process."""
    if len(_known) > 300_000:
        _known.clear()
    try:
        return list(map(_known.__getitem__, words))
    except KeyError:
        for w in set(words):
            if w not in _known:
                _known[w] = xxhash.xxh64_intdigest(w)
        return list(map(_known.__getitem__, words))


def key_bits(size: int) -> int:
    """Bits of a context that its dishes' random numbers depend on, for so many bytes of text."""
    return min(64, max(16, size.bit_length()))


def uniform(key: np.ndarray, k: int) -> np.ndarray:
    """A number in [0, 1) for each key and the draw k, the same wherever it is drawn."""
    with np.errstate(over="ignore"):
        x = key + np.uint64(k * 0x9E3779B97F4A7C15 & 2**64 - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)) * 2.0**-53


def binomial(m: np.ndarray, p: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Draws of how many of m succeed: by inversion where few are expected, by the normal approximation elsewhere."""
    u, mean = uniform(key, 2 * k), m * p
    z = np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * uniform(key, 2 * k + 1))
    out = np.clip(np.rint(mean + z * np.sqrt(mean * (1 - p))), 0, m)
    few = np.flatnonzero(mean < 16)
    n, q, u = m[few], p[few], u[few]
    one = (1 - q) ** n
    below, hits = one.copy(), np.zeros(len(few))
    for j in range(64):
        more = u >= below
        if not more.any():
            break
        hits += more
        one = one * (n - j) / (j + 1) * q / np.maximum(1 - q, 1e-12)
        below += one
    out[few] = np.minimum(hits, n)
    return out


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables after seating each dish's customers in turn.

    ``weight`` is the restaurant's (strength + discount * tables) times the dish's parent probability, held
    during the sweep; ``key`` is the dish's own number for its random draws.
    """
    order = np.argsort(-customers, kind="stable")
    c, s, key = customers[order], weight[order], key[order]
    t = np.minimum(c, 1).astype(np.float64)
    k = 1
    while n := int(np.searchsorted(-c, -k, side="left")):
        p = s[:n] / (k - discount * t[:n] + s[:n])
        if k < SINGLE:
            t[:n] += uniform(key[:n], k) < p
            k += 1
        else:
            m = np.minimum(k // 16, c[:n] - k)
            t[:n] += binomial(m, np.minimum(p, 1.0), key[:n], k)
            k += k // 16
    out = np.empty_like(t)
    out[order] = t
    return out


class Sums:
    """What the parts' sums are in all: words, tokens, each context's customers; and after a sweep its tables and the parent's."""

    def __init__(self, words: float, tokens: float, customers: np.ndarray, sweeps: list[tuple[np.ndarray, float, float]]):
        self.words, self.tokens, self.customers, self.sweeps = words, tokens, customers, sweeps

    def parent(self, sweep: int, up: np.ndarray, top: np.ndarray) -> np.ndarray:
        """The word restaurant's probability of words with so many customers and tables there."""
        d, a = UPPER
        _, total, roots = self.sweeps[sweep]
        return (up - d * top + (a + d * roots) / (self.words + 1)) / (a + total)

    def log10(self, context, customers, tables, up, top) -> np.ndarray:
        """The mean predictive probability's log10 over the samples. ``tables``, ``up`` and ``top``: one array per sample."""
        d, a = LOWER
        found = 0.0
        for s in range(SAMPLES):
            every = self.sweeps[s + 2][0][context].astype(np.float64)
            found = found + (customers - d * tables[s] + (a + d * every) * self.parent(s + 2, up[s], top[s])) / (a + self.customers[context].astype(np.float64))
        return np.log10(found / SAMPLES)


class Part:
    """The dishes of one range of words: ``pw`` and ``pb`` are a pair's word and context (by place in the part), ``c`` its customers."""

    def __init__(self, words: np.ndarray, pair_word: np.ndarray, pair_context: np.ndarray, customers: np.ndarray, contexts: np.ndarray | None = None, bits: int = 64):
        self.words, self.pw, self.pb, self.c = words, pair_word, pair_context, customers
        self.contexts = np.arange(pair_context.max(initial=-1) + 1, dtype=np.uint64) if contexts is None else contexts
        self.keys = self.contexts >> np.uint64(64 - bits)
        self.count = np.bincount(pair_word, customers, len(words))

    def busy(self) -> np.ndarray:
        """The contexts that have a dish of several customers here: only their tables change."""
        return np.unique(self.pb[self.c > 1])

    def sweeps(self, sums: Sums, upto: int):
        """(tables of each pair, parent's customers and tables of each word) at the start and after each sweep that ``sums`` allow.

        Sweep 0 is one table for each pair that has customers; a sweep reads the sums of the one before it, samples those of the burn-in.
        """
        (d, a), (d0, a0) = LOWER, UPPER
        t = np.minimum(self.c, 1).astype(np.float64)
        up = np.bincount(self.pw, t, len(self.words))
        top = np.minimum(up, 1)
        yield t, up, top
        many = np.flatnonzero(self.c > 1)
        c, pw, pb = self.c[many], self.pw[many], self.pb[many]
        with np.errstate(over="ignore"):
            own = (self.words[pw] ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD) + self.keys[pb] * np.uint64(0xC4CEB9FE1A85EC53)
            for sweep in range(1, upto + 1):
                before = min(sweep - 1, 1)
                tables, _, roots = sums.sweeps[before]
                turn = np.uint64(sweep * 0xA0761D6478BD642F & 2**64 - 1)
                t = np.minimum(self.c, 1).astype(np.float64)
                t[many] = seat(c, (a + d * tables[pb].astype(np.float64)) * sums.parent(before, up, top)[pw], d, own ^ turn)
                up = np.bincount(self.pw, t, len(self.words))
                top = seat(up, np.full(len(self.words), (a0 + d0 * roots) / (sums.words + 1)), d0, self.words ^ turn)
                yield t, up, top


def _pack_planes(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob, each with its lowest bytes first, then the next, and compressed: high bytes are mostly alike."""
    flat = [np.ascontiguousarray(x).view("u1").reshape(len(x), x.itemsize).T.tobytes() for x in arrays]
    return np.array([len(x) for x in arrays], dtype="<u4").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(flat))


def _unpack_planes(blob: bytes, *kinds: str) -> list[np.ndarray]:
    head = 4 * len(kinds)
    sizes, at, out = np.frombuffer(blob, "<u4", len(kinds)), 0, []
    flat = zstandard.ZstdDecompressor().decompress(memoryview(blob)[head:])
    for n, k in zip(sizes.tolist(), kinds, strict=True):
        width = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(flat, "u1", n * width, at).reshape(width, n).T).view(k).reshape(n))
        at += n * width
    return out


#: A block's entries for a part: words (by steps), their entries, contexts (by steps); each entry's context (by steps within its word), document, count; training documents.
_ENTRY = ("<u8", "<u4", "<u8", "<u4", "<u2", "<u2", "<u4")


def _steps(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers that rise within groups of these sizes, as steps from 0 in each."""
    start = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.diff(x, prepend=0)
    out[start] = x[start]
    return out


def _unsteps(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    x, sizes = x.astype(np.int64), sizes.astype(np.int64)
    every = np.concatenate([np.zeros(1, np.int64), np.cumsum(x)])
    return every[1:] - np.repeat(every[np.cumsum(sizes) - sizes], sizes)


def _split(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as (which, count) of at most 65535 each."""
    times = (n + 65534) // 65535
    which = np.repeat(np.arange(len(n)), times)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    return which, np.minimum(n[which] - 65535 * nth, 65535)


def _block(number: int, docs: list[tuple], parts: int) -> list[tuple]:
    """Rows (kind, part, word, block, blob) of one block: its documents, cold entries, hot counts, hot entries."""
    docs = sorted(docs, key=lambda x: x[1])  # training documents come first
    train = sum(not held for _, held, _ in docs)
    word, size = [], []
    for _, _, text in docs:
        own = hashes(text.lower().split()) if text else []
        word.append(np.array([*own, int(END)], dtype=np.uint64))
        size.append(len(own) + 1)
    tokens = np.array(size, dtype=np.int64)
    w = np.concatenate(word)
    words, at = np.unique(w, return_inverse=True)
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[np.cumsum(tokens) - tokens] = np.searchsorted(words, END)
    # one number per (word, context, document), both words by their place among the block's
    low = len(docs).bit_length()
    wide = low + len(words).bit_length()
    key, n = np.unique((at << wide) | (before << low) | np.repeat(np.arange(len(docs)), tokens), return_counts=True)
    which, n = _split(n)
    key = key[which]
    ew, eb, ed = key >> wide, (key >> low) & (1 << (wide - low)) - 1, key & (1 << low) - 1
    hot = np.bincount(at, minlength=len(words)) > max(64, HOT * len(w))
    ids = pa.array([i for i, _, _ in docs], pa.int64())
    meta = _pack_planes(np.array(ids.fill_null(0), dtype="<i8"), np.array(ids.is_null(), dtype="u1"), np.array([h for _, h, _ in docs], dtype="u1"), tokens.astype("<u4"))
    rows = [(0, number % parts, 0, number, meta)]
    entries = np.bincount(ew, minlength=len(words))
    stop = np.cumsum(entries)
    part = ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    for p in np.unique(part).tolist():
        lo, hi = np.searchsorted(part, [p, p + 1])
        cold = np.flatnonzero(~hot[lo:hi]) + lo
        if len(cold):
            keep = np.repeat(~hot[lo:hi], entries[lo:hi])
            e = slice(stop[lo] - entries[lo], stop[hi - 1])
            own, place = np.unique(eb[e][keep], return_inverse=True)
            place = _steps(place, entries[cold]).astype("<u4")
            rows.append((1, p, 0, number, _pack_planes(np.diff(words[cold], prepend=np.uint64(0)), entries[cold].astype("<u4"), np.diff(words[own], prepend=np.uint64(0)), place, ed[e][keep].astype("<u2"), n[e][keep].astype("<u2"), np.array([train], dtype="<u4"))))
    for k in np.flatnonzero(hot).tolist():
        e = slice(stop[k] - entries[k], stop[k])
        own, place = np.unique(eb[e], return_inverse=True)
        learned = np.bincount(place, n[e] * (ed[e] < train), len(own))
        signed = int(words[k].astype(np.int64))
        rows.append((2, int(part[k]), signed, number, _pack_planes(np.diff(words[own], prepend=np.uint64(0)), learned.astype("<u4"))))
        rows.append((3, number % parts, signed, number, _pack_planes(place.astype("<u4"), ed[e].astype("<u2"), n[e].astype("<u2"))))
    return rows


def blocks(docs: DataFrame, held_out, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's tokens as blocks' rows."""
    small_batches(docs.sparkSession)
    schema = "kind int, part int, word long, block long, blob binary"
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def run(batches):
        from pyspark import TaskContext

        number, own, size = TaskContext.get().partitionId() << 24, [], 0

        def rows():
            got = _block(number, own, parts)
            for i in range(0, len(got), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got[i : i + 64], strict=True), kinds, strict=True)], names=["kind", "part", "word", "block", "blob"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.append(row)
                size += len(row[2] or b"")
                if size >= BLOCK_BYTES or len(own) >= BLOCK_DOCS:
                    yield from rows()
                    number, own, size = number + 1, [], 0
        if own:
            yield from rows()

    return docs.select(F.col(id_col).cast("long"), held_out, utf8(text_col)).mapInArrow(run, schema)


#: A part's dishes as written: words and contexts (by steps); each pair's word (by steps), context (by steps within its word), customers.
_DISHES = ("<u8", "<u8", "<u4", "<u4", "<u8")
#: A part's entries: blocks, their entries; each entry's pair (by steps), document, count; hot (block, word), contexts; each one's pair.
_ENTRIES = ("<i8", "<u4", "<i4", "<u2", "<u2", "<i8", "<i8", "<u4", "<u4")


def _merged(pdf: pd.DataFrame) -> tuple[bytes, bytes] | None:
    """All of a part's rows as two blobs: passes that only seat read the first."""
    cold, hot = [], []
    for r in pdf[pdf.kind == 1].sort_values("block").itertuples():
        named, sizes, contexts, place, doc, n, train = _unpack_planes(r.blob, *_ENTRY)
        cold.append((r.block, np.cumsum(named), sizes.astype(np.int64), np.cumsum(contexts), _unsteps(place, sizes), doc, n, n * (doc < train[0])))
    for r in pdf[pdf.kind == 2].sort_values(["block", "word"]).itertuples():
        contexts, learned = _unpack_planes(r.blob, "<u8", "<u4")
        hot.append((r.block, r.word, np.cumsum(contexts), learned))
    if not cold and not hot:
        return None
    join = lambda kind, xs: np.concatenate([np.zeros(0, kind), *xs])
    words, at = np.unique(join(np.uint64, [x[1] for x in cold] + [np.array([w for _, w, _, _ in hot], dtype=np.int64).view(np.uint64)]), return_inverse=True)
    sizes = join(np.int64, [x[2] for x in cold])
    word = np.concatenate([np.repeat(at[: len(sizes)], sizes), np.repeat(at[len(sizes) :], [len(x[2]) for x in hot])])
    contexts, at = np.unique(join(np.uint64, [x[3] for x in cold] + [x[2] for x in hot]), return_inverse=True)
    start = np.cumsum([0] + [len(x[3]) for x in cold])
    place = join(np.int64, [at[i + x[4]] for i, x in zip(start.tolist(), cold, strict=False)] + [at[start[-1] :]])
    pairs, of = np.unique(word << 32 | place, return_inverse=True)
    del word, place, at
    customers = np.bincount(of, join(np.float64, [x[7] for x in cold] + [x[3] for x in hot]), len(pairs))
    many = sum(len(x[4]) for x in cold)
    pw = pairs >> 32
    pb = _steps(pairs & (1 << 32) - 1, np.bincount(pw, minlength=len(words)))
    dishes = _pack_planes(np.diff(words, prepend=np.uint64(0)), np.diff(contexts, prepend=np.uint64(0)), np.diff(pw, prepend=0).astype("<u4"), pb.astype("<u4"), customers.astype("<u8"))
    return dishes, _pack_planes(
        np.array([x[0] for x in cold], dtype="<i8"), np.array([len(x[4]) for x in cold], dtype="<u4"), np.diff(of[:many], prepend=0).astype("<i4"), join("<u2", [x[5] for x in cold]), join("<u2", [x[6] for x in cold]),
        np.array([x[0] for x in hot], dtype="<i8"), np.array([x[1] for x in hot], dtype="<i8"), np.array([len(x[2]) for x in hot], dtype="<u4"), of[many:].astype("<u4"),
    )


def _opened(blob: bytes, bits: int) -> Part:
    words, contexts, pw, pb, c = _unpack_planes(blob, *_DISHES)
    words, pw = np.cumsum(words), np.cumsum(pw, dtype=np.int64)
    return Part(words, pw, _unsteps(pb, np.bincount(pw, minlength=len(words))), c.astype(np.float64), np.cumsum(contexts), bits)


_SENT = "slice int, part int, contexts binary, sums binary, numbers binary"
_REPLY = "part int, turn int, slice int, sums binary"


def _sent(number: int, slices: int, contexts: np.ndarray, sums: list[np.ndarray], numbers: list[float]) -> pd.DataFrame:
    """A part's sums of its contexts, which rise, by range of contexts; the parent's numbers go with the first range."""
    at = ((contexts >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
    cut = np.searchsorted(at, np.arange(slices + 1))
    rows = []
    for k, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if hi > lo or not k:
            flat = np.concatenate([x[lo:hi] for x in sums])
            rows.append((k, number, _pack_planes(np.diff(contexts[lo:hi], prepend=np.uint64(0))), _pack_planes(flat.astype("<i8")), np.array(numbers if not k else [], dtype="<f8").tobytes()))
    return pd.DataFrame(rows, columns=["slice", "part", "contexts", "sums", "numbers"])


def _replied(sent: DataFrame, turn: int) -> tuple[DataFrame, list[float]]:
    """What each part gets back, the sums of its contexts over all parts, and the sums of the numbers."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        contexts = [np.cumsum(_unpack_planes(x, "<u8")[0]) for x in pdf.contexts]
        sums = [_unpack_planes(x, "<i8")[0] for x in pdf.sums]
        size = [len(x) for x in contexts]
        kinds = max(len(x) // n for x, n in zip(sums, size, strict=True) if n) if any(size) else 0
        every, at = np.unique(np.concatenate(contexts), return_inverse=True)
        added = [np.bincount(at, np.concatenate([x.reshape(kinds, -1)[j] for x in sums]), len(every)).astype("<i8") for j in range(kinds)]
        stop = np.cumsum(size)
        rows = [(p, turn, k, _pack_planes(np.concatenate([x[at[hi - n : hi]] for x in added]))) for p, k, n, hi in zip(pdf.part.tolist(), pdf.slice.tolist(), size, stop.tolist(), strict=True) if n]
        numbers = [np.frombuffer(x, "<f8") for x in pdf.numbers if x]
        rows += [(-1, turn, 0, sum(numbers).tobytes())] if numbers else []
        return pd.DataFrame(rows, columns=["part", "turn", "slice", "sums"])

    found = materialise(sent.groupBy("slice").applyInPandas(total, _REPLY), "replies")
    released(sent.sparkSession)
    numbers = [np.frombuffer(bytes(r.sums), "<f8") for r in found.filter("part = -1").select("sums").collect()]
    return found.filter("part >= 0"), (sum(numbers).tolist() if numbers else [])


def _own(part: Part, replies: pd.DataFrame, numbers: list[list[float]]) -> Sums:
    """The sums that a part has got back in the turns so far."""

    def got(turn: int, size: int) -> np.ndarray:
        rows = replies[replies.turn == turn].sort_values("slice")
        kinds = (2, 1, SAMPLES)[turn]
        return np.concatenate([np.zeros((kinds, 0)), *(_unpack_planes(x, "<i8")[0].reshape(kinds, -1) for x in rows.sums)], axis=1).reshape(kinds, size)

    (words, tokens, up, top), *later = numbers
    customers, start = got(0, len(part.contexts))
    sums = Sums(words, tokens, customers, [(start, up, top)])
    if later:
        busy, tables = part.busy(), start.copy()
        tables[busy] += got(1, len(busy))[0]
        sums.sweeps.append((tables, *later[0]))
    if len(later) > 1:
        sums.sweeps += [(start + x, *later[1][2 * j : 2 * j + 2]) for j, x in enumerate(got(2, len(part.contexts)))]
    return sums


def fitted(parts: DataFrame, slices: int, bits: int) -> tuple[DataFrame | None, list[list[float]]]:
    """The replies of the counts, of the burn-in sweep and of the samples, each exact before the next begins, and the parent's numbers."""

    def counts(frames):
        for pdf in frames:
            for number, blob in zip(pdf.part, pdf.blob, strict=True):
                part = _opened(blob, bits)
                t, up, top = next(part.sweeps(None, 0))
                size = len(part.contexts)
                yield _sent(number, slices, part.contexts, [np.bincount(part.pb, part.c, size), np.bincount(part.pb, t, size)], [top.sum(), part.c.sum(), up.sum(), top.sum()])

    def swept(turn: int, numbers: list[list[float]]):
        def values(replies: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            part = _opened(own.blob.iloc[0], bits)
            every = part.sweeps(_own(part, replies, numbers), 1 if turn == 1 else SAMPLES + 1)
            start, size, at = next(every)[0], len(part.contexts), part.busy() if turn == 1 else slice(None)
            sums, ends = [], []
            for sweep, (t, up, top) in enumerate(every, 1):
                if sweep >= turn:
                    sums.append(np.bincount(part.pb, t - start, size)[at])
                    ends += [up.sum(), top.sum()]
            return _sent(int(own.part.iloc[0]), slices, part.contexts[at], sums, ends)

        return values

    replies, first = _replied(parts.select("part", "blob").mapInPandas(counts, _SENT), 0)
    if not first:
        return None, []
    numbers = [first]
    for turn in (1, 2):
        sent = replies.groupBy("part").cogroup(parts.select("part", "blob").groupBy("part")).applyInPandas(swept(turn, numbers), _SENT)
        more, ends = _replied(sent, turn)
        replies, numbers = replies.union(more), [*numbers, ends]
    return replies, numbers


#: Logarithms are summed in whole multiples of this, so that no sum depends on the order.
UNIT = 2.0**-32
_SUM = "block long, hot boolean, word long, sums binary"


def _per_doc(doc: np.ndarray, model: np.ndarray, base: np.ndarray, known: np.ndarray) -> bytes:
    """Entries as sums for each document that has some."""
    there = np.flatnonzero(np.bincount(doc))
    add = lambda x: np.bincount(doc, x)[there].astype("<i8")
    return _pack_planes(there.astype("<u2"), add(model), add(base), add(known))


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from rows not held out."""
    size = docs.agg(F.sum(F.octet_length(utf8(text_col)).cast("long")).alias("n")).first().n or 0
    count, bits = max(1, -(-size // PART_BYTES)), key_bits(size)
    # one part per partition: hashing so few numbers would put several parts' blobs into one task
    dealt = blocks(docs, held_out, count, id_col, text_col).repartitionById(count, F.col("part"))
    schema = "kind int, part int, word long, block long, blob binary, entries binary"

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = pdf[pdf.kind.isin((0, 3))][["kind", "part", "word", "block", "blob"]].assign(entries=None)
        both = _merged(pdf)
        return kept if both is None else pd.concat([kept, pd.DataFrame({"kind": [1], "part": [pdf.part.iloc[0]], "word": [0], "block": [0], "blob": [both[0]], "entries": [both[1]]})])

    rows = materialise(dealt.groupBy("part").applyInPandas(gathered, schema), "parts")
    del dealt
    released(docs.sparkSession)
    parts = rows.filter("kind = 1")
    replies, numbers = fitted(parts, min(count, 16 + count // 8), bits)
    released(docs.sparkSession)

    def scored(replies: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        part = _opened(own.blob.iloc[0], bits)
        entries, sums = own.entries.iloc[0], _own(part, replies, numbers)
        at, sizes, pair, doc, n, hot_block, hot_word, hot_sizes, hot_pair = _unpack_planes(entries, *_ENTRIES)
        pair = np.cumsum(pair, dtype=np.int64)
        kept = list(part.sweeps(sums, SAMPLES + 1))[2:]
        model = sums.log10(part.pb, part.c, [t for t, _, _ in kept], [x[part.pw] for _, x, _ in kept], [x[part.pw] for _, _, x in kept])
        model, base = np.rint(model / UNIT), np.rint(np.log10(part.count + 1) / UNIT)[part.pw]
        known = (part.count > 0)[part.pw]
        stop = np.cumsum(sizes.astype(np.int64))
        cold = [_per_doc(doc[lo:hi], n[lo:hi] * model[p], n[lo:hi] * base[p], n[lo:hi] * known[p]) for lo, hi in zip((stop - sizes).tolist(), stop.tolist(), strict=True) for p in [pair[lo:hi]]]
        stop = np.cumsum(hot_sizes.astype(np.int64))
        hot = [_pack_planes(model[p].astype("<i8"), base[p[:1]].astype("<i8"), known[p[:1]].astype("u1")) for lo, hi in zip((stop - hot_sizes).tolist(), stop.tolist(), strict=True) for p in [hot_pair[lo:hi]]]
        return pd.DataFrame({"block": np.concatenate([at, hot_block]), "hot": [False] * len(cold) + [True] * len(hot), "word": np.concatenate([np.zeros(len(cold), dtype=np.int64), hot_word]), "sums": cold + hot})

    words, tokens = map(int, numbers[0][:2]) if numbers else (0, 0)
    offset = float(np.log10(tokens + words + 1))

    def joined(key, found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        ids, null, held, n = _unpack_planes(own.blob[own.kind == 0].iloc[0], "<i8", "u1", "u1", "<u4")
        total = np.zeros((3, len(ids)), dtype=np.int64)
        for blob in found.sums[~found.hot]:
            at, *values = _unpack_planes(blob, "<u2", "<i8", "<i8", "<i8")
            total[:, at] += np.stack(values)
        states = dict(zip(found.word[found.hot].tolist(), found.sums[found.hot], strict=True))
        for r in own[own.kind == 3].itertuples():
            place, doc, m = _unpack_planes(r.blob, "<u4", "<u2", "<u2")
            model, base, known = _unpack_planes(states[r.word], "<i8", "<i8", "u1")
            m = m.astype(np.int64)
            for row, x in zip(total, (m * model[place], m * base[0], m * int(known[0])), strict=True):
                np.add.at(row, doc, x)
        out = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "held_out": held.astype(bool), "n_tokens": n.astype(np.int64), "n_known": total[2], "train_tokens": tokens, "base_score": total[1] * UNIT - n * offset, "score": total[0] * UNIT})
        return out.assign(doc_id=out.doc_id.mask(null.astype(bool)))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if replies is None:
        return docs.sparkSession.createDataFrame([], schema)
    found = replies.groupBy("part").cogroup(parts.select("part", "blob", "entries").groupBy("part")).applyInPandas(scored, _SUM)
    return found.groupBy("block").cogroup(rows.filter("kind <> 1").select("kind", "word", "block", "blob").groupBy("block")).applyInPandas(joined, schema)


def op10_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), (remainder("doc_id", 7) == 2).alias("held_out"))
