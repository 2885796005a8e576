"""The corpus operators against brute force, on small tables with nulls, ties, copies, empty and very long texts."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("tessella.llm")
from tessella.llm import chaining, decontamination, language, mih, packing, pii, pitman_yor, quality, sharding, simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, grade int"
RNG = np.random.default_rng(3)
WORDS = ["".join(RNG.choice(list("abcdefghij"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    passage, long = prose(70, 99), prose(9000, 98)
    texts = [prose(40 + k, k) for k in range(20)] + [None, "", " \t", "one", "one two", long, long + " tail", prose(30, 7) + " " + passage + " " + prose(30, 8), prose(30, 9) + " " + passage]
    texts += [texts[3], texts[3], "ÜBER größe 😀 mail me a.b@c.de and +1 (017) 555-7713 now", "card 4111 1111 1111 1111 ip 1.2.3.4 999.1.1.1", 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"']
    out = [(k, t, "en" if k % 2 else None, "s", None, k, None) for k, t in enumerate(texts)]
    return [*out, (3, texts[3], None, "again", 1, 1, 1), (None, texts[5], "en", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def test_simhash(docs, empty, rows):
    got = sorted(simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect(), key=repr)
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(fps):
        least[root(i)].append(d)
    want = [(d, f - 2**64 if f >= 2**63 else f, min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, f) in enumerate(fps)]
    assert [tuple(r) for r in got] == sorted(want, key=repr) or sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert simhash.near_duplicates(empty).count() == 0


def test_trie_pairs_are_complete():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6))]))
    found = {(int(i), int(j)) for a, b in simhash.linked_pairs(near, near, True, [(64, 2)], leaf=2, chunk=16) for i, j in zip(a, b, strict=True)}
    assert found == {(i, j) for i in range(len(near)) for j in range(i + 1, len(near)) if int(near[i] ^ near[j]).bit_count() <= 2}


def test_subtree_pairs_cover_every_link(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 3000, dtype=np.int64)
    every = np.unique(np.concatenate([base, base[:200] ^ (1 << 62), base[:200] ^ 5]))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in every], "fp long"), [(64, 2)]).collect()
    assert len(edges) == 400 and len(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()) == 400


def test_similar_sets_meet_with_the_stated_chance():
    rng = np.random.default_rng(71)
    bits = rng.random((3000, simhash.CODE, 64)) < simhash.differing(simhash.LEAST)
    apart = np.packbits(bits, axis=2, bitorder="little").view("<u8")[..., 0]
    for n in (10, 5000, 1 << 18, 1 << 27):
        path, steps = simhash.budgets(n)
        met = np.zeros(3000, dtype=bool)
        for t in range(simhash.TABLES):
            x, turn = apart[:, t // 2], np.uint64(32 * (t % 2))
            x = (x << turn | x >> np.uint64(64) - turn) if turn else x
            x >>= np.uint64(simhash.TABLE_BITS)
            met |= np.logical_and.reduce([np.bitwise_count(x >> np.uint64(64 - d)) <= e for d, e in steps])
        assert met.mean() > simhash.RECALL - 0.01 and steps[1][0] == simhash.TABLE_BITS + path


def brute_kept(texts, least=0.8):
    """The smallest id of each group of similar texts."""
    sets = [set(simhash.shingles(t.encode()).tolist()) for t in texts]
    by = collections.defaultdict(list)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, s in enumerate(sets):
        shared = collections.Counter(i for x in s for i in by[x])
        for i, n in shared.items():
            if n / (len(s) + len(sets[i]) - n) >= least and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in s:
            by[x].append(j)
    return {find(i) for i in range(len(texts))}


def test_every_link_among_texts_with_much_in_common_is_found(spark):
    common, texts = [f"c{i}" for i in range(114)], []
    for k in range(300):  # of 135 shingles each all share 110 (similarity 0.69), the two of a pair 120 (0.8)
        texts += [" ".join([*common, *(f"p{k}w{i}" for i in range(10)), *(f"s{k}{x}w{i}" for i in range(15))]) for x in "ab"]
    assert len(simhash.shingles(texts[0].encode())) == 135 and len(brute_kept(texts)) == 300
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.similar_dropped(table).collect()} == brute_kept(texts)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(72)
    common, texts = [f"c{i}" for i in range(60)], []
    for k in range(40):  # families around one frequent text, each a chain whose ends are not similar
        own = common + [f"f{k}w{i}" for i in range(int(rng.integers(12, 22)))]
        for step in range(3):
            texts.append(" ".join(own[: len(own) - 4 * step] + [f"s{k}t{step}w{i}" for i in range(int(rng.integers(1, 5)))]))
    texts = [texts[i] for i in rng.permutation(len(texts))]
    monkeypatch.setattr(simhash, "ORDER_DOCS", 40)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_kept(texts)
    for small, block, shared in ((1, 4, 5), (3, 16, 1)):
        for name, value in (("SMALL", small), ("BLOCK", block), ("COMMON", shared)):
            monkeypatch.setattr(simhash, name, value)
        assert {r.doc_id for r in simhash.similar_dropped(table).collect()} == want
    assert 1 < len(want) < 119


def test_parities_bound_what_differs():
    rng = np.random.default_rng(73)
    for _ in range(200):
        every = rng.integers(0, 2**64, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(every, int(rng.integers(0, 400)))) for _ in range(2))
        p, q = simhash.parities(a), simhash.parities(b)
        w = min(len(p), len(q))
        assert np.bitwise_count(simhash.folded(p, w) ^ simhash.folded(q, w)).sum() <= len(np.setxor1d(a, b))


def test_sharding(docs, empty, rows):
    r = sharding.records(docs)
    got = sharding.assign(r, sharding.deal(sharding.slot_stats(r))).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for x in got:
        by[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {(x.doc_id, x["size"], x.text_crc32) for x in got} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows}
    e = sharding.records(empty)
    assert sharding.assign(e, sharding.deal(sharding.slot_stats(e))).count() == 0


def test_rebalance_moves_only_surplus(spark):
    stats = spark.range(200).selectExpr("cast(id as int) vslot", "10 + id % 7 as bytes", "1L as n_rows")
    first = sharding.deal(stats, 4).cache()
    second = {r.vslot: r.shard for r in sharding.rebalance(first, 5, 2).collect()}
    old = {r.vslot: r.shard for r in first.collect()}
    moved = [k for k in old if old[k] != second[k]]
    assert set(second) == set(old) and 0 < len(moved) < 60 and sum(second[k] == 4 for k in moved) > 30


def test_packing(docs, empty, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    want = collections.Counter()
    for d, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            want[d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack(empty, path).count() == 0


def test_tokenizer_equals_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, t = packing.WordTokenizer(path), Tokenizer.from_file(path)
    for text in ("Don't STOP — it's 12.5%!!", "<|endoftext|> x <|ENDOFTEXT|>", "Σίσυφος ΣΑΣ İstanbul", "é é ﬁ ½ 日本語", "a b c\x1cd", "word's '' ''s", "ÀÉÎ straße… (ok);"):
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_local_search_empties_a_bin():
    lengths = [6, 3, 3, 5, 4, 4, 5]
    bins = packing.local_search([[0], [1, 2], [3], [4, 5], [6]], lengths, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7))


def improving_step(bins, lengths, room):
    """By brute force: whether any move, 1-1, 2-1 or 1-2 exchange of two underfull bins raises the sum of squared fills."""
    size = lambda xs: sum(lengths[i] for i in xs)
    some = lambda b, most: [c for n in range(most + 1) for c in itertools.combinations(b, n)]
    for a, b in itertools.permutations([x for x in bins if size(x) < room], 2):
        for give in some(a, 2)[1:]:
            for take in some(b, 2 if len(give) == 1 else 1)[len(give) > 1 :]:
                g = size(give) - size(take)
                if g > 0 and size(b) + g <= room and (size(b) + g) ** 2 + (size(a) - g) ** 2 > size(a) ** 2 + size(b) ** 2:
                    return True
    return False


def test_local_search_ends_where_no_step_is_left():
    rng = np.random.default_rng(41)
    short = 0
    for trial in range(60):
        lengths = rng.integers(1, 30 if trial % 2 else 60, 24).tolist()
        start = packing.best_fit(lengths, 60)
        search = packing.Bins(start, lengths, 60)
        bins = [sorted(b) for b in search.search().members if b]
        assert sorted(i for b in bins for i in b) == list(range(24)) and all(sum(lengths[i] for i in b) <= 60 for b in bins)
        square = lambda bs: sum(sum(lengths[i] for i in b) ** 2 for b in bs)
        assert search.fewest <= len(bins) <= len(start) and square(bins) >= square(start)
        short += len(start) - len(bins)
        assert len(bins) == search.fewest or not improving_step(bins, lengths, 60)
    assert short > 10


def test_local_search_reaches_the_fewest_bins():
    rng = np.random.default_rng(42)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1.2, 4000).astype(int) + 1).tolist()
    start = packing.best_fit(lengths)
    assert len(packing.local_search(start, lengths)) == -(-sum(lengths) // 4096) < len(start)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for k, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_pii_base_spans(spark, docs, empty):
    hard = ["a@b.c@d.e x@y.zcom%foo@bar.com", "1.2.3.4.5.6.7.8 001.02.3.0004 256.1.1.1", "5 1234567890123 4111-1111-1111-1111 4111  1111 1111 1111 0000000000000", "+1234567890 +1-2-3 ++44 (0) 20.7946 0958.", "9" * 30_000, "x" * 30_000 + "@", "😀 é 4111111111111111", "1." * 5000, None, ""]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(hard)], "doc_id long, text string")
    got = {r.doc_id: r["pii"] for r in pii.spans(table).collect()}
    for k, t in enumerate(hard):
        want = [(kind, m.start(), m.end()) for kind, p in BASE.items() for m in re.finditer(p, t or "") if valid(kind, m.group())]
        assert [(s.kind, s.start, s.end) for s in got[k] if s.kind in BASE] == want, k
    assert pii.spans(empty).count() == 0
    text = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert "a.b@c.de" not in text[31] and "<EMAIL>" in text[31] and "<PHONE>" in text[31] and "<CARD>" in text[32] and "<IP>" in text[32]


def test_pii_many_matches_in_one_text(spark):
    import time

    n = 40_000
    text = "".join(f"é{k}@b.c 😀 " for k in range(n)) + "end"
    table = spark.createDataFrame([(1, text), (2, "x@y.zz")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r.spans for r in pii.spans(table).select("doc_id", "pii.start", "pii.end").selectExpr("doc_id", "arrays_zip(start, end) spans").collect()}
    new = {r.doc_id: r.text for r in pii.redacted(table).collect()}
    assert time.perf_counter() - began < 30
    assert [(s.start, s.end) for s in got[1]] == [(m.start(), m.end()) for m in re.finditer(BASE["email"], text)]
    assert new == {1: re.sub(BASE["email"], "<EMAIL>", text), 2: "<EMAIL>"}


def test_pii_redaction_of_overlapping_spans(spark):
    text = "a " * 3000 + "+1 (017) 555-7713 1.2.3.4 " + "é😀" * 2000 + " x@y.zz"
    table = spark.createDataFrame([(1, text, "own")], "doc_id long, text string, pii string")
    row = pii.redacted(table).first()
    assert row.pii == "own" and row.text == "a " * 3000 + "<PHONE> " + "é😀" * 2000 + " <EMAIL>"


def test_pii_labelers_are_estimated():
    rng = np.random.default_rng(31)
    hit, false, share = np.array([0.9, 0.8, 0.7, 0.85, 0.95]), np.array([0.1, 0.3, 0.2, 0.05, 0.5]), 0.3
    true = rng.random(20_000) < share
    votes = rng.random((20_000, 5)) < np.where(true[:, None], hit, false)
    mute = rng.random((20_000, 5)) < 0.2
    names = ["secret:" + "".join("-" if m else "01"[v] for v, m in zip(x, y, strict=True)) for x, y in zip(votes.tolist(), mute.tolist(), strict=True)]
    counts = collections.Counter(names)
    post = pii.reliabilities(counts)
    prior, got_hit, got_false = pii.estimate(counts, post)
    assert abs(prior["secret"] - share) < 0.03 and np.abs(np.array(got_hit) - hit).max() < 0.05 and np.abs(np.array(got_false) - false).max() < 0.05
    truth = collections.defaultdict(list)
    for n, t in zip(names, true.tolist(), strict=True):
        truth[n].append(t)
    assert all(abs(np.mean(t) - post[n]) < 0.1 for n, t in truth.items() if len(t) > 300)

    def objective(rates):  # the logarithm of the posterior density, by brute force
        prior, hit, false = rates
        total = sum(a * math.log(x) + b * math.log(1 - x) for xs, a, b in ((prior.values(), 1, 1), (hit, 2, 1), (false, 1, 2)) for x in xs)
        for p, n in counts.items():
            yes, no = prior["secret"], 1 - prior["secret"]
            for v, h, f in zip(p.split(":")[1], hit, false, strict=True):
                yes, no = yes * {"1": h, "0": 1 - h, "-": 1}[v], no * {"1": f, "0": 1 - f, "-": 1}[v]
            total += n * math.log(yes + no)
        return total

    steps = [objective(pii.estimate(counts, pii.reliabilities(counts, n))) for n in (0, 1, 2, 5, 20, 100)]
    assert all(b >= a - 1e-6 for a, b in zip(steps, steps[1:], strict=False))


def test_pii_adds_planted_secrets(spark):
    rng = np.random.default_rng(32)
    hexa = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    mixed = lambda n: "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"), n)) + "7aB"
    rows, want = [], {}
    for k in range(400):
        body, span = prose(30, 5000 + k), None
        if k % 4 == 0:
            span = hexa(40) if k % 8 else mixed(33)
            body += f' {["token", "api_key", "see"][k % 3]} = "{span}" and so on'
        elif k % 4 == 1:
            body += f" order {rng.integers(10**15, 10**16)} pages and part_number_{rng.integers(10**6)}_of_many"
        elif k % 4 == 2:
            body += f" /2024/report-2024-01-0{k % 9}-final-version2.html"
        rows.append((k, body))
        want[k] = [(body.index(span), body.index(span) + len(span))] if span else []
    got = {r.doc_id: [(s.start, s.end) for s in r.pii if s.kind == "secret"] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[k] == want[k] for k in want if want[k])
    wrong = sum(got[k] != want[k] for k in want if not want[k])
    assert found >= 95 and wrong <= 3, (found, wrong)


def test_search_recall(spark):
    x = RNG.standard_normal((1500, 32)).astype("float32")
    x[700:720] = x[3]
    bad = [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [None] * 32), (None, [1.0] * 32)]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + bad, "vec_id long, embedding array<float>")
    got = mih.search(table, table.filter("vec_id % 100 = 0 OR vec_id = 705")).collect()
    hit = total = 0
    for q in [*range(0, 1500, 100), 705]:
        dist = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        dist[q] = np.inf
        top = np.lexsort((np.arange(1500), dist))[:10]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        hit += len(set(mine) & set(top.tolist()))
        total += 10
        if q == 705:
            assert mine == top.tolist()
    assert hit / total >= 0.9
    assert mih.search(table.limit(0), table.limit(0)).count() == 0


def test_search_repeated_queries(spark):
    x = np.random.default_rng(15).standard_normal((300, 16))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    one, other = table.filter("vec_id = 100"), table.filter("vec_id = 200").selectExpr("100L AS vec_id", "embedding")
    want = sorted((r["rank"], r.vec_id) for r in mih.search(table, one).collect())
    assert len(want) == 10
    assert sorted((r["rank"], r.vec_id) for r in mih.search(table, one.union(one)).collect()) == want
    both = sorted((r["rank"], r.vec_id) for r in mih.search(table, one.union(other).union(one)).collect())
    assert both == sorted(want + [(r["rank"], r.vec_id) for r in mih.search(table, other).collect()])


def test_search_repeated_ids(spark):
    rng = np.random.default_rng(17)
    x = rng.standard_normal((60, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    twin = [(0, x[0].tolist())] * 14 + [(70, x[0].tolist())] * 3 + [(0, x[1].tolist())] * 2 + [(5, x[9].tolist())]
    table = spark.createDataFrame(rows + twin, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in mih.search(table, table.filter("vec_id = 0"), k=4).collect())
    every = {(k, tuple(v)) for k, v in rows + twin if k}
    want = []
    for y in (x[0], x[1]):
        near = sorted((float(np.sqrt(((np.array(v) - y) ** 2).sum())), k) for k, v in every)[:4]
        want += [(n + 1, k, d) for n, (d, k) in enumerate(near)]
    assert got == sorted(want) and (1, 70, 0.0) in got


def test_search_opens_few_buckets_where_vectors_cluster():
    rng = np.random.default_rng(18)
    centres = rng.standard_normal((400, 32)) * 4
    x = np.repeat(centres, 20, axis=0) + 0.3 * rng.standard_normal((8000, 32))
    model = mih.learn(x)
    queries = np.arange(0, 8000, 400)
    assert mih.reached(model, x, queries) < 0.5
    index, codes, hit = mih.Index(mih.encode(model, x)), mih.encode(model, x), 0
    for q in queries:
        dist = ((x - x[q]) ** 2).sum(axis=1)
        dist[q] = np.inf
        got = index.nearest(codes[q], 10, model, np.arange(8000) == q)
        hit += len(set(got[np.argsort(dist[got])[:10]].tolist()) & set(np.argsort(dist)[:10].tolist()))
    assert hit / (10 * len(queries)) >= 0.9


def test_decontamination(spark, empty):
    items = [(k, prose(20 + k, 500 + k)) for k in range(12)]
    edited = items[4][1].split()
    edited[5], edited[15] = "zzz", "yyy"
    texts = [prose(60, 600) + " " + items[2][1].upper() + ", " + prose(50, 601), " ".join(["pre", *edited, "post"]), prose(100, 602), None, "", " ".join(items[7][1].split()[:8])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*items, (99, None), (98, "zz yy"), (97, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(table, bench).collect()} == {(0, 2), (1, 4)}
    assert decontamination.leaks(table, bench.limit(0)).count() == 0 and decontamination.leaks(empty, bench).count() == 0


def test_decontamination_finds_edited_copies(spark):
    item = [f"w{k}" for k in range(40)]
    edited = ["zzz" if k % 5 == 4 else w for k, w in enumerate(item)]
    texts = [prose(50, 603) + " " + " ".join(edited) + " " + prose(50, 604), *[" ".join(item)] * 3, " ".join(item[:20])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id: r.score for r in decontamination.leaks(table.filter("doc_id = 0"), bench).collect()} == {0: 25 / 40}
    assert {r.doc_id for r in decontamination.leaks(table, bench).collect()} == {0, 1, 2, 3}


def edited(rng, words, cost):
    """A copy of words with edits of the given total cost: replaced and dropped words cost 2, new ones 1."""
    out = list(words)
    while cost > 0:
        at, kind = int(rng.integers(0, len(out) + 1)), int(rng.integers(0, 3))
        if kind == 0 or cost == 1:
            out.insert(at, f"n{rng.integers(1 << 30)}")
            cost -= 1
        elif at < len(out):
            out[at : at + 1] = [f"n{rng.integers(1 << 30)}"] if kind == 1 else []
            cost -= 2
    return out


def smith_waterman(a, b):
    h = [0] * (len(b) + 1)
    best = 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, h[j] + (1 if x == y else -1), h[j + 1] - 1, row[j] - 1))
        h, best = row, max(best, *row)
    return best


def test_decontamination_equals_full_alignment(spark):
    rng = np.random.default_rng(21)
    items = [[f"w{x}" for x in rng.integers(0, 60, n)] for n in (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 15, 20, 25, 30, 40, 60)] + [["w1", "w2"] * 8]
    docs = [[f"w{x}" for x in rng.integers(0, 60, 40)] for _ in range(6)]
    for item in items[3:]:
        for share in (0.1, 0.2, 0.3, 0.4, 0.45):
            copy = edited(rng, item, round(share * len(item)))
            docs.append([*(f"w{x}" for x in rng.integers(0, 60, rng.integers(0, 9))), *copy, *(f"w{x}" for x in rng.integers(0, 60, rng.integers(0, 9)))])
    docs += [[], items[17] * 2, items[2] + ["x"] * 3000 + items[16]]
    want = {(d, i): smith_waterman(item, doc) / len(item) for d, doc in enumerate(docs) for i, item in enumerate(items) if doc}
    want = {k: v for k, v in want.items() if v >= 0.6 - 1e-9}
    table = spark.createDataFrame([(k, " ".join(d).upper()) for k, d in enumerate(docs)] + [(0, " ".join(docs[0])), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, ", ".join(i)) for k, i in enumerate(items)] + [(3, ", ".join(items[3]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(table, bench).collect()}
    assert got == pytest.approx(want) and len({d for d, _ in want}) > 50


def test_decontamination_bound_is_never_below_the_score():
    rng = np.random.default_rng(10)
    for _ in range(300):
        a, b = rng.integers(1, 9, rng.integers(1, 12)), rng.integers(0, 9, rng.integers(1, 12))
        assert decontamination.bound(a, b) >= decontamination.align(a, b)[0]


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = rng.integers(1, 4, rng.integers(1, 9)), rng.integers(1, 4, rng.integers(1, 9))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontamination.align(a, b)[0] == h.max()


def test_chaining(docs, empty):
    got = {frozenset((r.doc_id, r.other_id)) for r in chaining.passages(docs).collect()}
    assert frozenset((27, 28)) in got and frozenset((25, 26)) in got
    assert chaining.passages(empty).count() == 0


def test_chain_is_cut_into_its_passages(spark):
    one, two = prose(60, 700), prose(60, 701)
    for gap, other in ((100, 100), (120, 160)):
        texts = [one + " " + prose(gap, 702) + " " + two, one + " " + prose(other, 703) + " " + two]
        got = chaining.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        assert sorted(sorted([(r.start, r.end), (r.other_start, r.other_end)]) for r in got) == [[(0, 60), (0, 60)], [(60 + min(gap, other), 120 + min(gap, other)), (60 + max(gap, other), 120 + max(gap, other))]]
        assert all(r.identity == 1 for r in got)


def test_chaining_finds_short_fuzzy_passages(spark):
    rng = np.random.default_rng(12)
    texts = []
    for k in range(60):
        own = [f"p{k}w{i}" for i in range(50)]
        where = range(4, 49, 5) if k % 3 == 0 else rng.choice(np.arange(1, 49), 5 if k % 3 == 1 else 8, replace=False)
        other = [f"q{k}r{i}" if i in set(where) else w for i, w in enumerate(own)]
        texts += [prose(30, 800 + k) + " " + " ".join(own) + " " + prose(30, 900 + k), prose(30, 1000 + k) + " " + " ".join(other) + " " + prose(30, 1100 + k)]
    got = {frozenset((r.doc_id // 2, r.other_id // 2)) for r in chaining.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r.doc_id // 2 == r.other_id // 2}
    assert got == {frozenset((k,)) for k in range(60)}


def test_chaining_meets_where_parts_stand_in_earlier_documents(spark):
    texts = []
    for k in range(50):
        own = [f"p{k}w{i}" for i in range(60 if k % 2 else 120)]
        for i in range(0, len(own), 20):  # each part stands in an earlier document, some also between the two
            texts.append((1000 * k + i, prose(30, 6000 + k) + " " + " ".join(own[i : i + 20]) + " " + prose(30, 6100 + k + i)))
        texts.append((1000 * k + 500, prose(25, 6300 + k) + " " + " ".join(own) + " " + prose(25, 6400 + k)))
        texts.append((1000 * k + 600, prose(25, 6500 + k) + " " + " ".join(own[20:40])))
        texts.append((1000 * k + 700, prose(25, 6600 + k) + " " + " ".join(own) + " " + prose(25, 6700 + k)))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    for dealt in (table.coalesce(1), table.repartition(7)):
        got = {frozenset((r.doc_id, r.other_id)) for r in chaining.passages(dealt).collect()}
        assert got >= {frozenset((1000 * k + 500, 1000 * k + 700)) for k in range(50)}
        assert all(len({x % 1000 for x in pair} & {500, 700}) == 2 for pair in got)


def test_each_seed_is_matched_to_the_first_it_shares_most_with():
    rng = np.random.default_rng(43)
    for _ in range(30):
        seed, doc = rng.integers(0, 4, 40).astype(np.uint64), rng.integers(0, 9, 40)
        key = sum(rng.integers(0, 3, 40).astype(np.uint32) << np.uint32(8 * j) for j in range(3))
        got = chaining.earlier(seed, key, doc)
        for i in range(40):
            want = -1
            for level in range(3, -1, -1):
                same = [j for j in range(40) if seed[j] == seed[i] and int(key[j]) >> 8 * (3 - level) == int(key[i]) >> 8 * (3 - level)]
                if doc[same[0]] != doc[i]:
                    want = same[0]
                    break
            assert got[i] == want


def classes(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("minor", [0, 2, 16])
def test_chaining_loses_no_link(spark, monkeypatch, minor):
    rng = np.random.default_rng(44)
    lines, parts, texts = [prose(20, 7000 + k) for k in range(3)], [], []
    for k in range(12):  # copies that differ in every fifth word; what they share stands in other, earlier documents and in lines of all
        own = [f"p{k}w{i}" for i in range(54)]
        if k % 3 == 0:
            own[20:40] = lines[0].split()
        other = [f"q{k}r{i}" if i % 5 == 4 else w for i, w in enumerate(own)]
        parts += [" ".join(own[i : i + 4]) for i in range(0, 54, 5)]
        texts += [" ".join([prose(30, 7100 + k), " ".join(x), prose(30, 7200 + 20 * k + j)]) for j, x in enumerate((own, other))]
    rng.shuffle(parts)
    early = [" ".join(f"{prose(25, 7500 + 9 * k + j)} {x}" for j, x in enumerate(parts[k::40])) for k in range(40)]
    texts = [f"{t} {lines[k % 3]} {prose(9, 7900 + k)} {lines[0]}" for k, t in enumerate(early + texts)]
    words = [np.array(chaining.hashes(t.encode().split()), dtype=np.uint64).astype("<u4") for t in texts]
    want = [(a, b) for b in range(len(texts)) for a in range(b) if chaining.linked(words[b], words[a])]
    assert set(want) >= {(40 + 2 * k, 41 + 2 * k) for k in range(12)} and len(set(classes(len(texts), want))) > 40
    monkeypatch.setattr(chaining, "MINOR", minor)
    monkeypatch.setattr(chaining, "CHUNK", 20)
    got = chaining.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)).collect()
    assert all(r.identity >= chaining.SAME and min(r.end - r.start, r.other_end - r.other_start) >= chaining.LEAST for r in got)
    assert classes(len(texts), [(r.doc_id, r.other_id) for r in got]) == classes(len(texts), want)


def test_met_lists_or_leaves_every_start_of_a_match():
    rng = np.random.default_rng(45)
    for _ in range(60):
        seed, before, root = np.sort(rng.integers(0, 6, 50)), rng.choice([1, 1, 1, 1, 2, 3], 50), rng.integers(0, 5, 50)
        i, j, rest, odd = chaining.met(seed, before, root, int(rng.integers(0, 5)))
        got = {frozenset(x) for x in zip(i.tolist(), j.tolist(), strict=True)}
        assert len(got) == len(i)
        for a in range(50):
            for b in range(a):
                if seed[a] == seed[b] and root[a] != root[b] and before[a] != before[b]:
                    assert (frozenset((a, b)) in got) != (rest[a] >= 0 and rest[a] == rest[b] and (odd[a] or odd[b]))
                else:
                    assert frozenset((a, b)) not in got


def test_windows_of_a_passage_may_link():
    rng = np.random.default_rng(46)
    for _ in range(200):
        n, side = int(rng.integers(50, 100)), chaining.WIDE
        x, y = (rng.integers(1, 40, 2 * side).astype("<u4") for _ in range(2))
        start = int(rng.integers(side - n + 4, side + 1))
        y[start : start + n] = x[start : start + n]
        y[rng.choice(np.setdiff1d(np.arange(start, start + n), np.arange(side, side + 4))[: n - 4], int(0.2 * n), replace=False)] = 99
        assert chaining.may_link(chaining.contexts([x]), chaining.contexts([y]))[0, 0] and chaining.best_shared(x[None], y[None])[0] >= 0


def test_chaining_meets_in_runs_of_one_word(spark):
    texts = [" ".join([prose(20, 8000), *["the"] * 51, prose(20, 8001)]), " ".join([*["the"] * 229, prose(20, 8002)]), " ".join([prose(20, 8003), *["the"] * 30])]
    got = chaining.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in got} == {frozenset((0, 1))} and all(r.identity >= chaining.SAME for r in got)


def test_repeated_seeds_are_counted():
    rng = np.random.default_rng(47)
    for _ in range(40):
        ends = np.cumsum(rng.integers(0, 80, 5))
        place, seed = chaining.kmers(rng.integers(0, int(rng.integers(1, 4)), ends[-1]).astype(np.uint64), ends)
        doc, reach, last, want = np.searchsorted(ends, place, side="right"), int(rng.integers(1, 60)), {}, []
        for x in zip(seed.tolist(), doc.tolist(), place.tolist(), strict=True):
            at, n = last.get(x[:2], (-100, -1))
            last[x[:2]] = x[2], n + 1 if x[2] - at <= reach else 0
            want.append(last[x[:2]][1])
        assert chaining.repeats(seed, doc, place, reach).tolist() == want


def test_bounds_of_ordered_words():
    rng, side, run = np.random.default_rng(48), chaining.WIDE, lambda *x: np.concatenate([np.repeat(np.uint32(w), n) for w, n in x]).astype("<u4")
    for _ in range(300):
        n = int(rng.integers(50, 100))
        x, y = (rng.integers(1, 40, 2 * side).astype("<u4") for _ in range(2))
        start = int(rng.integers(side - n + 4, side + 1))
        own = np.setdiff1d(np.arange(start, start + n), np.arange(side, side + 4))
        y[start : start + n] = x[start : start + n]
        for at in np.sort(rng.choice(own, int(0.2 * n), replace=False))[:: int(rng.integers(1, 3))]:  # words differ or are left out, towards the ends
            if rng.random() < 0.5:
                y[at] = 99
            elif at < side:
                y[1 : at + 1] = y[:at].copy()
            else:
                y[at:-1] = y[at + 1 :].copy()
        assert chaining.best_aligned(x[None], y[None])[0] >= 0 and chaining.best_aligned(y[None], x[None])[0] >= 0
    x, y = run((9, side), (1, 45), (2, side - 45)), run((8, side), (1, 10), (3, 9), (1, 10), (4, side - 29))
    assert chaining.best_shared(x[None], y[None])[0] >= 0 > chaining.best_aligned(x[None], y[None])[0]


def test_texts_without_a_passage_are_not_chained(monkeypatch):
    rng, texts = np.random.default_rng(49), []
    for k in range(40):
        words = np.repeat(rng.integers(0, 6, 12), rng.integers(1, 45, 12)) + rng.integers(0, 2, 1) * 3
        texts.append(np.where(rng.random(len(words)) < 0.1, 100 + k, words).astype("<u4"))
    pairs = [(x, y) for x in texts for y in texts[:8] if x is not y]
    got = [chaining.linked(x, y) for x, y in pairs]
    with monkeypatch.context() as m:
        m.setattr(chaining, "may_hold", lambda *a: True)
        assert got == [chaining.linked(x, y) for x, y in pairs] and 0 < sum(map(bool, got)) < len(got)
    monkeypatch.setattr(chaining, "chains", None)
    assert chaining.linked(np.r_[[1] * 42, [2] * 42].astype("<u4"), np.r_[[3] * 47, [1] * 47, [4] * 47].astype("<u4")) == []


def test_thinned_matches_cover_the_same_words():
    rng = np.random.default_rng(13)
    for _ in range(50):
        at = np.flatnonzero(rng.random(60) < 0.7)
        a, b = np.concatenate([at, at]), np.concatenate([at + 3, at + 9])
        kept = chaining.thinned(a, b)
        words = lambda x, y: {(p + i, q + i) for p, q in zip(x.tolist(), y.tolist(), strict=True) for i in range(chaining.K)}
        assert words(a[kept], b[kept]) == words(a, b) and len(kept) <= len(a)


def test_maximal_segments():
    assert chaining.maximal([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1), (2, 3), (4, 11)]


def test_chain_score_is_best():
    rng = np.random.default_rng(9)
    for _ in range(40):
        a, b = rng.integers(0, 30, 7), rng.integers(0, 30, 7)
        best = 0.0
        for mask in range(1, 128):
            s = sorted((int(a[i]), int(b[i])) for i in range(7) if mask >> i & 1)
            if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(s, s[1:], strict=False)):
                best = max(best, 5 * len(s) - 0.05 * (s[-1][0] - s[0][0] + s[-1][1] - s[0][1]))
        c = chaining.chains(a, b)[0]
        x, y = a[c], b[c]
        assert math.isclose(5 * len(c) - 0.05 * (x[-1] - x[0] + y[-1] - y[0]), best)


def test_language(spark, docs, empty):
    model = language.Classifier({"a": [prose(300, 1).encode()], "b": [prose(300, 1).translate({97: 120, 98: 121}).encode()]})
    assert [x for x, _ in model.predict([prose(40, 2).encode(), None, b"123"])] == ["a", "und", "und"]
    tree = model.trees[0]
    every = (np.uint32(97 << 24 | 98 << 16 | 99 << 8) | np.arange(256, dtype=np.uint32)).astype(np.uint32)
    assert np.exp2(tree.cost(every)).sum() <= 1 + 1e-9
    texts = [b"abc def", b"x" * 5000, "é".encode()]
    together = model.bits(texts)
    assert np.allclose(together, np.concatenate([model.bits([t]) for t in texts]))
    assert language.identify(empty, language.fit(empty)).count() == 0 and language.identify(docs, language.fit(docs)).count() == docs.count()


def test_pitman_yor(docs, empty, rows):
    held = (language.remainder("doc_id", 7) == 2).alias("h")
    got = pitman_yor.score(docs, held).collect()
    tokens = [((t or "").lower().encode().split() + [b"\n"], zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2) for d, t, *_ in rows]
    c = collections.Counter(w for ws, h in tokens if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((len(ws), sum(c[w] > 0 for w in ws), h, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for ws, h in tokens)
    assert sorted((r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert pitman_yor.score(empty, held).count() == 0


def test_pitman_yor_seats_by_the_chinese_restaurant():
    keys = np.random.default_rng(51).integers(0, 2**64, 4000, dtype=np.uint64)
    for customers, weight, d in ((2, 0.3, 0.8), (9, 0.05, 0.8), (60, 1.5, 0.6), (127, 0.2, 0.7), (1000, 0.4, 0.7)):
        chance = np.zeros(customers + 1)  # of each number of tables, one customer after the other
        chance[1] = 1.0
        for k in range(1, customers):
            t = np.arange(customers + 1)
            p = weight / (k - d * t + weight)
            grown = chance * np.clip(p, 0, 1)
            chance = chance - grown
            chance[1:] += grown[:-1]
        t = np.arange(customers + 1)
        mean = (chance * t).sum()
        spread = math.sqrt((chance * t * t).sum() - mean**2)
        got = pitman_yor.seat(np.full(4000, customers, dtype=float), np.full(4000, weight), d, keys)
        assert abs(got.mean() - mean) < max(4 * spread / math.sqrt(4000), 0.01 * mean) and abs(got.std() - spread) < 0.1 * spread + 0.02


def brute_pitman_yor(texts, held, bits, hot=None):
    """The model by dictionaries, customers seated one after the other with the same random numbers."""
    py = pitman_yor
    number = lambda w: xxhash.xxh64_intdigest(w)
    docs = []
    for t in texts:
        ws = [number(w) for w in (t or "").lower().encode().split()] + [int(py.END)]
        docs.append([(w, u >> (64 - bits)) for w, u in zip(ws, [int(py.END), *ws[:-1]], strict=True)])
    c = collections.Counter(x for d, h in zip(docs, held, strict=True) if not h for x in d)
    words, (d, a), (d0, a0) = {w for w, _ in c}, py.LOWER, py.UPPER
    customers = collections.Counter()
    for (_, b), n in c.items():
        customers[b] += n

    def totals(t):
        up, tables = collections.Counter(), collections.Counter()
        for (w, b), n in t.items():
            up[w] += n
            tables[b] += n
        return up, tables

    def seated(n, weight, discount, key):
        t = 1
        for k in range(1, n):
            t += float(py.uniform(np.array([key & 2**64 - 1], dtype=np.uint64), k)[0]) < weight / (k - discount * t + weight)
        return t

    t = dict.fromkeys(c, 1)
    up, tables = totals(t)
    state = [(t, up, dict.fromkeys(words, 1), tables)]
    parent = lambda s, w: (s[1][w] - d0 * s[2].get(w, 0) + (a0 + d0 * sum(s[2].values())) / (len(words) + 1)) / (a0 + sum(s[1].values()))
    for sweep in range(1, py.SAMPLES + 2):
        then, last = state[min(sweep - 1, 1)], state[-1]
        turn = sweep * 0xA0761D6478BD642F & 2**64 - 1
        # the sums are those after the burn-in, the dish's own customers those of the sweep before
        mixed = lambda w: (last[1][w] - d0 * last[2][w] + (a0 + d0 * sum(then[2].values())) / (len(words) + 1)) / (a0 + sum(then[1].values()))  # noqa: E731, B023
        t = {}
        for (w, b), n in c.items():
            key = (((w ^ 0xD6E8FEB86659FD93) * 0xFF51AFD7ED558CCD + b * 0xC4CEB9FE1A85EC53) & 2**64 - 1) ^ turn
            t[w, b] = seated(n, (a + d * then[3][b]) * mixed(w), d, key)
        up, tables = totals(t)
        state.append((t, up, {w: seated(up[w], (a0 + d0 * sum(then[2].values())) / (len(words) + 1), d0, w ^ turn) for w in words}, tables))
    out = []
    for doc in docs:
        total = 0.0
        for w, b in doc:
            p = [(c[w, b] - d * s[0].get((w, b), 0) + (a + d * s[3][b]) * parent(s, w)) / (a + customers[b]) for s in state[2:]]
            total += math.log10(sum(p) / len(p))
        out.append(total)
    return out


def test_pitman_yor_equals_plain_gibbs(spark, monkeypatch):
    rng = np.random.default_rng(52)
    weight = 1 / np.arange(5, 65)  # the first is hot in a block of all texts, and no word has SINGLE tables
    texts = [" ".join(f"W{x}" for x in rng.choice(60, rng.integers(0, 40), p=weight / weight.sum())) for _ in range(80)] + [None, "", "new words only"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    held = (F.col("doc_id") % 5 == 2).alias("h")
    want = brute_pitman_yor(texts, [k % 5 == 2 for k in range(len(texts))], 16)
    for partitions, part_bytes in ((1, 8_000_000), (6, 500), (2, 2_000)):
        monkeypatch.setattr(pitman_yor, "PART_BYTES", part_bytes)
        got = {r.doc_id: r.score for r in pitman_yor.score(table.repartition(partitions), held).collect()}
        assert [got[k] for k in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_pitman_yor_contexts_never_share_a_restaurant(spark):
    first: dict[int, str] = {}
    top = lambda w: xxhash.xxh64_intdigest(w.encode()) >> 48
    one, two = next((first[top(w)], w) for w in map("c{}".format, range(10000)) if first.setdefault(top(w), w) != w)
    # no dish has two customers, so no seat of a context is drawn
    texts = [f"{one} a", f"b {one} d", f"{two} e", f"f {two} g", f"x {one} a {two} a", f"{two} d h"]
    held = [k >= 4 for k in range(len(texts))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score(table, (F.col("doc_id") >= 4).alias("h")).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(brute_pitman_yor(texts, held, 64), rel=1e-9)
    assert brute_pitman_yor(texts, held, 16) != pytest.approx(brute_pitman_yor(texts, held, 64), rel=1e-3)


def test_pitman_yor_adds_up_to_one():
    rng = np.random.default_rng(2)
    pw, pb = np.repeat(np.arange(50), 4), np.tile(np.arange(4), 50)
    part = pitman_yor.Part(np.arange(50, dtype=np.uint64), pw, pb, rng.integers(0, 9, 200).astype(float))
    context = lambda x: np.bincount(pb, x, 4)
    t, up, top = next(part.sweeps(None, 0))
    sums = pitman_yor.Sums(float((part.count > 0).sum()), part.c.sum(), context(part.c), [(context(t), up.sum(), top.sum())])
    for first in (1, 2):
        every = list(part.sweeps(sums, 1 if first == 1 else pitman_yor.SAMPLES + 1))
        sums.sweeps += [(context(t), up.sum(), top.sum()) for t, up, top in every[first:]]
    kept = every[2:]
    for b in range(4):
        at = np.flatnonzero(pb == b)
        p = 10 ** sums.log10(pb[at], part.c[at], [t[at] for t, _, _ in kept], [u[pw[at]] for _, u, _ in kept], [x[pw[at]] for _, _, x in kept])
        seen = part.count > 0
        unknown = 10 ** sums.log10(np.array([b]), np.zeros(1), [np.zeros(1)] * 3, [np.zeros(1)] * 3, [np.zeros(1)] * 3)
        assert math.isclose(p[seen].sum() + unknown[0], 1, rel_tol=1e-6)


def test_quality(spark, empty):
    texts = [(k, prose(60, 900 + k) + (" vile rotten" if k % 5 == 0 else ""), "x") for k in range(300)] + [(1000, None, "x"), (1001, "", "x")]
    table = spark.createDataFrame(texts, "doc_id long, text string, keep string")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(200)] + [(None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(table, quality.graded(labels))
    assert (np.diff(model.t) >= 0).all()
    out = quality.scored(table, model).collect()
    assert len(out) == 302
    wrong = [r for r in out if 200 <= r.doc_id < 300 and r[quality.OUT[2]] == (r.doc_id % 5 == 0)]
    assert len(wrong) <= 5
    none = quality.scored(empty, quality.fit(empty, quality.graded(labels)))
    assert none.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert out and {r.doc_id for r in out} <= docs and len({r.doc_id for r in out}) > len(docs) // 3
    assert hashlib.sha256(repr(sorted(map(tuple, out))).encode()).hexdigest() == hashlib.sha256(repr(sorted(map(tuple, corpus_pipeline.run(spark, d).collect()))).encode()).hexdigest()


def test_pipeline_drops_near_copies_of_similarity_08(spark, docs, empty):
    import corpus_pipeline

    rng = np.random.default_rng(14)
    rows, near = [], 0
    for k in range(60):
        own = [f"p{k}w{i}" for i in range(300)]
        other = list(own)
        for i in rng.choice(300, (3, 6, 12)[k % 3], replace=False):
            other[i] = f"q{k}r{i}"
        a, b = ({tuple(x[i : i + 5]) for i in range(296)} for x in (own, other))
        near += len(a & b) / len(a | b) >= 0.8
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect()}
    assert near >= 40 and len(kept) == 120 - near and kept >= set(range(0, 120, 2))
    assert corpus_pipeline.drop_near_duplicates(spark, empty, "").count() == 0
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    texts = [" ".join((r.text or "").lower().split()) for r in left]
    assert len(texts) == len(set(texts)) and set(texts) | {None} >= {" ".join((prose(40 + k, k)).split()) for k in range(20)}


def test_language_sample_is_the_first_by_hash(spark, monkeypatch):
    from tessella.llm import language as L

    monkeypatch.setattr(L, "SAMPLE_DOCS", 40)
    monkeypatch.setattr(L, "SAMPLE_BYTES", 700)
    monkeypatch.setattr(L, "Classifier", lambda texts: texts)
    rows = [(k, "x" * (k % 50), "ab"[k % 2]) for k in range(300)] + [(7, "x" * 7, "b")] * 3 + [(None, "n", "a"), (1, None, "a"), (2, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hashed = docs.selectExpr("doc_id", "text", "lang", "xxhash64(doc_id) AS h").filter("text IS NOT NULL AND lang IS NOT NULL").collect()
    want = {}
    for lang in "ab":
        seen, size, texts = 0, 0, {}
        for r in sorted((r for r in hashed if r.lang == lang), key=lambda r: (r.h, r.doc_id is not None, r.doc_id or 0)):
            if (r.doc_id, r.text) in texts or (seen < 40 and size < 700):
                texts[r.doc_id, r.text] = r.text.encode()
            seen, size = seen + 1, size + len(r.text)
        want[lang] = sorted(texts.values())
    assert L.fit(docs) == want
    assert L.fit(docs.limit(0)) == {}
