"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns; operators and pipeline stages against plain forms."""

import collections
import contextlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

pytest.importorskip("tessella.llm")
import corpus_pipeline  # noqa: E402
from tessella.llm import chaining, common, decontamination, language, mih, packing, pii, pitman_yor, quality, sharding, simhash  # noqa: E402

DIR = "/root/testdata/sf0.001"
RNG = np.random.default_rng(61)
WORDS = ["".join(RNG.choice(list("abcdefghij"), RNG.integers(2, 8))) for _ in range(400)]
#: Columns with names that an operator might use itself.
CLASH = ["pii", "key", "node", "fp", "row", "item", "seed", "grade", "keep", "expected_grade", "p_top", "h", "i", "l", "n", "c", "at", "vslot", "bytes", "size", "slot", "block", "piece", "held_out", "h1", "code", "root", "version", "_key", "word"]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def texts():
    long = prose(30_000, 1)
    out = [(k, prose(40 + k, k)) for k in range(12)] + [(20, None), (21, ""), (22, " \n\t "), (23, "one"), (24, long), (25, long + " end"), (None, prose(50, 3)), (None, None), (30, "mail a.b@c.de, card 4111 1111 1111 1111")]
    return out + [(3, prose(43, 3)), (3, prose(43, 3)), (3, prose(60, 77))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en" if k and k % 2 else None, "s", len(t) if t else None) for k, t in texts()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *(F.lit(c).alias(c) for c in CLASH))


def bag(df):
    return collections.Counter(map(repr, map(tuple, df.collect())))


def held(n):
    return (language.remainder("doc_id", n) == 2).alias("held_out")


OPERATORS = {
    "simhash": lambda d: simhash.near_duplicates(d),
    "language": lambda d: language.identify(d, language.fit(d)),
    "decontamination": lambda d: decontamination.leaks(d, d.sparkSession.createDataFrame([(1, prose(43, 3)), (2, None), (1, prose(41, 1))], "item_id long, text string")),
    "sharding": lambda d: sharding.assign(sharding.records(d), sharding.deal(sharding.slot_stats(sharding.records(d)))).select("doc_id", "size", "text_crc32", "vslot", "shard"),
    "chaining": lambda d: chaining.passages(d).select("identity", "matched"),
    "packing": lambda d: packing.pieces(d, _path()),
    "pii": lambda d: pii.redacted(d.select("doc_id", "text", *[c for c in d.columns if c in CLASH])).select("doc_id", "text"),
    "quality": lambda d: quality.kept(d, quality.fit(d, quality.graded(_labels(d)))).select("doc_id", "text"),
    "pitman_yor": lambda d: pitman_yor.score(d, held(7)).select("doc_id", "n_tokens", "n_known", F.round("score", 7)),
}


def _path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _labels(d):
    return d.sparkSession.createDataFrame([(k, int(k != 2), int(k == 5)) for k in range(12)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_change_nothing(docs, wide, name):
    rows = bag(OPERATORS[name](docs))
    assert rows and rows == bag(OPERATORS[name](wide))
    assert not OPERATORS[name](docs.limit(0)).collect()


def test_search_ignores_other_columns(spark):
    x = np.random.default_rng(62).standard_normal((40, 8))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    wide = table.select("*", *(F.lit(c).alias(c) for c in (*CLASH, "v", "nth", "ib", "qb")))
    assert bag(mih.search(table, table.limit(3))) == bag(mih.search(wide, wide.limit(3)))


def test_the_shared_folder_must_be_named_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    session = type("Session", (), {"conf": Conf({"spark.master": "spark://host:7077"})})()
    with pytest.raises(ValueError):
        common.shared_dir(session)
    session.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert common.shared_dir(session) == "hdfs://x/y"


# --- the pipeline's stages, each on its own input


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_keep_columns_and_take_any_table(spark, docs, wide, name):
    got, more = STAGES[name](spark, docs, DIR), STAGES[name](spark, wide, DIR)
    assert STAGES[name](spark, docs.limit(0), DIR).count() == 0
    if name == "packing":
        assert bag(got.select("doc_id", "piece", "start", "length", "ids_crc32")) == bag(more.select("doc_id", "piece", "start", "length", "ids_crc32"))
    else:
        assert got.columns == docs.columns and more.columns == wide.columns
        assert bag(got) == bag(more.select(*docs.columns))


def test_quality_stage_follows_the_model(spark, docs):
    model = quality.fit(docs, quality.graded(common.table(spark, DIR, "labels")))
    w, t = model.w, model.t
    want = collections.Counter()
    for k, text in texts():
        i, x = quality.features(text.encode() if text else None)
        if 1 / (1 + math.exp(-(sum(float(np.float32(w[a])) * b for a, b in zip(i.tolist(), x.tolist(), strict=True)) - t[-1]))) >= 0.5:
            want[k, text] += 1
    assert collections.Counter((r.doc_id, r.text) for r in STAGES["quality"](spark, docs, DIR).collect()) == want


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs):
    got = collections.Counter((r.doc_id, r.text) for r in STAGES["near_duplicates"](spark, docs, DIR).collect())
    sets = {(k, t): simhash.shingles(t.encode() if t else None).tobytes() for k, t in texts()}
    alike = lambda a, b: a == b or (a and b and simhash.jaccard(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) >= 0.8)
    left = set(sets)
    want = set()
    while left:
        group, open_ = set(), {next(iter(left))}
        while open_:
            x = open_.pop()
            group.add(x)
            open_ |= {y for y in left - group if alike(sets[x], sets[y])}
        left -= group
        least = min((k is None, k if k is not None else 0) for k, _ in group)
        want.add((len(group), least))
    assert len(got) == len(want) and all(n == 1 for n in got.values())
    assert sorted((k is None, k if k is not None else 0) for k, _ in got) == sorted(x for _, x in want)


def test_decontamination_stage_drops_leaks_only(spark):
    items = [r.text for r in common.table(spark, DIR, "benchmark").collect()]
    rows = [(1, prose(30, 90) + " " + items[0] + " " + prose(30, 91)), (2, prose(200, 92)), (None, prose(50, 93)), (3, None), (4, ""), (2, items[1].upper()), (5, prose(30, 94))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in STAGES["decontamination"](spark, table, DIR).collect()}
    assert got == {rows[2], rows[3], rows[4], rows[6]}  # rows of one id go together


def test_personal_data_stage_replaces_spans(spark, docs):
    got = collections.Counter((r.doc_id, r.text, r.n_chars) for r in STAGES["personal_data"](spark, docs, DIR).collect())
    swap = lambda t: re.sub(r"4111 1111 1111 1111", "<CARD>", t.replace("a.b@c.de", "<EMAIL>"))
    assert got == collections.Counter((k, swap(t) if t is not None else None, len(swap(t)) if t is not None else None) for k, t in texts())


def test_packing_stage_fills_sequences(spark, docs):
    by = collections.defaultdict(list)
    for r in STAGES["packing"](spark, docs, DIR).collect():
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 4096 and sorted(b) == sorted((sum(n for o, n in b if o < at), length) for at, length in b) for b in by.values())
    assert len(by) == -(-sum(n for b in by.values() for _, n in b) // 4096)


# --- operators against plain forms


def plain_bits(train, text):
    """The code length of a text by PPM with escape method C, byte by byte."""
    seen = [collections.defaultdict(collections.Counter) for _ in range(4)]
    for t in train:
        data = b"   " + t.lower()
        for p in range(3, len(data)):
            for order in range(4):
                seen[order][data[p - order : p]][data[p]] += 1
    data, total = b"   " + text.lower(), 0.0
    for p in range(3, len(data)):
        chance, escape = None, 1.0
        for order in range(3, -1, -1):
            counts = seen[order].get(data[p - order : p])
            if counts:
                n, d = sum(counts.values()), len(counts)
                if data[p] in counts:
                    chance = escape * counts[data[p]] / (n + d)
                    break
                escape *= d / (n + d)
        total += math.log2(chance if chance is not None else escape / 256)
    return total


def test_language_code_lengths_equal_plain_ppm():
    rng = np.random.default_rng(63)
    train = {x: [prose(60, 700 + 10 * j + k).translate(str.maketrans("abc", y)).encode() for k in range(3)] for j, (x, y) in enumerate((("aa", "xyz"), ("bb", "abc"), ("cc", "zéü")))}
    asked = [b"a", "é zü".encode(), prose(30, 64).encode(), b"QQQ never seen \xff", bytes(rng.integers(1, 256, 200).astype("u1"))]
    got = language.Classifier(train).bits(asked)
    want = [[plain_bits(train[x], t) for x in sorted(train)] for t in asked]
    assert np.allclose(got, want, rtol=1e-9)


def test_language_has_letters():
    assert all(language.has_letter(t.encode()) for t in ("a", "é", "ß1", "日", "ª", "ʰ"))
    assert not any(language.has_letter(t.encode() if t is not None else None) for t in ("½", "²", "①", "12 3", "_", "", None, "😀", "٣"))


def test_language_on_held_out_documents(spark):
    got = language.identify(common.table(spark, "/root/testdata/sf0.01", "documents"), language.fit(common.table(spark, "/root/testdata/sf0.01", "documents").filter(language.remainder("doc_id", 4) != 2)))
    rows = got.join(common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "text"), "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_quality_scores_equal_a_plain_form(spark, docs):
    model = quality.CumulativeLink()
    rng = np.random.default_rng(65)
    model.w = rng.standard_normal(len(model.w)) * 0.05
    model.t = np.array([-0.7, 0.4])
    want = collections.Counter()
    for k, text in texts():
        words = text.split() if text else []
        low = {zlib.crc32(w.lower().strip(".,;:!?\"'()[]").encode()) % quality.DIM for w in words}
        shapes = collections.Counter(quality._slot(w.encode())[1] for w in words)
        score = sum(float(np.float32(model.w[f])) for f in low) + sum(float(np.float32(model.w[f])) * 4 * n / len(words) for f, n in shapes.items())
        tails = [1 / (1 + math.exp(-(score - t))) for t in model.t]
        want[k, round(sum(tails), 6), round(tails[-1], 6), tails[-1] >= 0.5] += 1
    got = collections.Counter((r.doc_id, round(r.expected_grade, 6), round(r.p_top, 6), r.keep) for r in quality.scored(docs, model).collect())
    assert got == want


def test_quality_step_follows_the_gradient():
    t = np.array([-0.5, 0.8])
    model = quality.CumulativeLink()
    model.t = t
    loss = lambda s, g: -math.log(([1.0, *model.tails(s)][g]) - ([*model.tails(s), 0.0][g]))
    for g in range(3):
        for s in (-1.3, 0.0, 2.1):
            up = model.tails(s)
            slope = (up[g] if g < 2 else 0.0) - (1 - (up[g - 1] if g else 1.0))
            assert math.isclose(slope, (loss(s + 1e-5, g) - loss(s - 1e-5, g)) / 2e-5, abs_tol=1e-6)


def test_quality_reads_one_row_of_each_id(spark):
    table = spark.createDataFrame([(1, f"copy {k} vile") for k in range(3000)] + [(k, "good words here") for k in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1)] + [(k, 1, 0) for k in range(2, 60)], "doc_id long, quality int, toxic int")
    once = table.filter("doc_id <> 1 OR text = 'copy 0 vile'")
    assert np.array_equal(quality.fit(table, quality.graded(labels)).w, quality.fit(once, quality.graded(labels)).w)


def test_sharding_is_even_with_hot_ids(spark):
    rows = [(7, "same text " * 5)] * 2000 + [(None, prose(8, k)) for k in range(1000)] + [(7, prose(8, 2000 + k)) for k in range(500)] + [(k, prose(8, 4000 + k)) for k in range(500)]
    placed = sharding.records(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    stats = sharding.slot_stats(placed).collect()
    dealt = {r.vslot: r.shard for r in sharding.deal(sharding.slot_stats(placed)).collect()}
    loads, want = [0] * sharding.SHARDS, {}
    for r in sorted(stats, key=lambda r: (-r.bytes, r.vslot)):
        want[r.vslot] = loads.index(min(loads))
        loads[want[r.vslot]] += r.bytes
    assert dealt == want and max(loads) - min(loads) <= max(r.bytes for r in stats) and max(loads) < 1.02 * min(loads)


def test_sharding_map_is_stored_and_edited(spark, docs, tmp_path):
    rows = sharding.records(docs)
    path = f"file://{tmp_path}/map"
    sharding.store(sharding.deal(sharding.slot_stats(rows)), path)
    sharding.store(sharding.rebalance(sharding.stored(spark, path, 1), 9, 2), path)
    one, two = ({r.vslot: r.shard for r in sharding.stored(spark, path, v).collect()} for v in (1, 2))
    assert one == {r.vslot: r.shard for r in sharding.deal(sharding.slot_stats(rows)).collect()} and set(one) == set(two)
    assert max(two.values()) <= 8 and max(one.values()) <= 7


def test_tasks_of_the_pipeline_leave_nothing_in_workers(docs, spark, monkeypatch):
    """A worker serves all stages: what one of them keeps of words would add to what the next one needs."""
    tasks, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, *args, **more: tasks.append(f) or plain(df, f, *args, **more))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DIR).collect()
    assert len(tasks) > 6
    for task in tasks:
        pitman_yor._known[b"word"], quality._slots[b"word"], packing._open["file"] = 1, (1, 1), None
        with contextlib.suppress(AttributeError):  # some ask for their partition, which there is none of here
            list(cloudpickle.loads(cloudpickle.dumps(task))(iter([])))  # as a worker gets it
        assert not any([pitman_yor._known, quality._slots, packing._open])
