"""Operators across rows: near duplicates, sharding and the pipeline."""

import random
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import marks, neardup, queries, sharding
from tickloom.llm.components import components
from tickloom.sources.scratch import Scratch


def brute(rows, words, percent):
    """(n_shingles, component) of each (id, text) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = [v for v in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if v]
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    """Copies, a large group of near copies of a base at various distances, a common passage, odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " ", "a", "A", "a b", "a b c", "x " * 5000]
    base = [word() for _ in range(120)]
    for _ in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base).upper()] * 40
    passage = [word() for _ in range(60)]
    for _ in range(120):
        texts.append(" ".join([word() for _ in range(rng.choice([5, 20, 60]))] + passage))
    chain = list(base)
    for _ in range(15):  # each like the one before, the ends unlike
        chain[rng.randrange(len(chain))] = word()
        chain[rng.randrange(len(chain))] = word()
        texts.append(" ".join(["chain"] * 3 + chain[::-1]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_near_duplicates_equal_brute_force(spark, seed, words, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: r for r in neardup.groups(df, words, percent).collect()}
    want = brute(rows, words, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.groups(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.groups(twice).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]


@pytest.mark.parametrize("name", ["op5_decontamination", "op6_license_scan", "op9_near_dedup"])
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_least_matches():
    assert 0 < neardup.least_matches(80) < neardup.least_matches(85) < neardup.COORDINATES


def test_marks_hold_their_ids(spark, monkeypatch):
    ids = spark.range(0, 5000, 7)
    for most, others in ((1 << 28, 20), (1 << 16, 300)):
        monkeypatch.setattr(marks, "MOST_BITS", most)
        got = marks.marked(spark.range(20_000), "id", ids).where(marks.MARKED).select("id").collect()
        marked = {r[0] for r in got}
        assert set(range(0, 5000, 7)) <= marked and len(marked) <= 715 + others
    assert marks.marked(spark.range(50), "id", spark.range(0)).where(marks.MARKED).count() == 0


@pytest.mark.parametrize("limits", [(64, 4096, 64), (2, 4096, 3), (2, 5, 1)])
def test_near_duplicates_in_any_parts(spark, monkeypatch, limits):
    """Hot classes and tokens dealt into parts give the same links."""
    for name, value in zip(("PAIRS", "MOST_HOT", "MEETING"), limits, strict=True):
        monkeypatch.setattr(neardup, name, value)
    rows = corpus(5)[:220]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.groups(df, 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_distinct_keeps_rows_of_kept_ids(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "A b c d e f", "z"), (None, "a b c d e f", "n"), (3, None, "k"), (4, "other words stand here now", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _tickloom string")
    assert sorted(map(tuple, neardup.distinct(df).collect()), key=str) == sorted([rows[0], rows[1], rows[4], rows[5]], key=str)
    assert neardup.distinct(df.limit(0)).columns == df.columns


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (5, 5), (300, 100)]
    got = components(Scratch(spark), spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {k: 0 for k in range(61)} | {100: 100, 200: 100, 300: 100}


def shards_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r)
    return out


def test_sharding(spark):
    rng = random.Random(9)
    texts = [None, "", "é" * 10] + ["copy of a text that many share " * 3] * 400 + ["t" * rng.randint(1, 300) + str(k) for k in range(800)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, Shard string")
    out = sharding.shard(df, 6).collect()
    assert len(out) == len(texts)
    sizes = {}
    for k, rows in shards_of(out).items():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        sizes[k] = sum(r["size"] for r in rows)
    for r in out:
        b = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(b) + 8 and r["text_crc32"] == zlib.crc32(b)
    assert len(sizes) == 6 and max(sizes.values()) - min(sizes.values()) <= 4 * 320
    copies = {r["shard"] for r in out if r["text"] and r["text"].startswith("copy")}
    assert len(copies) <= 4
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(df.repartition(5), 6).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in out}


def test_sharding_of_few_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(empty, 4).count() == 0
    same = spark.createDataFrame([(1, "same")] * 50, "doc_id long, text string")
    rows = sharding.shard(same, 4).collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [12, 12, 13, 13]
    for own in shards_of(rows).values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


def test_sharding_splits_rows_that_repeat(spark):
    for texts, apart in (([(7, "the same row again")] * 4800, 26), ([(7, "the same row again")] * 4800 + [(None, None)] * 480, 26 + 8)):
        rows = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), 24).collect()
        sizes = [sum(r["size"] for r in own) for own in shards_of(rows).values()]
        assert len(sizes) == 24 and max(sizes) - min(sizes) <= apart
        for own in shards_of(rows).values():
            assert sorted(r["slot"] for r in own) == list(range(len(own)))


def test_splitters_equal_sorted_prefix_sums(spark):
    """Each splitter cuts the sorted rows where their summed sizes come nearest to its share."""
    rng = random.Random(21)
    word = lambda: rng.randrange(-(1 << 63), 1 << 63)
    hot, copy = word(), word()
    rows = [(rng.choice([word(), hot]), rng.choice([word(), copy]), word(), rng.choice([8, 9, 500, rng.randint(8, 90_000)])) for _ in range(3000)]
    keys = spark.createDataFrame(rows, "high long, low long, row long, size long").repartition(7)
    order = sorted(rows)
    total = sum(r[3] for r in rows)
    for parts, tolerance in ((6, 0.0), (24, 0.0), (192, 0.0), (24, 0.01)):
        cuts, rounds = sharding.splitters(keys, parts, tolerance)
        assert len(cuts) == parts - 1 and cuts == sorted(cuts) and rounds < 20
        whole = [((h + (1 << 63)) << 128) + ((l + (1 << 63)) << 64) + r + (1 << 63) for h, l, r, _ in order]
        sums = [0]
        for r in order:
            sums.append(sums[-1] + r[3])
        for j, c in enumerate(cuts):
            target = total * (j + 1) // parts
            got = abs(sums[bisect_left(whole, c)] - target)
            assert got <= max(tolerance * total / parts, min(abs(v - target) for v in sums))
        at = sharding._split(cuts)
        parts_of = [np.array([r[k] for r in order], np.int64) for k in range(3)]
        assert sharding.below(parts_of, at).tolist() == [bisect_right(cuts, k) for k in whole]


def test_sharding_of_very_long_texts(spark):
    df = spark.createDataFrame([(0, "x" * 3_000_000), (1, "y" * 10), (2, "z" * 2_000_000), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sharding.shard(df, 3).collect()}
    assert [rows[k]["size"] for k in range(4)] == [3_000_008, 18, 2_000_008, 8] and rows[0]["shard"] != rows[2]["shard"]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", "en", "s", 0), (10_002, "12 34", "en", "s", 5)], docs.schema)
    docs = docs.union(extra).withColumn("score", F.lit(1)).withColumn("hits", F.lit("own"))
    columns = docs.columns
    n = [docs.count()]
    scratch = Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, sf))
        n.append(docs.count())
        if name != "packing":
            assert docs.columns == columns and docs.where("hits != 'own' or score != 1").count() == 0
        if name == "language_id":
            assert n[0] - n[1] == 3 and docs.where("doc_id >= 10000").count() == 0
        if name == "secrets":
            assert docs.where("text rlike 'AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}'").count() == 0 and docs.where("n_chars != length(text)").count() == 0
    assert n[1] > n[2] > n[3] == n[4]
    ids = {r[0] for r in docs.select("doc_id").distinct().collect()}
    assert len(ids) == n[4]


def test_pipeline_of_repeated_and_very_long_rows(spark, sf):
    """Rows that repeat a document share its fate; a text of megabytes passes whole; nulls in every other column do no harm."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prose = [r["text"] for r in docs.where("lang = 'en' and n_chars > 500").limit(4).collect()]
    words = " ".join(prose).split()
    rng = random.Random(5)
    long = " ".join(rng.choice(words) for _ in range(400_000)) + " token = abcdef123456 end"
    extra = [(20_000, long, None, None, None)] + [(20_001, " ".join(rng.choice(words) for _ in range(80)), None, None, None)] * 3 + [(20_002, "", "en", None, 0)] * 2
    few = docs.limit(60).unionByName(spark.createDataFrame(extra, docs.schema))
    scratch = Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        few = scratch.write(stage(spark, few, sf))
        n = Counter(r["doc_id"] for r in few.where("doc_id >= 20000").select("doc_id").collect())
        if name != "packing":
            assert n == {20_000: 1, 20_001: 3}
        if name == "secrets":
            text = few.where("doc_id = 20000").first()
            assert text["text"].endswith("[SECRET] end") and text["n_chars"] == len(text["text"]) > 1_000_000
    pieces = few.where("doc_id = 20000").orderBy("start").collect()
    assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"] > 400_000 and max(r["length"] for r in pieces) <= 4096


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    scratch = Scratch(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, sf))
    assert docs.count() == 0


def test_rows_without_ids(spark, sf):
    """Nulls in any column crash nothing."""
    from tickloom.llm import language, packing, secrets

    docs = spark.createDataFrame([(None, "a b c d e f g", None, None, None), (None, None, None, None, None), (4, "a b c d e f g", None, None, None)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.groups(docs).collect()), key=str)
    assert got == [(4, 4, True), (None, 4, False), (None, None, False)]
    assert sharding.shard(docs, 2).count() == 3
    assert packing.pack(docs, packing.default_tokenizer()).where("doc_id is null").count() >= 2
    assert secrets.find(docs, secrets.default_ranks(), redact=True).count() == 3
    assert language.predict(docs, language.fit(docs)).where("lang_pred = 'und'").count() == 3
    assert corpus_pipeline.drop_near_duplicates(spark, docs, sf).count() == 1
