"""Learned operators against plain Python: the same model applied letter by letter, and odd training rows."""

import base64
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import language, quality, rules, samples, secrets, toxicity
from tickloom.sources.scratch import Scratch

SF = "/root/testdata/sf0.001"
M32, M64 = (1 << 32) - 1, (1 << 64) - 1
SCHEMA = "doc_id long, text string, Score double, label int, N_WORDS string"
ODD = [None, "", " \n\t ", "a", "Ünï ÀÉ×", "word " * 5000, "1234 !!", "x\ny\n\nx\n", "\x00\x1c", "日本語 テキスト", "stu*pid ** A", "a" * 400]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 0.5, 3, "w") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    return [r["text"] for r in rows] + ODD


def lowered(text):
    """Bytes with A-Z and the capitals U+00C0 to U+00DE in lower case."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text or "").encode()


def mixed(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def spelled(word):
    return mixed(sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(word)) & M64)


def gram(data, n):
    h = 0
    for k in range(1, n + 1):
        h = (h * 0x01000193 + data[k - 1] + k) & M32
    return h * 0x9E3779B1 & M32


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def plain_toxicity(text, model):
    sums = []
    for w in re.findall(rb"[0-9a-z\x80-\xff*]+", lowered(text)):
        padded = b" " + w + b" "
        bag = [gram(padded[i : i + n], n) >> 14 for n in toxicity.GRAMS for i in range(len(padded) - n + 1)] + [spelled(w) >> 46]
        sums.append((sum(float(model.value[b]) for b in bag), len(bag)))
    passages = [sums[i : i + toxicity.PASSAGE] for i in range(len(sums))]
    return sigmoid(max((sum(s for s, _ in p) / sum(n for _, n in p) for p in passages), default=0.0) + model.bias)


def plain_quality(text, model):
    data = (text or "").encode()
    tokens = []
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|\n+|[^0-9A-Za-z\x80-\xff \t\n\x0b\x0c\r\x00]+", data):
        w = m.group()
        tokens.append((0 if re.match(rb"[0-9A-Za-z\x80-\xff]", w) else 2 if w[:1] == b"\n" else 1, w, spelled(bytes(c + 32 if 65 <= c <= 90 else c for c in w)) if w[:1] != b"\n" else 10))
    shapes, before = [], None
    for kind, w, h in tokens:
        if kind:
            shapes.append(mixed(h ^ 0xABCDEF))
            continue
        upper = sum(65 <= c <= 90 for c in w)
        case = 1 if any(48 <= c <= 57 for c in w) else 2 if not upper else 3 if upper == 1 and 65 <= w[0] <= 90 else 4 if upper == len(w) else 5
        shapes.append(mixed(case + 8 * (h == before)))
        before = h
    found = []
    for salt, (values, sizes) in enumerate((([h for _, _, h in tokens], (1, 2)), (shapes, (1, 2, 3)))):
        values = [v ^ (salt * 977 + 1) for v in values]
        for n in sizes:
            found += [mixed((sum(values[i + k] * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(n)) & M64) ^ n) >> 46 for i in range(len(values) - n + 1)]
    return sigmoid(quality.SCALE * sum(float(model.weights[b]) for b in found) / (quality.PRIOR + len(found)) + model.bias)


def plain_language(text, model):
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    data = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in lowered(text))
    counts = Counter((gram(data[i : i + n], n) >> 7) % language.BUCKETS for n in language.GRAMS for i in range(len(data) - n + 1))
    norm = math.sqrt(sum(counts.values()))
    margins = [sum(math.sqrt(c) / norm * float(model.weights[b, k]) for b, c in counts.items()) + float(model.weights[-1, k]) for k in range(model.weights.shape[1])]
    f, score = 0, 1.0
    if len(model.families) > 1:
        best = sorted(margins[: len(model.families)], reverse=True)
        f, score = margins.index(best[0]), 1 / (1 + math.exp(-2 * (best[0] - best[1])))
    own = model.languages[f]
    votes, least = [0.0] * len(own), [9.0] * len(own)
    for k, (g, a, b) in enumerate(model.pairs):
        if g == f:
            z = margins[len(model.families) + k]
            votes[a if z > 0 else b] += 1 + 1e-3 * min(abs(z), 9)
            least[a], least[b] = min(least[a], z), min(least[b], -z)
    at = votes.index(max(votes))
    return own[at], score * (1 / (1 + math.exp(-4 * least[at])) if len(own) > 1 else 1)


@pytest.mark.parametrize(("op", "label", "plain"), [(toxicity, "toxic", plain_toxicity), (quality, "quality", plain_quality)])
def test_scores_equal_a_plain_scorer(spark, real, op, label, plain):
    model = op.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), label)
    got = {r["doc_id"]: r for r in op.score(docs(spark, real), model).collect()}
    for i, t in enumerate(real):
        assert abs(got[i]["score"] - plain(t, model)) < 1e-6 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_languages_equal_a_plain_scorer(spark, real):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(90_000 + k, f"{w} " * 30, lang) for k, (w, lang) in enumerate([("hei verden", "no"), ("kiitos paljon", "fi"), ("日本語 です", "ja")] * 8)], "doc_id long, text string, lang string")
    model = language.fit(d.select("doc_id", "text", "lang").unionByName(more))
    assert len(model.families) == 4 and len(model.pairs) == 4
    got = {r["doc_id"]: r for r in language.predict(docs(spark, real), model).collect()}
    for i, t in enumerate(real):
        lang, score = plain_language(t, model)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-3


def plain_secrets(text, ranks):
    """Base patterns and opaque strings, told letter by letter."""
    import tiktoken

    with open(ranks, "rb") as f:
        enc = tiktoken.Encoding("t", pat_str=r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    out = []
    kinds = {"assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), "access": (r"(AKIA[A-Z0-9]+)", 20), "hex": (r"([0-9a-f]+)", 24)}
    for kind, (pattern, least) in kinds.items():
        out += [(m.start(), list(kinds).index(kind), m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(1)) >= least]
    taken = set()
    for s, _, e, _ in out:
        taken.update(range(s, e))
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        run: list[int] = []
        for at in [*range(m.start(), m.end()), None]:
            if at is not None and at not in taken:
                run.append(at)
                continue
            if len(run) >= 20:
                a, b = run[0], run[-1] + 1
                while a > m.start() and a < b and text[a] in "+/_=-":
                    a += 1
                while b < m.end() and b > a and text[b - 1] in "+/_=-":
                    b -= 1
                s = text[a:b]
                part = r"(?:[A-Za-z]?[a-z]+\d{0,4}|[A-Z]+\d{0,4}|\d{1,4})"
                known = re.fullmatch(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", s) or len(s) in (32, 40, 56, 64, 96, 128) and re.fullmatch(r"(?i)[0-9a-f]+", s) or re.fullmatch(rf"{part}([_/=+-]+{part})+", s, re.ASCII)
                one_case = not re.search(r"\d", s) and (s[1:].islower() or s.isupper())
                if re.search("[A-Za-z]", s) and not known and len(s) < (1.8 if one_case else 2.0) * len(enc.encode_ordinary(s)):
                    out.append((a, 3, b, "opaque"))
            run = []
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def test_secrets_equal_a_plain_scan(spark, real):
    ranks = secrets.default_ranks()
    rng = random.Random(31)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    parts = lambda: rng.choice(["password=", "Api_Key: '", "AKIA" + "".join(rng.choice(chars[:26]) for _ in range(16)), "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([20, 24, 32, 40]))), "".join(rng.choice(chars) for _ in range(rng.choice([8, 20, 33]))), "/", "_", " ", "=", "some_plain_name", "été ", "\n", "token"])
    texts = real + ["".join(parts() for _ in range(rng.randint(1, 25))) for _ in range(150)] + ["".join(parts() + "/" for _ in range(4000))]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.find(docs(spark, texts), ranks)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["spans"] == plain_secrets(t or "", ranks)
    assert len(got[len(texts) - 1]["spans"].split(",")) > 500
    assert secrets.find(docs(spark, texts).limit(0), ranks).count() == 0


def plain_statistics(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [v for v in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", v)]
    n, letters = max(1, len(words)), max(1, sum(map(len, words)))
    return len(words), len(hit), {
        "symbol_share": sum(t.count(c) for c in "#*$%&|<>") / letters, "repeat_share": len(hit) / n,
        "upper_share": len(re.findall("[A-Z]", t)) / letters, "mark_share": len(re.findall("[!?]", t)) / letters,
        "word_length": sum(map(len, words)) / n, "distinct_share": len(set(words)) / n,
        "dup_lines_share": (len(lines) - len(set(lines))) / n, "n_words": len(words),
    }


def test_rules_keep_what_the_plain_list_keeps(spark, real):
    sf = "/root/testdata/sf0.01"
    found = rules.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    assert found
    texts = real + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in rules.judge(docs(spark, texts), found).collect()}
    for i, t in enumerate(texts):
        n, hit, row = plain_statistics(t)
        rule = next((k for k, r in enumerate(found, 1) if all(row[c.feature] > c.cut if c.above else row[c.feature] <= c.cut for c in r)), 0)
        failed = n < 50 or 100 * hit > 50 * n
        assert (got[i]["rule"], got[i]["base_failed"], got[i]["kept"]) == (rule, failed, not failed and rule == 0)
    assert rules.judge(docs(spark, []), found).count() == 0


def test_fits_of_odd_rows(spark):
    """No rows, no labels, null ids and texts, repeated rows, a clashing label column: defined models, and the same for the same rows."""
    words = ["alpha", "beta", "gamma", "delta"]
    rng = random.Random(7)
    texts = [" ".join(rng.choice(words) for _ in range(60)) + (" !!%% clown" * 20 if k % 2 else "") for k in range(60)]
    some = docs(spark, texts)
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(60)], "doc_id long, toxic int, quality int")
    odd_docs = some.unionByName(some.limit(30)).unionByName(spark.createDataFrame([(None, "x", 0.1, 1, "w"), (3, None, 0.1, 1, "w")], SCHEMA))
    odd_labels = labels.unionByName(labels.limit(20)).unionByName(spark.createDataFrame([(None, 1, 1), (4, None, None), (10_000, 0, 1), (5, 7, -1)], labels.schema))
    for op, column in ((toxicity, "toxic"), (quality, "quality")):
        for d, ys in ((some.limit(0), labels), (some, labels.limit(0)), (some, labels.withColumn(column, F.lit(None).cast("int")))):
            model = op.fit(d, ys, column)
            out = op.score(docs(spark, ODD), model).collect()
            assert len({r["score"] for r in out}) == 1 and all(0 <= r["score"] <= 1 for r in out)
        a, b = op.fit(some, labels, column), op.fit(odd_docs.repartition(3), odd_labels, column)
        wa, wb = (m.value if op is toxicity else m.weights for m in (a, b))
        assert np.array_equal(wa, wb) and a.bias == b.bias
        assert op.score(docs(spark, ODD[:2]), a).columns == ["doc_id", "text", "label", "N_WORDS", "score", "predicted"]
    assert rules.fit(some.limit(0), labels, "quality") == rules.fit(some, labels.limit(0), "quality") == []
    assert rules.fit(some, labels, "quality") == rules.fit(odd_docs.repartition(3), odd_labels, "quality") != []


def test_language_of_odd_rows(spark):
    rows = [(k, f"{w} " * 20, lang) for k, (w, lang) in enumerate([("hello there", "en"), ("guten tag", "de"), ("12 34", "fr")] * 5)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    twice = base.unionByName(base).unionByName(spark.createDataFrame([(None, "hello you there", "en"), (77, None, "en"), (78, "text", None)], base.schema))
    model = language.fit(twice)
    assert model.families == ["germanic"] and model.languages == [["de", "en"]]
    assert language.predict(base, language.fit(base.limit(0))).where("lang_pred != 'und' or score != 0").count() == 0


def test_seventy_languages_are_learned(spark):
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 70 * 6)]
    rows = [(k * 100 + i, " ".join("".join(rng.choice(letters[6 * k : 6 * k + 6]) for _ in range(3)) for _ in range(12)), f"q{k:02d}") for k in range(70) for i in range(3 + 40 * (k == 0))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(d)
    assert sum(map(len, model.languages)) == 70
    got = language.predict(d, model).where("lang = lang_pred").count()
    assert got == len(rows)
    with pytest.warns(UserWarning, match="left out: q05"):
        few = language.fit(d, most_languages=5)
    assert sum(map(len, few.languages)) == 5 and few.families[0] == "q00"


def test_samples_are_bounded_whatever_repeats(spark):
    rows = [(1, "the same text")] * 3000 + [(2, f"text {k}") for k in range(3000)] + [(None, f"free {k}") for k in range(500)] + [(10 + k, "x" * (1 if k % 2 else 50_000)) for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(1))
    got = samples.stratified(d, "label", 200, ("doc_id", "text")).collect()
    assert 120 < len(got) < 300 and len({(r["doc_id"], r["text"]) for r in got}) == len(got)
    labels = spark.createDataFrame([(1, 0), (2, 0), (None, 0)] + [(10 + k, 1) for k in range(400)], "doc_id long, label int")
    found = samples.labelled(Scratch(spark), d.drop("label"), labels, "label", {0: 50, 1: 100}, strict=True)
    kept = samples.collected(found, "label", ("doc_id", "text"), {0: 50, 1: 100}, 1_000_000)
    assert Counter(r["label"] for r in kept)[0] <= 50 and sum(len(r["text"]) for r in kept if r["label"] == 1) <= 1_000_000
    long = sum(len(r["text"]) > 1 for r in kept if r["label"] == 1)
    assert 10 <= long <= 20  # some twenty long texts fit: none is left out for its length
    assert samples.collected(found.limit(0), "label", ("doc_id",), 5, 10) == []
