"""Near-duplicate documents: an inverted join of MinHash signature coordinates.

A document's signature is K minima; each (coordinate, value) pair is a token. Two documents
whose shingle sets have the wanted similarity share at least M of their K tokens but for a
chance below MISS. The join finds all pairs that share M:

* Documents with equal shingle sets are one class first, so copies make no pairs.
* Tokens that occur once can match nothing; a class with fewer than M other tokens is skipped.
* The others are posted under their S - M + 1 rarest tokens only (S: tokens left). Two classes
  that share M tokens meet in such a prefix; tokens that many documents share by a common
  passage come last and are hardly ever posted.
* Under each token every class first meets the token's most typical class only. Pairs are
  counted over all coordinates, then confirmed on full shingle sets, and joined into components.
* Then pairs that share a posting but lie in different components meet as well, one of them
  outside the posting's main component. Shingles that no other such class has bound the
  overlap of a pair; those that can't reach the similarity make no pair. So a large group of
  copies, linked by its hub already, makes few pairs.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import ragged
from tickloom.llm.components import components
from tickloom.llm.marks import MARKED, marked
from tickloom.sources.scratch import Scratch

#: Coordinates of a signature.
COORDINATES = 48
#: Chance that a pair at the threshold shares too few coordinates.
MISS = 1e-6
#: Ranges in which a set's shingles are counted.
SPREAD = 128
#: Pairs of one class that are joined in one piece, unless a MOST_HOT-th of all is more; members of a posting that meet the others in one piece.
PAIRS, MOST_HOT, MEETING = 64, 4096, 4096
#: Words of a shingle and percent of similarity, where no contract sets others.
WORDS, PERCENT = 5, 80


@cache
def least_matches(percent: int, k: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of coordinates that pairs at the threshold share but for a chance of miss."""
    p, tail, m = percent / 100, 0.0, 0
    while True:
        tail += comb(k, m) * p**m * (1 - p) ** (k - m)
        if tail > miss:
            return max(m, 1)
        m += 1


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    a = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, k, dtype=np.uint64)


def shingles(column: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; one of all words if it has fewer, none without words."""
    out: list[np.ndarray] = []
    for _, x, bounds in ragged.slices(column):
        x = ragged.ascii_lower(x)
        flag = ragged.VISIBLE[x]
        starts, ends, row = ragged.runs(flag, bounds)
        h = ragged.run_hashes(x, flag, starts, ends)
        count = np.bincount(row, minlength=len(bounds) - 1)
        first = np.cumsum(count) - count
        windows = ragged.window_hashes(h, words)
        for a, n in zip(first.tolist(), count.tolist(), strict=True):
            if n >= words:
                out.append(np.unique(windows[a : a + n - words + 1]))
            else:
                out.append(ragged.window_hashes(h[a : a + n], n) if n else np.zeros(0, np.uint64))
    return out


def _signed(*fields: str) -> list[T.StructField]:
    return [T.StructField(f, T.LongType()) for f in fields]


def signatures(docs: DataFrame, words: int, k: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a 128-bit hash of the set), sig (k minima; null for an empty set)."""
    fields = [*_signed("n_shingles", "set_a", "set_b"), T.StructField("sig", T.ArrayType(T.IntegerType()))]
    a, b = _coefficients(k)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = shingles(ragged.column(batch, "text"), words)
        n = np.array([s.size for s in sets], np.int64)
        hashed = np.zeros((2, len(sets)), np.uint64)
        sig = np.zeros((len(sets), k), np.uint32)
        for i, s in enumerate(sets):
            for at in range(0, s.size, 4096):
                part = s[at : at + 4096]
                low = ((part[:, None] * a + b) >> np.uint64(32)).min(axis=0).astype(np.uint32)
                sig[i] = low if at == 0 else np.minimum(sig[i], low)
            hashed[0, i] = ragged.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            hashed[1, i] = ragged.mix(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
        values = pa.array(sig.view(np.int32).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * k), values, mask=pa.array(n == 0))
        return [pa.array(n), pa.array(hashed[0].view(np.int64)), pa.array(hashed[1].view(np.int64)), lists]

    return ragged.append(docs.select("doc_id", "text"), run, fields, drop=("text",))


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """rep, shingles (the sorted hashes of the full set) and spread (how many of them fall into each of SPREAD ranges).

    Of docs those whose id is in ids (column id), and few others: a filter of the ids of bounded
    size is sent to where the texts are, so no text is shuffled. Joins on rep leave out the others.
    """
    fields = [T.StructField("rep", docs.schema["doc_id"].dataType), T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("spread", T.ArrayType(T.ShortType()))]

    def run(batches):
        for batch in (piece for b in batches for piece in ragged.pieces(b)):
            sets = shingles(batch.column(1), words)
            bounds = pa.array(np.concatenate([[0], np.cumsum([s.size for s in sets])]).astype(np.int32))
            values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            spread = np.zeros((len(sets), SPREAD), np.int16)
            for i, s in enumerate(sets):
                spread[i] = np.minimum(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=SPREAD), 32767)
            spreads = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SPREAD), pa.array(spread.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(values.view(np.int64))), spreads], names=["rep", "shingles", "spread"])

    some = marked(docs.select(F.col("doc_id").alias("rep"), "text").where("rep is not null"), "rep", ids)
    return some.where(MARKED).select("rep", "text").mapInArrow(run, T.StructType(fields))


def _postings(classes: DataFrame, least: int) -> DataFrame:
    """For each class that can have a link: rep, n, sig, typical (how often its tokens occur) and prefix (its rarest)."""
    tokens = classes.select("rep", F.posexplode("sig").alias("at", "value")).select("rep", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n_docs")).where("n_docs > 1")
    shared = tokens.join(counts, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n_docs", "token"))).alias("tokens"), F.sum("n_docs").alias("typical"))
    ranked = shared.where(F.size("tokens") >= least).select("rep", "typical", F.transform(F.slice("tokens", 1, F.size("tokens") - least + 1), lambda t: t["token"]).alias("prefix"))
    return ranked.join(classes.select("rep", "n", "sig"), "rep")


def _joined(pairs: DataFrame, table: DataFrame, key: str, other: str, total: int) -> DataFrame:
    """pairs joined with table on key, the pairs of a key that has many dealt out by `other`.

    Keys with more than PAIRS pairs, and more than a MOST_HOT-th of the total, are hot: fewer than
    MOST_HOT, so their table is broadcast. Their rows of table are repeated for each part.
    """
    limit = max(PAIRS, total // MOST_HOT)
    hot = F.broadcast(pairs.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = pairs.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("_parts")
    spread = table.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(spread, [key, "_part"]).drop("_part")


def _counted(pairs: DataFrame, posted: DataFrame, least: int, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity and that share enough coordinates."""
    total = pairs.count()
    one = posted.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = posted.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return _joined(_joined(pairs, one, "a", "b", total), two, "b", "a", total).where(sized).where(same >= least).select("a", "b", "n_a", "n_b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have the similarity."""
    total = pairs.count()
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("s_b"))
    both = _joined(_joined(pairs, one, "a", "b", total), two, "b", "a", total)
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b").distinct()


def _common(sets: DataFrame) -> DataFrame:
    """rep and common: how many of its shingles others of the sets have as well, a bound on every overlap."""
    alone = sets.select("rep", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1")
    alone = alone.groupBy("rep").agg(F.count("*").alias("alone"))
    return sets.select("rep", "spread", F.size("shingles").alias("n")).join(alone, "rep", "left").select("rep", "spread", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))


def _may_link(percent: int):
    """Whether two classes under one token can have the similarity, and this is the first token they share.

    An overlap is at most what both share with others, and at most the sum over ranges of the
    smaller count. The cheap tests come first.
    """
    enough = lambda overlap: 100 * overlap >= percent * (F.col("n_a") + F.col("n_b") - overlap)
    met_here = F.array_min(F.array_intersect("prefix_a", "prefix_b")) == F.col("token")["token"]
    spread = F.aggregate(F.zip_with("spread_a", "spread_b", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, v: s + v)
    capped = F.greatest("n_a", "n_b") >= 32767  # counts this large may have been cut
    return (F.col("component_a") != F.col("component_b")) & enough(F.least("common_a", "common_b")) & met_here & (capped | enough(spread))


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, k: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the component of each document under links of similar shingle sets.

    docs has doc_id and text; doc_id names one text, and rows that repeat it come back as often,
    each in the component of its own text. doc_id is a whole number. A null or empty text has no
    shingles, is linked with nothing and is kept. Texts of equal shingle sets are always linked. Ties between class
    representatives go to the smallest doc_id; a row without a doc_id is never kept. Other columns of docs are left out; an empty
    table gives no row. component_id is the smallest doc_id reachable.
    """
    least = least_matches(percent, k)
    scratch = Scratch(docs.sparkSession)
    base = scratch.write(signatures(docs, words, k))
    classes = scratch.write(base.where("n_shingles > 0").groupBy("set_a", "set_b", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    posted = scratch.write(_postings(classes, least))
    postings = posted.select("rep", "typical", F.explode("prefix").alias("token"))

    hubs = postings.groupBy("token").agg(F.max_by("rep", F.struct("typical", -F.col("rep"))).alias("hub"), F.count("*").alias("n_posted")).where("n_posted > 1")
    met = scratch.write(postings.join(hubs, "token").where("rep != hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct())
    first = scratch.write(_counted(met, posted, least, percent))
    ends = first.select(F.col("a").alias("id")).union(first.select("b")).distinct()
    links = scratch.write(_confirmed(first, shingle_sets(docs, ends, words), percent))
    parts = components(scratch, links)

    # Pairs that share a posting across components; those that met above are known.
    placed = postings.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("token", "rep", "typical", F.coalesce("component", "rep").alias("component"))
    split = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("component", F.struct("typical", -F.col("rep"))).alias("main")).where("low < high").select("token", "main")
    placed = scratch.write(placed.join(split, "token").select("token", "rep", "component", "main"))
    ids = placed.select(F.col("rep").alias("id")).distinct()
    sets = scratch.write(shingle_sets(docs, ids, words).join(ids.withColumnRenamed("id", "rep"), "rep", "left_semi").dropDuplicates(["rep"]))
    able = _common(sets).where(100 * F.col("common") >= percent * F.col("n")).join(posted.select("rep", "prefix"), "rep")
    members = scratch.write(placed.join(able, "rep"))
    named = lambda t, x: t.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "component", "n", "common", "prefix", "spread")])
    # Where many meet under one token, those outside its main component are dealt into parts, and each part meets all.
    parts_of = members.groupBy("token").agg(F.ceil(F.count_if(F.col("component") != F.col("main")) / MEETING).cast("int").alias("n_parts")).where("n_parts > 0")
    meeting = members.join(parts_of, "token")
    odd = named(meeting.where("component != main").withColumn("token", F.struct("token", F.pmod(F.xxhash64("rep"), F.col("n_parts")).cast("int").alias("part"))), "a")
    every = named(meeting.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).withColumn("token", F.struct("token", "part")), "b")
    across = odd.join(every, "token").where(_may_link(percent)).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    across = scratch.write(across)
    second = scratch.write(_counted(across, posted, least, percent))
    more = scratch.write(_confirmed(second, sets, percent))
    parts = components(scratch, links.union(more))

    of_class = classes.select("set_a", "set_b", F.col("n").alias("n_shingles"), F.col("rep").alias("id")).join(parts, "id", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b", "n_shingles"], "left")
    scratch.drop(posted, placed, sets, members, met, first, across, second, links, more)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def distinct(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all columns.

    Rows that repeat such a doc_id stay together; rows without a doc_id go. Texts are not
    shuffled, save those of ids that go and of few others: a filter of bounded size tells the rest apart.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(groups(docs, words, percent).select("doc_id", "kept"))
    gone = scratch.write(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.bool_or("kept").alias("kept")).where("not kept").select("id"))
    told = marked(docs.where("doc_id is not null"), "doc_id", gone)
    clear, doubtful = told.where(~F.col(MARKED)), told.where(MARKED)
    return clear.select(*docs.columns).unionByName(doubtful.join(gone.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti").select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: components of all documents, on shingles of 3 words with a similarity of 85 percent."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 85 * (u.n + v.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""
