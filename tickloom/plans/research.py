"""Rank correlation surfaces, their tests, false-discovery control and purged walk-forward folds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import exp, lgamma, log, log1p

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.sources.scratch import Scratch, local

PAIR = ("interval_ms", "horizon", "feature")


def below(scratch: Scratch, counts: DataFrame, keys: tuple[str, ...], c: str, n: str = "_t") -> DataFrame:
    """counts (keys, c, n) with _below, the sum of n over smaller values of c of the same keys.

    Values are dealt by range, so a key's values spread over many tasks; each task sums its own,
    and one row for each key and range carries the sums of the ranges before. The ranges are
    written, as both uses must see the same.
    """
    parts = scratch.write(counts.repartitionByRange(*keys, c).withColumn("_part", F.spark_partition_id()))
    order = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy(*keys, "_part").agg(F.sum(n).alias("_n")).select(*keys, "_part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part", *keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumn("_inside", F.coalesce(F.sum(n).over(own), F.lit(0)))
    return inside.join(before, [*keys, "_part"]).withColumn("_below", F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_part")


def _ranks(scratch: Scratch, counts: DataFrame, keys: tuple[str, ...], c: str) -> DataFrame:
    """counts (keys, c, _t) with _rank: twice the average rank of a value, 2 * (values below) + ties + 1."""
    return below(scratch, counts, keys, c).withColumn("_rank", 2 * F.col("_below") + F.col("_t") + 1).drop("_below")


def _correlation(n: Column, ab: Column, aa: Column, bb: Column) -> Column:
    """Of doubled ranks' exact sums of products; NULL where a side is constant or n < 3."""
    n = n.cast("double")
    mean = n * (n + 1) * (n + 1)  # n times the square of the doubled mean rank
    ab, aa, bb = (c.cast("double") - mean for c in (ab, aa, bb))
    return F.when((n >= 3) & (aa > 0) & (bb > 0), ab / F.sqrt(aa * bb))


#: Sums of products of ranks are exact for up to 5e11 pairs of a correlation.
_RANK, _SUM, _LOW = "decimal(13,0)", "decimal(24,0)", 21


def rank_ic(cells: DataFrame, keys: tuple[str, ...] = PAIR, x: str = "x", y: str = "y") -> DataFrame:
    """keys, n and ic: Spearman correlation with average ranks, NULL where a side is constant or n < 3; without null pairs.

    y's ranks are joined to the rows; then a value of x needs only its count and the sum of its
    rows' ranks of y. What is sorted is distinct values, dealt by range.
    """
    scratch = Scratch(cells.sparkSession)
    rows = scratch.write(cells.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null"))
    of_y = scratch.write(_ranks(scratch, rows.groupBy(*keys, "y").agg(F.count("*").alias("_t")), keys, "y"))
    sides = rows.join(of_y.select(*keys, "y", F.col("_rank").alias("_b")), [*keys, "y"]).groupBy(*keys, "x").agg(F.count("*").alias("_t"), F.sum(F.col("_b").cast(_RANK)).alias("_sb"))
    return _summed(scratch, sides, of_y, keys, keys)


def _summed(scratch: Scratch, sides: DataFrame, of_y: DataFrame, keys: tuple[str, ...], y_keys: tuple[str, ...]) -> DataFrame:
    """keys, n and ic from the values of x with their counts and sums of y's ranks, and the ranks of y."""
    big = lambda c, kind: F.col(c).cast(kind)
    of_x = _ranks(scratch, sides.withColumn("_sb", big("_sb", _SUM)), keys, "x")
    a = big("_rank", _RANK)
    left = of_x.groupBy(*keys).agg(F.sum("_t").alias("n"), F.sum(a * big("_sb", _SUM)).alias("_ab"), F.sum((a * a).cast("decimal(26,0)") * big("_t", "decimal(11,0)")).alias("_aa"))
    b = big("_rank", _RANK)
    right = of_y.groupBy(*y_keys).agg(F.sum((b * b).cast("decimal(26,0)") * big("_t", "decimal(11,0)")).alias("_bb"))
    return left.join(right, list(y_keys)).select(*keys, "n", _correlation(F.col("n"), F.col("_ab"), F.col("_aa"), F.col("_bb")).alias("ic"))


def _finite(c: str) -> Column:
    """The column as double, NULL where it is not a finite number."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def table_ic(table: DataFrame, features: tuple[str, ...] = schema.IC_FEATURES, horizons: tuple[int, ...] = schema.HORIZONS_SEC, n: str | None = None) -> DataFrame:
    """rank_ic() of all features against all forward returns of a feature table, by interval_ms, horizon and feature.

    The table is evaluated once. Features that are defined in the same rows share the ranks of
    the returns, and returns that are defined in the same rows share the pass over a feature's
    values, so neither the rows nor the ranks are made anew for each pair. A row stands for as many
    as its column n says, for one without it.
    """
    targets = tuple(f"r_{h}s" for h in horizons)
    missing = [c for c in (*features, *targets) if c not in table.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    scratch = Scratch(table.sparkSession)
    rows = scratch.write(table.select("interval_ms", *[_finite(c).alias(c) for c in (*features, *targets)], (F.col(n).cast("long") if n else F.lit(1).cast("long")).alias("_n")))
    columns = (*features, *targets)
    patterns = _patterns(rows, columns)
    out = [table.sparkSession.createDataFrame([], "interval_ms int, horizon int, feature string, n long, ic double")]
    for own in _alike(patterns, range(len(features))):
        defined = rows.where(F.col(columns[own[0]]).isNotNull())
        for ys in _alike({p for p in patterns if p >> own[0] & 1}, range(len(features), len(columns))):
            own_names, ys = tuple(columns[k] for k in own), tuple(columns[k] for k in ys)
            both = defined.where(F.col(ys[0]).isNotNull()).select("interval_ms", "_n", *own_names, *ys)
            pairs = F.explode(F.array(*[F.struct(F.lit(int(y[2:-1])).alias("horizon"), F.col(y).alias("y")) for y in ys]))
            each = both.select("interval_ms", "_n", pairs.alias("_p")).select("interval_ms", "_n", "_p.*")
            of_y = scratch.write(_ranks(scratch, each.groupBy("interval_ms", "horizon", "y").agg(F.sum("_n").alias("_t")), ("interval_ms", "horizon"), "y"))
            for y in ys:
                rank = of_y.where(F.col("horizon") == int(y[2:-1])).select("interval_ms", F.col("y").alias(y), F.col("_rank").alias(f"_b_{y}"))
                both = both.join(rank, ["interval_ms", y])
            values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in own_names]))
            # The high and the low bits of ranks are summed apart: both sums fit in a long.
            sums = [x for y in ys for x in (F.sum(F.shiftright(f"_b_{y}", _LOW) * F.col("_n")).alias(f"_h_{y}"), F.sum(F.col(f"_b_{y}").bitwiseAND((1 << _LOW) - 1) * F.col("_n")).alias(f"_l_{y}"))]
            wide = both.select("interval_ms", "_n", values.alias("_p"), *[f"_b_{y}" for y in ys]).select("interval_ms", "_n", "_p.*", *[f"_b_{y}" for y in ys])
            wide = wide.groupBy("interval_ms", "feature", "x").agg(F.sum("_n").alias("_t"), *sums)
            out.append(_table_sums(scratch, wide, of_y, ys))
    return reduce(DataFrame.union, out)


def _table_sums(scratch: Scratch, wide: DataFrame, of_y: DataFrame, ys: tuple[str, ...]) -> DataFrame:
    """interval_ms, horizon, feature, n and ic from the values of each feature with their counts and, for each return, the sum of its ranks."""
    of_x = _ranks(scratch, wide, ("interval_ms", "feature"), "x")
    of_x = of_x.withColumns({f"_s_{y}": ((F.col(f"_h_{y}").cast("decimal(20,0)") * F.lit(1 << _LOW).cast("decimal(7,0)")).cast("decimal(27,0)") + F.col(f"_l_{y}")).cast(_SUM) for y in ys})
    a, t = F.col("_rank").cast(_RANK), F.col("_t").cast("decimal(11,0)")
    left = of_x.groupBy("interval_ms", "feature").agg(F.sum("_t").alias("n"), F.sum((a * a).cast("decimal(26,0)") * t).alias("_aa"), *[F.sum(a * F.col(f"_s_{y}")).alias(f"_ab_{y}") for y in ys])
    products = F.explode(F.array(*[F.struct(F.lit(int(y[2:-1])).alias("horizon"), F.col(f"_ab_{y}").alias("_ab")) for y in ys]))
    left = left.select("interval_ms", "feature", "n", "_aa", products.alias("_p")).select("interval_ms", "feature", "n", "_aa", "_p.*")
    right = of_y.groupBy("interval_ms", "horizon").agg(F.sum((a * a).cast("decimal(26,0)") * t).alias("_bb"))
    return left.join(right, ["interval_ms", "horizon"]).select("interval_ms", "horizon", "feature", "n", _correlation(F.col("n"), F.col("_ab"), F.col("_aa"), F.col("_bb")).alias("ic"))


def _patterns(rows: DataFrame, columns: tuple[str, ...]) -> set[int]:
    """Which columns are defined together, as bits of a number for each kind of row: a few at most, whatever the rows."""
    mask = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(columns)))
    return {r[0] for r in rows.groupBy(mask.alias("_mask")).agg(F.lit(0)).collect()}


def _alike(patterns: set[int], places: range) -> list[list[int]]:
    """The columns at these places in groups that are defined in the same rows; those defined in none are left out."""
    out: list[list[int]] = []
    for k in places:
        if any(p >> k & 1 for p in patterns):
            same = next((g for g in out if all(p >> g[0] & 1 == p >> k & 1 for p in patterns)), None)
            (same.append(k) if same else out.append([k]))
    return out


def surface_tests(ic: DataFrame, intervals: tuple[int, ...] = schema.INTERVALS_MS, horizons: tuple[int, ...] = schema.HORIZONS_SEC, features: tuple[str, ...] = schema.IC_FEATURES) -> DataFrame:
    """tested() of every cell as one family, in the order of intervals, horizons and features (position).

    A cell that ic lacks has no pairs: n = 0 and no p-value. A cell beside them raises when it is counted.
    """
    cells = [(i, h, f, (a * len(horizons) + b) * len(features) + c) for a, i in enumerate(intervals) for b, h in enumerate(horizons) for c, f in enumerate(features)]
    columns = dict(zip(("interval_ms", "horizon", "feature", "position"), map(list, zip(*cells, strict=True)), strict=True))
    every = local(ic.sparkSession, columns, "interval_ms int, horizon int, feature string, position long")
    known = every.join(ic, ["interval_ms", "horizon", "feature"], "full").withColumn("position", F.when(F.col("position").isNotNull(), F.col("position")).otherwise(F.raise_error(F.lit("a test outside the surface")).cast("long")))
    return tested(known.withColumn("n", F.coalesce("n", F.lit(0)))).withColumn("family", F.lit("surface"))


def surface(ic: DataFrame, least: int = 30) -> DataFrame:
    """ic with what the surface shows: 0 for fewer than least pairs and for undefined correlations."""
    return ic.withColumn("ic", F.when(F.col("n") < least, 0.0).otherwise(F.coalesce("ic", F.lit(0.0))))


def composite(shown: DataFrame) -> DataFrame:
    """interval_ms, horizon and the mean absolute correlation over features."""
    return shown.groupBy("interval_ms", "horizon").agg(F.round(F.avg(F.abs("ic")), 9).alias("composite"))


def peak(cells: DataFrame) -> DataFrame:
    """The cell with the largest composite; the first in order of interval and horizon of equals."""
    return cells.orderBy(F.desc("composite"), "interval_ms", "horizon").limit(1)


def surface_json(shown: DataFrame, cells: DataFrame) -> DataFrame:
    """One row with the surface as JSON: each feature's correlations, the composite, and its peak. 250 cells at most."""
    each = shown.agg(F.sort_array(F.collect_list(F.struct("feature", "interval_ms", "horizon", "ic"))).alias("surfaces"))
    whole = cells.agg(F.sort_array(F.collect_list(F.struct("interval_ms", "horizon", "composite"))).alias("composite"), F.max_by(F.struct("interval_ms", "horizon", "composite"), F.struct("composite", -F.col("interval_ms"), -F.col("horizon"))).alias("peak"))
    return each.crossJoin(whole).select(F.to_json(F.struct("surfaces", "composite", "peak")).alias("value"))


def correlations(table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pearson correlations of all pairs of columns, as a, b and r; NULL where a column is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def r(a: str, b: str) -> Column:
        x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c)) for c in (a, b))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.when(spread > 0, F.covar_pop(x, y) / spread)

    row = table.agg(*[r(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("c")).select("c.*")


def brier(predicted: DataFrame, target: str) -> DataFrame:
    """The mean squared distance of three probabilities from what happened."""
    parts = [(F.col(p) - (F.col(target) == v).cast("double")) ** 2 for p, v in (("p_down", -1), ("p_neutral", 0), ("p_up", 1))]
    return predicted.agg(F.avg(parts[0] + parts[1] + parts[2]).alias("brier"))


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    # Evaluated from the tail: 1 / (1 + d1 / (1 + d2 / (1 + ...))).
    value = 1.0
    for i in range(300, 0, -1):
        m = i // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + d / value
    return front / value


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return _beta_tail(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def tested(ic: DataFrame) -> DataFrame:
    """ic with t_stat and p_value; NULL for an undefined correlation, infinite t and p = 0 for a perfect one.

    Only this small table, a row for each hypothesis, goes through Python.
    """
    t = F.col("ic") * F.sqrt((F.col("n") - 2) / (1 - F.col("ic") * F.col("ic")))
    perfect = F.when(F.col("ic") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    out = ic.withColumn("t_stat", F.when(F.abs("ic") >= 1, perfect).when(F.col("n") >= 3, t))

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else 0.0 if abs(a) == float("inf") else student_p(a, b - 2) for a, b in zip(t, n, strict=True)], dtype="float64")

    return out.withColumn("p_value", F.when(F.col("t_stat").isNotNull(), p("t_stat", "n")))


def benjamini_hochberg(tests: DataFrame, q: float = 0.05, family: tuple[str, ...] = ("family",), order: tuple[str, ...] = ("position",), p: str = "p_value") -> DataFrame:
    """tests with rank, p_adjusted and rejected, each family corrected on its own; an undefined p is not rejected.

    Tests are dealt by range of family, p and order, so a family spreads over many tasks; a row for
    each family and range carries the tests of the ranges before and the least adjusted p of those after.
    """
    scratch = Scratch(tests.sparkSession)
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    every = scratch.write(tests.withColumn("_ok", ok).repartitionByRange(*family, "_ok", p, *order).withColumn("_part", F.spark_partition_id()))
    keys = (*family, "_ok", "_part")

    def with_sums(rows: DataFrame, sums: DataFrame) -> DataFrame:
        """rows with the columns that sums has for their keys; a family can be NULL."""
        sums = sums.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in sums.columns if c not in keys])
        return rows.join(sums, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys)), "left").drop(*[f"_key_{k}" for k in keys])

    whole = Window.partitionBy(*family, "_ok")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = every.groupBy(*keys).agg(F.count("*").alias("_n"))
    counts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_m"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(p, *order))
    ranked = with_sums(every, counts).withColumn("rank", F.when(F.col("_ok"), place + F.col("_before")))
    adjusted = F.col(p) * F.col("_m") / F.col("rank")
    ends = ranked.where("_ok").groupBy(*keys).agg(F.min(adjusted).alias("_low"), F.max(F.when(F.col(p) <= q * F.col("rank") / F.col("_m"), F.col("rank"))).alias("_own"))
    after = whole.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, F.min("_low").over(after).alias("_after"), F.max("_own").over(whole).alias("_last"))
    # From the last test of a range to its first: a frame that grows is summed up once.
    smallest = F.least(F.min(adjusted).over(Window.partitionBy(*keys).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)), F.col("_after"))
    out = with_sums(ranked, ends)
    out = out.withColumns({"p_adjusted": F.when(F.col("_ok"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), smallest))), "rejected": F.coalesce(F.col("_ok") & (F.col("rank") <= F.col("_last")), F.lit(False))})
    return out.drop("_ok", "_m", "_part", "_before", "_after", "_last")


def report(tests: DataFrame) -> DataFrame:
    """Per family: n_tests, n_defined, n_discoveries, and the largest absolute correlation with its position."""
    size = F.abs("ic")
    return tests.groupBy("family").agg(F.count("*").alias("n_tests"), F.count("p_value").alias("n_defined"), F.count_if("rejected").alias("n_discoveries"), F.max(size).alias("best_abs_ic"), F.max_by("position", F.when(size.isNotNull(), F.struct(size, -F.col("position")))).alias("best_position"))


def deflated_sharpe() -> dict:
    """Not available: the table holds rank correlations, not a series of strategy returns."""
    return {"available": False, "reason": "a deflated Sharpe ratio needs strategy returns; this table holds rank correlations"}


def overlaps(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether two closed intervals share a point."""
    return (a[0] <= b[1]) & (b[0] <= a[1])


def purged(t: Column, start: Column | float, end: Column | float, lookback: float, tau: float, embargo: float) -> Column:
    """Whether a sample's feature interval [t - lookback, t] or label interval [t, t + tau] meets the embargoed test zone."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return t.between(start - embargo - tau, end + embargo + lookback)


def walk_forward(df: DataFrame, time: str, folds: int, lookback: float, tau: float, embargo: float) -> DataFrame:
    """df for each fold, with fold and part (train or test); purged and later rows are left out.

    Blocks are of distinct times in order: block = n div (folds + 1); fold i tests from block
    i + 1 on, the last to the end. The boundaries are found on the distinct times, of which each
    range partition counts its own; one row a partition and two a fold reach the driver.
    """
    bounds = fold_bounds(df.select(F.col(time).alias("t")).where(F.col(time).isNotNull()).distinct(), folds)
    zones = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(a).alias("test_start"), F.lit(b).alias("test_end")) for i, a, b in bounds])
    each = df.withColumn("_z", F.explode(zones)).select(*df.columns, "_z.*")
    t = F.col(time)
    test = t.between(F.col("test_start"), F.col("test_end"))
    train = (t < F.col("test_start")) & ~purged(t, F.col("test_start"), F.col("test_end"), lookback, tau, embargo)
    return each.withColumn("part", F.when(test, "test").when(train, "train")).where("part is not null").drop("test_start", "test_end")


def fold_bounds(distinct: DataFrame, folds: int) -> list[tuple]:
    """(fold, test start, test end) of distinct times t, without sorting them in one partition."""
    parts = Scratch(distinct.sparkSession).write(distinct.repartitionByRange("t").withColumn("part", F.spark_partition_id()))
    counts = dict(parts.groupBy("part").count().collect())  # a row for each partition
    n = sum(counts.values())
    if folds < 1 or n < folds + 1:
        raise ValueError("not enough times for the requested folds")
    block = n // (folds + 1)
    places = [(i, (i + 1) * block, n - 1 if i == folds - 1 else (i + 2) * block - 1) for i in range(folds)]
    starts, total = {}, 0
    for part in sorted(counts):
        starts[part], total = total, total + counts[part]
    wanted = F.lit(False)
    for place in {p for _, a, b in places for p in (a, b)}:
        part = max(k for k, s in starts.items() if s <= place)
        wanted = wanted | ((F.col("part") == part) & (F.col("place") == place - starts[part]))
    ranked = parts.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("t")) - 1)
    at = {starts[r["part"]] + r["place"]: r["t"] for r in ranked.where(wanted).collect()}
    return [(i, at[a], at[b]) for i, a, b in places]


def violations(split: DataFrame, time: str, lookback: float, tau: float, embargo: float) -> DataFrame:
    """Training rows whose intervals meet their fold's test zone: none if the folds are clean."""
    zones = split.where("part = 'test'").groupBy("fold").agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    t = F.col(time)
    zone = (F.col("_a") - embargo, F.col("_b") + embargo)
    hit = overlaps((t - lookback, t), zone) | overlaps((t, t + tau), zone)
    return split.where("part = 'train'").join(F.broadcast(zones), "fold").where(hit).drop("_a", "_b")


def block_bootstrap(values: pd.Series, block: int, draws: int, seed: int = 42) -> Iterator[float]:
    """Means of moving-block resamples of one ordered series."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x = values.to_numpy(dtype=float)
    n = len(x)
    for _ in range(draws):
        starts = rng.integers(0, max(1, n - block + 1), -(-n // block))
        yield float(np.concatenate([x[s : s + block] for s in starts])[:n].mean())
