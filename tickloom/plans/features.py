"""The feature table: ticks to 43 columns, with one exchange by instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.functions.book import Book, features
from tickloom.operators import flow, grid, targets
from tickloom.sources import ticks as tick_source


def tick_state(ticks: DataFrame, keys: tuple[str, ...] = flow.KEYS) -> DataFrame:
    """Ticks with aggressor, running volumes, cumulative volume and vwap."""
    return flow.cumulative(flow.volumes(flow.aggressor(ticks, keys=keys), keys), keys)


def tick_features(ticks: DataFrame, keys: tuple[str, ...] = flow.KEYS) -> DataFrame:
    """tick_state() with ready and all features that a tick alone tells."""
    book = Book.unrolled()
    return tick_state(ticks, keys).withColumn("ready", book.ready()).withColumns(features(book, F.col("ltp"), F.col("ready")) | flow.strength())


def grid_features(ticks: DataFrame, intervals_ms: tuple[int, ...] = (1000,), keys: tuple[str, ...] = flow.KEYS, flow_basis: str = "grid") -> DataFrame:
    """Grid rows with all features but the targets. Trade state is carried with the tick, so nothing looks ahead.

    What a tick alone tells is computed once for the tick, before it is carried to its grid
    points. flow_basis: order flow between neighbouring grid rows, or between neighbouring ticks.
    """
    state = tick_features(ticks, keys)
    if flow_basis == "tick":
        state = flow.order_flow(state, keys)
    state = tick_source.with_symbol(state)
    points = grid.resample(state, intervals_ms, keys)
    if flow_basis == "grid":
        points = flow.order_flow(points, (*keys, "interval_ms"), ("grid_seq",))
    return points


def feature_table(ticks: DataFrame, intervals_ms: tuple[int, ...] = (1000,), keys: tuple[str, ...] = flow.KEYS, flow_basis: str = "grid", exec_basis: str = "mid") -> DataFrame:
    """The feature table, interval_ms, and those of the keys that it lacks.

    Each set of keys has a grid of its own, with running volumes, order flow and targets that
    begin anew. ticks.BY_DAY deals a heavy instrument out by day.
    """
    out = targets.executable(targets.labels(targets.returns(grid_features(ticks, intervals_ms, keys, flow_basis), intervals_ms, keys=keys)), basis=exec_basis)
    return out.select(*schema.FEATURE_COLUMNS, "interval_ms", *[k for k in keys if k not in schema.FEATURE_COLUMNS])


def feature_runs(ticks: DataFrame, intervals_ms: tuple[int, ...] = (1000,), names: tuple[str, ...] = schema.IC_FEATURES, horizons: tuple[int, ...] = schema.HORIZONS_SEC, keys: tuple[str, ...] = flow.KEYS, digits: int | None = None) -> DataFrame:
    """keys, interval_ms, the named features and r_1s .. r_60s of those rows of the feature table whose grid reaches T + 60 s, and n_rows: neighbours that are alike are one row with their number.

    A row differs from the one before where the carried tick changes, one point after that (order
    flow is 0 then), and where the tick at T + horizon does. So the work follows the ticks, not the
    points of the grids. names are features of the tick or order flows; digits rounds features and returns.
    """
    flows = tuple(flow.between(Book.unrolled(), Book.unrolled()))
    own, moving = [n for n in names if n not in flows], [n for n in names if n in flows]
    fixed = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    each = (*keys, "interval_ms")
    runs = grid.runs(tick_features(ticks, keys), intervals_ms, keys)
    runs = flow.order_flow(runs, each, ("_low",))
    still = {n: F.when(F.col("ready"), x) for n, x in flow.between(Book.unrolled(), Book.unrolled()).items()}
    last = F.max("_high").over(Window.partitionBy(*each))
    runs = runs.withColumn("_last", last).select(*each, "_low", "_high", F.expr(f"(_last * delta_nanos - {max(schema.HORIZONS_SEC) * schema.SECOND}) div delta_nanos").alias("_end"), F.struct("mid_price").alias("_mid"), F.struct(F.col("mid_price").alias("_now"), *[fixed(F.col(n)).alias(n) for n in own]).alias("_own"),
                       F.struct(F.lit(0), *[fixed(F.col(n)).alias(n) for n in moving]).alias("_flow"), F.struct(F.lit(0), *[fixed(still[n]).alias(n) for n in moving]).alias("_still"))
    # What changes at which point: 0 the tick, -1 order flow, else the tick that many seconds on.
    marks = runs.withColumn("_kind", F.explode(F.array(*[F.lit(k) for k in (0, -1, *horizons)]))).where("_kind <> -1 or _high > _low")
    kind = F.col("_kind")
    marks = marks.select(*each, "_end", F.expr("CASE _kind WHEN 0 THEN _low WHEN -1 THEN _low + 1 ELSE _low - _kind * 1000 div interval_ms END").alias("_at"),
                         F.when(kind == 0, F.col("_own")).alias("_own"), F.when(kind == 0, F.col("_flow")).when(kind == -1, F.col("_still")).alias("_flow"), *[F.when(kind == h, F.col("_mid")).alias(f"_f{h}") for h in horizons])
    order = Window.partitionBy(*each).orderBy("_at")
    held = order.rowsBetween(Window.unboundedPreceding, 0)
    after = F.least(F.lead("_at").over(order), F.col("_end") + 1)  # the end alone behind the last mark
    rows = marks.select(*each, (after - F.greatest("_at", F.lit(1))).alias("n_rows"), *[F.last(c, ignorenulls=True).over(held).alias(c) for c in ("_own", "_flow", *[f"_f{h}" for h in horizons])]).where("n_rows > 0")
    now = F.col("_own._now")
    there = {h: F.col(f"_f{h}.mid_price") for h in horizons}
    return rows.select(*each, *[F.col(f"{'_flow' if n in moving else '_own'}.{n}").alias(n) for n in names], *[fixed(F.when((now > 0) & (x > 0), F.ln(x / now))).alias(f"r_{h}s") for h, x in there.items()], "n_rows")


def summary(table: DataFrame) -> DataFrame:
    """n_rows and the means of mid_price, spread, l1_obi, snapshot_age_ms and trade_strength."""
    return table.agg(F.count("*").alias("n_rows"), *[F.avg(c).alias(f"avg_{c}") for c in ("mid_price", "spread", "l1_obi", "snapshot_age_ms", "trade_strength")])
