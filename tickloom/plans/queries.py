"""The registered queries of this engine, and DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import schema, scores
from tickloom.functions.book import Book, features, percent
from tickloom.operators import extras, flow, grid, targets
from tickloom.plans import features as table
from tickloom.plans import export, ml, research, rows, trees
from tickloom.plans import surface as packed
from tickloom.sources import decoders, store, ticks, wal
from tickloom.sources.scratch import Scratch
from tickloom.streaming import book as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _rounded(c, digits: int):
    """c to so many digits, half away from zero, in plain arithmetic: faster than F.round for a few columns, slower where it makes a wide table's code too long to compile."""
    unit = float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * unit + 0.5) / unit + 0.0


_r9 = lambda c: F.round(c, 9)


def query(sql: str | None = None):
    """Register a function as the query of its name, with SQL of the same result."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    """A new folder among the shared ones of the session, removed when the driver ends."""
    return Scratch(spark).root


# --- SQL pieces ---------------------------------------------------------------------------


def d(x: float) -> str:
    """A number as a DOUBLE literal."""
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def sql_ticks(bad: bool = False, token: str = "user_id", crossed: bool = False, dated: bool = False, pace: int = 5) -> str:
    cents = {f"b{i}": f"base_c - {25 + 10 * i}" for i in range(5)} | {f"a{i}": f"base_c + {25 + 10 * i}" for i in range(5)}
    if bad:
        b0, a0 = cents["b0"], cents["a0"]
        cents["b0"] = f"CASE event_id % 50 WHEN 0 THEN {a0} WHEN 2 THEN 0 ELSE {b0} END"
        cents["a0"] = f"CASE event_id % 50 WHEN 0 THEN {b0} WHEN 1 THEN {b0} ELSE {a0} END"
        cents["b1"] = f"CASE event_id % 50 WHEN 3 THEN {b0} ELSE {cents['b1']} END"
        if crossed:
            cents["b0"], cents["a0"] = (f"CASE WHEN event_id % 5 < 2 THEN {other} ELSE {now} END" for other, now in ((a0, cents["b0"]), (b0, cents["a0"])))
    prices = ", ".join(f"({c}) / 1e2 AS {n}" for n, c in cents.items())
    qty = ", ".join(f"100 + ((event_id * {m} + {i * k} + {c}) % 500) * {5 - i} AS q{s}{i}" for s, m, k, c in (("b", 31, 17, 7), ("a", 37, 29, 11)) for i in range(5))
    orders = ", ".join(f"(1 + (event_id + {i}) % 10)::INTEGER AS o{s}{i}" for s in "ba" for i in range(5))
    day = ", strftime(ts, '%Y-%m-%d') AS trade_date" if dated else ""
    return f"""base AS (SELECT *, 10000 + CAST(round(value * 100) AS BIGINT) AS base_c, CASE event_type WHEN 'purchase' THEN 25 WHEN 'error' THEN -25 ELSE 0 END AS off FROM events),
ticks AS (SELECT {token} AS instrument_token, event_id AS seq, ((epoch_us(ts) - 1704067200000000) * {pace}) // 18 AS mono_nanos, epoch_us(ts) AS epoch_micros,
  coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS ltq, (base_c + off) / 1e2 AS ltp, {prices}, {qty}, {orders}{day} FROM base)"""


QUOTED = "(b0 > 0 AND a0 > 0)"
TAG = f"CASE WHEN NOT {QUOTED} THEN 'STATE_EMPTY_SIDE' WHEN b0 > a0 THEN 'STATE_CROSSED' WHEN b0 = a0 THEN 'STATE_LOCKED' ELSE 'NORMAL' END"
MONO = " AND ".join([f"(b{i} <= 0 OR b{i + 1} <= 0 OR b{i} > b{i + 1})" for i in range(4)] + [f"(a{i} <= 0 OR a{i + 1} <= 0 OR a{i} < a{i + 1})" for i in range(4)])
READY = f"(({TAG}) = 'NORMAL' AND {MONO})"
MID = f"CASE WHEN {QUOTED} THEN (b0 + a0) / 2e0 ELSE ltp END"
SPREAD = f"CASE WHEN {QUOTED} THEN a0 - b0 ELSE 0e0 END"


def sql_ratio(a: str, b: str, default: str = "0e0") -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE {default} END"


def sql_weighted(term: str, weights: tuple[float, ...]) -> str:
    return " + ".join(f"({term.format(i=i)}) * {d(w)}" for i, w in enumerate(weights))


def sql_features() -> dict[str, str]:
    exp = schema.exp_weights()
    side = lambda w, s: sql_weighted(f"q{s}{{i}}", w)
    obi = lambda w: sql_ratio(f"({side(w, 'b')}) - ({side(w, 'a')})", f"({side(w, 'b')}) + ({side(w, 'a')})")
    qb, qa = (" + ".join(f"q{s}{i}" for i in range(5)) for s in "ba")
    half = "(b0 + a0) / 2e0"
    micro = sql_ratio("a0 * qb0 + b0 * qa0", "qb0 + qa0", half)
    ready = lambda e: f"CASE WHEN {READY} THEN {e} END"
    pressure = f"(({micro}) - {half})"
    return {
        "best_bid": "coalesce(b0, 0e0)", "best_ask": "coalesce(a0, 0e0)", "mid_price": MID, "spread": SPREAD,
        "rel_spread_bps": f"({sql_ratio(SPREAD, MID)}) * 1e4",
        "l1_obi": ready(sql_ratio("qb0 - qa0", "qb0 + qa0")), "total_obi": ready(sql_ratio(f"({qb}) - ({qa})", f"({qb}) + ({qa})")),
        "w_obi_lin": ready(obi(schema.LINEAR_WEIGHTS)), "w_obi_exp": ready(obi(exp)),
        "microprice": ready(micro), "micro_pressure": ready(pressure), "micro_pressure_bps": ready(f"({sql_ratio(pressure, half)}) * 1e4"),
        "ml_microprice": ready(sql_ratio(sql_weighted("a{i} * qb{i} + b{i} * qa{i}", exp), sql_weighted("qb{i} + qa{i}", exp), half)),
    }


def sql_cols(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in cols.items())


def sql_flow(source: str, keys: str, order: str) -> str:
    """A select of source's columns with ready, first and the three flows."""
    fields = [f"{p}{s}{i}" for p in ("", "q") for s in "ba" for i in range(5)]
    lagged = ", ".join(f"lag({f}) OVER w AS p_{f}" for f in fields)
    one = lambda i: (
        f"((CASE WHEN b{i} > p_b{i} THEN qb{i} WHEN b{i} = p_b{i} THEN qb{i} - p_qb{i} ELSE -p_qb{i} END) - (CASE WHEN a{i} < p_a{i} THEN qa{i} WHEN a{i} = p_a{i} THEN qa{i} - p_qa{i} ELSE -p_qa{i} END))::DOUBLE"
    )
    total = lambda w: " + ".join(f"({one(i)}) * {d(x)}" for i, x in enumerate(w))
    flow_ = lambda e: f"CASE WHEN is_first THEN 0e0 WHEN ready AND p_ready THEN {e} END"
    return f"""SELECT * EXCLUDE (is_first, p_ready, {', '.join('p_' + f for f in fields)}), {flow_(one(0))} AS l1_ofi, {flow_(total(schema.OFI_UNIFORM_WEIGHTS))} AS ml_ofi_uniform, {flow_(total(schema.OFI_EXP_WEIGHTS))} AS ml_ofi_exp
FROM (SELECT *, lag(ready) OVER w AS p_ready, lag(true) OVER w IS NULL AS is_first, {lagged} FROM (SELECT *, {READY} AS ready FROM {source}) WINDOW w AS (PARTITION BY {keys} ORDER BY {order}))"""


SQL_SIDE = """moved AS (SELECT *, CASE WHEN ltq > 0 AND ltp > 0 THEN CASE WHEN a0 > 0 AND ltp >= a0 THEN 'BUY' WHEN b0 > 0 AND ltp <= b0 THEN 'SELL' WHEN ltp > prev THEN 'BUY' WHEN ltp < prev THEN 'SELL' END END AS moved
  FROM (SELECT *, last_value(CASE WHEN ltq > 0 AND ltp > 0 THEN ltp END IGNORE NULLS) OVER (PARTITION BY instrument_token ORDER BY mono_nanos, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ticks)),
sided AS (SELECT * EXCLUDE (prev, moved), CASE WHEN ltq > 0 AND ltp > 0 THEN coalesce(last_value(moved IGNORE NULLS) OVER (PARTITION BY instrument_token ORDER BY mono_nanos, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'UNKNOWN') END AS side FROM moved),
state AS (SELECT *, sum(CASE WHEN side = 'BUY' THEN ltq ELSE 0 END) OVER r::BIGINT AS buy_volume, sum(CASE WHEN side = 'SELL' THEN ltq ELSE 0 END) OVER r::BIGINT AS sell_volume,
  sum(CASE WHEN ltq > 0 THEN 1 ELSE 0 END) OVER r::BIGINT AS trade_count, sum(ltq) OVER r::BIGINT AS cum_volume, sum(CAST(round(ltp * 100) AS BIGINT) * ltq) OVER r::BIGINT AS cum_value
  FROM sided WINDOW r AS (PARTITION BY instrument_token ORDER BY mono_nanos, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
STRENGTH = {
    "trade_strength": sql_ratio("buy_volume - sell_volume", "buy_volume + sell_volume"),
    "buy_pressure": sql_ratio("buy_volume", "buy_volume + sell_volume", "0.5e0"),
    "sell_pressure": sql_ratio("sell_volume", "buy_volume + sell_volume", "0.5e0"),
}


def sql_grid(source: str, intervals: tuple[int, ...], flush: int | None = None) -> str:
    nxt = "lead(mono_nanos) OVER w" if flush is None else f"coalesce(lead(mono_nanos) OVER w, {flush})"
    return f"""spaced AS (SELECT *, {nxt} AS nxt, min(mono_nanos) OVER (PARTITION BY instrument_token) AS t0 FROM {source} WINDOW w AS (PARTITION BY instrument_token ORDER BY mono_nanos, seq)),
stepped AS (SELECT *, interval_ms::BIGINT * 1000000 AS delta_nanos FROM spaced, (SELECT unnest([{', '.join(map(str, intervals))}])::INTEGER AS interval_ms) WHERE nxt IS NOT NULL),
points AS (SELECT *, t0 + grid_seq * delta_nanos AS grid_nanos, greatest(0, t0 + grid_seq * delta_nanos - mono_nanos) / 1e6 AS snapshot_age_ms
  FROM (SELECT *, unnest(range((mono_nanos - t0) // delta_nanos + 1, (nxt - t0) // delta_nanos + 1)) AS grid_seq FROM stepped))"""


def sql_table(intervals: tuple[int, ...], **kind: bool | int) -> str:
    """WITH pieces that end in full_table, the feature table; kind as for sql_ticks."""
    lead = lambda h: f"last_value(mid_price) OVER (PARTITION BY instrument_token, interval_ms ORDER BY grid_nanos RANGE BETWEEN CURRENT ROW AND {h * schema.SECOND} FOLLOWING)"
    ret = ", ".join(f"CASE WHEN ripe AND f_{h} > 0 THEN ln(f_{h} / mid_price) END AS r_{h}s" for h in schema.HORIZONS_SEC)
    theta = lambda h: f"greatest({d(schema.SIGMA_DELTA * schema.ALPHA)} * sqrt({d(float(h * schema.SECOND))} / delta_nanos), {sql_ratio('spread', '2 * mid_price')})"
    y = ", ".join(f"CASE WHEN r_{h}s > {theta(h)} THEN 1 WHEN r_{h}s < -({theta(h)}) THEN -1 ELSE 0 END AS y_{h}s" for h in schema.HORIZONS_SEC)
    ex = ", ".join(f"CASE WHEN best_ask > 0 AND mid_price * exp(r_{h}s) > 0 THEN (mid_price * exp(r_{h}s) - best_ask) / best_ask - {d(scores.fixed_cost())} END AS exec_{h}s" for h in schema.HORIZONS_SEC)
    return f"""{sql_ticks(**kind)}, {SQL_SIDE}, {sql_grid('state', intervals)},
flows AS ({sql_flow('points', 'instrument_token, interval_ms', 'grid_seq')}),
feats AS (SELECT *, {sql_cols(sql_features())}, {sql_cols(STRENGTH)}, 'TOKEN_' || instrument_token AS symbol, {sql_ratio('cum_value', 'cum_volume * 100', 'ltp')} AS vwap FROM flows),
fwd AS (SELECT *, mid_price > 0 AND max(grid_nanos) OVER (PARTITION BY instrument_token, interval_ms) >= grid_nanos + {60 * schema.SECOND} AS ripe, {', '.join(f'{lead(h)} AS f_{h}' for h in schema.HORIZONS_SEC)} FROM feats),
rets AS (SELECT *, {ret} FROM fwd),
full_table AS (SELECT *, {y}, {ex} FROM rets)"""


_EXACT = {"trade_date", "grid_seq", "grid_nanos", "delta_nanos", "instrument_token", "symbol", "cum_volume", *(f"y_{h}s" for h in schema.HORIZONS_SEC), "interval_ms"}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) if c in _EXACT else _r9(F.col(c)).alias(c) for c in df.columns])


def sql_rounded(cols) -> str:
    return ", ".join(c if c in _EXACT else f"round({c}, 9) AS {c}" for c in cols)


# --- book --------------------------------------------------------------------------------


@query(f"WITH {sql_ticks()} SELECT * FROM ticks")
def tick_projection(spark, sf):
    return ticks.load(spark, sf)


@query(f"WITH {sql_ticks(True)} SELECT instrument_token, seq, {TAG} AS state_tag, {MONO} AS monotonic, {READY} AS ready FROM ticks")
def book_state_tags(spark, sf):
    b = Book.unrolled()
    return ticks.load(spark, sf, bad=True).select("instrument_token", "seq", b.tag().alias("state_tag"), b.monotonic().alias("monotonic"), b.ready().alias("ready"))


_QUOTES = ("best_bid", "best_ask", "mid_price", "spread", "rel_spread_bps")


def _suite(spark, sf, names, arrays: bool = False):
    rows = ticks.load(spark, sf, bad=True)
    if arrays:
        rows = ticks.snapshots(rows)
    b = Book.arrays() if arrays else Book.unrolled()
    f = features(b, F.col("ltp"), b.ready())
    return rows.select("instrument_token", "client_arrival_nanos" if arrays else "seq", *[f[n].alias(n) for n in names])


def _suite_sql(names, key: str = "seq") -> str:
    f = sql_features()
    return f"WITH {sql_ticks(True)} SELECT instrument_token, {key}, {sql_cols({n: f[n] for n in names})} FROM ticks"


@query(_suite_sql(_QUOTES))
def book_quotes(spark, sf):
    return _suite(spark, sf, _QUOTES)


_OBI = ("l1_obi", "total_obi", "w_obi_lin", "w_obi_exp")


@query(_suite_sql(_OBI))
def obi_suite(spark, sf):
    return _suite(spark, sf, _OBI)


_MICRO = ("microprice", "micro_pressure", "micro_pressure_bps", "ml_microprice")


@query(_suite_sql(_MICRO))
def microprice_suite(spark, sf):
    return _suite(spark, sf, _MICRO)


@query(_suite_sql((*_OBI, *_MICRO), "mono_nanos AS client_arrival_nanos"))
def array_book_suite(spark, sf):
    """The same functions on depth arrays."""
    return _suite(spark, sf, (*_OBI, *_MICRO), arrays=True)


@query(f"WITH {sql_ticks(True)}, f AS ({sql_flow('ticks', 'instrument_token', 'mono_nanos, seq')}) SELECT instrument_token, seq, ready, l1_ofi, ml_ofi_uniform, ml_ofi_exp FROM f")
def ofi_suite(spark, sf):
    return flow.order_flow(ticks.load(spark, sf, bad=True)).select("instrument_token", "seq", "ready", "l1_ofi", "ml_ofi_uniform", "ml_ofi_exp")


@query(f"WITH {sql_ticks()}, {SQL_SIDE} SELECT instrument_token, seq, side, buy_volume, sell_volume, trade_count FROM state")
def lee_ready_volumes(spark, sf):
    return flow.volumes(flow.aggressor(ticks.load(spark, sf))).select("instrument_token", "seq", "side", "buy_volume", "sell_volume", "trade_count")


@query(f"WITH {sql_ticks()}, {SQL_SIDE} SELECT instrument_token, seq, {sql_cols(STRENGTH)} FROM state")
def trade_strength(spark, sf):
    s = flow.strength()
    return flow.volumes(flow.aggressor(ticks.load(spark, sf))).select("instrument_token", "seq", *[c.alias(n) for n, c in s.items()])


@query(f"""WITH {sql_ticks()}, g AS (SELECT instrument_token, mono_nanos - lag(mono_nanos) OVER (PARTITION BY instrument_token ORDER BY mono_nanos, seq) AS gap FROM ticks)
SELECT instrument_token, count(gap) AS n_gaps, coalesce(avg(gap), 0e0) AS mean_gap, coalesce(min(gap), 0) AS min_gap, coalesce(max(gap), 0) AS max_gap, count(*) AS n_updates FROM g GROUP BY instrument_token""")
def arrival_gaps(spark, sf):
    return flow.arrival_gaps(ticks.load(spark, sf))


@query(f"""WITH {sql_ticks(True, 'user_id % 5', True)}, g AS (SELECT instrument_token, CASE WHEN tag = 'STATE_CROSSED' AND lag(tag) OVER w = 'STATE_CROSSED' THEN mono_nanos - lag(mono_nanos) OVER w ELSE 0 END AS gap
FROM (SELECT *, {TAG} AS tag FROM ticks) WINDOW w AS (PARTITION BY instrument_token ORDER BY mono_nanos, seq)) SELECT instrument_token, sum(gap)::BIGINT AS crossed_nanos FROM g GROUP BY instrument_token""")
def crossed_duration(spark, sf):
    """On all ticks, of five instruments so that crossed books, made of two events in five, are neighbours."""
    return flow.crossed_duration(ticks.load(spark, sf, bad=True, dense=True, crossed=True))


@query(f"""WITH {sql_ticks()} SELECT instrument_token, seq, mono_nanos, ltp, b0, a0, n_updates FROM (SELECT *, row_number() OVER (PARTITION BY instrument_token ORDER BY mono_nanos DESC, seq DESC) AS n, count(*) OVER (PARTITION BY instrument_token) AS n_updates FROM ticks) WHERE n = 1""")
def latest_book(spark, sf):
    return flow.latest(ticks.load(spark, sf).select("instrument_token", "seq", "mono_nanos", "ltp", "b0", "a0"))


@query(f"""WITH {sql_ticks()} SELECT instrument_token, seq, ltp FROM (SELECT *, row_number() OVER (PARTITION BY instrument_token ORDER BY mono_nanos DESC, seq DESC) AS n FROM ticks) WHERE n <= 300""")
def chart_tail(spark, sf):
    return flow.tail(ticks.load(spark, sf)).select("instrument_token", "seq", "ltp")


@query("SELECT c_custkey AS instrument_token, CASE WHEN c_custkey % 3 = 0 THEN 'TOKEN_' || c_custkey ELSE c_name END AS symbol FROM customer")
def symbol_lookup(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    names = c.where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("instrument_token"), F.col("c_name").alias("symbol"))
    return ticks.with_symbol(c.select(F.col("c_custkey").alias("instrument_token")), names)


# --- grids -------------------------------------------------------------------------------

_GRID = ("instrument_token", "interval_ms", "grid_seq", "grid_nanos", "delta_nanos", "snapshot_age_ms", "seq", "ltp")


@query(f"WITH {sql_ticks()}, {sql_grid('ticks', (1000,))} SELECT {', '.join(_GRID)} FROM points")
def locf_grid_1000ms(spark, sf):
    return grid.resample(ticks.load(spark, sf)).select(*_GRID)


@query(f"WITH {sql_ticks()}, {sql_grid('ticks', schema.INTERVALS_MS)} SELECT instrument_token, interval_ms, count(*) AS n_points, sum(grid_nanos)::BIGINT AS sum_nanos, sum(seq)::BIGINT AS sum_seq, max(grid_seq) AS last_seq FROM points GROUP BY ALL")
def locf_multi_grid(spark, sf):
    g = grid.resample(ticks.load(spark, sf).select("instrument_token", "mono_nanos", "seq"), schema.INTERVALS_MS)
    return g.groupBy("instrument_token", "interval_ms").agg(F.count("*").alias("n_points"), F.sum("grid_nanos").alias("sum_nanos"), F.sum("seq").alias("sum_seq"), F.max("grid_seq").alias("last_seq"))


_END = 725 * schema.SECOND


@query(f"WITH {sql_ticks()}, {sql_grid('ticks', (2000,), _END)} SELECT {', '.join(_GRID)} FROM points")
def grid_flush(spark, sf):
    return grid.resample(ticks.load(spark, sf), (2000,), flush=F.lit(_END)).select(*_GRID)


@query(f"WITH {sql_ticks()}, {sql_grid('ticks', schema.INTERVALS_MS)} SELECT instrument_token, interval_ms, count(*) AS n_points, count(*) FILTER (snapshot_age_ms > {schema.STALE_MS}) AS n_stale FROM points GROUP BY ALL")
def stale_points(spark, sf):
    return grid.staleness(grid.resample(ticks.load(spark, sf).select("instrument_token", "mono_nanos", "seq"), schema.INTERVALS_MS))


# --- feature table -----------------------------------------------------------------------

_RETURNS = ("instrument_token", "grid_seq", *(f"r_{h}s" for h in schema.HORIZONS_SEC))


@query(f"WITH {sql_table((1000,))} SELECT {sql_rounded(_RETURNS)} FROM full_table")
def forward_returns(spark, sf):
    return rounded(table.feature_table(ticks.load(spark, sf)).select(*_RETURNS))


_LABELS = ("instrument_token", "grid_seq", *(f"y_{h}s" for h in schema.HORIZONS_SEC))


@query(f"WITH {sql_table((1000,))} SELECT {', '.join(_LABELS)} FROM full_table")
def direction_labels(spark, sf):
    return table.feature_table(ticks.load(spark, sf)).select(*_LABELS)


_EXECS = ("instrument_token", "grid_seq", *(f"exec_{h}s" for h in schema.HORIZONS_SEC))


@query(f"WITH {sql_table((1000,))} SELECT {sql_rounded(_EXECS)} FROM full_table")
def exec_returns(spark, sf):
    return rounded(table.feature_table(ticks.load(spark, sf)).select(*_EXECS))


@query(f"WITH {sql_table((1000,))} SELECT {sql_rounded((*schema.FEATURE_COLUMNS, 'interval_ms'))} FROM full_table")
def feature_table(spark, sf):
    return rounded(table.feature_table(ticks.load(spark, sf)))


@query(f"WITH {sql_table(schema.INTERVALS_MS)} SELECT interval_ms, count(*) AS n_rows, round(avg(mid_price), 6) AS avg_mid, round(avg(l1_ofi), 6) AS avg_ofi, round(avg(r_5s), 9) AS avg_r5, round(avg(exec_60s), 9) AS avg_exec60, sum(y_10s)::BIGINT AS sum_y10 FROM full_table GROUP BY interval_ms")
def multi_grid_features(spark, sf):
    t = table.feature_table(ticks.load(spark, sf), schema.INTERVALS_MS)
    return t.groupBy("interval_ms").agg(F.count("*").alias("n_rows"), F.round(F.avg("mid_price"), 6).alias("avg_mid"), F.round(F.avg("l1_ofi"), 6).alias("avg_ofi"), F.round(F.avg("r_5s"), 9).alias("avg_r5"), F.round(F.avg("exec_60s"), 9).alias("avg_exec60"), F.sum("y_10s").alias("sum_y10"))


_DAILY = ("trade_date", "instrument_token", "grid_seq", "snapshot_age_ms", "mid_price", "l1_ofi", "trade_strength", "cum_volume", "r_5s", "y_5s", "exec_60s")


@query(f"WITH {sql_table((1000,), dated=True, pace=50)} SELECT {sql_rounded(_DAILY)} FROM full_table".replace("PARTITION BY instrument_token", "PARTITION BY trade_date, instrument_token"))
def daily_features(spark, sf):
    """The feature table with all state begun anew each day, ten times as fast a clock."""
    return rounded(table.feature_table(ticks.load(spark, sf, dated=True, pace=50), keys=ticks.BY_DAY).select(*_DAILY))


_AVG = ("mid_price", "spread", "l1_obi", "snapshot_age_ms", "trade_strength")


@query(f"WITH {sql_table((1000,))} SELECT count(*) AS n_rows, {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in _AVG)} FROM full_table")
def feature_summary(spark, sf):
    s = table.summary(table.feature_table(ticks.load(spark, sf)))
    return s.select("n_rows", *[F.round(f"avg_{c}", 6).alias(f"avg_{c}") for c in _AVG])


@query(f"WITH {sql_table((1000,))} SELECT instrument_token, grid_seq, round(mid_price, 9) AS mid_price, 1000 AS interval_ms FROM full_table")
def feature_store(spark, sf):
    """Written as partitions and read back, all instruments; pruning has a test of its own."""
    path = folder(spark)
    store.write_features(table.feature_table(ticks.load(spark, sf)), path, "2024-01-02")
    t = store.read_features(spark, path, 1000, "2024-01-02")
    return t.select(F.col("instrument_token").cast("bigint").alias("instrument_token"), "grid_seq", _r9(F.col("mid_price")).alias("mid_price"), "interval_ms")


_VALUES = "CAST(round(o_totalprice * 100) AS BIGINT) / 1e2"


@query(f"""WITH o AS (SELECT o_orderkey, {_VALUES} AS v, o_orderkey % 2 = 0 AS old FROM orders),
s AS (SELECT *, CASE WHEN old THEN 3.45e-5 ELSE 2.97e-5 END AS ex FROM o),
c AS (SELECT *, least(4e1, v * 2e0 * 3e-4) AS br, v * 2e0 * ex AS xf, v * 2e0 * 1e-6 AS sf FROM s)
SELECT o_orderkey, CASE WHEN old THEN 'NSE_EQUITY_LEGACY_2023' ELSE 'NSE_EQUITY_OCT_2024' END AS schedule, round(CASE WHEN v > 0 THEN (br + v * 2.5e-4 + xf + sf + (br + xf + sf) * 1.8e-1 + v * 3e-5) / v ELSE 0e0 END, 9) AS cost FROM c""")
def cost_rates(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.to_date(F.lit("2024-09-30"))).otherwise(F.when(F.col("o_orderkey") % 3 == 0, F.to_date(F.lit("2024-10-01"))))
    value = F.round(F.col("o_totalprice") * 100).cast("bigint") / 100.0
    return scores.with_schedule(o.select("o_orderkey", value.alias("v"), day.alias("day")), "day").select("o_orderkey", "schedule", _r9(scores.round_trip_cost(F.col("v"))).alias("cost"))


_SCORE = "greatest(-1e0, least(1e0, 3.5e-1 * greatest(-1e0, least(1e0, coalesce(w_obi_lin, 0e0))) + 3.5e-1 * greatest(-1e0, least(1e0, coalesce(trade_strength, 0e0))) + 3e-1 * tanh(coalesce(micro_pressure_bps, 0e0) / 5e1)))"


@query(f"WITH {sql_table((1000,))}, s AS (SELECT instrument_token, grid_seq, round({_SCORE}, 9) AS score FROM full_table) SELECT *, CASE WHEN score > 1.5e-1 THEN 1 WHEN score < -1.5e-1 THEN -1 ELSE 0 END AS label, round(CASE WHEN score > 0 THEN abs(score) * 1e2 ELSE 0e0 END, 7) AS up_percent, round(1e2 - abs(score) * 1e2, 7) AS neutral_percent FROM s")
def baseline_score(spark, sf):
    t = table.grid_features(ticks.load(spark, sf)).select("instrument_token", "grid_seq", _rounded(scores.baseline_score(F.col("w_obi_lin"), F.col("trade_strength"), F.col("micro_pressure_bps")), 9).alias("score"))
    split = scores.display_split(F.col("score"))
    return t.select("*", scores.band(F.col("score")).alias("label"), _rounded(split["up_percent"], 7).alias("up_percent"), _rounded(split["neutral_percent"], 7).alias("neutral_percent"))


# --- sessions ----------------------------------------------------------------------------

_LOCAL = "(ts + INTERVAL 330 MINUTE)"
_MINUTE = f"(extract(hour FROM {_LOCAL}) * 60 + extract(minute FROM {_LOCAL}))"
_PHASE = f"CASE WHEN isodow({_LOCAL}) >= 6 THEN 'CLOSED' " + " ".join(f"WHEN {_MINUTE} >= {m} THEN '{p}'" for m, p in reversed(scores.PHASES)) + " END"


@query(f"SELECT event_id, {_PHASE} AS phase FROM events")
def session_phases(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", scores.session_phase(F.col("ts").cast("timestamp")).alias("phase"))


@query(f"SELECT user_id, event_id, phase, before AS phase_before FROM (SELECT user_id, event_id, phase, lag(phase) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, {_PHASE} AS phase FROM events)) WHERE before IS NULL OR before <> phase")
def phase_transitions(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("phase", scores.session_phase(F.col("ts").cast("timestamp")))
    return flow.phase_changes(e, "phase", ("user_id",), ("ts", "event_id")).select("user_id", "event_id", "phase", "phase_before")


# --- research ----------------------------------------------------------------------------


def sql_ic(intervals: tuple[int, ...], horizons: tuple[int, ...], names: tuple[str, ...]) -> str:
    cells = " UNION ALL ".join(f"SELECT interval_ms, {h} AS horizon, '{f}' AS feature, round({f}, 9) AS x, round(r_{h}s, 9) AS y FROM full_table" for h in horizons for f in names)
    over = "OVER (PARTITION BY interval_ms, horizon, feature"
    rank = lambda c: f"2 * rank() {over} ORDER BY {c}) + count(*) {over}, {c}) - 1"
    return f"""WITH {sql_table(intervals)}, cells AS (SELECT * FROM ({cells}) WHERE x IS NOT NULL AND y IS NOT NULL),
ranks AS (SELECT interval_ms, horizon, feature, {rank('x')} AS a, {rank('y')} AS b FROM cells),
sums AS (SELECT interval_ms, horizon, feature, count(*) AS n, sum(a::HUGEINT * b)::DOUBLE AS ab, sum(a::HUGEINT * a)::DOUBLE AS aa, sum(b::HUGEINT * b)::DOUBLE AS bb, count(*)::DOUBLE * (count(*)::DOUBLE + 1) * (count(*)::DOUBLE + 1) AS mean FROM ranks GROUP BY ALL),
ic AS (SELECT interval_ms, horizon, feature, n, CASE WHEN n >= 3 AND aa - mean > 0 AND bb - mean > 0 THEN (ab - mean) / sqrt((aa - mean) * (bb - mean)) END AS ic FROM sums)"""


def _ic(spark, sf, intervals, horizons, names):
    return packed.runs_ic(ticks.load(spark, sf), intervals, names, horizons)


@query(sql_ic((1000,), (5,), schema.IC_FEATURES) + " SELECT interval_ms, horizon, feature, n, round(ic, 9) AS ic FROM ic")
def rank_ic_1s_grid(spark, sf):
    return _ic(spark, sf, (1000,), (5,), schema.IC_FEATURES).withColumn("ic", _r9(F.col("ic")))


#: All intervals, horizons and features: 250 hypotheses.
_WHOLE = (schema.INTERVALS_MS, schema.HORIZONS_SEC, schema.IC_FEATURES)
_SHOWN = ", shown AS (SELECT interval_ms, horizon, round(avg(abs(CASE WHEN n < 30 THEN 0e0 ELSE coalesce(ic, 0e0) END)), 9) AS composite FROM ic GROUP BY ALL)"


@query(sql_ic(*_WHOLE) + " SELECT interval_ms, horizon, feature, n, round(ic, 9) AS ic FROM ic")
def rank_ic_surface(spark, sf):
    """The correlations of all 250 hypotheses."""
    return _ic(spark, sf, *_WHOLE).withColumn("ic", _r9(F.col("ic")))


@query(sql_ic(*_WHOLE) + _SHOWN + " SELECT * FROM shown")
def information_surface(spark, sf):
    return research.composite(research.surface(_ic(spark, sf, *_WHOLE)))


@query(sql_ic(*_WHOLE) + _SHOWN + " SELECT * FROM shown ORDER BY composite DESC, interval_ms, horizon LIMIT 1")
def surface_peak(spark, sf):
    return research.peak(research.composite(research.surface(_ic(spark, sf, *_WHOLE))))


@query()
def surface_tests(spark, sf):
    """Rank correlations of the whole surface with their p-values, corrected as one family; the t tail has no SQL form."""
    t = research.surface_tests(_ic(spark, sf, *_WHOLE))
    return research.benjamini_hochberg(t).withColumn("rank", F.col("rank").cast("int"))


_P = "CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE ((p_partkey * 7919) % 10007) * ((p_partkey * 104729) % 10009) / 1.00160063e8 / 50 END"


@query(f"""WITH t AS (SELECT p_partkey AS position, CASE WHEN p_partkey % 2 = 0 THEN 'surface' ELSE 'cross_broker' END AS family, {_P} AS p_value FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value, position) AS k, count(*) OVER (PARTITION BY family) AS m FROM t WHERE p_value IS NOT NULL),
j AS (SELECT *, max(CASE WHEN p_value <= 5e-2 * k / m THEN k END) OVER (PARTITION BY family) AS last, min(p_value * m / k) OVER (PARTITION BY family ORDER BY p_value, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS adj FROM k)
SELECT t.position, t.family, t.p_value, coalesce(k, 0) AS rank, CASE WHEN k IS NOT NULL THEN greatest(0e0, least(1e0, adj)) END AS p_adjusted, coalesce(k <= last, false) AS rejected FROM t LEFT JOIN j USING (position, family)""")
def bh_fdr(spark, sf):
    k = F.col("p_partkey")
    p = F.when(k % 97 != 0, ((k * 7919) % 10007) * ((k * 104729) % 10009) / 100160063.0 / 50)
    t = spark.read.parquet(f"{sf}/part.parquet").select(k.alias("position"), F.when(k % 2 == 0, "surface").otherwise("cross_broker").alias("family"), p.alias("p_value"))
    return research.benjamini_hochberg(t).withColumn("rank", F.coalesce(F.col("rank").cast("bigint"), F.lit(0)))


_FOLDS = f"""WITH {sql_ticks()}, x AS (SELECT seq, mono_nanos AS t FROM ticks), o AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS place FROM (SELECT DISTINCT t FROM x)),
n AS (SELECT count(*) AS n, count(*) // 4 AS block FROM o), f AS (SELECT unnest([0, 1, 2])::INTEGER AS fold),
z AS (SELECT fold, min(t) AS a, max(t) AS b FROM f, n, o WHERE place >= (fold + 1) * block AND (fold = 2 OR place < (fold + 2) * block) GROUP BY fold),
s AS (SELECT seq, t, fold, CASE WHEN t BETWEEN a AND b THEN 'test' WHEN t < a AND NOT (t BETWEEN a - 7000000000 AND b + 7000000000) THEN 'train' END AS part FROM x, z)"""


@query(_FOLDS + " SELECT fold, part, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM s WHERE part IS NOT NULL GROUP BY ALL")
def walk_forward_folds(spark, sf):
    s = _split(spark, sf)
    return s.groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def _split(spark, sf):
    x = ticks.load(spark, sf).select("seq", F.col("mono_nanos").alias("t"))
    return research.walk_forward(x, "t", 3, 5 * schema.SECOND, 5 * schema.SECOND, 2 * schema.SECOND)


@query(_FOLDS + " SELECT seq, fold FROM s WHERE part = 'train'")
def purged_train(spark, sf):
    return _split(spark, sf).where("part = 'train'").select("seq", "fold")


@query(_FOLDS + """, train AS (SELECT * FROM s WHERE part = 'train'), zone AS (SELECT fold, min(t) - 2000000000 AS a, max(t) + 2000000000 AS b FROM s WHERE part = 'test' GROUP BY fold)
SELECT count(*) AS n_violations FROM train JOIN zone USING (fold) WHERE (t - 5000000000 <= b AND a <= t) OR (t <= b AND a <= t + 5000000000)""")
def fold_violations(spark, sf):
    s = _split(spark, sf)
    return research.violations(s, "t", 5 * schema.SECOND, 5 * schema.SECOND, 2 * schema.SECOND).agg(F.count("*").alias("n_violations"))


# --- sources and sinks -------------------------------------------------------------------


@query(f"WITH {sql_ticks()}, {SQL_SIDE} SELECT instrument_token, seq, mono_nanos, epoch_micros, ltp, ltq, cum_volume, {sql_ratio('cum_value', 'cum_volume * 100', 'ltp')} AS vwap, ltp - 0.25e0 AS b0, ltp + 0.25e0 AS a0, 100::BIGINT AS qb0, 100::BIGINT AS qa0 FROM state")
def wal_roundtrip(spark, sf):
    """Ticks written as frame logs and decoded again."""
    path = folder(spark)
    wal.write(flow.cumulative(ticks.load(spark, sf)), path)
    return wal.ticks(wal.read(spark, path)).select("instrument_token", "seq", "mono_nanos", "epoch_micros", "ltp", "ltq", "cum_volume", "vwap", "b0", "a0", "qb0", "qa0")


def _hex(c, size: int):
    return F.lpad(F.hex(c.cast("bigint")), 2 * size, "0")


_ARRAY = lambda side, p="": "[" + ", ".join(f"{p}{side}{i}" for i in range(5)) + "]"
_SNAP = ("instrument_token", "symbol", "client_arrival_nanos", "ltp", "ltq", "bid_prices", "bid_quantities", "bid_orders", "ask_prices", "ask_quantities", "ask_orders", "state_tag")


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as text, prices in cents, which compares alike in both engines."""
    text = lambda c, t: F.to_json(F.transform(c, lambda v: F.round(v * 100).cast("bigint")) if t == "array<double>" else F.col(c))
    return df.select(*[text(c, t).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def _flat_sql(more: int = 0) -> str:
    """more: levels of zeros beyond the five."""
    text = lambda e: f"'[' || array_to_string(list_concat({e}, [{', '.join(['0'] * more)}]), ',') || ']'"
    cents = lambda s: f"list_transform({_ARRAY(s)}, lambda v: CAST(round(v * 100) AS BIGINT))"
    parts = ", ".join(f"{text(cents(s))} AS {n}_prices, {text(_ARRAY(s, 'q'))} AS {n}_quantities, {text(_ARRAY(s, 'o'))} AS {n}_orders" for n, s in (("bid", "b"), ("ask", "a")))
    return f"instrument_token, 'TOKEN_' || instrument_token AS symbol, mono_nanos AS client_arrival_nanos, ltp, ltq, {parts}, {TAG} AS state_tag"


@query(f"WITH {sql_ticks(True)} SELECT {_flat_sql()} FROM ticks")
def kite_decode(spark, sf):
    """Ticks as 184-byte packets and decoded again."""
    t = ticks.load(spark, sf, bad=True)
    cents = lambda c: F.round(F.col(c) * 100)
    header = [_hex(F.col("instrument_token"), 4), _hex(cents("ltp"), 4), _hex(F.col("ltq"), 4), _hex(cents("ltp"), 4), _hex(F.col("ltq"), 4), F.lit("0" * 16), F.lit("0" * 64), _hex(F.expr("epoch_micros div 1000000"), 4)]
    depth = [x for s in "ba" for i in range(5) for x in (_hex(F.col(f"q{s}{i}"), 4), _hex(cents(f"{s}{i}"), 4), _hex(F.col(f"o{s}{i}"), 2), F.lit("0000"))]
    p = t.select(F.unhex(F.concat(*header, *depth)).alias("packet"), F.col("mono_nanos").alias("arrival_nanos"), F.col("epoch_micros").alias("arrival_micros"))
    return _flat(decoders.kite(p).select(*_SNAP))


@query(f"WITH {sql_ticks(True)} SELECT {_flat_sql(15)} FROM ticks")
def dhan_decode(spark, sf):
    """Ticks as JSON messages of five levels and decoded again; the levels beyond, up to 20, are zeros."""
    t = ticks.load(spark, sf, bad=True)
    side = lambda s: F.array(*[F.struct(F.col(f"{s}{i}").alias("price"), F.col(f"q{s}{i}").alias("quantity"), F.col(f"o{s}{i}").alias("orders")) for i in range(5)])
    message = F.to_json(F.struct(F.col("instrument_token").cast("string").alias("securityId"), F.col("ltp").alias("LTP"), F.col("ltq").alias("LTQ"), F.struct(side("b").alias("buy"), side("a").alias("sell")).alias("depth")))
    out = decoders.dhan(t.select(message.alias("json"), F.col("mono_nanos").alias("arrival_nanos"), F.col("epoch_micros").alias("arrival_micros")))
    return _flat(out.select(*_SNAP))


def _sql_levels(side: str) -> str:
    return "[" + ", ".join(f"{side}{i}" for i in range(5)) + "]"


_IMBALANCE = f"(coalesce({sql_features()['l1_obi']}, 0e0) * 1e2)"


@query(f"""WITH {sql_ticks(True)} SELECT 'orderbook_snapshot' AS type, 'MOCK' AS source, instrument_token, 'TOKEN_' || instrument_token AS symbol, epoch_micros AS arrival_micros, ltp, ltq, ltq AS volume, ltp AS vwap,
round({MID}, 9) AS mid, round({SPREAD}, 9) AS spread, {TAG} AS tag, round(greatest(-1e2, least(1e2, {_IMBALANCE})), 6) AS imbalance, 0e0 AS strength, 'MODE_BASELINE_ACTIVE' AS mode, 0e0 AS down, 1e2 AS neutral, 0e0 AS up, 0e0 AS score, false AS calibrated,
{", ".join(f"round(list_sum(list_transform({_sql_levels(s)}, lambda v: v)), 6) AS {n}_prices, list_sum({_sql_levels('q' + s)})::BIGINT AS {n}_quantities, list_sum({_sql_levels('o' + s)})::BIGINT AS {n}_orders" for s, n in (("b", "bid"), ("a", "ask")))},
greatest({', '.join(f'q{s}{i}' for s in 'ba' for i in range(5))}, 1)::BIGINT AS depth_scale, CASE WHEN {_IMBALANCE} > 0.25 THEN 'buy' WHEN {_IMBALANCE} < -0.25 THEN 'sell' ELSE 'neutral' END AS gauge FROM ticks""")
def ui_messages(spark, sf):
    """Dashboard messages: all 22 fields, read back from their JSON, levels as their sums."""
    s = ticks.snapshots(ticks.load(spark, sf, bad=True))
    b = Book.arrays()
    m = store.messages(s, b.obi(b.ready()), F.lit(0.0))
    level = "array<struct<price: double, quantity: bigint, orders: int>>"
    names = {
        "type": ("type", "string"), "sourceId": ("source", "string"), "symbol": ("symbol", "string"), "clientArrivalMicros": ("arrival_micros", "bigint"), "ltp": ("ltp", "double"), "ltq": ("ltq", "bigint"),
        "cumulativeVolume": ("volume", "bigint"), "dayVwap": ("vwap", "double"), "stateTag": ("tag", "string"), "tradeStrengthPercent": ("strength", "double"), "predictionMode": ("mode", "string"),
        "probabilityDownPercent": ("down", "double"), "probabilityNeutralPercent": ("neutral", "double"), "probabilityUpPercent": ("up", "double"), "predictionScorePercent": ("score", "double"), "calibratedProbabilities": ("calibrated", "boolean"),
    }
    schema_ = ", ".join([f"{k} {t}" for k, (_, t) in names.items()] + ["instrumentToken bigint", "midPrice double", "spread double", "depthImbalancePercent double", f"bids {level}", f"asks {level}"])
    total = lambda c, f, zero: F.aggregate(F.transform(F.col(f"j.{c}"), lambda v: v[f]), zero, lambda a, v: a + v)
    sums = [x for c, n in (("bids", "bid"), ("asks", "ask")) for x in (F.round(total(c, "price", F.lit(0.0)), 6).alias(f"{n}_prices"), total(c, "quantity", F.lit(0).cast("bigint")).alias(f"{n}_quantities"), total(c, "orders", F.lit(0)).cast("bigint").alias(f"{n}_orders"))]
    j = m.select(F.from_json("message", schema_).alias("j"), "depth_scale", "gauge")
    return j.select(*[F.col(f"j.{k}").alias(n) for k, (n, _) in names.items()], F.col("j.instrumentToken").alias("instrument_token"), _r9(F.col("j.midPrice")).alias("mid"), _r9(F.col("j.spread")).alias("spread"), F.round("j.depthImbalancePercent", 6).alias("imbalance"), *sums, "depth_scale", "gauge")


@query("""WITH r AS (SELECT s_name AS source, s_suppkey % 3 = 0 AS credentials, s_suppkey % 2 = 0 AS implemented, s_suppkey = 6 AS selected, CASE WHEN s_suppkey = 6 THEN ' ' || s_nationkey || ', 536,' || s_nationkey || ',,7 ' ELSE s_nationkey::VARCHAR END AS given FROM supplier),
p AS (SELECT source, trim(u.t) AS t, min(u.k) AS k FROM r, unnest(string_split(given, ',')) WITH ORDINALITY AS u(t, k) WHERE selected AND trim(u.t) <> '' GROUP BY ALL)
SELECT source, selected, CASE WHEN selected THEN (SELECT string_agg(t, ',' ORDER BY k) FROM p WHERE p.source = r.source) ELSE given END AS tokens,
CASE WHEN NOT implemented THEN 'NOT_IMPLEMENTED' WHEN NOT credentials THEN 'CREDENTIALS_MISSING' WHEN selected THEN 'CONNECTED' ELSE 'DISCONNECTED' END AS status FROM r""")
def source_registry(spark, sf):
    """Suppliers as feeds, one of them selected with a list of tokens to clean."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    k = F.col("s_suppkey")
    rows = s.select(F.col("s_name").alias("source"), (k == 1).alias("selected"), F.col("s_nationkey").cast("string").alias("tokens"), (k % 3 == 0).alias("credentials"), (k % 2 == 0).alias("implemented"))
    chosen = s.where(k == 6).select("s_name", "s_nationkey").first()
    return store.source_status(store.select_source(rows, f" {chosen[0].lower()} ", f" {chosen[1]}, 536,{chosen[1]},,7 ")).select("source", "selected", "tokens", "status")


@query("""WITH o AS (SELECT o_orderdate::DATE::VARCHAR AS trade_date, count(*) AS n, 1 AS version FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), w AS (SELECT o_orderdate::DATE::VARCHAR AS trade_date, count(*) AS n, 2 AS version FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT * FROM w UNION ALL SELECT * FROM o WHERE trade_date NOT IN (SELECT trade_date FROM w)""")
def metadata_upsert(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("trade_date", F.to_date("o_orderdate").cast("string"))
    of = lambda s, v: o.where(F.col("o_orderstatus") == s).groupBy("trade_date").agg(F.count("*").alias("n")).withColumn("version", F.lit(v))
    return store.upsert(of("F", 1), of("O", 2), ("trade_date",))


# --- streams and models ------------------------------------------------------------------


@query(f"WITH {sql_ticks()}, {sql_grid('ticks', (1000,))} SELECT instrument_token, grid_seq, grid_nanos, mono_nanos AS tick_nanos, seq, ltp FROM points")
def stream_locf(spark, sf):
    """The 1 s grid from a stream of ticks in three files, one a micro-batch."""
    path = folder(spark)
    t = ticks.load(spark, sf).select("instrument_token", "mono_nanos", "seq", "ltp", F.timestamp_micros("epoch_micros").alias("event_time"))
    for lo, hi in ((0, 250), (250, 500), (500, 10_000)):
        t.where((F.col("mono_nanos") >= lo * schema.SECOND) & (F.col("mono_nanos") < hi * schema.SECOND)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = live.locf(source, 1000, "30 days").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query()
def ml_report(spark, sf):
    """Each kind of model trained on the last of three purged folds and judged on its test block; exact trees have no SQL form."""
    scratch = Scratch(spark)
    t = scratch.write(rows.model_rows(ticks.load(spark, sf)))
    s = research.walk_forward(t, "t", 3, 5 * schema.SECOND, 5 * schema.SECOND, 2 * schema.SECOND).where("fold = 2")
    grown = [trees.of_kind(kind, 10, 4) for kind in ml.KINDS]
    points = trees.fit(s.where("part = 'train'"), grown)
    y, r = ml.TARGET, "r" + ml.TARGET[1:]
    p = trees.predicted(s.where("part = 'test'"), grown, points, (y, r))
    p = scratch.write(p.groupBy(*p.columns).agg(F.count("*").alias("n_rows")))
    hits = p.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"), *[F.sum(F.when(F.col(f"predicted_{k}") == F.col(y), F.col("n_rows")).otherwise(0)).alias(f"hits_{k}") for k in range(len(grown))])
    each = hits.select("n", F.explode(F.array(*[F.struct(F.lit(e.kind).alias("kind"), F.lit(f"score_{k}").alias("feature"), F.col(f"hits_{k}").alias("hits")) for k, e in enumerate(grown)])).alias("e"))
    ic = research.table_ic(p.withColumn("interval_ms", F.lit(1000)), tuple(f"score_{k}" for k in range(len(grown))), (int(r[2:-1]),), "n_rows")
    out = each.select("n", "e.*").join(F.broadcast(research.tested(ic).drop("n")), "feature", "left")
    return out.select("kind", (F.col("hits") / F.col("n")).alias("accuracy"), "n", "ic", "t_stat", "p_value")


@query(f"WITH {sql_table((1000,))}, m AS (SELECT * FROM full_table WHERE r_5s IS NOT NULL AND {' AND '.join(f'{f} IS NOT NULL' for f in schema.MODEL_FEATURES)}) " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(CASE WHEN stddev_pop({f}) < 1e-12 THEN 1e0 ELSE stddev_pop({f}) END, 6) AS std FROM m" for f in schema.MODEL_FEATURES))
def scaler_stats(spark, sf):
    s = ml.scaler(ml.matrix(table.feature_table(ticks.load(spark, sf))))
    return spark.createDataFrame([(f, m, d_) for f, (m, d_) in s.items()], "feature string, mean double, std double").select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {sql_ticks()} SELECT instrument_token, seq, round(greatest(-1e2, least(1e2, ({sql_features()['l1_obi']}) * 1e2)), 6) AS obi_percent FROM ticks")
def display_percent(spark, sf):
    b = Book.unrolled()
    return ticks.load(spark, sf).select("instrument_token", "seq", F.round(percent(b.obi(b.ready())), 6).alias("obi_percent"))



@query(f"WITH {sql_ticks()} SELECT count(DISTINCT instrument_token) AS n_instruments, count(*) AS n_updates FROM ticks")
def active_instruments(spark, sf):
    return ticks.load(spark, sf).agg(F.count_distinct("instrument_token").alias("n_instruments"), F.count("*").alias("n_updates"))


_CORR = ("l1_obi", "w_obi_lin", "micro_pressure_bps", "trade_strength")


@query(f"WITH {sql_table((1000,))} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM full_table" for i, a in enumerate(_CORR) for b in _CORR[i:]))
def pearson_matrix(spark, sf):
    t = table.feature_table(ticks.load(spark, sf))
    return research.correlations(t, _CORR).withColumn("r", F.round("r", 6))


@query(f"""WITH {sql_ticks()}, z AS (SELECT seq, mono_nanos AS t FROM ticks) SELECT seq FROM z WHERE (t - 5000000000 <= 362000000000 AND 358000000000 <= t) OR (t <= 362000000000 AND 358000000000 <= t + 5000000000)""")
def interval_overlap(spark, sf):
    """Ticks whose feature or label interval meets a zone."""
    t = F.col("mono_nanos")
    zone = (F.lit(358 * schema.SECOND), F.lit(362 * schema.SECOND))
    span = 5 * schema.SECOND
    return ticks.load(spark, sf).where(research.overlaps((t - span, t), zone) | research.overlaps((t, t + span), zone)).select("seq")


# --- reports and forms -------------------------------------------------------------------


@query(f"WITH {sql_ticks()} SELECT 'CLEAN' AS diagnosis, count(*) AS n_frames, count(*) * 80 AS valid_bytes, 0::BIGINT AS truncated_bytes FROM ticks UNION ALL SELECT 'PARTIAL_HEADER', 3, 240, 12")
def recovery_report(spark, sf):
    """What is readable of the logs of all ticks and of one that ends in half a header."""
    path = folder(spark)
    rows = flow.cumulative(ticks.load(spark, sf))
    wal.write(rows, path)
    import numpy as np

    names = ("instrument_token", "ltp", "ltq", "cum_volume", "vwap", "seq", "mono_nanos", "epoch_micros")
    files, where = wal.file_system(path)
    with files.open_output_stream(f"{where}/feed_conn2_00000.raw") as f:
        f.write(wal.packed({n: np.arange(3) for n in names}, 2) + b"x" * 12)
    r = wal.recovery_report(spark, path)
    return r.groupBy("diagnosis").agg(*[F.sum(c).alias(c) for c in ("n_frames", "valid_bytes", "truncated_bytes")]).where("n_frames > 0")


@query(f"WITH {sql_ticks()}, {sql_grid('ticks', schema.INTERVALS_MS)} SELECT instrument_token, interval_ms, count(*) AS n_rows, max(grid_seq) AS last_seq FROM points GROUP BY ALL")
def session_export(spark, sf):
    """Logs of all ticks, exported to the store as a session's feature tables, and counted as read back."""
    path = folder(spark)
    wal.write(flow.cumulative(ticks.load(spark, sf)), f"{path}/log")
    export.finalize_session(spark, f"{path}/log", f"{path}/features", "2024-01-02")
    t = store.read_features(spark, f"{path}/features").groupBy("instrument_token", "interval_ms").agg(F.count("*").alias("n_rows"), F.max("grid_seq").alias("last_seq"))
    return t.withColumn("instrument_token", F.col("instrument_token").cast("bigint"))


_TEXT = ("grid_seq", "instrument_token", "symbol", "mid_price", "spread", "ltp", "r_5s", "y_5s")


@query(f"WITH {sql_table((1000,))} SELECT grid_seq::VARCHAR AS grid_seq, instrument_token::VARCHAR AS instrument_token, symbol, printf('%.4f', mid_price) AS mid_price, printf('%.4f', spread) AS spread, printf('%.4f', ltp) AS ltp, CASE WHEN r_5s IS NULL THEN 'NaN' ELSE printf('%.6f', r_5s) END AS r_5s, y_5s::VARCHAR AS y_5s FROM full_table")
def csv_form(spark, sf):
    """The feature table as text with fixed digits."""
    return store.csv_rows(table.feature_table(ticks.load(spark, sf))).select(*_TEXT)


@query(f"WITH {sql_table((1000,))} SELECT instrument_token, grid_seq, " + ", ".join(f"round(CASE WHEN best_bid > 0 AND mid_price * exp(r_{h}s) > 0 THEN (best_bid - mid_price * exp(r_{h}s)) / best_bid - {d(scores.fixed_cost())} END, 6) AS short_{h}s" for h in schema.HORIZONS_SEC) + " FROM full_table")
def short_returns(spark, sf):
    """Sell at the bid, buy back at the forward mid, less costs."""
    t = table.feature_table(ticks.load(spark, sf))
    return t.select("instrument_token", "grid_seq", *[F.round(scores.short_return(F.col("best_bid"), F.col("mid_price") * F.exp(F.col(f"r_{h}s")), scores.fixed_cost()), 6).alias(f"short_{h}s") for h in schema.HORIZONS_SEC])


_MATRIX = f"m AS (SELECT * FROM full_table WHERE r_5s IS NOT NULL AND {' AND '.join(f'{f} IS NOT NULL' for f in schema.MODEL_FEATURES)})"
_ZS = {f: f"CASE WHEN stddev_pop({f}) < 1e-12 THEN 1e0 ELSE stddev_pop({f}) END" for f in schema.MODEL_FEATURES}


@query(f"WITH {sql_table((1000,))}, {_MATRIX} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n, round((min({f}) - avg({f})) / ({z}), 5) AS low, round((max({f}) - avg({f})) / ({z}), 5) AS high FROM m" for f, z in _ZS.items()))
def standardized(spark, sf):
    """The range of each standardised feature."""
    m = ml.matrix(table.feature_table(ticks.load(spark, sf)))
    z = ml.standardized(m, ml.scaler(m))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("z")) for f in schema.MODEL_FEATURES]))
    return z.select(cells.alias("c")).select("c.*").groupBy("feature").agg(F.count("*").alias("n"), F.round(F.min("z"), 5).alias("low"), F.round(F.max("z"), 5).alias("high"))


@query()
def mock_feed(spark, sf):
    """A thousand snapshots of the seeded feed, twenty levels each; hashes have no SQL form."""
    from tickloom.sources import mock

    return mock.batch(spark, 1000)


@query(f"WITH {sql_ticks()} SELECT instrument_token, seq, mono_nanos, ltp FROM (SELECT *, row_number() OVER (PARTITION BY instrument_token ORDER BY mono_nanos DESC, seq DESC) AS n FROM ticks) WHERE n = 1")
def message_fanout(spark, sf):
    """The newest row of each instrument as a sink got it from a stream of all ticks, beside a sink that fails."""
    path = folder(spark)
    t = ticks.load(spark, sf).select("instrument_token", "seq", "mono_nanos", "ltp")
    t.coalesce(1).write.parquet(f"{path}/in")

    def failing(batch: DataFrame, epoch: int) -> None:
        raise ValueError("this sink is down")

    sinks = [failing, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/out/{epoch}")]
    live.broadcast_messages(spark.readStream.schema(t.schema).parquet(f"{path}/in"), sinks, f"{path}/check", pace=None).awaitTermination()
    return spark.read.parquet(f"{path}/out/*").select(*t.columns)


_IC = "((p_partkey * 37) % 1999 - 999) / 1e3"


@query(f"""WITH t AS (SELECT p_partkey AS position, CASE WHEN p_partkey % 2 = 0 THEN 'surface' ELSE 'cross_broker' END AS family, {_P} AS p_value, {_IC} AS ic FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value, position) AS k, count(*) OVER (PARTITION BY family) AS m FROM t WHERE p_value IS NOT NULL),
l AS (SELECT family, max(CASE WHEN p_value <= 5e-2 * k / m THEN k END) AS last FROM k GROUP BY family),
b AS (SELECT family, position, abs(ic) AS size, row_number() OVER (PARTITION BY family ORDER BY abs(ic) DESC, position) AS n FROM t)
SELECT t.family, count(*) AS n_tests, count(p_value) AS n_defined, coalesce(max(l.last), 0)::BIGINT AS n_discoveries, max(abs(ic)) AS best_abs_ic, (SELECT position FROM b WHERE b.family = t.family AND n = 1) AS best_position FROM t LEFT JOIN l USING (family) GROUP BY t.family""")
def fdr_report(spark, sf):
    """Families with their numbers of tests and discoveries, and the best test of each."""
    k = F.col("p_partkey")
    p = F.when(k % 97 != 0, ((k * 7919) % 10007) * ((k * 104729) % 10009) / 100160063.0 / 50)
    t = spark.read.parquet(f"{sf}/part.parquet").select(k.alias("position"), F.when(k % 2 == 0, "surface").otherwise("cross_broker").alias("family"), p.alias("p_value"), (((k * 37) % 1999 - 999) / 1e3).alias("ic"))
    return research.report(research.benjamini_hochberg(t))


# --- beyond the feature table ------------------------------------------------------------


def _sql_rolling(s: int) -> str:
    over = f"OVER (PARTITION BY instrument_token ORDER BY mono_nanos RANGE BETWEEN {s * schema.SECOND} PRECEDING AND CURRENT ROW)"
    buy, sell = (f"sum(CASE WHEN side = '{v}' THEN ltq ELSE 0 END) {over}" for v in ("BUY", "SELL"))
    return f"round({sql_ratio(f'{buy} - {sell}', f'{buy} + {sell}')}, 9) AS strength_{s}s, round(sum(CASE WHEN ltq > 0 THEN 1 ELSE 0 END) {over} / {d(float(s))}, 9) AS intensity_{s}s"


@query(f"WITH {sql_ticks()}, {SQL_SIDE} SELECT instrument_token, seq, {', '.join(map(_sql_rolling, extras.WINDOWS_SEC))} FROM sided")
def rolling_strength(spark, sf):
    t = extras.rolling_strength(flow.aggressor(ticks.load(spark, sf)))
    return t.select("instrument_token", "seq", *[_r9(F.col(f"{n}_{s}s")).alias(f"{n}_{s}s") for s in extras.WINDOWS_SEC for n in ("strength", "intensity")])


@query(f"WITH {sql_ticks(True)}, f AS ({sql_flow('ticks', 'instrument_token', 'mono_nanos, seq')}) SELECT instrument_token, seq, round(CASE WHEN l1_ofi IS NOT NULL THEN {sql_ratio('l1_ofi', 'qb0 + qa0')} END, 9) AS flow_share FROM f")
def normalized_flow(spark, sf):
    t = flow.order_flow(ticks.load(spark, sf, bad=True))
    return t.select("instrument_token", "seq", _r9(extras.normalized_flow(t)).alias("flow_share"))


@query(f"""WITH {sql_ticks()}, c AS (SELECT *, CASE WHEN seq % 40 = 7 THEN 0 ELSE seq END AS cum_volume, mono_nanos // 40 AS t FROM ticks), l AS (SELECT *, t - lag(t) OVER w AS wait, lag(cum_volume) OVER w AS before, lag(ltp) OVER w IS NOT DISTINCT FROM ltp AND lag(ltq) OVER w IS NOT DISTINCT FROM ltq AND lag(b0) OVER w IS NOT DISTINCT FROM b0 AND lag(a0) OVER w IS NOT DISTINCT FROM a0 AS same
FROM c WINDOW w AS (PARTITION BY instrument_token ORDER BY t, seq))
SELECT instrument_token, seq, coalesce(same AND wait < 500000000, false) AS duplicate, coalesce(cum_volume < before, false) AS volume_fell, coalesce(wait > 1000000000, true) AS after_gap FROM l""")
def quality_flags(spark, sf):
    """On a clock forty times as fast, with quantities alike, so that there are duplicates and falls."""
    t = ticks.load(spark, sf)
    t = t.withColumns({"cum_volume": F.when(F.col("seq") % 40 == 7, 0).otherwise(F.col("seq")), "mono_nanos": F.expr("mono_nanos div 40"), "qb0": F.lit(1), "qa0": F.lit(1)})
    return extras.quality_flags(t, 500, 1).select("instrument_token", "seq", "duplicate", "volume_fell", "after_gap")


def _sql_fresh(h: int) -> str:
    return f"CASE WHEN max(CASE WHEN snapshot_age_ms > {schema.STALE_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_token, interval_ms ORDER BY grid_seq ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING) = 0 THEN round(r_{h}s, 9) END AS r_{h}s"


@query(f"WITH {sql_table((1000,))} SELECT instrument_token, grid_seq, {', '.join(map(_sql_fresh, schema.HORIZONS_SEC))} FROM full_table")
def fresh_returns(spark, sf):
    """Forward returns that no stale grid row lies in."""
    t = extras.fresh_returns(table.feature_table(ticks.load(spark, sf)), (1000,))
    return rounded(t.select("instrument_token", "grid_seq", *[f"r_{h}s" for h in schema.HORIZONS_SEC]))


@query(f"SELECT event_id FROM events WHERE {_PHASE} = 'CONTINUOUS_TRADING'")
def continuous_only(spark, sf):
    return extras.continuous_only(spark.read.parquet(f"{sf}/events.parquet"), F.col("ts").cast("timestamp")).select("event_id")


_CUTS, _REGIMES = (30.0, 45.0), ("tight", "usual", "wide")
_REGIME = "CASE WHEN rel_spread_bps < 30 THEN 'tight' WHEN rel_spread_bps < 45 THEN 'usual' ELSE 'wide' END"


@query(f"""WITH {sql_table((1000,))}, c AS (SELECT {_REGIME} AS regime, round(w_obi_lin, 9) AS x, round(r_5s, 9) AS y FROM full_table WHERE w_obi_lin IS NOT NULL AND r_5s IS NOT NULL),
k AS (SELECT regime, 2 * rank() OVER (PARTITION BY regime ORDER BY x) + count(*) OVER (PARTITION BY regime, x) - 1 AS a, 2 * rank() OVER (PARTITION BY regime ORDER BY y) + count(*) OVER (PARTITION BY regime, y) - 1 AS b FROM c)
SELECT regime, count(*) AS n, round(corr(a, b), 6) AS ic FROM k GROUP BY regime""")
def regime_ic(spark, sf):
    """Rank correlation of the imbalance with the return in three regimes of the spread."""
    t = table.feature_table(ticks.load(spark, sf))
    cells = t.select(extras.segment(F.col("rel_spread_bps"), _CUTS, _REGIMES).alias("regime"), _r9(F.col("w_obi_lin")).alias("x"), _r9(F.col("r_5s")).alias("y"))
    return research.rank_ic(cells, ("regime",)).withColumn("ic", F.round("ic", 6))


@query(f"WITH {sql_table((1000,))}, b AS (SELECT {', '.join(f'CASE WHEN {c} > 1.5e-1 THEN 1 WHEN {c} < -1.5e-1 THEN -1 ELSE 0 END AS {n}' for c, n in (('w_obi_lin', 'band_a'), ('trade_strength', 'band_b')))}, r_5s FROM full_table WHERE w_obi_lin IS NOT NULL AND trade_strength IS NOT NULL AND r_5s IS NOT NULL) SELECT band_a, band_b, count(*) AS n, round(avg(r_5s), 9) AS mean_target FROM b GROUP BY ALL")
def confluence(spark, sf):
    t = extras.confluence(table.feature_table(ticks.load(spark, sf)), "w_obi_lin", "trade_strength", "r_5s", schema.NEUTRAL_BAND)
    return t.withColumn("mean_target", _r9(F.col("mean_target")))


@query(sql_ic((1000,), schema.HORIZONS_SEC, schema.IC_FEATURES) + ", f AS (SELECT *, first_value(abs(ic)) OVER (PARTITION BY interval_ms, feature ORDER BY horizon) AS one FROM ic) SELECT interval_ms, feature, horizon, round(abs(ic), 9) AS abs_ic, round(CASE WHEN one > 0 THEN abs(ic) / one END, 6) AS share FROM f")
def decay_curve(spark, sf):
    """How the correlation of each feature falls with the horizon."""
    t = extras.decay(_ic(spark, sf, (1000,), schema.HORIZONS_SEC, schema.IC_FEATURES))
    return t.withColumns({"abs_ic": _r9(F.col("abs_ic")), "share": F.round("share", 6)})


def _sql_depth(n: int) -> str:
    b, a = (" + ".join(f"q{s}{i}" for i in range(n)) for s in "ba")
    return f"{sql_ratio(f'({b}) - ({a})', f'({b}) + ({a})')} AS obi_{n}"


@query(f"WITH {sql_ticks()}, o AS (SELECT instrument_token, {_sql_depth(2)}, {_sql_depth(5)} FROM ticks) SELECT instrument_token, count(*) AS n, round(avg(abs(obi_2 - obi_5)), 9) AS mean_gap, round(corr(obi_2, obi_5), 6) AS r FROM o GROUP BY instrument_token")
def depth_comparison(spark, sf):
    """Imbalances of the two best levels against those of all five."""
    t = extras.depth_imbalances(ticks.load(spark, sf), (2, 5))
    return t.groupBy("instrument_token").agg(F.count("*").alias("n"), _r9(F.avg(F.abs(F.col("obi_2") - F.col("obi_5")))).alias("mean_gap"), F.round(F.corr("obi_2", "obi_5"), 6).alias("r"))


@query(f"WITH {sql_table((1000,))}, s AS (SELECT *, CASE WHEN mid_price > 0 AND lag(mid_price) OVER w > 0 THEN ln(mid_price / lag(mid_price) OVER w) END AS step FROM full_table WINDOW w AS (PARTITION BY instrument_token, interval_ms ORDER BY grid_seq)) SELECT instrument_token, grid_seq, round(stddev_samp(step) OVER (PARTITION BY instrument_token, interval_ms ORDER BY grid_seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 6) AS sigma FROM s")
def realized_sigma(spark, sf):
    t = extras.realized_sigma(table.feature_table(ticks.load(spark, sf)))
    return t.select("instrument_token", "grid_seq", F.round("sigma", 6).alias("sigma"))
