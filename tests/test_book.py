"""Golden values of book mathematics, on arrays and on unrolled columns."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.functions.book import Book, features, levels
from tickloom.operators import flow


def book(spark, bids, asks, ltp=100.0, **more):
    row = {"bid_prices": [float(p) for p, _ in bids], "bid_quantities": [q for _, q in bids], "ask_prices": [float(p) for p, _ in asks], "ask_quantities": [q for _, q in asks], "ltp": ltp} | more
    return spark.createDataFrame([tuple(row.values())], "bid_prices array<double>, bid_quantities array<bigint>, ask_prices array<double>, ask_quantities array<bigint>, ltp double" + "".join(f", {k} array<int>" for k in more))


def values(df):
    b = Book.arrays(5)
    return df.select(*[c.alias(n) for n, c in features(b, F.col("ltp"), b.ready()).items()], b.tag().alias("tag"), b.monotonic().alias("mono")).first()


def test_imbalance(spark):
    r = values(book(spark, [(100, 300), (99, 700)], [(101, 100), (102, 300)]))
    assert r["l1_obi"] == 0.5 and r["total_obi"] == pytest.approx(600 / 1400) and r["tag"] == "NORMAL"


def test_weighted_imbalance(spark):
    r = values(book(spark, [(100, 100), (99, 100), (98, 100), (97, 100), (96, 1000)], [(101, 500), (102, 100), (103, 100), (104, 100), (105, 100)]))
    assert r["w_obi_lin"] == pytest.approx(-220 / 1180)


def test_microprice(spark):
    r = values(book(spark, [(100, 900)], [(101, 100)]))
    assert (r["mid_price"], r["microprice"]) == (100.5, pytest.approx(100.9))
    assert r["micro_pressure"] == pytest.approx(0.4) and r["micro_pressure_bps"] == pytest.approx(0.4 / 100.5 * 1e4)


def test_multi_level_microprice(spark):
    df = book(spark, [(2500, 500), (2499, 1000)], [(2501, 500), (2502, 1000)])
    b = Book.arrays(2)
    assert df.select(b.multi_microprice((1.0, 0.8), b.ready())).first()[0] == pytest.approx(2500.5)


@pytest.mark.parametrize(("bids", "asks", "tag"), [([(102, 1)], [(101, 1)], "STATE_CROSSED"), ([(101, 1)], [(101, 1)], "STATE_LOCKED"), ([], [(101, 1)], "STATE_EMPTY_SIDE"), ([(0, 1)], [(101, 1)], "STATE_EMPTY_SIDE")])
def test_bad_books_are_undefined(spark, bids, asks, tag):
    r = values(book(spark, bids, asks))
    assert r["tag"] == tag and r["l1_obi"] is None and r["microprice"] is None and r["ml_microprice"] is None
    if tag == "STATE_EMPTY_SIDE":
        assert r["mid_price"] == 100.0 and r["spread"] == 0.0


def test_ladders(spark):
    assert not values(book(spark, [(100, 1), (100, 1)], [(101, 1)]))["mono"]
    assert values(book(spark, [(100, 1), (0, 1), (99, 1)], [(101, 1), (103, 1)]))["mono"]


def _ofi(spark, rows, weights=None):
    data = [(1, i, i, *r) for i, r in enumerate(rows)]
    names = [f"{p}{s}{k}" for s in "ba" for k in range(len(rows[0]) // 4) for p in ("", "q")]
    df = spark.createDataFrame(data, "instrument_token long, mono_nanos long, seq long, " + ", ".join(f"{n} {'long' if n[0] == 'q' else 'double'}" for n in names))
    n = len(rows[0]) // 4
    w = flow.along()
    b, before = Book.unrolled(n), Book.unrolled(n, lambda c: F.lag(c).over(w))
    return df.withColumn("x", b.weighted_ofi(before, weights) if weights else b.ofi(before)).orderBy("seq").collect()[-1]["x"]


def test_order_flow(spark):
    assert _ofi(spark, [(100.0, 500, 101.0, 400), (100.0, 700, 101.0, 300)]) == 300
    assert _ofi(spark, [(100.0, 500, 101.0, 300), (100.5, 350, 101.0, 300)]) == 350
    assert _ofi(spark, [(100.0, 100, 99.0, 200, 101.0, 9, 102.0, 9), (100.0, 150, 99.0, 300, 101.0, 9, 102.0, 9)], (0.5, 0.5)) == 75


def test_lee_ready(spark):
    ltp = [101, 101.5, 100, 99.5, 100.50, 100.25, 100.25]
    df = spark.createDataFrame([(1, i, i, float(p), 10, 100.0, 101.0) for i, p in enumerate(ltp)], "instrument_token long, mono_nanos long, seq long, ltp double, ltq long, b0 double, a0 double")
    out = flow.aggressor(df, Book.unrolled(1)).orderBy("seq").collect()
    assert [r["side"] for r in out] == ["BUY", "BUY", "SELL", "SELL", "BUY", "SELL", "SELL"]


def test_trade_strength_and_ignored_trades(spark):
    df = spark.createDataFrame([(1, 0, 0, 101.0, 75, 100.0, 101.0), (1, 1, 1, 100.0, 25, 100.0, 101.0), (1, 2, 2, 100.5, 0, 100.0, 101.0), (1, 3, 3, 0.0, 5, 100.0, 101.0)], "instrument_token long, mono_nanos long, seq long, ltp double, ltq long, b0 double, a0 double")
    out = flow.volumes(flow.aggressor(df, Book.unrolled(1))).select("*", *[c.alias(n) for n, c in flow.strength().items()]).orderBy("seq").collect()
    assert (out[1]["trade_strength"], out[1]["buy_pressure"], out[1]["sell_pressure"]) == (0.5, 0.75, 0.25)
    assert out[3]["trade_strength"] == 0.5 and out[3]["side"] is None and [r["trade_count"] for r in out] == [1, 2, 2, 3]


def test_level_list_stops_at_the_shortest(spark):
    df = book(spark, [(100, 1), (99, 2)], [(101, 3)], bid_orders=[4], ask_orders=[5, 6])
    assert [tuple(x) for x in df.select(levels("bid")).first()[0]] == [(100.0, 1, 4)]


def test_weights():
    assert schema.exp_weights()[1] == pytest.approx(0.6065, abs=1e-4)
