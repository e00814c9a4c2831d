"""Book mathematics on one row. Undefined values are NULL.

A Book holds the levels of one row as columns. It is made of unrolled scalar columns (b0, qb0,
a0, qa0, ...), which stay inside whole-stage code generation, or of arrays of any depth, whose
missing levels are NULL; every function serves both.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions import schema


def ratio(a: Column, b: Column, default: Column | float | None = None) -> Column:
    """a / b where b is positive, else default."""
    return F.when(b > 0, a / b).otherwise(F.lit(default) if not isinstance(default, Column) else default)


@dataclass(frozen=True)
class Book:
    """Prices and quantities of both sides, best level first."""

    bid: tuple[Column, ...]
    bid_qty: tuple[Column, ...]
    ask: tuple[Column, ...]
    ask_qty: tuple[Column, ...]

    @classmethod
    def unrolled(cls, levels: int = 5, of=F.col) -> Book:
        """From columns b0.., qb0.., a0.., qa0..; of maps a name to a column, such as its lag."""
        return cls(*(tuple(of(f"{side}{i}") for i in range(levels)) for side in ("b", "qb", "a", "qa")))

    @classmethod
    def arrays(cls, levels: int = 5) -> Book:
        """From the arrays of the snapshot schema."""
        return cls(*(tuple(F.get(c, F.lit(i)) for i in range(levels)) for c in ("bid_prices", "bid_quantities", "ask_prices", "ask_quantities")))

    @property
    def quoted(self) -> Column:
        """Both best prices are there and positive."""
        return F.coalesce((self.bid[0] > 0) & (self.ask[0] > 0), F.lit(False))

    def mid(self, ltp: Column) -> Column:
        return F.when(self.quoted, (self.bid[0] + self.ask[0]) / 2).otherwise(ltp)

    def spread(self) -> Column:
        return F.when(self.quoted, self.ask[0] - self.bid[0]).otherwise(0.0)

    def relative_spread_bps(self, ltp: Column) -> Column:
        return ratio(self.spread(), self.mid(ltp), 0.0) * 1e4

    def tag(self) -> Column:
        """NORMAL, STATE_LOCKED, STATE_CROSSED or STATE_EMPTY_SIDE."""
        return F.when(~self.quoted, "STATE_EMPTY_SIDE").when(self.bid[0] > self.ask[0], "STATE_CROSSED").when(self.bid[0] == self.ask[0], "STATE_LOCKED").otherwise("NORMAL")

    def monotonic(self) -> Column:
        """Bids strictly fall and asks strictly rise; pairs with a price that is not positive don't count."""
        def fits(side: tuple[Column, ...], falls: bool) -> list[Column]:
            return [F.coalesce((a <= 0) | (b <= 0) | ((a > b) if falls else (a < b)), F.lit(True)) for a, b in zip(side, side[1:], strict=False)]

        return reduce(and_, fits(self.bid, True) + fits(self.ask, False), F.lit(True))

    def ready(self) -> Column:
        """Fit for computing: a normal tag and monotonic ladders."""
        return (self.tag() == "NORMAL") & self.monotonic()

    def best_bid(self) -> Column:
        return F.coalesce(self.bid[0], F.lit(0.0))

    def best_ask(self) -> Column:
        return F.coalesce(self.ask[0], F.lit(0.0))

    def obi(self, ready: Column) -> Column:
        """Imbalance of the best level."""
        return F.when(ready, ratio(self.bid_qty[0] - self.ask_qty[0], self.bid_qty[0] + self.ask_qty[0], 0.0))

    def total_obi(self, ready: Column) -> Column:
        """Imbalance of all levels; a missing level has no quantity."""
        b, a = (reduce(add, [F.coalesce(q, F.lit(0)) for q in side]) for side in (self.bid_qty, self.ask_qty))
        return F.when(ready, ratio(b - a, b + a, 0.0))

    def weighted_obi(self, weights: tuple[float, ...], ready: Column) -> Column:
        """Imbalance with weights on the levels that both sides have."""
        b, a = self._weighted(self.bid_qty, weights), self._weighted(self.ask_qty, weights)
        return F.when(ready, ratio(b - a, b + a, 0.0))

    def _weighted(self, values: tuple[Column, ...], weights: tuple[float, ...]) -> Column:
        both = [F.when(b.isNotNull() & a.isNotNull(), v * w).otherwise(0.0) for v, w, b, a in zip(values, weights, self.bid_qty, self.ask_qty, strict=False)]
        return reduce(add, both)

    def microprice(self, ready: Column) -> Column:
        """Best prices weighted by the other side's quantity; their mean without quantity."""
        total = self.bid_qty[0] + self.ask_qty[0]
        return F.when(ready, ratio(self.ask[0] * self.bid_qty[0] + self.bid[0] * self.ask_qty[0], total, (self.bid[0] + self.ask[0]) / 2))

    def pressure(self, ready: Column) -> Column:
        return self.microprice(ready) - F.when(ready, (self.bid[0] + self.ask[0]) / 2)

    def pressure_bps(self, ready: Column) -> Column:
        return ratio(self.pressure(ready), (self.bid[0] + self.ask[0]) / 2, F.when(ready, 0.0)) * 1e4

    def multi_microprice(self, weights: tuple[float, ...], ready: Column) -> Column:
        """The microprice over weighted levels; the mid without quantity."""
        top = self._weighted(tuple(a * q + b * r for a, q, b, r in zip(self.ask, self.bid_qty, self.bid, self.ask_qty, strict=True)), weights)
        total = self._weighted(tuple(q + r for q, r in zip(self.bid_qty, self.ask_qty, strict=True)), weights)
        return F.when(ready, ratio(top, total, (self.bid[0] + self.ask[0]) / 2))

    def ofi(self, before: Book, level: int = 0) -> Column:
        """Order-flow imbalance of a level against the book before."""
        b, q, pb, pq = self.bid[level], self.bid_qty[level], before.bid[level], before.bid_qty[level]
        a, r, pa, pr = self.ask[level], self.ask_qty[level], before.ask[level], before.ask_qty[level]
        bid = F.when(b > pb, q).when(b == pb, q - pq).otherwise(-pq)
        ask = F.when(a < pa, r).when(a == pa, r - pr).otherwise(-pr)
        return (bid - ask).cast("double")

    def weighted_ofi(self, before: Book, weights: tuple[float, ...]) -> Column:
        """Weighted sum over the levels that both books have on both sides."""
        terms = [F.coalesce(self.ofi(before, i) * w, F.lit(0.0)) for i, w in zip(range(len(self.bid)), weights, strict=False)]
        return reduce(add, terms)


def features(book: Book, ltp: Column, ready: Column) -> dict[str, Column]:
    """The price, imbalance and microprice columns of the feature table."""
    exp = schema.exp_weights()
    return {
        "best_bid": book.best_bid(),
        "best_ask": book.best_ask(),
        "mid_price": book.mid(ltp),
        "spread": book.spread(),
        "rel_spread_bps": book.relative_spread_bps(ltp),
        "l1_obi": book.obi(ready),
        "total_obi": book.total_obi(ready),
        "w_obi_lin": book.weighted_obi(schema.LINEAR_WEIGHTS, ready),
        "w_obi_exp": book.weighted_obi(exp, ready),
        "microprice": book.microprice(ready),
        "micro_pressure": book.pressure(ready),
        "micro_pressure_bps": book.pressure_bps(ready),
        "ml_microprice": book.multi_microprice(exp, ready),
    }


def levels(side: str) -> Column:
    """The level list of a side (bid or ask): price, quantity, orders, to the shortest of the three arrays."""
    arrays = [f"{side}_prices", f"{side}_quantities", f"{side}_orders"]
    zipped = F.transform(F.arrays_zip(*arrays), lambda z: F.struct(*[z[a].alias(n) for a, n in zip(arrays, ("price", "quantity", "orders"), strict=True)]))
    return F.slice(zipped, F.lit(1), F.least(*[F.size(a) for a in arrays]))


def finite(x: Column) -> Column:
    """x, or 0 where it is NULL, NaN or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def clamp(x: Column, limit: float) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), x))


def percent(x: Column) -> Column:
    """A share as a percent to display, in [-100, 100]; 0 where it is undefined."""
    return clamp(finite(x) * 100, 100.0)


def depth_scale(rows: int = 20) -> Column:
    """The largest quantity over the first rows of both sides, 1 at least."""
    most = lambda c: F.coalesce(F.array_max(F.slice(c, 1, rows)), F.lit(0))
    return F.greatest(most("bid_quantities"), most("ask_quantities"), F.lit(1))


def gauge(percentage: Column) -> Column:
    """buy above 0.25, sell below -0.25, else neutral."""
    return F.when(percentage > 0.25, "buy").when(percentage < -0.25, "sell").otherwise("neutral")
