"""Order matching by price, then time, within each security."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from flowspark.schema import require

TRADES = "sec_code long, buy_no long, sell_no long, price double, volume long"


class Book:
    """Resting orders of one security: sells by (price, arrival), buys by (-price, arrival)."""

    def __init__(self):
        self.sells: list[list] = []
        self.buys: list[list] = []
        self.arrivals = 0

    def add(self, order_no: int, is_buy: bool, price: float, volume: int) -> Iterator[tuple[int, int, float, int]]:
        """Match against the best resting orders, at their prices; what is left rests. Yields (buy, sell, price, volume)."""
        own, other = (self.buys, self.sells) if is_buy else (self.sells, self.buys)
        while volume > 0 and other:
            best = other[0]
            resting = best[0] if is_buy else -best[0]
            if (resting > price) if is_buy else (resting < price):
                break
            traded = min(volume, best[3])
            yield (order_no, best[2], resting, traded) if is_buy else (best[2], order_no, resting, traded)
            volume -= traded
            best[3] -= traded
            if not best[3]:
                heapq.heappop(other)
        if volume > 0:
            self.arrivals += 1
            heapq.heappush(own, [-price if is_buy else price, self.arrivals, order_no, volume])


def replay(orders: Iterable[dict]) -> Iterator[tuple[int, int, float, int]]:
    book = Book()
    for o in orders:
        yield from book.add(o["order_no"], o["direction"] == "B", o["price"], o["volume"])


def match(orders: DataFrame) -> DataFrame:
    """Trades of ``orders`` (sec_code, order_no, ts, direction B or S, price, volume). Matching is sequential within a
    security, so one security is one task; securities run in parallel. Orders are taken by (ts, order_no)."""
    require(orders, ["sec_code", "order_no", "ts", "direction", "price", "volume"])

    def run(group):
        import pyarrow as pa

        code = group.column("sec_code")[0].as_py()
        trades = [(code, *t) for t in replay(group.sort_by([("ts", "ascending"), ("order_no", "ascending")]).to_pylist())]
        columns = list(zip(*trades, strict=True)) if trades else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["sec_code", "buy_no", "sell_no", "price", "volume"])

    return orders.select("sec_code", "order_no", "ts", "direction", "price", "volume").groupBy("sec_code").applyInArrow(run, TRADES)
