"""The state of a price series that gives the features of its next row, kept by a stream."""

from __future__ import annotations

import datetime as dt
import math
import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .features import LAGS, WINDOWS
from .panel import FILL_DAYS

#: Days whose prices the state holds: the longest lag or window.
RING = max(*LAGS, *WINDOWS)
RSI_DAYS = 14
EPOCH = dt.date(1970, 1, 1)
DAY_MS = 86_400_000

_ROLLED = [f"{n}_{w}" for w in WINDOWS for n in ("mean", "std", "min", "max")]
_OTHER = ["volatility_14", "return_1", "return_7", "acceleration", "bollinger", "expanding_mean", "from_expanding_mean", "rsi", "macd", "macd_signal", "slope_7", "slope_14"]
_COUNTS = ["observed_7", "observed_30", "observed_age"]
#: What a next row has beside series and day.
COLUMNS = [*[f"lag_{k}" for k in LAGS], *_ROLLED, *_OTHER, *_COUNTS]
SCHEMA = "series string, report_date date, " + ", ".join(f"{c} {'long' if c in _COUNTS[:2] else 'int' if c in _COUNTS else 'double'}" for c in COLUMNS)
#: Day number, days so far, filled and observed prices of the last days (newest last), sum and number of
#: filled prices, day and price of the last observation, two averages and the signal with their weights.
STATE = (
    "day int, days long, prices array<double>, observed array<double>, total double, n long, seen int, last double,"
    " fast double, fast_w double, slow double, slow_w double, signal double, signal_w double"
)


def decayed(value: float | None, weight: float, price: float | None, alpha: float) -> tuple[float | None, float]:
    """One step of an exponential average; a missing price lets the weight of what is known decay."""
    if value is None:
        return price, 1.0
    weight *= 1 - alpha
    return (value, weight) if price is None else ((weight * value + alpha * price) / (weight + alpha), 1.0)


def _change(a: float | None, b: float | None) -> float | None:
    return None if a is None else 0.0 if not b else (a - b) / b


def _slope(points: list[tuple[int, float]]) -> float | None:
    if len(points) < 2:
        return None
    x, y = (statistics.fmean(v) for v in zip(*points, strict=True))
    return math.fsum((a - x) * (b - y) for a, b in points) / math.fsum((a - x) ** 2 for a, _ in points)


class SeriesState:
    """A series up to a day; bounded by ``RING`` days."""

    def __init__(self, values: tuple | None = None):
        values = values or (None, 0, [], [], 0.0, 0, None, None, None, 1.0, None, 1.0, None, 1.0)
        self.day, self.days, prices, observed, self.total, self.n, self.seen, self.last, self.fast, self.fast_w, self.slow, self.slow_w, self.signal, self.signal_w = values
        self.prices, self.observed = list(prices), list(observed)

    def values(self) -> tuple:
        return self.day, self.days, self.prices, self.observed, self.total, self.n, self.seen, self.last, self.fast, self.fast_w, self.slow, self.slow_w, self.signal, self.signal_w

    def advance(self, day: int, observed: float | None) -> None:
        """The next day, observed or not; a price is carried for ``FILL_DAYS`` days."""
        if observed is not None:
            self.seen, self.last = day, observed
        price = self.last if self.seen is not None and day - self.seen <= FILL_DAYS else None
        self.day, self.days = day, self.days + 1
        self.prices = [*self.prices[1 - RING :], price]
        self.observed = [*self.observed[1 - RING :], observed]
        if price is not None:
            self.total, self.n = self.total + price, self.n + 1
        self.fast, self.fast_w = decayed(self.fast, self.fast_w, price, 2 / 13)
        self.slow, self.slow_w = decayed(self.slow, self.slow_w, price, 2 / 27)
        self.signal, self.signal_w = decayed(self.signal, self.signal_w, None if self.fast is None else self.fast - self.slow, 2 / 10)

    def next_row(self) -> list:
        """The features of the day after, in the order of ``COLUMNS``."""
        lag = lambda k: self.prices[-k] if k <= len(self.prices) else None
        out: list = [lag(k) for k in LAGS]
        mean14 = std14 = None
        n14 = 0
        for w in WINDOWS:
            known = [p for p in self.prices[-w:] if p is not None]
            mean = math.fsum(known) / len(known) if known else None
            std = math.sqrt(math.fsum((p - mean) ** 2 for p in known) / (len(known) - 1)) if len(known) > 1 else None
            out += [mean, std, min(known, default=None), max(known, default=None)]
            if w == 14:
                mean14, std14, n14 = mean, std, len(known)
        before = _change(lag(2), lag(3))
        one = _change(lag(1), lag(2))
        expanding = self.total / self.n if self.n else None
        moves = [a - b if a is not None and b is not None else 0.0 for a, b in zip(self.prices[:0:-1], self.prices[-2::-1], strict=True)][:RSI_DAYS]
        rows = min(RSI_DAYS, self.days + 1)
        gain, loss = math.fsum(m for m in moves if m > 0) / rows, -math.fsum(m for m in moves if m < 0) / rows
        first = self.day - len(self.observed) + 1
        points = [(first + k, p) for k, p in enumerate(self.observed) if p is not None]
        within = lambda w: [x for x in points if x[0] > self.day - w]
        return out + [
            std14 / mean14 if n14 >= 2 and mean14 else None, one, _change(lag(1), lag(8)), None if one is None or before is None else one - before,
            None if lag(1) is None else 0.0 if not std14 else (lag(1) - mean14) / (2 * std14), expanding, (lag(1) - expanding) / expanding if expanding and lag(1) is not None else None,
            100 - 100 / (1 + gain / (loss + 1e-6)), None if self.fast is None else self.fast - self.slow, self.signal, _slope(within(7)), _slope(within(14)),
            len(within(7)), len(within(30)), None if self.seen is None else self.day + 1 - self.seen,
        ]


class NextRows(StatefulProcessor):
    """Prices of a series -> a next row for each of its days, those without a price included.

    The days between two prices are filled in when the later one comes, or when the watermark has
    passed them (a timer stands at the end of the first day that is open), the latter only as long as
    the last price is carried. A day that is not after the last one is late and changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", STATE)

    def _emit(self, key: tuple, rows: list[list]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["report_date", *COLUMNS], dtype=object)
        out.insert(0, "series", key[0])
        return out

    def _keep(self, state: SeriesState, timed: bool) -> None:
        self.state.update(state.values())
        if timed and state.seen is not None and state.day - state.seen < FILL_DAYS:
            self.handle.registerTimer((state.day + 2) * DAY_MS)

    def _step(self, state: SeriesState, day: int, observed: float | None, rows: list[list]) -> None:
        state.advance(day, observed)
        rows.append([EPOCH + dt.timedelta(days=day + 1), *state.next_row()])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = SeriesState(self.state.get() if self.state.exists() else None)
        got = pd.concat(list(rows))
        days = ((pd.to_datetime(got["day"]) - pd.Timestamp(EPOCH)) // pd.Timedelta(days=1)).astype(int)
        prices: dict[int, float | None] = {}
        for day, price in sorted(zip(days.tolist(), got["observed_price"].astype(float).tolist(), strict=True), key=lambda x: (x[0], x[1] != x[1], x[1])):
            prices.setdefault(day, None if price != price else price)  # of several rows of a day the least price
        out: list[list] = []
        for day, price in prices.items():
            if state.day is not None and day <= state.day:
                continue
            for gap in range(day if state.day is None else state.day + 1, day):
                self._step(state, gap, None, out)
            self._step(state, day, price, out)
        if out:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self._keep(state, timed=True)
            yield self._emit(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = SeriesState(self.state.get()), []
        while (state.day + 2) * DAY_MS <= timerValues.getCurrentWatermarkInMs() and state.day - state.seen < FILL_DAYS:
            self._step(state, state.day + 1, None, out)
        self._keep(state, timed=True)
        if out:
            yield self._emit(key, out)

    def close(self) -> None:
        pass


def next_rows(prices: DataFrame, late: str = "0 days") -> DataFrame:
    """ST4: a stream of ``series, report_date, observed_price`` (a row may be a day without an observation) -> FE3-FE10, FE13 and FE14 of each day's next row.

    Rows with a null series or day are left out. The state store must be RocksDB.
    """
    prices.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = prices.where("series IS NOT NULL AND report_date IS NOT NULL").select("series", F.col("report_date").cast("timestamp").alias("day"), "observed_price")
    return rows.withWatermark("day", late).groupBy("series").transformWithStateInPandas(NextRows(), SCHEMA, "Append", "EventTime")
