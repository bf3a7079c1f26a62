"""Keyed state processors for detectors that need ordered per-key state.

A key's rows of a micro-batch are sorted by (event time, event id), which is also a key's cursor. Rows of equal time are
never lost; rows at or before the cursor are late and are handed on as such. State is small and bounded by the
detector's window.
"""

from __future__ import annotations

import math
from collections import deque
from itertools import groupby
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor


def _batch(rows) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["ts_us", "event_id"])


def _instants(rows, cursor: tuple[int, int]):
    """Split a micro-batch: rows at or before the cursor (late), and the others in groups of equal time."""
    frame = _batch(rows)
    late = (frame["ts_us"] < cursor[0]) | ((frame["ts_us"] == cursor[0]) & (frame["event_id"] <= cursor[1]))
    return frame[late], ((now, list(group)) for now, group in groupby(frame[~late].itertuples(), key=attrgetter("ts_us")))


class EntropyDetector(StatefulProcessor):
    """Rolling trade-side entropy and its z-score per asset (batch twin: rolling_entropy, entropy_zscore).

    Rows of one instant count together. Every row gives one output row; a row behind the key's cursor only gives one marked ``late``.
    """

    SCHEMA = "asset_id string, event_id long, ts_us long, entropy double, z double, late boolean"
    STATE = "ts array<bigint>, buy array<double>, sell array<double>, hist array<double>, last bigint, last_id bigint"

    def __init__(self, window_us: int, history: int = 200, min_history: int = 12):
        self.window_us, self.history, self.min_history = window_us, history, min_history

    def init(self, handle) -> None:
        self.state = handle.getValueState("window", self.STATE)

    def handleInputRows(self, key, rows, timerValues):
        ts, buy, sell, hist, last, last_id = self.state.get() if self.state.exists() else ([], [], [], [], -1, -1)
        window = deque(zip(ts, buy, sell))
        bought, sold, buys, sells = math.fsum(buy), math.fsum(sell), sum(map(bool, buy)), sum(map(bool, sell))
        frame = _batch(rows)
        behind = ((frame["ts_us"] < last) | ((frame["ts_us"] == last) & (frame["event_id"] <= last_id))).to_numpy()
        late, frame = frame[behind], frame[~behind]
        times, sizes, bids = frame["ts_us"].tolist(), frame["size"].tolist(), (frame["side"] == "BUY").tolist()
        entropies, begin = np.full(len(times), np.nan), 0
        while begin < len(times):
            last, end = int(times[begin]), begin
            while end < len(times) and times[end] == last:
                b, s = (float(sizes[end]), 0.0) if bids[end] else (0.0, float(sizes[end]))
                window.append((last, b, s))
                bought, sold, buys, sells = bought + b, sold + s, buys + bool(b), sells + bool(s)
                end += 1
            while window[0][0] < last - self.window_us:
                _, b, s = window.popleft()
                bought, sold, buys, sells = bought - b, sold - s, buys - bool(b), sells - bool(s)
            # What rounding leaves of a side that is gone counts as zero.
            bought, sold = bought if buys else 0.0, sold if sells else 0.0
            total = bought + sold
            if len(window) >= 2 and total > 0:
                entropies[begin:end] = -sum(p * math.log2(p) for p in (max(1e-18, v / total) for v in (bought, sold)))
            begin = end
        if times:
            last_id = int(frame["event_id"].iloc[-1])
        defined = ~np.isnan(entropies)
        levels, z = np.concatenate([hist, entropies[defined]]), np.full(len(times), np.nan)
        z[defined] = self._scores(levels, len(hist))
        self.state.update(([x[0] for x in window], [x[1] for x in window], [x[2] for x in window], levels[-self.history :].tolist(), last, last_id))
        none = np.full(len(late), np.nan)
        yield pd.DataFrame({
            "asset_id": key[0], "event_id": np.concatenate([late["event_id"], frame["event_id"]]).astype(np.int64), "ts_us": np.concatenate([late["ts_us"], frame["ts_us"]]).astype(np.int64),
            "entropy": np.concatenate([none, entropies]), "z": np.concatenate([none, z]), "late": np.repeat([True, False], [len(late), len(frame)]),
        })

    def _scores(self, levels: np.ndarray, known: int, block: int = 4096) -> np.ndarray:
        """The z of each level from number ``known`` on, against the spread of at most ``history - 1`` levels before it; NaN where these are too few."""
        width, out = self.history - 1, np.full(len(levels) - known, np.nan)
        if not len(out):
            return out
        before = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(width), levels[:-1]]), width)
        for begin in range(max(known, self.min_history - 1, 2), len(levels), block):
            at = np.arange(begin, min(begin + block, len(levels)))
            held = np.minimum(at, width)
            mean = before[at].sum(axis=1) / held
            there = np.arange(width) >= (width - held)[:, None]
            var = (np.where(there, before[at] - mean[:, None], 0.0) ** 2).sum(axis=1) / (held - 1)
            sigma = np.where(var > 1e-12, np.sqrt(var), 1e-6)
            out[at - known] = np.clip((levels[at] - levels[at - 1]) / sigma, -50.0, 50.0)
        return out

    def close(self) -> None:
        pass


class FlowShockDetector(StatefulProcessor):
    """One-sided flow shocks per coin (batch twin: flow_shocks without mids).

    Rows of one instant count together; rows behind the key's cursor give an output row marked ``late``.
    """

    SCHEMA = "coin string, event_id long, ts_us long, n_events long, total_usd double, ofi double, late boolean"
    STATE = "ts array<bigint>, notional array<double>, last bigint, last_id bigint"

    def __init__(self, window_us: int, min_notional: float, imbalance: float, gap_us: int):
        self.window_us, self.min_notional, self.imbalance, self.gap_us = window_us, min_notional, imbalance, gap_us

    def init(self, handle) -> None:
        self.state = handle.getValueState("flow", self.STATE)

    def handleInputRows(self, key, rows, timerValues):
        ts, signed, last, last_id = self.state.get() if self.state.exists() else ([], [], -1, -1)
        window = deque(zip(ts, signed))
        total, ofi = math.fsum(map(abs, signed)), math.fsum(signed)
        late, instants = _instants(rows, (last, last_id))
        out = [(key[0], int(r.event_id), int(r.ts_us), None, None, None, True) for r in late.itertuples()]
        for now, group in instants:
            kept = []
            for r in group:
                if not (r.price > 0 and r.size > 0):
                    continue
                stalled, last, last_id = 0 <= last < now - self.gap_us, int(now), int(r.event_id)
                if stalled:
                    window.clear()
                    total = ofi = 0.0
                    continue
                usd = float(r.price * r.size) * (1 if r.side == "BUY" else -1)
                window.append((last, usd))
                total, ofi = total + abs(usd), ofi + usd
                kept.append(int(r.event_id))
            if not kept:
                continue
            while window[0][0] < last - self.window_us:
                usd = window.popleft()[1]
                total, ofi = total - abs(usd), ofi - usd
            if len(window) >= 2 and total >= self.min_notional and abs(ofi) / max(total, 1e-12) >= self.imbalance:
                out += [(key[0], i, last, len(window), total, ofi, False) for i in kept]
        self.state.update(([x[0] for x in window], [x[1] for x in window], last, last_id))
        yield pd.DataFrame(out, columns=["coin", "event_id", "ts_us", "n_events", "total_usd", "ofi", "late"])

    def close(self) -> None:
        pass


class ArbitrageLegs(StatefulProcessor):
    """Latest YES and NO asks per market with expiry (batch twin: arbitrage_legs)."""

    SCHEMA = "market_id string, event_id long, ts_us long, total double, depth double, late boolean"
    STATE = "yp double, ys double, yt bigint, np double, ns double, nt bigint, last_id bigint"

    def __init__(self, max_total: float, min_depth: float, ttl_us: int):
        self.max_total, self.min_depth, self.ttl_us = max_total, min_depth, ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("legs", self.STATE)

    def handleInputRows(self, key, rows, timerValues):
        yp, ys, yt, np_, ns, nt, last_id = self.state.get() if self.state.exists() else (0.0, 0.0, -1, 0.0, 0.0, -1, -1)
        out = []
        for r in _batch(rows).itertuples():
            now = int(r.ts_us)
            if (now, int(r.event_id)) <= (max(yt, nt), last_id):
                out.append((key[0], int(r.event_id), now, None, None, True))
                continue
            last_id = int(r.event_id)
            if r.outcome == "YES":
                yp, ys, yt = float(r.ask), float(r.ask_size), now
            else:
                np_, ns, nt = float(r.ask), float(r.ask_size), now
            if min(yt, nt) >= 0 and round(yp + np_, 6) < self.max_total and min(ys, ns) >= self.min_depth:
                out.append((key[0], int(r.event_id), now, yp + np_, min(ys, ns), False))
        self.state.update((yp, ys, yt, np_, ns, nt, last_id))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(max(yt, nt) // 1000 + self.ttl_us // 1000)
        yield pd.DataFrame(out, columns=["market_id", "event_id", "ts_us", "total", "depth", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield pd.DataFrame([], columns=["market_id", "event_id", "ts_us", "total", "depth", "late"])

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """Large trades, each silencing its market for the cooldown (batch twin: cooldown_triggers).

    A market without a trigger for ``ttl_ms`` of processing time is forgotten.
    """

    SCHEMA = "market_id string, event_id long, ts_us long, usd double"

    def __init__(self, min_usd: float, cooldown_us: int, ttl_ms: int | None = None):
        self.min_usd, self.cooldown_us, self.ttl_ms = min_usd, cooldown_us, ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("last", "ts bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        last = self.state.get()[0] if self.state.exists() else None
        out = []
        for r in _batch(rows).itertuples():
            if r.usd >= self.min_usd and (last is None or r.ts_us - last >= self.cooldown_us):
                last = int(r.ts_us)
                out.append((key[0], int(r.event_id), last, float(r.usd)))
        if last is not None:
            self.state.update((last,))
        yield pd.DataFrame(out, columns=["market_id", "event_id", "ts_us", "usd"])

    def close(self) -> None:
        pass


class FirstAlert(StatefulProcessor):
    """First alert of each (wallet, trigger) key; the key expires after ``ttl_ms`` of processing time."""

    SCHEMA = "alert_key string, event_id long, ts_us long"

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("seen", "ts bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        out = []
        if not self.state.exists():
            first = _batch(rows).iloc[0]
            self.state.update((int(first["ts_us"]),))
            out.append((key[0], int(first["event_id"]), int(first["ts_us"])))
        yield pd.DataFrame(out, columns=["alert_key", "event_id", "ts_us"])

    def close(self) -> None:
        pass
