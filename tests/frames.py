"""Hand-made and random tick frames, and a bin-by-bin evaluation of the bar rules in plain Python."""

from __future__ import annotations

import math
import random
import statistics
from datetime import date, timedelta

SCHEMA = (
    "symbol STRING, session DATE, ts_us BIGINT, seq BIGINT, action STRING, side STRING, price DOUBLE, bid_px_00 DOUBLE, "
    "ask_px_00 DOUBLE, bid_px_01 DOUBLE, ask_px_01 DOUBLE, size BIGINT, bid_sz_00 BIGINT, ask_sz_00 BIGINT"
)
FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]
EPOCH = date(1970, 1, 1)
DAY = date(2024, 10, 7)


def tick(seq, second, action="A", side="B", bid=100.0, ask=101.0, bid_sz=10, ask_sz=20, size=5, price=None, symbol="X", day=DAY):
    us = (day - EPOCH).days * 86_400_000_000 + round(second * 1_000_000)
    price = price if price is not None else 100.5
    return (symbol, day, us, seq, action, side, price, bid, ask, bid and bid - 1, ask and ask + 1, size, bid_sz, ask_sz)


def random_ticks(seed, sessions=2, n=150, bins=40, rate=60):
    """Ticks with gaps, equal times, missing sides, empty books and rare actions."""
    rng = random.Random(seed)
    rows = []
    for symbol in ("X", "Y"):
        for d in range(sessions):
            seconds = sorted(rng.choice(range(bins * rate * 4)) / 4 for _ in range(n))
            for i, s in enumerate(seconds):
                bid = None if rng.random() < 0.05 else 100 + rng.randint(-64, 64) / 64
                ask = None if rng.random() < 0.05 else (bid or 100.0) + rng.randint(1, 5) / 64
                empty = rng.random() < 0.05
                rows.append(
                    tick(
                        i,
                        34_200 + s,
                        rng.choice("TTTAAAACCCM"),
                        rng.choice("BA"),
                        bid,
                        ask,
                        0 if empty else rng.randint(0, 30),
                        0 if empty else rng.randint(0, 30),
                        rng.randint(1, 100),
                        100 + rng.randint(-64, 64) / 64,
                        symbol,
                        DAY + timedelta(days=d),
                    )
                )
    rng.shuffle(rows)
    return rows


def _mean(values):
    return sum(values) / len(values) if values else None


def _std(values):
    return statistics.stdev(values) if len(values) > 1 else None


def _minus(a, b):
    return None if a is None or b is None else a - b


def _over(a, b):
    return None if a is None or not b else a / b


def session_bars(rows, rate):
    """Complete bars of one (symbol, session): ``{bar index: {column: value}}``."""
    ticks = sorted((dict(zip(FIELDS, r)) for r in rows), key=lambda t: (t["ts_us"], t["seq"]))
    by_bin: dict[int, list[dict]] = {}
    for t in ticks:
        bid, ask = t["bid_px_00"], t["ask_px_00"]
        sides = [v for v in (ask, bid) if v is not None]
        t["mid"] = _mean(sides)
        t["spread"] = _minus(ask, bid)
        total = t["bid_sz_00"] + t["ask_sz_00"]
        both = bid is not None and ask is not None and total > 0
        t["wmid"] = (ask * t["bid_sz_00"] + bid * t["ask_sz_00"]) / total if both else (ask if ask is not None else bid)
        by_bin.setdefault(t["ts_us"] % 86_400_000_000 // (rate * 1_000_000), []).append(t)
    lo, hi = min(by_bin), max(by_bin)

    def span(test):
        found = [ix for ix, ts in by_bin.items() if any(test(t) for t in ts)]
        return (min(found), max(found)) if found else (None, None)

    def covered(test, ix):
        a, b = span(test)
        return a is not None and a <= ix <= b

    def is_(action, side=None):
        return lambda t: t["action"] == action and (side is None or t["side"] == side)

    grid, carried = [], {}
    for ix in range(lo, hi + 1):
        ts = by_bin.get(ix, [])
        values = lambda c: [t[c] for t in ts if t[c] is not None]
        end = lambda c, k: values(c)[k] if values(c) else None
        top = lambda f, c: f(values(c)) if values(c) else None
        row = {
            "mid_price_first": end("mid", 0),
            "mid_price_last": end("mid", -1),
            "mid_price_high": top(max, "mid"),
            "mid_price_low": top(min, "mid"),
            "mid_price_mean": _mean(values("mid")),
            "std_mid_price": _std(values("mid")),
            "weighted_mid_price_first": end("wmid", 0),
            "weighted_mid_price_last": end("wmid", -1),
            "weighted_mid_price_mean": _mean(values("wmid")),
            "last_spread": end("spread", -1),
            "mean_spread": _mean(values("spread")),
            "std_spread": _std(values("spread")),
            "mean_best_bid_price": _mean(values("bid_px_00")),
            "mean_best_ask_price": _mean(values("ask_px_00")),
            "std_best_bid_size": _std(values("bid_sz_00")),
            "std_best_ask_size": _std(values("ask_sz_00")),
            "mean_second_ask_price": _mean(values("ask_px_01")),
            "mean_second_bid_price": _mean(values("bid_px_01")),
        }
        fresh = {
            "last_best_bid_price": end("bid_px_00", -1),
            "last_best_ask_price": end("ask_px_00", -1),
            "last_best_bid_size": end("bid_sz_00", -1),
            "last_best_ask_size": end("ask_sz_00", -1),
            "mean_best_bid_size": _mean(values("bid_sz_00")),
            "mean_best_ask_size": _mean(values("ask_sz_00")),
        }
        carried = {c: carried.get(c) if v is None else v for c, v in fresh.items()}
        row |= carried
        trades = [t["price"] for t in ts if t["action"] == "T"]
        row |= {
            "trade_open": trades[0] if trades else None,
            "trade_close": trades[-1] if trades else None,
            "trade_high": max(trades, default=None),
            "trade_low": min(trades, default=None),
        }
        for name, code in (("num_added_orders", "A"), ("num_canceled_orders", "C"), ("num_traded_orders", "T")):
            row[name] = sum(t["action"] == code for t in ts) if covered(is_(code), ix) else None
        for name, side in (("total_bid_volume", "B"), ("total_ask_volume", "A")):
            both = covered(is_("A", side), ix) and covered(is_("C", side), ix)
            flow = sum(t["size"] for t in ts if is_("A", side)(t)) - sum(t["size"] for t in ts if is_("C", side)(t))
            row[name] = flow if both else None
        for name, c in (("mid_price", "mid_price_last"), ("mean_mid_price", "mid_price_mean")):
            row[f"{name}_variation"] = _minus(_over(row[c], row["mid_price_first"]), 1)
        row["weighted_mid_price_variation"] = _minus(_over(row["weighted_mid_price_last"], row["weighted_mid_price_first"]), 1)
        bid, ask = row["mean_best_bid_size"], row["mean_best_ask_size"]
        gap = None if bid is None or ask is None else math.trunc(bid) - math.trunc(ask)
        row["mean_order_book_imbalance"] = _over(gap, None if gap is None else bid + ask)
        bid, ask = row["last_best_bid_size"], row["last_best_ask_size"]
        row["total_net_order_flow"] = _minus(bid, ask)
        row["last_order_book_imbalance"] = _over(row["total_net_order_flow"], None if bid is None or ask is None else bid + ask)
        grid.append(row)
    for k, row in enumerate(grid):
        for name, c in (("order_book_imbalance_5s", "mean_order_book_imbalance"), ("order_flow_5s", "total_net_order_flow")):
            last5 = [g[c] for g in grid[max(0, k - 4) : k + 1]]
            row[name] = _mean(last5) if len(last5) == 5 and None not in last5 else None
        before = grid[k - 1] if k else {}
        for name, c in (("bid_volume_variation", "last_best_bid_size"), ("ask_volume_variation", "last_best_ask_size")):
            row[name] = _minus(row[c], before.get(c))
        for name, c in (("bid_price_variation", "last_best_bid_price"), ("ask_price_variation", "last_best_ask_price")):
            now, then = row[c], before.get(c)
            row[name] = None if now is None or then is None else math.trunc(now) - math.trunc(then)
        move = row["mid_price_variation"]
        row["mid_price_variation_class"] = 1 if not move else 2 if move > 0 else 0
        mean_move = row["mean_mid_price_variation"]
        row["mean_mid_price_variation_class"] = int(mean_move is not None and mean_move >= 0)
        weighted = row["weighted_mid_price_variation"]
        row["weighted_mid_price_variation_class"] = int(weighted is not None and weighted > 0)
        coming = [g["mean_mid_price_variation"] for g in grid[k : k + 5]]
        ready = k >= 4 and len(coming) == 5 and None not in coming
        row["next_5_mean_mid_price_variation_class"] = int(ready and _mean(coming) > 0)
    return {lo + k: row for k, row in enumerate(grid) if None not in row.values()}
