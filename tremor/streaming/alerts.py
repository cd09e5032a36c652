"""Debounced alerts carried over batches, and the start of a stream that has fallen behind."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from tremor.streaming.live import on_final_bars


def alert_bars(events: DataFrame, mu: float, alpha: float, beta: float, width: int, threshold: float, k: int, window: int, lag: int, genesis_s: int, block_s: int) -> DataFrame:
    """(protocol, bar, score) of each bar at which k of the last `window` bars come to be above the threshold.

    events: protocol, ts, usd. Every bar up to the last final one with events is tested, quiet ones too: after some quiet bars
    none of the last `window` is above, and the rest of a gap is skipped. Carried: decayed history at the next bar, that bar,
    the last flags, and whether an alert is on.
    """
    window = max(window, k)

    def fold(protocol, carried, rows):
        r, at, flags, active = carried or (0.0, rows[0][0], "", False)
        out = []
        for bar, n, _ in rows:
            while at <= bar:
                score = alpha * r / (mu + alpha * r)
                flags = (flags + ("1" if score >= threshold else "0"))[-window:]
                on = flags.count("1") >= k
                if on and not active:
                    out.append((protocol, at, score))
                active = on
                skip = at < bar - 1 and "1" not in flags and score < threshold
                gone = bar - at if skip else 1  # scores only fall in a gap
                r, at = (r + (n if at == bar else 0)) * math.exp(-beta * gone), at + gone
        return (r, at, flags, active), out

    return on_final_bars(events, fold, "protocol string, bar long, score double", width, lag, genesis_s, block_s)


def catch_up_start(scored_through: int, head: int, cap: int, width: int, origin: int = 0) -> tuple[int, bool]:
    """(block to start from, whether the carried history is dropped): a gap of more than `cap` blocks is skipped up to the
    last bar edge on the origin's clock that is `cap` or more before the head; a cap of 0 skips nothing."""
    if not cap or head - scored_through <= cap:
        return scored_through, False
    return origin + (head - cap - origin) // width * width, True
