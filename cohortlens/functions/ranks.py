"""Exact percentiles of whole columns with bounded memory, in the executors and on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a bracket that come to the driver, accuracy of the sketch that narrows larger ones, and how much wider a bracket is than its error.
AT_ONCE, ACCURACY, SLACK = 20_000, 10_000, 2.0


class _Rank:
    """The k-th value of a field, from 0: known, or strictly between low and high, where `inside` values lie, after `below` ones."""

    def __init__(self, x: Column, k: int, n: int):
        self.x, self.k, self.below, self.inside = x, k, 0, n
        self.low = self.high = self.value = None
        self.slack = SLACK

    def within(self) -> Column:
        out = self.x.isNotNull()
        out = out if self.low is None else out & (self.x > self.low)
        return out if self.high is None else out & (self.x < self.high)

    def ends(self) -> Column:
        """Two values that its own lies between, if the sketch is right; the whole range once the slack is as large."""
        at, wide = (self.k - self.below) / max(1, self.inside - 1), self.slack / ACCURACY
        inside = F.when(self.within(), self.x)
        if wide >= 1:
            return F.array(F.min(inside), F.max(inside))
        return F.percentile_approx(inside, [max(0.0, at - wide), min(1.0, at + wide)], ACCURACY)

    def counts(self, low: float, high: float) -> list[Column]:
        return [F.count_if(c) for c in (self.x < low, self.x <= low, self.x < high, self.x <= high)]

    def take(self, low: float, high: float, under: int, to_low: int, to_high: int, up_to: int) -> None:
        if not under <= self.k < up_to:
            self.slack *= 16
        elif self.k < to_low:
            self.value = low
        elif self.k >= to_high:
            self.value = high
        else:
            self.low, self.high, self.below, self.inside, self.slack = low, high, to_low, to_high - to_low, SLACK


def exact_percentiles(df: DataFrame, wanted: list[tuple[str, float]], at_once: int = AT_ONCE) -> dict[tuple[str, float], float | None]:
    """
    Percentiles q (0 to 100) of fields, linear between neighbours, nulls left out; None for a field without values.

    A sketch brackets every rank, counts make sure of the bracket, and so on until a bracket has `at_once` values at most, which are
    sorted on the driver.  Ties at an end of a bracket are the answer or are left out by their count, so that no value's copies are held.
    Each round is two aggregations for all ranks together and narrows a bracket some thousandfold.
    """
    fields = sorted({f for f, _ in wanted})
    x = {f: F.col(f"`{f}`").cast("double") for f in fields}
    total = dict(zip(fields, df.agg(*(F.count(x[f]) for f in fields)).first(), strict=True)) if fields else {}
    place = {(f, q): q / 100 * (total[f] - 1) for f, q in wanted if total[f]}
    ranks = {(f, k): _Rank(x[f], k, total[f]) for (f, _), p in place.items() for k in (math.floor(p), math.ceil(p))}
    while wide := [r for r in ranks.values() if r.value is None and r.inside > at_once]:
        ends = df.agg(*(r.ends() for r in wide)).first()
        counts = df.agg(*(c for r, e in zip(wide, ends, strict=True) for c in r.counts(*e))).first()
        for j, (r, e) in enumerate(zip(wide, ends, strict=True)):
            r.take(*e, *counts[4 * j : 4 * j + 4])
    # Neighbouring ranks often share a bracket; its values come once.
    left = [r for r in ranks.values() if r.value is None]
    brackets = {(f, r.low, r.high): r for (f, _), r in ranks.items() if r.value is None}
    held = dict(zip(brackets, df.agg(*(F.collect_list(F.when(r.within(), r.x)) for r in brackets.values())).first(), strict=True)) if left else {}
    values = {key: sorted(v, key=lambda y: (y != y, y)) for key, v in held.items()}

    def at(f: str, k: int) -> float:
        r = ranks[f, k]
        return r.value if r.value is not None else values[f, r.low, r.high][k - r.below]

    out: dict[tuple[str, float], float | None] = dict.fromkeys(wanted)
    for (f, q), p in place.items():
        low, high = math.floor(p), math.ceil(p)
        a, b = at(f, low), at(f, high)
        out[f, q] = a if low == high or a == b else (high - p) * a + (p - low) * b
    return out
