"""Column functions that several operators share. The work of each grows about as its arrays do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums run over blocks of so many values, then over the blocks.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever number of times ``body`` names it, also inside its own lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(values: Column) -> Column:
    """Sums of the values before each, and of all: one more than there are values. For short arrays: each step copies the sums so far."""
    return F.aggregate(values, F.array(F.lit(0)), lambda done, v: F.concat(done, F.array(F.element_at(done, -1) + v)))


def sums_before(values: Column) -> Column:
    """For each whole number of an array the sum of those before it; an empty array gives an empty one."""

    def over(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))
        return F.when(F.size(v) > 0, let(F.transform(starts, lambda at: _sums(F.slice(v, at, BLOCK))), joined)).otherwise(F.array().cast("array<int>"))

    def joined(blocks: Column) -> Column:
        firsts = _sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(firsts, lambda f: F.flatten(F.transform(blocks, lambda b, k: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda s: s + F.get(f, k)))))

    return let(values, over)


def starts_at(words: Column, spots: Column) -> Column:
    """Where the words of some numbers, in order, start in their text, one character standing between words. Each word is counted once."""

    def over(s: Column) -> Column:
        before = lambda k: F.when(k == 0, 0).otherwise(F.get(s, k - 1))
        gaps = F.transform(s, lambda at, k: F.aggregate(F.slice(words, before(k) + 1, at - before(k)), F.lit(0), lambda n, w: n + F.length(w) + 1))
        return let(gaps, lambda g: let(sums_before(g), lambda sums: F.transform(g, lambda gap, k: F.get(sums, k) + gap)))

    return let(spots, over)


def first_ending_after(spans: Column, at: Column) -> Column:
    """Place, by halving, of the first of some spans with ``end`` beyond a point; their number if none is. The spans must be in order and apart."""

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        beyond = F.get(spans, middle)["end"] > at
        return F.when(a["low"] >= a["high"], a).otherwise(F.struct(F.when(beyond, a["low"]).otherwise(middle + 1).alias("low"), F.when(beyond, middle).otherwise(a["high"]).alias("high")))

    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(spans))))
    return F.aggregate(halvings, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), step)["low"]
