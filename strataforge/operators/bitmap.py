"""Bitmaps that drop rows before a shuffle, sized by the number of their keys up to a fixed bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longs in a bitmap: at least and at most (4 MB). About so many bits are taken a key; past the bound more rows get through to the join that follows, which decides.
LEAST_LONGS, MOST_LONGS, BITS = 1 << 12, 1 << 19, 16


class Bitmap:
    """Which slots some keys (longs) fill. Its array is a literal of bounded size in the plans that use it."""

    def __init__(self, keys: DataFrame, key: Column):
        self.longs = LEAST_LONGS
        # an approximate count is a small pass over keys, which are a written table
        n = keys.agg(F.approx_count_distinct(key)).first()[0]
        while self.longs < MOST_LONGS and 64 * self.longs < BITS * n:
            self.longs *= 2
        word = F.shiftright(self._slot(key), 6).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))
        # one row a long, of bounded number
        found = dict(keys.groupBy(word.alias("k")).agg(F.bit_or(bit).alias("v")).filter("k is not null").collect())
        self.array = F.split(F.lit(",".join(str(found.get(k, 0)) for k in range(self.longs))), ",").cast("array<bigint>")

    def _slot(self, key: Column) -> Column:
        return F.pmod(key, F.lit(64 * self.longs))

    def fills(self, key: Column) -> Column:
        """False only if key is none of the bitmap's keys."""
        return F.getbit(F.get(self.array, F.shiftright(self._slot(key), 6).cast("int")), F.pmod(key, F.lit(64)).cast("int")) == 1


def may_be_in(keys: DataFrame, *names: str) -> Column:
    """A condition on columns that all their values in keys meet, and few others."""
    key = F.xxhash64(*names)
    return Bitmap(keys, key).fills(key)
