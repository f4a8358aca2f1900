"""A Bloom filter as a table of one row, for tests within a scan: what it rules out is neither hashed nor shuffled.

The filter has BITS_PER_KEY bits a key, and most_bits at most, which bounds what is broadcast. Beyond that it lets more through and loses
nothing, so whatever follows has to be exact by itself. It is built by partial aggregations; nothing of it reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import written

BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 12, 1 << 27


class Bloom:
    """Of the keys of a table, given as 64-bit hashes. bits: a table with one row, whose array of longs is 16 MB at most, in the column `field`."""

    def __init__(self, keys: DataFrame, hashed: Column, field: str = "__bits", *, most_bits: int = MOST_BITS) -> None:
        n, self.field = keys.count(), field
        self.size = min(most_bits, max(LEAST_BITS, 1 << (BITS_PER_KEY * n).bit_length()))
        places = keys.select(F.explode(F.array(*self._places(hashed))).alias("p"))
        # one row a word: size / 64 at most
        words = places.groupBy(self._word(F.col("p")).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), self._bit(F.col("p")))).alias("b"))
        every = keys.sparkSession.range(self.size // 64).join(words, F.col("id") == F.col("w"), "left").select(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")).alias("x"))
        self.bits = written(every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]).alias(field)), "bloom")

    def _places(self, hashed: Column) -> list[Column]:
        mask = F.lit(self.size - 1).cast("long")
        return [hashed.bitwiseAND(mask), F.shiftrightunsigned(hashed, 32).bitwiseAND(mask)]

    @staticmethod
    def _word(place: Column) -> Column:
        return F.shiftright(place, 6).cast("int")

    @staticmethod
    def _bit(place: Column) -> Column:
        return place.bitwiseAND(F.lit(63).cast("long")).cast("int")

    def beside(self, rows: DataFrame) -> DataFrame:
        """The rows with the filter as one more column, for may_hold(). One row of bounded size is broadcast."""
        return rows.crossJoin(F.broadcast(self.bits))

    def may_hold(self, hashed: Column) -> Column:
        """False only where no key has this hash."""
        bit = lambda p: F.call_function("shiftright", F.get(F.col(self.field), self._word(p)), self._bit(p)).bitwiseAND(F.lit(1).cast("long")) == 1
        one, two = map(bit, self._places(hashed))
        return one & two
