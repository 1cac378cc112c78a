"""A Bloom filter over keys, as a column expression: which rows cannot have one of many keys.

The filter is sized from the counted number of keys, built by a distributed aggregate of 64-bit words, and
reaches tasks as one array, so the rows that are looked up do not move. What it lets pass has one of the keys,
or is one of the few false positives that the caller settles exactly.

All bits of a key lie in one word: a look-up names the words once, so a plan and its tasks carry one copy of them, and
the key twice, however many bits are tested.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.sources.store import Store

#: Bits of the filter for each key, and bits that a key sets: one other key in two hundred passes.
BITS_A_KEY, HASHES = 16, 5
#: A filter is at most so large; more keys than fit make more false positives, never a wrong answer.
MOST_BYTES = 64 << 20
_WORD = 64


@dataclass(frozen=True)
class KeyFilter:
    """Bits set for keys: ``words`` as a column of one row, ``size`` of them."""

    words: Column
    size: int

    @classmethod
    def of(cls, keys: DataFrame, column: str, count: int, store: Store, label: str) -> "KeyFilter":
        """A filter for ``count`` keys, as many as counted."""
        size = max(1, min(-(-count * BITS_A_KEY // _WORD), MOST_BYTES // 8))
        set_bits = keys.select(_place(F.col(column), size).alias("at")).groupBy("at.word").agg(F.bit_or("at.bits").alias("set"))
        # One row of at most MOST_BYTES: words without a key are filled in, so a place is an index.
        every = keys.sparkSession.range(size).select(F.col("id").cast("int").alias("word")).join(set_bits, "word", "left")
        ordered = F.sort_array(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("long")).alias("set"))))
        kept = store.write(label, every.agg(ordered.alias("all")).select(F.col("all.set").alias("words")))
        return cls(kept.select("words").scalar(), size)

    def may_have(self, key: Column) -> Column:
        """Whether a key may be one of the filter's; false for null."""
        # A key is worked out inside the function's argument, and not once for each of its bits.
        at = F.get(F.transform(F.array(key), lambda k: _place(k, self.size)), F.lit(0))
        unset = F.bitwise_not(F.get(self.words, at["word"])).bitwiseAND(at["bits"])
        return F.coalesce(unset == 0, F.lit(False))


def _place(key: Column, size: int) -> Column:
    """The word of a key and its bits there: one hash gives the word, six bits of another each bit. No word for null."""
    word = F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(size)).cast("int"))
    hashed = F.xxhash64(key, F.lit("second"))
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.pmod(F.shiftrightunsigned(hashed, 6 * at), F.lit(_WORD)).cast("int")) for at in range(HASHES)]
    return F.struct(word.alias("word"), reduce(Column.bitwiseOR, bits).alias("bits"))
