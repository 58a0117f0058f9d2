"""A bounded pre-filter: rows that cannot be among some keys are told apart before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylag.llm.names import unused
from skylag.session import materialized

BITS = 24  # 2^24 bits are 2 MB, whatever the number of keys
WORDS_PER_BLOCK = 1 << 12


def _place(key: Column) -> tuple[Column, Column, Column]:
    """Block, word in the block and bit of a 64-bit key."""
    at = key.bitwiseAND(F.lit((1 << BITS) - 1))
    word = F.shiftright(at, 6)
    return F.floor(word / WORDS_PER_BLOCK).cast("int"), (word % WORDS_PER_BLOCK).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")


def bitmap(members: DataFrame, key: str) -> DataFrame:
    """Rows (block, words): the set bits of all keys, 4,096 words a row."""
    block, word, bit = _place(F.col(key))
    set_bits = members.select(block.alias("block"), word.alias("word"), bit.alias("bit")).distinct()
    per_word = set_bits.groupBy("block", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    empty = members.sparkSession.range(1 << (BITS - 6)).select(F.floor(F.col("id") / WORDS_PER_BLOCK).cast("int").alias("block"), (F.col("id") % WORDS_PER_BLOCK).cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = per_word.unionByName(empty).groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    whole = words.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("sorted"))
    return materialized(whole.select("block", F.col("sorted.bits").alias("words")), "bitmap")


def maybe_member(df: DataFrame, key: Column, members: DataFrame, name: str = "maybe") -> DataFrame:
    """The frame with a column that is false only for rows whose key is not among `members`."""
    columns = dict(zip(("block", "word", "bit", "words"), unused(df, "_block", "_word", "_bit", "_words")))
    block, word, bit = _place(key)
    placed = df.withColumns({columns["block"]: block, columns["word"]: word, columns["bit"]: bit})
    own = members.select(F.col("block").alias(columns["block"]), F.col("words").alias(columns["words"]))
    joined = placed.join(F.broadcast(own), columns["block"], "left")
    hit = F.coalesce(F.getbit(F.get(columns["words"], F.col(columns["word"])), F.col(columns["bit"])) == 1, F.lit(False))
    return joined.select(*df.columns, hit.alias(name))
