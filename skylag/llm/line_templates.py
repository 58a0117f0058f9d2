"""Line deduplication by a log-template tree, in built-in functions only.

Lines are masked (a token with a digit is a variable field) and led down a tree of fixed
depth: first by their number of tokens, then by their first `depth` tokens. In a leaf, a
token at a position stays in the template if lines of enough documents have it there; others
become variable fields. Enough are `min_docs`, or two where lines have more than `long_tokens` tokens. A template
recurs if that many (document, line) pairs from at least two documents follow it and enough of it
is constant. Lines of fewer than `min_tokens` tokens, too few for a template, recur as they
stand. Recurring lines are kept in the first document (smallest key) and dropped from all others.

Only hashes of lines are counted at first; texts are looked at again for lines in leaves
that recur and hold more than one line. A map-side bitmap of fixed size keeps the others,
and documents without a dropped line, out of the shuffles. The dropped lines of a document are
a bitmap too, so that a document is cut in time proportional to its length.

Defined results: a null text stays null, an empty one empty; rows without a key and blank lines stay as they are. Rows that
share key and text count as one document; unlike texts under one key are documents of their own, the
first of which is not told apart. A document may come out empty. An empty table gives no rows. Other
columns pass through unchanged, whatever their names; one called like the count is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylag.llm.bitmap import bitmap, maybe_member
from skylag.llm.names import unused
from skylag.session import materialized

FIELD = "<*>"
DEPTH = 3
MIN_TOKENS = 4
MIN_DOCS = 3
LONG_TOKENS = 50
CONSTANT_SHARE = 0.6


def masked(line: Column) -> Column:
    """The trimmed line with every token that holds a digit made a variable field."""
    bare = F.trim(line)
    return F.when(bare.rlike("[0-9]"), F.regexp_replace(bare, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(bare)


def token_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def lines_of(docs: DataFrame, key: str, text: str, min_tokens: int, depth: int) -> DataFrame:
    """Rows (key, version, number, line, tokens, leaf, k1, k2) of every line that is not blank.

    `version` tells texts under one key apart; k1 and k2 together identify a line, masked unless
    it has fewer than `min_tokens` tokens.
    """
    each = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n", -1)).alias("number", "raw"))
    lined = each.filter(F.col("raw").rlike(r"\S"))
    bare = F.trim(F.col("raw"))
    few = F.substring_index(bare, " ", max(min_tokens - 1, 0)) == bare  # fewer than `min_tokens` tokens
    lined = lined.withColumn("line", F.when(few, bare).otherwise(masked(F.col("raw")))).withColumn("tokens", token_count(F.col("line")))
    leaf = F.xxhash64("tokens", F.substring_index("line", " ", depth))
    return lined.select("key", "version", "number", "line", "tokens", leaf.alias("leaf"), F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def recurring(docs: DataFrame, lines: DataFrame, key: str, text: str, min_docs: int, min_tokens: int, depth: int, constant_share: float) -> DataFrame:
    """Rows (k1, k2, first): lines that follow a recurring template, and its first document.

    All lines of a leaf have the same number of tokens, hence `long` in common.
    """
    enough = F.when(F.col("long"), min(2, min_docs)).otherwise(min_docs)
    pairs = lines.select("key", "leaf", "k1", "k2", "long").distinct()
    variants = materialized(pairs.groupBy("leaf", "k1", "k2").agg(F.max("long").alias("long"), F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last")), "line_variants")
    leaves = variants.groupBy("leaf").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("variants"), F.max("long").alias("long")).filter((F.col("variants") > 1) & (F.col("total") >= enough))
    leaves = materialized(leaves.select("leaf"), "mixed_leaves")

    # Texts of the variants of mixed leaves, each from its first document; every other line is ruled out before it is sorted or shuffled.
    whole = lines_of(docs, key, text, min_tokens, depth).filter(F.col("tokens") >= min_tokens)
    wanted = maybe_member(variants, F.col("leaf"), bitmap(leaves, "leaf")).filter("maybe").select(F.xxhash64("k1", "k2", "first").alias("occurrence"))
    texts = maybe_member(whole, F.xxhash64("k1", "k2", "key"), bitmap(wanted, "occurrence")).filter("maybe")
    texts = texts.groupBy("leaf", "k1", "k2").agg(F.min("line").alias("line"))
    mixed = materialized(texts.join(leaves, "leaf", "left_semi").join(variants.drop("leaf"), ["k1", "k2"]), "mixed_variants")

    tokens = mixed.select("leaf", "long", "k1", "k2", "n", F.posexplode(F.split("line", " ", -1)).alias("place", "token")).filter(F.col("place") >= depth)
    support = tokens.groupBy("leaf", "place", "token").agg(F.sum("n").alias("support"), F.max("long").alias("long")).filter(F.col("support") >= enough)
    support = materialized(support.select("leaf", "place", "token"), "constant_tokens")
    constant = tokens.join(support, ["leaf", "place", "token"]).groupBy("leaf", "k1", "k2").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("constants"))
    named = mixed.join(constant, ["leaf", "k1", "k2"]).withColumn("shape", F.xxhash64("constants")).withColumn("shape2", F.xxhash64(F.lit(1), "constants"))
    fixed = F.size("constants") + F.size(F.filter(F.split(F.substring_index("line", " ", depth), " ", -1), lambda t: t != FIELD)) - F.size(F.filter("constants", lambda c: c["token"] == FIELD))
    strong = named.filter((fixed >= min_tokens) & (fixed >= constant_share * token_count(F.col("line"))))
    strong = materialized(strong.select("leaf", "long", "shape", "shape2", "k1", "k2", "n", "first", "last"), "templates_of_variants")
    templates = strong.groupBy("leaf", "shape", "shape2").agg(F.sum("n").alias("n"), F.max("long").alias("long"), F.min("first").alias("first"), F.max("last").alias("last"))
    templates = materialized(templates.filter((F.col("n") >= enough) & (F.col("first") < F.col("last"))).select("leaf", "shape", "shape2", "first"), "recurring_templates")
    general = strong.drop("first").join(templates, ["leaf", "shape", "shape2"]).select("k1", "k2", "first")

    # A line that recurs by itself is its own template, unless a wider one holds it.
    alone = variants.filter((F.col("n") >= enough) & (F.col("first") < F.col("last"))).select("k1", "k2", "first")
    return materialized(general.unionByName(alone).groupBy("k1", "k2").agg(F.min("first").alias("first")), "recurring_lines")


def dropped_lines(hits: DataFrame) -> DataFrame:
    """Rows (key, version, words): the numbers of the hits of each document as a bitmap, 64 lines a word."""
    words = hits.groupBy("key", "version", F.shiftright("number", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, number & 63)")).alias("bits"))
    sorted_words = materialized(words.groupBy("key", "version").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("sorted")), "dropped_words")

    def with_gap(x: Column, i: Column) -> Column:
        before = F.when(i == 0, -1).otherwise(F.get(F.col("sorted"), i - 1)["word"])
        return F.concat(F.array_repeat(F.lit(0).cast("long"), x["word"] - before - 1), F.array(x["bits"]))

    return sorted_words.select("key", "version", F.flatten(F.transform("sorted", with_gap)).alias("words"))


def drop_recurring(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    depth: int = DEPTH,
    constant_share: float = CONSTANT_SHARE,
    long_tokens: int = LONG_TOKENS,
    count: str = "lines_dropped",
) -> DataFrame:
    """The frame with recurring lines dropped from its text, and how many they were."""
    lines = materialized(lines_of(docs, key, text, min_tokens, depth).withColumn("long", F.col("tokens") > long_tokens).drop("line", "tokens"), "lines")
    known = recurring(docs, lines, key, text, min_docs, min_tokens, depth, constant_share)
    hits = lines.join(known, ["k1", "k2"]).filter(F.col("key") > F.col("first"))
    dropped = materialized(dropped_lines(hits).withColumn("document", F.xxhash64("key", "version")), "dropped_lines")

    plain = docs.drop(count)
    version, maybe, other_key, other_version, words = unused(plain, "_version", "_maybe", "_key", "_other", "_words")
    named = plain.withColumn(version, F.xxhash64(text))
    told = maybe_member(named, F.xxhash64(F.col(key), F.col(version)), bitmap(dropped, "document"), maybe)
    untouched = told.filter(~F.col(maybe)).withColumn(count, F.lit(0))
    gone = dropped.select(F.col("key").alias(other_key), F.col("version").alias(other_version), F.col("words").alias(words))
    joined = told.filter(maybe).join(gone, (F.col(key) == F.col(other_key)) & (F.col(version) == F.col(other_version)), "left")

    def is_kept(line: Column, i: Column) -> Column:
        return F.coalesce(F.getbit(F.get(F.col(words), F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))), F.lit(0)) == 0

    kept = F.array_join(F.filter(F.split(text, "\n", -1), is_kept), "\n")
    size = F.aggregate(F.coalesce(F.col(words), F.array().cast("array<bigint>")), F.lit(0), lambda a, w: a + F.bit_count(w))
    touched = joined.withColumn(count, size).withColumn(text, F.when(F.col(words).isNotNull(), kept).otherwise(F.col(text)))
    columns = [c for c in docs.columns if c != count]
    return touched.select(*columns, count).unionByName(untouched.select(*columns, count))
