"""Exact token totals for every context limit from one length histogram.

Documents are aggregated by encoded length; suffix sums over the lengths answer how many
documents are longer than a limit, how many tokens remain when every document is truncated
to it, and every quantile. The histogram has one row per distinct length.

Null and empty texts have length 0. No documents: no rows. Repeated rows are counted one by one; very long texts
are encoded whole, in pieces. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylag.llm import bpe
from skylag.llm.prefix import running_before
from skylag.session import materialized


def lengths(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """One row per document with the number of ids of its text."""
    coded = bpe.encode(docs.select(F.col(text).alias("text")), vocabulary)
    return coded.select((F.length("ids") / 4).cast("long").alias("n_tokens"))


def histogram(per_document: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """Rows (n_tokens, documents, documents_shorter, tokens_shorter, documents_longer,
    tokens_longer, total_documents, total_tokens, truncated_tokens), one per distinct length.

    `truncated_tokens` is what is left of all documents with that length as the limit.
    """
    counts = per_document.groupBy(F.col(n_tokens).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("documents"))
    counts = materialized(counts, "lengths")
    own = F.col("documents") * F.col("n_tokens")
    documents, tokens = counts.agg(F.sum("documents"), F.sum(own)).first()
    sums = running_before(counts, "n_tokens", {"documents_shorter": F.col("documents"), "tokens_shorter": own})
    return (
        sums.withColumns({"total_documents": F.lit(documents).cast("long"), "total_tokens": F.lit(tokens).cast("long")})
        .withColumn("documents_longer", F.col("total_documents") - F.col("documents_shorter") - F.col("documents"))
        .withColumn("tokens_longer", F.col("total_tokens") - F.col("tokens_shorter") - own)
        .withColumn("truncated_tokens", F.col("tokens_shorter") + F.col("n_tokens") * (F.col("documents") + F.col("documents_longer")))
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """One row: total and truncated tokens, and documents cut, for any limit >= 0.

    Empty histogram: one row of nulls.
    """
    fits = F.col("n_tokens") <= F.lit(limit)
    kept: Column = F.when(fits, F.col("n_tokens")).otherwise(F.lit(limit)) * F.col("documents")
    return hist.agg(
        F.max("total_tokens").alias("total_tokens"),
        F.sum(kept).alias("truncated_tokens"),
        F.sum(F.when(fits, 0).otherwise(F.col("documents"))).alias("documents_cut"),
    )


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of the documents does not exceed."""
    reached = (F.col("documents_shorter") + F.col("documents")) >= F.lit(q) * F.col("total_documents")
    return hist.filter(reached).agg(F.min("n_tokens").alias("n_tokens"))
