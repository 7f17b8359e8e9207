"""Exact token-length histogram and the answers that its suffix sums give for every context limit.

Nulls count as empty texts (length 0). Repeated rows count each time. An empty table gives an empty histogram. Other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.bpe import load_ranks
from emberframe.llm.common import pick, stored

#: Lengths that one window of the suffix sums spans; the sums of whole spans are added in a second step.
SPAN = 1024


def token_lengths(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """(length): encoded length of each text, one row a document."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoder = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"length": [len(encoder.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["text"]]})

    return pick(docs, text=text).mapInPandas(run, "length long")


def histogram(lengths: DataFrame, length: str = "length") -> DataFrame:
    """(length, n_docs): documents of each exact length. It is stored, so that texts are encoded once however often it is read."""
    return stored(lengths.groupBy(F.col(length).alias("length")).agg(F.count("*").alias("n_docs")), "length-histogram")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L that occurs: documents and tokens of that length, below or at L, at or above L, and in all;
    quantile (share of documents with at most L tokens) and truncated_tokens (total if each text is cut at L tokens).

    Window sums run within spans of SPAN lengths; span totals are summed apart, so no task sees the whole histogram.
    """
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / SPAN).alias("span"))
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("span_docs"), F.sum("tokens").alias("span_tokens"))
    after = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = spans.select("span", F.coalesce(F.sum("span_docs").over(after), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("span_tokens").over(after), F.lit(0)).alias("tokens_above"))
    total = spans.agg(F.sum("span_docs").alias("all_docs"), F.sum("span_tokens").alias("all_tokens"))
    within = Window.partitionBy("span").orderBy(F.col("length").desc())
    out = (
        h.join(above, "span")
        .withColumn("docs_at_least", F.sum("n_docs").over(within) + F.col("docs_above"))
        .withColumn("tokens_at_least", F.sum("tokens").over(within) + F.col("tokens_above"))
        .crossJoin(F.broadcast(total))  # one row
    )
    at_most = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return out.select(
        F.col("length").alias("context_limit"), "n_docs", "docs_at_least", "tokens_at_least", F.col("all_docs").alias("total_docs"), F.col("all_tokens").alias("total_tokens"),
        (at_most / F.col("all_docs")).alias("quantile"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("length")).alias("truncated_tokens"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """(length): the smallest length that at least a share q of the documents does not exceed."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("context_limit").alias("length"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """(truncated_tokens): total tokens if each text is cut at `limit`, whether or not a text has that length."""
    cut = F.col("tokens_at_least") - F.col("docs_at_least") * F.lit(limit)
    over = sums.filter(F.col("context_limit") > limit)
    first = over.agg(F.min_by(cut, "context_limit").alias("saved"))
    return sums.agg(F.max("total_tokens").alias("t")).crossJoin(first).select((F.coalesce("t", F.lit(0)) - F.coalesce("saved", F.lit(0))).alias("truncated_tokens"))
