"""Token counts from an exact length histogram.

Documents are aggregated by encoded length (combined before the shuffle); the
histogram has at most as many rows as there are distinct lengths. Suffix sums
over it answer, for a context limit at each length: how many documents are
that long or longer, their tokens, the total after truncation at the limit, and
the share of documents that fit. They run over blocks of lengths, each a task,
plus the blocks' totals, so no task gets the whole histogram.

Defined results. Null and empty texts have length 0. An empty table has no
rows. Repeated rows count each; a very long text is one more length. Columns beside
n_tokens are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import written

BLOCK = 4096


def length_histogram(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """From rows ``n_tokens``: a row for each length with its counts and suffix sums."""
    h = written(
        counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
        .withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
        .withColumn("block", F.expr(f"n_tokens div {block}")),
        "length-histogram",
    )
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = written(
        h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))  # one row for each block: few
        .select(
            "block",
            F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
            F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
            F.sum("d").over(everything).alias("all_docs"),
            F.sum("t").over(everything).alias("all_tokens"),
        ),
        "length-blocks",
    )
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    x = h.join(blocks.hint("shuffle_merge"), "block")
    x = x.withColumn("docs_ge", F.sum("n_docs").over(down) + F.col("docs_after"))
    x = x.withColumn("tokens_ge", F.sum("tokens").over(down) + F.col("tokens_after"))
    longer = F.col("docs_ge") - F.col("n_docs")
    return x.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        (F.col("all_docs") - longer).alias("docs_fit"),
        "all_docs",
        "all_tokens",
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents and tokens in full, and the truncated total."""
    limit = F.explode(F.array(*[F.lit(x).cast("long") for x in sorted(set(limits))])).alias("context")
    x = histogram.select("n_tokens", "n_docs", limit)
    return x.groupBy("context").agg(
        F.sum("n_docs").alias("n_docs"),
        F.sum(F.expr("n_docs * n_tokens")).alias("all_tokens"),
        F.sum(F.expr("if(n_tokens <= context, n_docs, 0)")).alias("docs_fit"),
        F.sum(F.expr("n_docs * least(n_tokens, context)")).alias("truncated_total"),
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the smallest length that at least that share of documents don't exceed."""
    share = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    x = histogram.select("n_tokens", "docs_fit", "all_docs", share).where("docs_fit >= share * all_docs")
    return x.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
