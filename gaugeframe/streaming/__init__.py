"""Running totals over a stream of texts, from the same expressions as the batch checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions import text as tx


def running_profile(stream: DataFrame, text_col: str = "text", short: int = 8, toxic_threshold: float = 0.8) -> DataFrame:
    """One row of totals, for ``outputMode("complete")``: rows, empty and short texts, words, sentences, toxic rows.

    Only sums are kept as state, so its size does not grow with the stream. Null texts count as empty."""
    text = F.col(text_col).cast("string")
    bare = F.length(tx.clean(text))
    words = tx.words(text)
    return stream.groupBy().agg(
        F.count("*").alias("rows"),
        F.count_if(bare == 0).alias("empty_text_rows"),
        F.count_if((bare > 0) & (F.length(text) < short)).alias("short_text_rows"),
        F.sum(F.size(words)).alias("words"),
        F.sum(tx.sentences(text)).alias("sentences"),
        F.count_if(tx.toxicity(words) >= toxic_threshold).alias("toxic_rows"),
    )
