"""Incremental support over a stream of sequences (an extension: the postings grow as entities arrive)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentograph.operators import ngrams


def support_stream(stream: DataFrame, longest: int, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """(ngram, support) over a streaming (id, tokens): each entity counts once for each of its n-grams.

    An entity has to arrive in one row. With a watermark, support is by hour of ``time`` and late rows are left out.
    """
    own = stream if watermark is None else stream.withWatermark(time, watermark)
    keep = [] if watermark is None else [F.window(time, "1 hour").alias("window")]
    rows = own.select(*keep, F.explode(F.array_distinct(F.transform(ngrams.windows(F.col("tokens"), longest), lambda t: F.array_join(t, "|")))).alias("ngram"))
    return rows.groupBy(*(["window"] if watermark else []), "ngram").agg(F.count(F.lit(1)).alias("support"))
