"""The estimate: scan, chunk, count tokens, look prices up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import chunking, cost


def estimated(docs: DataFrame, models: DataFrame, *, size: int = 8000, overlap: int = 1500) -> DataFrame:
    """source, provider, model, documents, chunks, input_tokens, output_tokens, cost, price_known.

    docs(doc_id, source, text), models(source, provider, model). Texts are reduced to counts before anything is shuffled.
    """
    tokens = cost.chunk_tokens(chunking.chunk_chars(docs, size, overlap), "doc_id")
    by_source = docs.select("doc_id", "source").join(tokens, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), (F.count("*") * cost.OUTPUT_TOKENS).alias("output_tokens")
    )
    usage = by_source.join(models, "source").select("source", "provider", "model", "documents", "chunks", "input_tokens", "output_tokens")
    return cost.priced(usage, cost.prices(docs.sparkSession))
