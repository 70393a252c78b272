"""Token and cost estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T

# US dollars for a million tokens, in and out; "*" is any model of a provider.
PRICES = [
    ("anthropic", "claude-sonnet-4-20250514", 3.00, 15.00),
    ("anthropic", "claude-opus-4-20250514", 15.00, 75.00),
    ("openai", "gpt-4o", 2.50, 10.00),
    ("openai", "gpt-4o-mini", 0.15, 0.60),
    ("groq", "llama-3.1-70b-versatile", 0.59, 0.79),
    ("ollama", "*", 0.00, 0.00),
    ("google", "gemini-3-flash-preview", 0.50, 3.00),
    ("google-fast", "gemma-4-31b-it", 0.00, 0.00),
]
#: Output tokens of every estimate: 250 for each of 15 slides.
OUTPUT_TOKENS = 250 * 15


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "provider string, model string, price_in double, price_out double")


def chunk_tokens(chunks: DataFrame, *keys: str) -> DataFrame:
    """Characters and estimated input tokens of the chunks of each key; overlaps count twice."""
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunks"), F.sum(F.char_length("chunk").cast("long")).alias("total_chars"), F.sum(T.tokens(F.col("chunk"))).alias("input_tokens"))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def priced(usage: DataFrame, table: DataFrame) -> DataFrame:
    """usage(provider, model, input_tokens, output_tokens, ...) with cost and whether a price was known.

    The price of the model itself comes first, then that of the provider's "*"; without one the cost is 0. The
    price table is a fixed list of a few rows, hence broadcast.
    """
    exact = F.broadcast(table.select("provider", "model", F.col("price_in").alias("_in"), F.col("price_out").alias("_out")))
    any_model = F.broadcast(table.where("model = '*'").select("provider", F.col("price_in").alias("_any_in"), F.col("price_out").alias("_any_out")))
    joined = usage.join(exact, ["provider", "model"], "left").join(any_model, "provider", "left")
    pin, pout = F.coalesce("_in", "_any_in"), F.coalesce("_out", "_any_out")
    amount = cost(F.col("input_tokens"), F.col("output_tokens"), F.coalesce(pin, F.lit(0.0)), F.coalesce(pout, F.lit(0.0)))
    return joined.select(*usage.columns, amount.alias("cost"), pin.isNotNull().alias("price_known"))
