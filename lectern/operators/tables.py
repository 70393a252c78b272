"""Pipe tables in Markdown: islands of table lines, checks, placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.storage import Scratch, small

# What makes a table malformed.
MOST_ROWS = 70
LEAST_CONSISTENT = 0.8
LEAST_FILLED = 0.2


# What ends a line.
LINE_ENDS = "\\n\\r\\x0b\\x0c\\x1c-\\x1e\\u0085\\u2028\\u2029"


def whole_lines(text: Column) -> Column:
    """The lines of a text as an array, each with what ends it; an end at the very last gives no further line."""
    return F.regexp_extract_all(text, F.lit(f"([^{LINE_ENDS}]*(?:\\r\\n|[{LINE_ENDS}])|[^{LINE_ENDS}]+\\z)"), 1)


def lines_of(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, l, eol: the lines of each text and what ends them."""
    rows = docs.where(F.col(text) != "").select(key, F.posexplode(whole_lines(F.col(text))).alias("line", "_w"))
    rows = rows.withColumn("eol", F.regexp_extract("_w", f"(\\r\\n|[{LINE_ENDS}])\\z", 1))
    return rows.select(key, "line", F.expr("substring(_w, 1, char_length(_w) - char_length(eol))").alias("l"), "eol")


def table_islands(lines: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """lines(key, line, l, ...) with island: null outside of tables, else the number of the first line.

    A table begins at a line that starts or ends with a pipe and goes on while lines hold any pipe.
    """
    order = W.partitionBy(key).orderBy("line")
    pipe = F.contains("l", F.lit("|"))
    begins = pipe & T.strip(F.col("l")).rlike(r"^\||\|$")
    # runs of lines with a pipe, and inside each the first line that can begin a table
    run = F.sum(F.when(pipe, 0).otherwise(1)).over(order)
    marked = lines.withColumn("_pipe", pipe).withColumn("_begins", begins).withColumn("_run", run)
    first = F.min(F.when(F.col("_begins"), F.col("line"))).over(W.partitionBy(key, "_run"))
    return marked.withColumn("_first", first).select(*lines.columns, F.when(F.col("_pipe") & (F.col("line") >= F.col("_first")), F.col("_first")).alias("island"))


def check_tables(islands: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, island, last, rows, malformed, caption for each table of table_islands()."""
    order = W.partitionBy(key).orderBy("line")
    near = islands.withColumn("_before", F.lag("l").over(order)).withColumn("_after", F.lead("l").over(order)).where("island is not null")
    row = ~F.col("l").rlike(T.TABLE_RULE)
    near = near.withColumn("_row", row).withColumn("_pipes", F.char_length("l") - F.char_length(F.replace("l", F.lit("|"), F.lit(""))))
    cells = F.split("l", r"\|", -1)
    near = near.withColumn("_cells", F.size(cells)).withColumn("_filled", F.size(F.filter(cells, lambda c: T.strip(c) != "")))
    by_width = near.groupBy(key, "island", F.when(F.col("_row"), F.col("_pipes")).alias("_w")).agg(
        F.count("*").alias("_n"), F.sum(F.when(F.col("_row"), F.col("_cells"))).alias("_c"), F.sum(F.when(F.col("_row"), F.col("_filled"))).alias("_f"), F.max("line").alias("last"),
        F.max(F.when(F.col("line") == F.col("island"), F.col("_before"))).alias("_b"), F.max(F.struct("line", F.col("_after").alias("a"))).alias("_a"),
    )
    table = by_width.groupBy(key, "island").agg(
        F.coalesce(F.sum(F.when(F.col("_w").isNotNull(), F.col("_n"))), F.lit(0)).alias("rows"), F.max(F.when(F.col("_w").isNotNull(), F.col("_n"))).alias("_modal"),
        F.sum("_c").alias("_c"), F.sum("_f").alias("_f"), F.max("last").alias("last"), F.max("_b").alias("_b"), F.max("_a").alias("_a"),
    )
    malformed = (F.col("rows") > MOST_ROWS) | ((F.col("rows") > 0) & ((F.col("_modal") / F.col("rows") < LEAST_CONSISTENT) | (F.col("_f") / F.col("_c") < LEAST_FILLED)))
    before, after = T.strip(F.col("_b")), T.strip(F.col("_a.a"))
    caption = F.when(T.is_caption(before), before).when(T.is_caption(after), after)
    return table.select(key, "island", "last", "rows", F.coalesce(malformed, F.lit(False)).alias("malformed"), F.coalesce(F.substring(caption, 1, T.CAPTION_LENGTH), F.lit("")).alias("caption"))


def clean_tables(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text: malformed tables replaced by a placeholder with the caption from next to them.

    Only the lines of texts with a pipe are looked at one by one; texts themselves stay in their rows and are cut there.
    """
    piped = docs.where(F.contains(F.col(text), F.lit("|")))
    bad = check_tables(table_islands(lines_of(piped, key=key, text=text), key=key), key=key).where("malformed")
    mark = F.concat(F.lit("[TABLE"), F.when(F.col("caption") != "", F.concat(F.lit(": "), "caption")).otherwise(F.lit("")), F.lit("]\n"))
    spans = bad.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("island", "last", mark.alias("mark")))).alias("_spans"))
    # the spans of few texts are sent to the texts; of very many, both are sorted
    joined = docs.select(key, F.col(text).alias("_text")).join(small(Scratch(docs.sparkSession, "tables").save(spans, "spans"), 100_000), key, "left")
    n = F.size("_spans")

    def between(z: Column) -> Column:
        """The lines after table k - 1 and before table k, then the placeholder of table k."""
        k, lines = z["k"], z["lines"]
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get("_spans", k - 1)["last"] + 1)
        end = F.when(k == n, F.size(lines)).otherwise(F.get("_spans", k)["island"])
        return F.concat(F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0))), F.filter(F.array(F.get("_spans", k)["mark"]), lambda x: x.isNotNull()))

    # the lines go along with each place: what else stands inside a lambda is evaluated for every element
    places = F.arrays_zip(F.sequence(F.lit(0), n).alias("k"), F.array_repeat(whole_lines(F.col("_text")), n + 1).alias("lines"))
    joined = joined.withColumn("_cut", F.when(n > 0, F.flatten(F.transform(places, between))))
    return joined.select(key, F.coalesce(F.array_join("_cut", ""), "_text").alias("text"))
