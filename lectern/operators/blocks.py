"""Ordered content blocks rendered as Markdown, with figures numbered as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

# Kinds of blocks that are page furniture.
FURNITURE = ("header", "footer", "page_number", "page_footnote", "discarded")
BLOCK = (
    "doc_id long, ord int, type string, text string, text_level int, page_idx int, img_path string, "
    "image_caption array<string>, chart_caption array<string>, table_caption array<string>, table_body string, has_crop boolean"
)


def rendered_blocks(blocks: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, ord, page, figure_id, caption, part: what each block (schema BLOCK) adds to the text; blocks that add nothing are left out.

    Images and charts need a caption and a crop, and become figures; a table becomes one if it has both, and
    its cells always stay. Figures are numbered from 0 in order, per document.
    """
    # dealt by document before the work on texts, so that a corpus of few input splits is rendered by as many tasks as there are
    kept = blocks.where(~F.coalesce(F.col("type"), F.lit("text")).isin(*FURNITURE)).repartition(key)
    picture = F.col("type").isin("image", "chart")
    caption = F.when(F.col("type") == "chart", T.join_caption(F.col("chart_caption"))).when(F.col("type") == "image", T.join_caption(F.col("image_caption"))).when(F.col("type") == "table", T.join_caption(F.col("table_caption"))).otherwise(F.lit(""))
    kept = kept.withColumn("caption", caption)
    is_figure = F.col("type").isin("image", "chart", "table") & (F.col("caption") != "") & F.coalesce("has_crop", F.col("img_path").isNotNull()) & (F.coalesce("img_path", F.lit("")) != "")
    # texts and cells are made below the window, through which no filter is pushed that would make them again
    cells = T.table_markdown(F.when(F.col("type") == "table", F.col("table_body")))
    kept = kept.withColumns({"_figure": F.coalesce(is_figure, F.lit(False)), "_cells": cells, "_text": T.strip(F.coalesce("text", F.lit("")))})
    number = F.sum(F.col("_figure").cast("long")).over(W.partitionBy(key).orderBy("ord")) - 1
    kept = kept.withColumn("figure_id", F.when(F.col("_figure"), number))
    tagged = F.concat("caption", F.lit(" [FIGURE_ID: "), F.col("figure_id").cast("string"), F.lit("]"))
    text = F.col("_text")
    head = F.when(F.col("_figure"), tagged).otherwise(F.nullif("caption", F.lit("")))
    part = (
        F.when(picture, F.when(F.col("_figure"), tagged))
        .when(F.col("type") == "table", F.nullif(F.concat_ws("\n\n", head, F.nullif("_cells", F.lit(""))), F.lit("")))
        .when(F.col("type") == "equation", F.when(text != "", T.wrap_latex(text)))
        .otherwise(F.when(text != "", T.heading_line(F.col("text_level"), text)))
    )
    return kept.select(key, "ord", (F.coalesce("page_idx", F.lit(0)) + 1).alias("page"), "figure_id", "caption", part.alias("part")).where("part is not null")


def markdown(parts: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, text: the parts of each document in order, blank lines between."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), "\n\n")
    return parts.groupBy(key).agg(body.alias("text"))


def figures(parts: DataFrame, *, key: str = "doc_id") -> DataFrame:
    return parts.where("figure_id is not null").select(key, "figure_id", "caption", "page")


# Tags that begin or end a block; all others are inside one.
BLOCK_TAGS = "address|article|aside|blockquote|body|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"


def html_blocks(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, ord, type, text: headings and paragraphs of web pages, whole; scripts, styles and comments are left out.

    A heading or paragraph ends at the next tag of a block, or with the page; tags inside it go, a line break becomes a
    space, character references are resolved. Empty ones are left out; null pages have none.
    """
    body = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)\s*>|<!--.*?-->", "")
    blocks = F.regexp_extract_all(body, F.lit(rf"(?is)(<(?:h1|p)(?=[\s>/])[^>]*>.*?)(?=</?(?:{BLOCK_TAGS})(?=[\s>/])|\z)"), 1)
    found = pages.select(key, F.posexplode(blocks).alias("ord", "m"))
    text = F.regexp_replace(F.regexp_replace("m", r"(?i)(?<=.)<br\b[^>]*>", " "), r"<[^>]*>", "")
    for mark, char in T.ENTITIES:
        text = F.replace(text, F.lit(mark), F.lit(char))
    kind = F.when(F.lower(F.substring("m", 1, 3)) == "<h1", "title").otherwise("text")
    return found.select(key, F.col("ord").cast("long").alias("ord"), kind.alias("type"), T.strip(F.regexp_replace(text, r"(?U)\s+", " ")).alias("text")).where("text != ''")
