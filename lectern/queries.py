"""Registered queries over the driver's tables, each next to the SQL that says the same for DuckDB.

The tables stand in for relations that they don't hold: markdown is built from documents, figures and slides
are line items, outlines are events. What is built, is built alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import images
from lectern.functions import text as T
from lectern.operators import blocks, chunking, cost, figures, geometry, library, reviews, sections, tables, validation
from lectern.plans import decks, estimate
from lectern.session import table
from lectern.sources import readers, registry, writers
from lectern.storage import Scratch
from lectern.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- chunks, tokens, cost


def _chunks_sql(size: int, overlap: int) -> str:
    return f"""
WITH cut AS (
  SELECT doc_id, p, regexp_replace(regexp_replace(substr(text, CAST(p AS BIGINT) + 1, {size}), '^\\s+', ''), '\\s+$', '') AS chunk
  FROM documents, unnest(CASE WHEN length(text) <= {size} THEN [0] ELSE range(0, length(text), {size - overlap}) END) AS t(p)
  WHERE length(text) > {size}
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= {size} AND regexp_matches(text, '\\S'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS chunk_idx,
       CAST(length(chunk) AS BIGINT) AS n_chars, md5(chunk) AS chunk_md5
FROM cut WHERE chunk <> ''"""


def _chunked(spark, d, size, overlap):
    out = chunking.chunk_chars(table(spark, d, "documents"), size, overlap)
    return out.select("doc_id", "chunk_idx", F.char_length("chunk").cast("long").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query(_chunks_sql(8000, 1500))
def chunk_chars_8000(spark, d):
    return _chunked(spark, d, 8000, 1500)


@query(_chunks_sql(1000, 200))
def chunk_chars_1000(spark, d):
    return _chunked(spark, d, 1000, 200)


@query(
    """WITH RECURSIVE t AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) AS x FROM documents),
w(doc_id, x, p, beg, fin) AS (
  SELECT doc_id, x, -1, 0, 0 FROM t WHERE length(x) > 300
  UNION ALL
  SELECT doc_id, x, p + 1, a, CASE WHEN a + 300 < length(x) AND strpos(reverse(substr(x, a + 1, 300)), chr(10) || chr(10)) > 0 THEN a + 300 - strpos(reverse(substr(x, a + 1, 300)), chr(10) || chr(10)) - 1 ELSE a + 300 END
  FROM (SELECT *, CASE WHEN p < 0 THEN 0 ELSE greatest(fin - 60, beg + 1) END AS a FROM w) WHERE a < length(x)),
c AS (
  SELECT doc_id, p, regexp_replace(substr(x, CAST(beg AS BIGINT) + 1, CAST(fin - beg AS BIGINT)), '^\\s+|\\s+$', '', 'g') AS chunk FROM w WHERE p >= 0
  UNION ALL SELECT doc_id, 0, x FROM t WHERE length(x) <= 300 AND regexp_matches(x, '\\S'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS chunk_idx, md5(chunk) AS chunk_md5 FROM c WHERE chunk <> ''"""
)
def chunk_blank_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return chunking.chunk_chars(docs, 300, 60).select("doc_id", "chunk_idx", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


_SIZES = f"WITH chunks AS ({_chunks_sql(8000, 1500)})"


@query(f"{_SIZES} SELECT doc_id, CAST(sum(n_chars) AS BIGINT) AS total_chars FROM chunks GROUP BY doc_id")
def char_count(spark, d):
    return cost.chunk_tokens(chunking.chunk_chars(table(spark, d, "documents"), 8000, 1500), "doc_id").select("doc_id", "total_chars")


@query(f"{_SIZES} SELECT doc_id, count(*) AS chunks, CAST(sum(n_chars // 4) AS BIGINT) AS input_tokens FROM chunks GROUP BY doc_id")
def token_estimate(spark, d):
    return cost.chunk_tokens(chunking.chunk_chars(table(spark, d, "documents"), 8000, 1500), "doc_id").select("doc_id", "chunks", "input_tokens")


#: A provider and model for each source: known ones, a wildcard, and one without a price.
_MODELS = [("src0", "anthropic", "claude-sonnet-4-20250514"), ("src1", "openai", "gpt-4o"), ("src2", "ollama", "anything"), ("src3", "google", "gemini-3-flash-preview"), ("src4", "groq", "unlisted")]
_VALUES = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


@query(
    f"""{_SIZES},
m(source, provider, model) AS (VALUES {_VALUES(_MODELS)}), p(provider, model, i, o) AS (VALUES {_VALUES(cost.PRICES)}),
t AS (SELECT doc_id, count(*) AS chunks, sum(n_chars // 4) AS tokens FROM chunks GROUP BY doc_id),
u AS (SELECT d.source, count(*) AS documents, coalesce(sum(t.chunks), 0) AS chunks, coalesce(sum(t.tokens), 0) AS input_tokens, count(*) * 3750 AS output_tokens
      FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.source)
SELECT u.source, m.provider, m.model, u.documents, CAST(u.chunks AS BIGINT) AS chunks, CAST(u.input_tokens AS BIGINT) AS input_tokens, CAST(u.output_tokens AS BIGINT) AS output_tokens,
       round(CAST(u.input_tokens / 1e6 * coalesce(p.i, w.i, 0.0) + u.output_tokens / 1e6 * coalesce(p.o, w.o, 0.0) AS DOUBLE), 6) AS cost,
       coalesce(p.i, w.i) IS NOT NULL AS price_known
FROM u JOIN m USING (source) LEFT JOIN p ON p.provider = m.provider AND p.model = m.model LEFT JOIN p w ON w.provider = m.provider AND w.model = '*'"""
)
def cost_by_source(spark, d):
    models = spark.createDataFrame(_MODELS, "source string, provider string, model string")
    return estimate.estimated(table(spark, d, "documents"), models).withColumn("cost", F.round("cost", 6))


_LINES = "length(text) - length(replace(text, chr(10), '')) + 1"


@query(f"SELECT doc_id, CAST({_LINES} AS BIGINT) AS chapters, CAST(n_chars AS BIGINT) AS total_chars, CASE WHEN {_LINES} > 3 AND n_chars > 4000 THEN 'multi' ELSE 'single' END AS mode FROM documents")
def route_mode(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("chapters"), F.col("n_chars").cast("long").alias("total_chars"))
    return sections.routed(docs, most_chapters=3, most_chars=4000)


# ---------------------------------------------------------------- identity


@query("SELECT doc_id, left(sha256(text), 8) AS doc_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", library.content_hash(F.col("text").cast("binary")).alias("doc_hash"))


@query(
    """WITH o AS (SELECT doc_id, left(sha256(text), 8) AS doc_hash, n_chars FROM documents)
SELECT doc_id, doc_hash FROM (SELECT *, row_number() OVER (PARTITION BY doc_hash ORDER BY doc_id DESC) AS r FROM o) WHERE r = 1"""
)
def dedup_overwrite(spark, d):
    made = table(spark, d, "documents").select("doc_id", library.content_hash(F.col("text").cast("binary")).alias("doc_hash"))
    outputs = made.select("doc_id", F.col("doc_id").alias("file"), "doc_hash", F.col("doc_id").alias("generated_at"), F.lit(False).alias("archived"))
    return made.join(library.stale_outputs(outputs).select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, left(sha256(sha256(text) || 'gpt-4o' || '8000' || '1500' || 'text'), 16) AS run_key FROM documents")
def run_key(spark, d):
    h = F.sha2(F.col("text").cast("binary"), 256)
    return table(spark, d, "documents").select("doc_id", library.run_key(h, "gpt-4o", 8000, 1500, "text").alias("run_key"))


# ---------------------------------------------------------------- markdown

_MD = "source || chr(10) || '# ' || lang || chr(10) || replace(text, chr(10), chr(10) || '## ')"


def _markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("\n# "), "lang", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## "))).alias("text"))


def _sections_sql(text: str) -> str:
    return f"""
l AS (SELECT doc_id, p, x[p] AS l, p = len(x) AS last FROM (SELECT doc_id, string_split({text}, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(p)),
h AS (SELECT *, regexp_matches(l, '^#{{1,2}}\\s') OR (regexp_matches(l, '^#{{1,2}}$') AND NOT last) AS head FROM l),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS section FROM h),
g AS (SELECT doc_id, CAST(section AS BIGINT) AS section, max(l) FILTER (WHERE head) AS heading, coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (WHERE NOT head), '') AS body FROM s GROUP BY 1, 2),
cut AS (
  SELECT doc_id, section, CASE WHEN regexp_matches(body, '\\S') THEN heading ELSE regexp_replace(heading, '\\s+$', '') END AS heading,
         CASE WHEN section = 0 THEN regexp_replace(body, '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(body, '\\s+$', '') END AS body FROM g)"""


_SECTIONS = _sections_sql(_MD)


@query(f"WITH {_SECTIONS} SELECT doc_id, section, heading, md5(body) AS body_md5 FROM cut WHERE heading IS NOT NULL OR body <> ''")
def heading_sections(spark, d):
    return chunking.sections(_markdown(spark, d)).select("doc_id", "section", "heading", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def _section_chunks_sql(size: int, overlap: int) -> str:
    """c: doc_id, section, heading, part, chunk, after _sections_sql()."""
    return f"""
f AS (SELECT *, regexp_replace(CASE WHEN heading IS NULL THEN body ELSE heading || chr(10) || body END, '^\\s+|\\s+$', '', 'g') AS whole, coalesce(length(heading), 0) AS hl FROM cut WHERE heading IS NOT NULL OR body <> ''),
c AS (
  SELECT doc_id, section, heading, 0 AS part, whole AS chunk FROM f WHERE length(whole) <= {size} AND whole <> ''
  UNION ALL
  SELECT doc_id, section, heading, p, regexp_replace(coalesce(heading || chr(10), '') || regexp_replace(substr(body, CAST(p AS BIGINT) + 1, {size} - hl - 1), '^\\s+|\\s+$', '', 'g'), '^\\s+|\\s+$', '', 'g')
  FROM f, unnest(CASE WHEN length(body) <= {size} - hl - 1 THEN [0] ELSE range(0, length(body), {size} - hl - 1 - {overlap}) END) AS t(p)
  WHERE length(whole) > {size} AND regexp_matches(substr(body, CAST(p AS BIGINT) + 1, {size} - hl - 1), '\\S'))"""


@query(f"WITH {_SECTIONS}, {_section_chunks_sql(500, 100)} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1 AS chunk_idx, md5(chunk) AS chunk_md5 FROM c")
def section_split(spark, d):
    return chunking.chunk_sections(_markdown(spark, d), 500, 100).select("doc_id", "chunk_idx", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


# cut at every tag of a block, where the operator looks for blocks as wholes
_BLOCKS = """
c AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gsi'),
        '</?(article|blockquote|body|div|footer|h[2-6]|head|header|html|li|nav|ol|section|table|title|ul|td|tr)(\\s[^>]*)?>|</(p|h1)>', chr(1) || 'x', 'gi'), '<(p|h1)(\\s[^>]*)?>', chr(1) || '\\1', 'gi'), chr(1)) AS x FROM pages),
b AS (SELECT page_id, p, x[p] AS m FROM c, unnest(range(1, len(x) + 1)) AS t(p) WHERE x[p][1] IN ('p', 'P', 'h', 'H')),
k AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS ord, CASE WHEN lower(m[1]) = 'h' THEN 'title' ELSE 'text' END AS type,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(CASE WHEN lower(m[1]) = 'h' THEN substr(m, 3) ELSE substr(m, 2) END, '<br[^>]*>', ' ', 'gi'), '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM b)"""


@query(f"WITH {_BLOCKS} SELECT page_id, CAST(ord AS BIGINT) AS ord, type, text FROM k WHERE text <> ''")
def page_blocks(spark, d):
    return blocks.html_blocks(table(spark, d, "pages"))


@query(f"WITH {_BLOCKS} SELECT page_id, md5(string_agg(CASE type WHEN 'title' THEN '# ' ELSE '' END || text, chr(10) || chr(10) ORDER BY ord)) AS markdown_md5 FROM k WHERE text <> '' GROUP BY page_id")
def page_markdown(spark, d):
    found = blocks.html_blocks(table(spark, d, "pages"))
    parts = found.select("page_id", "ord", T.heading_line(F.when(F.col("type") == "title", 1), F.col("text")).alias("part"))
    return blocks.markdown(parts, key="page_id").select("page_id", F.md5(F.col("text").cast("binary")).alias("markdown_md5"))


_CELLS = "'<table><tr><th>' || p_type || '</th><th>size</th></tr><tr><td> ' || p_brand || '|x</td></tr><tr></tr><tr><td colspan=2>' || p_size || ' <b>&amp;</b></td></tr></table>'"
_PART_BLOCKS = f"""
array(
  named_struct('type', 'text', 'text', p_name, 'text_level', nullif(p_size % 9, 0), 'img_path', null, 'image_caption', null, 'table_caption', null, 'table_body', null),
  named_struct('type', 'equation', 'text', if(p_partkey % 2 = 0, concat('$', p_type, '$'), p_type), 'text_level', null, 'img_path', null, 'image_caption', null, 'table_caption', null, 'table_body', null),
  named_struct('type', 'image', 'text', null, 'text_level', null, 'img_path', if(p_partkey % 3 != 0, 'i.png', null), 'image_caption', array('Figure ' || p_size || ':', ' ' || p_name || ' '), 'table_caption', null, 'table_body', null),
  named_struct('type', 'table', 'text', null, 'text_level', null, 'img_path', if(p_partkey % 4 < 2, 't.png', null), 'image_caption', null, 'table_caption', array(p_brand), 'table_body', {_CELLS}),
  named_struct('type', 'header', 'text', 'Page', 'text_level', null, 'img_path', null, 'image_caption', null, 'table_caption', null, 'table_body', null))"""


@query(
    """WITH b AS (
  SELECT p_partkey AS doc_id, 0 AS ord, CASE WHEN p_size % 9 = 0 THEN p_name ELSE repeat('#', least(p_size % 9, 6)) || ' ' || p_name END AS part FROM part
  UNION ALL SELECT p_partkey, 1, CASE WHEN p_partkey % 2 = 0 THEN '$' || p_type || '$' ELSE '$$' || chr(10) || p_type || chr(10) || '$$' END FROM part
  UNION ALL SELECT p_partkey, 2, 'Figure ' || p_size || ': ' || p_name || ' [FIGURE_ID: 0]' FROM part WHERE p_partkey % 3 <> 0
  UNION ALL SELECT p_partkey, 3, p_brand || CASE WHEN p_partkey % 4 < 2 THEN ' [FIGURE_ID: ' || CASE WHEN p_partkey % 3 <> 0 THEN 1 ELSE 0 END || ']' ELSE '' END || chr(10) || chr(10) ||
         concat_ws(chr(10), '| ' || p_type || ' | size |', '| --- | --- |', '| ' || p_brand || '\\|x |  |', '| ' || p_size || ' & |  |') FROM part)
SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY ord) AS text FROM b GROUP BY 1"""
)
def block_markdown(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.expr(_PART_BLOCKS)).alias("ord", "b"))
    rows = rows.select("doc_id", "ord", "b.*").withColumns({"page_idx": F.lit(0), "chart_caption": F.lit(None).cast("array<string>"), "has_crop": F.col("img_path").isNotNull()})
    return blocks.markdown(blocks.rendered_blocks(rows))


#: Documents of which every six lines begin with a caption and three table rows, even in every other document; each seventh is one table.
_TABLE_SQL = """
raw AS (SELECT doc_id, p - 1 AS i, x[p] AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS u(p)),
t AS (SELECT doc_id, string_agg(CASE
    WHEN doc_id % 7 = 0 OR i % 6 IN (1, 2, 3) THEN CASE WHEN doc_id % 2 = 0 THEN '| ' || left(l, 5) || ' | ' || length(l) || ' |' ELSE '| ' || replace(left(l, 40), ' ', ' | ') || ' |' END
    WHEN i % 6 = 0 AND doc_id % 3 <> 0 THEN 'Table ' || i || ': ' || left(l, 20) ELSE l END, chr(10) ORDER BY i) || CASE WHEN doc_id % 2 = 1 THEN chr(10) ELSE '' END AS text FROM raw GROUP BY doc_id)"""
_ISLANDS = f"""{_TABLE_SQL},
l AS (SELECT doc_id, p - 1 AS line, x[p] AS l FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS x FROM t), unnest(range(1, len(x) + 1)) AS u(p)),
r AS (SELECT *, sum(CASE WHEN contains(l, '|') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS run, contains(l, '|') AS pipe FROM l),
i AS (SELECT doc_id, line, l, CASE WHEN pipe AND line >= f THEN f END AS island FROM (
  SELECT *, min(CASE WHEN pipe AND regexp_matches(trim(l), '^\\||\\|$') THEN line END) OVER (PARTITION BY doc_id, run) AS f FROM r))"""


def _tables(spark, d):
    def line(l, i):
        row = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("| "), F.substring(l, 1, 5), F.lit(" | "), F.char_length(l).cast("string"), F.lit(" |"))).otherwise(F.concat(F.lit("| "), F.replace(F.substring(l, 1, 40), F.lit(" "), F.lit(" | ")), F.lit(" |")))
        caption = F.concat(F.lit("Table "), i.cast("string"), F.lit(": "), F.substring(l, 1, 20))
        return F.when((F.col("doc_id") % 7 == 0) | (i % 6).isin(1, 2, 3), row).when((i % 6 == 0) & (F.col("doc_id") % 3 != 0), caption).otherwise(l)

    end = F.when(F.col("doc_id") % 2 == 1, "\n").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat(F.array_join(F.transform(F.split("text", "\n", -1), line), "\n"), end).alias("text"))


@query(f"WITH {_ISLANDS} SELECT doc_id, CAST(line AS INTEGER) AS line, l, CAST(island AS INTEGER) AS island FROM i")
def table_islands(spark, d):
    return tables.table_islands(tables.lines_of(_tables(spark, d))).drop("eol")


_CHECKED = f"""{_ISLANDS},
n AS (SELECT *, lag(l) OVER w AS b, lead(l) OVER w AS a, NOT regexp_matches(l, '^\\s*\\|[\\s\\-:|]+\\|\\s*$') AS is_row, length(l) - length(replace(l, '|', '')) AS pipes,
        len(string_split(l, '|')) AS cells, len(list_filter(string_split(l, '|'), lambda c: trim(c) <> '')) AS filled FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
q AS (SELECT doc_id, island, pipes, count(*) AS n FROM n WHERE island IS NOT NULL AND is_row GROUP BY ALL),
g AS (SELECT doc_id, island, max(line) AS last, count(*) FILTER (WHERE is_row) AS rows, sum(filled) FILTER (WHERE is_row) AS f, sum(cells) FILTER (WHERE is_row) AS c,
        max(b) FILTER (WHERE line = island) AS b, arg_max(a, line) AS a0 FROM n WHERE island IS NOT NULL GROUP BY ALL),
z AS (SELECT g.*, (SELECT max(n) FROM q WHERE q.doc_id = g.doc_id AND q.island = g.island) AS modal, (SELECT l FROM n WHERE n.doc_id = g.doc_id AND n.line = g.last + 1) AS a FROM g),
checked AS (SELECT doc_id, CAST(island AS INTEGER) AS island, CAST(last AS INTEGER) AS last, rows, coalesce(rows > 70 OR (rows > 0 AND (modal / rows < 0.8 OR f / c < 0.2)), false) AS malformed,
       coalesce(left(CASE WHEN regexp_matches(trim(b), '(?i)^(fig\\.?|figure|chart|table)\\b') THEN trim(b) WHEN regexp_matches(trim(a), '(?i)^(fig\\.?|figure|chart|table)\\b') THEN trim(a) END, 120), '') AS caption FROM z)"""


@query(f"WITH {_CHECKED} SELECT * FROM checked")
def table_check(spark, d):
    return tables.check_tables(tables.table_islands(tables.lines_of(_tables(spark, d))))


@query(
    f"""WITH {_CHECKED},
w AS (SELECT i.doc_id, i.line, i.l, i.island, coalesce(c.malformed, false) AS bad, c.caption, i.line = max(i.line) OVER (PARTITION BY i.doc_id) AS last
      FROM i LEFT JOIN checked c ON c.doc_id = i.doc_id AND c.island = i.island)
SELECT t.doc_id, md5(string_agg(CASE WHEN bad AND line = w.island THEN '[TABLE' || CASE WHEN caption <> '' THEN ': ' || caption ELSE '' END || ']' || chr(10) WHEN bad THEN ''
       ELSE l || CASE WHEN last AND NOT t.text LIKE '%' || chr(10) THEN '' ELSE chr(10) END END, '' ORDER BY line)) AS text_md5
FROM t JOIN w USING (doc_id) GROUP BY t.doc_id"""
)
def table_clean(spark, d):
    return tables.clean_tables(_tables(spark, d)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# ---------------------------------------------------------------- slugs and stamps


@query("SELECT p_partkey, left(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ': ' || p_brand || ' / ' || p_type), '[^\\w\\s-]', '', 'g'), '[-\\s]+', '_', 'g'), '^_+|_+$', '', 'g'), 80) AS slug FROM part")
def slug_ascii(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug_ascii(F.concat("p_name", F.lit(": "), "p_brand", F.lit(" / "), "p_type")).alias("slug"))


@query(
    """WITH a AS (SELECT doc_id, regexp_replace(lower(regexp_replace(strip_accents(string_split(text, chr(10))[1]), '[^\\x00-\\x7F]', '', 'g')), '[^\\w\\s-]', '', 'g') AS s FROM documents)
SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(s, '[-\\s]+', '_', 'g'), '^_+|_+$', '', 'g'), 80), ''), 'untitled_document') AS slug FROM a"""
)
def slug_unicode(spark, d):
    # a title is one line: the first of each text
    return table(spark, d, "documents").select("doc_id", T.output_slug(F.regexp_extract("text", r"^([^\n]*)", 1)).alias("slug"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%S') AS stamp, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM orders")
def stamp(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.stamp(F.col("o_orderdate")).alias("stamp"), T.iso(F.col("o_orderdate")).alias("iso"))


@query("SELECT p_partkey, 'data:image/' || CASE WHEN p_partkey % 2 = 0 THEN 'jpeg' ELSE 'png' END || ';base64,' || to_base64(encode(p_name)) AS uri FROM part")
def data_uri(spark, d):
    path = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".JPG").otherwise(".png"))
    return table(spark, d, "part").select("p_partkey", T.data_uri(path, F.col("p_name").cast("binary")).alias("uri"))


# ---------------------------------------------------------------- figures

_CAPTION = "CASE p_partkey % 4 WHEN 0 THEN 'Figure  ' WHEN 1 THEN 'Fig. ' WHEN 2 THEN 'table ' ELSE 'See figure ' END || p_size || ': ' || p_name"


def _captioned(spark, d):
    word = F.element_at(F.array(F.lit("Figure  "), F.lit("Fig. "), F.lit("table "), F.lit("See figure ")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").withColumn("caption", F.concat(word, F.col("p_size").cast("string"), F.lit(": "), "p_name"))


@query("SELECT p_partkey, CAST([p_partkey, p_size] AS BIGINT[]) AS figure_ids FROM part")
def figure_tags(spark, d):
    text = F.concat("p_name", F.lit(" [FIGURE_ID: "), F.col("p_partkey").cast("string"), F.lit("] and [FIGURE_ID:"), F.col("p_size").cast("string"), F.lit("] [FIGURE_ID: x]"))
    return table(spark, d, "part").select("p_partkey", T.figure_tags(text).alias("figure_ids"))


@query(f"SELECT p_partkey, caption, regexp_matches(caption, '(?i)^(fig\\.?|figure|chart|table)\\b') AS is_caption, nullif(lower(regexp_replace(trim(regexp_extract(caption, '(?i)^((?:fig\\.?\\s*|figure\\s*|chart\\s*|table\\s*)\\d+)', 1)), '\\s+', ' ', 'g')), '') AS caption_key FROM (SELECT p_partkey, {_CAPTION} AS caption FROM part)")
def caption_scan(spark, d):
    return _captioned(spark, d).select("p_partkey", "caption", T.is_caption(F.col("caption")).alias("is_caption"), T.caption_key(F.col("caption")).alias("caption_key"))


_INJECT_TEXT = "concat_ws('\n', 'See Figure ' || p_size || ' first.', '**Figure  ' || p_size || '** ' || p_name, 'Figure ' || p_size || ' again', 'Table ' || p_partkey || '. T', 'TABLE  ' || p_partkey || ' twice', 'Figure ' || p_size || '0 not')"
_INJECT_CAPTIONS = "['Figure ' || p_size || ': x', 'table ' || p_partkey, 'Chart 9', CASE WHEN p_partkey % 5 = 0 THEN 'figure   ' || p_size || ' too' ELSE 'no keyword 1' END]"
_KEY_SQL = "lower(regexp_replace(trim(regexp_extract({}, '(?i)^\\*{{0,2}}((?:fig\\.?\\s*|figure\\s*|chart\\s*|table\\s*)\\d+)\\b', 1)), '\\s+', ' ', 'g'))"


@query(
    f"""WITH d AS (SELECT p_partkey AS doc_id, string_split({_INJECT_TEXT.replace("'" + chr(92) + "n'", 'chr(10)')}, chr(10)) AS x, {_INJECT_CAPTIONS} AS c FROM part),
l AS (SELECT doc_id, p, x[p] AS l, {_KEY_SQL.format("x[p]")} AS k FROM d, unnest(range(1, len(x) + 1)) AS t(p)),
f AS (SELECT doc_id, p - 1 AS id, {_KEY_SQL.format("c[p]")} AS k FROM d, unnest(range(1, len(c) + 1)) AS t(p)),
g AS (SELECT doc_id, k, string_agg(' [FIGURE_ID: ' || id || ']', '' ORDER BY id) AS tags FROM f WHERE k <> '' GROUP BY 1, 2),
n AS (SELECT doc_id, k, min(p) AS p FROM l WHERE k <> '' GROUP BY 1, 2)
SELECT l.doc_id, string_agg(l || coalesce(tags, ''), chr(10) ORDER BY l.p) AS text
FROM l LEFT JOIN n ON n.doc_id = l.doc_id AND n.p = l.p LEFT JOIN g ON g.doc_id = n.doc_id AND g.k = n.k GROUP BY 1"""
)
def figure_inject(spark, d):
    part = table(spark, d, "part")
    captions = F.expr(_INJECT_CAPTIONS.replace("[", "array(", 1).replace("]", ")"))
    return figures.inject_figure_ids(part.select(F.col("p_partkey").alias("doc_id"), F.expr(_INJECT_TEXT).alias("text")), part.select(F.col("p_partkey").alias("doc_id"), F.posexplode(captions).alias("figure_id", "caption")))


_CATALOG = """
use AS (SELECT l_suppkey AS doc_id, CAST(l_linenumber AS BIGINT) AS chunk_idx, l_partkey AS figure_id, l_returnflag AS flag FROM lineitem),
captions AS (SELECT DISTINCT doc_id, figure_id, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_name END AS caption FROM use JOIN part ON p_partkey = figure_id WHERE p_size > 10),
catalog AS (
  SELECT c.doc_id, c.figure_id, c.caption, coalesce(p.purpose, 'unspecified') AS purpose, f.source_chunk
  FROM (SELECT * FROM captions WHERE trim(caption) <> '') c
  JOIN (SELECT doc_id, figure_id, min(chunk_idx) AS source_chunk FROM use GROUP BY 1, 2) f USING (doc_id, figure_id)
  LEFT JOIN (SELECT doc_id, figure_id, arg_min(flag, (chunk_idx, flag)) AS purpose FROM use WHERE flag <> 'N' GROUP BY 1, 2) p USING (doc_id, figure_id))"""


def _use(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("chunk_idx"), F.col("l_partkey").alias("figure_id"), F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("slide_index"))


def _catalog(spark, d):
    use = _use(spark, d)
    part = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("figure_id"), F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name")).alias("caption"))
    captions = use.select("doc_id", "figure_id").distinct().join(part, "figure_id").withColumn("ord", F.lit(0))
    purposes = use.where("flag <> 'N'").select("doc_id", "figure_id", F.struct("chunk_idx", "flag").alias("chunk_idx"), F.col("flag").alias("purpose"))
    return figures.figure_catalog(captions, use, purposes)


@query(f"WITH {_CATALOG} SELECT doc_id, figure_id, caption, purpose, source_chunk FROM catalog")
def figure_catalog(spark, d):
    return _catalog(spark, d)


_OWNERS = f"""{_CATALOG},
req AS (SELECT l_suppkey AS doc_id, l_orderkey AS slide_index, l_partkey AS figure_id, l_linenumber AS n FROM lineitem),
o AS (SELECT * FROM (SELECT r.doc_id, r.figure_id, r.slide_index, c.source_chunk IN (n, n + 1) AS overlap,
        row_number() OVER (PARTITION BY r.doc_id, r.figure_id ORDER BY (c.source_chunk IN (n, n + 1)) DESC, r.slide_index) AS k
      FROM req r JOIN catalog c USING (doc_id, figure_id)) WHERE k = 1)"""


def _owners(spark, d):
    requests = _use(spark, d).select("doc_id", "slide_index", "figure_id", F.array("chunk_idx", F.col("chunk_idx") + 1).alias("chunk_indices"))
    return figures.figure_owners(requests, _catalog(spark, d))


@query(f"WITH {_OWNERS} SELECT doc_id, figure_id, slide_index, overlap FROM o")
def figure_owner(spark, d):
    return _owners(spark, d)


_PLACED = "row_number() OVER (PARTITION BY doc_id, slide_index % 3 ORDER BY overlap DESC, figure_id)"


@query(f"WITH {_OWNERS} SELECT doc_id, figure_id, slide_index % 3 AS slide_index, overlap, p AS place FROM (SELECT *, {_PLACED} AS p FROM o) WHERE p <= 3")
def figure_cap3(spark, d):
    return figures.capped_figures(_owners(spark, d).withColumn("slide_index", F.col("slide_index") % 3))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def image_semi(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return figures.referenced_images(table(spark, d, "part").select("p_partkey", "p_name"), used, ["p_partkey"])


@query(f"WITH {_CATALOG} SELECT doc_id, md5(string_agg('[' || figure_id || '] (' || purpose || ', chunk ' || source_chunk || ') ' || caption, chr(10) ORDER BY figure_id)) AS catalog_md5 FROM catalog GROUP BY doc_id")
def format_catalog(spark, d):
    return figures.format_catalog(_catalog(spark, d)).select("doc_id", F.md5(F.col("catalog").cast("binary")).alias("catalog_md5"))


@query(
    f"""WITH chunks AS ({_chunks_sql(1000, 200)}),
w AS (SELECT DISTINCT s.doc_id, i AS chunk_idx FROM (SELECT DISTINCT doc_id FROM documents) s, (VALUES (2), (0), (2), (-1), (900)) AS v(i)),
x AS (SELECT w.doc_id, string_agg('[chunk ' || w.chunk_idx || '] ' || chunk_md5, chr(10) ORDER BY w.chunk_idx) AS c FROM w JOIN chunks USING (doc_id, chunk_idx) GROUP BY w.doc_id)
SELECT doc_id, coalesce(md5(c), md5('none')) AS context_md5 FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN x USING (doc_id)"""
)
def source_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id").distinct()
    slides = docs.select("doc_id", F.lit(1).alias("slide_index"), F.array(*(F.lit(i).cast("long") for i in (2, 0, 2, -1, 900))).alias("chunk_indices"))
    chunks = chunking.chunk_chars(table(spark, d, "documents"), 1000, 200).withColumn("chunk", F.md5(F.col("chunk").cast("binary")))
    got = figures.source_chunks(slides, chunks, empty="none")
    return got.select("doc_id", F.md5(F.replace(F.replace("context", F.lit("]\n"), F.lit("] ")), F.lit("\n\n"), F.lit("\n")).cast("binary")).alias("context_md5"))


# ---------------------------------------------------------------- outlines

_EVENTS = "e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS chunk_idx FROM events)"


def _numbered(spark, d):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select("user_id", "event_id", "event_type", place.cast("long").alias("chunk_idx"))


def _outline(spark, d):
    marks = _numbered(spark, d).where("event_type in ('signup', 'click')")
    return marks.select("user_id", F.col("chunk_idx").alias("ord"), F.col("chunk_idx").alias("position"), F.when(F.col("event_type") == "signup", 1).otherwise(2).alias("level"), F.concat(F.lit("chapter "), F.col("event_id").cast("string")).alias("heading"))


@query(
    f"""WITH {_EVENTS}, s AS (SELECT user_id, chunk_idx, 'chapter ' || event_id AS h FROM e WHERE event_type = 'signup')
SELECT e.user_id, e.event_id, e.chunk_idx, coalesce(s.h, f.h, 'main') AS chapter
FROM e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.chunk_idx >= s.chunk_idx
LEFT JOIN (SELECT user_id, arg_min(h, chunk_idx) AS h FROM s GROUP BY 1) f ON f.user_id = e.user_id"""
)
def chapter_asof(spark, d):
    items = _numbered(spark, d).select("user_id", "event_id", "chunk_idx")
    return sections.chapter_of(items, _outline(spark, d), key="user_id")


@query(
    f"""WITH {_EVENTS}, o AS (SELECT user_id, chunk_idx AS ord, CASE event_type WHEN 'signup' THEN 1 ELSE 2 END AS level, 'chapter ' || event_id AS h FROM e WHERE event_type IN ('signup', 'click')),
i AS (SELECT user_id, chunk_idx FROM e WHERE event_type = 'purchase'),
b AS (SELECT i.user_id, i.chunk_idx, coalesce(max(CASE WHEN o.ord <= i.chunk_idx THEN o.ord END), min(o.ord), 0) AS start FROM i LEFT JOIN o ON o.user_id = i.user_id AND o.level = 1 GROUP BY 1, 2)
SELECT b.user_id, b.chunk_idx, o.ord, o.h AS heading FROM b JOIN o ON o.user_id = b.user_id WHERE o.level = 1 OR o.ord >= b.start"""
)
def skeleton_trim(spark, d):
    items = _numbered(spark, d).where("event_type = 'purchase'").select("user_id", "chunk_idx")
    return sections.trimmed_outline(items, _outline(spark, d), key="user_id")


@query(
    f"""WITH {_EVENTS}, o AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 ELSE 2 END AS level FROM e WHERE event_type IN ('signup', 'click'))
SELECT u.user_id, left(coalesce('chapter ' || min(CASE WHEN level = 1 THEN chunk_idx END), 'chapter ' || min(chunk_idx)), 120) AS title
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN o USING (user_id) GROUP BY u.user_id"""
)
def skeleton_title(spark, d):
    toc = _outline(spark, d).withColumn("heading", F.concat(F.lit("chapter "), F.col("position").cast("string")))
    titles = table(spark, d, "events").select("user_id", F.lit(" ").alias("title")).distinct()
    return sections.skeleton(toc, titles, key="user_id")


@query("SELECT p_brand, CAST(p_size % 6 + 1 AS INTEGER) AS level, count(*) AS sections FROM part GROUP BY ALL")
def level_histogram(spark, d):
    outline = table(spark, d, "part").select("p_brand", (F.col("p_size") % 6 + 1).alias("level"))
    return sections.level_histogram(outline, key="p_brand")


@query("WITH s AS (SELECT p_brand, p_partkey, p_name, p_size, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part) SELECT p_brand, trim(left(string_agg(trim(p_name), ' ' ORDER BY p_partkey), 120)) AS title FROM s WHERE p_size >= m * 0.95 GROUP BY p_brand")
def title_pick(spark, d):
    spans = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("ord"), F.col("p_size").alias("size"), F.col("p_name").alias("text"))
    return sections.page_title(spans, key="p_brand")


@query("WITH g AS (SELECT user_id, list_sort(list(value) FILTER (WHERE value > 0)) AS v FROM events GROUP BY user_id) SELECT user_id, coalesce(v[len(v) // 2 + 1], 10.0) AS body_size FROM g")
def upper_median(spark, d):
    return sections.body_size(table(spark, d, "events"), key="user_id", value="value")


# ---------------------------------------------------------------- library

_LIB = """
decks AS (SELECT c_custkey AS k, '/' || c_name || '.json' AS file, CASE WHEN c_nationkey % 2 = 0 THEN 'single_deck' ELSE 'multi_deck' END AS type, c_nationkey AS own, c_mktsegment AS seg, c_acctbal < 0 AS archived FROM customer),
lib AS (
  SELECT d.file, d.type, CASE d.type WHEN 'single_deck' THEN d.own ELSE coalesce(x.s, 0) END AS slide_count, CASE d.type WHEN 'single_deck' THEN 1 ELSE coalesce(x.n, 0) END AS deck_count, d.archived, left(sha256(d.seg || d.own), 8) AS doc_hash, d.k
  FROM decks d LEFT JOIN (SELECT o_custkey AS k, count(*) AS n, sum(coalesce(c, 0)) AS s FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem WHERE l_quantity > 10 GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1) x USING (k))"""


def _library(spark, d):
    decks = table(spark, d, "customer").select(
        F.concat(F.lit("/"), "c_name", F.lit(".json")).alias("file"), F.when(F.col("c_nationkey") % 2 == 0, "single_deck").otherwise("multi_deck").alias("type"), F.col("c_nationkey").alias("own_slides"),
        (F.col("c_acctbal") < 0).alias("archived"), library.content_hash(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).cast("binary")).alias("doc_hash"), F.col("c_custkey"),
    )
    slides = table(spark, d, "lineitem").where("l_quantity > 10").groupBy("l_orderkey").agg(F.count("*").alias("slides"))
    chapters = table(spark, d, "orders").join(slides, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_custkey").alias("c_custkey"), "slides")
    return library.library_counts(decks, chapters, on="c_custkey")


@query(f"WITH {_LIB} SELECT file, type, CAST(slide_count AS BIGINT) AS slide_count, CAST(deck_count AS BIGINT) AS deck_count, archived FROM lib")
def library_rebuild(spark, d):
    return _library(spark, d).select("file", "type", "slide_count", "deck_count", "archived")


def _entries(df):
    return df.select(F.col("file").alias("title"), "file", "type", F.col("c_custkey").cast("string").alias("generated_at"), F.lit("p").alias("provider"), F.lit("m").alias("model"), "doc_hash", "slide_count", "deck_count", "archived")


@query(
    f"""WITH {_LIB}, new AS (SELECT file, 'single_deck' AS type, CAST(1 AS BIGINT) AS slide_count, false AS archived FROM lib WHERE k % 3 = 0 UNION ALL SELECT '/new' || k || '.json', 'single_deck', 1, false FROM lib WHERE k % 50 = 0)
SELECT file, type, CAST(slide_count AS BIGINT) AS slide_count, archived FROM lib WHERE file NOT IN (SELECT file FROM new) UNION ALL SELECT * FROM new"""
)
def library_upsert(spark, d):
    old = _library(spark, d)
    new = old.where("c_custkey % 3 = 0").unionByName(old.where("c_custkey % 50 = 0").withColumn("file", F.concat(F.lit("/new"), F.col("c_custkey").cast("string"), F.lit(".json"))))
    new = new.withColumns({"type": F.lit("single_deck"), "slide_count": F.lit(1).cast("long"), "archived": F.lit(None).cast("boolean")})
    return library.upserted(_entries(old), _entries(new)).select("file", "type", "slide_count", "archived")


@query(
    f"""WITH {_LIB}, runs AS (SELECT doc_hash, arg_max(file, k) AS keep FROM lib WHERE NOT archived AND k % 2 = 0 GROUP BY doc_hash)
SELECT file, doc_hash FROM lib WHERE archived OR doc_hash NOT IN (SELECT doc_hash FROM runs) OR file IN (SELECT keep FROM runs)"""
)
def library_prune(spark, d):
    lib = _library(spark, d)
    runs = lib.where("not archived and c_custkey % 2 = 0").groupBy("doc_hash").agg(F.max_by("file", "c_custkey").alias("keep_file"))
    return library.pruned(_entries(lib), runs).select("file", "doc_hash")


@query(f"WITH {_LIB} SELECT file, CASE WHEN k % 4 = 0 THEN true ELSE archived END AS archived FROM lib")
def library_archive(spark, d):
    lib = _library(spark, d)
    return library.archived(_entries(lib), lib.where("c_custkey % 4 = 0")).select("file", "archived")


@query(f"WITH {_LIB} SELECT k AS c_custkey, file, CAST(CASE WHEN archived THEN 409 ELSE 200 END AS INTEGER) AS status FROM lib WHERE k % 4 = 0 UNION ALL SELECT -1, '/none', 404")
def library_archive_status(spark, d):
    lib = _library(spark, d)
    asked = lib.where("c_custkey % 4 = 0").select("file").union(spark.createDataFrame([("/none",)], "file string"))
    return library.archive_status(_entries(lib), asked).join(lib.select("file", "c_custkey"), "file", "left").select(F.coalesce("c_custkey", F.lit(-1).cast("long")).alias("c_custkey"), "file", "status")


@query("SELECT o_orderkey, s || '_' || t || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS name FROM (SELECT o_orderkey, lower(o_orderstatus) AS s, strftime(o_orderdate, '%Y%m%d') AS t, row_number() OVER (PARTITION BY o_orderstatus, strftime(o_orderdate, '%Y%m%d') ORDER BY o_orderkey) AS n FROM orders)")
def unique_path(spark, d):
    made = table(spark, d, "orders").select("o_orderkey", F.lower("o_orderstatus").alias("s"), F.date_format("o_orderdate", "yyyyMMdd").alias("t"))
    return library.unique_names(made, "s", "t", "o_orderkey").select("o_orderkey", "name")


@query("SELECT o_custkey, o_orderkey, lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR), 2, '0') AS deck_no FROM orders WHERE o_orderstatus <> 'F'")
def deck_number(spark, d):
    chapters = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("chapter"), (F.col("o_orderstatus") == "F").alias("failed"))
    return library.deck_numbers(chapters, key="o_custkey").select("o_custkey", "o_orderkey", "deck_no")


# ---------------------------------------------------------------- drafting and review


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 AS batch FROM conversations")
def writer_batches(spark, d):
    return reviews.batches(table(spark, d, "conversations").select("conv_id", "turn"), 5, key=["conv_id"], order="turn")


@query(
    """WITH w AS (SELECT conv_id, turn, string_split(role, 't') AS parts, text FROM conversations),
u AS (SELECT conv_id, parts[i] AS p, min((turn, i)) AS pos FROM w, unnest(range(1, len(parts) + 1)) AS t(i) GROUP BY ALL)
SELECT c.conv_id, CAST(l.roles AS VARCHAR[]) AS roles, c.first_role FROM (SELECT conv_id, arg_min(role, turn) AS first_role FROM conversations GROUP BY 1) c JOIN (SELECT conv_id, list(p ORDER BY pos) AS roles FROM u GROUP BY 1) l USING (conv_id)"""
)
def merge_array(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.split("role", "t").alias("roles"), F.col("role").alias("first_role"))
    return reviews.merged_lists(rows, "conv_id", lists=["roles"], order="turn", scalars=["first_role"])


@query(
    """WITH r AS (SELECT o_custkey, l_orderkey, l_returnflag || l_linestatus AS k, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag || l_linestatus) AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT o_custkey, l_orderkey, k, min(o) AS o FROM r GROUP BY ALL),
f AS (SELECT o_custkey, l_orderkey, min(o) AS first FROM r GROUP BY ALL),
u AS (SELECT p.o_custkey, p.k, min((f.first, p.o)) AS pos FROM p JOIN f USING (o_custkey, l_orderkey) GROUP BY ALL)
SELECT c.o_custkey, c.parts, c.items, l.k AS key_concepts FROM (SELECT o_custkey, count(DISTINCT l_orderkey) AS parts, count(*) AS items FROM r GROUP BY 1) c JOIN (SELECT o_custkey, list(k ORDER BY pos) AS k FROM u GROUP BY 1) l USING (o_custkey)"""
)
def two_level_merge(spark, d):
    items = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    concept = F.concat("l_returnflag", "l_linestatus")
    rows = items.select("o_custkey", "l_orderkey", F.array(concept).alias("key_concepts"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", concept.alias("c")).alias("at"))
    return reviews.two_level_merge(rows, "o_custkey", "l_orderkey", lists=["key_concepts"], order="at").select("o_custkey", "parts", "items", "key_concepts")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN [] ELSE [CAST(l.quality AS BIGINT), CAST(l.toxic AS BIGINT)] END AS image_refs FROM documents d LEFT JOIN labels l USING (doc_id)")
def planned_refs(spark, d):
    draft = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("slide_index"), F.array(F.lit(999).cast("long")).alias("image_refs"))
    plan = table(spark, d, "labels").select("doc_id", F.col("doc_id").alias("slide_index"), F.array(F.col("quality").cast("long"), F.col("toxic").cast("long")).alias("figure_ids"))
    return reviews.with_planned_figures(draft, plan, key=["doc_id"]).select("doc_id", "image_refs")


def _reviews(spark, d):
    issue = F.array(F.struct(F.lit("toxic").alias("type"), F.concat(F.lit("label "), F.col("toxic").cast("string")).alias("detail")), F.struct(F.lit("quality").alias("type"), F.lit("low").alias("detail")))
    none = F.array().cast("array<struct<type:string,detail:string>>")
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("source", F.col("doc_id").alias("slide_index"), (F.col("quality") == 1).alias("passed"), F.when(F.col("doc_id") % 3 == 0, none).otherwise(issue).alias("issues"), "toxic")


@query("SELECT d.doc_id, coalesce('fixed ' || l.quality, d.lang) AS body FROM documents d LEFT JOIN labels l USING (doc_id)")
def review_merge(spark, d):
    slides = table(spark, d, "documents").select("doc_id", F.col("lang").alias("body"))
    fixes = table(spark, d, "labels").select("doc_id", F.concat(F.lit("fixed "), F.col("quality").cast("string")).alias("body"))
    return reviews.corrected(slides, fixes, key=["doc_id"], fields=["body"])


@query("SELECT source, doc_id AS slide_index FROM labels JOIN documents USING (doc_id) WHERE quality <> 1")
def failed_slides(spark, d):
    return reviews.failed(_reviews(spark, d)).select("source", "slide_index")


@query("SELECT source, bool_and(quality = 1) AS all_passed FROM labels JOIN documents USING (doc_id) GROUP BY source")
def all_passed(spark, d):
    return reviews.verdicts(_reviews(spark, d), "source")


@query("SELECT source, doc_id AS slide_index, CASE WHEN doc_id % 3 = 0 THEN 'failed without an issue' ELSE 'toxic: label ' || toxic END AS note FROM labels JOIN documents USING (doc_id) WHERE quality <> 1")
def unresolved(spark, d):
    return reviews.unresolved(_reviews(spark, d), "source")


@query("SELECT source, md5(string_agg('Slide ' || doc_id || ': ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'label ' || toxic || '; low' END, chr(10) ORDER BY doc_id)) AS critique_md5 FROM labels JOIN documents USING (doc_id) WHERE quality <> 1 GROUP BY source")
def critique_text(spark, d):
    return reviews.critiques(_reviews(spark, d), "source").select("source", F.md5(F.col("critique").cast("binary")).alias("critique_md5"))


@query("WITH f AS (SELECT l_orderkey, min(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, coalesce(l_linenumber = f, false) AS is_summary FROM lineitem JOIN f USING (l_orderkey)")
def summary_split(spark, d):
    slides = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("ord"), F.when(F.col("l_returnflag") == "R", "Summary").otherwise("Concept").alias("tag"))
    content, summary = reviews.split_summary(slides, key=["l_orderkey"])
    out = content.withColumn("is_summary", F.lit(False)).unionByName(summary.withColumn("is_summary", F.lit(True)))
    return out.select("l_orderkey", "l_linenumber", "is_summary")


@query("SELECT user_id AS job_id, event_type AS stage, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS completed, CAST(arg_max(CAST(value AS BIGINT), (ts, event_id)) AS BIGINT) AS total FROM (SELECT *, floor(value) AS v FROM events) GROUP BY ALL".replace("CAST(value AS BIGINT)", "CAST(v AS BIGINT)"))
def progress_latest(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("completed"), F.floor("value").cast("long").alias("total"), "ts", "event_id")
    return jobs.progress(events)


@query(
    """WITH m AS (SELECT user_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS length FROM m WHERE bad GROUP BY ALL"""
)
def breaker_runs(spark, d):
    return reviews.failure_runs(table(spark, d, "events"), key="user_id", order=["ts", "event_id"], bad=F.col("event_type") == "error")


# ---------------------------------------------------------------- geometry

_RECT = "l_orderkey AS doc_id, l_suppkey % 5 AS page, CAST(l_linenumber AS BIGINT) AS region_id, CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST(l_quantity * 10 AS DOUBLE) AS y0, CAST(l_partkey % 400 + 20 + l_linenumber * 10 AS DOUBLE) AS x1, CAST(l_quantity * 10 + 15 + l_linenumber * 5 AS DOUBLE) AS y1, l_discount AS confidence"


def _rects(spark, d):
    return table(spark, d, "lineitem").selectExpr(*_RECT.replace(" AS BIGINT", " as bigint").split(", "))


_PAIRS = f"""r AS (SELECT {_RECT} FROM lineitem),
pairs AS (SELECT f.doc_id, f.page, f.region_id AS figure_id, c.region_id AS caption_id, greatest(0.0, f.y0 - c.y1, c.y0 - f.y1) AS gap
  FROM r f JOIN r c ON f.doc_id = c.doc_id AND f.page = c.page AND f.region_id % 2 = 1 AND c.region_id % 2 = 0
  WHERE least(f.x1, c.x1) - greatest(f.x0, c.x0) > 0)"""


@query(f"WITH {_PAIRS} SELECT doc_id, page, figure_id, caption_id, gap FROM pairs WHERE gap <= 80")
def region_pairs(spark, d):
    r = _rects(spark, d)
    return geometry.caption_pairs(r.where("region_id % 2 = 1"), r.where("region_id % 2 = 0"))


@query(
    f"""WITH RECURSIVE {_PAIRS},
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY gap, figure_id, caption_id) AS n FROM pairs WHERE gap <= 80),
g(doc_id, page, n, fs, cs) AS (
  SELECT doc_id, page, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM k GROUP BY ALL
  UNION ALL
  SELECT g.doc_id, g.page, k.n, CASE WHEN list_contains(fs, k.figure_id) OR list_contains(cs, k.caption_id) THEN fs ELSE list_append(fs, k.figure_id) END,
         CASE WHEN list_contains(fs, k.figure_id) OR list_contains(cs, k.caption_id) THEN cs ELSE list_append(cs, k.caption_id) END
  FROM g JOIN k ON k.doc_id = g.doc_id AND k.page = g.page AND k.n = g.n + 1),
m AS (SELECT doc_id, page, unnest(fs) AS figure_id, unnest(cs) AS caption_id FROM (SELECT doc_id, page, arg_max(fs, n) AS fs, arg_max(cs, n) AS cs FROM g GROUP BY ALL))
SELECT f.doc_id, f.page, f.region_id AS figure_id, m.caption_id FROM r f LEFT JOIN m ON m.doc_id = f.doc_id AND m.page = f.page AND m.figure_id = f.region_id WHERE f.region_id % 2 = 1
UNION ALL SELECT c.doc_id, c.page, NULL, c.region_id FROM r c WHERE c.region_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = c.doc_id AND m.page = c.page AND m.caption_id = c.region_id)"""
)
def greedy_match(spark, d):
    r = _rects(spark, d)
    return geometry.paired_figures(r.where("region_id % 2 = 1"), r.where("region_id % 2 = 0"))


@query(
    f"""WITH r AS (SELECT doc_id, page, region_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT {_RECT} FROM lineitem) GROUP BY ALL)
SELECT a.doc_id, a.page, a.region_id AS a, b.region_id AS b FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.page = b.page AND a.region_id < b.region_id
AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 18 AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 18"""
)
def panel_pairs(spark, d):
    return geometry.panel_links(geometry.bounding_boxes(_rects(spark, d), "doc_id", "page", "region_id"))


@query(
    f"""WITH r AS (SELECT {_RECT} FROM lineitem), l AS (SELECT *, ['Text', 'Figure', 'Caption', 'Picture', 'Title'][region_id % 5 + 1] AS label FROM r WHERE confidence * 10 >= 0.5)
SELECT doc_id, page, region_id, label IN ('Figure', 'Picture') AS is_figure FROM l WHERE label IN ('Figure', 'Picture', 'Caption')"""
)
def region_labels(spark, d):
    labels = F.array(*(F.lit(x) for x in ("Text", "Figure", "Caption", "Picture", "Title")))
    r = _rects(spark, d).withColumn("label", F.get(labels, (F.col("region_id") % 5).cast("int"))).withColumn("confidence", F.col("confidence") * 10)
    found, captions = geometry.detected(r)
    return found.withColumn("is_figure", F.lit(True)).unionByName(captions.withColumn("is_figure", F.lit(False))).select("doc_id", "page", "region_id", "is_figure")


@query(f"SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(confidence) AS confidence FROM (SELECT {_RECT} FROM lineitem) GROUP BY ALL")
def bbox_union(spark, d):
    return geometry.bounding_boxes(_rects(spark, d), "doc_id", "page")


@query(
    f"""WITH RECURSIVE r AS (SELECT doc_id, page, region_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT {_RECT} FROM lineitem) GROUP BY ALL),
e AS (SELECT a.doc_id, a.page, a.region_id AS a, b.region_id AS b FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.page = b.page AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 18 AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 18),
t(doc_id, page, a, b) AS (SELECT doc_id, page, a, b FROM e UNION SELECT t.doc_id, t.page, t.a, e.b FROM t JOIN e ON e.doc_id = t.doc_id AND e.page = t.page AND e.a = t.b)
SELECT doc_id, page, a AS region_id, min(b) AS component FROM t GROUP BY ALL"""
)
def panel_components(spark, d):
    r = geometry.bounding_boxes(_rects(spark, d), "doc_id", "page", "region_id")
    return geometry.panel_components(r).select("doc_id", "page", "region_id", "component")


@query(f"SELECT doc_id, page, region_id, x0 * 0.75 AS x0, y0 * 0.75 AS y0, confidence FROM (SELECT {_RECT.replace('l_discount', 'CASE WHEN l_linenumber = 1 THEN 1.0 ELSE l_discount * 8 END')} FROM lineitem) WHERE confidence >= 0.5")
def region_confidence(spark, d):
    r = _rects(spark, d).withColumn("confidence", F.when(F.col("region_id") == 1, F.lit(None).cast("double")).otherwise(F.col("confidence") * 8))
    return geometry.confident(r, scale=0.75).select("doc_id", "page", "region_id", "x0", "y0", "confidence")


@query(
    f"""WITH r AS (SELECT {_RECT} FROM lineitem), b AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM r WHERE region_id > 1)
SELECT q.doc_id, q.page, q.region_id AS rect_id, string_agg('block ' || b.region_id, ' ' ORDER BY b.region_id) AS text
FROM r q JOIN b USING (doc_id, page) WHERE q.region_id = 1
AND greatest(0, least(q.x1 + 300, b.x1) - greatest(q.x0, b.x0)) * greatest(0, least(q.y1 + 100, b.y1) - greatest(q.y0, b.y0)) >= 0.5 * b.w * b.h GROUP BY ALL"""
)
def text_in_rect(spark, d):
    r = _rects(spark, d)
    rects = r.where("region_id = 1").select("doc_id", "page", F.col("region_id").alias("rect_id"), "x0", "y0", (F.col("x1") + 300).alias("x1"), (F.col("y1") + 100).alias("y1"))
    text = r.where("region_id > 1").select("doc_id", "page", F.col("region_id").alias("ord"), F.concat(F.lit("block "), F.col("region_id").cast("string")).alias("text"), "x0", "y0", "x1", "y1")
    return geometry.text_inside(rects, text)


# ---------------------------------------------------------------- rules and JSON


@query("SELECT doc_id, length(text) BETWEEN 1 AND 1200 AND lang IN ('en', 'de') AS valid, CAST(CASE WHEN length(text) BETWEEN 1 AND 1200 THEN [] ELSE ['text'] END || CASE WHEN lang IN ('en', 'de') THEN [] ELSE ['lang'] END AS VARCHAR[]) AS errors FROM documents")
def validate_rules(spark, d):
    rules = [validation.Rule("text", least=1, most=1200, measure="chars"), validation.Rule("lang", allowed=("en", "de"))]
    return validation.validated(table(spark, d, "documents"), rules).select("doc_id", "valid", "errors")


@query("SELECT event_id, props AS json FROM events")
def json_slice(spark, d):
    noisy = F.concat(F.lit("Here you are:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, d, "events").select("event_id", T.json_slice(noisy).alias("json"))


@query("SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS fields FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.array_size(F.json_object_keys("props")).alias("fields"))


# ---------------------------------------------------------------- decks with the stand-in model


def _decks(spark, d, multi: bool):
    from lectern.model.stub import Stub
    from lectern.sources.registry import settings

    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("# Part one\n"), F.regexp_replace("text", "\n", "\n# Part of ")).alias("text"))
    made = decks.decks(docs, Stub(flag=1), settings(chapters_for_multi=1 if multi else 10**9, chars_for_multi=0, chunk_size=8000, review_cycles=2))
    said = F.filter("slides", lambda x: x["tag"] != "Summary")  # whose words come from all headings
    text = F.array_join(F.transform(said, lambda x: F.concat_ws("|", x["index"].cast("string"), x["tag"], x["body"], F.array_join(x["image_refs"].cast("array<string>"), ","))), "\n")
    return made.select("doc_id", "deck_id", "mode", "title", "error", F.size("slides").alias("slides"), F.md5(text.cast("binary")).alias("slides_md5"), F.size("images").alias("images"), F.size("unresolved").alias("open"))


# What the stand-in answers: a slide for each chunk, of all chunks of its batch of five; odd lengths fail the first review and
# are refined by a stop.
_DECK_TEXT = "'# Part one' || chr(10) || replace(text, chr(10), chr(10) || '# Part of ')"
_DECKS = f"""{_sections_sql(_DECK_TEXT)}, {_section_chunks_sql(8000, 1500)},
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1 AS chunk_idx, trim(substr(heading, 2)) AS chapter, chunk FROM c)"""
_DECK_SLIDES = """
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, deck ORDER BY chunk_idx) - 1 AS at, count(*) OVER (PARTITION BY doc_id, deck) AS m FROM d),
n AS (SELECT doc_id, deck, min(chunk_idx) AS first, CAST(least(20, greatest(4, count(*) + 2)) AS INTEGER) AS slides, count(*) AS m FROM d GROUP BY 1, 2),
i AS (SELECT n.*, i, least(greatest(i - 1, 0), m - 1) AS at FROM n, unnest(range(0, slides)) AS t(i)),
b AS (SELECT DISTINCT i.doc_id, i.deck, i // 5 AS batch, o.chunk_idx, o.chunk FROM i JOIN o ON o.doc_id = i.doc_id AND o.deck = i.deck AND o.at = i.at),
x AS (SELECT doc_id, deck, batch, string_agg('[chunk ' || chunk_idx || ']' || chr(10) || chunk, chr(10) || chr(10) ORDER BY chunk_idx) AS context FROM b GROUP BY 1, 2, 3),
y AS (SELECT i.*, CASE WHEN i = 0 THEN 'Introduction' ELSE 'Key Concept' END AS tag, left((i + 1) || ': ' || context, 400) AS body FROM i JOIN x ON x.doc_id = i.doc_id AND x.deck = i.deck AND x.batch = i // 5 WHERE i < slides - 1),
z AS (SELECT doc_id, deck, min(first) AS first, min(slides) AS slides, md5(string_agg((i + 1) || '|' || tag || '|' || body || CASE WHEN length(body) % 2 = 1 THEN '.' ELSE '' END || '|', chr(10) ORDER BY i)) AS slides_md5 FROM y GROUP BY 1, 2)"""


@query(f"WITH {_DECKS}, d AS (SELECT *, 'Part one' AS deck FROM k), {_DECK_SLIDES} SELECT doc_id, CAST(0 AS BIGINT) AS deck_id, 'single' AS mode, 'Part one' AS title, CAST(NULL AS VARCHAR) AS error, slides, slides_md5, CAST(0 AS INTEGER) AS images, CAST(0 AS INTEGER) AS open FROM z")
def deck_stub_single(spark, d):
    return _decks(spark, d, False)


@query(
    f"""WITH {_DECKS},
m AS (SELECT doc_id, count(DISTINCT section) > 1 AS multi FROM cut GROUP BY doc_id),
d AS (SELECT k.*, CASE WHEN multi THEN chapter ELSE 'Part one' END AS deck, multi FROM k JOIN m USING (doc_id)), {_DECK_SLIDES}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS deck_id, CASE WHEN multi THEN 'multi' ELSE 'single' END AS mode, left(deck, 60) AS title,
  CAST(NULL AS VARCHAR) AS error, slides, slides_md5, CAST(0 AS INTEGER) AS images, CAST(0 AS INTEGER) AS open FROM z JOIN m USING (doc_id)"""
)
def deck_stub_multi(spark, d):
    return _decks(spark, d, True)


# ---------------------------------------------------------------- pages with captions

_PAGE_BLOCKS = """b AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS ord, CAST(l_linenumber % 5 = 4 AS INTEGER) AS kind,
    CASE WHEN l_linenumber % 3 = 1 THEN 'Figure ' || l_linenumber || ': of ' ELSE '' END || 'block ' || l_linenumber || CASE WHEN q % 2 = 0 THEN '-' ELSE '' END AS text,
    CAST(q % 7 * 10 AS DOUBLE) AS x0, CAST(l_linenumber * 22 + q % 9 AS DOUBLE) AS y0, CAST(q % 7 * 10 + 200 AS DOUBLE) AS x1, CAST(l_linenumber * 22 + q % 9 + 10 + q % 5 AS DOUBLE) AS y1
  FROM (SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL))"""


def _page_blocks(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("ord")).agg(F.max("l_quantity").cast("long").alias("q"))
    opening = F.when(F.col("ord") % 3 == 1, F.format_string("Figure %d: of ", "ord")).otherwise(F.lit(""))
    top = F.col("ord") * 22 + F.col("q") % 9
    return rows.select(
        "doc_id", F.lit(1).alias("page"), "ord", (F.col("ord") % 5 == 4).cast("int").alias("kind"), F.concat(opening, F.lit("block "), F.col("ord").cast("string"), F.when(F.col("q") % 2 == 0, "-").otherwise("")).alias("text"),
        (F.col("q") % 7 * 10).cast("double").alias("x0"), top.cast("double").alias("y0"), (F.col("q") % 7 * 10 + 200).cast("double").alias("x1"), (top + 10 + F.col("q") % 5).cast("double").alias("y1"), (F.col("q") % 4 * 4).cast("double").alias("size"),
    )


_CAPTION_FOLD = f"""{_PAGE_BLOCKS},
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n, regexp_matches(text, '(?i)^(fig\\.?|figure|chart|table)\\b') AS opens FROM b),
f(doc_id, n, cap, text, x0, y0, x1, y1) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM o WHERE n = 1
  UNION ALL
  SELECT o.doc_id, o.n,
    CASE WHEN o.kind <> 0 THEN NULL WHEN o.opens THEN o.ord WHEN o.y0 - f.y1 <= 8 THEN f.cap END,
    CASE WHEN o.opens THEN o.text WHEN f.text LIKE '%-' THEN left(f.text, length(f.text) - 1) || o.text ELSE f.text || ' ' || o.text END,
    CASE WHEN o.opens THEN o.x0 ELSE least(f.x0, o.x0) END, CASE WHEN o.opens THEN o.y0 ELSE least(f.y0, o.y0) END,
    CASE WHEN o.opens THEN o.x1 ELSE greatest(f.x1, o.x1) END, CASE WHEN o.opens THEN o.y1 ELSE greatest(f.y1, o.y1) END
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1),
cap AS (SELECT doc_id, 1 AS page, CAST(cap AS INTEGER) AS caption_ord, arg_max(text, n) AS text, arg_max(x0, n) AS x0, arg_max(y0, n) AS y0, arg_max(x1, n) AS x1, arg_max(y1, n) AS y1 FROM f WHERE cap IS NOT NULL GROUP BY doc_id, cap)"""


@query(f"WITH RECURSIVE {_CAPTION_FOLD} SELECT * FROM cap")
def caption_blocks(spark, d):
    return geometry.scan_captions(_page_blocks(spark, d).drop("size"))


# the best of each way to find a figure: shapes above or below, images likewise, the space up to the next text
_FIGURE_SQL = f"""{_CAPTION_FOLD},
c AS (SELECT doc_id, caption_ord, x0 AS cx0, y0 AS cy0, x1 AS cx1, y1 AS cy1, greatest(x1 - x0, 1.0) AS wide FROM cap),
shape AS (
  SELECT doc_id, 1 AS rank, x0, y0 - 9 AS y0, x1, y0 - 9 + ord * 7 AS y1 FROM b WHERE kind = 1 AND (ord % 2 = 0 OR ord * 7 >= 2) AND ord < 6
  UNION ALL SELECT doc_id, 2, x0, y0, x1, y1 FROM b WHERE kind = 1),
s AS (
  SELECT c.*, rank, 0 AS side, shape.x0, shape.y0, shape.x1, shape.y1 FROM c JOIN shape USING (doc_id) WHERE (least(shape.x1, cx1) - greatest(shape.x0, cx0)) / wide >= 0.4 AND shape.y1 <= cy0 + 2 AND shape.y0 >= greatest(0.0, cy0 - 500)
  UNION ALL SELECT c.*, rank, 1, shape.x0, shape.y0, shape.x1, shape.y1 FROM c JOIN shape USING (doc_id) WHERE (least(shape.x1, cx1) - greatest(shape.x0, cx0)) / wide >= 0.4 AND shape.y0 >= cy1 - 2 AND shape.y1 <= least(800.0, cy1 + 500)),
u AS (SELECT doc_id, caption_ord, rank, side, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM s GROUP BY ALL),
best AS (SELECT doc_id, caption_ord, rank, greatest(x0 - 8, 0.0) AS x0, greatest(y0 - 8, 0.0) AS y0, least(x1 + 8, 600.0) AS x1, least(y1 + 8, 800.0) AS y1
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, caption_ord, rank ORDER BY (x1 - x0) * (y1 - y0) DESC, side) AS k FROM u) WHERE k = 1),
t AS (SELECT doc_id, x0, y0, x1, y1, z FROM (SELECT b.*, q % 4 * 4 AS z FROM b JOIN (SELECT l_orderkey AS doc_id, l_linenumber AS ord, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL) USING (doc_id, ord)) WHERE kind = 0 AND NOT regexp_matches(text, '(?i)^(fig\\.?|figure|chart|table)\\b')),
e AS (
  SELECT c.*, greatest(greatest(0.0, cy0 - 500), coalesce((SELECT max(t.y1) FROM t WHERE t.doc_id = c.doc_id AND t.y1 <= cy0 - 2 AND least(t.x1, cx1) > greatest(t.x0, cx0) AND z >= 8), 0.0)) AS up,
    least(least(800.0, cy1 + 500), coalesce((SELECT min(t.y0) FROM t WHERE t.doc_id = c.doc_id AND t.y0 >= cy1 + 2 AND least(t.x1, cx1) > greatest(t.x0, cx0) AND z >= 8), 800.0)) AS down FROM c),
gap AS (
  SELECT doc_id, caption_ord, 3 AS rank, cx0, cx1, up AS y0, cy0 AS y1 FROM e UNION ALL SELECT doc_id, caption_ord, 4, cx0, cx1, cy1, down FROM e),
w AS (SELECT gap.doc_id, caption_ord, rank, greatest(least(cx0, coalesce((SELECT min(x0) FROM b WHERE b.doc_id = gap.doc_id AND b.y0 >= gap.y0 AND b.y1 <= gap.y1), cx0)) - 8, 0.0) AS x0, y0,
        least(greatest(cx1, coalesce((SELECT max(x1) FROM b WHERE b.doc_id = gap.doc_id AND b.y0 >= gap.y0 AND b.y1 <= gap.y1), cx1)) + 8, 600.0) AS x1, y1 FROM gap WHERE gap.y1 - gap.y0 >= 20),
every AS (SELECT * FROM best WHERE y1 - y0 >= 20 AND x1 > x0 UNION ALL SELECT * FROM w)
SELECT doc_id, 1 AS page, caption_ord, x0, y0, x1, y1, CASE rank WHEN 1 THEN 'drawing' WHEN 2 THEN 'raster' WHEN 3 THEN 'above' ELSE 'below' END AS source
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, caption_ord ORDER BY rank > 1, (x1 - x0) * (y1 - y0) DESC, rank) AS k FROM every) WHERE k = 1"""


@query(f"WITH RECURSIVE {_FIGURE_SQL}")
def figure_search(spark, d):
    found = _page_blocks(spark, d)
    drawings = found.where("kind = 1 and ord < 6").select("doc_id", "page", (F.col("ord") % 2 == 0).alias("filled"), "x0", (F.col("y0") - 9).alias("y0"), "x1", (F.col("y0") - 9 + F.col("ord") * 7).alias("y1"))
    pages = found.select("doc_id", "page").distinct().selectExpr("*", "0D as px0", "0D as py0", "600D as px1", "800D as py1", "10D as body_size")
    return geometry.figure_regions(geometry.scan_captions(found.drop("size")), drawings, found, pages)


# ---------------------------------------------------------------- texts, images and tables of contents


@query("SELECT doc_id, 'Use ' || lang || ' for ' || source || ' (' || n_chars || ') $langs ${none} and ' || lang || '.' AS prompt FROM documents".replace("$langs", "' || 'LL' || '").replace("'LL'", "lang || 's'"))
def prompt_fill(spark, d):
    values = {"lang": F.col("lang"), "source": F.col("source"), "n": F.col("n_chars"), "langs": F.concat("lang", F.lit("s"))}
    return table(spark, d, "documents").select("doc_id", T.substitute("Use $lang for $source ($n) $langs ${none} and ${lang}.", values).alias("prompt"))


@query("SELECT p_partkey, p_size % 4 = 0 OR p_size < 3 AS blank FROM part")
def blank_images(spark, d):
    # 100 pixels of three channels, white but for p_size % 4 bytes in the middle; none at all for small sizes
    pixels = F.concat(F.repeat(F.lit("FF"), 150), F.repeat(F.lit("F9"), (F.col("p_size") % 4).cast("int")), F.repeat(F.lit("FA"), (150 - F.col("p_size") % 4).cast("int")))
    return table(spark, d, "part").select("p_partkey", images.is_blank(F.when(F.col("p_size") >= 3, F.unhex(pixels)), F.lit(3)).alias("blank"))


@query("SELECT p_partkey, CAST(8 + p_size AS INTEGER) AS width, 6 AS height, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 4 END AS channels, p_size % 3 = 0 AS blank FROM part")
def png_images(spark, d):
    """PNG files of five colour types and all row filters, white but for one sample, decoded and looked at."""

    @F.pandas_udf("binary")
    def files(key: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for k, s in zip(key, size):
            colour = (0, 2, 3, 4, 6)[k % 5]
            white = 1 if colour == 3 else 255
            pixels = np.full((6, (8 + s) * images._CHANNELS[colour]), white, np.uint8)
            pixels[s % 6, s] = white if s % 3 == 0 else 0 if colour == 3 else 249
            out.append(images.made_png(pixels, colour, palette=bytes([9, 9, 9, 255, 255, 255]) if colour == 3 else b""))
        return pd.Series(out)

    # dealt by key, so that a table of few input splits is drawn by as many tasks as there are
    parts = table(spark, d, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    made = Scratch(spark, "png").save(parts.select("p_partkey", files("p_partkey", "p_size").alias("content")), "files")
    found = made.select("p_partkey", images.png_pixels(F.col("content")).alias("x")).select("p_partkey", "x.*")
    return found.select("p_partkey", "width", "height", "channels", images.is_blank(F.col("samples"), F.col("channels")).alias("blank"))


@query("SELECT p_brand, CAST(r - 1 AS BIGINT) AS position, level, trim(heading) AS heading, p_size AS page FROM (SELECT p_brand, p_size, p_size % 3 + 1 AS level, CASE WHEN p_size % 7 = 0 THEN '  ' ELSE ' ' || p_name || ' ' END AS heading, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE trim(heading) <> ''")
def toc_rows(spark, d):
    entry = F.struct("p_partkey", (F.col("p_size") % 3 + 1).alias("level"), F.when(F.col("p_size") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("heading"), F.col("p_size").alias("page"))
    docs = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(entry)).alias("toc"))
    return sections.toc_rows(docs, key="p_brand")


@query("SELECT event_id, k, k IS NOT NULL AND k BETWEEN 10 AND 60 AS valid FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def json_validate(spark, d):
    noisy = F.concat(F.lit("So: "), "props", F.lit(" - done."))
    parsed = table(spark, d, "events").select("event_id", F.from_json(T.json_slice(noisy), "k long")["k"].alias("k"))
    return validation.validated(parsed, [validation.Rule("k", least=10, most=60)]).select("event_id", "k", "valid")


@query(f"SELECT doc_id, page, region_id, greatest(x0 - 8, 50.0) AS x0, greatest(y0 - 8, 50.0) AS y0, least(x1 + 8, 350.0) AS x1, least(y1 + 8, 400.0) AS y1 FROM (SELECT {_RECT} FROM lineitem)")
def padded_rects(spark, d):
    r = _rects(spark, d).selectExpr("*", "50D as px0", "50D as py0", "350D as px1", "400D as py1")
    return geometry.padded(r).select("doc_id", "page", "region_id", "x0", "y0", "x1", "y1")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Plan slides for the chapter \"' || p_name || '\" and no other. Keep its definitions and terms in line with the outline of the whole document.' ELSE '' END AS scope FROM part")
def scope_text(spark, d):
    return table(spark, d, "part").select("p_partkey", decks.scope_of(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("")).alias("scope"))


@query("SELECT user_id, event_type AS chapter, string_agg(event_id, ',' ORDER BY event_id) AS maps FROM events GROUP BY ALL")
def chapter_maps(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("chapter"), "event_id")
    return decks.ordered(rows, ["user_id", "chapter"], "event_id", F.col("event_id").cast("string"), "maps").select("user_id", "chapter", F.array_join("maps", ",").alias("maps"))


# ---------------------------------------------------------------- by way of files


@query(f"WITH {_LIB} SELECT file, type, CAST(slide_count AS BIGINT) AS slide_count FROM lib WHERE NOT (archived AND k % 2 = 0)")
def library_delete(spark, d):
    lib = _library(spark, d)
    held = Scratch(spark, "library")
    path = held.path("manifest")
    writers.write_library(_entries(lib), path)
    writers.write_library(library.deleted(writers.read_library(spark, path), lib.where("c_custkey % 2 = 0")), path)
    return writers.read_library(spark, path).select("file", "type", "slide_count")


@query("SELECT p_partkey, p_name FROM part")
def stage_cache(spark, d):
    root = Scratch(spark, "stages").root
    writers.save_stage(table(spark, d, "part").select("p_partkey", "p_name"), root, "key", "parts")
    return readers.stage(spark, root, "key", "parts", resume=True)


_NATION_DECKS = """
k AS (SELECT n_nationkey, n_name, n_regionkey % 2 = 0 AS multi, left(sha256(n_name), 8) AS h FROM nation),
s AS (SELECT k.*, s_suppkey, s_name FROM k JOIN supplier ON s_nationkey = n_nationkey)"""


@query(
    f"""WITH {_NATION_DECKS}
SELECT CASE WHEN multi THEN min_by(s_name, s_suppkey) ELSE n_name END AS title,
  '/' || lower(replace(replace(CASE WHEN multi THEN min_by(s_name, s_suppkey) ELSE n_name END, '#', ''), ' ', '_')) || '_' || h || '_20260101T000000' || CASE WHEN multi THEN '/index.json' ELSE '.json' END AS file,
  CASE WHEN multi THEN 'multi_deck' ELSE 'single_deck' END AS type, h AS doc_hash, CAST(count(*) AS BIGINT) AS slide_count, CASE WHEN multi THEN count(*) ELSE 1 END AS deck_count, false AS archived
FROM s GROUP BY n_nationkey, n_name, multi, h"""
)
def published_decks(spark, d):
    """Decks of nations written as files, one for each supplier in every other region, and the manifest that the files give."""
    both = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    multi = F.col("n_regionkey") % 2 == 0
    slide = F.struct("s_suppkey", F.col("s_suppkey").alias("index"), F.lit("Definition").alias("tag"), F.col("s_name").alias("heading"), F.lit("b").alias("body"), F.array().cast("array<long>").alias("image_refs"))
    rows = both.groupBy(F.col("n_nationkey").alias("doc_id"), "n_name", multi.alias("multi"), F.when(multi, F.col("s_suppkey")).otherwise(0).alias("deck_id")).agg(F.array_sort(F.collect_list(slide)).alias("slides"), F.min("s_name").alias("s_name"))
    made = rows.select(
        "doc_id", "deck_id", F.when(F.col("multi"), "multi").otherwise("single").alias("mode"), F.when(F.col("multi"), F.col("s_name")).otherwise("").alias("chapter"), F.when(F.col("multi"), F.col("s_name")).otherwise(F.col("n_name")).alias("title"),
        library.content_hash(F.col("n_name").cast("binary")).alias("doc_hash"), F.transform("slides", lambda s: s.dropFields("s_suppkey")).alias("slides"), F.array().cast("array<struct<index:long,caption:string,page:long,data_uri:string>>").alias("images"),
    )
    path = Scratch(spark, "decks").path("out")
    writers.publish_decks(made, path, stamp="20260101T000000", generated_at="2026-01-01", provider="p", model="m")
    return readers.rebuilt_library(spark, path).select("title", "file", "type", "doc_hash", "slide_count", "deck_count", "archived")


@query("SELECT n_nationkey, CAST(p - 1 AS INTEGER) AS ord, x[p] AS type, CASE x[p] WHEN 'text' THEN n_name END AS text, CAST(n_regionkey AS INTEGER) AS page_idx FROM (SELECT *, ['text', 'image', 'table'] AS x FROM nation), unnest(range(1, 4)) AS t(p)")
def block_files(spark, d):
    """Content blocks written as one JSON list for each nation, and read back."""
    block = lambda kind: F.struct(F.lit(kind).alias("type"), F.when(F.lit(kind == "text"), F.col("n_name")).alias("text"), F.col("n_regionkey").alias("page_idx"), F.col("n_name").alias("img_path"))
    path = Scratch(spark, "blocks").path("lists")
    lists = table(spark, d, "nation").select("n_nationkey", F.to_json(F.array(*(block(k) for k in ("text", "image", "table")))).alias("value"))
    lists.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    names = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("img_path"))
    return readers.block_lists(spark, path).join(names, "img_path").select("n_nationkey", "ord", "type", "text", "page_idx")


@query(f"WITH {_LIB} SELECT file, type, CAST(slide_count AS BIGINT) AS slide_count, archived FROM lib")
def manifest_read(spark, d):
    """Manifests that are JSON lists, as older libraries have them: one for each of 16 shelves."""
    path = Scratch(spark, "manifest").path("library.json")
    shelf = F.pmod(F.xxhash64("file"), F.lit(16)).alias("shelf")
    lists = _entries(_library(spark, d)).groupBy(shelf).agg(F.to_json(F.collect_list(F.struct(*library.COLUMNS))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.library(spark, path).select("file", "type", "slide_count", "archived")


def _nation_files(spark, d) -> str:
    """A folder for each nation, with its name in a text file."""
    path = Scratch(spark, "files").path("texts")
    table(spark, d, "nation").repartition("n_nationkey").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    return path


def _nation_of(path):
    return F.regexp_extract(path, "n_nationkey=([0-9]+)", 1).cast("long")


@query("SELECT n_nationkey, left(sha256(n_name || chr(10)), 8) AS doc_hash, n_name || chr(10) AS text FROM nation")
def extracted_texts(spark, d):
    found = registry.extractor("text")(spark, _nation_files(spark, d))
    return found.select(_nation_of(F.col("path")).alias("n_nationkey"), "doc_hash", "text")


@query("SELECT n_nationkey, left(sha256(n_name || chr(10)), 8) AS doc_hash, 'done' AS status FROM nation")
def upload_jobs(spark, d):
    """Files as a stream of jobs, each batch hashed, and the last word on each job."""
    out = Scratch(spark, "jobs")
    stream = jobs.uploads(spark, f"{_nation_files(spark, d)}/*", suffix=".txt", per_batch=8)
    jobs.run_jobs(stream, lambda batch: batch.select("job_id", "doc_hash"), out.path("out"), out.path("checkpoint"), once=True).awaitTermination()
    hashes = spark.read.parquet(f"{out.path('out')}/results").select("job_id", "doc_hash")
    return jobs.statuses(spark, out.path("out")).join(hashes, "job_id").select(_nation_of(F.col("path")).alias("n_nationkey"), "doc_hash", "status")
