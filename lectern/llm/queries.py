"""The thin queries over the operators of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from lectern.llm import chat_format, fill_in_middle, sentencepiece_fst
from lectern.llm.ann import nearest
from lectern.llm.divergence import divergence
from lectern.llm.embedding_dedup import near_duplicates
from lectern.llm.exact_dedup import exact_duplicates
from lectern.llm.jaccard_join import jaccard_components
from lectern.llm.line_dedup import dedup_lines
from lectern.llm.lm_score import lm_scores
from lectern.llm.packing import pack
from lectern.llm.quality import quality_scores
from lectern.llm.warc import archived_pages
from lectern.session import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.where("vec_id % 50 = 0"), rows, k=5)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    read = chat_format.read_back(chat_format.segments(turns))
    return read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_sentencepiece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.coding_digest(table(spark, sf_dir, "documents"), model=public_tokenizers.path("piece_bpe_32k.model"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(table(spark, sf_dir, "documents"), rate=100, suffix_first=50, seed=7)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"), least=3, ranks=200)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


#: Words and 3-word shingles of the documents, as op3 defines them.
_OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
                               ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM words, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i)
  WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (
  SELECT u, v FROM links UNION SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
       CAST(least(d.doc_id, coalesce(r.m, d.doc_id)) AS BIGINT) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) r USING (doc_id)
"""


_OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, p - 1 AS pos, l[p] AS w1, l[p + 1] AS w2, l[p + 2] AS w3, len(l) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(p)),
windows AS (
  SELECT doc_id, pos, w1 || chr(10) || w2 || chr(10) || w3 AS w FROM lines
  WHERE pos + 3 <= n AND regexp_matches(w1 || w2 || w3, '\S')),
later AS (
  SELECT doc_id, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS o(k))
SELECT d.doc_id,
       coalesce(string_agg(l.w1, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text,
       CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.pos) AS BIGINT) AS n_removed
FROM documents d JOIN lines l USING (doc_id) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
GROUP BY d.doc_id
"""


_OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes FROM pages),
newest AS (SELECT html, max(page_id) AS newest FROM p WHERE bytes >= 1000 GROUP BY html)
SELECT p.page_id, CAST(p.bytes AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN n.newest > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n.newest > p.page_id THEN n.newest END AS refers_to
FROM p LEFT JOIN newest n ON p.html = n.html
"""

_OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
WHERE rank <= 5
"""

_OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM (VALUES (0), (1)) AS x(i)),
f AS (
  SELECT *, lag(role) OVER w AS before, lead(turn) OVER w IS NULL AS last,
         regexp_replace(replace(text, '\', '\\'), '(### |</turn>|###)', '\\\1', 'g') AS escaped
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + length('### : ') + length(role) + length(' </turn>x')) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
                     WHEN before = 'user' THEN role = 'assistant' ELSE role = 'user' END
                AND (NOT last OR role = 'assistant')) AS valid
FROM f GROUP BY conv_id
"""

_OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT u, v FROM links UNION SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u),
n AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY 1),
c AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

_OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS r FROM d),
c AS (
  SELECT *, len(u) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
              WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

_OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
           FROM (SELECT row_number() OVER () AS doc_id, lang, source, text FROM documents)),
o AS (SELECT lang, source, doc_id, t.w AS term FROM d, unnest(d.w) AS t(w)),
kept AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + 1000000000 * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS p FROM x WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM x GROUP BY 1, 2),
q AS (SELECT *, 1 + 1000000000 * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS q FROM l WINDOW w AS (PARTITION BY lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
          UNION ALL
          SELECT p.lang, p.source, 'term', p.term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
WHERE part = 'pair' OR rank <= 200
"""

_OP13_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_warc_transactions": op2_warc_transactions,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_line_dedup": op9_line_dedup,
        "op10_sentencepiece_coding": op10_sentencepiece_coding,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_source_divergence": op12_source_divergence,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_transactions": _OP2_SQL,
        "op3_ngram_jaccard_join": _OP3_SQL,
        "op5_nearest_neighbours": _OP5_SQL,
        "op7_chat_formatting": _OP7_SQL,
        "op8_embedding_near_dedup": _OP8_SQL,
        "op9_line_dedup": _OP9_SQL,
        "op11_fill_in_middle": _OP11_SQL,
        "op12_source_divergence": _OP12_SQL,
        "op13_exact_dedup": _OP13_SQL,
    }
