"""Removal of repeated passages by overlapping three-line windows.

Every run of three consecutive lines is hashed (128 bits). Of a window that occurs more than once in
the corpus, the occurrence with the smallest (doc_id, line number) stays and all others go: the
lines that they cover are removed, overlapping windows merging into one span. Every removed
line so survives where its window, or a window that removed it there, occurs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.storage import Scratch, free_name, small

WINDOW = 3
#: Documents and positions that are broadcast at most, about 6 MB.
MOST_SPANS = 300_000


def later_windows(docs: DataFrame, scratch: Scratch, size: int = WINDOW) -> DataFrame:
    """(doc_id, pos) of each window of docs(doc_id, text) that occurs earlier as well."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    # the window as text is unambiguous: lines hold no line feed; two seeds give 128 bits
    windows = lines.where(F.size("lines") >= size).select(
        "doc_id",
        F.explode(
            F.expr(
                f"filter(transform(sequence(0, size(lines) - {size}), i -> named_struct('pos', i, 'w', concat_ws('\\n', slice(lines, i + 1, {size})))), x -> x.w rlike '[^\\\\s]')"
            )
        ).alias("x"),
    )
    windows = windows.select("doc_id", "x.pos", F.xxhash64("x.w").alias("h"), F.xxhash64(F.lit(7), "x.w").alias("g"))
    windows = scratch.save(windows, "windows")
    firsts = windows.groupBy("h", "g").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("uses"))
    firsts = scratch.save(firsts.where("uses > 1").select("h", "g", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")), "repeated")
    return windows.join(small(firsts, 50_000), ["h", "g"]).where("doc_id != first_doc or pos != first_pos").select("doc_id", "pos")


def _cleaned(docs: DataFrame, size: int) -> tuple[DataFrame, str, str]:
    """docs with text changed and two more columns: lines before, lines removed."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone, total, lost = (free_name(docs, c) for c in ("_gone", "_lines", "_removed"))
    later = later_windows(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), scratch, size)
    spans = scratch.save(later.groupBy(F.col("doc_id").alias("_d")).agg(F.sort_array(F.collect_set("pos")).alias(gone)), "spans")
    # texts are shuffled only where the spans of all documents are too many to send around
    most = spans.agg(F.count("*") + F.sum(F.size(gone))).first()[0] or 0
    spans = F.broadcast(spans) if most <= MOST_SPANS else spans.hint("merge")
    joined = docs.join(spans, docs["doc_id"] == spans["_d"], "left").select(*(docs[c] for c in docs.columns), gone)
    rest = free_name(joined, "_left")
    lines, last = F.split(F.col("text").cast("string"), "\n", -1), F.size(gone)

    def between(z):
        """The lines from the end of one removed window to the begin of the next; none where they overlap or touch."""
        k, whole = z["k"], z["lines"]
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get(gone, k - 1) + size)
        return F.slice(whole, begin + 1, F.greatest(F.when(k == last, F.size(whole)).otherwise(F.get(gone, k)) - begin, F.lit(0)))

    # the lines go along with each place: what else stands inside a lambda is evaluated for every element
    places = F.arrays_zip(F.sequence(F.lit(0), last).alias("k"), F.array_repeat(lines, last + 1).alias("lines"))
    left = F.flatten(F.transform(places, between))
    joined = joined.withColumn(rest, F.when(F.col(gone).isNotNull() & F.col("text").isNotNull(), left))
    none = F.lit(0).cast("long")
    before = F.when(F.col("text").isNotNull(), F.size(lines).cast("long")).otherwise(none)
    removed = F.when(F.col(rest).isNotNull(), before - F.size(rest)).otherwise(none)
    text = F.coalesce(F.array_join(rest, "\n"), F.col("text").cast("string"))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, before.alias(total), removed.alias(lost)), total, lost


def dedup_lines(docs: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """doc_id, text, n_lines, n_removed for every row of docs(doc_id, text, ...).

    n_lines counts the lines before. Null texts stay null (0 lines); an empty text is one empty line.
    Texts of fewer than `size` lines stay whole, as do windows without a visible character and rows
    with a null doc_id. Rows that repeat a doc_id are occurrences at the same place: none of them
    comes before another. Other columns aren't read.
    """
    out, total, lost = _cleaned(docs.select("doc_id", "text"), size)
    return out.select("doc_id", "text", F.col(total).alias("n_lines"), F.col(lost).alias("n_removed"))


def without_repeated_lines(docs: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """docs with its own columns, repeated passages removed, and rows dropped of which nothing visible is left.

    n_chars, where there is such a column, follows the text.
    """
    out, _, lost = _cleaned(docs, size)
    out = out.where(f"not (`{lost}` > 0 and not text rlike '[^\\\\s]')").drop(lost).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
