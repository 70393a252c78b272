"""Fill-in-the-middle examples by escaped marker injection.

A text is cut into units, here lines with their line feeds. A delimiter that no escaped text holds is put
behind every unit; counting it counts the units, and what stands between two ranks of it is a part of the text. So
prefix, middle and suffix are cut without arrays of units, unescaped, and put together behind markers. All of it is
column expressions in the scan: no shuffle, no state, and the same result for a row whatever else the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.storage import free_name

#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
LINES = r"[^\n]*+\n|[^\n]++"
#: What is put behind units, and what escapes it and itself.
DELIMITER, ESCAPE = "\x01", "\x02"


def escaped(text: Column) -> Column:
    """The text without a delimiter: an escape becomes escape a, a delimiter escape b."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "a")), F.lit(DELIMITER), F.lit(ESCAPE + "b"))


def unescaped(marked: Column) -> Column:
    """The text that was escaped, without the delimiters put into it since."""
    bare = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "b"), F.lit(DELIMITER)), F.lit(ESCAPE + "a"), F.lit(ESCAPE))


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of seed, colon and key."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone; the markers stand in an output once each unless it is plain."""
    p, s, m = MARKERS
    upto = lambda x, mark: F.substring_index(x, mark, 1)
    behind = lambda x, mark: F.substring_index(x, mark, -1)
    psm = F.concat(behind(upto(output, s), p), behind(output, m), upto(behind(output, s), m))
    spm = F.concat(upto(behind(output, p), m), behind(output, m), behind(upto(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", units: str = LINES, rate: int = 100, suffix_first: int = 50, seed: int = 7) -> DataFrame:
    """docs with output, form, n_units, prefix, middle, suffix after its own columns (underscores follow names taken).

    The prefix ends after the smaller and the middle after the larger of two numbers of units, drawn from `key`;
    `rate` and `suffix_first` are the shares, in hundredths, of texts that are rearranged and of those that begin with the suffix.
    `units` is a pattern whose matches, one after the other, make up the text. Null texts are empty; empty texts and
    those that hold a marker are plain: output is the text; prefix, middle and suffix are null. A null key counts as an
    empty one; rows that repeat a key and text have equal outputs; an empty table gives none.
    """
    names = ["output", "form", "n_units", "prefix", "middle", "suffix", "_text", "_marked", "_low", "_high", "_h"]
    name: dict[str, str] = {}
    for n in names:
        name[n] = free_name(docs.withColumns({x: F.lit(0) for x in name.values()}), n)
    col = {n: F.col(f"`{x}`") for n, x in name.items()}
    own = docs.select("*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias(name["_text"]), F.array(*draws(F.col(f"`{key}`"), seed)).alias(name["_h"]))
    # each step is a projection of its own, so that no expensive expression stands twice in one
    cut = own.withColumn(name["_marked"], F.regexp_replace(escaped(col["_text"]), units, "$0" + DELIMITER))
    cut = cut.withColumn(name["n_units"], F.length(col["_marked"]).cast("long") - F.length(F.replace(col["_marked"], F.lit(DELIMITER), F.lit(""))))
    a, b = (col["_h"][k] % (col["n_units"] + 1) for k in (0, 1))
    cut = cut.withColumns({name["_low"]: F.least(a, b).cast("int"), name["_high"]: F.greatest(a, b).cast("int")})
    n, low, high, marked = col["n_units"].cast("int"), col["_low"], col["_high"], col["_marked"]
    ranked = lambda x, k: F.call_function("substring_index", x, F.lit(DELIMITER), k)
    plain = (col["_text"] == "") | (col["_h"][2] % 100 >= rate)
    for m in MARKERS:
        plain = plain | F.contains(col["_text"], F.lit(m))
    cut = cut.withColumn(name["form"], F.when(plain, "plain").when(col["_h"][3] % 100 < suffix_first, "spm").otherwise("psm"))
    whole = col["form"] == "plain"
    part = lambda x: F.when(~whole, unescaped(x))
    # counted from the end, the delimiter of rank `high` is the (n - high + 1)-th of the whole, that of rank `low` the (high - low)-th of what precedes it
    cut = cut.withColumns(
        {
            name["prefix"]: part(ranked(marked, low)),
            name["middle"]: part(ranked(ranked(marked, high), low - high)),
            name["suffix"]: part(ranked(marked, high - n - 1)),
        }
    )
    p, s, m = (F.lit(x) for x in MARKERS)
    prefix, middle, suffix = col["prefix"], col["middle"], col["suffix"]
    output = F.when(whole, col["_text"]).when(col["form"] == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = cut.withColumn(name["output"], output)
    return cut.select(*(F.col(f"`{c}`") for c in docs.columns), *(col[n] for n in ("output", "form", "n_units", "prefix", "middle", "suffix")))


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of output and of the text rebuilt from output and form."""
    made = fill_in_middle(docs.select("doc_id", "text"), **options)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    made = made.withColumn("again", restored(F.col("output"), F.col("form")))
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(F.col("again")).alias("restored_sha256"),
    )
