"""Table functions for SQL: chunks, figure tags and tokens of a text, by LATERAL join.

    register(spark)
    spark.sql("SELECT doc_id, c.* FROM documents, LATERAL lectern_chunks(text, 8000, 1500) AS c")
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lectern.operators.chunking import Snap
from lectern.session import ship

_TAG = re.compile(r"\[FIGURE_ID:\s*(\d+)\]")


@udtf(returnType="chunk_idx bigint, chunk string", useArrow=True)
class Chunks:
    """Overlapping windows of a text, as chunk_chars() cuts them: a text that fits is one chunk as it is, blank ones are left out."""

    def eval(self, text: str, size: int, overlap: int):
        if text is None or size is None or overlap is None:
            return
        if len(text) <= size:
            if text.strip():
                yield 0, text
            return
        n = 0
        for a, b in Snap(text, size, overlap).spans():
            if chunk := text[a:b].strip():
                yield n, chunk
                n += 1


@udtf(returnType="ord bigint, figure_id bigint, at bigint", useArrow=True)
class Tags:
    """The figures that a text names, in order, with the place of each tag."""

    def eval(self, text: str):
        for n, m in enumerate(_TAG.finditer(text or "")):
            yield n, int(m[1]), m.start()


def register(spark: SparkSession) -> None:
    """Makes lectern_chunks(text, size, overlap) and lectern_tags(text) known to SQL."""
    ship(spark)
    spark.udtf.register("lectern_chunks", Chunks)
    spark.udtf.register("lectern_tags", Tags)
