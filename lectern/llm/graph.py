"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.storage import Scratch


def components(links: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(id, root) for every id in links(u, v); root is the smallest id reachable.

    Each round points every id at its smallest neighbour if that is smaller, follows the pointers to
    their ends, and contracts the links to those ends. Pointers only go down, so they form trees;
    contraction at least halves what is still linked, so rounds grow with the logarithm.
    All tables go through the shared folder; aggregation is a minimum, combined before the
    shuffle, so a hub with any number of links costs one row per task.
    """
    links = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    links = scratch.save(links, f"{tag}_links0")
    total, k = None, 0
    while not links.isEmpty():
        both = links.union(links.select("v", "u"))
        parent = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("near")).select("id", F.least("id", "near").alias("root"))
        parent = scratch.save(parent, f"{tag}_p{k}_0")
        jump = 0
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("over"))
            moved = scratch.save(parent.join(up, "root").select("id", F.col("over").alias("root"), (F.col("over") != F.col("root")).alias("moved")), f"{tag}_p{k}_{jump + 1}")
            any_moved = not moved.where("moved").isEmpty()
            parent = moved.select("id", "root")
            scratch.drop(f"{tag}_p{k}_{jump}")
            jump += 1
            if not any_moved:
                break
        if total is None:
            total = parent
        else:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("over"))
            total = scratch.save(total.join(up, "root", "left").select("id", F.coalesce("over", "root").alias("root")), f"{tag}_t{k}")
        left = parent.select(F.col("id").alias("u"), F.col("root").alias("ru"))
        right = parent.select(F.col("id").alias("v"), F.col("root").alias("rv"))
        nxt = links.join(left, "u").join(right, "v").where("ru != rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        nxt = scratch.save(nxt, f"{tag}_links{k + 1}")
        scratch.drop(f"{tag}_links{k}")
        links, k = nxt, k + 1
    if total is None:
        kind = links.schema["u"].dataType
        return links.select(F.col("u").cast(kind).alias("id"), F.col("v").cast(kind).alias("root"))
    return total


def most_frequent(counts: DataFrame, by: str, most: int) -> DataFrame:
    """The rows of counts with the largest `by`: all that reach a threshold, at most `most` rows.

    The threshold comes from a histogram of a few thousand bins, so no task and no driver sorts all
    rows; rows tied at the threshold come all or, where they'd exceed `most`, not at all.
    """
    n = F.col(by)
    place = F.when(n < 1024, n).otherwise(F.lit(1024) + F.floor((F.log2(n.cast("double")) - 10) * 64)).cast("long")
    total, edge = 0, None
    for row in counts.groupBy(place.alias("bin")).agg(F.count("*").alias("rows")).orderBy(F.desc("bin")).collect():
        total += row.rows
        if total > most:
            break
        edge = row.bin
    return counts.where(place >= edge) if edge is not None else counts.where("false")
