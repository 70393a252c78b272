"""Rectangles on pages: pairing, merging, containment, figure regions.

Rectangles are four columns x0, y0, x1, y1. Joins always carry the page; those of a page with many rectangles also a cell of a grid, of
a size that follows the rectangles', so a rectangle only meets those around it, however many a page has.
"""

from __future__ import annotations

import re
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lectern.functions import text as T
from lectern.session import ship
from lectern.storage import Scratch

# Fixed values, in points.
CAPTION_GAP = 80.0
PANEL_GAP = 18.0
CONTINUATION_GAP = 8.0
SEARCH = 500.0
PADDING = 8.0
LEAST_HEIGHT = 20.0
HAIRLINE = 2.0
OVERLAP = 0.4
CONTAINED = 0.5
LEAST_CONFIDENCE = 0.5
FIGURES = ("Figure", "Picture")
CAPTIONS = ("Caption",)
PAGE = ("doc_id", "page")


def rect(prefix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def confident(regions: DataFrame, *, scale: float = 1.0) -> DataFrame:
    """Regions of a confidence of 0.5 and more; null counts as 1. Corners are scaled (72 / 96 for pixels)."""
    kept = regions.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).where(F.col("confidence") >= LEAST_CONFIDENCE)
    return kept.withColumns({c: F.col(c) * scale for c in ("x0", "y0", "x1", "y1")})


def detected(regions: DataFrame, *, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(figures, captions) of regions(label, confidence, x0..y1): confident ones, by label; all other labels are left out."""
    sure = confident(regions, scale=scale)
    return sure.where(F.col("label").isin(*FIGURES)), sure.where(F.col("label").isin(*CAPTIONS))


def padded(df: DataFrame, padding: float = PADDING) -> DataFrame:
    """Rectangles grown by `padding` and clipped to the page (px0, py0, px1, py1)."""
    return df.withColumns({"x0": F.greatest(F.col("x0") - padding, F.col("px0")), "y0": F.greatest(F.col("y0") - padding, F.col("py0")), "x1": F.least(F.col("x1") + padding, F.col("px1")), "y1": F.least(F.col("y1") + padding, F.col("py1"))})


def bounding_boxes(regions: DataFrame, *keys: str) -> DataFrame:
    """keys, x0, y0, x1, y1, confidence: the union of each group's rectangles and their best confidence."""
    return regions.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("confidence").alias("confidence"))


#: Rectangles on a page of which all pairs are looked at; in cells, each would be some thirty rows.
FEW = 64
#: Powers of two, in points, of the sides of cells.
FINEST, COARSEST = 4, 12


def _boxed(df: DataFrame, box: tuple, side: str) -> DataFrame:
    """Rows of df with a page and a whole box, which they have as `side` columns too."""
    x0, y0, x1, y1 = box
    low = {f"_{side}x": F.least(x0, x1), f"_{side}y": F.least(y0, y1), f"_{side}u": F.greatest(x0, x1), f"_{side}v": F.greatest(y0, y1)}
    whole = df.where(x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()).where(" and ".join(f"{c} is not null" for c in PAGE))
    return whole.withColumns({k: c.cast("double") for k, c in low.items()})


def _in_cells(df: DataFrame, side: str, visiting: int | None) -> DataFrame:
    """A row of df for each cell that its box meets: at the level of its size, or, visiting, at all levels from `visiting` above it."""
    x, y, u, v = (F.col(f"_{side}{c}") for c in "xyuv")
    level = F.greatest(F.lit(FINEST), F.least(F.lit(COARSEST), F.ceil(F.log2(F.greatest(u - x, v - y, F.lit(1.0)))))).cast("int")
    own = F.array(level) if visiting is None else F.when(level + visiting <= COARSEST, F.sequence(level + visiting, F.lit(COARSEST)))
    df = df.withColumn("_level", F.explode(own)).withColumn("_size", F.call_function("shiftleft", F.lit(1), F.col("_level")))
    cell = lambda a: F.floor(a / F.col("_size"))
    return df.withColumn("_cx", F.explode(F.sequence(cell(x), cell(u)))).withColumn("_cy", F.explode(F.sequence(cell(y), cell(v)))).drop("_size")


def crowded_pages(*rects: DataFrame) -> DataFrame:
    """doc_id, page of the pages with more than FEW rows in all."""
    return reduce(DataFrame.unionAll, [r.select(*PAGE) for r in rects]).groupBy(*PAGE).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select(*PAGE)


def meeting(a: DataFrame, b: DataFrame, a_box: tuple, b_box: tuple, *, crowded: DataFrame | bool = True) -> DataFrame:
    """Rows of a and b on one page whose boxes meet, each pair once; but for the page they share no column names.

    Boxes are (x0, y0, x1, y1) as columns; nulls meet nothing. On a page of at most FEW boxes all pairs are looked at, by one join on
    the page. On others a box has at most four cells at the level of its size, and at each coarser one, where it visits the larger
    boxes that live there; a pair counts in the cell where its intersection begins. crowded: the pages to be joined by cells where they
    are known, False if there are none; else they are counted.
    """
    here = lambda axis: F.floor(F.greatest(F.col(f"_a{axis}"), F.col(f"_b{axis}")) / F.call_function("shiftleft", F.lit(1), F.col("_level")))
    meets = (F.least("_au", "_bu") >= F.greatest("_ax", "_bx")) & (F.least("_av", "_bv") >= F.greatest("_ay", "_by"))
    columns = [*PAGE, *(c for c in a.columns if c not in PAGE), *(c for c in b.columns if c not in PAGE)]
    a, b = _boxed(a, a_box, "a"), _boxed(b, b_box, "b")
    if crowded is False:
        return a.join(b, list(PAGE)).where(meets).select(*columns)
    crowded = crowded_pages(a, b) if crowded is True else crowded
    few = [x.join(crowded, list(PAGE), "left_anti") for x in (a, b)]
    many = [x.join(crowded, list(PAGE), "left_semi") for x in (a, b)]

    def met(a_visits: int | None, b_visits: int | None) -> DataFrame:
        both = _in_cells(many[0], "a", a_visits).join(_in_cells(many[1], "b", b_visits), [*PAGE, "_level", "_cx", "_cy"])
        return both.where(meets & (F.col("_cx") == here("x")) & (F.col("_cy") == here("y"))).select(*columns)

    return few[0].join(few[1], list(PAGE)).where(meets).select(*columns).union(met(0, None)).union(met(None, 1))


def _grown(box: tuple, dx: float, dy: float) -> tuple:
    x0, y0, x1, y1 = box
    return F.least(x0, x1) - dx, F.least(y0, y1) - dy, F.greatest(x0, x1) + dx, F.greatest(y0, y1) + dy


def caption_pairs(figures: DataFrame, captions: DataFrame, most: float = CAPTION_GAP) -> DataFrame:
    """doc_id, page, figure_id, caption_id, gap of all pairs that share some width and are at most `most` apart."""
    f = figures.select(*PAGE, F.col("region_id").alias("figure_id"), *(F.col(c).alias(f"f{c}") for c in ("x0", "y0", "x1", "y1")))
    c = captions.select(*PAGE, F.col("region_id").alias("caption_id"), *(F.col(x).alias(f"c{x}") for x in ("x0", "y0", "x1", "y1")))
    gap = F.greatest(F.lit(0.0), F.col("fy0") - F.col("cy1"), F.col("cy0") - F.col("fy1"))
    pairs = meeting(f, c, _grown(rect("f"), 0.0, most), rect("c")).where("least(fx1, cx1) - greatest(fx0, cx0) > 0").withColumn("gap", gap)
    return pairs.where(F.col("gap") <= most).select(*PAGE, "figure_id", "caption_id", "gap")


def page_folds(rows: DataFrame, order: list[str], fold, schema: str) -> DataFrame:
    """Applies fold(list of rows as dicts) -> rows as tuples to each page, its rows in order.

    Pages stream by, many to an Arrow batch, so a corpus of small pages costs no call per page.
    """
    ship(rows.sparkSession)
    names = rows.columns
    kinds = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)}

    def folded(batches):
        page, last, out = [], None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(names, row))
                key = tuple(row[c] for c in PAGE)
                if page and key != last:
                    out += fold(page)
                    page = []
                page.append(row)
                last = key
            if len(out) >= 10_000:
                yield filled(out)
                out = []
        yield filled(out + (fold(page) if page else []))

    def filled(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds.values())], list(kinds))

    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInArrow(folded, schema)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def matched_captions(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs, greedily by (gap, figure_id, caption_id) on each page."""

    def greedy(page: list[dict]) -> list[tuple]:
        figures, captions, kept = set(), set(), []
        for row in page:
            if row["figure_id"] not in figures and row["caption_id"] not in captions:
                figures.add(row["figure_id"]), captions.add(row["caption_id"]), kept.append(tuple(row.values()))
        return kept

    return page_folds(pairs, ["gap", "figure_id", "caption_id"], greedy, _schema(pairs))


def paired_figures(figures: DataFrame, captions: DataFrame, most: float = CAPTION_GAP) -> DataFrame:
    """doc_id, page, figure_id, caption_id: every figure with its caption or null, and captions without figure with a null figure."""
    pairs = matched_captions(caption_pairs(figures, captions, most)).select(*PAGE, "figure_id", "caption_id")
    every = figures.select(*PAGE, F.col("region_id").alias("figure_id")).join(pairs, [*PAGE, "figure_id"], "left")
    alone = captions.select(*PAGE, F.col("region_id").alias("caption_id")).join(pairs, [*PAGE, "caption_id"], "left_anti")
    return every.unionByName(alone.withColumn("figure_id", F.lit(None).cast(figures.schema["region_id"].dataType)).select(*PAGE, "figure_id", "caption_id"))


def panel_links(regions: DataFrame, gap: float = PANEL_GAP) -> DataFrame:
    """doc_id, page, a, b of regions at most `gap` apart on both axes."""
    a = regions.select(*PAGE, F.col("region_id").alias("a"), *(F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")))
    b = regions.select(*PAGE, F.col("region_id").alias("b"), *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    near = f"greatest(ax0, bx0) - least(ax1, bx1) <= {gap} and greatest(ay0, by0) - least(ay1, by1) <= {gap}"
    return meeting(a, b, _grown(rect("a"), gap, gap), rect("b")).where(f"a < b and {near}").select(*PAGE, "a", "b")


def panel_components(regions: DataFrame, gap: float = PANEL_GAP) -> DataFrame:
    """regions with component: the smallest region_id of all panels reachable. region_id names a region of a page."""

    def merged(links: list[dict]) -> list[tuple]:
        root: dict = {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        for row in links:
            a, b = sorted((find(row["a"]), find(row["b"])))
            root[b] = a  # the smaller one stays, so a root is the smallest of its own
        return [(*(links[0][c] for c in PAGE), v, find(v)) for v in list(root)]

    key, page, kind = (regions.schema[c].dataType.simpleString() for c in (*PAGE, "region_id"))
    found = page_folds(panel_links(regions, gap), ["a", "b"], merged, f"doc_id {key}, page {page}, region_id {kind}, _root {kind}")
    out = regions.join(found, [*PAGE, "region_id"], "left")
    return out.select(*(regions[c] for c in regions.columns), F.coalesce("_root", regions["region_id"]).alias("component"))


def merged_panels(regions: DataFrame, gap: float = PANEL_GAP) -> DataFrame:
    """One region for each component: its bounding box and best confidence."""
    return bounding_boxes(panel_components(regions, gap), *PAGE, "component")


def text_inside(rects: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page, rect_id, text: the texts of all blocks with half their own area inside a rectangle, in order.

    rects(doc_id, page, rect_id, x0..y1), blocks(doc_id, page, ord, text, x0..y1).
    """
    b = blocks.select(*PAGE, "ord", "text", *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    both = meeting(rects.select(*PAGE, "rect_id", "x0", "y0", "x1", "y1"), b, rect(""), rect("b"))
    inside = area(F.greatest("x0", "bx0"), F.greatest("y0", "by0"), F.least("x1", "bx1"), F.least("y1", "by1"))
    own = area(*rect("b"))
    both = both.where((own > 0) & (inside > 0) & (inside / own >= CONTAINED) & (F.trim("text") != ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    return both.groupBy(*PAGE, "rect_id").agg(text.alias("text"))


def scan_captions(blocks: DataFrame) -> DataFrame:
    """doc_id, page, caption_ord, text, x0, y0, x1, y1: captions with the blocks that continue them.

    blocks(doc_id, page, ord, kind, text, x0..y1), kind 0 for text. A caption takes up the text blocks right
    after it while the gap stays within 8 points of what it covers so far; another kind of block or a new
    caption ends it; a hyphen at the end of a part joins words. Each step depends on the one
    before, so a page is one ordered fold.
    """
    opening = re.compile(T.CAPTION_WORDS, re.IGNORECASE)
    box = ("x0", "y0", "x1", "y1")

    def folded(page: list[dict]) -> list[tuple]:
        out: list[dict] = []
        open_: dict | None = None
        for b in page:
            text = (b["text"] or "").strip()
            if b["kind"] != 0:
                open_ = None
            elif opening.match(text):
                open_ = {"doc_id": b["doc_id"], "page": b["page"], "caption_ord": b["ord"], "text": text, **{c: b[c] for c in box}}
                out.append(open_)
            elif open_ is not None and b["y0"] - open_["y1"] > CONTINUATION_GAP:
                open_ = None
            elif open_ is not None:
                open_["text"] = open_["text"][:-1] + text if open_["text"].endswith("-") else f"{open_['text']} {text}"
                open_ |= {"x0": min(open_["x0"], b["x0"]), "y0": min(open_["y0"], b["y0"]), "x1": max(open_["x1"], b["x1"]), "y1": max(open_["y1"], b["y1"])}
        return [tuple((c | {"text": c["text"].strip()}).values()) for c in out]

    key, page, order = (blocks.schema[c].dataType.simpleString() for c in ("doc_id", "page", "ord"))
    return page_folds(blocks, ["ord"], folded, f"doc_id {key}, page {page}, caption_ord {order}, text string, x0 double, y0 double, x1 double, y1 double")


def figure_regions(captions: DataFrame, drawings: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, caption_ord, x0, y0, x1, y1, source: where the figure of each caption is.

    captions as scan_captions() gives them; drawings(doc_id, page, filled, x0..y1); blocks(doc_id, page, ord,
    kind, size, text, x0..y1) with kind 1 for raster images; pages(doc_id, page, px0..py1, body_size).
    Drawings near the caption come first: all above or all below, whichever cover more, above if equal. Else
    the largest of the images found likewise and the space up to the next body text above and below.
    """
    c = captions.select(*PAGE, "caption_ord", *(F.col(x).alias(f"c{x}") for x in ("x0", "y0", "x1", "y1"))).join(pages, list(PAGE))
    # each way to find a figure joins these again
    scratch = Scratch(captions.sparkSession, "figures")
    c, blocks = scratch.save(c, "captions"), scratch.save(blocks, "blocks")
    crowded = scratch.save(crowded_pages(c, drawings, blocks), "crowded")
    meets = partial(meeting, crowded=False if crowded.isEmpty() else crowded)
    wide = F.greatest(F.col("cx1") - F.col("cx0"), F.lit(1.0))
    keys = [*PAGE, "caption_ord"]

    def side(shapes: DataFrame, source: str) -> DataFrame:
        near = meets(c, shapes.select(*PAGE, "x0", "y0", "x1", "y1"), _grown(rect("c"), 0.0, SEARCH), rect("")).where((F.least("x1", "cx1") - F.greatest("x0", "cx0")) / wide >= OVERLAP)
        above = (F.col("y1") <= F.col("cy0") + 2) & (F.col("y0") >= F.greatest(F.col("py0"), F.col("cy0") - SEARCH))
        below = (F.col("y0") >= F.col("cy1") - 2) & (F.col("y1") <= F.least(F.col("py1"), F.col("cy1") + SEARCH))
        # a shape within two points of a thin caption can be on both sides
        where = near.withColumn("_side", F.explode(F.filter(F.array(F.when(above, 0), F.when(below, 1)), lambda s: s.isNotNull())))
        boxes = where.groupBy(*keys, "px0", "py0", "px1", "py1", "_side").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(area(*rect(""))), "_side"))
        boxes = padded(boxes.withColumn("_r", best).where("_r = 1"))
        return boxes.where(f"x1 > x0 and y1 > y0 and y1 - y0 >= {LEAST_HEIGHT}").select(*keys, "x0", "y0", "x1", "y1", F.lit(source).alias("source"))

    drawn = side(drawings.where(f"filled or y1 - y0 >= {HAIRLINE}"), "drawing")
    raster = side(blocks.where("kind = 1"), "raster")

    def gap(up: bool) -> DataFrame:
        text = blocks.where("kind = 0").where(~T.is_caption(F.trim("text"))).select(*PAGE, "size", *(F.col(x).alias(f"b{x}") for x in ("x0", "y0", "x1", "y1")))
        beyond = F.col("by1") <= F.col("cy0") - 2 if up else F.col("by0") >= F.col("cy1") + 2
        counts = beyond & (F.least("bx1", "cx1") - F.greatest("bx0", "cx0") > 0) & (F.coalesce("size", F.lit(0.0)) >= F.col("body_size") * 0.8)
        # what is farther off than the search goes decides nothing
        near = meets(c.select(*keys, "cx0", "cy0", "cx1", "cy1", "body_size"), text, _grown(rect("c"), 0.0, SEARCH), rect("b")).where(counts)
        known = near.groupBy(*keys).agg((F.max("by1") if up else F.min("by0")).alias("_e"))
        limit = F.greatest(F.col("py0"), F.col("cy0") - SEARCH) if up else F.least(F.col("py1"), F.col("cy1") + SEARCH)
        edge = c.join(known, keys, "left").withColumn("_edge", (F.greatest if up else F.least)(limit, F.coalesce("_e", limit)))
        lo, hi = ("_edge", "cy0") if up else ("cy1", "_edge")
        every = blocks.select(*PAGE, *(F.col(x).alias(f"b{x}") for x in ("x0", "y0", "x1", "y1")))
        band = lambda y0, y1: (F.lit(0.0), F.col(y0), F.lit(0.0), F.col(y1))  # noqa: E731  the whole width of the page
        between = meets(edge.select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi")), every, band("_lo", "_hi"), band("by0", "by1")).where("_lo <= by0 and by1 <= _hi")
        out = edge.join(between.groupBy(*keys).agg(F.min("bx0").alias("_l"), F.max("bx1").alias("_r")), keys, "left")
        out = out.select(*keys, (F.least("cx0", F.coalesce("_l", "cx0")) - PADDING).alias("x0"), F.col(lo).alias("y0"), (F.greatest("cx1", F.coalesce("_r", "cx1")) + PADDING).alias("x1"), F.col(hi).alias("y1"), "px0", "py0", "px1", "py1")
        return padded(out.where(f"x1 > x0 and y1 - y0 >= {LEAST_HEIGHT}"), 0.0).select(*keys, "x0", "y0", "x1", "y1", F.lit("above" if up else "below").alias("source"))

    rest = raster.unionByName(gap(True)).unionByName(gap(False)).join(drawn.select(*keys), keys, "left_anti")
    order = F.when(F.col("source") == "raster", 0).when(F.col("source") == "above", 1).otherwise(2)
    rest = rest.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(area(*rect(""))), order))).where("_r = 1").drop("_r")
    return drawn.unionByName(rest)
