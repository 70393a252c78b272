"""Grid joins of rectangles against all pairs, and pages with very many rectangles."""

import random
import time

from pyspark.sql import functions as F

from lectern.operators import geometry as G

RECTS = "doc_id long, page int, region_id long, x0 double, y0 double, x1 double, y1 double"


def rects(seed, n, pages=3):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        x, y, size = rnd.uniform(-20, 600), rnd.uniform(-20, 800), rnd.choice([0, 3, 15, 16, 40, 300, 5000])
        w, h = rnd.uniform(0, size), rnd.uniform(0, size)
        x, y = (round(v / 8) * 8.0 for v in (x, y)) if rnd.random() < 0.3 else (x, y)  # edges on cells
        row = [x, y, x + w, y + h]
        if rnd.random() < 0.05:
            row = [row[2], row[1], row[0], row[3]]
        if rnd.random() < 0.03:
            row[rnd.randrange(4)] = None
        out.append((rnd.choice([1, None, 2]) if k % 20 == 0 else 1, rnd.randrange(pages), k, *row))
    return out


def test_meeting_is_all_pairs_that_meet(spark):
    a, b = rects(1, 180), rects(2, 170)
    df = lambda rows, p: spark.createDataFrame(rows, RECTS).select("doc_id", "page", F.col("region_id").alias(f"{p}id"), *(F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1"))).repartition(3)
    got = [(r.aid, r.bid) for r in G.meeting(df(a, "a"), df(b, "b"), G.rect("a"), G.rect("b")).collect()]

    def meet(p, q):
        if None in (*p, *q) or p[:2] != q[:2]:
            return False
        low, high = (lambda r, i: min(r[3 + i], r[5 + i])), (lambda r, i: max(r[3 + i], r[5 + i]))
        return all(max(low(p, i), low(q, i)) <= min(high(p, i), high(q, i)) for i in (0, 1))

    want = [(p[2], q[2]) for p in a for q in b if meet(p, q)]
    assert sorted(got) == sorted(want) and len(want) > 300


def test_components_are_those_of_all_pairs(spark):
    rows = [r for r in rects(3, 160) if None not in r and max(r[5] - r[3], r[6] - r[4]) < 60]
    got = {r.region_id: r.component for r in G.panel_components(spark.createDataFrame(rows, RECTS)).collect()}
    near = lambda p, q: p[:2] == q[:2] and all(max(p[i], q[i]) - min(p[i + 2], q[i + 2]) <= G.PANEL_GAP for i in (3, 4))
    root = {r[2]: r[2] for r in rows}
    for _ in rows:
        root = {p[2]: min([root[p[2]], *(root[q[2]] for q in rows if near(p, q))]) for p in rows}
    assert got == root and 5 < len(set(root.values())) < len(root)


def test_a_page_of_very_many_rectangles(spark):
    """A lattice of 40,000 small rectangles in chains of ten, and one that covers the page."""
    n = 200
    ids = spark.range(n * n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page"), F.col("id").alias("region_id"), (F.col("id") % n).alias("i"), (F.col("id") / n).cast("int").alias("j"))
    x = F.col("i") * 12 + F.floor(F.col("i") / 10) * 30
    small = ids.select("doc_id", "page", "region_id", x.cast("double").alias("x0"), (F.col("j") * 40).cast("double").alias("y0"), (x + 5).cast("double").alias("x1"), (F.col("j") * 40 + 5).cast("double").alias("y1"))
    began = time.time()
    found = G.panel_components(small)
    sizes = {(r.n, r.parts) for r in found.groupBy("component").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("parts")).collect()}
    assert sizes == {(10, n * n // 10)} and time.time() - began < 240
    whole = spark.createDataFrame([(1, 0, 7, 0.0, 0.0, 1e4, 1e4)], "doc_id long, page int, rect_id long, x0 double, y0 double, x1 double, y1 double")
    blocks = small.withColumns({"ord": F.col("region_id"), "text": F.lit("t")})
    assert len(G.text_inside(whole, blocks).first().text) == 2 * n * n - 1
