"""From documents to reviewed decks, for a whole corpus at once.

Every stage is one DataFrame step over all documents, written to the shared folder where a model has
answered. A deck is a group (doc_id, deck_id): single mode has one per document, multi mode one per
chapter, so both are the same plan: analyse chunks, merge the maps by chapter and document, plan slides with
figures from a catalog, write in batches, review and refine in cycles, summarise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.model.client import Client
from lectern.operators import chunking, figures, library, reviews, sections
from lectern.plans.stages import Stages
from lectern.sources import writers
from lectern.sources.registry import Settings
from lectern.storage import Scratch

DECK = ["doc_id", "deck_id"]
IMAGE = "doc_id long, figure_id long, ord long, caption string, page long, data_uri string"
_MAP = "core_thesis string, key_concepts array<string>, summary string, figure_purposes map<string,string>"
_PLANNED = "array<struct<index:long,tag:string,source_section:string,intention:string,emphasis:string,chunk_indices:array<long>,figure_ids:array<long>>>"
_SLIDES = "array<struct<index:long,tag:string,heading:string,body:string,latex:string>>"
_REVIEWS = "array<struct<index:long,passed:boolean,issues:array<struct<type:string,detail:string>>>>"


def outline_of(docs: DataFrame) -> DataFrame:
    """doc_id, ord, position, level, heading from the `#` and `##` lines of the texts; position is the ordinal."""
    heads = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?mdU)^(#{1,2}\s+\S[^\n]*)"), 1)).alias("ord", "l"))
    level = F.length(F.regexp_extract("l", "^(#+)", 1))
    return heads.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("ord").cast("long").alias("position"), level.alias("level"), T.strip(F.regexp_replace("l", r"^#+", "")).alias("heading"))


def scope_of(chapter: Column) -> Column:
    """What the planner is told when a deck covers one chapter; empty for a whole document."""
    named = F.format_string('Plan slides for the chapter "%s" and no other. Keep its definitions and terms in line with the outline of the whole document.', chapter)
    return F.when(chapter != "", named).otherwise(F.lit(""))


def _payload(prompts: dict[str, str], task: str, **fields: Column) -> Column:
    """The JSON of a call; with a template for the task, its text with $names filled in goes along."""
    values = [v.alias(k) for k, v in fields.items()]
    if prompts.get(task):
        plain = {k: v if k not in ("slides", "flagged", "chunks", "headings") else F.to_json(v) for k, v in fields.items()}
        values.append(T.substitute(prompts[task], plain).alias("prompt"))
    return F.to_json(F.struct(*values)).alias("payload")


def ordered(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """keys, name: the values of each key as a list, in order."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), value.alias("_v"))))
    return rows.groupBy(*keys).agg(F.transform(held, lambda x: x["_v"]).alias(name))


#: Maps that one call merges at most; more are merged in levels.
FAN_IN = 40


def merged_in_levels(steps: Stages, maps: DataFrame, keys: list[str], name: str, task: str, payload: Column) -> tuple[DataFrame, DataFrame]:
    """(keys, ord, map) with at most FAN_IN rows for each key, and (keys, error) of calls that failed, from maps(keys, ord, map).

    Each level merges neighbours, FAN_IN at a time, in one wave of calls; keys with no more stay as they are. `payload` is
    made of keys and maps, the list of one call. So no call, row or group holds all maps of a chapter, however many it has.
    """
    errors, level = [], 0
    while True:
        place = F.row_number().over(W.partitionBy(*keys).orderBy("ord")) - 1
        maps = steps.kept(maps.select(*keys, "ord", "map", place.alias("_at"), F.count("*").over(W.partitionBy(*keys)).alias("_n")), f"{name}-{level}")
        large = maps.where(F.col("_n") > FAN_IN)
        if large.isEmpty():
            break
        asked = ordered(large.withColumn("ord", F.floor(F.col("_at") / FAN_IN)), [*keys, "ord"], "_at", F.col("map"), "maps")
        said = steps.answers(asked.select(*keys, "ord", payload), f"{name}-merged-{level}", task, [*keys, "ord"])
        errors.append(said.where("error is not null").select(*keys, "error"))
        whole = maps.where(F.col("_n") <= FAN_IN).select(*keys, F.col("ord").cast("long").alias("ord"), "map")
        maps, level = whole.union(said.where("error is null").select(*keys, "ord", F.col("answer").alias("map"))), level + 1
    lost = maps.select(*keys, F.lit(None).cast("string").alias("error")).where("false")
    for more in errors:
        lost = lost.union(more)
    return maps.select(*keys, "ord", "map"), lost


def decks(docs: DataFrame, client: Client, settings: Settings = Settings(), *, images: DataFrame | None = None, prompts: dict[str, str] | None = None, root: str | None = None, key: str = "run", resume: bool = False) -> DataFrame:
    """doc_id, deck_id, mode, chapter, title, doc_hash, error, slides, images, unresolved of docs(doc_id, text).

    images(schema IMAGE) are the figures that texts tag. slides are in order of the plan, the summary last. A chapter or
    document with a model call that failed has its error and no slides; the others go on. Stages are kept below
    root/key; resume goes on from what an earlier run has kept there.
    """
    prompts = prompts or {}
    steps = Stages(docs, client, settings, root=root, key=key, resume=resume)
    images = images if images is not None else docs.sparkSession.createDataFrame([], IMAGE)
    docs = docs.where("text is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    chunks = steps.kept(chunking.chunk_sections(docs, settings.chunk_size, settings.overlap_size), "chunks", fixed=True)
    outline = outline_of(docs)
    if not settings.ordinal_positions:
        firsts = chunks.where("section > 0").groupBy("doc_id", (F.col("section") - 1).alias("ord")).agg(F.min("chunk_idx").alias("_at"))
        outline = outline.join(firsts, ["doc_id", "ord"], "left").withColumn("position", F.coalesce("_at", "position")).drop("_at")
    outline = steps.kept(outline, "outline", fixed=True)
    tops = outline.where("level = 1").groupBy("doc_id").agg(F.count("*").alias("chapters"))
    chars = chunks.groupBy("doc_id").agg(F.sum(F.char_length("chunk").cast("long")).alias("total_chars"))
    routes = sections.routed(chars.join(tops, "doc_id", "left").withColumn("chapters", F.coalesce("chapters", F.lit(0))), most_chapters=settings.chapters_for_multi, most_chars=settings.chars_for_multi)
    titles = sections.skeleton(outline, docs.select("doc_id", F.lit(None).cast("string").alias("title")))
    headings = ordered(outline, ["doc_id"], "ord", F.col("heading"), "headings")
    placed = sections.chapter_of(chunks.drop("section").join(routes.select("doc_id", "mode"), "doc_id"), outline)
    placed = placed.withColumn("deck", F.when(F.col("mode") == "multi", F.col("chapter")).otherwise(F.lit("")))
    number = F.dense_rank().over(W.partitionBy("doc_id").orderBy("_first")) - 1
    firsts = placed.groupBy("doc_id", "deck").agg(F.min("chunk_idx").alias("_first")).withColumn("deck_id", number.cast("long")).drop("_first")
    placed = placed.join(firsts, ["doc_id", "deck"]).join(titles, "doc_id", "left").withColumn("title", F.coalesce(F.nullif("deck", F.lit("")), "title", F.lit("Untitled")))
    placed = steps.kept(placed, "placed", fixed=True)

    # chunks are analysed under the headings that matter there, their maps merged by chapter, then by document
    # the outline goes to a document's chunks as one list, of which each takes its part: no row is made for a chunk and a section
    starts = sections.outline_starts(chunks.select("doc_id", "chunk_idx"), outline)
    toc = ordered(outline, ["doc_id"], "ord", F.struct("level", "position", "heading"), "toc")
    asked = placed.join(starts, ["doc_id", "chunk_idx"], "left").join(toc, "doc_id", "left")
    near = F.transform(F.filter("toc", lambda x: (x["level"] == 1) | (x["position"] >= F.col("start"))), lambda x: x["heading"])
    asked = asked.withColumn("headings", F.coalesce(near, F.array().cast("array<string>")))
    asked = asked.select(*DECK, "chunk_idx", "chapter", _payload(prompts, "analyse", text=F.col("chunk"), title=F.col("title"), chunk_index=F.col("chunk_idx") + 1, headings=F.col("headings")))
    maps = steps.answers(asked, "maps", "analyse", [*DECK, "chunk_idx", "chapter"]).withColumn("m", F.from_json("answer", _MAP))
    whole = F.to_json(F.struct("m.core_thesis", "m.key_concepts"))  # without the figures' purposes
    merge = lambda task: _payload(prompts, task, **({"chapter": F.col("chapter")} if task == "merge_chapter" else {}), maps=F.col("maps"))
    single, lost_parts = merged_in_levels(steps, maps.where("error is null").select("doc_id", "chapter", F.col("chunk_idx").alias("ord"), whole.alias("map")), ["doc_id", "chapter"], "chapter-maps", "merge_chapter", merge("merge_chapter"))
    parts = ordered(single, ["doc_id", "chapter"], "ord", F.col("map"), "maps").join(maps.groupBy("doc_id", "chapter").agg(F.min("chunk_idx").alias("_first")), ["doc_id", "chapter"])
    several = chunks.groupBy("doc_id").agg((F.count("*") > 1).alias("_several"))
    parts = steps.kept(parts.join(several, "doc_id"), "parts")
    merged = steps.answers(parts.where("_several").select("doc_id", "chapter", "_first", _payload(prompts, "merge_chapter", chapter=F.col("chapter"), maps=F.col("maps"))), "chapters", "merge_chapter", ["doc_id", "chapter", "_first"])
    chapters, lost_chapters = merged_in_levels(steps, merged.where("error is null").select("doc_id", F.col("_first").alias("ord"), F.col("answer").alias("map")), ["doc_id"], "document-maps", "merge_document", merge("merge_document"))
    both = ordered(chapters, ["doc_id"], "ord", F.col("map"), "maps")
    document = steps.answers(both.select("doc_id", _payload(prompts, "merge_document", maps=F.col("maps"))), "documents", "merge_document", ["doc_id"])
    alone = parts.where("not _several").select("doc_id", F.get("maps", F.lit(0)).alias("answer"))
    doc_map = document.where("error is null").select("doc_id", "answer").union(alone).select("doc_id", F.col("answer").alias("doc_map"))
    failed = maps.select(*DECK, "error").where("error is not null")
    lost = merged.select("doc_id", "error").union(document.select("doc_id", "error")).union(lost_parts.select("doc_id", "error")).union(lost_chapters).where("error is not null").groupBy("doc_id").agg(F.min("error").alias("_lost"))

    heads = placed.groupBy(*DECK, "mode", "title", F.col("deck").alias("chapter")).agg(F.sort_array(F.collect_list("chunk_idx")).alias("chunks"))
    heads = heads.join(failed.groupBy(*DECK).agg(F.min("error").alias("error")), DECK, "left").join(lost, "doc_id", "left").withColumn("error", F.coalesce("error", "_lost")).drop("_lost")
    heads = steps.kept(heads.join(doc_map, "doc_id", "left"), "heads")

    # the catalog of each document's figures, and a plan for each deck that may ask for them
    tagged = chunks.select("doc_id", "chunk_idx", F.explode(T.figure_tags(F.col("chunk"))).alias("figure_id"))
    purposes = maps.select("doc_id", "chunk_idx", F.explode("m.figure_purposes").alias("figure_id", "purpose")).withColumn("figure_id", F.col("figure_id").try_cast("long")).where("figure_id is not null and purpose is not null")
    catalog = steps.kept(figures.figure_catalog(images, tagged, purposes), "catalog")
    asked = heads.where("error is null").join(headings, "doc_id", "left").join(figures.format_catalog(catalog), "doc_id", "left")
    fields = dict(title=F.col("title"), chunks=F.col("chunks"), doc_map=F.col("doc_map"), headings=F.coalesce("headings", F.array().cast("array<string>")), scope_instruction=scope_of(F.col("chapter")), figure_catalog=F.coalesce("catalog", F.lit("(no figures)")), max_slides=F.lit(settings.max_slides))
    plans = steps.answers(asked.select(*DECK, _payload(prompts, "plan", **fields)), "plans", "plan", DECK)
    planned = plans.select(*DECK, F.posexplode(F.from_json("answer", f"slides {_PLANNED}")["slides"]).alias("ord", "s")).select(*DECK, F.struct(*DECK).alias("deck"), "ord", "s.*").withColumnRenamed("index", "slide_index")
    planned = steps.kept(planned, "planned")
    requests = planned.select("deck", "slide_index", "chunk_indices", F.explode("figure_ids").alias("figure_id"))
    choices = heads.select("doc_id", F.struct(*DECK).alias("deck")).join(catalog, "doc_id")
    owned = figures.capped_figures(figures.figure_owners(requests, choices, key="deck"), key="deck")
    refs = ordered(owned, ["deck", "slide_index"], "place", F.col("figure_id"), "figure_ids").select("deck.*", "slide_index", "figure_ids")

    # drafts in batches of slides with the chunks that they draw on
    batched = reviews.batches(planned, settings.writer_batch, key=DECK, order="ord")
    line = F.format_string("Slide %d [%s] %s: %s", "slide_index", "tag", F.coalesce("source_section", F.lit("")), F.coalesce("intention", F.lit("")))
    groups = batched.groupBy(*DECK, "batch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]).alias("lines"), F.array_sort(F.collect_list(F.struct("ord", F.col("slide_index").alias("index"), "tag", "intention"))).alias("slides"), F.flatten(F.collect_list("chunk_indices")).alias("chunk_indices")
    )
    groups = groups.withColumn("slide_index", F.struct("deck_id", "batch"))
    texts = figures.source_chunks(groups, chunks, empty="")
    asked = groups.join(texts, ["doc_id", "slide_index"]).join(heads.select(*DECK, "doc_map"), DECK)
    asked = asked.select(*DECK, "batch", _payload(prompts, "write", doc_map=F.col("doc_map"), batch_plan=F.array_join("lines", "\n"), slides=F.transform("slides", lambda s: s.dropFields("ord")), source_text=F.col("context")))
    wrote = steps.answers(asked, "writes", "write", [*DECK, "batch"])
    draft = _slides(wrote, [*DECK, "batch"]).withColumn("ord", F.col("batch") * 1000 + F.col("_at")).drop("batch", "_at").withColumn("image_refs", F.array().cast("array<long>"))
    draft = steps.kept(reviews.with_planned_figures(draft, refs, key=DECK), "draft")
    errors = wrote.select(*DECK, "error").union(plans.select(*DECK, "error"))

    # the summary waits until all others are reviewed; what fails is refined, at most review_cycles - 1 times
    content, _ = reviews.split_summary(planned, key=DECK)
    summary = planned.join(content.select(*DECK, "ord"), [*DECK, "ord"], "left_anti").select(*DECK, "slide_index")
    draft = draft.join(summary, [*DECK, "slide_index"], "left_anti")
    sources = planned.select("doc_id", F.struct("deck_id", "slide_index").alias("slide_index"), "chunk_indices")
    sources = figures.source_chunks(sources, chunks).select("doc_id", "slide_index.*", "context")
    sources = steps.kept(sources.withColumn("l", F.format_string("[slide %d]\n%s", "slide_index", "context")), "sources")
    verdict = None
    for cycle in range(1, settings.review_cycles + 1):
        asked = _whole(draft).join(_context(sources, draft), DECK, "left").join(heads.select(*DECK, "doc_map"), DECK)
        said = steps.answers(asked.select(*DECK, _payload(prompts, "review", doc_map=F.col("doc_map"), slides=F.col("slides"), source_chunks=F.col("sources"), cycle=F.lit(cycle))), f"reviews{cycle}", "review", DECK)
        errors = errors.union(said.select(*DECK, "error"))
        rows = said.select(*DECK, F.explode(F.from_json("answer", f"slides {_REVIEWS}")["slides"]).alias("r")).select(*DECK, F.col("r.index").alias("slide_index"), F.coalesce("r.passed", F.lit(False)).alias("passed"), F.coalesce("r.issues", F.array().cast("array<struct<type:string,detail:string>>")).alias("issues"))
        verdict = steps.kept(rows, f"verdict{cycle}")
        flagged = reviews.failed(verdict)
        if cycle == settings.review_cycles or flagged.isEmpty():
            break
        only = draft.join(flagged.select(*DECK, "slide_index"), [*DECK, "slide_index"], "left_semi")
        asked = _whole(only).withColumnRenamed("slides", "flagged").join(_whole(draft), DECK).join(reviews.critiques(flagged, *DECK), DECK).join(_context(sources, only), DECK, "left").join(heads.select(*DECK, "doc_map"), DECK)
        asked = asked.select(*DECK, _payload(prompts, "refine", doc_map=F.col("doc_map"), slides=F.col("slides"), flagged=F.col("flagged"), critiques=F.col("critique"), source_chunks=F.col("sources"), deck_feedback=F.lit("none")))
        fixed = steps.answers(asked, f"refines{cycle}", "refine", DECK)
        errors = errors.union(fixed.select(*DECK, "error"))
        fixes = _slides(fixed, DECK).groupBy(*DECK, "slide_index").agg(F.max_by(F.struct("tag", "heading", "body", "latex"), "_at").alias("f")).select(*DECK, "slide_index", "f.*")
        draft = steps.kept(reviews.corrected(draft, fixes, key=[*DECK, "slide_index"], fields=["tag", "heading", "body", "latex"]), f"draft{cycle}")

    asked = _whole(draft).join(summary, DECK).select(*DECK, "slide_index", _payload(prompts, "summarise", slides=F.col("slides"), summary_index=F.col("slide_index")))
    closing = steps.answers(asked, "summaries", "summarise", [*DECK, "slide_index"])
    errors = errors.union(closing.select(*DECK, "error"))
    last = _slides(closing.drop("slide_index"), DECK).where("_at = 0").drop("_at").withColumns({"ord": F.lit(1 << 40).cast("long"), "image_refs": F.array().cast("array<long>")})
    final = steps.kept(draft.unionByName(last.select(*draft.columns)), "final")

    fields = ["index", "tag", "heading", "body", "latex", "image_refs"]
    slides = ordered(final.withColumnRenamed("slide_index", "index"), DECK, "ord", F.struct(*fields), "slides")
    shown = figures.referenced_images(heads.select(*DECK).join(images, "doc_id"), final.select(*DECK, F.explode("image_refs").alias("figure_id")).distinct(), [*DECK, "figure_id"])
    shown = ordered(shown, DECK, "figure_id", F.struct(F.col("figure_id").alias("index"), "caption", "page", "data_uri"), "images")
    none = F.array().cast("array<struct<index:long,caption:string,page:long,data_uri:string>>")
    out = heads.join(errors.groupBy(*DECK).agg(F.min("error").alias("_error")), DECK, "left").withColumn("error", F.coalesce("error", "_error")).join(slides, DECK, "left").join(shown, DECK, "left")
    open_ = F.array().cast("array<string>")
    if verdict is not None:
        out = out.join(ordered(reviews.unresolved(verdict, *DECK), DECK, "slide_index", F.col("note"), "unresolved"), DECK, "left")
        open_ = F.coalesce("unresolved", open_)
    hashes = docs.select("doc_id", library.content_hash(F.col("text").cast("binary")).alias("doc_hash"))
    good = F.col("error").isNull()
    title = plans.select(*DECK, F.substring(F.from_json("answer", "title string")["title"], 1, 60).alias("_title"))
    out = out.join(hashes, "doc_id").join(title, DECK, "left")
    return out.select(*DECK, "mode", "chapter", F.coalesce("_title", "title").alias("title"), "doc_hash", "error", F.when(good, F.col("slides")).alias("slides"), F.when(good, F.coalesce("images", none)).alias("images"), F.when(good, open_).alias("unresolved"))


def _slides(answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _at, slide_index, tag, heading, body, latex of the slides in answers."""
    rows = answers.select(*keys, F.posexplode(F.from_json("answer", f"slides {_SLIDES}")["slides"]).alias("_at", "s"))
    return rows.select(*keys, F.col("_at").cast("long").alias("_at"), F.col("s.index").alias("slide_index"), "s.tag", "s.heading", "s.body", "s.latex")


def _whole(draft: DataFrame) -> DataFrame:
    """A deck's slides in order, as one list."""
    return ordered(draft, DECK, "ord", F.struct(F.col("slide_index").alias("index"), "tag", "heading", "body", "latex", "image_refs"), "slides")


def _context(sources: DataFrame, draft: DataFrame) -> DataFrame:
    """The source texts behind a deck's slides."""
    mine = sources.join(draft.select(*DECK, "slide_index"), [*DECK, "slide_index"], "left_semi")
    return ordered(mine, DECK, "slide_index", F.col("l"), "_l").select(*DECK, F.array_join("_l", "\n\n").alias("sources"))


def run(docs: DataFrame, client: Client, settings: Settings, path: str, *, stamp: str, generated_at: str, debug: bool = False, **how) -> DataFrame:
    """Makes decks of docs, publishes them below path and brings the manifest (path/library) up to date; returns decks().

    With the duplicate policy "overwrite", older outputs of the same content go, but only once the new ones and
    their manifest rows are there; archived ones stay. A run that is cut short at any step loses no older deck.
    """
    spark = docs.sparkSession
    made = Scratch(spark, "run").save(decks(docs, client, settings, **how), "decks")
    published = writers.publish_decks(made, path, stamp=stamp, generated_at=generated_at, provider=settings.provider, model=settings.model, debug=debug)
    entries = library_entries(published, generated_at=generated_at, provider=settings.provider, model=settings.model)
    manifest = f"{path}/library"
    entries = Scratch(spark, "run").save(entries, "entries")
    writers.update_library(spark, manifest, lambda held: library.upserted(held, entries))
    if settings.duplicate_policy == "overwrite":
        mine = entries.select("doc_hash", F.col("file").alias("keep_file"))
        held = Scratch(spark, "run").save(writers.read_library(spark, manifest), "held")
        stale = Scratch(spark, "run").save(held.join(library.pruned(held, mine).select("file"), "file", "left_anti").select("file"), "stale")
        writers.update_library(spark, manifest, lambda held: held.join(stale, "file", "left_anti").select(*held.columns))
        writers.delete_outputs(spark, path, stale)
    return made


def library_entries(published: DataFrame, *, generated_at: str, provider: str, model: str) -> DataFrame:
    """Manifest rows (schema ENTRY) of published decks: one for each document, the titles of its first deck."""
    docs = published.groupBy("doc_id", "mode", "doc_hash", "file").agg(F.min_by("title", "deck_id").alias("title"), F.sum(F.size("slides")).cast("long").alias("slide_count"), F.count("*").alias("deck_count"))
    return docs.select(
        "title", "file", F.when(F.col("mode") == "multi", "multi_deck").otherwise("single_deck").alias("type"), F.lit(generated_at).alias("generated_at"), F.lit(provider).alias("provider"), F.lit(model).alias("model"),
        "doc_hash", "slide_count", "deck_count", F.lit(False).alias("archived"),
    )
