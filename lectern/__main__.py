"""Command line: estimate the cost of a folder of texts, run the deck plan, refresh a library."""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import functions as F

from lectern.operators import library
from lectern.session import local_session, ship
from lectern.sources import readers, registry, writers


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lectern", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in (("estimate", "tokens and cost of the documents below a path"), ("run", "decks of the documents below a path"), ("library-refresh", "rebuild the manifest of a folder of decks")):
        c = sub.add_parser(name, help=about)
        c.add_argument("path")
        c.add_argument("--settings", help="a JSON file of settings")
        c.add_argument("--out", help="where to write")
        c.add_argument("--fast", action="store_true", help="review once, refine never")
        c.add_argument("--provider", help="a provider by name; stub needs no model")
        c.add_argument("--max-concurrent", type=int, help="calls at a time")
        c.add_argument("--prompts", help="a folder of prompt templates")
        c.add_argument("--cache", help="where stages are kept from run to run")
        c.add_argument("--resume", action="store_true", help="go on from the stages in the cache")
        c.add_argument("--force", action="store_true", help="start anew, whatever the cache holds")
        c.add_argument("--debug", action="store_true", help="write intermediate results next to the decks")
    a = p.parse_args(arguments)
    changes = {"review_cycles": 1} if a.fast else {}
    changes |= {"max_concurrent": a.max_concurrent} if a.max_concurrent else {}
    said = registry.settings(a.settings, **changes)
    if a.provider:
        said = replace(said, provider=a.provider, models={"stub": "stub"} | said.models)
        if a.provider not in said.models:
            p.error(f"unknown provider {a.provider!r}; there are: {', '.join(said.models)}")
    spark = local_session()
    ship(spark)
    if a.command == "estimate":
        from lectern.plans.estimate import estimated

        docs = registry.extractor("text")(spark, a.path).withColumn("source", F.lit(a.path))
        models = spark.createDataFrame([(a.path, said.provider, said.model)], "source string, provider string, model string")
        estimated(docs, models, size=said.chunk_size, overlap=said.overlap_size).show(truncate=False)
    elif a.command == "run":
        from lectern.model.providers import client_for
        from lectern.plans import decks

        docs = registry.extractor("text")(spark, a.path)
        client = client_for(said.provider, said.model, timeout=said.timeout)
        how = {"prompts": registry.prompts(a.prompts) if a.prompts else None}
        if a.cache:
            whole = docs.agg(F.concat_ws("-", F.count("*"), F.bit_xor(F.xxhash64("doc_hash")), F.sum(F.xxhash64(F.lit(1), "doc_hash") % 1_000_003)).alias("h"))
            key = whole.select(library.run_key(F.col("h"), said.model, said.chunk_size, said.overlap_size, "text")).first()[0]
            how |= {"root": a.cache, "key": key, "resume": a.resume and not a.force}
        if a.out:
            now = datetime.now(timezone.utc)
            made = decks.run(docs, client, said, a.out, stamp=now.strftime("%Y%m%dT%H%M%S"), generated_at=now.isoformat(), debug=a.debug, **how)
            if a.cache:  # all is written: the stages have done their work
                writers.clear_stages(spark, a.cache, key)
                writers.point_to(spark, a.cache, key, a.out)
        else:
            made = decks.decks(docs, client, said, **how)
        made.select("doc_id", "mode", "title", "error", F.size("slides").alias("slides")).show(truncate=False)
    else:
        found = readers.rebuilt_library(spark, a.path)
        writers.write_library(found, a.out) if a.out else found.show(truncate=False)


if __name__ == "__main__":
    main()
