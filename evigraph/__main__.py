"""Command line: ``python -m evigraph COMMAND``."""

from __future__ import annotations

import argparse
import json
import logging
import os

from .config import PRESETS, AgentConfig, FilterConfig, NerConfig, load_ner_config


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("evigraph").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def log_to(path: str | None = None, level: str = "INFO") -> None:
    """Messages of this package with time and place, to the console and, with a path, to a file; once, however often it is called."""
    log = logging.getLogger("evigraph")
    log.setLevel(level)
    have = {getattr(h, "baseFilename", None) for h in log.handlers}
    for target in (None, os.path.abspath(path)) if path else (None,):
        if target not in have:
            handler = logging.FileHandler(target, encoding="utf-8") if target else logging.StreamHandler()
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            log.addHandler(handler)


def preview(spark, folder: str) -> None:
    """The entities and relationships that stand out."""
    from pyspark.sql import functions as F

    from .operators import filtering, metrics

    entities, mentions, pairs = (spark.read.parquet(f"{folder}/{t}") for t in ("entity", "mention", "cooccurrence"))
    metrics.top_entities(entities, mentions, 5).show(truncate=False)
    named = filtering.named(pairs, entities)
    metrics.strongest(named, 5).select("entity_a_name", "entity_b_name", F.col("docs_count").alias("documents")).show(truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evigraph", description="Evidence graphs of document corpora.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str) -> None:
        c = sub.add_parser(name)
        for o in options:
            kind = int if o in ("limit", "docs-min", "sents-min") else str
            c.add_argument(f"--{o}", type=kind, required=o in ("out", "source"))
        c.add_argument("--log")

    command("ingest", "source", "term", "limit", "out")
    command("nlp", "source", "terms", "aliases", "out", "config")
    command("build-kg", "source", "out")
    command("extend-kg", "source", "out")
    command("build-graph", "source", "out", "docs-min", "sents-min")
    command("run-pipeline", "source", "term", "limit", "size", "terms", "aliases", "out", "config")
    command("continue-pipeline", "terms", "aliases", "out", "config")
    command("ask", "source", "question", "aliases")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from .operators import documents, linking
    from .plans import agent, pipeline

    log_to(a.log)
    spark = session()
    config = load_ner_config(a.config) if getattr(a, "config", None) else NerConfig()
    table = spark.read.parquet
    if a.command == "ingest":
        done = pipeline.ingest(spark, a.source, a.term or "", a.limit or PRESETS["quick"], a.out)
    elif a.command == "nlp":
        done = pipeline.annotate_and_link(spark, documents.from_abstracts(table(a.source)), table(a.terms), table(a.aliases), a.out, config)
    elif a.command in ("build-kg", "extend-kg"):
        done = (pipeline.build_kg if a.command == "build-kg" else pipeline.extend_kg)(spark, a.source, a.out)
        if done["entities"]:
            preview(spark, a.out)
    elif a.command == "build-graph":
        done = pipeline.build_graph(spark, a.source, a.out, FilterConfig(a.docs_min or 2, a.sents_min or 2))
    elif a.command == "run-pipeline":
        done = pipeline.run(spark, a.source, a.term or "", a.limit or PRESETS[a.size or "quick"], table(a.terms), table(a.aliases), a.out, config)
    elif a.command == "continue-pipeline":
        done = pipeline.resume(spark, table(a.terms), table(a.aliases), a.out, config)
    else:
        done = agent.ask(pipeline.load_graph(spark, a.source), a.question or "", config=AgentConfig(), concepts=agent.linker(linking.loaded(lambda: table(a.aliases)) if a.aliases else None))
    print(json.dumps(done, indent=1, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
