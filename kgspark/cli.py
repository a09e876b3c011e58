"""``python -m kgspark.cli --root ROOT COMMAND ...``: every retrieval from the command line, one JSON object a line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from kgspark import engine, validate
from kgspark.sources import dump


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kgspark")
    top.add_argument("--root", default=".", help="folder of the snapshots")
    top.add_argument("--kg", default="wikidata")
    top.add_argument("--date", help="of the snapshot, yyyymmdd; the newest if none is given")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *ids: str):
        c = commands.add_parser(name)
        for x in ids:
            c.add_argument(x, nargs="+")
        return c

    build = commands.add_parser("build")
    build.add_argument("dump", help="a file or folder of lines, or - for lines that come through a pipe")
    build.add_argument("date")
    build.add_argument("--add", action="store_true", help="to what the newest snapshot has")
    build.add_argument("--skip-lines", type=int, default=0)
    build.add_argument("--resume-from", help="the first entity to read; goes before --skip-lines")
    look = command("lookup", "names")
    look.add_argument("--limit", type=validate.limit, default=10)
    look.add_argument("--ids", nargs="+")
    for x in ("--kind", "--ner-type", "--types", "--extended-types", "--language", "--query"):
        look.add_argument(x)
    for x in ("--fuzzy", "--soft-filtering", "--normalize-score"):
        look.add_argument(x, action="store_true")
    for name in ("types", "objects", "literals", "sameas"):
        command(name, "entities")
    labels = command("labels", "entities")
    labels.add_argument("--lang")
    labels.add_argument("--category")
    command("predicates", "pairs").epilog = "pairs as SUBJECT,OBJECT"
    bow = command("bow", "entities")
    bow.add_argument("--text", required=True)
    bow.add_argument("--texts", required=True, help="Parquet of (entity, text)")
    command("classify-literals", "literals")
    columns = commands.add_parser("classify-columns")
    columns.add_argument("tables", help="JSON: tables of columns of cells")
    columns.add_argument("--model-type", type=validate.model_type, default="fast")
    command("ner", "texts")
    for name in ("objects-summary", "literals-summary"):
        c = commands.add_parser(name)
        c.add_argument("--entities", nargs="+")
        c.add_argument("--rank-order", default="desc")
        c.add_argument("--k", type=validate.k, default=validate.DEFAULT_K)
    return top


def _lines(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.dump == "-":
        if a.resume_from or a.skip_lines:
            raise ValueError("lines from a pipe cannot be skipped")
        return dump.piped(spark, sys.stdin)
    if a.resume_from:
        return dump.resumed(spark, a.dump, a.resume_from)
    return dump.skipped(spark, a.dump, a.skip_lines) if a.skip_lines > 0 else dump.lines(spark, a.dump)


def answered(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    g = engine.KnowledgeGraph(spark, a.root, a.kg, a.date if a.command != "build" else None)
    match a.command:
        case "build":
            return (engine.extend if a.add else engine.build)(_lines(spark, a), a.root, a.kg, a.date)
        case "lookup":
            return g.lookup(a.names, a.limit, a.fuzzy, a.kind, a.ner_type, a.types, a.extended_types, a.language, a.ids, a.query, a.soft_filtering, a.normalize_score).orderBy("mention_id", "position")
        case "types" | "objects" | "literals" | "sameas":
            return getattr(g, a.command)(a.entities)
        case "labels":
            return g.labels(a.entities, a.lang, a.category)
        case "predicates":
            return g.predicates([tuple(p.split(",")) for p in a.pairs])
        case "bow":
            return g.bow(a.text, a.entities, spark.read.parquet(a.texts))
        case "classify-literals":
            return g.classify_literals(a.literals)
        case "classify-columns":
            return g.classify_columns(json.loads(a.tables))
        case "ner":
            return g.recognize_entities(a.texts)
        case "objects-summary":
            return g.objects_summary(a.entities, a.rank_order, a.k)
        case "literals-summary":
            return g.literals_summary(a.entities, a.rank_order, a.k)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    found = answered(SparkSession.builder.appName("kgspark").getOrCreate(), a)
    if found is not None:
        for row in found.toJSON().toLocalIterator():
            sys.stdout.write(row + "\n")


if __name__ == "__main__":
    main()
