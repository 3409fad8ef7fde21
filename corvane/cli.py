"""Command line: ``python -m corvane.cli ingest|search|build|index|nearest ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from corvane import build, vector_index
from corvane.operators import corpus
from corvane.repository import Filters, Publications
from corvane.session import build_session
from corvane.sources import files, sinks


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corvane")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="normalise a tree of document files")
    ingest.add_argument("--input", required=True)
    ingest.add_argument("--output", required=True)
    ingest.add_argument("--report", required=True)
    search = commands.add_parser("search", help="rank publications by a query")
    search.add_argument("--query", required=True)
    search.add_argument("--index", required=True)
    search.add_argument("--type", action="append", default=[])
    search.add_argument("--author", action="append", default=[])
    search.add_argument("--start-date")
    search.add_argument("--end-date")
    search.add_argument("--limit", type=int, default=10)
    make = commands.add_parser("build", help="build what is new of a corpus of admitted chunks from a tree of document files")
    make.add_argument("--input", required=True)
    make.add_argument("--output", required=True)
    make.add_argument("--max-characters", type=int, default=4000)
    make.add_argument("--min-characters", type=int, default=corpus.Thresholds.min_characters)
    index = commands.add_parser("index", help="embed and store the chunks of a built corpus")
    index.add_argument("--corpus", required=True)
    index.add_argument("--output", required=True)
    near = commands.add_parser("nearest", help="rank the chunks of a stored index by a query")
    for name in ("--index", "--query"):
        near.add_argument(name, required=True)
    near.add_argument("--limit", type=int, default=10)
    for command in (index, near):
        command.add_argument("--dimension", type=int, default=8)
        command.add_argument("--chunking-version", default="1")
    args = parser.parse_args(argv)
    spark = build_session("local[*]")
    if args.command == "build":
        sinks.guard_output(args.output, [args.input])
        settings = build.Settings(corpus.Thresholds(min_characters=args.min_characters), args.max_characters)
        sources = lambda: build.file_sources(spark, args.input)
        made = build.build_corpus(sources, build.file_parser(spark, args.input), spark, args.output, settings)
        print(build.summary(made).toJSON().first())
        return
    if args.command in ("index", "nearest"):
        provider = vector_index.hash_axis_provider(args.dimension)
        if args.command == "index":
            chunks = build.open_build(spark, args.corpus).chunks.select(
                F.concat_ws(":", "doc", F.col("chunk_index").cast("string")).alias("chunk_id"),
                F.col("doc").alias("publication_id"),
                "chunk_index",
                "checksum",
                F.lit(args.chunking_version).alias("chunking_version"),
                "text",
            )
            sinks.guard_output(args.output, [args.corpus])
            vector_index.build_index(chunks, args.output, provider, args.chunking_version)
        opened = vector_index.open_index(spark, args.output if args.command == "index" else args.index, provider, args.chunking_version)
        if args.command == "index":
            print(json.dumps({k: opened.manifest[k] for k in ("input_chunks", "indexed_chunks", "skipped_chunks", "content_address")}))
        else:
            opened.search(args.query, provider, args.limit).show(args.limit, truncate=False)
        return
    if args.command == "ingest":
        documents = files.read_documents(files.scan_files(spark, args.input))
        publications = files.normalise_sources(documents)
        sinks.guard_output(args.output, [args.input])
        publications.write.mode("errorifexists").parquet(args.output)
        sinks.write_lines(files.ingestion_report(documents), args.report, ["total"], [args.input])
        return
    rows = spark.read.parquet(args.index)
    absent = {"abstract": "string", "keywords": "array<string>", "authors": "array<string>", "publication_date": "date"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in absent.items() if c not in rows.columns})
    filters = Filters(args.type, args.author, args.start_date, args.end_date)
    Publications(rows).search(args.query, filters, args.limit).show(args.limit, truncate=False)


if __name__ == "__main__":
    main()
