"""Command line: ``python -m gleaner.cli {strip,chunk,ingest,query,index,compact} ...`` for spark-submit or a shell."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .config import corpus_settings
from .operators import chunk, corpus, embed, strip
from .plans import ingest as plan
from .session import get_session, ship, temporary
from .sources import files


def _corpus(spark, settings, embedder):
    return corpus.Corpus(spark, settings.path, embed.collection_of(embedder, settings.collection_prefix))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gleaner")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, what in (("strip", "pages (Parquet: url, html)"), ("chunk", "saved extraction results (JSON)"), ("ingest", "pages (Parquet: url, html)")):
        sub.add_parser(name).add_argument("path", help=what)
    ask = sub.add_parser("query")
    ask.add_argument("text")
    ask.add_argument("-k", type=int, default=5)
    sub.add_parser("index", help="make an index of the collection; stores and queries use it from then on")
    sub.add_parser("compact", help="rewrite buckets of several layers and drop old versions")
    args = parser.parse_args(argv)
    with temporary():
        return run(ship(get_session()), args)


def run(spark, args) -> int:
    """One command; what it leaves in the shared folder goes when it is done."""
    settings = corpus_settings()
    if args.command == "strip":
        strip.strip_pages(spark.read.parquet(args.path)).select("url", "title", "outcome", "method", "chars_before", "chars_after").show(50, False)
    elif args.command == "chunk":
        chunk.chunk_results(files.read_results(spark, args.path), settings.max_chunk_chars).select("chunk_id", "source_url", "section_index", "chunk_index", "chunk_total").show(50, False)
    elif args.command == "ingest":
        embedder = embed.load_embedder(settings)
        done = plan.ingest(plan.fetch_offline(spark.read.parquet(args.path)), corpus=settings, embedder=embedder)
        stored = _corpus(spark, settings, embedder).store(done.chunks)
        done.outcomes.groupBy("status").count().orderBy("status").show()
        print(f"stored_chunks={stored}")
    elif args.command == "index":
        print(f"version={_corpus(spark, settings, embed.load_embedder(settings)).build_index()}")
    elif args.command == "compact":
        collection = _corpus(spark, settings, embed.load_embedder(settings))
        print(f"version={collection.compact()} deleted_folders={collection.vacuum()}")
    else:
        embedder = embed.load_embedder(settings)
        collection = _corpus(spark, settings, embedder)
        one = spark.createDataFrame([(0, [float(x) for x in embedder.embed([args.text])[0]])], "query_id int, query_vector array<double>")
        rows = collection.read().join(F.broadcast(collection.search(one, args.k)), F.col("chunk_id") == F.col("hit_id")).orderBy("rank")  # k rows
        for r in rows.select(F.round("distance", 4).alias("distance"), "source_url", F.substring(F.regexp_replace("content", r"\s+", " "), 1, 200).alias("text")).collect():
            print(r["distance"], r["source_url"], r["text"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
