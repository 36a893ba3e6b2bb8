"""Command line: catalog of a folder tree, ingest of a folder of documents into an index."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellum.config import Settings
from vellum.operators.index import save_index
from vellum.plans.ingest import ingest
from vellum.sources.catalog import scan_catalog
from vellum.sources.documents import TextPages, read_documents


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vellum", description=__doc__)
    todo = parser.add_subparsers(dest="what", required=True)
    listing = todo.add_parser("catalog", help="classes and subjects found below a folder")
    listing.add_argument("root")
    load = todo.add_parser("ingest", help="read one folder of documents into an index")
    load.add_argument("folder")
    load.add_argument("index")
    load.add_argument("--pattern", default="*.pdf")
    load.add_argument("--class", dest="klass", default="10")
    load.add_argument("--subject", default="Science")
    load.add_argument("--lang", default="en")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(Settings.from_env().app_name).getOrCreate()
    if args.what == "catalog":
        scan_catalog(spark, args.root).orderBy("class", "subject", "language").show(1000, truncate=False)
        return 0
    settings = Settings.from_env()
    scans = read_documents(spark, args.folder, TextPages(), args.pattern, args.lang or settings.ocr_language, settings.ocr_dpi).withColumn("doc_id", F.xxhash64("pdf_path"))
    chunks = ingest(scans.where("error is null"), settings)
    save_index(chunks.withColumns({"class": F.lit(args.klass), "subject": F.lit(args.subject), "lang": F.lit(args.lang)}), args.index, mode="append")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
