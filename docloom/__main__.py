"""Command line: ``python -m docloom corpus|duplicates|pages|convert|tokens ...``."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.config import CorpusConfig, DuplicateConfig
from docloom.operators import quality
from docloom.plans import pipeline
from docloom.sources import files as S


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docloom")
    sub = parser.add_subparsers(dest="command", required=True)
    corpus = sub.add_parser("corpus", help="index, segment, count, score and report a folder of Markdown")
    corpus.add_argument("--input-dir", required=True)
    corpus.add_argument("--out-dir", required=True)
    corpus.add_argument("--old-index", default="")
    corpus.add_argument("--candidate-limit", type=int, default=60)
    corpus.add_argument("--max-tfidf-features", type=int, default=5000)
    corpus.add_argument("--expected-document-count", type=int, default=1059)
    corpus.add_argument("--dictionary", help="CSV of the terms: group,ord,term; without it the engine's small test dictionary")
    corpus.add_argument("--csv", action="store_true", help="write the tables as CSV too")
    dup = sub.add_parser("duplicates", help="report duplicate files; deletes nothing")
    dup.add_argument("--input-dir", required=True)
    dup.add_argument("--out-dir", required=True)
    dup.add_argument("--threshold", type=float, default=0.90)
    dup.add_argument("--prefilter", action="store_true")
    dup.add_argument("--simhash-max-distance", type=int, default=24)
    convert = sub.add_parser("convert", help="PDF and DOCX files of a folder to Markdown")
    convert.add_argument("--input-dir", required=True)
    convert.add_argument("--out-dir", required=True)
    pages = sub.add_parser("pages", help="fetch addresses and write their text as Markdown files")
    pages.add_argument("--urls", required=True, help="text file with one address a line")
    pages.add_argument("--out-dir", required=True)
    pages.add_argument("--date", default=date.today().isoformat(), help="day of retrieval, part of the file names")
    budget = sub.add_parser("tokens", help="estimated tokens of a folder against a threshold")
    budget.add_argument("directory")
    budget.add_argument("-t", "--threshold", type=int, default=32_000)
    budget.add_argument("--tokenizer", help="vocabulary file for exact counts")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    if args.command == "corpus":
        config = CorpusConfig(candidate_limit=args.candidate_limit, tfidf_features=args.max_tfidf_features, expected_documents=args.expected_document_count)
        groups = None
        if args.dictionary:
            terms = S.read_csv(spark, args.dictionary, ["group", "ord", "term"]).withColumn("ord", F.col("ord").try_cast("int")).filter("term != ''")
            groups = pipeline.read_dictionary(terms)
        print(pipeline.run_corpus(spark, args.input_dir, args.out_dir, args.old_index, groups, config, hidden=True, csv=args.csv))
    elif args.command == "pages":
        urls = spark.read.text(args.urls).select(F.xxhash64("value").alias("page_id"), F.col("value").alias("url")).distinct()
        pipeline.run_pages(spark, urls, args.out_dir, args.date).select("url", "file_name", "char_count", "word_count", "status").orderBy("url").show(1000, False)
    elif args.command == "convert":
        pipeline.run_conversion(spark, args.input_dir, args.out_dir).orderBy("path").show(1000, False)
    elif args.command == "duplicates":
        config = DuplicateConfig(args.threshold, args.simhash_max_distance, args.prefilter)
        print(pipeline.run_duplicates(spark, args.input_dir, args.out_dir, config))
    else:
        texts = S.all_files(spark, args.directory).filter(F.is_valid_utf8(F.col("content").cast("string"))).select(F.col("content").cast("string").alias("text"))
        rows = quality.token_budget(texts, args.threshold, args.tokenizer).collect()
        print(rows[0].asDict() if rows else "no files")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
