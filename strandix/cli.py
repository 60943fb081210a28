"""Command line: build, query, check, bench and permute, on files."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import ALPHABETS, MAX_K, Config
from .functions.sequence import random_kmer
from .operators import reorder
from .operators.dictionary import Dictionary
from .operators.minimizers import bucket_classes, skew_partitions
from .operators.reads import file_report, report_lines
from .operators.statistics import minimizer_advice, offset_widths, space_breakdown, space_model
from .sources.files import kind_of, read_sequences, read_weighted_fasta, write_fasta, write_metrics
from .sources.pieces import read_pieces


def _build(spark, args) -> None:
    config = Config(k=args.k, m=args.m, seed=args.seed, canonical=args.canonical, weighted=args.weighted, encoding=args.encoding)
    if args.threads:  # a hint only: tasks run on whatever the session has
        spark.conf.set("spark.sql.shuffle.partitions", str(args.threads))
    if args.weighted:
        rows = read_weighted_fasta(spark, args.input, args.k)
    elif kind_of(args.input) == "fasta":
        rows = read_pieces(spark, args.input, args.k)
    else:
        rows = read_sequences(spark, args.input)
    dictionary = Dictionary.build(rows, config, args.directory)
    if args.verbose:
        for table in (dictionary.metadata(), space_model(dictionary), space_breakdown(dictionary), offset_widths(dictionary), minimizer_advice(dictionary), bucket_classes(dictionary), skew_partitions(dictionary)):
            table.show(truncate=False)
    if args.check:
        print(json.dumps(dictionary.check()))
    if args.output:
        dictionary.save(args.output)


def _query(spark, args) -> None:
    dictionary = Dictionary.load(spark, args.index)
    began = time.time()
    report = file_report(dictionary, args.query, args.multiline)
    print(json.dumps(report.first().asDict() | {"seconds": round(time.time() - began, 3)}))
    if args.verbose:
        print("\n".join(report_lines(report)))


def _check(spark, args) -> None:
    print(json.dumps(Dictionary.load(spark, args.index).check()))


def _bench(spark, args) -> None:
    dictionary = Dictionary.load(spark, args.index)
    kmers = dictionary.kmers.select(dictionary.kmer_strings().alias("kmer"), "kmer_id")
    random = dictionary.kmers.select(random_kmer(dictionary.k, args.seed).alias("kmer"))
    timed = {
        "lookup": dictionary.lookup(kmers.select("kmer")),
        "negative lookup": dictionary.lookup(random),
        "lookup and weight": dictionary.weights(dictionary.lookup(kmers.select("kmer"))),
        "access": dictionary.access(kmers.select("kmer_id")),
        "iterate": dictionary.iterate(),
    }
    n, rows = dictionary.kmers.count(), []
    for name, df in timed.items():
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        rows.append({"operation": name, "seconds": round(time.time() - began, 3), "nanoseconds_per_kmer": round((time.time() - began) / max(1, n) * 1e9, 1)})
        print(json.dumps(rows[-1]))
    if args.output:
        write_metrics(spark.createDataFrame(rows), args.output)


def _permute(spark, args) -> None:
    rows = read_weighted_fasta(spark, args.input, args.k)
    ends = rows.select(F.col("sequence_id").alias("string_id"), F.element_at("weights", 1).alias("front"), F.element_at("weights", -1).alias("back"))
    order, walks = reorder.permutation(ends)
    out = reorder.apply_permutation(rows.select(F.col("sequence_id").alias("string_id"), "seq", "weights"), order)
    write_fasta(out, args.output, "new_pos", "seq", "new_pos", args.k)
    if args.directory:
        reorder.write_permutation(order, args.directory)
    print(json.dumps({"strings": rows.count(), "walks": walks}))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandix", description=__doc__)
    tools = parser.add_subparsers(dest="tool", required=True)
    build = tools.add_parser("build", help="build a dictionary from a sequence file")
    build.add_argument("-i", "--input", required=True)
    build.add_argument("-k", type=int, default=31, help=f"k-mer length, at most {MAX_K}")
    build.add_argument("-m", type=int, default=20, help="minimizer length, at most min(k, 31)")
    build.add_argument("-s", "--seed", type=int, default=1)
    build.add_argument("-o", "--output")
    build.add_argument("-d", "--directory", help="folder of the tables while they are built")
    build.add_argument("-t", "--threads", type=int, help="tasks of a shuffle")
    build.add_argument("-e", "--encoding", choices=sorted(ALPHABETS), default="default", help="order of the bases")
    for flag in ("--canonical", "--weighted", "--check", "--verbose"):
        build.add_argument(flag, action="store_true")
    query = tools.add_parser("query", help="report on the k-mers of a read file")
    query.add_argument("-i", "--index", required=True)
    query.add_argument("-q", "--query", required=True)
    query.add_argument("--multiline", action="store_true")
    query.add_argument("--verbose", action="store_true")
    tools.add_parser("check").add_argument("-i", "--index", required=True)
    bench = tools.add_parser("bench", help="time lookups, access and iteration")
    bench.add_argument("-i", "--index", required=True)
    bench.add_argument("-s", "--seed", type=int, default=1)
    bench.add_argument("-o", "--output", help="folder of JSON lines")
    permute = tools.add_parser("permute", help="reorder weighted strings")
    permute.add_argument("-i", "--input", required=True)
    permute.add_argument("-k", type=int, required=True)
    permute.add_argument("-o", "--output", required=True)
    permute.add_argument("-d", "--directory", help="folder of the permutation file")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("strandix").getOrCreate()
    {"build": _build, "query": _query, "check": _check, "bench": _bench, "permute": _permute}[args.tool](spark, args)


if __name__ == "__main__":
    main()
