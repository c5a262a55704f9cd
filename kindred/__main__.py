"""Commands over JSON lines: ``python -m kindred COMMAND``.  Paths are those that Spark knows; ``-`` is the standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import KindredError
from .operators import minhash
from .operators.dedupe import Deduplicator, Settings
from .plans import planner
from .sources import readers, sinks
from .streaming.index import ProgressEvent, StoredIndex


def session() -> SparkSession:
    """The session that spark-submit has set up, or a local one."""
    found = SparkSession.builder.appName("kindred").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    found.sparkContext.setLogLevel("ERROR")
    return found


def show(df: DataFrame, output: str | None) -> None:
    """Lines of text to a folder that must not exist, or to the standard output, a partition at a time."""
    if output:
        sinks.publish(df.sparkSession, {output: df})
    else:
        for row in df.toLocalIterator():
            print(row.value)


def report(df: DataFrame, form: str) -> None:
    show(sinks.json_text(df) if form == "json" else sinks.report_text(df), None)


def signed(records: DataFrame, key: str, num_perm: int, seed: int, width: int) -> DataFrame:
    """``key, signature`` of records that hold either values or a signature."""
    made = minhash.sign(records.where("signature is null"), key, F.col("values"), num_perm, seed, width)
    number = lambda v: F.when(v < F.lit(str(1 << 63)).cast("decimal(20,0)"), v).otherwise(v - F.lit(str(1 << 64)).cast("decimal(21,0)")).cast("bigint")
    return made.unionByName(records.where("signature is not null").select(key, F.transform("signature", number).alias("signature")))


def index(a: argparse.Namespace) -> int:
    spark = session()
    s = Settings(a.threshold, a.num_perm, a.seed, a.width, store_signatures=not a.no_signatures)
    rows = readers.index_records(spark, a.input, num_perm=a.num_perm, seed=a.seed, scheme=f"affine{a.width}")
    built = StoredIndex.create(spark, a.path, s)
    try:
        built.insert_signatures(signed(rows, "key", a.num_perm, a.seed, a.width), (a.num_perm, a.seed, a.width))
    except Exception:
        built.drop()
        raise
    if a.progress:
        print(ProgressEvent(len(built), len(built), len(built), 0.0, 0.0, True), file=sys.stderr)
    return 0


def search(a: argparse.Namespace) -> int:
    spark = session()
    found = StoredIndex.open(spark, a.path, read_only=True)
    m = found.meta
    rows = readers.index_records(spark, a.queries, True, m["num_perm"], m["seed"], f"affine{m['width']}")
    queries = signed(rows, "ordinal", m["num_perm"], m["seed"], m["width"])
    hits = found.search_signatures(queries, "ordinal", a.min_similarity, a.top_k)
    names = rows.select(F.col("ordinal").alias("query"), "id")
    show(sinks.json_text(sinks.search_rows(hits, names)) if a.format == "json" else sinks.search_text(hits, names), a.output)
    return 0


def dedup(a: argparse.Namespace) -> int:
    spark = session()
    rows = readers.index_records(spark, a.input, num_perm=a.num_perm, seed=a.seed, scheme=f"affine{a.width}")
    s = Settings(a.threshold, a.num_perm, a.seed, a.width, min_similarity=a.min_similarity)
    d = Deduplicator.of_signatures(signed(rows, "key", a.num_perm, a.seed, a.width), "key", s)
    form = {"json": (sinks.json_text, sinks.json_text), "tsv": (sinks.pair_text, sinks.group_text)}[a.format]
    if a.pairs:
        pairs = d.candidate_pairs() if a.min_similarity is None else d.scored_pairs().where(F.col("similarity") >= a.min_similarity)
        show(form[0](pairs), a.output)
    else:
        show(form[1](d.groups(a.min_size)), a.output)
    return 0


def stats(a: argparse.Namespace) -> int:
    report(StoredIndex.open(session(), a.path, read_only=True).stats(), a.format)
    return 0


def verify(a: argparse.Namespace) -> int:
    found = StoredIndex.open(session(), a.path, read_only=True).verify().collect()
    for row in found:
        print(f"{row.problem}: {row.n}")
    return int(any(row.n for row in found))


def explain(a: argparse.Namespace) -> int:
    report(StoredIndex.open(session(), a.path, read_only=True).explain(a.items, a.memory, a.storage), a.format)
    return 0


def plan(a: argparse.Namespace) -> int:
    report(planner.plan_frame(session(), [planner.plan(a.items, a.threshold, a.num_perm, a.memory, a.storage, a.width)]), a.format)
    return 0


def compact(a: argparse.Namespace) -> int:
    StoredIndex.open(session(), a.path).compact()
    return 0


def completion(a: argparse.Namespace) -> int:
    """A line that makes a shell complete the commands."""
    words = " ".join(sorted(COMMANDS))
    print(f"complete -W '{words}' kindred" if a.shell == "bash" else f"#compdef kindred\n_arguments '1:command:({words})' '*:file:_files'")
    return 0


COMMANDS = {f.__name__: f for f in (index, search, dedup, stats, verify, explain, plan, compact, completion)}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("kindred", description="Approximate similarity search and deduplication of JSON lines.")
    of = out.add_subparsers(dest="command", required=True)
    add = {name: of.add_parser(name, help=(f.__doc__ or name).split(".")[0]) for name, f in COMMANDS.items()}
    for name in ("index", "dedup", "plan"):
        add[name].add_argument("--threshold", type=float, default=0.8)
        add[name].add_argument("--num-perm", type=int, default=128)
        add[name].add_argument("--width", type=int, choices=(32, 64), default=32)
    for name in ("index", "dedup"):
        add[name].add_argument("input")
        add[name].add_argument("--seed", type=int, default=1)
    for name in ("index", "search", "stats", "verify", "explain", "compact"):
        add[name].add_argument("path")
    for name in ("search", "dedup"):
        add[name].add_argument("--min-similarity", type=float)
        add[name].add_argument("--output")
        add[name].add_argument("--format", choices=("json", "tsv"), default="json")
    for name in ("stats", "explain", "plan"):
        add[name].add_argument("--format", choices=("text", "json"), default="text")
    for name in ("explain", "plan"):
        add[name].add_argument("--items", type=int, required=name == "plan")
        add[name].add_argument("--memory", type=int)
        add[name].add_argument("--storage", default="auto")
    add["index"].add_argument("--no-signatures", action="store_true")
    add["index"].add_argument("--progress", action="store_true")
    add["search"].add_argument("queries")
    add["search"].add_argument("--top-k", type=int)
    add["dedup"].add_argument("--pairs", action="store_true")
    add["dedup"].add_argument("--min-size", type=int, default=2)
    add["completion"].add_argument("shell", choices=("bash", "zsh"))
    return out


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        return COMMANDS[a.command](a)
    except KindredError as e:
        print(f"kindred: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
