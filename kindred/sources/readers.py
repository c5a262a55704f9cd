"""Sources: strict JSON lines, documents, source trees, entities, CSV, integer sets, frames, synthetic sets."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError
from ..operators.tables import shared_table

#: Splits of text files up to which the table that numbers them is broadcast.
FEW_SPLITS = 100_000

INDEX_RECORD = "key bigint, values array<string>, signature array<decimal(20,0)>, scheme string, seed bigint"
QUERY_RECORD = "id string, values array<string>, signature array<decimal(20,0)>, scheme string, seed bigint"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, offset, ordinal, value`` of text lines: numbers from 1 within a file, bytes before the line (line ends of
    one byte), and a number from 0 over all files by name.  ``-`` is the standard input.

    Lines are counted and measured within each split where they lie; only the splits' totals, a row each, are added up."""
    if path == "-":
        return ingest(spark, ({"value": line.rstrip("\n")} for line in sys.stdin), "value string").select(
            F.lit("-").alias("file"), (F.col("_position") + 1).alias("line"), F.lit(None).cast("bigint").alias("offset"), F.col("_position").alias("ordinal"), "value"
        )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, line, at = None, 0, 0
        for batch in batches:
            keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True))
            lines, offsets = [], []
            for key, size in zip(keys, batch.column("size").to_pylist(), strict=True):
                if key != own:
                    own, line, at = key, 0, 0
                lines.append(line)
                offsets.append(at)
                line, at = line + 1, at + size
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("file", "block", "size", "value")], pa.array(lines, pa.int64()), pa.array(offsets, pa.int64())],
                names=["file", "block", "size", "value", "i", "o"],
            )

    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), (F.octet_length("value") + 1).cast("bigint").alias("size"), "value"
    )
    rows = rows.mapInArrow(place, "file string, block bigint, size bigint, value string, i bigint, o bigint")
    splits = shared_table(rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "splits")
    within, every = Window.partitionBy("file").orderBy("block"), Window.orderBy("file", "block")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "block", before("n", within).alias("l0"), before("bytes", within).alias("o0"), before("n", every).alias("g0"))
    starts = shared_table(starts, "splits")
    if starts.limit(FEW_SPLITS + 1).count() <= FEW_SPLITS:
        starts = F.broadcast(starts)
    return rows.join(starts, ["file", "block"]).select(
        "file", (F.col("l0") + F.col("i") + 1).alias("line"), (F.col("o0") + F.col("o")).alias("offset"), (F.col("g0") + F.col("i")).alias("ordinal"), "value"
    )


def _blank(value: str = "value") -> Column:
    return F.trim(value) == ""


def _where() -> Column:
    return F.concat(F.lit(" (line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"), F.lit(")"))


def json_lines(spark: SparkSession, path: str, schema: str, ordinal: bool = False) -> DataFrame:
    """Objects of a JSON-lines file or ``-``; blank lines are skipped; a malformed line or a field that the schema does not have
    is an error that names the line and shows it.  ``ordinal`` adds the number of the line."""
    fields = [f.name for f in T._parse_datatype_string(schema).fields]
    lines = numbered_lines(spark, path).where(~_blank())
    allowed = F.array(*[F.lit(f) for f in fields])
    bad = F.concat(F.lit("malformed record or unknown field: "), F.substring("value", 1, 200), _where())
    parsed = lines.select("*", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.json_object_keys("value").alias("k"))
    good = F.col("k").isNotNull() & (F.size(F.array_except("k", allowed)) == 0)
    return parsed.select(F.when(good, F.col("r")).otherwise(F.raise_error(bad)).alias("r"), "ordinal").select("r.*", *["ordinal"] * ordinal)


def index_records(spark: SparkSession, path: str, query: bool = False, num_perm: int = 128, seed: int = 1, scheme: str = "affine32") -> DataFrame:
    """Records with either ``values`` or a ``signature`` whose scheme, seed and length are those of the index; queries have
    their line's ``ordinal`` as well."""
    rows = json_lines(spark, path, QUERY_RECORD if query else INDEX_RECORD, ordinal=query)
    values, signature = F.col("values").isNotNull(), F.col("signature").isNotNull()
    limit = F.lit(str((1 << 32) - 1 if scheme == "affine32" else (1 << 64) - 1)).cast("decimal(20,0)")
    plain = values & ~signature & F.col("scheme").isNull() & F.col("seed").isNull()
    signed = (
        signature & ~values & (F.col("scheme") == scheme) & (F.coalesce("seed", F.lit(seed)) == seed) & (F.size("signature") == num_perm)
        & F.forall("signature", lambda v: (v >= 0) & (v <= limit))
    )
    ok = F.coalesce(plain | signed, F.lit(False))
    return rows.select(*[c for c in rows.columns if c not in ("values", "signature")], *[
        F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit("a record needs either values, or a signature of the index's scheme"))).alias(c) for c in ("values", "signature")
    ])


def documents(spark: SparkSession, path: str, text_field: str = "text", id_field: str = "id", limit: int | None = None, positions: bool = False) -> DataFrame:
    """``id string, text``: ids are strings or integers, texts are strings; anything else is an error that names the line.

    ``positions`` adds ``key`` (the number of the document, from 0), ``file`` and ``offset``; ``limit`` takes the first ones."""
    lines = numbered_lines(spark, path).where(~_blank())
    v = lines.select("*", F.parse_json("value").alias("v"))
    kind = lambda f: F.expr(f"schema_of_variant(variant_get(v, '$.{f}', 'variant'))")
    ok = kind(id_field).isin("STRING", "BIGINT") & (kind(text_field) == "STRING")
    bad = F.concat(F.lit("a document needs a string or integer id and a string text"), _where())
    checked = v.withColumn("v", F.when(F.coalesce(ok, F.lit(False)), F.col("v")).otherwise(F.raise_error(bad).cast("variant")))
    out = checked.select(
        F.expr(f"variant_get(v, '$.{id_field}', 'string')").alias("id"), F.expr(f"variant_get(v, '$.{text_field}', 'string')").alias("text"), "ordinal", "file", "offset"
    )
    if limit is not None:
        out = first_rows(out, F.col("ordinal"), limit)
    if not positions:
        return out.select("id", "text")
    if out.limit(1).count() == 0:
        return out.select(F.lit(0).cast("bigint").alias("key"), "id", "text", "file", "offset")
    # Blank lines have ordinals too: those of documents are counted within ranges, and the ranges' totals added up.
    ranged = shared_table(out.repartitionByRange("ordinal").withColumn("part", F.spark_partition_id()), "documents")
    per = ranged.groupBy("part").agg(F.count("*").alias("n"))
    starts = per.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("g0"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("ordinal")) - 1
    return ranged.withColumn("i", place).join(F.broadcast(starts), "part").select((F.col("g0") + F.col("i")).alias("key"), "id", "text", "file", "offset")


def first_rows(df: DataFrame, order: Column, limit: int) -> DataFrame:
    """The ``limit`` first rows by ``order``, which tells all rows apart: the same ones on every run."""
    if isinstance(limit, bool) or limit < 0:
        raise ConfigurationError("limit must not be negative")
    return df.orderBy(order).limit(limit)


def source_tree(spark: SparkSession, root: str, extensions: tuple[str, ...], max_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(``path, content`` of the accepted files, counts of files by fate): hidden, other extensions, too large, binary, blank.

    Spark's file sources do not list files of no bytes, so those are neither accepted nor counted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").replace("file://", "")
    path = F.regexp_replace("path", F.lit("^.*?" + base.replace(".", "[.]") + "/"), F.lit(""))
    fate = (
        F.when(F.rlike(path, F.lit(r"(^|/)\.")), "skipped_hidden").when(~F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*extensions), "skipped_extension")
        .when(F.col("length") > max_bytes, "skipped_oversize").when(F.instr(F.decode("content", "ISO-8859-1"), F.lit("\0")) > 0, "skipped_binary")
        .when(F.trim(F.decode("content", "UTF-8")) == "", "skipped_empty").otherwise("accepted")
    )
    rows = files.select(path.alias("path"), "content", fate.alias("fate"))
    return rows.where("fate = 'accepted'").select("path", F.decode("content", "UTF-8").alias("content")), rows.groupBy("fate").agg(F.count("*").alias("files"))


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, or an error if its keys repeat."""
    found = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if found:
        raise ConfigurationError(f"repeated key {tuple(found[0])[:-1]}")
    return df


def csv(spark: SparkSession, path: str, schema: str, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows of CSV files with a header; a malformed row is an error.  ``limit`` takes the first rows by the column ``order``."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    if limit is None:
        return rows
    if order is None:
        raise ConfigurationError("a limit needs an order")
    return first_rows(rows, F.col(order), limit)


def integer_sets(spark: SparkSession, path: str) -> DataFrame:
    """``items``: the sorted distinct integers of each line; a blank line is an empty set."""
    numbers = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    return spark.read.text(path).select(F.array_sort(F.array_distinct(F.transform(numbers, lambda x: x.cast("bigint")))).alias("items"))


def _positive(size: object) -> int:
    if isinstance(size, bool) or not isinstance(size, int) or size < 1:
        raise ConfigurationError("batch_size must be a positive integer")
    return size


def ingest(spark: SparkSession, rows: Iterable[dict | pa.RecordBatch], schema: str | None = None, batch_size: int = 65_536) -> DataFrame:
    """Rows (or record batches) that only the driver can iterate over, with their ``_position``: they are written to the shared
    folder ``batch_size`` at a time, so the driver holds one batch, and read back from there."""
    _positive(batch_size)
    out, at, source = None, 0, iter(rows)

    def write(table: pa.Table | list, n: int) -> None:
        nonlocal out, at
        df = spark.createDataFrame(table) if isinstance(table, pa.Table) else spark.createDataFrame(table, schema) if schema else spark.createDataFrame(table)
        df = df.withColumn("_position", F.monotonically_increasing_id()) if n == 1 else df.coalesce(1).withColumn("_position", F.monotonically_increasing_id())
        part = shared_table(df.withColumn("_position", F.col("_position") + at), "ingested")
        out, at = part if out is None else out.unionByName(part, allowMissingColumns=True), at + n

    while chunk := list(itertools.islice(source, batch_size)):
        if isinstance(chunk[0], pa.RecordBatch):
            for batch in chunk:
                for start in range(0, batch.num_rows, batch_size):
                    piece = batch.slice(start, batch_size)
                    write(pa.Table.from_batches([piece]), piece.num_rows)
        else:
            columns = list(dict.fromkeys(k for row in chunk for k in row))
            write([tuple(row.get(c) for c in columns) for row in chunk] if schema else pa.Table.from_pylist(chunk), len(chunk))
    if out is None:
        return spark.createDataFrame([], f"{schema}, _position bigint" if schema else "_position bigint")
    return out


def _projected(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns; ``a.b`` keeps the field ``b`` of the struct ``a`` within ``a``, whose nulls stay."""
    tops: dict[str, list[str]] = {}
    for c in columns:
        top, _, inner = c.partition(".")
        tops.setdefault(top, [])
        if inner:
            tops[top].append(inner)
    return df.select(*[
        F.when(F.col(top).isNotNull(), F.struct(*[F.col(f"{top}.{i}").alias(i) for i in inner])).alias(top) if inner else F.col(top) for top, inner in tops.items()
    ])


def frame(spark: SparkSession, source: object, columns: list[str] | None = None, batch_size: int = 65_536) -> DataFrame:
    """Rows of a Parquet path, Arrow table, batch, reader, dataset or scanner, pandas or Polars frame (eager or lazy), or of a
    dataset that is iterated over in batches.  What comes in batches goes through the driver one batch at a time."""
    _positive(batch_size)
    out = None
    if isinstance(source, DataFrame):
        out = source
    elif isinstance(source, str):
        out = spark.read.parquet(source)
    elif hasattr(source, "collect_batches"):
        out = ingest(spark, (b for f in source.collect_batches(chunk_size=batch_size, maintain_order=True) for b in f.to_arrow().to_batches()), None, batch_size).drop("_position")
    elif isinstance(source, pa.RecordBatchReader):
        out = ingest(spark, iter(source), None, batch_size).drop("_position")
    elif isinstance(source, pa.RecordBatch):
        out = spark.createDataFrame(pa.Table.from_batches([source]))
    elif isinstance(source, pa.Table):
        out = spark.createDataFrame(source)
    elif hasattr(source, "to_batches"):
        out = ingest(spark, source.to_batches(), None, batch_size).drop("_position")
    elif hasattr(source, "iter") and not hasattr(source, "columns"):
        out = ingest(spark, _dataset_rows(source, batch_size), None, batch_size).drop("_position")
    else:
        if hasattr(source, "collect") and hasattr(source, "lazy"):
            source = source.collect()
        if hasattr(source, "to_arrow"):
            source = source.to_arrow()
        out = spark.createDataFrame(source)
    return _projected(out, columns) if columns else out


def _dataset_rows(source, batch_size: int) -> Iterator[dict]:
    for batch in source.iter(batch_size=batch_size, drop_last_batch=False):
        if not hasattr(batch, "keys"):
            raise TypeError("a batch of a dataset must be a mapping of columns")
        names = list(batch)
        if len({len(batch[n]) for n in names}) > 1:
            raise ValueError("the columns of a batch have different lengths")
        for values in zip(*[batch[n] for n in names], strict=True):
            yield dict(zip(names, values, strict=True))


def feature_function(fn: Callable[[dict], Iterable[str | bytes]], *columns: str) -> Column:
    """Features by a Python function of a row (a dict of ``columns``), in Arrow batches; bytes are taken as UTF-8."""
    @F.pandas_udf("array<string>")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([[x.decode() if isinstance(x, bytes) else x for x in fn(r)] for r in rows.to_dict("records")])

    return run(F.struct(*columns))


def project(df: DataFrame, key: Column, record: dict[str, Column], features: Column | Callable[[dict], Iterable[str | bytes]]) -> DataFrame:
    """``key, <record>, features``: what a Deduplicator works on, from any source's rows."""
    own = features if isinstance(features, Column) else feature_function(features, *df.columns)
    return df.select(key.alias("key"), *[c.alias(n) for n, c in record.items()], own.alias("features"))


def synthetic_sets(spark: SparkSession, rows: int, set_size: int = 32, seed: int = 7) -> DataFrame:
    """``key, items``: sets of 64-bit numbers (bit-cast to BIGINT) that a mixing function makes from key and place."""
    if rows < 0 or set_size < 1:
        raise ConfigurationError("rows and set_size must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("id").to_numpy().astype(np.uint64)
            with np.errstate(over="ignore"):
                x = keys[:, None] * np.uint64(set_size + 1) + np.arange(set_size, dtype=np.uint64) + np.uint64(seed)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x = np.sort(x ^ (x >> np.uint64(31)), axis=1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * set_size), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["key", "items"])

    return spark.range(rows).mapInArrow(run, "key bigint, items array<bigint>")


def synthetic_queries(spark: SparkSession, rows: int, set_size: int = 32, overlap: int = 24, seed: int = 7) -> DataFrame:
    """``key, items``: sets that keep the ``overlap`` smallest items of the set of the same key and have others for the rest."""
    if not 0 <= overlap <= set_size:
        raise ConfigurationError("overlap must be within 0 and set_size")
    # The others are drawn by another seed, beyond the numbers that any set's own draw has.
    other = synthetic_sets(spark, rows, set_size, seed + (1 << 40)).withColumnRenamed("items", "other")
    kept = synthetic_sets(spark, rows, set_size, seed).join(other, "key")
    return kept.select("key", F.array_sort(F.concat(F.slice("items", 1, overlap), F.slice("other", 1, set_size - overlap))).alias("items"))


def synthetic_families(spark: SparkSession, families: int, members: int = 2, features: int = 32, own: int = 2) -> DataFrame:
    """``key, family, features``: the members of a family share all features but ``own``; families share none."""
    if families < 0 or members < 1 or not 0 <= own <= features:
        raise ConfigurationError("families, members and features must be positive")
    key = F.col("id")
    family = F.floor(key / members)
    shared = F.transform(F.sequence(F.lit(1), F.lit(max(1, features - own))), lambda i: F.concat_ws(":", F.lit("family"), family.cast("string"), i.cast("string")))
    single = F.transform(F.sequence(F.lit(1), F.lit(max(1, own))), lambda i: F.concat_ws(":", F.lit("own"), key.cast("string"), i.cast("string")))
    parts = [p for p, n in ((shared, features - own), (single, own)) if n]
    return spark.range(families * members).select(key.alias("key"), family.alias("family"), F.concat(*parts).alias("features"))


def held_out(df: DataFrame, order: Column, rows: int, planted: int = 0) -> tuple[DataFrame, DataFrame]:
    """(reference, queries): the ``rows`` last by ``order`` are queries and not in the reference; the ``planted`` first ones are in both."""
    last = df.orderBy(order.desc()).limit(rows)
    reference = df.join(last, df.columns, "left_anti")
    return (reference, last) if not planted else (reference, last.unionAll(reference.orderBy(order).limit(planted)))
