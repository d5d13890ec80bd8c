"""Recordings in Parquet (a list column of counters per metric) and distributions as JSON.

Recordings are read by a data source of its own, ``recordings``: the driver lists paths and deals them out in groups of bytes; footers are opened, and the
parameters in them read, by the tasks, so files may differ in columns and parameters, and nothing is joined. Only recorded columns are read.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import DistributionError, IncompatibleParameters
from ..functions.bucketing import Config
from ..functions.width import U64, CounterWidth

# The names under which a column's metadata gives the kind of metric and the parameters, and Spark's name for its own metadata.
KIND, GROUPING, MAXIMUM = "metric_type", "grouping_power", "max_value_power"
SPARK_ROWS = b"org.apache.spark.sql.parquet.row.metadata"

FOOTERS = "column string, p tinyint, n tinyint, file string"
ROWS = "column string, p tinyint, n tinyint, counts array<decimal(20,0)>, file string"
#: Bytes of files that one task is dealt, and counters that one batch holds about.
GROUP_BYTES, BATCH_COUNTERS = 128 << 20, 1 << 19
#: Stores that are opened straight from the tasks; any other goes through Spark's own reader of whole files.
OPENED = {"", "file", "s3", "gs", "gcs", "abfs", "hdfs"}


def _named(meta: dict[str, str], kind: str | None) -> Config | None:
    """The parameters in a column's metadata, if it is complete and valid, and of the kind that is asked for."""
    if KIND not in meta or GROUPING not in meta or MAXIMUM not in meta or kind not in (None, meta[KIND]):
        return None
    try:
        return Config(int(meta[GROUPING]), int(meta[MAXIMUM]))
    except (DistributionError, ValueError):
        return None


def _recorded(file: pq.ParquetFile, kind: str | None) -> dict[str, Config]:
    """The recorded columns that a file's footer names: lists of unsigned 64-bit counters, or what Spark writes for these."""
    stored = (file.metadata.metadata or {}).get(SPARK_ROWS)
    own = {f["name"]: {k: str(v) for k, v in f["metadata"].items()} for f in json.loads(stored)["fields"]} if stored else {}
    found = {}
    for field in file.schema_arrow:
        if not (pa.types.is_list(field.type) or pa.types.is_large_list(field.type)):
            continue
        value = field.type.value_type
        written = pa.types.is_uint64(value) or bool(own.get(field.name)) and (pa.types.is_decimal(value) or pa.types.is_int64(value))
        meta = {k.decode(): v.decode() for k, v in (field.metadata or {}).items()} | own.get(field.name, {})
        if written and (config := _named(meta, kind)):
            found[field.name] = config
    return found


def _lists(column: pa.Array, total: int) -> pa.Array:
    """The lists that hold ``total`` counters, null ones aside, as decimals; null lists and lists of another length are left out."""
    lists = column.filter(column.is_valid())
    parent, values = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    given = values.is_valid()
    size = np.bincount(parent[given.to_numpy(zero_copy_only=False)], minlength=len(lists))
    keep = given.to_numpy(zero_copy_only=False) & (size == total)[parent]
    kept = pc.cast(values.filter(pa.array(keep)), pa.decimal128(20, 0))
    return pa.ListArray.from_arrays(pa.array(np.arange(int((size == total).sum()) + 1) * total, pa.int32()), kept)


def _inside(file: pq.ParquetFile, start: int, end: int) -> list[int]:
    """The row groups that begin within a range of bytes: each belongs to one range of a file that is dealt out in several."""
    begins = lambda c: min(x for x in (c.dictionary_page_offset, c.data_page_offset) if x)
    first = lambda g: min(begins(file.metadata.row_group(g).column(c)) for c in range(file.metadata.num_columns))
    return [g for g in range(file.num_row_groups) if start <= first(g) < end]


def _parsed(file: pq.ParquetFile, name: str, wanted: set[str] | None, kind: str | None, footers: bool, start: int = 0, end: int = 1 << 62) -> Iterator[pa.RecordBatch]:
    """What one file, or one range of it, holds in the wanted columns (None: all that are recorded)."""
    columns = {c: x for c, x in _recorded(file, kind).items() if wanted is None or c in wanted}
    fixed = lambda c, x, n: [pa.array([c] * n, pa.string()), pa.array([x.p] * n, pa.int8()), pa.array([x.n] * n, pa.int8())]
    if footers:
        for c, x in columns.items() if start == 0 else ():
            yield pa.RecordBatch.from_arrays([*fixed(c, x, 1), pa.array([name])], names=["column", "p", "n", "file"])
        return
    if not columns or not (groups := _inside(file, start, end)):
        return
    rows = max(1, min(4096, BATCH_COUNTERS // max(x.total_buckets for x in columns.values())))
    for batch in file.iter_batches(rows, row_groups=groups, columns=list(columns)):
        for c, x in columns.items():
            counts = _lists(batch.column(batch.schema.get_field_index(c)), x.total_buckets)
            yield pa.RecordBatch.from_arrays([*fixed(c, x, len(counts)), counts, pa.array([name] * len(counts), pa.string())], names=["column", "p", "n", "counts", "file"])


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return pafs.FileSystem.from_uri(uri)


def _wanted(options: dict[str, str]) -> set[str] | None:
    return set(options["columns"].split(",")) if "columns" in options else None


class _Files(InputPartition):
    """Files, or ranges of a file, of one task: (path, start, end)."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        super().__init__(parts)


class RecordingsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("kind")
        self.footers = options.get("footers", "false").lower() == "true"
        self.group = int(options.get("groupbytes", GROUP_BYTES))
        self.glob = options.get("pathglobfilter")
        self.wanted = _wanted(options)

    def partitions(self) -> list[InputPartition]:
        """One listing of paths and sizes; no file is opened."""
        store, path = _store(self.path)
        found = store.get_file_info(pafs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == pafs.FileType.Directory else [store.get_file_info(path)]
        hidden = lambda p: any(part[:1] in "._" for part in p[len(path) :].split("/") if part)
        files = sorted((f.path, f.size) for f in found if f.is_file and not hidden(f.path) and fnmatch.fnmatch(f.base_name, self.glob or "*"))
        groups, held = [[]], 0
        for name, size in files:
            for start in range(0, max(size, 1), self.group):
                end = min(size, start + self.group) if start + self.group < size else 1 << 62
                part = min(self.group, size - start)
                if groups[-1] and held + part > self.group:
                    groups.append([])
                    held = 0
                groups[-1].append((name, start, end))
                held += part
        return [_Files(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for name, start, end in partition.value:
            with store.open_input_file(name) as source:
                yield from _parsed(pq.ParquetFile(source), name, self.wanted, self.kind, self.footers, start, end)


class Recordings(DataSource):
    """``spark.read.format("recordings").load(path)``. Options: ``kind`` (the value that a column's metadata must have under metric_type; any, if unset),
    ``columns`` (names, comma-separated: no other is read), ``pathGlobFilter`` (names of files: no other is opened), ``groupBytes``, ``footers`` (true:
    only what the footers say). Pruning goes by options, not by the filters of a query: Spark 4.1 keeps the filters that a source of this kind has taken for one
    query, and applies them to the next over the same DataFrame."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return FOOTERS if self.options.get("footers", "false").lower() == "true" else ROWS

    def reader(self, schema: T.StructType) -> RecordingsReader:
        return RecordingsReader(dict(self.options))


def _source(spark: SparkSession, path: str, kind: str | None, footers: bool, options: dict[str, str]) -> DataFrame:
    if urlsplit(path).scheme in OPENED:
        spark.dataSource.register(Recordings)
        reader = spark.read.format("recordings").option("footers", footers)
        return reader.options(**options, **({"kind": kind} if kind else {})).load(path)
    # a store that only Spark opens: it hands whole files to the tasks
    wanted = _wanted(options)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _parsed(pq.ParquetFile(pa.BufferReader(content.as_buffer())), name.as_py(), wanted, kind, footers)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if "pathGlobFilter" in options:
        files = files.option("pathGlobFilter", options["pathGlobFilter"])
    return files.load(path).select("path", "content").mapInArrow(parse, FOOTERS if footers else ROWS)


def recorded_columns(spark: SparkSession, path: str, *, kind: str | None = None) -> dict[str, list[Config]]:
    """The list columns whose metadata is complete and valid, in any file below ``path``, with each set of parameters they have. Tasks read the footers; what
    comes back is a row for each name and set."""
    out: dict[str, list[Config]] = {}
    for r in _source(spark, path, kind, True, {}).select("column", "p", "n").distinct().orderBy("column", "p", "n").collect():
        out.setdefault(r.column, []).append(Config(r.p, r.n))
    return out


def read_recordings(spark: SparkSession, path: str, *, kind: str | None = None, columns: list[str] | None = None, **options: str) -> DataFrame:
    """(column, p, n, counts, file), a row per recorded distribution, of all files below ``path``, which may differ in columns and parameters. Null lists, and
    lists of a wrong length, are left out; null elements are dropped before the length counts. ``kind`` is the value that a column's metadata must have under
    metric_type (any, if not given). A path without any recorded column is refused: footers are read, by tasks, until one is found."""
    if columns is not None:
        options["columns"] = ",".join(columns)
    if _source(spark, path, kind, True, options).isEmpty():
        raise IncompatibleParameters(f"no recorded column in {path}")
    return _source(spark, path, kind, False, options)


def write_recordings(dense: DataFrame, path: str, columns: dict[str, Config], *, kind: str = "distribution") -> None:
    """Write list columns with their parameters, and what kind of metric they are, as column metadata, which ``read_recordings`` finds."""
    meta = {name: {KIND: kind, GROUPING: str(c.p), MAXIMUM: str(c.n)} for name, c in columns.items()}
    dense.select(*(F.col(f"`{c}`").alias(c, metadata=meta[c]) if c in meta else F.col(f"`{c}`") for c in dense.columns)).write.parquet(path)


def to_json(packed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., json) of packed or dense rows."""
    return packed.select(*keys, F.to_json(F.struct(*(c for c in packed.columns if c not in keys))).alias("json"))


def form_schema(kind: str = "packed", *, count: str = "cnt", width: CounterWidth = U64) -> T.StructType:
    """The schema of a form's JSON: ``dense`` (p, n, counts) or ``packed`` (p, n, idx, <count>), with counters of a width; ``count="cum"`` is the
    cumulative form. What ``from_json`` takes."""
    if kind not in ("dense", "packed"):
        raise ValueError(f"kind={kind!r}")
    counter = width.column_type
    arrays = f"counts array<{counter}>" if kind == "dense" else f"idx array<bigint>, {count} array<{counter}>"
    return T.StructType.fromDDL(f"p tinyint, n tinyint, {arrays}")


def from_json(texts: DataFrame, keys: list[str], schema: T.StructType, column: str = "json") -> DataFrame:
    return texts.select(*keys, F.from_json(column, schema).alias("h")).select(*keys, "h.*")
