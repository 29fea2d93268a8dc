"""Data sources of a store that is asked by requests: pages by key ranges for reads, batches of bounded size for writes.

Reads: `key_pages` splits the key's range into partitions from the files' statistics, and
each partition asks for its rows a page at a time, in order of the key and after the
last one seen. Filters that the store knows are pushed into the requests.

Writes: `request_batches` sends at most `size` rows a request. Requests are files that
count only once the job's manifest names them; a job that fails has none, and its folder
is emptied. What a killed task of a stream sent stays, counts for nothing and is removed by
unlisted_removed(). A stream's manifest is named by its batch, so a repeated
batch replaces itself. Paths are those that pyarrow's file systems open, on the driver and
on executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

PAGE, SIZE = 1000, 80


def _opened(path: str):
    """(file system, path in it)."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class KeyRange(InputPartition):
    """Keys above `low` up to `high`; None is open."""

    low: object
    high: object


class KeyPagesReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.key = options["path"], options["key"]
        self.page, self.ranges = int(options.get("page", PAGE)), int(options.get("ranges", 8))
        self.schema, self.filters = schema, []

    def pushFilters(self, filters):
        """Comparisons, lists and prefixes of a column go into the requests; others stay with Spark."""
        known = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, StringStartsWith)
        for f in filters:
            if isinstance(f, known) and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def _table(self) -> ds.Dataset:
        fs, path = _opened(self.path)
        return ds.dataset(path, filesystem=fs, format="parquet")

    def partitions(self) -> list[KeyRange]:
        """Ranges between largest keys of row groups, so about as many rows each where files are sorted; one range otherwise."""
        last = []
        for fragment in self._table().get_fragments():
            for group in fragment.row_groups or []:
                if group.statistics and self.key in group.statistics:
                    last.append(group.statistics[self.key]["max"])
        last = sorted(set(last))
        step = max(1, -(-len(last) // self.ranges))
        bounds = [None, *last[step - 1 : -1 : step], None]
        return [KeyRange(a, b) for a, b in zip(bounds, bounds[1:])]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        key = ds.field(self.key)
        wanted = None
        both = lambda a, b: b if a is None else a & b
        for f in self.filters:
            c = ds.field(f.attribute[0])
            one = c.isin(list(f.value)) if isinstance(f, In) else pc.starts_with(c, f.value) if isinstance(f, StringStartsWith) else {EqualTo: c == f.value, GreaterThan: c > f.value, GreaterThanOrEqual: c >= f.value, LessThan: c < f.value, LessThanOrEqual: c <= f.value}[type(f)]
            wanted = both(wanted, one)
        span = wanted
        if partition.low is not None:
            span = both(span, key > partition.low)
        if partition.high is not None:
            span = both(span, key <= partition.high if partition.low is not None else (key <= partition.high) | key.is_null())
        rows = self._table().to_table(columns=[f.name for f in self.schema.fields], filter=span)
        # the store answers in order of the key; a page begins after the last row of the one before
        rows = rows.sort_by(self.key)
        for batch in rows.to_batches(max_chunksize=self.page):
            yield batch


class KeyPages(DataSource):
    """spark.read.format("key_pages").option("path", ...).option("key", ...).option("page", 1000).option("ranges", 8)"""

    @classmethod
    def name(cls) -> str:
        return "key_pages"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        fs, path = _opened(self.options["path"])
        return from_arrow_schema(ds.dataset(path, filesystem=fs, format="parquet").schema)

    def reader(self, schema: StructType) -> KeyPagesReader:
        return KeyPagesReader(dict(self.options), schema)


@dataclass
class Sent(WriterCommitMessage):
    """Requests of one task: (file, rows)."""

    requests: list


class _Sender:
    def __init__(self, options: dict, schema: StructType):
        self.path, self.size, self.job = options["path"], int(options.get("size", SIZE)), uuid.uuid4().hex
        self.names = schema.fieldNames()
        if not 0 < self.size <= SIZE:
            raise ValueError(f"a request takes 1 to {SIZE} rows")

    def _send(self, rows, folder: str) -> Sent:
        fs, base = _opened(self.path)
        fs.create_dir(f"{base}/requests/{folder}", recursive=True)
        sent, held = [], []

        def flush() -> None:
            name = f"requests/{folder}/{uuid.uuid4().hex}.json"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write("\n".join(json.dumps(r, default=str) for r in held).encode())
            sent.append((name, len(held)))
            held.clear()

        try:
            for row in rows:
                held.append(dict(zip(self.names, row)))
                if len(held) == self.size:
                    flush()
            if held:
                flush()
        except BaseException:
            for name, _ in sent:
                fs.delete_file(f"{base}/{name}")
            raise
        return Sent(sent)

    def _publish(self, messages, name: str) -> None:
        fs, base = _opened(self.path)
        fs.create_dir(f"{base}/manifests", recursive=True)
        listed = [[f, n] for m in messages if m for f, n in m.requests]
        # a whole file appears at once
        with fs.open_output_stream(f"{base}/manifests/.{name}.{self.job}") as out:
            out.write(json.dumps({"name": name, "requests": listed}).encode())
        fs.move(f"{base}/manifests/.{name}.{self.job}", f"{base}/manifests/{name}.json")

    def _forget(self, messages) -> None:
        fs, base = _opened(self.path)
        for m in messages:
            for name, _ in m.requests if m else []:
                fs.delete_file(f"{base}/{name}")


class BatchWriter(_Sender, DataSourceWriter):
    def write(self, iterator) -> Sent:
        return self._send(iterator, self.job)

    def commit(self, messages) -> None:
        self._publish(messages, f"job-{self.job}")

    def abort(self, messages) -> None:
        # the folder is the job's own: what a killed task had sent goes too
        fs, base = _opened(self.path)
        fs.delete_dir_contents(f"{base}/requests/{self.job}", missing_dir_ok=True)


class BatchStreamWriter(_Sender, DataSourceStreamWriter):
    def write(self, iterator) -> Sent:
        return self._send(iterator, self.job)

    def commit(self, messages, batchId: int) -> None:
        self._publish(messages, f"batch-{batchId:012d}")

    def abort(self, messages, batchId: int) -> None:
        self._forget(messages)


class RequestBatches(DataSource):
    """df.write.format("request_batches").mode("append").option("path", ...).option("size", 80).save(), and writeStream alike."""

    @classmethod
    def name(cls) -> str:
        return "request_batches"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(dict(self.options), schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> BatchStreamWriter:
        return BatchStreamWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes both sources known to the session, and lets it push filters into Python sources, which key_pages takes."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (KeyPages, RequestBatches):
        spark.dataSource.register(source)


def requests_sent(spark: SparkSession, path: str) -> DataFrame:
    """manifest, file, n: the requests that count."""
    m = spark.read.schema("name string, requests array<array<string>>").json(f"{path}/manifests/*.json")
    return m.select(F.col("name").alias("manifest"), F.explode("requests").alias("r")).select("manifest", F.col("r")[0].alias("file"), F.col("r")[1].cast("int").alias("n"))


def rows_sent(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the requests that count, with their manifest."""
    raw = spark.read.schema(schema).json(f"{path}/requests/*/*.json").select("*", F.col("_metadata.file_path").alias("_file"))
    sent = requests_sent(spark, path).select("manifest", F.element_at(F.split("file", "/"), -1).alias("_name"))
    return raw.withColumn("_name", F.element_at(F.split("_file", "/"), -1)).join(sent, "_name").drop("_name", "_file")


def unlisted_removed(path: str) -> int:
    """Removes requests that no manifest names (while no job runs); returns how many."""
    fs, base = _opened(path)
    find = lambda d: [f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/{d}", recursive=True, allow_not_found=True)) if f.type == pafs.FileType.File]
    listed = set()
    for m in find("manifests"):
        with fs.open_input_stream(m) as f:
            listed |= {n.rsplit("/", 1)[-1] for n, _ in json.loads(f.read())["requests"]}
    gone = [f for f in find("requests") if f.rsplit("/", 1)[-1] not in listed]
    for f in gone:
        fs.delete_file(f)
    return len(gone)
