"""Pages that make up the table, and batches that count only when the job did."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstone.sources import requests


@pytest.fixture(scope="module")
def ready(spark):
    requests.register(spark)
    return spark


def store(tmp_path, n=5000):
    os.makedirs(f"{tmp_path}/t", exist_ok=True)
    keys = [None if k % 997 == 5 else k * 3 for k in range(n)]
    for part in range(3):
        t = pa.table({"id": pa.array(keys[part::3] if part else keys[::3], pa.int64()), "name": [f"n{k % 7}-{k}" for k in range(len(keys[part::3]))]})
        pq.write_table(t, f"{tmp_path}/t/p{part}.parquet", row_group_size=300)
    return f"{tmp_path}/t"


@pytest.mark.parametrize("ranges", [1, 4, 50])
def test_pages_are_the_table(ready, tmp_path, ranges):
    path = store(tmp_path)
    pages = ready.read.format("key_pages").option("path", path).option("key", "id").option("page", 100).option("ranges", ranges).load()
    assert sorted(map(str, pages.collect())) == sorted(map(str, ready.read.parquet(path).collect()))
    reader = requests.KeyPagesReader({"path": path, "key": "id", "page": 100, "ranges": ranges}, pages.schema)
    parts = reader.partitions()
    assert len(parts) <= ranges + 1 and (len(parts) > 1) == (ranges > 1)
    for p in parts:
        got = list(reader.read(p))
        keys = [k for b in got for k in b.column("id").to_pylist() if k is not None]
        assert keys == sorted(keys) and all(b.num_rows <= 100 for b in got)


def test_filters_go_into_requests(ready, tmp_path):
    path = store(tmp_path)
    pages = ready.read.format("key_pages").option("path", path).option("key", "id").load()
    plain = ready.read.parquet(path)
    for c in (F.col("id") > 9000, F.col("id") == 300, F.col("id").isin(3, 6, 7), F.col("name").startswith("n3-"), (F.col("id") >= 30) & (F.col("id") < 60) & (F.length("name") > 3)):
        assert sorted(map(str, pages.where(c).collect())) == sorted(map(str, plain.where(c).collect()))
    reader = requests.KeyPagesReader({"path": path, "key": "id"}, pages.schema)
    assert list(reader.pushFilters([requests.GreaterThan(("id",), 9000)])) == []
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == plain.where("id > 9000").count()


def test_batches_of_eighty(ready, tmp_path):
    path = str(tmp_path / "sink")
    df = ready.range(1000).repartition(3).select("id", F.concat(F.lit("é"), "id").alias("v"))
    df.write.format("request_batches").mode("append").option("path", path).save()
    sent = requests.requests_sent(ready, path)
    assert sent.agg(F.max("n")).first()[0] == 80 and sent.agg(F.sum("n")).first()[0] == 1000
    assert sorted((r["id"], r["v"]) for r in requests.rows_sent(ready, path, "id long, v string").collect()) == [(k, f"é{k}") for k in range(1000)]
    with pytest.raises(Exception, match="1 to 80"):
        df.write.format("request_batches").mode("append").option("path", path).option("size", 81).save()


def test_a_failed_job_leaves_nothing(ready, tmp_path):
    path = str(tmp_path / "sink")
    bad = ready.range(1000).repartition(2).select(F.when(F.col("id") == 777, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("request_batches").mode("append").option("path", path).save()
    assert not os.path.exists(f"{path}/manifests") and not [f for _, _, fs in os.walk(path) for f in fs]


def test_a_repeated_batch_of_a_stream_replaces_itself(ready, tmp_path):
    ready.range(200).write.parquet(f"{tmp_path}/in")
    s = ready.readStream.schema("id long").parquet(f"{tmp_path}/in")
    for k in range(2):  # a second run with its checkpoint lost sends batch 0 again
        s.writeStream.format("request_batches").option("path", f"{tmp_path}/sink").option("checkpointLocation", f"{tmp_path}/c{k}").trigger(availableNow=True).start().awaitTermination()
    assert os.listdir(f"{tmp_path}/sink/manifests") and sorted(r["id"] for r in requests.rows_sent(ready, f"{tmp_path}/sink", "id long").collect()) == list(range(200))
    assert requests.unlisted_removed(f"{tmp_path}/sink") >= 3 and requests.unlisted_removed(f"{tmp_path}/sink") == 0
    assert requests.rows_sent(ready, f"{tmp_path}/sink", "id long").count() == 200
    with open(f"{tmp_path}/sink/manifests/batch-000000000000.json") as f:
        assert all(n <= 80 for _, n in json.load(f)["requests"])
