"""Reading and writing practice records: state JSON, packs, manifests, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..operators.due import dense_index

SECRET_FIELDS = ["aikey", "aikeyTs"]


def read_state(spark: SparkSession, path: str, schema: StructType, defaults: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """State documents with defaults, and the texts that aren't JSON (kept aside, not lost)."""
    full = StructType(schema.fields).add("_corrupt", "string")
    # texts are parsed by from_json: a file source may not be asked for its corrupt column alone
    raw = spark.read.text(path).select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    good = raw.where("_corrupt is null").drop("_corrupt")
    return good.fillna(defaults) if defaults else good, raw.where("_corrupt is not null").select(F.col("_corrupt").alias("text"))


def without_secrets(df: DataFrame) -> DataFrame:
    return df.drop(*SECRET_FIELDS)


def export_state(df: DataFrame, path: str) -> None:
    without_secrets(df).write.mode("overwrite").json(path)


def save_both(df: DataFrame, first: str, second: str) -> list[str]:
    """Writes to two places; one is enough. The places that took it."""
    done, errors = [], []
    for path in (first, second):
        try:
            df.write.mode("overwrite").parquet(path)
            done.append(path)
        except Exception as e:  # the other place may still take it
            errors.append(e)
    if not done:
        raise errors[0]
    return done


def route_import(raw: DataFrame) -> dict[str, DataFrame]:
    """Imported documents (kind, items) by kind, each with its own condition."""
    items = raw.select("kind", F.posexplode("items").alias("pos", "item"))
    has = lambda *c: [F.col(f"item.{x}").isNotNull() & (F.col(f"item.{x}").cast("string") != "") for x in c]
    need = {"qpack": has("id"), "flash": has("id", "front"), "notes": has("id", "title"), "outline": has("id", "title")}
    out = {}
    for kind, conditions in need.items():
        d = items.where(F.col("kind") == kind)
        for c in conditions:
            d = d.where(c)
        out[kind] = d.select("pos", "item.*")
    return out


def latest_replica(a: DataFrame, b: DataFrame, key: list[str], stamp: str = "_mt") -> DataFrame:
    """The newer replica's row of each key; ties to a."""
    from ..operators.merge import last_writer

    return last_writer(a, b, key, F.coalesce(stamp, F.lit(0)))


def by_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.where(F.col(key).startswith(prefix))


def replace_scope(df: DataFrame, path: str, scope: str) -> None:
    """Replaces only the scopes (partitions) that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)


def log_upsert(log: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """An append-only log with rows put in: by client id, stamped and marked pending."""
    put = rows.withColumns({"updatedAt": now, "upload_state": F.when(F.coalesce("uploaded", F.lit(False)), "uploaded").otherwise("pending")})
    return log.join(put.select("client_id"), "client_id", "left_anti").unionByName(put, allowMissingColumns=True)


def pending(log: DataFrame, user: str | None, n: int = 80) -> DataFrame:
    """The n oldest rows not uploaded."""
    d = log.where(F.col("upload_state") == "pending")
    d = d.where(F.col("user_id") == user) if user else d
    return d.orderBy("updatedAt", "client_id").limit(n)


def log_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"), F.count_if(F.col("upload_state") == "pending").alias("pending"))


def run_stats(log: DataFrame, prefix: str) -> DataFrame:
    return log.where(F.col("qid").startswith(prefix)).groupBy("qid").agg(F.count("*").alias("total"), F.count_if(F.col("upload_state") == "pending").alias("pending"))


def acknowledged(log: DataFrame, sent: DataFrame) -> DataFrame:
    """Marks rows uploaded whose updatedAt isn't later than what was sent."""
    s = sent.select("client_id", F.col("updatedAt").alias("_sent"))
    ok = F.coalesce(F.col("updatedAt") <= F.col("_sent"), F.lit(False))
    return log.join(s, "client_id", "left").withColumns({"uploaded": F.coalesce("uploaded", F.lit(False)) | ok, "upload_state": F.when(ok, "uploaded").otherwise(F.col("upload_state"))}).drop("_sent")


def page(df: DataFrame, order: list[str], number: int, size: int = 1000) -> DataFrame:
    """A page of an ordered scan; a whole scan needs none."""
    return df.orderBy(*order).offset(number * size).limit(size)


def method_library(methods: DataFrame) -> DataFrame:
    """Methods of each unit in order of their id."""
    return methods.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("id", "lec", "concept", "method"))).alias("methods"), F.count("*").alias("n"))


def pack_items(packs: DataFrame, kind: str) -> DataFrame:
    """All items of packs of a kind (packs: pack_id, kind, items array)."""
    return packs.where(F.col("kind") == kind).select("pack_id", F.posexplode("items").alias("pos", "item")).select("pack_id", "pos", "item.*")


def pack_totals(packs: DataFrame) -> DataFrame:
    return packs.groupBy("kind").agg(F.sum(F.size("items")).alias("n"))


def pack_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """pack_id, action (fetch, push, none, both) by rev."""
    j = local.select("pack_id", F.col("rev").alias("l")).join(remote.select("pack_id", F.col("rev").alias("r")), "pack_id", "full_outer")
    action = F.when(F.col("l").isNull(), "fetch").when(F.col("r").isNull(), "push").when(F.col("r") > F.col("l"), "fetch").when(F.col("l") > F.col("r"), "push").otherwise("none")
    return j.select("pack_id", action.alias("action"))


def manifest_valid(manifest: DataFrame) -> DataFrame:
    """manifest (schema, packs array of structs) with valid."""
    pack = lambda p: p["id"].rlike(r"^[A-Za-z0-9_.:-]+$") & p["file"].rlike(r"^[A-Za-z0-9_.-]+\.json$") & p["sha256"].rlike(r"^[0-9a-f]{64}$")
    return manifest.withColumn("valid", (F.col("schema") == 1) & (F.size("packs") > 0) & F.coalesce(F.forall("packs", pack), F.lit(False)))


def verified_packs(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (name, content) whose SHA-256 is the manifest's (file, sha256, id)."""
    return files.withColumn("_sha", F.sha2("content", 256)).join(manifest, (F.col("name") == F.col("file")) & (F.col("_sha") == F.col("sha256"))).drop("_sha")


def read_pack_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def revoked(local: DataFrame, manifest: DataFrame) -> DataFrame:
    """Curated packs that the manifest no longer lists."""
    return local.where("curated").join(manifest.select(F.col("id").alias("pack_id")), "pack_id", "left_anti")


#: Hex digits of an item's hash that name its leaf, and of a leaf's that name its branch.
LEAF, BRANCH = 4, 2


def content_digest(items: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """by, n, sha256: a digest of each group's rows that doesn't depend on their order or on partitions.

    A tree of hashes: rows' hashes are dealt to leaves by their first digits, and a leaf is
    the hash of its sorted row hashes, a branch that of its sorted leaves, the digest that of
    its branches. No array holds more than the hashes of a leaf, one in 65,536 of a group's
    rows, and a large group's leaves are many tasks' work. Equal rows count each; a null
    and an empty text are different.
    """
    field = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    rows = items.select(*by, F.sha2(F.concat(*[field(c) for c in columns]), 256).alias("_h"))
    level = lambda d, key, n: d.groupBy(*by, *key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_d"), F.sum(n).alias("n"))
    leaves = level(rows.withColumn("_k", F.substring("_h", 1, LEAF)), ["_k"], F.lit(1))
    named = lambda d: d.withColumn("_h", F.concat("_k", "_d"))
    branches = level(named(leaves).withColumn("_b", F.substring("_k", 1, BRANCH)), ["_b"], F.col("n"))
    return level(named(branches.withColumnRenamed("_b", "_k")), [], F.col("n")).select(*by, F.col("n").cast("long").alias("n"), F.col("_d").alias("sha256"))


def source_packs(accepted: DataFrame, default: str = "unknown") -> DataFrame:
    """src, n, file, sha256 of each source's accepted items: what a manifest lists, files numbered in order of sources."""
    src = F.coalesce(F.nullif("src", F.lit("")), F.lit(default))
    g = content_digest(accepted.select(src.alias("src"), "id", "q"), ["src"], "id", "q")
    return g.join(dense_index(g, "src"), "src").select("src", "n", text.file_name(F.col("src"), F.col("idx")).alias("file"), "sha256")


def write_packs(accepted: DataFrame, path: str, default: str = "unknown") -> None:
    accepted.withColumn("src", F.coalesce(F.nullif("src", F.lit("")), F.lit(default))).write.mode("overwrite").partitionBy("src").json(path)


def collated(df: DataFrame, column: str, locale: str = "zh_Hant") -> DataFrame:
    """Ordered as the locale has it."""
    return df.orderBy(F.collate(column, locale))


def adopted(rows: DataFrame, user: str) -> DataFrame:
    """Ownerless rows become the user's, once."""
    return rows.withColumn("user_id", F.coalesce("user_id", F.lit(user)))


def insert_missing(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def snapshot_rows(log: DataFrame, upto: int, pos: str = "pos") -> DataFrame:
    """A log as it was after `upto` rows."""
    return log.where(F.col(pos) < upto)
