"""Exact duplicates found by a stateful stream.

Documents land once, with a row locator and a digest of their normalised text.
A stream reads the landed digests; its keyed state lives on disk (RocksDB), never
expires, and holds per digest the smallest identifier, the locator of that row's
content and the number of rows. A digest that was hit is not trusted: the bytes of
every copy are compared with the bytes at the locator, and a digest shared by
different texts is grouped by the texts themselves.

Defined cases: a null text counts as empty; a null id sorts after all others;
repeated rows with one id are copies like any other (the first landed stays);
an empty table gives an empty result; other columns travel in the ``document``
struct and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import stored
from tickloom.session import scratch_path

#: Settings of the state store: on disk, change logs instead of whole snapshots, one memory bound for all stores of an executor.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
}
#: How many partitions a stream's state has (else as many as a shuffle).
STATE_PARTITIONS = "spark.sql.streaming.internal.stateStore.partitions"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def land(docs: DataFrame, id_column: str, text_column: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Store the documents with a locator that stays the same from here on."""
    return stored(
        docs.select(
            F.struct("*").alias("document"),
            F.col(id_column).alias("id"),
            F.monotonically_increasing_id().alias("locator"),
            digest(normalised(F.col(text_column))).alias("digest"),
        ),
        "landed",
    )


def first_seen(landed: DataFrame, files_per_batch: int | None = None, rows_per_state: int = 100_000) -> DataFrame:
    """digest, keeper (no_id, id, locator), group_size, from the stream's state.

    Each state partition is a database of its own with some MB of files however little it
    holds, so their number follows the rows.
    """
    spark = landed.sparkSession
    updates, state = scratch_path(spark, "first-seen"), scratch_path(spark, "dedup-state")
    source = sorted({f.rsplit("/", 1)[0] for f in landed.inputFiles()})
    if not source:
        return _groups(landed)
    # A session of its own: other queries of the caller's go on with the caller's settings.
    own = spark.newSession()
    for key, value in (STATE_STORE | {STATE_PARTITIONS: str(landed.count() // rows_per_state + 1)}).items():
        own.conf.set(key, value)
    stream = own.readStream.schema(landed.schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    seen = _groups(stream.parquet(*source))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={batch_id}")

    run = (
        seen.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    # A later batch repeats a digest with a smaller or equal keeper and a larger count.
    return (
        spark.read.schema(seen.schema).parquet(updates)
        .groupBy("digest").agg(F.min("keeper").alias("keeper"), F.max("group_size").alias("group_size"))
    )


def _groups(landed: DataFrame) -> DataFrame:
    keeper = F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")
    return landed.groupBy("digest").agg(F.min(keeper).alias("keeper"), F.count(F.lit(1)).alias("group_size"))


def copy_labels(
    landed: DataFrame,
    text_column: str = "text",
    files_per_batch: int | None = None,
) -> DataFrame:
    """locator, id, digest, keep_id, group_size, kept: one row per landed row."""
    groups = stored(first_seen(landed, files_per_batch), "copy-groups")
    labels = stored(
        landed.select("locator", "id", "digest").join(groups, "digest").select(
            "locator", "id", "digest", F.col("keeper.id").alias("keep_id"), F.col("keeper.locator").alias("keep_locator"), "group_size"
        ),
        "copy-labels",
    )
    content = landed.select("locator", normalised(F.col(f"document.{text_column}")).alias("content"))
    hits = labels.where("group_size > 1")
    members = hits.select("locator", "digest", "keep_locator").join(content, "locator")
    keepers = (
        hits.where("locator = keep_locator").select("locator").join(content, "locator")
        .select(F.col("locator").alias("keep_locator"), F.col("content").alias("kept_content"))
    )
    collided = stored(
        members.join(keepers, "keep_locator").where("content != kept_content").select("digest").distinct(), "collisions"
    )
    if not collided.isEmpty():
        labels = _separate(labels, collided, content)
    return labels.select("locator", "id", "digest", "keep_id", "group_size", (F.col("locator") == F.col("keep_locator")).alias("kept"))


def _separate(labels: DataFrame, collided: DataFrame, content: DataFrame) -> DataFrame:
    """Group the rows of these digests by their texts."""
    apart = labels.join(collided, "digest").select("locator", "id", "digest").join(content, "locator")
    keeper = F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")
    groups = apart.groupBy("digest", "content").agg(F.min(keeper).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    right = apart.join(groups, ["digest", "content"]).select(
        "locator", "id", "digest", F.col("keeper.id").alias("keep_id"), F.col("keeper.locator").alias("keep_locator"), "group_size"
    )
    return labels.join(collided, "digest", "left_anti").unionByName(right)


def exact_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
) -> DataFrame:
    """locator, id, digest, keep_id, group_size, kept: one row per input row."""
    return copy_labels(land(docs, id_column, text_column, digest), text_column, files_per_batch)


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    landed = land(docs, id_column, text_column, sha256)
    kept = copy_labels(landed, text_column).where("kept").select("locator")
    return landed.join(kept, "locator", "left_semi").select("document.*")
