"""Victims as a stream: first and last observation, late ones included."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.session import shared_folder


def observe(observations: DataFrame) -> DataFrame:
    """State per victim over a stream of (victim_id, kit_id, source, observed_at); a repeated observation counts once."""
    once = observations.dropDuplicates(["victim_id", "kit_id", "source"])
    return once.groupBy("victim_id").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count(F.lit(1)).alias("kits"))


def merge_batch(current: DataFrame | None, changed: DataFrame) -> DataFrame:
    """Changed states over current ones: min of first, max of last, so replays change nothing."""
    both = changed if current is None else current.unionByName(changed)
    return both.groupBy("victim_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("kits").alias("kits"))


def victim_state(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """Run the stream over all files there are that it has not seen and return the table it keeps.

    ``state`` is the folder of the stream's log and table: a later run with the same one
    goes on where the last one ended. Without it the stream starts anew.
    """
    landed = spark.read.parquet(path)
    stream = spark.readStream.schema(landed.schema)
    folder, name = path.rsplit("/", 1)
    # A stream reads a folder; a single file is picked from its folder by name.
    single = [f.rsplit("/", 1)[1] for f in landed.inputFiles()] == [name]
    orders = stream.option("pathGlobFilter", name).parquet(folder) if single else stream.parquet(path)
    seen = orders.select(F.col("o_custkey").alias("victim_id"), F.col("o_orderkey").alias("kit_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("observed_at"))
    folder = (state or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}").rstrip("/")

    def table_of(epoch: int) -> str:
        return f"{folder}/state-{epoch}"

    def exists(where: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def keep(batch: DataFrame, epoch: int) -> None:
        # A batch that is run again writes the same table from the same one before it.
        current = batch.sparkSession.read.parquet(table_of(epoch - 1)) if epoch and exists(table_of(epoch - 1)) else None
        merge_batch(current, batch).write.mode("overwrite").parquet(table_of(epoch))

    query = observe(seen).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/log").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    done = 0
    while exists(table_of(done + 1)):
        done += 1
    return spark.read.parquet(table_of(done))
