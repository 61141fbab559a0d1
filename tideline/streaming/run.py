"""Running a stream to its end over stored rows: for tests, backfills, and the equality of batch and stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans import views
from tideline.streaming.session import filter_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def folder(spark: SparkSession) -> str:
    """A fresh folder in spark.checkpoint.dir, or, in local tests that set none, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tideline-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_to_end(streamed: DataFrame, mode: str, out: str, at: str) -> DataFrame:
    """Start the query on what is there, wait, and read what it wrote; ``batch`` numbers the micro-batches."""
    spark = streamed.sparkSession
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        streamed.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(out)


def final_states(spark: SparkSession, sf: str, model: dict, files: int = 4) -> DataFrame:
    """symbol, ts_ns, level, ll, steps after all users' ticks went through streaming sessions, a file a micro-batch, in order of time."""
    at = folder(spark)
    ticks = views.kalman_ticks(spark, sf).withColumn("command", F.lit(None).cast("string")).select("symbol", "ts_ns", "seq", "values", "command")
    bounds = ticks.approxQuantile("ts_ns", [k / files for k in range(1, files)], 0.01)
    part = sum(((F.col("ts_ns") > b).cast("int") for b in bounds), F.lit(0))
    for k in range(files):
        ticks.filter(part == k).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{at}/in")
    told = run_to_end(filter_stream(stream, model, drain=True), "update", f"{at}/out", at).filter("kind = 'batch'")
    last = told.groupBy("symbol").agg(F.max_by(F.struct("ts_ns", "x", "ll", "steps"), "batch").alias("s")).select("symbol", "s.*")
    return last.select("symbol", "ts_ns", F.round(F.get("x", 0), 6).alias("level"), F.round("ll", 6).alias("ll"), "steps")
