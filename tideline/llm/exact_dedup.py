"""Exact deduplication as a stream with state on disk.

Documents pass as a stream. A first query fingerprints each row: digest of the text without white space, code points of the
original, and the content locator (file and row in it). A second query keeps, per digest and without expiry, the stable identifier and
locator of the row to stay and the number of rows; its state lives in RocksDB and its checkpoint in the shared folder, or in a
folder that the caller names: then a later call goes on with the state and only reads files that are new. Each
digest that was hit more than once is then checked on full bytes, fetched by locator: the least and the greatest normalised text of the
digest must be the same one, which map-side aggregation finds with one text per digest and task. Digests that fail this check (two
texts, one digest) are regrouped by the texts themselves. Rows that were not hit are hashed once and never read again for the check.

Null text counts as empty, and empty texts are equal to each other; texts of any length are read whole; of equal texts the row with most
code points stays, then the one with the smallest doc_id (a null doc_id only if no other), then the one of the least locator: exactly
one row of a group stays, also where ids or whole rows repeat. An empty table gives an empty result; other columns
are ignored by ``deduplicate`` and kept by ``drop_copies``. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.scratch import fresh_path, materialise

#: Settings of the state: in RocksDB, without space set aside for each partition, with changes instead of whole copies as checkpoints.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Locators up to this number (16 bytes each) are sent to every executor; beyond, the texts are joined by a shuffle.
BROADCAST_HITS = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _run(df: DataFrame, label: str, at: str, sink: Callable | None = None) -> str:
    """One pass over what the stream holds now; the folder it wrote to."""
    out = f"{at}/{label}"
    writer = df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/{label}-progress")
    if sink is None:
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.outputMode("update").foreachBatch(lambda batch, number: sink(batch, number, out)).start()
    query.awaitTermination()
    return out


#: The locator of a row that is read from files.
LOCATOR = ("_metadata.file_path AS __file", "_metadata.row_index AS __row")


def located(docs: DataFrame) -> DataFrame:
    """docs with its locators in __file and __row: of the files that docs is read from (and filtered or projected, no more), or else of a
    copy in the shared folder."""
    try:
        return docs.selectExpr("*", *LOCATOR)
    except AnalysisException:
        return materialise(docs, "located").selectExpr("*", *LOCATOR)


def fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, digest, n_chars, file, row of each row of a stream or table with locators."""
    return docs.select("doc_id", digest(normalised(F.col("text"))).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.col("__file").alias("file"), F.col("__row").alias("row"))


def _best() -> Column:
    """Of a group, the row to stay."""
    told = F.struct("doc_id", "file", "row")
    return F.min_by(told, F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "file", "row"))


def keepers(prints: DataFrame) -> DataFrame:
    """The running state: for each digest the row to stay and the rows so far."""
    return prints.groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size"))


def stream_state(spark: SparkSession, rows: DataFrame, digest: Callable[[Column], Column] = sha256, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Pass all rows with locators that the stream holds now; their fingerprints, and the last state of each digest. A table passes, too,
    its fingerprints as the stream. ``at`` names the folder of the state, which a later call on the same stream resumes."""
    if at is not None and not rows.isStreaming:
        raise ValueError("a state that lasts needs a stream")
    at = at.rstrip("/") if at is not None else fresh_path(spark, "dedup")
    flat = fingerprints(rows, digest)
    if flat.isStreaming:
        _run(flat, "fingerprints", at)
    else:
        flat.write.parquet(f"{at}/fingerprints")
    prints = spark.read.schema(flat.schema).parquet(f"{at}/fingerprints")
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        grouped = keepers(spark.readStream.schema(flat.schema).parquet(f"{at}/fingerprints"))
        held = _run(grouped, "state", at, lambda b, n, out: b.write.mode("overwrite").parquet(f"{out}/pass={n}"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = T.StructType([*grouped.schema.fields, T.StructField("pass", T.IntegerType())])
    updates = spark.read.schema(schema).parquet(held) if _exists(spark, held) else spark.createDataFrame([], schema)
    # Each pass wrote the digests that it changed; the last one holds.
    last = updates.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "pass").alias("s")).select("digest", "s.best", "s.group_size")
    return prints, last


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _texts(rows: DataFrame, prints: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The normalised texts of the prints with these digests, fetched by their locators (file's hash, row), and these prints."""
    digests = F.broadcast(digests) if digests.count() <= BROADCAST_HITS else digests
    wanted = materialise(prints.join(digests, "digest", "left_semi").withColumn("at", F.xxhash64("file")), "hits")
    keys = wanted.select("at", "row", "digest")
    texts = rows.select(F.xxhash64("__file").alias("at"), F.col("__row").alias("row"), "text")
    found = texts.join(F.broadcast(keys) if wanted.count() <= BROADCAST_HITS else keys, ["at", "row"])
    return found.select("at", "row", "digest", normalised(F.col("text")).alias("plain")), wanted


def deduplicate(spark: SparkSession, docs: DataFrame, path: str | None = None, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, n_chars, file, row, keep_file, keep_row of each row. path: the Parquet that docs is read
    from, which then passes as a stream; without it docs is fingerprinted as a table and the fingerprints pass as a stream. state: with a
    path, the folder of a state that lasts and is resumed."""
    if path is None:
        rows = located(docs.select("doc_id", "text"))
        stream = rows
    else:
        rows = spark.read.schema(docs.select("doc_id", "text").schema).parquet(path).selectExpr("*", *LOCATOR)
        # As a pattern, since a stream takes no bare file.
        stream = spark.readStream.schema(docs.select("doc_id", "text").schema).parquet(f"{path[:-1]}[{path[-1]}]").selectExpr("*", *LOCATOR)
    return _decided(spark, rows, *stream_state(spark, stream, digest, state))


def _decided(spark: SparkSession, rows: DataFrame, prints: DataFrame, told: DataFrame) -> DataFrame:
    """What ``deduplicate`` returns, of rows with locators, their fingerprints and the state of their digests."""
    told = materialise(told, "digests")
    groups = prints.join(told, "digest")
    texts, wanted = _texts(rows, prints, told.filter("group_size > 1").select("digest"))
    checked = materialise(texts.groupBy("digest").agg((F.min("plain") != F.max("plain")).alias("mixed")), "checked")
    mixed = checked.filter("mixed").select("digest")
    if mixed.isEmpty():
        final = groups
    else:
        # Several texts under one digest: their own bytes group them.
        texts, few = _texts(rows, prints, mixed)
        few = few.join(texts.drop("digest"), ["at", "row"])
        apart = few.groupBy("plain").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size"))
        final = groups.join(mixed, "digest", "left_anti").unionByName(few.join(apart, "plain").select(*groups.columns))
    stays = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    return final.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), stays.alias("kept"), "digest", "n_chars", "file", "row", F.col("best.file").alias("keep_file"), F.col("best.row").alias("keep_row"))


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: exactly one of each group of equal texts."""
    names = docs.columns  # by place, so that no name of theirs clashes with one used here
    rows = located(docs.toDF(*[f"c{k}" for k in range(len(names))]))
    texts = rows.select(F.col(f"c{names.index('doc_id')}").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"), "__file", "__row")
    done = materialise(_decided(spark, texts, *stream_state(spark, texts)).select("file", "row", "kept"), "copies")
    gone = done.filter(~F.col("kept")).select(F.xxhash64("file").alias("__of"), F.col("row").alias("__gone"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_HITS else gone
    left = rows.join(gone, (F.xxhash64("__file") == F.col("__of")) & (F.col("__row") == F.col("__gone")), "left_anti")
    return left.drop("__file", "__row").toDF(*names)


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every row of documents with the row that stays for it."""
    path = f"{sf_dir}/documents.parquet"
    done = deduplicate(spark, spark.read.parquet(path).select("doc_id", "text"), path)
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


EXACT_DEDUP_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS plain FROM documents),
w AS (SELECT doc_id, plain, first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM w
"""
