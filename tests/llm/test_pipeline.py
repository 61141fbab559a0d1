"""The pipeline's stages, each on its own input, against plain versions; and the registered queries."""

import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tideline.llm import jaccard_join, secrets
from tideline.llm.batches import BATCH_BYTES, BATCH_SETTING
from tideline.llm.queries import oracle_sql, queries


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "exact copies":
            best = {}
            for d, t, *_ in before:
                plain = re.sub(r"[\x20\x09-\x0D]", "", t or "")
                best[plain] = min(best.get(plain, (1, 0)), (-len(t or ""), d))
            assert set(after) == {d for _, d in best.values()}
        elif name == "near copies":
            brute = jaccard_join.brute([(d, t) for d, t, *_ in before])
            assert set(after) == {d for d, (_, c) in brute.items() if d == c}
        elif name == "secrets":
            assert set(after) == {r[0] for r in before} and not any(secrets.base_spans(t or "") for t in after.values())
    assert {r["doc_id"] for r in docs.collect()} == set(after)


def test_repeated_rows_leave_one(spark, sf):
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (2, "ab", "en", "s", 2), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"] or 0) for r in corpus_pipeline.drop_copies(spark, docs, sf).collect())
    assert kept == [0, 1, 3]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), sf).count() == 0


def test_registered(spark, sf):
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) >= 10
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        got, want = queries()[name](spark, sf).toPandas(), con.execute(sql).df()
        key = got.columns[0]
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        got, want = (f[columns].sort_values(key).reset_index(drop=True) for f in (got, want))
        assert (got == want).all().all(), name


def test_stages_bound_the_bytes_of_batches(spark):
    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("plain words "), 200).alias("text"))
    largest = lambda: max(r["n"] for r in docs.mapInArrow(told, "n long").collect())
    spark.conf.unset(BATCH_SETTING)
    try:
        corpus_pipeline.mask_secrets(spark, docs, "")
        assert largest() < 2 * BATCH_BYTES
        spark.conf.set(BATCH_SETTING, "64m")
        corpus_pipeline.mask_secrets(spark, docs, "")
        assert largest() > 2 * BATCH_BYTES
    finally:
        spark.conf.unset(BATCH_SETTING)


def test_stages_begin_with_a_collection(spark, sf):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        before = full()
        stage(spark, docs, sf)
        assert full() > before, name
