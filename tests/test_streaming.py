from quern.streaming import counters


def test_fold_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    got = counters.fold(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    want = counters.pair_counts(docs)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_windows(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert counters.windowed_events(events).agg({"n": "sum"}).first()[0] == events.count()
