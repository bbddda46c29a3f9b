"""Streams against batch: restarts, row budgets, running class counts."""

from pyspark.sql import functions as F

from starlens.streaming import stream as st


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_updates_and_restart(spark):
    path = st.scratch_dir(spark, "t-updates")
    schema = "cluster_name string, rating int, sentiment string"
    feed(spark, path + "/in", [("a", 5, "Positive"), ("b", 1, "Negative")], schema)

    def run(mode):
        src = st.stream_source(spark, path + "/in", spark.read.parquet(path + "/in").schema, max_files_per_trigger=1)
        kpis = st.streaming_kpis(src)
        if mode == "update":
            return st.run_updates(kpis, ["cluster_name"], path + "/ck-u", path + "/out-u")
        return st.run_complete(kpis, path + "/ck-c", path + "/out-c")

    def totals(df):
        return sorted(((r.cluster_name, r.total, r.rating_sum) for r in df.collect()), key=repr)

    for mode in ("update", "complete"):
        assert totals(run(mode)) == [("a", 1, 5.0), ("b", 1, 1.0)]
        assert totals(run(mode)) == [("a", 1, 5.0), ("b", 1, 1.0)]         # nothing new: the last result
    feed(spark, path + "/in", [("a", 3, "Neutral"), (None, 2, None)], schema)
    for mode in ("update", "complete"):
        assert totals(run(mode)) == [("a", 2, 8.0), ("b", 1, 1.0), (None, 1, 2.0)]
    batches = st.finished_batches(spark, path + "/out-u")
    assert len(batches) == 2
    last = spark.read.parquet(f"{path}/out-u/batch={batches[-1]}")
    assert sorted(str(r.cluster_name) for r in last.collect()) == ["None", "a"]      # b did not change


def test_row_budget(spark):
    path = st.scratch_dir(spark, "t-budget")
    schema = spark.createDataFrame([], "k long, t string").schema
    for part in range(4):
        feed(spark, path + "/in", [(part * 10 + i, "x") for i in range(10)], schema)

    def run():
        src = st.stream_source(spark, path + "/in", schema, max_files_per_trigger=1)
        st.ingest_bounded(src, path + "/out", path + "/ck", 25, "k").awaitTermination()
        return sorted(r.k for r in spark.read.parquet(path + "/out").collect())

    first = run()
    assert len(first) == 25 == len(set(first))
    feed(spark, path + "/in", [(99, "late")], schema)
    assert run() == first


def test_running_class_counts(spark):
    path = st.scratch_dir(spark, "t-weights")
    schema = spark.createDataFrame([], "review_id long, star_label int").schema
    for part in range(3):
        feed(spark, path + "/in", [(part * 10 + i, i % 2 if part else 2) for i in range(6)], schema)
    src = st.stream_source(spark, path + "/in", schema, max_files_per_trigger=1)
    st.score_stream(src, lambda b: b, path + "/out", path + "/ck", label="star_label",
                    counts_path=path + "/counts").awaitTermination()
    got = {r.star_label: (r.n_c, r.class_weight) for r in st.running_class_weights(spark, path + "/counts").collect()}
    assert got == {0: (6, 1.0), 1: (6, 1.0), 2: (6, 1.0)}
    assert spark.read.parquet(path + "/out").agg(F.count("*")).first()[0] == 18
    assert st.running_class_weights(spark, path + "/none").count() == 0


def test_stream_files_follow_the_splits(spark):
    """The files of a stream grow in number with its table, its batches do not."""
    import glob

    from starlens.plans import registry  # noqa: F401  (registers the queries in order)
    from starlens.plans.q_stream import _files
    df = spark.range(0, 4000, 1, 40)
    for table, n, each in ((df, 40, 10), (df.coalesce(2), 4, 1)):
        path, files = _files(table, spark, "t-files")
        assert len(glob.glob(f"{path.removeprefix('file:')}/in/part-*")) == n and files == each
        assert spark.read.parquet(path + "/in").distinct().count() == 4000
