import datetime as dt

from tesserae.streaming import facts as S

T = dt.datetime(2024, 1, 1)
SCHEMA = "id string, entity_id string, predicate string, object string, at timestamp_ntz"


def test_supersede_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    b1 = [("1", "e", "P", "x", T), ("2", "e", "p", "X", T + dt.timedelta(1)), ("3", "f", "p", None, T), ("4", "f", "q", "u", T)]
    b2 = [("5", "e", "p", "y", T + dt.timedelta(2)), ("6", "e", "p", "w", T - dt.timedelta(9)), ("7", "f", "q", "u", T + dt.timedelta(3))]
    q = None
    for rows in (b1, b2):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        if q is None:
            stream = spark.readStream.schema(SCHEMA).parquet(src)
            q = S.supersede_stream(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: out.extend(df.collect())).start()
        q.processAllAvailable()
    q.stop()
    assert [(r.id, r.object, r.superseded) for r in sorted(out, key=lambda r: r.id)] == [("1", "x", None), ("4", "u", None), ("5", "y", "x")]


def test_access_writer(spark):
    state = {"df": spark.createDataFrame([("a", 0, T), ("b", 5, T)], "id string, access_count int, last_accessed_at timestamp_ntz")}
    write = S.access_writer(lambda: state["df"], lambda df, n: state.update(df=df), lambda: "2024-02-01 00:00:00")
    write(spark.createDataFrame([("b",), ("b",), ("zz",)], "id string"), 0)
    assert {r.id: r.access_count for r in state["df"].collect()} == {"a": 0, "b": 6}


def test_arrivals(spark):
    df = spark.createDataFrame([(T,), (T + dt.timedelta(hours=3),), (T + dt.timedelta(days=2),)], "created_at timestamp_ntz")
    assert sorted(r.n for r in S.arrivals(df).collect()) == [1, 2]
