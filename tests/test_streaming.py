import datetime as dt

from pyspark.sql import functions as F

from codeloom.streaming import incremental

COLUMNS = "repository string, file_path string, name string, suffix string, content binary, content_hash string, collected_at timestamp_ntz, loaded_at timestamp_ntz"


def row(path, content, day, hash_="h"):
    at = dt.datetime(2024, 1, day)
    return ("r", path, path, ".py", content, hash_, at, at)


def test_files_arrive_twice_late_and_changed(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []

    def sink(nodes, edges, number):
        seen.append({r.id for r in nodes.filter("label = 'Method'").collect()})

    def run():
        files = incremental.changed_files(incremental.file_stream(spark, folder))
        incremental.start(files, sink, str(tmp_path / "state")).awaitTermination(120)

    spark.createDataFrame([row("a.py", b"def f(): pass\n", 2), row("a.py", b"def f(): pass\n", 2), row("b.py", b"def g(:\n", 2)], COLUMNS).write.mode("append").parquet(folder)
    run()
    spark.createDataFrame([row("a.py", b"def f(): pass\n", 3), row("b.py", b"def g(): pass\n", 3, "h2"), row("c.py", None, 3)], COLUMNS).write.mode("append").parquet(folder)
    run()
    ids = [x for x in seen if x]
    assert ids == [{"r::a.py#f"}, {"r::b.py#g"}]


def test_parse_rates_per_window(spark):
    rows = [("py", ["e"], dt.datetime(2024, 1, 1, 3)), ("py", [], dt.datetime(2024, 1, 1, 23)), ("java", None, dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "language string, errors array<string>, parsed_at timestamp_ntz")
    got = {(r.language, r.n_files, r.n_errors) for r in incremental.parse_rates(df).collect()}
    assert got == {("py", 2, 1), ("java", 1, 0)}
    assert incremental.parse_rates(df.filter(F.lit(False))).isEmpty()
