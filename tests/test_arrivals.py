import random
from pathlib import Path

from pyspark.sql import functions as F

import file_queries
from tallymatch.operators.keyed import keyed_roster
from tallymatch.operators.spread import Limits
from tallymatch.plans.reconcile import reconcile
from tallymatch.sources.storage import plain_path
from tallymatch.streaming.arrivals import FILES, ROWS, Arrivals

ROSTER = "row_number long, key_raw string, target_raw string, name string"


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def test_stream_and_batch_agree_after_every_arrival(spark, stage):
    rows = spark.createDataFrame(
        [(2, "1", "a", ""), (3, "2", "b", ""), (4, "3", "c", ""), (5, "3", "d", ""), (6, "", "e", ""), (7, "4", "f", "")],
        ROSTER,
    )
    batches = [["x/1.jpg", "x/9.jpg", "x/readme"], ["y/1.jpg", "x/3.jpg"], ["z/nothing.txt"], ["x/2.jpeg"]]
    incoming, state = stage.path("incoming"), stage.path("state")
    seen = []
    for paths in batches:
        seen += paths
        listing = spark.createDataFrame([(path, 1) for path in paths], "path string, size long")
        listing.coalesce(1).write.mode("append").parquet(incoming)
        # Started anew for every batch: it goes on from its state.
        running = Arrivals(keyed_roster(rows), "out", state, limits=Limits(2, 2))
        running.start(incoming).awaitTermination()
        everything = spark.createDataFrame([(path, 1) for path in seen], "path string, size long")
        assert rows_of(running.audit()) == rows_of(reconcile(rows, everything, "out").audit)


def test_random_changes_on_both_sides(spark, stage):
    """Rows and files come and go at random; after each batch the audit is that of a match of what is left."""
    rng = random.Random(11)
    keys, targets = ["1", "2", "3", "04", " x 5", ""], ["a", "A", "b", "ß", "SS", "c/d", "", "e", "f"]
    rows = {n: (n, rng.choice(keys), rng.choice(targets), "") for n in range(2, 9)}
    files = []
    first = spark.createDataFrame(list(rows.values()), ROSTER)
    incoming, changes, state = (stage.path(name) for name in ("incoming", "changes", "state"))
    for batch in range(7):
        of_files, of_rows = [], []
        for _ in range(5):
            if files and rng.random() < 0.45:
                of_files.append((files.pop(rng.randrange(len(files))), 1, -1))
            else:
                path = f"{rng.choice('ab')}/{batch}-{rng.randrange(99)}/{rng.choice(['1', '2', '3', '04', 'X5', '7', 'no'])}.{rng.choice(['jpg', 'txt', 'jpeg'])}"
                if path not in files:
                    files.append(path)
                    of_files.append((path, 1, None))
        for n in rng.sample(range(2, 14), 3):
            if n in rows:
                of_rows.append((*rows.pop(n), -1))
            if rng.random() < 0.7:
                rows[n] = (n, rng.choice(keys), rng.choice(targets), "")
                of_rows.append((*rows[n], 1))
        spark.createDataFrame(of_files, FILES).coalesce(1).write.mode("append").parquet(incoming)
        spark.createDataFrame(of_rows, ROWS).coalesce(1).write.mode("append").parquet(changes)
        running = Arrivals(keyed_roster(first), "out", state)
        running.start(incoming, rows=changes).awaitTermination()
        left = spark.createDataFrame([(path, 1) for path in files], "path string, size long")
        whole = spark.createDataFrame(list(rows.values()), ROSTER)
        assert rows_of(running.audit(stage)) == rows_of(reconcile(whole, left, "out").audit), batch


def test_a_batch_reads_its_own_events_alone(spark, stage):
    """The last of many batches reads and updates as many rows as the first."""
    roster = spark.range(2, 402).select(
        F.col("id").alias("row_number"), F.col("id").cast("string").alias("key_raw"), F.concat(F.lit("t"), "id").alias("target_raw"), F.lit("").alias("name")
    )
    incoming = stage.path("incoming")
    for batch in range(8):
        paths = spark.range(50).select(F.format_string(f"{batch}/%d.jpg", F.col("id") * 8 + batch).alias("path"), F.lit(1).cast("long").alias("size"))
        paths.coalesce(1).write.mode("append").parquet(incoming)
    running = Arrivals(keyed_roster(roster), "out", stage.path("state"))
    stream = running.start(incoming, most_files=1)
    stream.awaitTermination()
    progress = [p for p in stream.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [50] * 8
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in progress] == [51] * 8
    assert running.counts().filter("kind = 'key'").count() == 400


def test_events_that_are_not_taken_yet_do_not_show(spark, stage):
    rows = spark.createDataFrame([(2, "1", "a", ""), (3, "2", "b", "")], ROSTER)
    incoming = stage.path("incoming")
    running = Arrivals(keyed_roster(rows), "out", stage.path("state"))
    assert rows_of(running.audit()) == rows_of(reconcile(rows, spark.createDataFrame([], "path string, size long"), "out").audit)
    for path in ("x/1.jpg", "x/2.jpg"):
        spark.createDataFrame([(path, 1)], "path string, size long").coalesce(1).write.mode("append").parquet(incoming)
        if path == "x/1.jpg":
            running.start(incoming).awaitTermination()
    one = spark.createDataFrame([("x/1.jpg", 1)], "path string, size long")
    assert rows_of(running.audit()) == rows_of(reconcile(rows, one, "out").audit)


def test_batches_do_not_grow_with_the_files(spark, tmp_path, monkeypatch):
    """50,000 files come in no more listings, each a batch of its own, than 500 do, and every file is audited."""
    spark.range(1, 51).selectExpr("id as c_custkey", "'n' as c_name").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1, 50_001).selectExpr("id as p_partkey", "int(id % 50) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    listings, start = [], Arrivals.start

    def counted(self, incoming, *args, **more):
        listings.append(len([*Path(plain_path(incoming)).glob("*.parquet")]))
        return start(self, incoming, *args, **more)

    monkeypatch.setattr(Arrivals, "start", counted)
    found = file_queries.arrivals(spark, str(tmp_path))
    assert listings == [file_queries.TASKS]
    view = [file_queries.X.view(spark, str(tmp_path), sql) for sql in (file_queries.X.ROSTER, file_queries.X.ASSETS)]
    expected = reconcile(*view, "out").audit.select(*found.columns)
    assert found.count() == expected.count() and not found.exceptAll(expected).count()
