import os
import time

import pytest
from pyspark.sql import functions as F

from tallymatch.sources import listing
from tallymatch.sources.folders import list_folder


@pytest.fixture
def tree(tmp_path):
    for name in ("a/1.jpg", "a/2.JPG", "a/b/c/d/3.jpeg", "a/b/_4.jpg", ".5.jpg", "noext", "a/.hidden", "x y/6 #%.txt", "a/7.", "z/8.jpg.txt"):
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    (tmp_path / "tree/link").symlink_to(tmp_path / "tree/a")
    (tmp_path / "tree/one.jpg").symlink_to(tmp_path / "tree/noext")
    return str(tmp_path / "tree")


def read(spark, tree, **options):
    listing.register(spark)
    return spark.read.format("file_listing").options(path=tree, **options).load()


def pairs(table):
    return sorted((row.path, row.size) for row in table.select("path", "size").collect())


@pytest.mark.parametrize("depth", [0, 1, 2, 9])
def test_equals_list_folder(spark, stage, tree, depth):
    assert pairs(read(spark, tree, recursive=True, depth=depth)) == pairs(list_folder(spark, tree, stage, recursive=True))
    assert pairs(read(spark, tree, depth=depth)) == pairs(list_folder(spark, tree, stage))


def test_one_partition_a_folder(spark, tree):
    assert read(spark, tree).rdd.getNumPartitions() == 1
    # The top, a, x y, z; below a, b with all that is deeper.
    assert read(spark, tree, recursive=True).rdd.getNumPartitions() == 5


def test_suffix_and_name(spark, tree):
    rows = {r.name: r.suffix for r in read(spark, tree, recursive=True).collect()}
    assert rows["2.JPG"] == ".jpg" and rows["8.jpg.txt"] == ".txt" and rows["_4.jpg"] == ".jpg" and rows[".5.jpg"] == ".jpg"
    assert rows["noext"] == rows[".hidden"] == rows["7."] == ""


def test_filters_reach_the_source(spark, tree):
    table = read(spark, tree, recursive=True)
    asked = table.filter(F.col("suffix").isin(".jpg", ".jpeg") & F.col("name").endswith("jpg") & (F.col("size") > 3))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    kept = [line for line in plan.splitlines() if "Filter" in line and "suffix" in line]
    assert not [line for line in kept if "suffix" in line.split("PushedFilters")[0] and " IN " in line.split("PushedFilters")[0]]
    assert sorted(r.name for r in asked.collect()) == sorted(
        r.name for r in table.collect() if r.suffix in (".jpg", ".jpeg") and r.name.endswith("jpg") and r.size > 3
    )
    assert "In(" in plan or "IN" in plan.upper().split("PUSHEDFILTERS")[-1]


def test_a_filtered_file_is_not_looked_at(tree):
    seen = []

    class Watched(listing.Wanted):
        def takes(self, found):
            return super().takes(found) and not seen.append(found.name)

    list(listing.listed(listing.Folder(tree, True), True, Watched((("suffix", "in", (".jpeg",)),))))
    assert seen == ["3.jpeg"]


def test_stream_takes_each_file_once(spark, stage, tree):
    listing.register(spark)
    out, progress = stage.path("out"), stage.path("progress")

    def step():
        stream = spark.readStream.format("file_listing").options(path=tree, recursive=True, settle=0).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return sorted(r.path for r in spark.read.parquet(out).collect())

    before = step()
    assert before == [path for path, _ in pairs(read(spark, tree, recursive=True))]
    assert step() == before
    time.sleep(0.05)
    new = os.path.join(tree, "a/b/9.jpg")
    with open(new, "w") as file:
        file.write("9")
    assert step() == sorted([*before, new])


def test_a_missing_folder_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="Folder not found"):
        read(spark, str(tmp_path / "none")).collect()
    with pytest.raises(Exception, match="needs the option path"):
        spark.read.format("file_listing").load().collect()
