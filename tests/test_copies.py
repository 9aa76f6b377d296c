"""Copies dealt out by bytes, equality up to the first difference, the report as one file."""

import hashlib
import io
import os
import random
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from file_queries import roster_rows, write_files
from tallymatch import labels as L
from tallymatch.operators import files
from tallymatch.operators.files import copy_files, in_bins
from tallymatch.operators.sinks import BYTE_ORDER_MARK, Joined, write_report, write_report_file
from tallymatch.sources import folders, storage
from tallymatch.sources.folders import list_folder
from tallymatch.sources.storage import Aside, content_hash, copy_into_place, same_bytes, write_into_place

ROWS = "row_number long, source string, destination string, size long, status string, detail string"


def files_of(spark, folder, sizes):
    rng = random.Random(3)
    (folder / "in").mkdir()
    (folder / "out").mkdir()
    rows = []
    for n, size in enumerate(sizes):
        path = folder / "in" / f"{n}.bin"
        path.write_bytes(rng.randbytes(size))
        os.utime(path, (10**9 + n, 10**9 + n))
        rows.append((n, str(path), str(folder / "out" / f"{n}.bin"), size, "", ""))
    return spark.createDataFrame(rows, ROWS)


def test_ranges_and_whole_files(spark, stage, tmp_path):
    """Every size around the borders of ranges; a source that is gone, one that has shrunk, a destination that is a folder."""
    rows = files_of(spark, tmp_path, [0, 1, 999, 1000, 1001, 1999, 2000, 2001, 12345, 5000, 7000])
    os.remove(tmp_path / "in/9.bin")
    (tmp_path / "in/10.bin").write_bytes(b"short")
    (tmp_path / "out/4.bin").mkdir()
    (tmp_path / "out/4.bin/x").write_bytes(b"")
    done = {r.row_number: r for r in copy_files(rows, stage, range_bytes=1000).collect()}
    assert len(done) == 11
    assert {n for n, r in done.items() if r.status == L.COPY_FAILED} == {4, 9, 10}
    assert all("Error: " in done[n].detail for n in (4, 9, 10))
    for n in {*done} - {4, 9, 10}:
        one, other = tmp_path / f"in/{n}.bin", tmp_path / f"out/{n}.bin"
        assert done[n].status == L.APPLIED and one.read_bytes() == other.read_bytes()
        assert os.stat(one).st_mtime == os.stat(other).st_mtime
    assert not [name for name in os.listdir(tmp_path / "out") if name.endswith(".part")]
    assert copy_files(rows.limit(0), stage).count() == 0


def test_one_large_file_among_many_small_ones(spark, stage):
    """2 GB in ranges of 64 MB beside 10,000 files of 100 kB: no task has more than twice the bytes of the median."""
    small = spark.range(10_000).select(F.concat(F.lit("s"), "id").alias("destination"), F.lit(0).alias("part"), F.lit(100_000).alias("bytes"))
    large = spark.range(32).select(F.lit("big").alias("destination"), F.col("id").cast("int").alias("part"), F.lit(64 << 20).alias("bytes"))
    bins = in_bins(small.unionByName(large), F.col("bytes"), 24, stage)
    held = [r.n for r in bins.groupBy("bin").agg(F.sum("bytes").alias("n")).collect()]
    assert len(held) == 24 and bins.count() == 10_032
    assert max(held) <= 2 * sorted(held)[12]


def test_equality_reads_up_to_the_first_difference(tmp_path):
    one, other = tmp_path / "one", tmp_path / "other"
    whole = random.Random(4).randbytes(1_000_000)
    one.write_bytes(whole)
    for at, most in ((0, 1000), (500_000, 501_000), (999_999, 1_000_000)):
        other.write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        same, read = same_bytes(str(one), str(other), 1000)
        assert not same and at < read <= most
    other.write_bytes(whole[:-1])
    assert same_bytes(str(one), str(other), 1000) == (False, 1_000_000)
    other.write_bytes(whole)
    assert same_bytes(str(one), str(other), 1000) == (True, 1_000_000)


@pytest.mark.parametrize("files", [1, 5, None])
def test_report_in_one_file(spark, stage, tmp_path, files):
    """The bytes of the parts one after the other, mark and header once."""
    audit = spark.range(3000).selectExpr(
        "if(id % 3 = 0, null, (id * 7919) % 3001) as row_number", "'a,b' as key_raw", "'\"q\"' as target_raw", "' é\n' as name",
        "'X' as status", "concat(id % 10, '/', id, '.jpg') as source", "'' as destination", "'' as detail", "'hot' as key",
    )
    path = tmp_path / "new" / "report.csv"
    write_report_file(audit, str(path), stage, files)
    write_report(audit, str(tmp_path / "parts"), files)
    expected = b""
    for part in sorted(p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-")):
        content = part.read_bytes()
        expected += content if not expected else content[content.index(b"\n") + 1 :]
    assert path.read_bytes() == expected and expected.startswith(BYTE_ORDER_MARK.encode())
    assert os.listdir(path.parent) == ["report.csv"]
    write_report_file(audit.limit(0), str(path), stage, files)
    assert path.read_text(encoding="utf-8-sig") == "row_number,key_raw,target_raw,name,status,source,destination,detail\n"


def test_parts_as_one_stream(tmp_path):
    for name in "ab":
        (tmp_path / name).write_bytes(name.encode() * 3)
    stream = Joined(b"top\n", [str(tmp_path / "a"), str(tmp_path / "b")])
    out = b""
    while piece := stream.read(2):
        out += piece
    assert out == b"top\naaabbb"


def test_small_ranges_share_tasks(spark, stage, tmp_path, monkeypatch):
    """600 ranges of 10 bytes are not 600 tasks: ranges are dealt out like small files."""
    seen, bins = [], in_bins
    monkeypatch.setattr(files, "in_bins", lambda pieces, weight, n, stage: seen.append(n) or bins(pieces, weight, n, stage))
    rows = files_of(spark, tmp_path, [60] * 100)
    assert {r.status for r in copy_files(rows, stage, range_bytes=10).collect()} == {L.APPLIED}
    assert seen == [spark.sparkContext.defaultParallelism]
    assert all((tmp_path / f"in/{n}.bin").read_bytes() == (tmp_path / f"out/{n}.bin").read_bytes() for n in range(100))


def test_a_listing_of_one_folder_is_dealt_out(spark, stage, tmp_path):
    """One task lists a folder; what reads the listing is more than one task."""
    files_of(spark, tmp_path, [1] * 200)
    listing = list_folder(spark, str(tmp_path / "in"), stage)
    assert listing.count() == 200
    assert listing.select(F.spark_partition_id()).distinct().count() > 1


def test_files_in_the_making_lie_aside(tmp_path):
    """A temporary file is no entry of the folder that all tasks write to, and its own folder goes at the end, also after a failure."""
    (tmp_path / "in.bin").write_bytes(b"abc")
    (tmp_path / "out/b.bin").mkdir(parents=True)
    with Aside("7") as aside:
        write_into_place(io.BytesIO(b"x"), str(tmp_path / "new/deep/a.bin"), aside)
        copy_into_place(str(tmp_path / "in.bin"), str(tmp_path / "out/a.bin"), aside)
        with pytest.raises(OSError):
            copy_into_place(str(tmp_path / "in.bin"), str(tmp_path / "out/b.bin"), aside)
        with pytest.raises(FileNotFoundError):
            copy_into_place(str(tmp_path / "in.bin"), str(tmp_path / "none/a.bin"), aside)
        assert not [*(tmp_path / "out/.7.part").iterdir()]
    assert sorted(os.listdir(tmp_path / "out")) == ["a.bin", "b.bin"] and not (tmp_path / "none").exists()
    assert (tmp_path / "out/a.bin").read_bytes() == b"abc" and (tmp_path / "new/deep/a.bin").read_bytes() == b"x"


def test_a_path_is_written_once(spark, stage, tmp_path):
    """Rows with the same path make one file, which is not replaced again and again."""
    table = spark.range(0, 100).selectExpr(f"concat('{tmp_path}/x/', id % 10) as path", "concat('file ', id % 10) as content")
    assert write_files(table, stage).count() == 10
    assert {name: (tmp_path / "x" / name).read_text() for name in os.listdir(tmp_path / "x")} == {str(n): f"file {n}" for n in range(10)}


@pytest.mark.parametrize("links", [True, False])
def test_small_files_take_few_calls(tmp_path, monkeypatch, links):
    """Neither ``copy2`` nor, where there are links, a rename; bytes, mode and timestamps come along, and what has the name is replaced."""
    moved = []
    replace = storage._give_name

    def no_link(*_):
        raise PermissionError("no links here")

    class Local(storage.fs.LocalFileSystem):
        def move(self, one, other):
            moved.append(other)
            os.replace(one, other)

    monkeypatch.setattr(storage, "_give_name", lambda store, part, path: replace(Local(), part, path))
    monkeypatch.setattr(shutil, "copy2", lambda *_: pytest.fail("copy2"))
    if not links:
        monkeypatch.setattr(os, "link", no_link)
    (tmp_path / "out").mkdir()
    for n, size in enumerate([0, 1, storage.SMALL - 1, storage.SMALL]):
        source, to = tmp_path / f"{n}.bin", tmp_path / f"out/{n}.bin"
        source.write_bytes(random.Random(n).randbytes(size))
        os.chmod(source, 0o640 - n % 2 * 0o200)
        os.utime(source, ns=(10**18 + n, 10**18 + 7 * n))
        for k in range(2):
            with Aside("t") as aside:
                copy_into_place(str(source), str(to), aside)
            assert moved == [str(to)] * (k if links else k + 1)
        moved.clear()
        one, other = os.stat(source), os.stat(to)
        assert source.read_bytes() == to.read_bytes()
        assert (one.st_mtime_ns, one.st_mode, other.st_nlink) == (other.st_mtime_ns, other.st_mode, 1)
        assert content_hash(str(to)) == hashlib.sha256(source.read_bytes()).hexdigest()
    assert sorted(os.listdir(tmp_path / "out")) == ["0.bin", "1.bin", "2.bin", "3.bin"]


def test_larger_files_and_attributes_are_copied_whole(tmp_path):
    source = tmp_path / "a.bin"
    source.write_bytes(random.Random(1).randbytes(storage.SMALL * 3 + 1))
    small = tmp_path / "b.bin"
    small.write_bytes(b"b")
    try:
        os.setxattr(small, "user.note", b"kept")
    except OSError:
        pytest.skip("no extended attributes here")
    for path in (source, small):
        copy_into_place(str(path), f"{path}.copy", "t")
        with open(f"{path}.copy", "rb") as copy:
            assert copy.read() == path.read_bytes()
        assert content_hash(str(path)) == hashlib.sha256(path.read_bytes()).hexdigest()
    assert os.getxattr(f"{small}.copy", "user.note") == b"kept"


def test_the_task_that_reads_names_asks_for_no_size(spark, stage, tmp_path):
    for n in range(50):
        (tmp_path / f"{n}.txt").write_bytes(b"x" * n)
    (tmp_path / "gone.txt").symlink_to(tmp_path / "nowhere")
    with open(os.fsencode(tmp_path) + b"/\xff.txt", "wb") as odd:
        odd.write(b"odd")
    batch = pa.RecordBatch.from_pydict({"path": [str(tmp_path)]})
    named = list(folders._lister(True)(iter([batch])))
    rows = [row for part in named for row in part.to_pylist()]
    assert {(row["size"], row["kind"]) for row in rows if "\\" not in row["path"]} == {(None, folders.UNSIZED)}
    expected = {str(tmp_path / f"{n}.txt"): n for n in range(50)} | {str(tmp_path / "gone.txt"): None, f"{tmp_path}/\\xff.txt": 3}
    assert {row["path"]: row["size"] for part in folders._with_sizes(iter(named)) for row in part.to_pylist()} == expected
    assert {r.path: r.size for r in list_folder(spark, str(tmp_path), stage, recursive=True).collect()} == expected


def test_one_small_file_of_rows_is_dealt_out(spark, tmp_path):
    spark.range(1, 3001).selectExpr("id as c_custkey", "string(id) as c_name").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = roster_rows(spark, str(tmp_path))
    sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and min(sizes) and sum(sizes) == 3000
