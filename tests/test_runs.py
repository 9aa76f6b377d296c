"""Whole runs on real files."""

import os

import pytest

from tallymatch import labels as L
from tallymatch.operators.files import look_at_destinations
from tallymatch.operators.sinks import write_report
from tallymatch.plans.run import Settings, run
from tallymatch.plans.staging import Stage
from tallymatch.sources.sheets import MissingColumn


@pytest.fixture
def job(tmp_path):
    """Two rows with a file each, a file that no row has, and one that is no picture."""
    photos = tmp_path / "scans"
    photos.mkdir()
    for name in ("oak.jpg", "31.JPEG", "elm.jpg", "readme.md"):
        (photos / name).write_bytes(name.encode() * 3)
    sheet = tmp_path / "trees.csv"
    sheet.write_text("Key,Target,Name\nOak,T-oak,Quercus\n31.0,T-31,Fagus\n")
    return str(photos), str(sheet), str(tmp_path / "out")


def test_run_and_rerun(spark, job, tmp_path):
    photos, sheet, out = job
    before = os.stat(f"{photos}/oak.jpg").st_mtime
    first = run(spark, *job, report_path=str(tmp_path / "report"))
    assert first.code == 0
    assert first.summary == {L.APPLIED: 2, L.ORPHAN_ASSET: 1}
    assert sorted(os.listdir(out)) == ["T-31.jpeg", "T-oak.jpg"]
    assert open(f"{out}/T-oak.jpg", "rb").read() == b"oak.jpg" * 3
    assert os.stat(f"{out}/T-oak.jpg").st_mtime == before
    assert sorted(os.listdir(photos)) == ["31.JPEG", "elm.jpg", "oak.jpg", "readme.md"]

    # Reading the result again copies nothing and changes nothing.
    assert first.audit.filter("status = 'APPLIED'").count() == 2

    for settings in (Settings(), Settings(verify=True), Settings(overwrite=True, verify=True)):
        again = run(spark, *job, settings)
        assert (again.code, again.summary) == (0, {L.ALREADY_DONE: 2, L.ORPHAN_ASSET: 1})


def test_report_bytes(spark, job, tmp_path):
    photos, sheet, out = job
    with open(sheet, "a") as rows:
        rows.write('fir," T3 ","Zoé ""Z"", B"\n')
    run(spark, *job, report_path=str(tmp_path / "report"))
    parts = sorted(path for path in (tmp_path / "report").iterdir() if path.name.startswith("part-"))
    lines = []
    for part in parts:
        content = part.read_bytes()
        if content:
            assert content.startswith(b"\xef\xbb\xbfrow_number,key_raw,target_raw,name,status,source,destination,detail\n")
            lines += content.decode("utf-8-sig").splitlines()[1:]
    assert lines == [
        f"2,Oak,T-oak,Quercus,APPLIED,{photos}/oak.jpg,{out}/T-oak.jpg,",
        f"3,31,T-31,Fagus,APPLIED,{photos}/31.JPEG,{out}/T-31.jpeg,",
        '4,fir,T3,"Zoé ""Z"", B",NO_ASSET,,,',
        f",,,,ORPHAN_ASSET,{photos}/elm.jpg,,No row has this key",
    ]


def test_report_in_several_files_keeps_its_order(spark, tmp_path):
    audit = spark.range(3000).selectExpr(
        "if(id % 3 = 0, null, (id * 7919) % 3001) as row_number", "'' as key_raw", "'' as target_raw", "'' as name",
        "'X' as status", "concat(id % 10, '/', id, '.jpg') as source", "'' as destination", "'' as detail", "'hot' as key",
    )
    write_report(audit, str(tmp_path / "report"), files=4)
    parts = sorted(path for path in (tmp_path / "report").iterdir() if path.name.startswith("part-"))
    assert len(parts) == 4
    found = [line.split(",") for part in parts for line in part.read_text(encoding="utf-8-sig").splitlines()[1:]]
    numbers = [int(cells[0]) for cells in found if cells[0]]
    paths = [cells[5] for cells in found if not cells[0]]
    assert numbers == sorted(numbers) and len(numbers) == 2000
    assert all(cells[0] for cells in found[:2000])
    assert paths == sorted(paths, key=lambda path: path.split("/")) and len(paths) == 1000


def test_dry_run_writes_nothing(spark, job):
    result = run(spark, *job, Settings(dry_run=True))
    assert (result.code, result.summary) == (0, {L.PLANNED: 2, L.ORPHAN_ASSET: 1})
    assert not os.path.exists(job[2])


def test_conflict_is_reported_not_overwritten(spark, job):
    os.mkdir(job[2])
    target = f"{job[2]}/T-oak.jpg"
    with open(target, "wb") as other:
        other.write(b"something else")
    result = run(spark, *job)
    assert (result.code, result.summary[L.TARGET_CONFLICT]) == (2, 1)
    assert open(target, "rb").read() == b"something else"
    assert run(spark, *job, Settings(dry_run=True)).summary[L.TARGET_CONFLICT] == 1

    assert run(spark, *job, Settings(overwrite=True)).code == 0
    assert open(target, "rb").read() == b"oak.jpg" * 3


def test_same_size_counts_as_done_unless_verified(spark, job):
    os.mkdir(job[2])
    with open(f"{job[2]}/T-oak.jpg", "wb") as other:
        other.write(b"oax.jpg" * 3)
    assert run(spark, *job, Settings(overwrite=True)).summary[L.ALREADY_DONE] == 1
    assert open(f"{job[2]}/T-oak.jpg", "rb").read() == b"oax.jpg" * 3
    assert run(spark, *job, Settings(verify=True)).summary[L.TARGET_CONFLICT] == 1
    assert run(spark, *job, Settings(verify=True, overwrite=True)).summary == {
        L.APPLIED: 1, L.ALREADY_DONE: 1, L.ORPHAN_ASSET: 1,
    }


def test_one_bad_file_fails_alone(spark, job):
    # A folder at the destination: it exists, it is no copy, and it cannot be replaced by a file.
    os.makedirs(f"{job[2]}/T-oak.jpg/inner")
    result = run(spark, *job, Settings(overwrite=True))
    assert result.code == 2
    assert result.summary == {L.COPY_FAILED: 1, L.APPLIED: 1, L.ORPHAN_ASSET: 1}
    failed = result.audit.filter("status = 'COPY_FAILED'").first()
    assert "Error: " in failed.detail
    assert sorted(os.listdir(job[2])) == ["T-31.jpeg", "T-oak.jpg"]


def test_source_that_vanished(spark, tmp_path):
    (tmp_path / "there.jpg").write_bytes(b"x")
    rows = spark.createDataFrame(
        [(2, str(tmp_path / "gone.jpg"), str(tmp_path / "there.jpg"))], "row_number long, source string, destination string"
    )
    there = spark.createDataFrame([(str(tmp_path / "there.jpg"), 1)], "path string, size long")
    seen = look_at_destinations(rows, there, there.limit(0), str(tmp_path), 1).first()
    assert seen.found and not seen.same and seen.problem.startswith("FileNotFoundError: ")


def test_recursive(spark, job):
    photos = job[0]
    os.makedirs(f"{photos}/a/b")
    for name in ("a/b/_yew.jpg", "a/.ash.jpg"):
        with open(f"{photos}/{name}", "wb") as file:
            file.write(b"x")
    os.symlink(f"{photos}/a", f"{photos}/link")
    os.symlink(f"{photos}/oak.jpg", f"{photos}/box.jpg")
    flat = run(spark, *job, Settings(dry_run=True))
    assert flat.summary == {L.PLANNED: 2, L.ORPHAN_ASSET: 2}
    deep = run(spark, *job, Settings(dry_run=True, recursive=True))
    found = {row.source for row in deep.audit.filter("row_number is null").collect()}
    assert found == {f"{photos}/{name}" for name in ("elm.jpg", "box.jpg", "a/b/_yew.jpg", "a/.ash.jpg")}


def test_checks_come_first(spark, job, tmp_path):
    photos, sheet, out = job
    with pytest.raises(ValueError):
        run(spark, photos, sheet, f"{photos}/../scans")
    with pytest.raises(ValueError):
        run(spark, photos, sheet, f"{photos}/out", Settings(recursive=True))
    assert run(spark, photos, sheet, f"{photos}/out", Settings(dry_run=True)).code == 0
    with pytest.raises(NotADirectoryError):
        run(spark, f"{photos}-missing", sheet, out)
    with pytest.raises(FileNotFoundError):
        run(spark, photos, f"{tmp_path}/missing.csv", out)
    with pytest.raises(ValueError):
        run(spark, photos, f"{photos}/readme.md", out)
    (tmp_path / "bad.csv").write_text("Label,Rest\nOak,x\n")
    with pytest.raises(MissingColumn, match="Missing: Key, Target. The header has: Label, Rest"):
        run(spark, photos, str(tmp_path / "bad.csv"), out)
    assert not os.path.exists(out)


def test_names_that_look_like_addresses(spark, tmp_path):
    photos = tmp_path / "scans"
    photos.mkdir()
    names = ["é.jpg", "a b.jpg", "5%20x.jpg", "x#y.jpg", "is?.jpg", "[z].jpg"]
    for name in names:
        (photos / name).write_bytes(name.encode())
    (photos / os.fsdecode(b"bad\xff.jpg")).write_bytes(b"x")
    rows = spark.createDataFrame([(n, name[:-4], f"t{n}", "") for n, name in enumerate(names)], "row_number long, key_raw string, target_raw string, name string")
    for _ in range(2):
        result = run(spark, str(photos), rows, str(tmp_path / "out"))
    assert result.summary == {L.ALREADY_DONE: 6, L.ORPHAN_ASSET: 1}
    assert [row.source for row in result.audit.filter("row_number is null").collect()] == [f"{photos}/bad\\xff.jpg"]
    assert [(tmp_path / "out" / f"t{n}.jpg").read_bytes() for n in range(6)] == [name.encode() for name in names]
    assert result.scan == {"scanned": 7, "skipped": 0, "indexed": 7, "distinct_keys": 7}
    assert result.plan == {"tasks": 6, "row_issues": 0, "orphans": 1}


def test_tables_in_tables_out(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "oak.jpg").write_bytes(b"1")
    files = spark.createDataFrame([(str(tmp_path / "deep" / "oak.jpg"), 1), ("gone/elm.jpg", 1)], "path string, size long")
    rows = spark.createDataFrame([(1, "oak", "a", ""), (2, "elm", "b", "")], "row_number long, key_raw string, target_raw string, name string")
    with Stage(spark) as stage:
        result = run(spark, files, rows, str(tmp_path / "out"), stage=stage, audit_path=str(tmp_path / "audit"))
        assert result.summary == {L.APPLIED: 1, L.COPY_FAILED: 1} and result.code == 2
        folder = stage.folder.removeprefix("file:")
        assert os.path.exists(folder)
    assert not os.path.exists(folder)
    assert result.audit.count() == 2
