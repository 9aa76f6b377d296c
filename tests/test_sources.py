"""Sheets, tables and archives."""

import csv
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallymatch.sources import archives, storage
from tallymatch.sources.folders import as_listing, list_folder
from tallymatch.sources.sheets import MissingColumn, find_columns, is_whole_record, read_sheet, roster_from_table
from tallymatch.sources.storage import open_store


def rows_of(frame):
    return sorted(tuple(row) for row in frame.collect())


def by_csv_module(path, places):
    with open(path, newline="", encoding="utf-8-sig") as lines:
        reader = csv.reader(lines)
        next(reader)
        found = []
        for number, cells in enumerate(reader, 2):
            if any(cell.strip() for cell in cells):
                found.append((number, *[(cells[at] if at < len(cells) else "").strip() for at in places]))
    return found


def ends_inside(path):
    with open(path, newline="", encoding="utf-8") as lines:
        return list(csv.reader([*lines, "\n", "the end"]))[-1] != ["the end"]


def test_the_file_that_was_named(spark, tmp_path):
    for name in ("staff[1].csv", "staff1.csv", "a*b.csv", "axb.csv", "{x}.csv", "x.csv", "q?.csv", "qq.csv", "b\\c.csv"):
        (tmp_path / name).write_text(f"Key,Target\n{name[:-4]},t\n")
    for name in ("staff[1]", "a*b", "{x}", "q?", "b\\c"):
        assert rows_of(read_sheet(spark, str(tmp_path / f"{name}.csv"), "Key", "Target")) == [(2, name, "t", "")]


def test_bytes_that_are_not_text(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes(b"Key,Target\n" + b"1,a\n" * 5000 + b"\xe9\xe8,b\n")
    with pytest.raises(ValueError, match="UTF-8: 1 lines"):
        read_sheet(spark, str(tmp_path / "s.csv"), "Key", "Target")
    (tmp_path / "t.csv").write_text("Key,Target\n\ufffd,b\n", encoding="utf-8")
    assert rows_of(read_sheet(spark, str(tmp_path / "t.csv"), "Key", "Target")) == [(2, "\ufffd", "b", "")]


def test_row_of_very_many_cells(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Key,Target\n1,a" + "," * 30_000 + "\n2,b\n")
    assert rows_of(read_sheet(spark, str(tmp_path / "s.csv"), "Key", "Target")) == [(2, "1", "a", ""), (3, "2", "b", "")]


def test_blank_lines_count_and_are_dropped(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('﻿Name,KEY no.,"Target, No"\nA,1,x\n\n , ,\n"",""," "\nB,02\nC,3.0,z,extra\n,,,x\n\n', encoding="utf-8")
    assert rows_of(read_sheet(spark, str(path), "key no", "TARGET NO", "name")) == [
        (2, "1", "x", "A"), (6, "02", "", "B"), (7, "3", "z", "C"), (8, "", "", ""),
    ]


@pytest.mark.parametrize("ending", ["\n", "\r\n", "\r"])
def test_line_breaks_inside_cells(spark, tmp_path, ending):
    path = tmp_path / "s.csv"
    lines = ["Key,Target,Name", '1,a,"two', 'lines"', "", '2,b,"say ""hi"""', "3,c,d"]
    path.write_bytes(ending.join(lines).encode())
    found = rows_of(read_sheet(spark, str(path), "Key", "Target", "Name"))
    assert [row[:3] for row in found] == [(2, "1", "a"), (4, "2", "b"), (5, "3", "c")]
    assert found[0][3].split() == ["two", "lines"] and found[1][3] == 'say "hi"'


def test_stray_quotes_go_the_safe_way(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('Key,Target,Name\n1,5" pipe,x\n2,b,"c"d\n3,e"f,"g\n4,h,i"\n5,j,k\n')
    assert rows_of(read_sheet(spark, str(path), "Key", "Target", "Name")) == [
        (number, *cells) for number, *cells in by_csv_module(path, (0, 1, 2))
    ]


def test_random_sheets_as_the_csv_module_reads_them(spark, tmp_path):
    rng = random.Random(5)
    for seed in range(6):
        path = tmp_path / f"{seed}.csv"
        pieces = ['"', '""', ",", "a", "7.0", " ", "\n", "b c"] if seed % 2 else ["x", "7", " ", ",", "é"]
        body = "\n".join("".join(rng.choices(pieces, k=rng.randint(0, 8))) for _ in range(120))
        path.write_text("Key,Target,Name\n" + body, encoding="utf-8")
        if ends_inside(path):
            with pytest.raises(ValueError, match="inside a quoted cell"):
                read_sheet(spark, str(path), "Key", "Target", "Name")
            with open(path, "a", encoding="utf-8") as more:
                more.write('"')
        ours = [row[:3] for row in rows_of(read_sheet(spark, str(path), "Key", "Target", "Name"))]
        theirs = [row[:3] for row in by_csv_module(path, (0, 1, 2))]
        drop = lambda text: text[:-2] if text.endswith(".0") and text[:-2].isdigit() else text
        assert ours == [(number, drop(key), drop(target)) for number, key, target in theirs]


def test_whole_records(spark):
    lines = {
        "a,b": True, "": True, '"a,b",c': True, '"a""b"': True, '""': True, '""""': True, '"a': False, 'a"b': False,
        '"a"b': False, 'a,"b': False, '"a","b"': True, 'a ,"b" ': False, '"' + '""' * 50_000 + '"': True,
        'a,""': True, '"",a': True, '"a",b"c,d': False, '"a"",b': False, ',"a,b",': True, '"a" ,"b"': False,
        ",".join(['"x"'] * 900): True,
    }
    frame = spark.createDataFrame([(line,) for line in lines], "v string")
    assert {row.v: row[1] for row in frame.select("v", is_whole_record(F.col("v"))).collect()} == lines


def test_sheet_of_many_splits(spark, tmp_path):
    path = tmp_path / "s.csv"
    expected = []
    with open(path, "w") as out:
        out.write("Key,Target,Name\n")
        for number in range(2, 30_002):
            blank = number % 7 == 0
            out.write("\n" if blank else f"{number},t{number},n\n")
            if not blank:
                expected.append((number, str(number), f"t{number}", "n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        sheet = read_sheet(spark, str(path), "Key", "Target", "Name")
        assert rows_of(sheet) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("tail", ["3,c,z\n", '3,c,"z\nz"\n'])
def test_sheet_in_parts(spark, tmp_path, tail):
    folder = tmp_path / "sheet"
    folder.mkdir()
    (folder / "_SUCCESS").write_text("")
    (folder / "part-0.txt").write_text("Key,Target,Name\n\n1,a,x\n")
    (folder / "part-1.txt").write_text("")
    (folder / "part-2.txt").write_text("2,b,y\n\n" + tail)
    found = rows_of(read_sheet(spark, str(folder), "Key", "Target", "Name"))
    assert [row[:3] for row in found] == [(3, "1", "a"), (4, "2", "b"), (6, "3", "c")]


def test_records_across_splits(spark, tmp_path):
    rng = random.Random(9)
    path = tmp_path / "s.csv"
    with open(path, "w", newline="") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["Key", "Target", "Name"])
        for number in range(3_000):
            lines = rng.choice([1, 1, 1, 2, 40])
            writer.writerow([number, f"t{number}", "\n".join(rng.choice(['a "b"', "", "c,d"]) for _ in range(lines))])
            if number % 50 == 0:
                out.write(rng.choice(["\n", 'x"y,z,"w\n",\n', ' "q,r\n']))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert read_sheet(spark, str(path), "Key", "Target", "Name").count() > 3_000
        found = rows_of(read_sheet(spark, str(path), "Key", "Target", "Name"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == [(number, *cells) for number, *cells in by_csv_module(path, (0, 1, 2))]


def test_columns():
    assert find_columns(["Name", "Key No", "key-no", "Target"], "KEY NO", "target", "name") == (2, 3, 0)
    assert find_columns(["key", "target"], "key", "target", "name") == (0, 1, None)
    with pytest.raises(MissingColumn, match="Missing: Key, B. The header has: A, --"):
        find_columns(["A", "--"], "Key", "B")


def test_hidden_sheet_is_refused_not_read_as_empty(spark, tmp_path):
    (tmp_path / "_s.csv").write_text("Key,Target\n1,a\n")
    with pytest.raises(ValueError, match="rename"):
        read_sheet(spark, str(tmp_path / "_s.csv"), "Key", "Target")


def test_empty_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        read_sheet(spark, str(tmp_path / "s.csv"), "Key", "Target")


def test_table_with_typed_cells(spark):
    table = spark.createDataFrame(
        [(7, 5.0, 12, None), (8, None, None, " "), (9, 1.5, 3, "x")], "id long, `Key No` double, Target int, Note string"
    )
    assert rows_of(roster_from_table(table, "key no", "target", row_number="id")) == [
        (7, "5", "12", ""), (9, "1.5", "3", ""),
    ]


def test_listing_with_odd_names(spark, stage, tmp_path):
    names = {"_a.jpg", ".b.jpg", "c d.jpg", "5%20x.jpg", "é.jpg"}
    for name in names:
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "dir").mkdir()
    (tmp_path / "dead").symlink_to(tmp_path / "nothing")
    flat = list_folder(spark, f"file://{tmp_path}", stage)
    assert {tuple(row) for row in flat.collect()} == {(f"{tmp_path}/{name}", 5) for name in names}
    deep = as_listing(list_folder(spark, str(tmp_path), stage, recursive=True))
    assert {row.path for row in deep.collect()} == {f"{tmp_path}/{name}" for name in names | {"dead"}}


def test_archives(spark, stage, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as opened:
        opened.writestr("sub/", b"")
        for name, content in [
            ("1.jpg", b"one"), ("sub/2.jpg", b"two"), ("../3.jpg", b"bad"), ("/4.jpg", b"bad"), ("sub/../5.jpg", b"five"),
            ("5.jpg", b"again"), ("sub/../../6.jpg", b"bad"),
        ]:
            opened.writestr(name, content)
    found = spark.createDataFrame([(str(tmp_path / "a.zip"),)], "path string")
    entries = archives.archive_entries(found)
    assert entries.count() == 7
    assert archives.entries_written(entries).select("n", "n_places").collect() == [(4, 3)]
    out = tmp_path / "out"
    written = stage.save(archives.extract(entries, str(out), 4), "written")
    assert rows_of(written) == [(f"{out}/1.jpg", 3), (f"{out}/5.jpg", 5), (f"{out}/sub/2.jpg", 3)]
    assert (out / "5.jpg").read_bytes() == b"again"
    assert sorted(path.name for path in tmp_path.rglob("*") if path.is_file()) == ["1.jpg", "2.jpg", "5.jpg", "a.zip"]


def test_remote_names_mean_themselves(monkeypatch):
    asked = []

    class Store:
        @staticmethod
        def from_uri(address):
            asked.append(address)
            return object(), address.split("://")[1].rstrip("/")

    storage._remote_store.cache_clear()
    monkeypatch.setattr(storage.fs, "FileSystem", Store)
    for name in ("a b", "é", "5%20x", "x#y", "is?", "[z]", "d/e"):
        assert open_store(f"s3a://shelf/{name}")[1] == f"shelf/{name}"
    assert asked == ["s3://shelf/"]
    storage._remote_store.cache_clear()


def test_spelling_of_paths():
    assert open_store("file:///a/b")[1] == open_store("file:/a/b")[1] == open_store("/a/b")[1] == "/a/b"
