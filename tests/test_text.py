"""Cleaning against a plain-Python statement of the rules, on fixed cases and on random text."""

import random
import re
import unicodedata
from pathlib import PurePosixPath

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymatch.functions import paths, text


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "value, kind, key",
    [
        ("\u2003x\u00a0y\u3000", "string", "XY"),
        ("7.000", "string", "7"),
        ("7.0.0", "string", "7.0.0"),
        ("1 8.0", "string", "18.0"),
        ("-3.0", "string", "-3.0"),
        ("straße", "string", "STRASSE"),
        (" 7\u001c", "string", "7"),
        ("\u0661\u0662.0", "string", "\u0661\u0662"),
        (-3.0, "double", "-3"),
        (0.25, "double", "0.25"),
        (4e9, "double", "4000000000"),
        (1e22, "double", "10000000000000000000000"),
        (-0.0, "double", "0"),
        (float("inf"), "double", "INF"),
        (float("nan"), "double", "NAN"),
        (8, "bigint", "8"),
        (True, "boolean", "TRUE"),
        (None, "string", ""),
        (None, "double", ""),
        (None, "int", ""),
    ],
)
def test_clean_key(spark, value, kind, key):
    assert one(spark, value, lambda c: text.clean_key(c, kind), kind) == key


@pytest.mark.parametrize(
    "value, stripped",
    [("0", "0"), ("0070", "70"), ("0X7", "0X7"), ("70", "70"), ("0000000", "0"), ("", "")],
)
def test_zeros_go_only_when_asked(spark, value, stripped):
    assert one(spark, value, lambda c: text.clean_key(c, zeros=True)) == stripped
    assert one(spark, value, text.clean_key) == value


@pytest.mark.parametrize(
    "name, safe",
    [
        ("two words", True), ("x/y", False), ("", False), (".", False), ("..", False), ("...", True),
        ("a\\b", False), ("a\u0001", False), ("a:b", False), ("a?", False), ("a|b", False), ("é", True), ("a\n", False),
    ],
)
def test_safe_name(spark, name, safe):
    assert one(spark, name, text.is_safe_name) is safe


def test_header_token(spark):
    for header, token in [(" Key  No. ", "keyno"), ("KEY_NO", "keyno"), (None, ""), ("Größe", "gre"), ("---", "")]:
        assert one(spark, header, text.header_token) == token


def test_random_cells(spark):
    rng = random.Random(7)
    letters = list("0012 5.0aB.") + list(text.WHITESPACE) + [".0", ".00", "00", "-"]
    cells = ["".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(20_000)]

    def cell(value):
        stripped = value.strip()
        found = re.match(r"(\d+)\.0+\Z", stripped)
        return found[1] if found else stripped

    table = spark.createDataFrame(pd.DataFrame({"v": cells})).select(
        "v",
        text.clean_cell("v").alias("cell"),
        text.clean_key("v").alias("key"),
        text.clean_key("v", zeros=True).alias("short"),
        text.clean_target("v").alias("target"),
    )
    for row in table.collect():
        squeezed = "".join(cell(row.v).split())
        assert row.cell == cell(row.v)
        assert row.target == squeezed
        assert row.key == squeezed.upper()
        assert row.short == ((row.key.lstrip("0") or "0") if row.key.isdigit() else row.key)


def test_fold_case_has_the_classes_of_casefold(spark):
    rng = random.Random(3)
    points = [chr(c) for c in range(0x20000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    mixed = ["".join(rng.choices(points[:3000] + list("ẞßıΣσςİKſﬁ"), k=rng.randint(2, 5))) for _ in range(20_000)]
    table = spark.createDataFrame(pd.DataFrame({"v": points + mixed}))
    there, back = {}, {}
    for row in table.select("v", text.fold_case(F.col("v")).alias("folded")).collect():
        assert there.setdefault(row.v.casefold(), row.folded) == row.folded
        assert back.setdefault(row.folded, row.v.casefold()) == row.v.casefold()


def test_name_parts(spark):
    names = "123.jpg .jpg a.b.JPEG 123. noext 1.jpg.jpeg ..jpg ... a.. .a.b".split() + ["a b.jpg", "a.jpg\n"]
    table = spark.createDataFrame([(name,) for name in names], "n string")
    parts = table.select("n", paths.file_stem(F.col("n")).alias("stem"), paths.file_suffix(F.col("n")).alias("suffix"))
    for row in parts.collect():
        assert (row.stem, row.suffix) == (PurePosixPath(row.n).stem, PurePosixPath(row.n).suffix)


def test_target_path(spark):
    def build(folder):
        return one(spark, "x/100.JPEG", lambda c: paths.target_path(folder, F.lit("T-1"), paths.file_name(c)))

    assert build("out") == build("out/") == "out/T-1.jpeg"
    assert build("/") == "/T-1.jpeg"


@pytest.mark.parametrize(
    "entry, inside, place",
    [
        ("a/b", True, "a/b"), ("/a", False, None), ("../a", False, None), ("a/../b", True, "b"),
        ("a/../../b", False, None), ("./a//b", True, "a/b"), ("..", False, None), ("a/b/../../c", True, "c"),
    ],
)
def test_entries(spark, entry, inside, place):
    assert one(spark, entry, paths.resolves_inside) is inside
    if inside:
        assert one(spark, entry, paths.resolved_entry) == place
