"""The decision on small tables, and on tables where one key holds much of the data."""

import random

import pytest
from pyspark.sql import functions as F

from tallymatch import labels as L
from tallymatch.operators import audit as A
from tallymatch.operators import groups
from tallymatch.operators.keyed import keyed_assets, keyed_roster, scan_metrics
from tallymatch.operators.matching import probe, with_repeats
from tallymatch.operators.spread import Limits
from tallymatch.plans.reconcile import reconcile

EVERY_KEY_IS_HEAVY = Limits(heavy_keys=3, heavy_rows=2)


def tables(spark, rows, paths):
    roster = spark.createDataFrame(
        [(number, key, target, "X") for number, key, target in rows],
        "row_number long, key_raw string, target_raw string, name string",
    )
    return roster, spark.createDataFrame([(path, 1) for path in paths], "path string, size long")


def statuses(match):
    return {row.row_number: row.status for row in match.decided.collect()}


# One situation each: rows (key, target), file names, status of each row, names of the files no row has.
CASES = {
    "a match": ([("tulip", "A7")], ["tulip.jpg"], [L.PLANNED], []),
    "the suffix does not count": ([("fern", "x"), ("moss", "y")], ["fern.JPEG", "moss.jpeg"], [L.PLANNED] * 2, []),
    "keys are compared clean": ([(" iris\t4 ", "x"), ("81.00", "y")], ["Iris4.jpg", "81.jpg"], [L.PLANNED] * 2, []),
    "nothing to look for": ([("  ", "x"), ("", "x")], [], [L.BLANK_KEY] * 2, []),
    "nowhere to go": ([("oak", " "), ("elm", "\t")], ["oak.jpg"], [L.BLANK_TARGET] * 2, []),
    "no file name": ([("oak", "a:b"), ("elm", ".."), ("ash", "what?")], ["elm.jpg"], [L.INVALID_TARGET] * 3, []),
    "a blank key before a bad target": ([("", "a:b")], [], [L.BLANK_KEY], []),
    "a bad target before a repeated key": ([("oak", "a|b"), ("OAK", "c")], [], [L.INVALID_TARGET, L.DUPLICATE_KEY], []),
    "a repeated key before a repeated target": ([("oak", "c"), ("oak", "c")], ["oak.jpg"], [L.DUPLICATE_KEY] * 2, []),
    "targets that some disks take for one": (
        [("oak", "Straße"), ("elm", "STRASSE"), ("ash", "z")], ["oak.jpg"], [L.DUPLICATE_TARGET] * 2 + [L.NO_ASSET], [],
    ),
    "a target that only a rejected row shares": ([("oak", "c"), ("", "C")], ["oak.jpg"], [L.DUPLICATE_TARGET, L.BLANK_KEY], []),
    "two files": ([("oak", "c")], ["oak.jpg", "Oak.jpeg"], [L.DUPLICATE_ASSET], []),
    "no file": ([("oak", "c")], ["oak.png", "oa k2.jpg"], [L.NO_ASSET], ["oa k2.jpg"]),
    "files without rows": ([("oak", "c")], ["oak.jpg", "elm.jpg", "elm.jpeg"], [L.PLANNED], ["elm.jpeg", "elm.jpg"]),
}


@pytest.mark.parametrize("limits", [Limits(), EVERY_KEY_IS_HEAVY])
def test_cases(spark, limits):
    """All cases at once: each has folders, keys and targets of its own."""
    rows, paths, expected, left_over = [], [], {}, []
    for at, (name, (own_rows, files, statuses_of_rows, orphans)) in enumerate(CASES.items()):
        mark = f"q{at}"
        for (key, target), status in zip(own_rows, statuses_of_rows, strict=True):
            number = 100 * at + len(expected)
            # A mark behind the text keeps cases apart; text that is blank, or a decimal, stays as it is.
            tail = "" if "." in key and key.strip()[0].isdigit() else mark
            rows.append((number, f"{key.rstrip()}{tail}" if key.strip() else key, f"{target}{mark}" if target.strip(" .\t") else target))
            expected[number] = name, status
        for file in files:
            stem, dot, suffix = file.rpartition(".")
            paths.append(f"in/{at}/{stem}{'' if stem == '81' else mark}{dot}{suffix}")
        left_over += [f"in/{at}/{stem}{mark}.{suffix}" for stem, suffix in (file.rsplit(".", 1) for file in orphans)]
    match = reconcile(*tables(spark, rows, paths), "out", limits=limits)
    found = statuses(match)
    assert {number: (name, found[number]) for number, (name, _) in expected.items()} == expected
    assert sorted(row.path for row in match.orphans.collect()) == sorted(left_over)
    metrics = A.plan_metrics(match.audit).first()
    planned = sum(status == L.PLANNED for _, status in expected.values())
    assert (metrics.tasks, metrics.row_issues, metrics.orphans) == (planned, len(rows) - planned, len(left_over))
    assert not A.all_ok(match.audit).first().all_ok


def test_what_a_row_says(spark):
    rows = [(5, "oak", "a"), (6, "elm", "b"), (7, "Elm", "c"), (8, "ash", "D"), (9, "yew", "d"), (10, "fir", "e/f")]
    match = reconcile(*tables(spark, rows, ["x/oak.jpg", "x/ash.jpg", "x/yew.jpg", "y/yew.jpg"]), "to")
    said = {row.row_number: (row.source, row.destination, row.detail) for row in match.decided.collect()}
    assert said == {
        5: ("x/oak.jpg", "to/a.jpg", ""), 6: ("", "", "Key is on 2 rows"), 7: ("", "", "Key is on 2 rows"),
        8: ("", "", "Target is on 2 rows"), 9: ("", "", "Target is on 2 rows"),
        10: ("", "", "Target cannot be used as a file name"),
    }
    assert not match.audit.filter("row_number is null").count()


def test_limits_that_make_no_sense():
    for wrong in ({"heavy_rows": 1}, {"heavy_keys": 0}):
        with pytest.raises(ValueError):
            Limits(**wrong)


def test_no_rows_is_fine(spark):
    match = reconcile(*tables(spark, [], ["in/1.jpg"]), "out")
    assert A.all_ok(match.audit).first().all_ok
    assert A.summary(match.audit).collect() == [(L.ORPHAN_ASSET, 1)]


def test_report_order(spark):
    rows = [(10, "5", "A"), (9, "6", "B")]
    paths = ["b/7.jpg", "a-x/7.jpg", "a/7.jpg", "a/10.jpg", "a/5.jpg"]
    match = reconcile(*tables(spark, rows, paths), "out")
    report = A.in_report_order(match.audit)
    assert report.columns == list(A.COLUMNS)
    assert [(row.row_number, row.source) for row in report.collect()] == [
        (9, ""), (10, "a/5.jpg"), (None, "a/10.jpg"), (None, "a/7.jpg"), (None, "a-x/7.jpg"), (None, "b/7.jpg"),
    ]


@pytest.mark.parametrize("n", [2, 300])
def test_the_names_behind_a_group_are_rows(spark, stage, n):
    """Whatever the size of a group, the detail has its number and the candidates have its files."""
    paths = [f"in/{folder}/1.jpg" for folder in range(n)] + ["in/2.jpg"]
    match = reconcile(*tables(spark, [(2, "1", "T"), (3, "2", "U")], paths), "out", limits=Limits(heavy_rows=10))
    assert match.decided.filter("row_number = 2").first().detail == f"{n} files carry this key"
    listed = match.candidates().collect()
    assert sorted(row.path for row in listed) == sorted(paths[:n]) and {row.row_number for row in listed} == {2}


def test_places_in_a_group_follow_folders(spark, stage):
    paths = ["a-x/1.jpeg", "a/1.jpg", "a/b/1.jpg", "2.jpg"] + [f"z/{n:03}/hot.jpg" for n in range(400)]
    found = groups.multimap(keyed_assets(tables(spark, [], paths)[1]), stage).collect()
    places = {row.path: (row.position, row.n_assets) for row in found}
    assert [places[path] for path in paths[:4]] == [(3, 3), (1, 3), (2, 3), (1, 1)]
    assert [places[f"z/{n:03}/hot.jpg"] for n in range(400)] == [(n + 1, 400) for n in range(400)]


def test_scan_metrics(spark):
    _, listing = tables(spark, [], ["a/1.jpg", "b/1.JPG", "a/2.png", "a/ .jpg", "a/.jpg", "a/x"])
    assert scan_metrics(listing).first() == (6, 4, 2, 1)


def test_other_suffixes_and_labels(spark):
    rows, listing = tables(spark, [(2, "1", "T"), (3, "2", "U")], ["a/1.PNG"])
    match = reconcile(rows, listing, "out", suffixes=[".png"])
    own = A.relabel(match.audit, {L.NO_ASSET: "MISSING"}, {"key_raw": "code"})
    assert {row.code: row.status for row in own.collect()} == {"1": L.PLANNED, "2": "MISSING"}


def expected(rows, paths):
    """The decision in plain Python, on lists."""
    keys, targets, files = {}, {}, {}
    for _, key, target in rows:
        keys[key.strip().upper()] = keys.get(key.strip().upper(), 0) + 1
        targets[target.strip().casefold()] = targets.get(target.strip().casefold(), 0) + 1
    for path in paths:
        files.setdefault(path.split("/")[-1].rsplit(".", 1)[0].upper(), []).append(path)
    found = {}
    for number, key, target in rows:
        key, target = key.strip().upper(), target.strip()
        if not key:
            found[number] = L.BLANK_KEY
        elif not target:
            found[number] = L.BLANK_TARGET
        elif "/" in target:
            found[number] = L.INVALID_TARGET
        elif keys[key] > 1:
            found[number] = L.DUPLICATE_KEY
        elif targets[target.casefold()] > 1:
            found[number] = L.DUPLICATE_TARGET
        else:
            found[number] = {0: L.NO_ASSET, 1: L.PLANNED}.get(len(files.get(key, [])), L.DUPLICATE_ASSET)
    return found, sorted(path for key, group in files.items() if not keys.get(key) for path in group)


@pytest.mark.parametrize("limits", [Limits(), Limits(2, 100), Limits(1, 5)])
def test_heavy_keys_on_both_sides(spark, limits):
    """A third of the rows under one key, a third under one target, a third of the files under one key."""
    rng = random.Random(11)
    rows, paths = [], []
    for number in range(2, 1502):
        key = rng.choice(["", "hot", str(rng.randrange(2000)), str(rng.randrange(2000)), f"u{number}"])
        target = rng.choice(["same", f"t{number}", f"t{number}", f"T{rng.randrange(900)}", "", "a/b"])
        rows.append((number, key, target))
    for number in range(1500):
        paths.append(f"in/{number}/{rng.choice(['busy', str(rng.randrange(2000)), f'u{number}', 'hot'])}.jpg")
    rows += [(9000, "busy", "t9000"), (9001, "u1", "t9001")]
    match = reconcile(*tables(spark, rows, paths), "out", limits=limits)
    decided, left_over = expected(rows, paths)
    assert statuses(match) == decided
    assert sorted(row.path for row in match.orphans.collect()) == left_over
    busy = sorted(path for path in paths if path.endswith("/busy.jpg"))
    assert sorted(row.path for row in match.candidates().filter("row_number = 9000").collect()) == busy
    assert match.audit.count() == len(rows) + len(left_over)


@pytest.mark.parametrize("limits", [Limits(), Limits(2, 3)])
def test_single_operators_with_heavy_keys(spark, limits):
    rows = [(n, "hot" if n % 3 else "", f"t{n % 4}") for n in range(2, 40)] + [(50, "one", "t50")]
    roster, listing = tables(spark, rows, [f"{n}/HOT.jpg" for n in range(9)] + ["a/one.jpg"])
    roster, assets = keyed_roster(roster), keyed_assets(listing)
    probed = probe(roster, assets, limits)
    assert probed.count() == len(rows)
    assert {(row.key, row.n_assets) for row in probed.collect()} == {("HOT", 9), ("", None), ("ONE", 1)}
    counted = {(row.key, row.target): (row.n_rows, row.n_targets) for row in with_repeats(roster, limits).collect()}
    assert counted[("ONE", "t50")] == (None, None)
    hot = sum(1 for row in rows if row[1])-1
    assert counted[("HOT", "t1")] == (hot, sum(1 for row in rows if row[2] == "t1"))
    assert counted[("", "t1")][0] is None
    assert groups.asset_listing(assets, limits).groupBy("key", "n_assets").count().orderBy("key").collect() == [
        ("HOT", 9, 9), ("ONE", 1, 1),
    ]


def test_every_row_and_file_is_accounted_for(spark, stage):
    rows = [(n, str(n % 70), f"t{n}") for n in range(2, 100)]
    paths = [f"{n % 3}/{n % 90}.jpg" for n in range(150)]
    match = reconcile(*tables(spark, rows, paths), "out", stage=stage)
    audit = match.audit
    assert sorted(row.row_number for row in audit.filter("row_number is not null").collect()) == [r[0] for r in rows]
    claimed = {str(n % 70) for n in range(2, 100)}
    left = sorted(row.source for row in audit.filter("row_number is null").collect())
    assert left == sorted(path for path in paths if path.split("/")[1][:-4] not in claimed)
