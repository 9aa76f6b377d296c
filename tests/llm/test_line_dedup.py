"""Against brute force, and the query against its SQL."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from tallymatch.llm import line_dedup

FOLDER = "/root/testdata/sf0.001"


def brute(rows, lines=3):
    split = [(i, [] if t is None else t.split("\n")) for i, t in rows]
    seen, gone = set(), [set() for _ in rows]
    for d in sorted(range(len(rows)), key=lambda d: rows[d][0]):
        i, ls = split[d]
        for p in range(len(ls) - lines + 1):
            window = tuple(ls[p : p + lines])
            if not re.search(r"[^\x20\x09-\x0D]", "".join(window)):
                continue
            if window in seen:
                gone[d].update(range(p, p + lines))
            seen.add(window)
    return sorted(
        (i, None if t is None else "\n".join(x for p, x in enumerate(ls) if p not in g), len(ls), len(g))
        for (i, t), (_, ls), g in zip(rows, split, gone)
    )


def ours(docs):
    return sorted(map(tuple, line_dedup.remove_repeated_lines(docs).collect()), key=str)


def test_planted(documents):
    random.seed(2)
    texts = []
    for _ in range(80):
        texts.append("\n".join(random.choice(["a b", "c", "", "é", "d d", " "]) for _ in range(random.randrange(9))))
    blank = ["\n\n\n\n\n", "\n\n\n\n", None, "", "x", "x\ny", "x\ny\nz", "0\nx\ny\nz\n1", "z\nz\nz\nz\nz", "x\ny\nz" * 300]
    rows = list(enumerate(texts + blank))
    assert ours(documents(rows)) == sorted(brute(rows), key=str)


def test_repeated_rows_and_ids(documents):
    same = "a\nb\nc"
    docs = documents([(1, same), (1, same), (2, same + "\nd"), (None, "q"), (3, "d\n" + same), (1, "e\nf\ng"), (1, "f\ng\nh")])
    assert ours(docs) == sorted(
        [(1, same, 3, 0), (1, same, 3, 0), (2, "d", 4, 3), (None, "q", 1, 0), (3, "d", 4, 3), (1, "e\nf\ng", 3, 0), (1, "f\ng\nh", 3, 0)],
        key=str,
    )


def test_empty_and_clashing_columns(documents):
    docs = documents(["a\nb\nc", "a\nb\nc"])
    assert ours(docs.limit(0)) == []
    clashing = docs.withColumns({name: F.lit("?") for name in ("row", "at", "one", "two", "n", "least", "starts", "rest", "a.b")})
    assert ours(clashing) == ours(docs) == [(0, "a\nb\nc", 3, 0), (1, "", 3, 3)]


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    theirs = con.sql(line_dedup.OP3_SQL)
    mine = line_dedup.op3_line_dedup(spark, FOLDER)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert sorted(map(tuple, mine.select(*theirs.columns).collect())) == sorted(theirs.fetchall())
    assert mine.agg(F.sum("n_removed")).first()[0] > 0
