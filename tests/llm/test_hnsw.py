"""Recall and exactness against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymatch.llm import hnsw
from tallymatch.plans.staging import Stage

FOLDER = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>"


def usable(rows):
    return [(i, np.array(v, np.float64)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]


def brute(rows, queries, k=10):
    """For each query its ids in order of nearness, with the distance."""
    out = {}
    rows = usable(rows)
    for q, vector in usable(queries):
        found = {}
        for i, v in rows:
            if i != q and len(v) == len(vector):
                gap = v - vector
                found[i] = min(found.get(i, np.inf), float(np.sqrt((gap * gap).sum())))
        out[q] = sorted((d, i) for i, d in found.items())[:k]
    return out


def ours(spark, rows, queries, **options):
    index = hnsw.build_index(rows, Stage(spark), **options)
    out = {}
    for r in hnsw.search(index, queries).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    expected = brute(rows, [row for row in rows if row[0] % 100 == 0])
    found = {}
    for r in hnsw.op8_hnsw(spark, FOLDER).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert found.keys() == expected.keys()
    hit = total = 0
    for q, near in expected.items():
        assert found[q] == sorted(found[q]) and len(found[q]) == len(near)
        hit += len({i for _, i in near} & {i for _, i in found[q]})
        total += len(near)
    assert hit / total >= 0.95


@pytest.mark.parametrize("shard", [40, 4000])
def test_planted(spark, shard):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(200)]
    rows += [(200 + k, rows[7][1]) for k in range(150)]  # one vector many times
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] * 4), (404, [float("nan")] * 8),
             (405, [float("inf")] + [1.0] * 7), (None, rows[3][1]), (406, [1.0, 2.0]), (407, [1.0, 3.0]), (5, rows[5][1]),
             (408, [5.0]), (6, rows[9][1])]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("?")).withColumn("a.b", F.lit("?"))
    queries = table.filter("vec_id is null or vec_id % 3 = 0 or vec_id >= 400")
    expected = brute(rows, [row for row in rows if row[0] is None or row[0] % 3 == 0 or row[0] >= 400])
    found = ours(spark, table, queries, shard=shard)
    assert found.keys() == {q for q, near in expected.items() if near}
    for q, near in expected.items():
        mine = found.get(q, [])
        assert len(mine) == len(near)
        if q != 6:
            assert [i for _, i in mine] == [i for _, i in near], q
            assert np.allclose([d for d, _ in mine], [d for d, _ in near], rtol=1e-12)


def test_empty(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.5])], SCHEMA)
    assert ours(spark, table.limit(0), table) == {}
    assert ours(spark, table, table.limit(0)) == {}
    assert ours(spark, table, table) == {1: [(0.5, 2)], 2: [(0.5, 1)]}
