"""Approximate nearest neighbours with a hierarchical navigable small-world graph for each shard.

1. *Different vectors.* Each task keeps, for each different vector it meets, its smallest ids, as many as a result can name
   (``k`` and one more, the query itself); the groups of the shuffle have one row of a task each, so a vector that a third of all
   rows hold makes no large group. Vectors that are null, zero, empty or hold null or non-finite components take no part.
2. *Shards.* Different vectors are dealt out by hash over as many shards as give about ``SHARD`` vectors each. Vectors of
   unequal dimension never share a shard.
3. *Index.* A task builds the graph of its shard: every vector gets a level, falling off exponentially; from the top level
   down it is linked to near vectors found by a best-first search of width ``BUILD``, chosen so that none is nearer to another
   one chosen than to the new vector. The graph is stored as flat arrays, a row of neighbour numbers for each vector and
   level, in a table of one row a shard, so it can be kept and searched again.
4. *Search.* Queries are cut into blocks. Each pair of shard and block is a row of its own: a greedy walk down the levels, then
   a best-first search of width ``SEARCH``. The vectors found are expanded to ids, distances are computed again in
   double precision, and the results of all shards are merged by rank.

Distances are Euclidean. Queries with fewer candidates than ``k`` get all that were found. Null ids take no part, since a
result names ids. Rows with the same id and vector count once; rows with the same id and other vectors are candidates each,
and a query never finds its own id. Empty tables give empty results; only ``vec_id`` and ``embedding`` are looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymatch.llm import words
from tallymatch.plans.staging import Stage

K = 10
SHARD = 2500
LINKS = 16
BUILD = 80
SEARCH = 120
BLOCK = 2048
_GROUP = 16
#: Partitions for each piece of work, so that few tasks get several.
SPREAD = 3

UNIQUE = "one long, two long, vector binary, ids array<long>"
INDEX = "shard long, dim int, n long, vectors binary, ids array<array<long>>, neighbours array<binary>, entry int"
FOUND = "query_id long, vec_id long, score double"


class Graph:
    """Vectors with, for each level, a flat array of ``width`` neighbours a vector (-1: none)."""

    def __init__(self, vectors: np.ndarray, levels: list[np.ndarray], entry: int):
        self.vectors, self.levels, self.entry = vectors, levels, entry
        self.squares = np.einsum("ij,ij->i", vectors, vectors)

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, width: int = BUILD) -> Graph:
        n = len(vectors)
        # A level from a hash of the vector: the same shard gives the same graph again.
        random = words.mixed(np.arange(1, n + 1, dtype=np.uint64)).astype(np.float64) / 2**64
        height = np.floor(-np.log(np.maximum(random, 1e-18)) / math.log(links)).astype(int)
        levels = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(int(height.max()) + 1 if n else 1)]
        graph = cls(vectors, levels, 0)
        counts = [np.zeros(n, np.int32) for _ in levels]
        top = int(height[0]) if n else 0
        for new in range(1, n):
            at = [graph.entry]
            for level in range(top, int(height[new]), -1):
                at = [graph._search(vectors[new], at, 1, level)[0][1]]
            for level in range(min(top, int(height[new])), -1, -1):
                found = graph._search(vectors[new], at, width, level)
                at = [v for _, v in found]
                graph._link(new, found, level, counts[level], links)
            if height[new] > top:
                top, graph.entry = int(height[new]), new
        return graph

    def _distances(self, query: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Squared distances less the query's square: in order of nearness."""
        return self.squares[of] - 2 * (self.vectors[of] @ query)

    def _search(self, query: np.ndarray, entries: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """Best first over one level; the ``width`` nearest that were met, nearest first."""
        neighbours = self.levels[level]
        seen = np.zeros(len(self.vectors), bool)
        seen[entries] = True
        start = self._distances(query, np.array(entries)).tolist()
        candidates = list(zip(start, entries, strict=True))
        heapq.heapify(candidates)
        best = [(-d, v) for d, v in candidates]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while candidates:
            distance, vector = heapq.heappop(candidates)
            if distance > -best[0][0] and len(best) >= width:
                break
            near = neighbours[vector]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for d, v in zip(self._distances(query, near).tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-d, v))
                    heapq.heappush(candidates, (d, v))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, v))
                    heapq.heappush(candidates, (d, v))
        return sorted((-d, v) for d, v in best)

    def _choose(self, found: list[tuple[float, int]], most: int, square: float) -> list[int]:
        """Neighbours in different directions: none that is nearer to a chosen one than to the vector itself."""
        ids = np.array([v for _, v in found])
        own = self.vectors[ids]
        between = self.squares[ids][:, None] + self.squares[ids][None, :] - 2 * (own @ own.T)
        chosen: list[int] = []
        left: list[int] = []
        for k, (distance, _) in enumerate(found):
            if len(chosen) >= most:
                break
            if chosen and between[k, chosen].min() < distance + square:
                left.append(k)
            else:
                chosen.append(k)
        chosen += left[: most - len(chosen)]
        return ids[chosen].tolist()

    def _link(self, new: int, found: list[tuple[float, int]], level: int, count: np.ndarray, links: int) -> None:
        neighbours = self.levels[level]
        most = neighbours.shape[1]
        chosen = self._choose(found, links, self.squares[new])
        neighbours[new, : len(chosen)] = chosen
        count[new] = len(chosen)
        for other in chosen:
            if count[other] < most:
                neighbours[other, count[other]] = new
                count[other] += 1
                continue
            ids = np.append(neighbours[other], new)
            distances = self._distances(self.vectors[other], ids)
            order = np.argsort(distances, kind="stable")
            kept = self._choose(list(zip(distances[order].tolist(), ids[order].tolist(), strict=True)), most, self.squares[other])
            neighbours[other, :] = -1
            neighbours[other, : len(kept)] = kept
            count[other] = len(kept)

    def nearest(self, query: np.ndarray, width: int) -> np.ndarray:
        at = [self.entry]
        for level in range(len(self.levels) - 1, 0, -1):
            at = [self._search(query, at, 1, level)[0][1]]
        return np.array([v for _, v in self._search(query, at, width, 0)])


def usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places and values of the vectors that take part, as doubles."""
    lists = column.cast(pa.large_list(pa.float64()))
    lengths = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out, places = [], []
    for k in np.flatnonzero(lengths):
        vector = flat[bounds[k] : bounds[k + 1]]
        if np.isfinite(vector).all() and vector.any():
            out.append(vector)
            places.append(k)
    return np.array(places, int), out


def unique(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of each batch the different vectors, each with its smallest ids and 128 bits to tell it by."""
    for batch in batches:
        places, vectors = usable(batch.column(batch.schema.get_field_index("embedding")))
        ids = batch.column(batch.schema.get_field_index("vec_id")).to_numpy(zero_copy_only=False)
        groups: dict[bytes, set[int]] = {}
        for place, vector in zip(places, vectors, strict=True):
            groups.setdefault((vector + 0.0).tobytes(), set()).add(int(ids[place]))  # -0.0 becomes 0.0
        if not groups:
            continue
        data, offsets = words.raw(pa.array(list(groups), pa.binary()))
        one, two = (np.zeros(len(groups), np.uint64) for _ in range(2))
        numbers = words.mixed(np.frombuffer(data.tobytes(), np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        starts = offsets[:-1] // 8
        place = np.arange(len(numbers), dtype=np.uint64) - np.repeat(starts, np.diff(offsets) // 8).astype(np.uint64)
        one = np.add.reduceat(words.mixed(numbers ^ words.mixed(place + np.uint64(1))), starts)
        two = np.add.reduceat(words.mixed(numbers ^ words.mixed(place + np.uint64(1 << 33))), starts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(one.view(np.int64)),
                pa.array(two.view(np.int64)),
                pa.array(list(groups), pa.binary()),
                pa.array([sorted(own)[:most] for own in groups.values()], pa.list_(pa.int64())),
            ],
            names=["one", "two", "vector", "ids"],
        )


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def build_index(vectors: DataFrame, stage: Stage, k: int = K, shard: int = SHARD) -> DataFrame:
    """The table of shards of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    least = k + 1
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null")
    rows = rows.mapInArrow(lambda batches: unique(batches, least), UNIQUE)
    # The smallest ids of a vector, from each batch's smallest; a batch that met it gives one row. A first round by a random
    # number keeps the second one's groups small, whatever the number of batches.
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, least).alias("ids")
    salt = F.pmod(F.xxhash64("ids"), F.lit(_GROUP))
    rows = rows.groupBy("one", "two", salt.alias("salt")).agg(F.first("vector").alias("vector"), ids)
    rows = rows.groupBy("one", "two").agg(F.first("vector").alias("vector"), ids)
    rows = stage.save(rows.withColumn("dim", (F.octet_length("vector") / 8).cast("int")), "vectors")
    counts = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("long").alias("shards"))
    rows = rows.join(counts, "dim").withColumn("shard", F.pmod("one", F.col("shards")))
    # A graph is much work on few bytes: partitions by the number of shards, not by size.
    tasks = SPREAD * max(1, counts.agg(F.sum("shards")).first()[0] or 0)

    def built(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("two").to_numpy(), table.column("one").to_numpy()))
        table = table.take(order)
        values = table.column("vector").to_pylist()
        graph = Graph.build(_matrix(values))
        return pa.table(
            {
                "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
                "dim": pa.array([table.column("dim")[0].as_py()], pa.int32()),
                "n": pa.array([len(values)], pa.int64()),
                "vectors": pa.array([b"".join(values)], pa.binary()),
                "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
                "neighbours": pa.array([[level.tobytes() for level in graph.levels]], pa.list_(pa.binary())),
                "entry": pa.array([graph.entry], pa.int32()),
            }
        )

    shards = rows.select("dim", "shard", "one", "two", "vector", "ids").repartition(tasks, "dim", "shard").groupBy("dim", "shard")
    return stage.save(shards.applyInArrow(built, INDEX), "index")


def _loaded(row: dict) -> Graph:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"])
    levels = [np.frombuffer(level, np.int32).reshape(row["n"], -1) for level in row["neighbours"]]
    return Graph(vectors, levels, row["entry"])


def searched(batches: Iterable[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            graph, ids = _loaded(row), row["ids"]
            queries = _matrix(row["queries"])
            out: list[tuple[int, int, float]] = []
            for query, query_id in zip(queries, row["query_ids"], strict=True):
                near = graph.nearest(query, width)
                gaps = graph.vectors[near] - query
                scores = np.sqrt((gaps * gaps).sum(1))
                found: list[tuple[float, int]] = []
                for at in np.argsort(scores, kind="stable"):
                    # Ids are in order; once k are held, only vectors as near as the last can matter.
                    if len(found) >= k and scores[at] > found[k - 1][0]:
                        break
                    found += [(float(scores[at]), v) for v in ids[near[at]] if v != query_id]
                    found = sorted(found)[:k]
                out += [(query_id, v, score) for score, v in found]
            if out:
                query_id, vec_id, score = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, pa.float64())],
                    names=["query_id", "vec_id", "score"],
                )


def search(index: DataFrame, queries: DataFrame, k: int = K, width: int = SEARCH, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the queries (vec_id, embedding)."""

    def taken(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, vectors = usable(batch.column(batch.schema.get_field_index("embedding")))
            ids = batch.column(batch.schema.get_field_index("vec_id")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[places], pa.int64()),
                    pa.array([len(v) for v in vectors], pa.int32()),
                    pa.array([(v + 0.0).tobytes() for v in vectors], pa.binary()),
                ],
                names=["query_id", "dim", "query"],
            )

    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null")
    queries = queries.mapInArrow(taken, "query_id long, dim int, query binary")
    # Blocks of about ``block`` queries, by the hash of the id; each is sent to every shard of its dimension.
    counts = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    number = F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block")
    blocks = queries.join(counts, "dim").groupBy("dim", number).agg(
        F.collect_list("query_id").alias("query_ids"), F.collect_list("query").alias("queries")
    )
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    blocks = blocks.join(shards, "dim").withColumn("shard", F.explode("shards")).drop("shards")
    spread = index.join(counts, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ["dim", "shard", "block"]
    tasks = SPREAD * max(1, spread.count())
    pairs = spread.repartition(tasks, *keys).join(blocks.repartition(tasks, *keys), keys)
    found = pairs.mapInArrow(lambda batches: searched(batches, k, width), FOUND)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_hnsw(spark, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    index = build_index(vectors, Stage(spark))
    return search(index, vectors.filter("vec_id % 100 = 0"))
