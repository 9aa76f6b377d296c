"""N-gram Jaccard join with a MinHash LSH forest.

Documents are sets of ``SHINGLE`` words in a row (a document of fewer words is one shingle); two are linked where the
Jaccard similarity of their sets is ``THRESHOLD`` or more. Each row gets its class, the smallest id that links lead to, and
the number of rows it is linked to.

1. *Texts.* One pass hashes the words. Rows of equal word sequences become one node with a number of copies.
2. *Forest.* A label of up to ``LONGEST`` minimum hashes for each of ``TREES`` trees, sorted by prefix: nodes with a common
   prefix lie next to each other in the trie. From its full length the prefix is shortened, one level at a time, until two
   sets that are just similar enough share it in some tree with probability ``RECALL`` (``depth``). That bound holds for
   any data, so the depth does not depend on what was found, and a task writes only the prefix that is used.
3. *Clusters.* Each node is tied to the smallest node under its prefix, not to every node there, and ties are followed
   to components (``graph``). Every pair that shares a prefix is in one cluster.
4. *Exact verification.* Clusters are cut into blocks of bounded size, and each pair of blocks is one group that counts
   the common shingles of all its pairs in a matrix product. A group hands on numbers of links and a star for each of its
   own components, never pairs, so a group of thousands of near copies gives a few rows a node. The counting itself is
   quadratic in a group of different, similar texts, as the number of links is; blocks spread it over tasks.
5. Components of the verified stars are the classes.

Null or empty texts have no shingle and no link; each is a class of its own. Null id: smaller than all others. Rows with
the same id are linked like any other rows. Empty tables give empty results; only ``doc_id`` and ``text`` are looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.llm import graph, tables, words
from tallymatch.llm.substring_dedup import sequences, unpacked
from tallymatch.plans.staging import Stage

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
TREES = 32
LONGEST = 8
RECALL = 0.9999
BLOCK_NODES = 512
BLOCK_SHINGLES = 1 << 20
_COLUMNS = 1 << 14

SIGNED = "doc_id long, one long, two long, size long, keys array<long>"
SETS = "cluster long, a int, b int, block int, node long, copies long, shingles binary"
LINKS = "node long, n_links long, root long"


def depth(trees: int = TREES, threshold: float = THRESHOLD, recall: float = RECALL, longest: int = LONGEST) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target probability."""
    for length in range(longest, 1, -1):
        if 1 - (1 - float(threshold) ** length) ** trees >= recall:
            return length
    return 1


def shingles(found: words.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts of all shingles, in order of the texts, repetitions included."""
    hashes = found.hashes()
    at = np.flatnonzero(found.fits(size))
    own, text = found.runs(hashes, size)[at], found.text_of_word()[at]
    for short in range(1, size):
        few = np.flatnonzero(found.counts == short)
        if len(few):
            whole = found.runs(hashes, short)[found.first[few]] ^ np.uint64(short)
            own, text = np.concatenate([own, whole]), np.concatenate([text, few])
    order = np.argsort(text, kind="stable")
    return own[order], text[order]


def signed(batches: Iterable[pa.RecordBatch], size: int, trees: int, length: int) -> Iterator[pa.RecordBatch]:
    factors = words.mixed(np.arange(1, trees * length + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    high = np.uint64(32)
    for part, data, offsets in words.pieces(batches, "text"):
        found = words.Words(data, offsets)
        own, text = shingles(found, size)
        held, first = np.unique(text, return_index=True)
        keys = np.zeros((part.num_rows, trees), np.uint64)
        if len(held):
            for tree in range(trees):
                label = np.zeros(len(held), np.uint64)
                for factor in factors[tree * length : (tree + 1) * length]:
                    least = np.minimum.reduceat(((own * factor) >> high).astype(np.uint32), first)
                    label = words.mixed(label ^ least.astype(np.uint64))
                keys[held, tree] = label
        at = np.arange(0, keys.size + 1, trees, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words.ids(part)),
                pa.array(sequences(found, 1).view(np.int64)),
                pa.array(sequences(found, 2).view(np.int64)),
                pa.array(np.bincount(text, minlength=part.num_rows).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64))),
            ],
            names=["doc_id", "one", "two", "size", "keys"],
        )


def compressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for part, data, offsets in words.pieces(batches, "text"):
        data = data.tobytes()
        texts = [packer.compress(data[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(words.ids(part)), pa.array(texts, pa.binary())], names=["doc_id", "text"])


def sets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The shingle set of each row that has the word sequence of its node, once for each pair of blocks."""
    for batch in unpacked(batches):
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        data, offsets = words.raw(column["text"])
        found = words.Words(data, offsets)
        own, text = shingles(found, size)
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
        same = sequences(found, 1).view(np.int64) == column["one"].to_numpy()
        rows = []
        for r in np.flatnonzero(same):
            shingle = np.unique(own[bounds[r] : bounds[r + 1]]).tobytes()
            node = {name: column[name][r].as_py() for name in ("cluster", "blocks", "block", "node", "copies")}
            mine, n = node["block"], node.pop("blocks")
            rows += [{**node, "a": min(mine, k), "b": max(mine, k), "shingles": shingle} for k in range(n)]
        if rows:
            schema = pa.schema(
                [("cluster", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("block", pa.int32()), ("node", pa.int64()),
                 ("copies", pa.int64()), ("shingles", pa.binary())]
            )
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[at : at + 256], schema)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that are sorted by the keys, one table for each value of them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys], 1)
        cuts = np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if held and tuple(columns[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(columns[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common shingles of each pair."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64)
    lefts, rights = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(np.unique(lefts), np.unique(rights), assume_unique=True)
    total = np.zeros((len(left), len(right)), np.int64)

    def places(of: np.ndarray, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(both, of)
        at[at == len(both)] = 0
        hit = both[at] == of
        return np.repeat(np.arange(len(own)), [len(x) for x in own])[hit], at[hit]

    if not len(both):
        return total
    (lr, lc), (rr, rc) = places(lefts, left), places(rights, right)
    for start in range(0, len(both), _COLUMNS):
        width = min(_COLUMNS, len(both) - start)
        tables_ = []
        for r, c, n in ((lr, lc, len(left)), (rr, rc, len(right))):
            in_ = (c >= start) & (c < start + width)
            dense = np.zeros((n, width), np.float32)  # counts stay below 2 ** 24 in one slice, so floats are exact
            dense[r[in_], c[in_] - start] = 1
            tables_.append(dense)
        total += (tables_[0] @ tables_[1].T).astype(np.int64)
    return total


def linked(batches: Iterable[pa.RecordBatch], threshold: Fraction) -> Iterator[pa.RecordBatch]:
    """For each node of a pair of blocks its number of links there and the smallest node they lead to."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        node, n, root = (np.concatenate(column) for column in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(root)], names=["node", "n_links", "root"])

    for group in groups(batches, ["cluster", "a", "b"]):
        node, first = np.unique(group.column("node").to_numpy(), return_index=True)
        own = [np.frombuffer(group.column("shingles")[i].as_py(), np.uint64) for i in first]
        copies, block = group.column("copies").to_numpy()[first], group.column("block").to_numpy()[first]
        a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        if not len(left) or not len(right):
            continue
        length = np.array([len(x) for x in own])
        both = common([own[i] for i in left], [own[i] for i in right])
        either = length[left][:, None] + length[right][None, :] - both
        link = both * threshold.denominator >= either * threshold.numerator
        if a == b:
            np.fill_diagonal(link, False)
        n = np.zeros(len(node), np.int64)
        n[left] += link @ copies[right]
        if a != b:
            n[right] += link.T @ copies[left]
        root = np.arange(len(node))
        while True:
            low = root.copy()
            np.minimum.at(low, left, np.where(link, root[right][None, :], len(node)).min(1))
            np.minimum.at(low, right, np.where(link, root[left][:, None], len(node)).min(0))
            if (low == root).all():
                break
            root = low
        hit = n > 0
        out.append((node[hit], n[hit], node[root[hit]]))
        size += int(hit.sum())
        if size >= 50_000:
            yield flush()
            out, size = [], 0
    if out:
        yield flush()


def near_duplicates(
    docs: DataFrame,
    stage: Stage | None = None,
    size: int = SHINGLE,
    threshold: Fraction = THRESHOLD,
    trees: int = TREES,
    recall: float = RECALL,
) -> DataFrame:
    """doc_id, class_id, n_links, n_copies (rows of the same words, itself included); a row for each row of ``docs``."""
    stage = stage or Stage(docs.sparkSession)
    docs = tables.only(docs, "doc_id", "text")
    length = depth(trees, float(threshold), recall)
    rows = stage.save(docs.mapInArrow(lambda batches: signed(batches, size, trees, length), SIGNED), "signed")

    same = rows.filter("size > 0").groupBy("one", "two")
    classes = same.agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = stage.save(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    leaves = nodes.select("node", F.posexplode("keys").alias("tree", "prefix"))
    under = leaves.groupBy("tree", "prefix").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n"))
    ties = leaves.join(under.filter("n > 1").hint("merge"), ["tree", "prefix"])
    clusters = graph.components(ties.select(F.col("node").alias("a"), F.col("root").alias("b")), stage)
    in_cluster = nodes.drop("keys").join(clusters.withColumnRenamed("id", "node"), "node")
    in_cluster = stage.save(in_cluster.withColumnRenamed("component", "cluster"), "clusters")
    sizes = in_cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    by_n, by_total = F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("total") / BLOCK_SHINGLES)
    sizes = sizes.select("cluster", F.least(F.greatest(by_n, by_total), F.col("n")).cast("int").alias("blocks"))
    blocked = in_cluster.join(sizes, "cluster")
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocked = blocked.select(F.col("least").alias("doc_id"), "one", "node", "copies", "cluster", "blocks", "block")

    packed = docs.mapInArrow(compressed, "doc_id long, text binary")
    # Both sides grow with the corpus: joined the same way at every size.
    packed = packed.join(blocked.hint("merge"), "doc_id")
    keys = ["cluster", "a", "b"]
    members = packed.mapInArrow(lambda batches: sets(batches, size), SETS).repartition(*keys).sortWithinPartitions(*keys)
    links = stage.save(members.mapInArrow(lambda batches: linked(batches, threshold), LINKS), "links")

    n_links = links.groupBy("node").agg(F.sum("n_links").alias("n"))
    joined = graph.components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), stage)
    placed = nodes.select("node", "one", "two", "least", "copies").join(n_links, "node", "left")
    placed = placed.join(joined.withColumnRenamed("id", "node"), "node", "left")
    placed = stage.save(placed.withColumn("component", F.coalesce("component", "node")), "placed")
    low = placed.groupBy("component").agg(F.min("least").alias("class_id"))
    classed = placed.join(low, "component").select("one", "two", "class_id", "copies", F.coalesce("n", F.lit(0)).alias("n"))

    met = rows.select("doc_id", "one", "two", "size").join(classed, ["one", "two"], "left")
    alone = F.col("size") == 0
    return met.select(
        tables.given_id().alias("doc_id"),
        F.when(alone, tables.given_id()).otherwise(tables.given_id("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("n_copies"),
    )


def op10_ngram_jaccard_join(spark, folder: str) -> DataFrame:
    return near_duplicates(tables.table(spark, folder, "documents"))
