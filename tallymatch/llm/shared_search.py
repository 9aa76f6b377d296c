"""Ranked lexical search for many queries at once, with the parts that queries share computed once a document.

A query is the set of its terms; a document's score is the sum of what the terms weigh in it. Queries share terms, so sums are
shared too (*multi-query common-subexpression evaluation*):

1. *Mining.* Terms that the same queries ask for become one leaf. Each query is then a list of leaves, those that most queries
   have in front. Pairs of neighbours that two queries or more have in common become a node of their own, the sum of the two, which
   takes their place in all these lists; so round by round, until no pair is shared. What is left is a graph of sums in which
   a set of terms that many queries share is one node.
2. *Documents* are cut into terms once. A document keeps its number of terms and the counts of those that some query has.
   From these tables come the number of documents N, of terms L, and of documents with each term.
3. *Evaluation.* A block of documents fills the leaves, then the nodes, level by level, then the queries from what is left of
   their lists: a document's partial sums are made once for all queries that share them. Each task keeps the ``most`` best of
   its documents for each query; the best of these are the result, in two steps, so no group is larger than one number of
   candidates for each task.

Queries are mined in the tasks that read them, in plans of at most ``POSTINGS`` pairs of query and term; what is broadcast at a time
is one plan. A query with more terms than that is spread over several plans, and its partial scores are summed by document
in a shuffle. All sums are 64-bit integers; the weight of a term is floor(1000 * ln((2N + 2) / (2 df + 1))).

A term is a run of ASCII letters and digits and any characters beyond ASCII, with A to Z lower-cased; terms are told apart by 64
bits. Null texts have no term; a query without terms, and documents that share none, give no rows. Ties go to the smaller
id, null before all others; every row of either table is a query or a document of its own, repeated ids included. Texts are
taken whole, in pieces of a megabyte (a longer text alone). Empty tables give an empty result; columns other than id and
text are not looked at.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymatch.llm import tables, words
from tallymatch.llm.suffix_tree import LOWER
from tallymatch.plans.staging import Stage

MOST = 50
POSTINGS = 200_000
ITEMS_PER_TASK = 20_000
SALTS = 64
_BLOCK = 128

SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

PLANS = "plan binary, n_items long, open boolean"
COUNTED = "row long, doc_id long, n long, terms array<int>, counts array<long>"
CANDIDATES = "item_row long, item_id long, row long, doc_id long, score long"


def scale(n: int, documents: int, terms: int) -> int:
    """What the length of a document of ``n`` terms adds below the line."""
    return 20 * (100 - 50 + (50 * n * documents) // terms)


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


@dataclass
class Plan:
    """A graph of sums. Nodes are numbered: first the leaves, then level by level.

    ``terms``: sorted keys; ``leaf``: of each term. ``left`` and ``right``: of each node that is a sum; ``levels``: where the levels
    begin, from the first sum on, and the end. ``nodes`` of query k, whose sum is its score: from ``first[k]`` to ``first[k + 1]``.
    """

    terms: np.ndarray
    leaf: np.ndarray
    left: np.ndarray
    right: np.ndarray
    levels: np.ndarray
    nodes: np.ndarray
    first: np.ndarray
    item_rows: np.ndarray
    item_ids: np.ndarray

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{field.name: getattr(self, field.name) for field in fields(self)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, whole: bytes) -> Plan:
        with np.load(io.BytesIO(whole)) as arrays:
            return cls(**{field.name: arrays[field.name] for field in fields(cls)})

    @property
    def leaves(self) -> int:
        return int(self.levels[0])

    def scores(self, leaf: np.ndarray, doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Queries by documents, of the parts that each document gives to each leaf."""
        total = np.zeros((int(self.levels[-1]), n), np.int64)
        np.add.at(total.reshape(-1), leaf * n + doc, value)
        for low, high in zip(self.levels[:-1], self.levels[1:], strict=True):
            own = slice(low - self.leaves, high - self.leaves)
            total[low:high] = total[self.left[own]] + total[self.right[own]]
        return np.add.reduceat(total[self.nodes], self.first[:-1], axis=0)


def picked(item: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the lists (``node`` by ``item``) where a shared pair of neighbours begins, none over another; the pairs."""
    next_to = np.flatnonzero(item[:-1] == item[1:])
    none = np.zeros((0, 2), np.int64)
    if not len(next_to):
        return next_to, next_to, none
    pairs, which, n = np.unique(np.stack([node[next_to], node[next_to + 1]], 1), axis=0, return_inverse=True, return_counts=True)
    which = which.reshape(-1)
    # A pair is taken where no neighbouring pair is shared by more; of equal ones the first.
    shared = np.zeros(len(item) + 1, np.int64)
    shared[next_to] = n[which]
    order = np.zeros(len(item) + 1, np.int64)
    order[next_to] = which + 1
    rank = shared * (len(pairs) + 2) + (len(pairs) + 1 - order) * (shared > 0)
    before = np.concatenate([[0], rank[:-1]])
    after = np.concatenate([rank[1:], [0]])
    at = np.flatnonzero((shared > 1) & (rank > before) & (rank >= after))
    own = order[at] - 1
    often = np.bincount(own, minlength=len(pairs)) > 1
    at = at[often[own]]
    kept, own = np.unique(order[at] - 1, return_inverse=True)
    return at, own, pairs[kept]


def mine(item: np.ndarray, term: np.ndarray, item_rows: np.ndarray, item_ids: np.ndarray) -> Plan:
    """The plan for queries given as pairs of query number (0, 1, ..., in order) and key of a term, each pair once."""
    terms, place = np.unique(term, return_inverse=True)
    # Terms that the same queries have: the sums of random numbers of these queries agree.
    mark = words.mixed(np.arange(1, len(item_rows) + 1, dtype=np.uint64))
    sums = np.zeros((len(terms), 2), np.uint64)
    np.add.at(sums[:, 0], place, mark[item])
    np.add.at(sums[:, 1], place, words.mixed(mark)[item])
    asked = np.bincount(place, minlength=len(terms))
    classes, leaf = np.unique(np.column_stack([-asked.astype(np.int64).view(np.uint64), sums]).view(np.int64), axis=0, return_inverse=True)
    leaf = leaf.reshape(-1)
    # Leaves are numbered by how many queries have them, the most first; a query has each once.
    order = np.lexsort((leaf[place], item))
    item, node = item[order], leaf[place][order]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (node[1:] != node[:-1])])
    item, node = item[new], node[new]
    left, right, levels = [], [], [len(classes)]
    while True:
        at, own, pairs = picked(item, node)
        if not len(at):
            break
        left.append(pairs[:, 0])
        right.append(pairs[:, 1])
        node = node.copy()
        node[at] = levels[-1] + own
        levels.append(levels[-1] + len(pairs))
        stays = np.ones(len(node), bool)
        stays[at + 1] = False
        item, node = item[stays], node[stays]
    none = np.zeros(0, np.int64)
    first = np.searchsorted(item, np.arange(len(item_rows) + 1))
    return Plan(
        terms, leaf, np.concatenate([none, *left]), np.concatenate([none, *right]), np.array(levels), node, first, item_rows, item_ids
    )


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, key and count of each term of each text, in order of the texts; and the terms of each text."""
    found = words.Words(LOWER[data], offsets, SEPARATORS)
    text, key = found.text_of_word(), found.hashes()
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])[: len(key)])
    return text[first], key[first], np.diff(np.append(first, len(key)))


def _of(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def _mined(batches: Iterable[pa.RecordBatch], postings: int) -> Iterator[pa.RecordBatch]:
    row, held, size = TaskContext.get().partitionId() << 40, [], 0

    def plan(parts: list, is_open: bool) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(parts)), [len(keys) for _, _, keys in parts])
        rows, given = (np.array([part[k] for part in parts], np.int64) for k in (0, 1))
        made = mine(item, np.concatenate([keys for _, _, keys in parts]), rows, given)
        return pa.RecordBatch.from_arrays(
            [pa.array([made.packed()], pa.binary()), pa.array([len(parts)], pa.int64()), pa.array([is_open])], names=["plan", "n_items", "open"]
        )

    for part, data, offsets in words.pieces(batches, "text"):
        text, key, _ = _keys(data, offsets)
        bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
        for k, given in enumerate(words.ids(part, "item_id").tolist()):
            own = key[bounds[k] : bounds[k + 1]]
            if len(own) > postings:
                for at in range(0, len(own), postings):
                    yield plan([(row + k, given, own[at : at + postings])], True)
                continue
            if held and size + len(own) > postings:
                yield plan(held, False)
                held, size = [], 0
            if len(own):
                held.append((row + k, given, own))
                size += len(own)
        row += part.num_rows
    if held:
        yield plan(held, False)


def plans(items: DataFrame, postings: int = POSTINGS) -> DataFrame:
    """The queries (item_id, text) as plans, each of so many pairs of query and term at most."""
    items = tables.only(items, "item_id", "text")
    n = -(-items.count() // ITEMS_PER_TASK)
    return items.repartition(max(1, n)).mapInArrow(lambda batches: _mined(batches, postings), PLANS)


def _counted(batches: Iterable[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    terms = sent.value.terms
    for part, data, offsets in words.pieces(batches, "text"):
        n = part.num_rows
        text, key, count = _keys(data, offsets)
        total = np.bincount(text, count, n).astype(np.int64)
        at = np.minimum(np.searchsorted(terms, key), len(terms) - 1)
        hit = terms[at] == key
        bounds = pa.array(np.searchsorted(text[hit], np.arange(n + 1)).astype(np.int32))
        columns = [
            _of(part, "row"),
            pa.array(words.ids(part)),
            pa.array(total),
            pa.ListArray.from_arrays(bounds, pa.array(at[hit].astype(np.int32))),
            pa.ListArray.from_arrays(bounds, pa.array(count[hit])),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n", "terms", "counts"])


class Best:
    """The best documents of each query so far: score and id, at most ``most`` of them once ``settle`` has run."""

    def __init__(self, n_items: int, most: int):
        self.most, self.held = most, []
        self.least, self.size, self.room = np.ones(n_items, np.int64), 0, max(4 * most * n_items, 100_000)

    def add(self, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.held.append((item, scores[item, doc], ids[doc], rows[doc]))
        self.size += len(item)
        if self.size > self.room:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        item, score, ids, rows = (np.concatenate(part) for part in zip(*self.held, strict=True))
        order = np.lexsort((rows, ids, -score, item))
        item, score, ids, rows = item[order], score[order], ids[order], rows[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.most
        last = place == self.most - 1
        self.least[item[last]] = score[last]
        self.held = [(item[keep], score[keep], ids[keep], rows[keep])]
        self.size = int(keep.sum())
        return self.held[0]


def _evaluated(batches: Iterable[pa.RecordBatch], sent, numbers: tuple, most: int, is_open: bool) -> Iterator[pa.RecordBatch]:
    plan, (weights, documents, terms) = sent.value, numbers
    best = Best(len(plan.item_rows), most)

    def table(item, score, ids, rows) -> pa.RecordBatch:
        columns = [plan.item_rows[item], plan.item_ids[item], rows, ids, score]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item_row", "item_id", "row", "doc_id", "score"])

    for whole in batches:
        for start in range(0, whole.num_rows, _BLOCK):
            batch = whole.slice(start, _BLOCK)
            lists, n = _of(batch, "terms"), batch.num_rows
            term, doc = lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy()
            if not len(term):
                continue
            count = _of(batch, "counts").flatten().to_numpy()
            lengths = np.array([scale(m, documents, terms) for m in _of(batch, "n").to_pylist()], np.int64)
            value = weights[term] * (1_000_000_000 * count // (1000 * count + lengths[doc]))
            scores = plan.scores(plan.leaf[term].astype(np.int64), doc, value, n)
            rows, ids = (_of(batch, name).to_numpy() for name in ("row", "doc_id"))
            if is_open:
                item, at = np.nonzero(scores > 0)
                yield table(item, scores[item, at], ids[at], rows[at])
            else:
                best.add(scores, rows, ids)
    if best.held:
        yield table(*best.settle())


def _numbers(counted: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """The weights of a plan's terms, the number of documents with a term, the number of all terms."""
    documents, terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # A plan has a bounded number of terms.
    having = np.zeros(n_terms, np.int64)
    for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        having[row["term"]] = row["count"]
    return np.array([weight(documents, n) for n in having.tolist()], np.int64), documents, terms


def best_of(candidates: DataFrame, most: int) -> DataFrame:
    """item_id, rank, doc_id, score: the best candidates of each query, from the best of each part of them."""
    order = [F.desc("score"), "doc_id", "row"]
    parts = candidates.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item_row", "part").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item_row").orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.select(tables.given_id("item_id").alias("item_id"), "rank", tables.given_id().alias("doc_id"), "score")


def search(
    items: DataFrame, docs: DataFrame, most: int = MOST, stage: Stage | None = None, postings: int = POSTINGS
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each query the ``most`` documents of the highest scores above 0."""
    spark = docs.sparkSession
    stage = stage or Stage(spark)
    docs = tables.only(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    stored = stage.save(plans(items, postings), "plans").withColumn("place", F.monotonically_increasing_id())
    found, partial = [], []
    made = stored.select("place", "open").collect()
    if any(row.open for row in made):
        docs = stage.save(docs, "docs")  # parts of a query meet by row, so rows have to keep their numbers
    # One plan at a time, each of bounded size.
    for row in made:
        plan = Plan.unpacked(bytes(stored.filter(F.col("place") == row.place).first()["plan"]))
        sent = spark.sparkContext.broadcast(plan)
        counted = stage.save(docs.mapInArrow(lambda batches, sent=sent: _counted(batches, sent), COUNTED), "counted")
        numbers = _numbers(counted, len(plan.terms))
        if not numbers[1]:
            continue
        scored = counted.filter(F.size("terms") > 0).mapInArrow(
            lambda batches, sent=sent, numbers=numbers, is_open=row.open: _evaluated(batches, sent, numbers, most, is_open), CANDIDATES
        )
        (partial if row.open else found).append(stage.save(scored, "candidates"))
    if partial:
        whole = partial[0]
        for other in partial[1:]:
            whole = whole.unionByName(other)
        summed = whole.groupBy("item_row", "row").agg(F.first("item_id").alias("item_id"), F.first("doc_id").alias("doc_id"), F.sum("score").alias("score"))
        found.append(summed.select("item_row", "item_id", "row", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    candidates = found[0]
    for other in found[1:]:
        candidates = candidates.unionByName(other)
    return best_of(candidates, most)


def op12_shared_search(spark, folder: str) -> DataFrame:
    return search(tables.table(spark, folder, "benchmark"), tables.table(spark, folder, "documents"))


OP12_SQL = r"""
with cut as (
  select doc_id, row_number() over () as doc,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null),
asked as (
  select item_id, row_number() over () as item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from benchmark where text is not null),
wanted as (select distinct item, item_id, unnest(terms) as term from asked),
lengths as (select doc, doc_id, cast(len(terms) as bigint) as n from cut where len(terms) > 0),
sizes as (select count(*) as nd, cast(sum(n) as bigint) as l from lengths),
single as (select doc, unnest(terms) as term from cut),
tf as (select doc, term, count(*) as tf from single where term in (select term from wanted) group by all),
df as (select term, count(*) as df from tf group by term),
parts as (
  select tf.doc, doc_id, tf.term, cast(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) as bigint)
    * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l))) as part
  from tf join df on tf.term = df.term join lengths on tf.doc = lengths.doc, sizes),
scores as (
  select item, item_id, doc, doc_id, cast(sum(part) as bigint) as score
  from parts join wanted on parts.term = wanted.term group by item, item_id, doc, doc_id having sum(part) > 0),
ranked as (
  select item_id, row_number() over (partition by item order by score desc, doc_id nulls first, doc) as rank, doc_id, score
  from scores)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 50
"""
