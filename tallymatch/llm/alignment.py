"""Alignment of the tokens of two tokenizers: groups that end at the same bytes, links of overlapping tokens, their counts.

Both tokenizers cut the same bytes, a blank and the text. Where a token of the one and a token of the other end at the same
byte, a group ends. Groups are found by *pointer jumping*: every token points to the token that reaches farthest right among
those that overlap it, which is the other tokenizer's token over its last byte, or the group's last token itself. Following
two pointers at once, for all tokens of a piece together, doubles the distance each round, so after the logarithm of the
longest group every token points to the last token of its group, which names it. A link is a pair of overlapping tokens;
every byte range between two neighbouring ends, of whichever tokenizer, is one.

The count of a pair of ids is the number of documents that hold it linked. Each task first counts the pairs of its own
documents, then Spark sums them, so a pair that every document holds is one row for each task's piece. Counts of the most
frequent pairs, ``BROADCAST_PAIRS`` at most, go to every task; the other pairs of a document meet the full table in a shuffled
join. No pair of that kind can be frequent, so the join has no heavy key. A document's own pairs are written once, with their
numbers of links, and tokenising is not done twice.

The first vocabulary is a byte-level merge list (a ``tokenizers`` file), whose ids are the ranks of its merges; the second a
``sentencepiece`` model, whose pieces spell blanks as U+2581 and single bytes as <0xHH>. Texts are taken whole, in pieces of a
megabyte (a longer text alone: what is held then grows with that text, some 100 bytes for each of its own).

Null and empty texts, and texts that either tokenizer does not spell back byte for byte, have no tokens: all numbers are 0 and
``groups_sha256`` is ''. Rows are aligned one by one, repeated rows and null ids alike, and each row counts as a document.
Ties: all pairs whose count equals the highest of their first id are best. An empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.llm import tables, words
from tallymatch.plans.staging import Stage

BROADCAST_PAIRS = 1_000_000
_HELD = 1_000_000

TOKENS = "doc_id long, a_ids array<int>, a_groups array<int>, b_ids array<int>, b_groups array<int>"
LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
FOUND = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<long>, rare_times array<int>"


@dataclass(frozen=True)
class Vocabulary:
    """``encode`` gives the ids of a text; the bytes of an id are in ``flat``, so many from ``begin`` on."""

    encode: Callable[[str], np.ndarray]
    flat: np.ndarray
    begin: np.ndarray
    size: np.ndarray


def _vocabulary(encode: Callable[[str], np.ndarray], spelled: list[bytes]) -> Vocabulary:
    size = np.array([len(token) for token in spelled], np.int64)
    return Vocabulary(encode, np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(size) - size, size)


@lru_cache(maxsize=4)
def merge_list(path: str) -> Vocabulary:
    """A byte-level vocabulary file."""
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    special = {token["content"] for token in whole["added_tokens"]}
    letters = {}
    spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    # Every byte but those that UTF-8 never has stands in some character; the others keep their order in the alphabet.
    for point in [*range(0x800), *range(0x800, 0x10000, 64), *range(0x10000, 0x110000, 4096)]:
        if not 0xD800 <= point < 0xE000:
            letters |= zip(spell(chr(point))[0][0], chr(point).encode(), strict=True)
    unseen = iter(sorted(set(range(256)) - set(letters.values())))
    for letter in sorted({c for token in whole["model"]["vocab"] if token not in special for c in token} - set(letters)):
        letters[letter] = next(unseen)
    ranks = {bytes(letters[c] for c in token): n for token, n in whole["model"]["vocab"].items() if token not in special}
    spelled = [b""] * (max(whole["model"]["vocab"].values()) + 1)
    for token, n in ranks.items():
        spelled[n] = token
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding(base64.b16encode(path.encode()).decode(), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _vocabulary(lambda text: encoding.encode_to_numpy(text, disallowed_special=()), spelled)


@lru_cache(maxsize=4)
def piece_model(path: str) -> Vocabulary:
    """A model of pieces that puts a blank before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = []
    for n in range(model.get_piece_size()):
        piece = model.id_to_piece(n)
        spelled.append(bytes([int(piece[3:5], 16)]) if model.is_byte(n) else piece.replace("▁", " ").encode())
    return _vocabulary(model.encode_as_numpy, spelled)


def laid(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, one after the other."""
    reach = np.concatenate([[0], np.cumsum(length)])
    return flat[np.repeat(begin - reach[:-1], length) + np.arange(int(reach[-1]))]


@lru_cache(maxsize=4)
def numerals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers below ``n``, a comma after each: the characters, where each number begins, how many digits it has."""
    numbers = [str(k).encode() for k in range(n)]
    digits = np.array([len(k) for k in numbers])
    return np.frombuffer(b",".join(numbers) + b",", np.uint8), np.cumsum(digits + 1) - digits - 1, digits


class Side:
    """The tokens of one tokenizer over all texts of a piece: ids, and where in the joined texts each ends."""

    def __init__(self, ids: list[np.ndarray], vocabulary: Vocabulary):
        self.counts = np.array([len(own) for own in ids], np.int64)
        self.ids = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        self.ends = np.cumsum(vocabulary.size[self.ids])
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.vocabulary = vocabulary

    def spelled(self) -> list[bytes]:
        """What the tokens of each text spell."""
        own = self.vocabulary
        whole, reach = laid(own.flat, own.begin[self.ids], own.size[self.ids]).tobytes(), np.concatenate([[0], self.ends])[self.first]
        return [whole[x:y] for x, y in zip(reach[:-1], reach[1:], strict=True)]

    def without(self, bad: np.ndarray) -> Side:
        """No tokens for these texts."""
        parts = np.split(self.ids, self.first[1:-1])
        return Side([part[:0] if drop else part for part, drop in zip(parts, bad, strict=True)], self.vocabulary)


def earlier(ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place in so many bytes, whether a token ends there and how many end before it."""
    here = np.zeros(size + 1, bool)
    here[ends] = True
    return here, np.cumsum(here) - here


def terminals(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each token, those of ``a`` first, the last token of its group, by pointer jumping over their ends."""
    size = int(a[-1]) if len(a) else 0
    (_, before_a), (here_b, before_b) = earlier(a, size), earlier(b, size)
    # A token of ``a`` points to the one of ``b`` over its last byte; that one stays where it reaches no farther itself.
    over_a, over_b = before_b[a], before_a[b]
    own = len(a) + np.arange(len(b))
    pointer = np.concatenate([len(a) + over_a, np.where(a[over_b] > b, over_b, own) if len(a) else own])
    while True:
        twice = pointer[pointer]
        if np.array_equal(twice, pointer):
            return pointer
        pointer = twice


class Aligned:
    """The tokens of both sides for the texts of a piece, and their groups and links."""

    def __init__(self, texts: list[str | None], first: Vocabulary, second: Vocabulary):
        none = np.zeros(0, np.int64)
        whole = [" " + text if text else "" for text in texts]
        self.a = Side([first.encode(text) if text else none for text in whole], first)
        self.b = Side([second.encode(text) if text else none for text in texts], second)
        expected = [text.encode() for text in whole]
        bad = np.array([x != z or y != z for x, y, z in zip(self.a.spelled(), self.b.spelled(), expected, strict=True)], bool)
        if bad.any():
            self.a, self.b = self.a.without(bad), self.b.without(bad)
        last = terminals(self.a.ends, self.b.ends)
        # The last tokens of the groups are tokens of the second side, in order.
        ends_group = np.zeros(len(last) + 1, bool)
        ends_group[last] = True
        self.ending = np.flatnonzero(ends_group)
        before = np.cumsum(ends_group) - ends_group
        group = before[last]
        self.group_a, self.group_b = group[: len(self.a.ids)], group[len(self.a.ids) :]
        # Of the groups before each text.
        self.first = before[len(self.a.ids) + self.b.first]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and pair of ids of each link. A pair is one number, the first id times the ids of the second side and the second."""
        a, b = self.a, self.b
        size = int(a.ends[-1]) if len(a.ids) else 0
        (here_a, before_a), (here_b, before_b) = earlier(a.ends, size), earlier(b.ends, size)
        ends = np.flatnonzero(here_a | here_b)
        at_a, at_b = before_a[ends], before_b[ends]
        text = np.repeat(np.arange(len(a.counts)), a.counts)[at_a]
        return text, a.ids[at_a] * len(b.vocabulary.size) + b.ids[at_b]

    def digests(self) -> list[str]:
        """For each text the hash of its groups as ``a1,a2|b1;a3|b2``; '' where it has no tokens."""
        a, b = self.a, self.b
        flat, begin, digits = numerals(max(len(a.vocabulary.size), len(b.vocabulary.size)))
        # Place of each token where the tokens of a group stand together, those of the first side in front.
        in_a, in_b = (np.bincount(group, minlength=len(self.ending)) for group in (self.group_a, self.group_b))
        to_a, to_b = np.cumsum(in_a), np.cumsum(in_b)
        at_a = np.arange(len(a.ids)) + (to_b - in_b)[self.group_a]
        at_b = np.arange(len(b.ids)) + to_a[self.group_b]
        order = np.empty(len(a.ids) + len(b.ids), np.int64)
        order[at_a], order[at_b] = a.ids, b.ids
        out = laid(flat, begin[order], digits[order] + 1)
        stop = np.cumsum(digits[order] + 1) - 1
        out[stop[to_a + to_b - in_b - 1]] = ord("|")
        out[stop[to_a + to_b - 1]] = ord(";")
        whole, reach = out.tobytes(), np.concatenate([[0], stop + 1])[a.first + b.first]
        return [hashlib.sha256(whole[x : y - 1]).hexdigest() if x < y else "" for x, y in zip(reach[:-1], reach[1:], strict=True)]


def _lists(first: np.ndarray, values: np.ndarray, kind=np.int32) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(kind)))


def _of(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def _narrow(docs: DataFrame) -> DataFrame:
    return tables.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def tokens(docs: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, and for each side the ids and the number of the group, from 0, that each token is in."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in words.pieces(batches, "text"):
            own = Aligned(_of(part, "text").to_pylist(), merge_list(first), piece_model(second))
            columns = [_of(part, "doc_id")]
            for side, group in ((own.a, own.group_a), (own.b, own.group_b)):
                columns += [_lists(side.first, side.ids), _lists(side.first, group - np.repeat(own.first[:-1], side.counts))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "a_groups", "b_ids", "b_groups"])

    return _narrow(docs).mapInArrow(cut, TOKENS)


def _linked(batches: Iterable[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for part, _, _ in words.pieces(batches, "text"):
        n = part.num_rows
        own = Aligned(_of(part, "text").to_pylist(), merge_list(first), piece_model(second))
        text, pair = own.links()
        # A piece has a million texts at most, and pairs are below the product of two vocabularies.
        pairs = len(own.a.vocabulary.size) * len(own.b.vocabulary.size)
        both = np.sort(text * pairs + pair)
        text, pair = np.divmod(both, pairs)
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])[: len(both)])
        bounds = np.searchsorted(text[new], np.arange(n + 1))
        columns = [
            pa.array(row + np.arange(n)),
            _of(part, "doc_id"),
            pa.array(own.a.counts),
            pa.array(own.b.counts),
            pa.array(np.diff(own.first)),
            pa.array(np.bincount(text, minlength=n)),
            pa.array(own.digests()),
            _lists(bounds, pair[new], np.int64),
            _lists(bounds, np.diff(np.append(new, len(pair)))),
        ]
        names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        row += n


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by pair; up to ``_HELD`` different pairs are kept until they are sent."""
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    for batch in batches:
        own, n = np.unique(_of(batch, "pairs").flatten().to_numpy(), return_counts=True)
        pairs, place = np.unique(np.concatenate([pairs, own]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
        if len(pairs) > _HELD:
            yield table()
            pairs, counts = pairs[:0], counts[:0]
    yield table()


def _looked_up(batches: Iterable[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    keys, counts, best = frequent.value
    for batch in batches:
        lists, n = _of(batch, "pairs"), batch.num_rows
        pair, times = lists.flatten().to_numpy(), _of(batch, "times").flatten().to_numpy().astype(np.int64)
        text = pc.list_parent_indices(lists).to_numpy()
        at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
        summed, best_links = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(summed, text[hit], times[hit] * counts[at[hit]])
        np.add.at(best_links, text[hit], times[hit] * best[at[hit]])
        bounds = np.searchsorted(text[~hit], np.arange(n + 1))
        columns = [
            *(_of(batch, name) for name in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")),
            pa.array(best_links),
            pa.array(summed),
            _lists(bounds, pair[~hit], np.int64),
            _lists(bounds, times[~hit]),
        ]
        names = [field.split()[0] for field in FOUND.split(", ")]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def pair_counts(linked: DataFrame, n_second: int) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair of its first id has more)."""
    counts = linked.select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("a", F.floor(F.col("pair") / n_second))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(
    docs: DataFrame, first: str, second: str, stage: Stage | None = None, most: int = BROADCAST_PAIRS
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; a row for each row of ``docs``."""
    stage = stage or Stage(docs.sparkSession)
    linked = stage.save(_narrow(docs).mapInArrow(lambda batches: _linked(batches, first, second), LINKED), "linked")
    counts = stage.save(pair_counts(linked, len(piece_model(second).size)), "pairs")
    least = tables.least_of_most(counts, "n", most)
    top = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    arrays = [top.column(k).to_numpy() for k in range(3)]
    sent = docs.sparkSession.sparkContext.broadcast((arrays[0], arrays[1], arrays[2].astype(np.int64)))

    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
    found = linked.mapInArrow(lambda batches: _looked_up(batches, sent), FOUND)
    rest = counts.filter(F.col("n") < least)
    if rest.isEmpty():
        return found.select(*names, "n_best", "count_sum", "groups_sha256")
    found = stage.save(found, "found")
    rare = found.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("own"))
    rare = rare.select("row", F.col("own.rare").alias("pair"), F.col("own.rare_times").alias("times"))
    more = rare.join(rest, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more_sum"),
    )
    none = F.lit(0).cast("long")
    return found.join(more, "row", "left").select(
        *names,
        (F.col("n_best") + F.coalesce("more_best", none)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", none)).alias("count_sum"),
        "groups_sha256",
    )


def op11_alignment(spark, folder: str) -> DataFrame:
    import public_tokenizers

    first, second = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align(tables.table(spark, folder, "documents"), first, second)
