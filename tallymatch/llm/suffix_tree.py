"""Language-model scores from a probabilistic suffix tree.

The text of a document is its words, lower-cased (A to Z), joined by one blank and closed by an end; the symbols of the model
are the bytes of that. A context is a run of up to ``DEPTH`` bytes; before its first byte every text has ends.

*The tree* is learnt from the documents that are not held out. Every context that occurs ``LEAST`` times is a candidate, whatever
the size of the corpus. Distributions of the next symbol are smoothed with those of the context without the oldest byte:
``DISCOUNT`` is taken off every count, and what that frees, and ``WEIGHT`` more, goes to the shorter context; the bytes alone are
smoothed with equal shares (Witten-Bell). Candidates of up to ``ROOTS`` bytes are kept. A longer one is retained if its
distribution differs from that of the shorter one: the divergence, times its count, has to pay for the parameters it adds
(half the logarithm of the count for each symbol that follows it) and for its name (the logarithm of the number of candidates
that differ from it in the oldest byte alone). Contexts that a retained one ends with are retained too. A symbol is scored in the longest
context that is retained.

*How it runs.* A number for each symbol holds its context, newest byte first, and the symbol, so that in sorted order each node of
the tree is a stretch, with all longer contexts that end alike inside it.

1. Tasks read the texts once, in chunks of up to ``CHUNK`` symbols and ``DIFFERENT`` different numbers, and write each chunk's symbols and its different numbers with their
   counts, sorted, as differences, compressed: one row for a chunk and one of ``SLOTS`` slots, by the newest three bytes. Words, and runs of
   three bytes, are counted on the way; the latter are 2 ** 24 at most and make the top of the tree, which goes to every task.
2. The rows of a slot meet in one task, which sums them and has whole subtrees then: counts, tests, smoothing and costs
   of all its contexts are a few passes over sorted arrays. Numbers that only held-out documents have are in it with count 0.
   The same task answers each of its rows: the length of the context that every number is scored in, and a cost for each different pair
   of such a context and a symbol, from which the chunk can tell the costs of its numbers.
3. The answers to a chunk meet its symbols, and documents are summed up.

So the shuffles carry differences of sorted numbers, once, and what differs among their costs, and hot contexts are
merged before they move. The arrays of one chunk, then a slot's arrays, and its rows as they came, compressed, are what a task holds; raise ``slots`` where a
corpus has more different numbers than some 10 million for each.

The base score needs the count of every word. Counts of the most frequent words, ``BROADCAST_WORDS`` at most, go to every
task; the other words of a document meet the full table of counts in a shuffled join. No word of that kind can be frequent,
so the join has no heavy key. Words are told apart by 64-bit hashes.

Null text: empty, so just the end. Null id: held out, its text counts as none, so remainder 0. Rows are scored one by
one, repeated rows alike. A very long text is cut at white space into parts of a megabyte, which see the symbols before
them, so memory does not depend on it (a longer word alone). Without training documents all counts are 0 and the model gives equal shares.
Ties do not matter: all candidates that pass are kept. An empty table gives an empty result; columns other than ``doc_id`` and
``text`` are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymatch.llm import tables, words
from tallymatch.plans.staging import Stage

DEPTH = 7
LEAST = 2
ROOTS = 3
DISCOUNT = 0.8
WEIGHT = 20.0
BROADCAST_WORDS = 400_000
ADDED = 0.1
CHUNK = 16 << 20
DIFFERENT = 23 << 17
BLOCK = 1 << 20
PART_BYTES = words.PIECE_BYTES
SLOTS = 1024
_ROWS = 1 << 20
_MERGED = 1 << 17
_VALUES = 256
#: Rows of an Arrow batch: of texts, of words.
_TEXTS, _WORDS = 1024, 1 << 16

END = 10
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
END_KEY = 0
#: In place of a slot, for the other rows of a chunk.
TEXTS, WORDS, SHORT = -1, -2, -3

BYTE = np.uint64(8)
ASKED = "chunk long, slot int, data binary, counts binary"
ANSWERED = "chunk long, slot int, data binary"
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>"


def held_out(name: str = "doc_id") -> Column:
    """A tenth of the documents, by the checksum of their ids."""
    return F.coalesce(F.crc32(F.col(name).cast("long").cast("string").cast("binary")) % 10, F.lit(0)) == 0


def packed(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value. Bytes of like weight stand together, which makes them shorter."""
    planes = [np.ascontiguousarray(x).view(np.uint8)[k :: x.itemsize].tobytes() for x in arrays for k in range(x.itemsize)]
    whole = b"".join([np.array([len(x) for x in arrays], np.int64).tobytes(), *planes])
    return len(whole).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(whole, asbytes=True)


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    whole = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    at, out = 8 * len(kinds), []
    for n, kind in zip(whole[:at].view(np.int64).tolist(), map(np.dtype, kinds), strict=True):
        own = np.empty(n * kind.itemsize, np.uint8)
        for k in range(kind.itemsize):
            own[k :: kind.itemsize] = whole[at : at + n]
            at += n
        out.append(own.view(kind))
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def symbols(found: words.Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each after ``depth`` ends, and where each begins (its ends included)."""
    lengths = found.ends - found.starts + 1
    reach = np.concatenate([[0], np.cumsum(lengths)])
    own = reach[found.first[1:]] - reach[found.first[:-1]]
    whole = np.maximum(own, 1) + depth
    begin = np.concatenate([[0], np.cumsum(whole)])
    out = np.full(int(begin[-1]), END, np.uint8)
    if len(found):
        to = reach[:-1] + np.repeat(begin[:-1] + depth - reach[found.first[:-1]], found.counts)
        compact = np.arange(int(reach[-1]))
        source = np.repeat(found.starts - reach[:-1], lengths) + compact
        target = np.repeat(to - reach[:-1], lengths) + compact
        values = np.append(found.data, np.uint8(32))[source]
        values[reach[1:] - 1] = 32
        values[reach[found.first[1:][own > 0]] - 1] = END
        out[target] = LOWER[values]
    return out, begin


def runs(stream: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
    """For each symbol the number that it makes with the ``depth`` symbols before it, the newest in the lowest byte."""
    total = stream.astype(np.uint64)
    have = 1
    while have <= depth:
        step = min(have, depth + 1 - have)
        # The newest ``step`` symbols of the run that ends ``have`` earlier are its oldest ones.
        low = total[: len(total) - have] & np.uint64((1 << (8 * step)) - 1)
        total[have:] |= low << np.uint64(8 * have)
        have += step
    padding = np.zeros(len(stream), bool)
    for k in range(depth):
        padding[begin[:-1] + k] = True
    return total[~padding]


def sortable(run: np.ndarray) -> np.ndarray:
    """The same with the context in the upper seven bytes, newest first, and the symbol in the lowest."""
    turned = run.byteswap()
    return (turned << BYTE) | (turned >> np.uint64(56))


def by_slot(keys: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by slot, which goes by the newest three bytes of the context, and where each slot begins in it."""
    slot = np.empty(len(keys), np.uint16)
    for at in range(0, len(keys), _MERGED):
        slot[at : at + _MERGED] = words.mixed(keys[at : at + _MERGED] >> np.uint64(40)) % np.uint64(slots)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=slots))])
    return np.argsort(slot, kind="stable"), bounds


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, in order, with the sums of its counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], *(np.add.reduceat(n[order], first) if len(first) else n for n in counts)


def firsts(values: np.ndarray) -> np.ndarray:
    """Which of the sorted values differ from the one before."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def different(values: np.ndarray) -> np.ndarray:
    """Each value once, in order."""
    values = np.sort(values)
    return values[firsts(values)]


def joined(keys: np.ndarray, n: np.ndarray, more: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of keys as one, the counts of those in both added up."""
    at = np.searchsorted(keys, more)
    new = np.ones(len(more), bool)
    new[at < len(keys)] = keys[at[at < len(keys)]] != more[at < len(keys)]
    at += np.cumsum(new) - new
    old = np.ones(len(keys) + np.count_nonzero(new), bool)
    old[at[new]] = False
    out, sums = np.empty(len(old), keys.dtype), np.empty(len(old), n.dtype)
    out[old], out[at] = keys, more
    sums[old], sums[at[new]] = n, 0
    sums[at] += m
    return out, sums


def merged(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted lists of different keys as one with each key once, and for each list where its keys are in it. One stretch of keys after the
    other, so that little more than the lists and the result is held; empties ``parts``."""
    cuts = max(parts, key=len)[_MERGED::_MERGED].copy()
    ends = [np.append(np.searchsorted(part, cuts), len(part)) for part in parts]
    places = [np.empty(len(part), np.uint32) for part in parts]
    out, size, begins = [], 0, [0] * len(parts)
    for stops in zip(*ends, strict=True):
        keys = np.concatenate([part[at:end] for part, at, end in zip(parts, begins, stops, strict=True)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = firsts(keys)
        to = np.empty(len(keys), np.uint32)
        to[order] = np.cumsum(first) + (size - 1)
        reach = 0
        for place, at, end in zip(places, begins, stops, strict=True):
            place[at:end] = to[reach : reach + end - at]
            reach += end - at
        out.append(keys[first])
        size, begins = size + len(out[-1]), stops
    parts.clear()
    return np.concatenate(out), places


def word_keys(found: words.Words) -> np.ndarray:
    lowered = words.Words.__new__(words.Words)
    lowered.__dict__.update(found.__dict__)
    lowered.data = LOWER[found.data]
    keys = lowered.hashes()
    keys[keys == END_KEY] = 1
    return keys


def _of(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def cuts(data: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Parts of a long text, each of about ``most`` bytes, that begin with a word (a longer word alone); the last ends with one."""
    white = words.WHITE[data]
    if white.all():
        return [(0, 0)]
    end, at, out = len(data) - int(np.argmin(white[::-1])), 0, []
    while at < end:
        at += int(np.argmin(white[at:end]))
        stop = min(at + most, end)
        if stop < end and not white[stop]:
            before, after = white[at:stop][::-1], white[stop:end]
            if before.any():
                stop -= int(np.argmax(before)) + 1
            else:
                stop = stop + int(np.argmax(after)) if after.any() else end
        out.append((at, stop))
        at = stop
    return out


class Chunk:
    """The symbols of texts, or of parts of long ones, and their different numbers so far."""

    def __init__(self, depth: int, slots: int, most: int):
        self.depth, self.slots, self.most, self.block = depth, slots, most, min(BLOCK, most)
        self.streams, self.lengths, self.rows, self.size = [], [], [], 0
        self.words = []
        self.open, self.waiting = {True: [], False: []}, 0
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def add(self, row: np.ndarray, given: list, held: np.ndarray, found: words.Words, before: np.ndarray | None = None, last: bool = True):
        """``before``: the symbols in front of a part; ``last``: whether the text ends with it. Gives back its last symbols."""
        stream, begin = symbols(found, self.depth)
        if before is not None:
            stream[: self.depth] = before
        if not last:
            stream[-1] = 32
        self.streams.append(stream)
        self.lengths.append(np.diff(begin))
        known = np.array([i is not None for i in given])
        ids = np.array([0 if i is None else i for i in given], np.int64)
        ends = np.full(len(row), last)
        self.rows.append((row, ids, known, held, np.full(len(row), before is None), ends))
        self.size += len(stream)

        keys = np.concatenate([word_keys(found), np.full(int(ends.sum()), END_KEY, np.uint64)])
        train = np.concatenate([np.repeat(~held, found.counts), ~held[ends]])
        keys, place, n = np.unique(keys, return_inverse=True, return_counts=True)
        self.words.append((keys, n, np.bincount(place, train, len(keys)).astype(np.int64)))

        keys, train = sortable(runs(stream, begin, self.depth)), np.repeat(~held, np.diff(begin) - self.depth)
        self.open[True].append(keys[train])
        self.open[False].append(keys[~train])
        self.waiting += len(keys)
        if self.waiting >= self.block:
            self.settle()
        return stream[-self.depth :]

    def settle(self) -> None:
        learnt, other = np.concatenate(self.open[True]), np.concatenate(self.open[False])
        self.open, self.waiting = {True: [], False: []}, 0
        learnt.sort()
        at, size = np.flatnonzero(firsts(learnt)), len(learnt)
        learnt, n = learnt[at], np.diff(at, append=size).astype(np.int32)
        del at
        other = different(other)
        learnt, n = joined(learnt, n, other, np.zeros(len(other), np.int32))
        del other
        self.keys, self.n = joined(self.keys, self.n, learnt, n)

    @property
    def full(self) -> bool:
        return self.size >= self.most or len(self.keys) >= DIFFERENT

    def rows_of(self, chunk: int) -> Iterator[pa.RecordBatch]:
        def table(slots: list[int], data: list[bytes], counts: list[bytes | None]) -> pa.RecordBatch:
            columns = [pa.array(np.full(len(slots), chunk)), pa.array(slots, pa.int32()), pa.array(data, pa.binary()), pa.array(counts, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "slot", "data", "counts"])

        if self.waiting:
            self.settle()
        stream, length = np.concatenate(self.streams), np.concatenate(self.lengths)
        self.streams = []
        texts = packed(stream, length, *(np.concatenate(x) for x in zip(*self.rows, strict=True)), level=7)
        del stream, length
        keys, n = self.keys, self.n
        short, of_short = [], []
        for at in range(0, len(keys), _ROWS):
            own = keys[at : at + _ROWS]
            code, m = summed(((own >> np.uint64(48)) << BYTE) | (own & np.uint64(255)), n[at : at + _ROWS].astype(np.int64))
            short.append(code)
            of_short.append(m)
        short, of_short = summed(np.concatenate(short), np.concatenate(of_short))
        word, whole, in_train = summed(*(np.concatenate(x) for x in zip(*self.words, strict=True)))
        yield table([TEXTS, WORDS, SHORT], [texts, packed(steps(word), in_train.astype(np.int32), whole.astype(np.int32)), packed(short, of_short)], [None] * 3)
        del texts, word, whole, in_train
        self.words = []
        order, bounds = by_slot(keys, self.slots)
        full = np.flatnonzero(np.diff(bounds))
        for some in np.array_split(full, max(1, len(full) // 128)):
            parts = [order[bounds[k] : bounds[k + 1]] for k in some]
            yield table(some.tolist(), [packed(steps(keys[part])) for part in parts], [packed(n[part]) for part in parts])


def asked(batches: Iterable[pa.RecordBatch], depth: int, slots: int, most: int, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """For each chunk its texts, the counts of its words and short runs, and its numbers by slot."""
    number = TaskContext.get().partitionId() << 40
    row, own = number, Chunk(depth, slots, most)
    for part, data, offsets in words.pieces(batches, "text", part_bytes):
        n = part.num_rows
        rows, given = row + np.arange(n), _of(part, "doc_id").to_pylist()
        held = _of(part, "held_out").to_numpy(zero_copy_only=False)
        row += n
        long = n == 1 and len(data) > part_bytes
        parts = cuts(data, part_bytes) if long else [(0, len(data))]
        before = None
        for k, (start, stop) in enumerate(parts):
            bounds = np.array([0, stop - start]) if long else offsets
            found = words.Words(data[start:stop], bounds)
            before = own.add(rows, given, held, found, before, k == len(parts) - 1)
            if own.full:
                yield from own.rows_of(number)
                number, own = number + 1, Chunk(depth, slots, most)
    if own.size:
        yield from own.rows_of(number)


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words."""
    for batch in batches:
        for data in _of(batch, "data").to_pylist():
            gaps, train, whole = unpacked(data, np.uint64, np.int32, np.int32)
            keys = np.cumsum(gaps, dtype=np.uint64).view(np.int64)
            for at in range(0, len(keys), _WORDS):
                columns = [keys[at : at + _WORDS], *(n[at : at + _WORDS].astype(np.int64) for n in (train, whole))]
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=["key", "train", "whole"])


def counted_short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of runs of three bytes, summed in the task."""
    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for data in _of(batch, "data").to_pylist():
            own, more = unpacked(data, np.uint64, np.int64)
            keys, n = summed(np.concatenate([keys, own]), np.concatenate([n, more]))
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])


class Level:
    """The runs of one length: ``code`` (the context, newest byte first, and the symbol), their counts, and of each context
    the place, count and number of different symbols."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.code, self.n = code, n
        context = code >> BYTE
        self.first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])[: len(code)])
        self.context = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(code))))
        self.total = np.bincount(self.context, n, len(self.first))
        self.different = np.bincount(self.context, n > 0, len(self.first))

    def shorter(self) -> tuple[Level, np.ndarray]:
        """The runs without their oldest byte, and where each of ours is among them."""
        code = ((self.code >> np.uint64(16)) << BYTE) | (self.code & np.uint64(255))
        found, place = np.unique(code, return_inverse=True)
        return Level(found, np.bincount(place, self.n, len(found))), place

    def smoothed(self, lower: np.ndarray) -> np.ndarray:
        total, different = self.total[self.context], self.different[self.context]
        kept = np.maximum(self.n - DISCOUNT, 0) + (WEIGHT + DISCOUNT * different) * lower
        return np.where(total > 0, kept / (total + WEIGHT), lower)

    def gain(self, lower: np.ndarray) -> np.ndarray:
        """The divergence of each context from the shorter one, times its count, less what its parameters cost."""
        seen = self.n > 0
        part = np.zeros(len(self.n))
        part[seen] = self.n[seen] * np.log(self.n[seen] / self.total[self.context][seen] / lower[seen])
        return np.bincount(self.context, part, len(self.first)) - 0.5 * self.different * np.log(np.maximum(self.total, 1))


class Model:
    """The top of the tree: contexts of up to two bytes. ``codes`` are the runs of three bytes that occur, in order, ``best`` the
    probability of the last byte of each.

    ``cost``: log10 probabilities of the bytes that were seen, and of any other, in rows of ``width``: before any context, then after
    each byte that is a candidate.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray, least: int):
        self.codes, self.least = codes, least
        two = Level(codes, n)
        one, to_one = two.shorter()
        none, to_none = one.shorter()
        counts = np.zeros(256)
        counts[none.code.astype(np.int64)] = none.n
        total, different = counts.sum(), np.count_nonzero(counts)
        self.first = (counts + different / 256) / (total + different) if total else np.full(256, 1 / 256)
        lower = self.first[none.code.astype(np.int64)][to_none]
        p_one = one.smoothed(lower)
        best = np.where((one.total >= least)[one.context], p_one, lower)
        self.best = np.where((two.total >= least)[two.context], two.smoothed(best[to_one]), best[to_one])

        seen = np.flatnonzero(counts)
        unseen = self.first[counts == 0][0] if len(seen) < 256 else 0.0
        rows = [np.append(self.first[seen], unseen)]
        column = np.full(256, len(seen))
        column[seen] = np.arange(len(seen))
        for k in np.flatnonzero(one.total >= least):
            own = one.context == k
            row = (WEIGHT + DISCOUNT * one.different[k]) * rows[0] / (one.total[k] + WEIGHT)
            at = column[(one.code[own] & np.uint64(255)).astype(np.int64)]
            row[at[at < len(seen)]] = p_one[own][at < len(seen)]
            rows.append(row)
        with np.errstate(divide="ignore"):
            self.cost = np.log10(np.concatenate(rows))
        self.width = len(seen) + 1


def train(asked_rows: DataFrame, least_share: float) -> Model:
    """The top of the tree from the counts of short runs, of which there are 2 ** 24 at most."""
    rows = asked_rows.filter((F.col("kind") == "whole") & (F.col("slot") == SHORT)).select("data").mapInArrow(counted_short, "key long, n long")
    found = rows.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    codes, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy().astype(np.int64)
    order = np.argsort(codes)
    return Model(codes[order], n[order], max(LEAST, math.ceil(int(n.sum()) * least_share)))


def costs(keys: np.ndarray, n: np.ndarray, depth: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """What each number's symbol costs, less log10 of its probability, for all numbers of whole subtrees below ``ROOTS`` bytes, and the
    length of the context that tells it (one less than ``ROOTS`` for all that the top of the tree settles)."""
    context = keys >> np.uint64(8 * (8 - depth))
    level = Level((context << BYTE) | (keys & np.uint64(255)), n)
    levels, places = [level], []
    for _ in range(depth - ROOTS):
        level, place = level.shorter()
        levels.append(level)
        places.append(place)
    levels.reverse()
    places.reverse()

    above = ((levels[0].code >> np.uint64(16)) << BYTE) | (levels[0].code & np.uint64(255))
    lower = model.best[np.searchsorted(model.codes, above)]
    smooth, best = [levels[0].smoothed(lower)], lower
    kept = [levels[0].total >= model.least]
    parents = [np.zeros(0, np.int64)]
    for level, shorter, place in zip(levels[1:], levels[:-1], places, strict=True):
        lower = smooth[-1][place]
        candidate = level.total >= model.least
        parent = shorter.context[place][level.first]
        alike = np.bincount(parent[candidate], minlength=len(shorter.first))[parent]
        kept.append(candidate & (level.gain(lower) > np.log(np.maximum(alike, 1))))
        parents.append(parent)
        smooth.append(level.smoothed(lower))
    # What a retained context ends with is retained.
    for k in range(len(levels) - 1, 0, -1):
        kept[k - 1][parents[k][kept[k]]] = True
    length = np.full(len(best), ROOTS - 1, np.uint8)
    for k, level in enumerate(levels):
        own = kept[k][level.context]
        best = np.where(own, smooth[k], best if k == 0 else best[places[k - 1]])
        length = np.where(own, np.uint8(ROOTS + k), length if k == 0 else length[places[k - 1]])
    # Three bits less than the kind holds, a relative error below 3e-7: these would not compress.
    exact = (-np.log10(best)).astype(np.float32).view(np.uint32)
    return ((exact + np.uint32(4)) & ~np.uint32(7)).view(np.float32), length


def alike(keys: np.ndarray, length: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which of the numbers are scored in a shorter context than their own, the place of each of these among the different pairs of such a
    context and a symbol, and how many pairs there are. All others differ from each other."""
    short = length < depth
    keys, length = keys[short], length[short].astype(np.uint64)
    rest = np.uint64(64) - BYTE * length
    # The byte above the symbol is free in all of them: it tells a context from one that goes on with zeros.
    pairs, place = np.unique((keys >> rest << rest) | (length << BYTE) | (keys & np.uint64(255)), return_inverse=True)
    return short, place, len(pairs)


def answer(keys: np.ndarray, cost: np.ndarray, length: np.ndarray, depth: int) -> bytes:
    """The costs of sorted numbers: the lengths of their contexts, then each cost once."""
    short, place, n = alike(keys, length, depth)
    once = np.empty(n, np.float32)
    once[place] = cost[short]
    return packed(length, np.append(once, cost[~short]))


def read_answer(keys: np.ndarray, data: bytes, depth: int) -> np.ndarray:
    """The costs of the same numbers."""
    length, once = unpacked(data, np.uint8, np.float32)
    short, place, n = alike(keys, length, depth)
    cost = np.empty(len(keys), np.float32)
    cost[short], cost[~short] = once[place], once[n:]
    return cost


def by_key(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple[int, Iterator[list]]]:
    """Rows in order of the first column, those of each of its values together, one row at a time."""

    def rows() -> Iterator[list]:
        for batch in batches:
            columns = [_of(batch, name) for name in names]
            for k in range(batch.num_rows):
                yield [column[k].as_py() for column in columns]

    return groupby(rows(), lambda row: row[0])


def learnt(batches: Iterable[pa.RecordBatch], depth: int, sent) -> Iterator[pa.RecordBatch]:
    """The costs for each row of a chunk and slot, from the numbers and counts of all rows of the slot."""
    for slot, rows in by_key(batches, "slot", "chunk", "data", "counts"):
        keys, n, held, size, asking = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, []
        for _, chunk, data, counts in rows:
            (gaps,), (more,) = unpacked(data, np.uint64), unpacked(counts, np.int32)
            asking.append((chunk, data))
            held.append((np.cumsum(gaps, dtype=np.uint64), more))
            size += len(gaps)
            if size > max(_ROWS, len(keys)):
                keys, n = _merged(keys, n, held)
                held, size = [], 0
        keys, n = _merged(keys, n, held)
        held = []
        cost, length = costs(keys, n, depth, sent.value)
        for chunk, data in asking:
            (gaps,) = unpacked(data, np.uint64)
            own = np.cumsum(gaps, dtype=np.uint64)
            at = np.searchsorted(keys, own)
            columns = [pa.array([chunk]), pa.array([slot], pa.int32()), pa.array([answer(own, cost[at], length[at], depth)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "slot", "data"])


def _merged(keys: np.ndarray, n: np.ndarray, more: list) -> tuple[np.ndarray, np.ndarray]:
    if not more:
        return keys, n
    return summed(np.concatenate([keys, *(k for k, _ in more)]), np.concatenate([n, *(m.astype(np.int64) for _, m in more)]))


def matched(own: np.ndarray, text: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Which of a piece's keys are in the sorted ``keys``, where these are, and the others as a list for each of ``n`` texts."""
    at = np.searchsorted(keys, own)
    at[at == len(keys)] = 0
    hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
    order = np.argsort(text[~hit], kind="stable")
    reach = np.concatenate([[0], np.cumsum(np.bincount(text[~hit], minlength=n))])
    return hit, at[hit], pa.ListArray.from_arrays(pa.array(reach.astype(np.int32)), pa.array(own[~hit][order].view(np.int64)))


def blocks(length: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``most`` symbols together."""
    reach, at = np.concatenate([[0], np.cumsum(length)]), 0
    while at < len(length):
        to = max(at + 1, int(np.searchsorted(reach, reach[at] + most, "right")) - 1)
        yield at, to
        at = to


def _numbers(stream: np.ndarray, begin: np.ndarray, i: int, j: int, depth: int) -> np.ndarray:
    """Of the symbols of some texts."""
    return sortable(runs(stream[begin[i] : begin[j]], begin[i : j + 1] - begin[i], depth))


def numbered(stream: np.ndarray, length: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of a chunk, in order, and for each symbol where its number is among them.

    Blocks are sorted one by one; those since the last merge wait for the next, with the places in their own numbers."""
    begin = np.concatenate([[0], np.cumsum(length)])
    place = np.empty(len(stream) - depth * len(length), np.uint32)
    parts, bounds, size = [np.zeros(0, np.uint64)], [0, 0], 0

    def merge() -> None:
        nonlocal size
        keys, places = merged(parts)
        for to, at, end in zip(places, bounds, bounds[1:], strict=False):
            for i in range(at, end, BLOCK):
                own = place[i : min(i + BLOCK, end)]
                own[:] = to[own]
        parts[:], bounds[:], size = [keys], [0, bounds[-1]], 0

    for i, j in blocks(length, BLOCK >> 1):
        own = _numbers(stream, begin, i, j, depth)
        order = np.argsort(own)
        own = own[order]
        first = firsts(own)
        at = bounds[-1]
        place[at : at + len(own)][order] = np.cumsum(first, dtype=np.uint32) - np.uint32(1)
        bounds.append(at + len(own))
        parts.append(own[first])
        size += len(parts[-1])
        del own, order, first
        if size > max(BLOCK, len(parts[0])) // 2:
            merge()
    merge()
    return parts[0], place


def scored(batches: Iterable[pa.RecordBatch], depth: int, slots: int, frequent) -> Iterator[pa.RecordBatch]:
    """The texts of all chunks, and parts of texts, from their symbols and the costs of these."""
    for _, rows in by_key(batches, "chunk", "slot", "data"):
        yield from scored_chunk(rows, depth, slots, *frequent.value)


def scored_chunk(rows: Iterator[list], depth: int, slots: int, word: np.ndarray, logs: np.ndarray, known_word: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Those of one chunk, all of whose arrays are gone before the next one's are made."""
    _, _, texts = next(rows)
    stream, length, row, ids, known, held, first, last = unpacked(
        texts, np.uint8, np.int64, np.int64, np.int64, bool, bool, bool, bool
    )
    del texts
    begin = np.concatenate([[0], np.cumsum(length)])
    # The different numbers of a slot make up the row that was answered.
    keys, place = numbered(stream, length, depth)
    cost = np.empty(len(keys), np.float32)
    order, bounds = by_slot(keys, slots)
    for _, slot, data in rows:
        own = order[bounds[slot] : bounds[slot + 1]]
        cost[own] = read_answer(keys[own], data, depth)
    del order, keys
    at = 0
    for i, j in blocks(length, BLOCK >> 2):
        m, span = j - i, length[i:j]
        to = at + int(span.sum()) - depth * m
        score = np.bincount(np.repeat(np.arange(m), span - depth), -cost[place[at:to]], m)
        at = to
        # The symbols before a part belong to another one.
        symbols_of, begins = stream[begin[i] : begin[j]].copy(), begin[i : j + 1] - begin[i]
        for k in begins[:-1][~first[i:j]]:
            symbols_of[k : k + depth] = END
        found = words.Words(symbols_of, begins)
        ends = np.flatnonzero(last[i:j])
        own = np.concatenate([word_keys(found), np.full(len(ends), END_KEY, np.uint64)])
        text = np.concatenate([found.text_of_word(), ends])
        hit, known_at, rare = matched(own, text, word, m)
        columns = [
            pa.array(row[i:j]),
            pa.array(ids[i:j], mask=~known[i:j]),
            pa.array(held[i:j]),
            pa.array(found.counts.astype(np.int64) + last[i:j]),
            pa.array(np.bincount(text[hit], known_word[known_at], m).astype(np.int64)),
            pa.array(np.bincount(text[hit], logs[known_at], m)),
            pa.array(score),
            rare,
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in SCORED.split(", ")])


def score(
    docs: DataFrame,
    stage: Stage | None = None,
    depth: int = DEPTH,
    least_share: float = 0.0,
    most: int = BROADCAST_WORDS,
    slots: int = SLOTS,
    chunk: int = CHUNK,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each row of ``docs``."""
    if not ROOTS <= depth < 8 or not 0 < slots <= 1 << 16:
        raise ValueError("a context has 3 to 7 bytes, and there are 65,536 slots at most")
    spark = docs.sparkSession
    stage = stage or Stage(spark)
    docs = tables.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    # The rows of slots lie in a folder of their own, which goes when they are answered.
    path = stage.path("asked")
    rows = docs.mapInArrow(lambda batches: asked(batches, depth, slots, chunk, part_bytes), ASKED)
    with tables.small_batches(spark, _TEXTS):
        rows.withColumn("kind", F.when(F.col("slot") >= 0, "slots").otherwise("whole")).write.partitionBy("kind").parquet(path)
    # A table without rows has neither folder.
    rows = spark.read.schema(f"{ASKED}, kind string").parquet(path)

    model = train(rows, least_share)
    top = spark.sparkContext.broadcast(model)
    own = rows.filter((F.col("kind") == "whole") & (F.col("slot") == WORDS)).select("data").mapInArrow(counted, "key long, train long, whole long")
    own = stage.save(own.groupBy("key").agg(F.sum("train").alias("train"), F.sum("whole").alias("whole")), "words")
    tokens, distinct = own.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).first()
    below = math.log10(tokens + ADDED * (distinct + 1))
    least = tables.least_of_most(own, "whole", most)
    frequent = own.filter((F.col("whole") >= least) | (F.col("key") == END_KEY)).toArrow()
    keys, known = frequent.column("key").to_numpy().view(np.uint64), frequent.column("train").to_numpy()
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], np.log10(known[order] + ADDED) - below, (known[order] > 0).astype(float)))

    of_slot = rows.filter("kind = 'slots'").drop("kind").repartition("slot").sortWithinPartitions("slot")
    with tables.small_batches(spark, _VALUES):
        answers = stage.save(of_slot.mapInArrow(lambda batches: learnt(batches, depth, top), ANSWERED), "answers")
    stage.drop(f"{path}/kind=slots")
    rows = spark.read.schema(f"{ASKED}, kind string").parquet(path)
    texts = rows.filter((F.col("kind") == "whole") & (F.col("slot") == TEXTS)).select("chunk", "slot", "data")
    # Texts stand before the costs of their chunk.
    meeting = texts.unionByName(answers).repartition("chunk").sortWithinPartitions("chunk", "slot")
    with tables.small_batches(spark, _VALUES):
        found = stage.save(meeting.mapInArrow(lambda batches: scored(batches, depth, slots, sent), SCORED), "scored")

    whole = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("held_out").alias("held_out"),
        *(F.sum(name).alias(name) for name in ("n_tokens", "n_known", "base", "score")),
    )
    log = F.log10(F.col("train") + ADDED) - F.lit(below)
    others = own.filter((F.col("whole") < least) & (F.col("train") > 0)).select("key", log.alias("value"))
    added = found.select("row", F.explode("rare").alias("key")).join(others, "key", "left").groupBy("row").agg(
        F.sum(F.coalesce("value", F.lit(math.log10(ADDED) - below))).alias("more"), F.count("value").alias("more_known")
    )
    return whole.join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op4_lm_scoring(spark, folder: str) -> DataFrame:
    return score(tables.table(spark, folder, "documents"))
