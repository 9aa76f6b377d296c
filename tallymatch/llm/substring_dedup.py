"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window over it starts earlier as well: in a
document of smaller id, or earlier in the same one. Windows are judged on the input, not on what is left.

Hashing every window and shuffling it would move many times the input. Instead, runs of ``ANCHOR`` words are hashed only at
positions whose remainder modulo ``PERIOD`` is in ``COVER``. The differences of ``COVER`` give every remainder, so for any
two positions i and j there is a step d < ``PERIOD`` that takes both into the cover; two equal windows of
``ANCHOR + PERIOD - 1`` words or more therefore share an anchor at the same place. So:

1. *Copies.* Of rows with equal word sequences all but those with the smallest id lose everything, since each of their windows
   starts earlier there; only the others go on. A task sends the text of a sequence once and tells itself which of its rows
   are later copies.
2. *Anchors.* Each task hashes its anchors and sends one row for each different hash. Hashes that it has met twice itself
   need no partner elsewhere. The group of a hash has a row for each task's piece at most, however often a passage occurs.
3. *Extension.* Documents with repeated anchors are picked out, and the windows around those anchors are hashed as a whole,
   to 96 bits. Again a task sends the first place of each hash only; its later places are known to go. Of the places that
   meet, all but the first go.
4. Documents meet their marked windows by id.

Texts travel compressed. Null text: no words. Null id: an id smaller than all others. Rows with the same id are judged
each on its own text; where two such rows hold the same window at the same place, neither is earlier, so repeated rows
are treated alike. Texts of fewer words than a window are kept whole. Empty tables give empty results; columns other
than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymatch.llm import tables, words
from tallymatch.plans.staging import Stage

WINDOW = 20
PERIOD = 13
#: A perfect difference set: its differences modulo 13 are 0 to 12.
COVER = (0, 1, 3, 9)

PACKED = "one long, two long, doc_id long, text binary, n_words long, copy boolean, carried string"
ANCHORS = "key long, doc_id long, pos int, hits array<int>"
PLACES = "key long, more int, doc_id long, pos int, marks array<long>"
KEPT = "doc_id long, text string, n_words long, n_removed long, carried string"
_BUFFER = 2_000_000


def first_places(keys: list[np.ndarray], doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by key and place without repetitions, and which of them come after another place of their key."""
    order = np.lexsort((pos, doc, *keys[::-1]))
    same_key = np.ones(len(order), bool)
    for key in keys:
        key = key[order]
        same_key[1:] &= key[1:] == key[:-1]
    same_key[:1] = False
    doc, pos = doc[order], pos[order]
    again = same_key.copy()
    again[1:] &= (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
    order, same_key = order[~again], same_key[~again]
    return order, same_key


def spread(doc: np.ndarray) -> np.ndarray:
    """A key for rows that need no partner, so that they are dealt out evenly."""
    return words.mixed(doc.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)


def by_document(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The different documents and the values of each as a list."""
    order = np.argsort(doc, kind="stable")
    docs, first = np.unique(doc[order], return_index=True)
    bounds = np.append(first, len(doc)).astype(np.int32)
    return docs, pa.ListArray.from_arrays(pa.array(bounds), pa.array(values[order]))


def anchors(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    length, held, size = window - PERIOD + 1, [], 0
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def flush() -> pa.RecordBatch:
        key, doc, pos = (np.concatenate(column) for column in zip(*held, strict=True))
        order, later = first_places([key], doc, pos)
        key, doc, pos = key[order], doc[order], pos[order]
        # Of a key met twice here, all places are known; the first of them still stands for this task.
        known = later.copy()
        known[:-1] |= later[1:]
        first = ~later
        docs, hits = by_document(doc[known], pos[known].astype(np.int32))
        none = pa.nulls(int(first.sum()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([key[first].view(np.int64), spread(docs)])),
                pa.array(np.concatenate([doc[first], docs])),
                pa.array(np.concatenate([pos[first], np.full(len(docs), -1)]).astype(np.int32)),
                pa.concat_arrays([none, hits]),
            ],
            names=["key", "doc_id", "pos", "hits"],
        )

    for part in unpacked(batches):
        data, offsets = words.raw(part.column(part.schema.get_field_index("text")))
        found = words.Words(data, offsets)
        if not len(found):
            continue
        pos = found.position()
        at = np.flatnonzero(found.fits(length) & in_cover[pos % PERIOD])
        doc = words.ids(part)[found.text_of_word()[at]]
        held.append((found.runs(found.hashes(), length)[at], doc, pos[at]))
        size += len(at)
        if size >= _BUFFER:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def sequences(found: words.Words, seed: int) -> np.ndarray:
    """64 bits for each text's sequence of words."""
    out = np.zeros(len(found.offsets) - 1, np.uint64)
    if len(found):
        held = np.flatnonzero(found.counts)
        place = words.mixed(found.position().astype(np.uint64) + np.uint64(seed << 40))
        out[held] = np.add.reduceat(words.mixed(found.hashes(seed) ^ place), found.first[held])
    return words.mixed(out + found.counts.astype(np.uint64))


def packed(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each row with its word sequence as 128 bits; compressed texts, but for later copies of a row met before."""
    packer = zstandard.ZstdCompressor(level=1)
    for part, data, offsets in words.pieces(batches, "text"):
        found = words.Words(data, offsets)
        doc, one, two = words.ids(part), sequences(found, 1), sequences(found, 2)
        order = np.lexsort((doc, two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        group = np.concatenate([[0], np.cumsum(~same)])
        least = doc[order][np.flatnonzero(np.concatenate([[True], ~same]))][group]
        copy = np.zeros(len(doc), bool)
        copy[order] = doc[order] > least
        copy &= found.counts >= window
        data = data.tobytes()
        texts = [None if c else packer.compress(data[a:b]) for a, b, c in zip(offsets, offsets[1:], copy, strict=False)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.where(copy, spread(doc), one.view(np.int64))),
                pa.array(two.view(np.int64)),
                pa.array(doc),
                pa.array(texts, pa.binary()),
                pa.array(found.counts.astype(np.int64)),
                pa.array(copy),
                part.column(part.schema.get_field_index("carried")),
            ],
            names=["one", "two", "doc_id", "text", "n_words", "copy", "carried"],
        )


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, with their texts as they were."""
    opener = zstandard.ZstdDecompressor()

    def piece(rows: list[tuple[pa.RecordBatch, bytes]]) -> pa.RecordBatch:
        whole = pa.Table.from_batches([row for row, _ in rows]).combine_chunks().to_batches()[0]
        at = whole.schema.get_field_index("text")
        return whole.set_column(at, "text", pa.array([text for _, text in rows], pa.binary()))

    for batch in batches:
        rows, size = [], 0
        for i, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
            text = opener.decompress(text.as_py())
            rows.append((batch.slice(i, 1), text))
            size += len(text)
            if size >= words.PIECE_BYTES:
                yield piece(rows)
                rows, size = [], 0
        if rows:
            yield piece(rows)


def window_keys(found: words.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    return found.runs(found.hashes(1), window), found.runs(found.hashes(2), window)


def marked(key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A window that goes: its place, and low bits of its key, since rows of the same id may differ."""
    return (pos.astype(np.int64) << 32) | (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def places(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows that hold a repeated anchor whole, each task's first place of each and the later ones as known."""
    for batch in unpacked(batches):
        data, offsets = words.raw(batch.column(batch.schema.get_field_index("text")))
        found = words.Words(data, offsets)
        hits = batch.column(batch.schema.get_field_index("hits"))
        lengths = pa.compute.list_value_length(hits).to_numpy(zero_copy_only=False)
        at = np.repeat(found.first[:-1], lengths) + hits.flatten().to_numpy(zero_copy_only=False)
        # A row of the same id may be longer than this one.
        at = at[at < np.repeat(found.first[1:], lengths)]
        edge = np.zeros(len(found) + PERIOD + 1, np.int64)
        np.add.at(edge, np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(edge, at + 1, -1)
        near = np.flatnonzero((np.cumsum(edge)[: len(found)] > 0) & found.fits(window))
        if not len(near):
            continue
        key, more = (hashes[near] for hashes in window_keys(found, window))
        doc, pos = words.ids(batch)[found.text_of_word()[near]], found.position()[near]
        order, later = first_places([key, more], doc, pos)
        key, more, doc, pos = key[order], more[order], doc[order], pos[order]
        docs, marks = by_document(doc[later], marked(key, pos)[later])
        first = ~later
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([key[first].view(np.int64), spread(docs)])),
                pa.array(np.concatenate([(more[first] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.zeros(len(docs), np.int32)])),
                pa.array(np.concatenate([doc[first], docs])),
                pa.array(np.concatenate([pos[first], np.full(len(docs), -1)]).astype(np.int32)),
                pa.concat_arrays([pa.nulls(int(first.sum()), pa.list_(pa.int64())), marks]),
            ],
            names=["key", "more", "doc_id", "pos", "marks"],
        )


def without(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """What is left of the documents once the words of the marked windows are gone."""
    for batch in unpacked(batches):
        data, offsets = words.raw(batch.column(batch.schema.get_field_index("text")))
        found = words.Words(data, offsets)
        marks = batch.column(batch.schema.get_field_index("marks"))
        lengths = pa.compute.list_value_length(pa.compute.fill_null(marks, [])).to_numpy(zero_copy_only=False)
        packed = pa.compute.fill_null(marks, []).flatten().to_numpy(zero_copy_only=False)
        at = np.repeat(found.first[:-1], lengths) + (packed >> 32)
        low = (packed & 0xFFFFFFFF).astype(np.uint64)
        own = at < np.repeat(found.first[1:], lengths)
        at, low = at[own], low[own]
        key = found.runs(found.hashes(1), window)
        at = at[(key[at] & np.uint64(0xFFFFFFFF)) == low]
        edge = np.zeros(len(found) + window + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge)[: len(found)] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("doc_id")),
                pa.array([text.decode() for text in found.joined(~gone)], pa.string()),
                pa.array(found.counts.astype(np.int64)),
                pa.array(removed[found.first[1:]] - removed[found.first[:-1]]),
                batch.column(batch.schema.get_field_index("carried")),
            ],
            names=["doc_id", "text", "n_words", "n_removed", "carried"],
        )


def remove_repeats(docs: DataFrame, stage: Stage | None = None, window: int = WINDOW, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text (what is left, joined by single spaces), n_words, n_removed; a row for each row of ``docs``.

    ``carry`` names columns that JSON can hold, which are handed on with each row.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    stage = stage or Stage(docs.sparkSession)
    columns = [F.col(f"`{name}`") for name in carry]
    carried = F.to_json(F.struct(*columns)) if carry else F.lit(None).cast("string")
    kinds = docs.select(*columns).schema
    docs = docs.select("doc_id", "text", carried.alias("carried"))

    rows = docs.mapInArrow(lambda batches: packed(batches, window), PACKED)
    least = F.min(F.when(~F.col("copy"), F.col("doc_id"))).over(Window.partitionBy("one", "two"))
    copy = F.col("copy") | ((F.col("doc_id") > F.col("least")) & (F.col("n_words") >= window))
    rows = rows.withColumn("least", least).withColumn("copy", copy).drop("one", "two", "least")
    rows = stage.save(rows.withColumn("text", F.when(~F.col("copy"), F.col("text"))), "packed")
    texts = rows.filter("not copy").select("doc_id", "text", "carried")

    found = texts.select("doc_id", "text").mapInArrow(lambda batches: anchors(batches, window), ANCHORS)
    n = F.count(F.when(F.col("hits").isNull(), 1)).over(Window.partitionBy("key"))
    repeated = found.withColumn("n", n).filter("hits is not null or n > 1")
    hits = F.array_distinct(F.flatten(F.collect_list(F.coalesce("hits", F.array("pos")))))
    hits = stage.save(repeated.groupBy("doc_id").agg(hits.alias("hits")), "hits")
    near = stage.save(texts.select("doc_id", "text").join(hits, "doc_id"), "near")

    met = near.mapInArrow(lambda batches: places(batches, window), PLACES)
    place = F.struct("doc_id", "pos")
    first = F.min(F.when(F.col("marks").isNull(), place)).over(Window.partitionBy("key", "more"))
    going = met.withColumn("first", first).filter(F.col("marks").isNotNull() | (place > F.col("first")))
    mark = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))
    marks = F.flatten(F.collect_list(F.coalesce("marks", F.array(mark))))
    marks = stage.save(going.groupBy("doc_id").agg(marks.alias("marks")), "marks")

    rest = texts.join(marks, "doc_id", "left").mapInArrow(lambda batches: without(batches, window), KEPT)
    copies = rows.filter("copy").select("doc_id", F.lit("").alias("text"), "n_words", F.col("n_words").alias("n_removed"), "carried")
    own = F.from_json("carried", kinds) if carry else None
    return rest.unionByName(copies).select(
        tables.given_id().alias("doc_id"), "text", "n_words", "n_removed", *(own[name].alias(name) for name in carry)
    )


def op6_substring_dedup(spark, folder: str) -> DataFrame:
    kept = remove_repeats(tables.table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
