"""Packing of tokenised documents into sequences, best fit decreasing.

A document is tokenised and one end id is appended. While it is longer than a sequence, full sequences are cut off it; what
is left is one piece. Pieces are placed in order of falling length, each into the open sequence with the least room that
still takes it. A segment tree over the possible amounts of room (0 to the length of a sequence) finds that one in a few
steps, however many sequences are open.

Each task packs the documents of its own partition, in blocks of ``BLOCK_IDS`` ids, so nothing is shuffled, memory does not
depend on the data, and a task that is run again gives the same sequences. What a block leaves less than ``FULL`` full is
packed again with the next block; only the last sequences of a partition can stay partly empty. The ids of pieces are
kept as bytes (unsigned 32-bit, little-endian).

Tokenising works word by word: no id of this vocabulary reaches over a blank, so the ids of words are remembered, up to a
bound, and put together. Null text: empty, so just the end id. Each row of the table is a document, rows with the same or
a null id too. An empty table gives no pieces; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterable, Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.llm import tables, words

LENGTH = 2048
END_ID = 1
BLOCK_IDS = 8 << 20
FULL = 0.97
REMEMBERED = 400_000
#: Letters whose lower case is one letter each, and ASCII punctuation.
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(192, 215), *range(216, 247), *range(248, 256)]))
PLAIN = re.compile(f"[{LETTERS}]+")
MARKS = string.punctuation

PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


class Tokens(dict):
    """The ids of each blank-separated part of a text, as bytes.

    The vocabulary is in lower case and cuts between letters and punctuation, so the ids of a word with punctuation after it
    are those of the word in lower case and those of the punctuation. Such a word goes to the merges directly, its letters
    spelled as the byte-level alphabet has them; any other part goes through the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.merges = self.tokenizer.model.tokenize
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = str.maketrans({letter: spell(letter)[0][0] for letter in LETTERS})
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _encode(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = [token.id for token in self.merges(word if word.isascii() else word.translate(self.spelling))]
        return pack_ids(f"<{len(ids)}I", *ids)

    def __missing__(self, part: str) -> bytes:
        word = part.rstrip(MARKS)
        known, lower = self.words, word.lower()
        ids = known.get(lower)
        if ids is None:
            if not word.isalpha() or not (word.isascii() or PLAIN.fullmatch(word)):
                ids = self._encode(part)
                if len(part) < 100:
                    self[part] = ids
                return ids
            ids = self._word(lower)
            if len(word) < 100:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[lower] = ids
        if len(part) > len(word):
            mark = part[len(word) :]
            end = self.marks.get(mark)
            if end is None:
                end = self._encode(mark)
                if len(self.marks) < 1000 and len(mark) < 10:
                    self.marks[mark] = end
            ids += end
        if len(part) < 100:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = ids
        return ids

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_TOKENS: dict[str, Tokens] = {}


class Rooms:
    """Open sequences by the room they have. Node ``k`` of the tree tells whether any leaf below it has one."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = self.leaves + room
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The sequence with the least room of at least ``least``, and its room."""
        any_, at = self.any, self.leaves + least
        if not any_[at]:
            while at > 1 and (at & 1 or not any_[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if any_[2 * at] else 2 * at + 1
        room = at - self.leaves
        sequence = self.open[room].pop()
        if not self.open[room]:
            any_[at] = 0
            at >>= 1
            while at and not (any_[2 * at] or any_[2 * at + 1]):
                any_[at] = 0
                at >>= 1
        return room, sequence


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """The pieces of each sequence, as places in ``lengths``."""
    rooms, out = Rooms(most), []
    for piece in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        found = rooms.take(lengths[piece])
        if found is None:
            found = most, len(out)
            out.append([])
        room, sequence = found
        out[sequence].append(piece)
        if room > lengths[piece]:
            rooms.put(room - lengths[piece], sequence)
    return out


def cut(doc_id, ids: bytes, most: int) -> list[tuple]:
    total = len(ids) // 4
    return [(doc_id, start, ids[4 * start : 4 * (start + most)], total) for start in range(0, total, most)]


def packed(batches: Iterable[pa.RecordBatch], vocabulary: str, most: int, end: int, block: int) -> Iterator[pa.RecordBatch]:
    if vocabulary not in _TOKENS:
        _TOKENS[vocabulary] = Tokens(vocabulary)
    tokens = _TOKENS[vocabulary]
    last = np.array([end], "<u4").tobytes()
    number = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    size = 0

    def place(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size, number
        lengths = [len(piece[2]) // 4 for piece in held]
        again, rows = [], []
        for sequence in best_fit(lengths, most):
            if not final and sum(lengths[k] for k in sequence) < FULL * most:
                again += [held[k] for k in sequence]
                continue
            offset = 0
            for k in sequence:
                rows.append((*held[k], number, offset))
                offset += lengths[k]
            number += 1
        held, size = again, sum(len(piece[2]) // 4 for piece in again)
        for at in range(0, len(rows), 2000):
            doc, start, ids, total, sequence, offset = zip(*rows[at : at + 2000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(total, pa.int64()),
                    pa.array(sequence, pa.int64()),
                    pa.array(offset, pa.int64()),
                ],
                names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    for part, data, offsets in words.pieces(batches, "text"):
        data = data.tobytes()
        doc_ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
        for doc_id, a, b in zip(doc_ids, offsets, offsets[1:], strict=False):
            ids = tokens.of(data[a:b].decode()) + last
            held += cut(doc_id, ids, most)
            size += len(ids) // 4
            if size >= block:
                yield from place(False)
                # Were much left over, each document would pack it all again.
                if size > block // 2:
                    yield from place(True)
    if held:
        yield from place(True)


def pack(docs: DataFrame, vocabulary: str, most: int = LENGTH, end: int = END_ID, block: int = BLOCK_IDS) -> DataFrame:
    """doc_id, start, ids, doc_tokens, sequence_id, offset: a row for each piece.

    ``vocabulary`` is the place of a tokenizers file on every executor whose ids do not reach over blanks.
    """
    docs = tables.only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(lambda batches: packed(batches, vocabulary, most, end, block), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    length = (F.octet_length("ids") / 4).cast("long")
    return pieces.select(
        "doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op1_packing(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(tables.table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")))
