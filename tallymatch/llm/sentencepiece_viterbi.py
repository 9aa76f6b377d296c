"""SentencePiece encoding and decoding with a streaming Viterbi search.

The pieces and scores of a public model file are used as a unigram vocabulary: of all ways to cut a text into pieces the one
with the greatest sum of scores is taken; of equal ones, the one whose last piece is longest, and so on towards the
front. A character that is no piece by itself may stand alone at ``UNKNOWN`` below the least score and becomes its UTF-8
bytes. As in the model's own normaliser, one blank is put before a text and blanks are written as U+2581; a U+2581 of the
text itself becomes its bytes, so that decoding gives back every text exactly.

*Streaming.* A piece is at most as long as the longest one in the vocabulary, so a position can only be reached from a window
of that length, and only the positions in the window can still be part of the best path. From time to time the
paths back from all of them are followed until they meet: what lies before the meeting point is settled, its ids are given out
and forgotten. So a text of any length without a blank is encoded with a window of state.

*Words.* Where no piece reaches from another character over to a blank, all paths meet before a blank. Texts are cut there.
Short parts are searched side by side, one step of all of them at a time, by hashes of all pieces; their ids are
remembered, up to a bound.

Null text: null ids and null text back. Empty text: no ids. Rows are treated one by one, repeated rows and null ids alike; an
empty table gives an empty result; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymatch.llm import tables, words

BLANK = "▁"
#: Stands for a U+2581 of the text while it is cut: no character, so never a piece.
OWN_BLANK = "\udfff"
UNKNOWN = 10.0
NEVER = float("-inf")
REMEMBERED = 400_000
SETTLE = 4
#: Parts of up to so many characters are searched together, so many characters at a time.
SHORT = 64
TOGETHER = 100_000
FACTOR = np.uint64(0xD6E8FEB86659FD93)


class Vocabulary(dict):
    """The pieces of a model; as a dict, the ids of short parts that were met before."""

    def __init__(self, model: str):
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [
            k
            for k in range(loaded.get_piece_size())
            if not (loaded.is_byte(k) or loaded.is_control(k) or loaded.is_unknown(k) or loaded.is_unused(k))
        ]
        self.ids = {loaded.id_to_piece(k): k for k in plain}
        self.scores = {piece: loaded.get_score(k) for piece, k in self.ids.items()}
        self.bytes = [loaded.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(loaded.is_byte(k) for k in self.bytes):
            raise ValueError("the model has no byte fallback")
        #: Every beginning of a piece, with its score if it is a piece itself.
        self.beginnings = {piece[:n]: None for piece in self.ids for n in range(1, len(piece))} | self.scores
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values()) - UNKNOWN
        #: Hashes of the pieces of each length, sorted, with their ids and scores.
        self.by_length = {}
        for length in range(1, self.longest + 1):
            own = [piece for piece in self.ids if len(piece) == length]
            codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), length).astype(np.uint64)
            keys = np.zeros(len(own), np.uint64)
            for k in range(length):
                keys = keys * FACTOR + words.mixed(codes[:, k] + np.uint64(1))
            order = np.argsort(keys)
            ids = np.array([self.ids[piece] for piece in own], np.int32)
            scores = np.array([self.scores[piece] for piece in own], float)
            # No piece of a length: a key that is met by chance only, with a score that never wins.
            self.by_length[length] = (keys[order], ids[order], scores[order]) if own else (
                np.zeros(1, np.uint64), np.full(1, -1, np.int32), np.full(1, NEVER)
            )
        self.pieces: list[bytes | None] = [None] * loaded.get_piece_size()
        for piece, k in self.ids.items():
            self.pieces[k] = piece.replace(BLANK, " ").encode()
        for b, k in enumerate(self.bytes):
            self.pieces[k] = bytes([b])
        #: Whether no piece holds another character and then a blank. If one does, the whole text is one part.
        self.cuts_before_blanks = not any(re.search(f"[^{BLANK}]{BLANK}", piece) for piece in self.ids)
        self.parts = re.compile(f"{BLANK}+[^{BLANK}]*" if self.cuts_before_blanks else ".+", re.DOTALL)

    def pieces_of(self, text: str) -> Iterator[str]:
        """The best cut of a text, given out as far as it is settled."""
        score_of, longest, length = self.beginnings.get, self.longest, len(text)
        settle = SETTLE * longest
        # For each position from ``base`` on: the best sum up to it and where its last piece begins.
        base, best, back = 0, [0.0] + [NEVER] * longest, [0] * (longest + 1)
        for start in range(length):
            at = start - base
            here = best[at]
            best.append(NEVER)
            back.append(0)
            if here > NEVER:
                if text[start] not in self.scores and here + self.unknown > best[at + 1]:
                    best[at + 1], back[at + 1] = here + self.unknown, start
                for end in range(start + 1, min(length, start + longest) + 1):
                    score = score_of(text[start:end], NEVER)
                    if score is None:
                        continue
                    if score == NEVER:
                        break
                    at = end - base
                    if here + score > best[at]:
                        best[at], back[at] = here + score, start
            if start - base >= settle:
                meet = self._meeting(best, back, base, start + 1)
                if meet > base:
                    yield from self._path(text, back, base, meet)
                    best, back, base = best[meet - base :], back[meet - base :], meet
        yield from self._path(text, back, base, length)

    @staticmethod
    def _meeting(best: list, back: list, base: int, next_: int) -> int:
        """Where the paths back from all positions that later pieces can start at, or that are reached already, meet."""
        live = {at for at in range(next_, base + len(best)) if best[at - base] > NEVER}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(max(back[last - base], base))
        (at,) = live
        return base if at >= next_ else at

    @staticmethod
    def _path(text: str, back: list, base: int, end: int) -> list[str]:
        out = []
        while end > base:
            out.append(text[back[end - base] : end])
            end = back[end - base]
        return out[::-1]

    def encode_part(self, part: str) -> bytes:
        out: list[int] = []
        for piece in self.pieces_of(part):
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            else:
                out += [self.bytes[b] for b in piece.replace(OWN_BLANK, BLANK).encode("utf-8")]
        return pack_ids(f"<{len(out)}I", *out)

    def __missing__(self, part: str) -> bytes:
        return self.encode_part(part)

    def learn(self, parts: Iterable[str]) -> None:
        """Remember the ids of short parts, searched side by side."""
        if len(self) >= REMEMBERED:
            self.clear()
        parts = sorted((part for part in parts if 0 < len(part) <= SHORT), key=len, reverse=True)
        at = 0
        while at < len(parts):
            some = parts[at : at + max(1, TOGETHER // len(parts[at]))]
            self.update(zip(some, self.encode_parts(some), strict=True))
            at += len(some)

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """The same as ``encode_part`` for parts in order of falling length: one step of all of them at a time."""
        flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes, total = words.mixed(flat.astype(np.uint64) + np.uint64(1)), len(flat)
        lengths = np.array([len(part) for part in parts])
        start = np.cumsum(lengths) - lengths
        left = np.repeat(start + lengths, lengths) - np.arange(total)
        most = min(self.longest, int(lengths[0]))
        # For each length and place the score and the id of the piece that begins there.
        score, ident = np.full((most + 1, total), NEVER), np.full((most + 1, total), -1, np.int32)
        hashes = np.zeros(total, np.uint64)
        for length in range(1, most + 1):
            hashes[: total - length + 1] = hashes[: total - length + 1] * FACTOR + codes[length - 1 :]
            keys, ids, scores = self.by_length[length]
            place = np.flatnonzero(left >= length)
            near = np.minimum(np.searchsorted(keys, hashes[place]), len(keys) - 1)
            hit = keys[near] == hashes[place]
            score[length, place[hit]], ident[length, place[hit]] = scores[near[hit]], ids[near[hit]]
        score[1][ident[1] < 0] = self.unknown
        single = np.flatnonzero((ident[1] < 0) & (flat < 128))  # one byte, so one id
        ident[1, single] = np.array(self.bytes, np.int32)[flat[single]]
        best, back = np.full((int(lengths[0]) + 1, len(parts)), NEVER), np.zeros((int(lengths[0]) + 1, len(parts)), np.int8)
        best[0] = 0.0
        reach = np.searchsorted(-lengths, -np.arange(int(lengths[0]) + 1), "right")
        for end in range(1, int(lengths[0]) + 1):
            n = reach[end]
            for length in range(min(most, end), 0, -1):
                found = best[end - length, :n] + score[length, start[:n] + end - length]
                better = found > best[end, :n]
                np.copyto(best[end, :n], found, where=better)
                np.copyto(back[end, :n], length, where=better)
        at, row = lengths.copy(), np.arange(len(parts))
        rows, places, ids = [], [], []
        while len(row):
            length = back[at[row], row].astype(np.int64)
            at[row] -= length
            rows.append(row)
            places.append(at[row])
            ids.append(ident[length, start[row] + at[row]])
            row = row[at[row] > 0]
        rows, places, ids = (np.concatenate(x) for x in (rows, places, ids))
        order = np.lexsort((places, rows))
        bounds = 4 * np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(parts)))])
        whole = ids[order].astype("<u4").tobytes()
        out = [whole[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in np.unique(rows[ids < 0]).tolist():
            out[k] = self.encode_part(parts[k])  # with characters that are no pieces
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [self._split(text) for text in texts]
        self.learn(set().union(*split) - self.keys())
        return [b"".join(map(self.__getitem__, parts)) for parts in split]

    def _split(self, text: str) -> list[str]:
        """The parts of a text, blanks escaped; a part begins at the blanks before a word."""
        if not text:
            return []
        if BLANK in text:
            text = text.replace(BLANK, OWN_BLANK)
        if self.cuts_before_blanks and text[0] != " " and "  " not in text:
            return [BLANK + part for part in text.split(" ")]
        return self.parts.findall(BLANK + text.replace(" ", BLANK))

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text[1:].decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(model: str) -> Vocabulary:
    if model not in _LOADED:
        _LOADED[model] = Vocabulary(model)
    return _LOADED[model]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text, ids (binary); ``model`` is the place of a sentencepiece file on every executor."""

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for part, _, _ in words.pieces(batches, "text"):
            texts = part.column(part.schema.get_field_index("text"))
            given = texts.to_pylist()
            ids = own.encode_all([text or "" for text in given])
            ids = [None if text is None else found for text, found in zip(given, ids, strict=True)]
            doc_id = part.column(part.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([doc_id, texts, pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(encoded, "doc_id long, text string, ids binary")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """The rows with ``ids`` and, as ``decoded``, their text."""

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for part, _, _ in words.pieces(batches, "ids", 4 * words.PIECE_BYTES):
            ids = part.column(part.schema.get_field_index("ids")).to_pylist()
            texts = [None if x is None else own.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return coded.mapInArrow(decoded, T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())]))


def op7_sentencepiece(spark, folder: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    there_and_back = decode(encode(tables.table(spark, folder, "documents"), model), model)
    return there_and_back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("same"),
    )
