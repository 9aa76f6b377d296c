"""Quality rules on what a public tokeniser makes of a text.

Texts that a vocabulary was not made for, or that are no prose at all, come out in many short pieces, in raw bytes, or in a
few pieces over and over. Measured per document over its whole text, words one by one: characters per token, tokens per
word, the share of byte-fallback tokens, the entropy of the token distribution in bits. ``BANDS`` holds what is accepted for
each language; a language that is not listed is judged by the script that most of its letters are in, and a text
without letters by the widest band. A lower bound on the entropy allows for the length of a text, since n tokens have at most
log2(n) bits; the bounds on tokens allow ``SPARE_SHARE`` more for each word, ``SPARE_TOKENS`` at most, and ``SPARE_BYTES`` raw bytes, for a few odd
words in a text, such as an address or a sign.

Before that the base rules: fewer than ``LEAST_WORDS`` words, or more than ``MOST_REPEATED`` percent of the words in
windows of ``WINDOW`` words that are found twice or more. Repeated windows are found by hash and compared word for word.

One pass, no shuffle, nothing remembered but a bounded number of words. Null text: no words, so rejected. Null or unknown
language: by script. Rows are judged one by one, repeated rows alike; an empty table gives an empty result; columns
other than ``doc_id``, ``text`` and ``lang`` are not looked at (``lang`` may be missing). A very long text is judged whole, with some 100
bytes for each of its own held at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.llm import tables, words

LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8
SPARE_TOKENS = 60
SPARE_SHARE = 0.5
SPARE_BYTES = 8
REMEMBERED = 400_000

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Least and most characters per token, most tokens per word, most byte-fallback share, least entropy share."""

    least_chars: float
    most_chars: float
    most_tokens: float
    most_bytes: float
    least_entropy: float


#: Accepted bands for prose in the 32,000-piece vocabulary, by language, then by script.
BANDS = {
    "en": Band(1.6, 8.0, 3.3, 0.05, 0.40),
    "de": Band(1.6, 8.0, 3.5, 0.05, 0.40),
    "fr": Band(1.5, 8.0, 3.5, 0.05, 0.40),
    "es": Band(1.5, 8.0, 3.6, 0.05, 0.40),
    "Latin": Band(1.3, 9.0, 4.5, 0.15, 0.35),
    "Greek": Band(0.8, 6.0, 12.0, 0.20, 0.30),
    "Cyrillic": Band(0.9, 6.0, 9.0, 0.20, 0.30),
    "Hebrew": Band(0.7, 6.0, 12.0, 0.30, 0.25),
    "Arabic": Band(0.7, 6.0, 12.0, 0.30, 0.25),
    "Devanagari": Band(0.4, 6.0, 30.0, 0.60, 0.25),
    "Han": Band(0.3, 4.0, 1e9, 0.90, 0.25),
    "Kana": Band(0.4, 4.0, 1e9, 0.80, 0.25),
    "Hangul": Band(0.3, 4.0, 30.0, 0.90, 0.25),
    "other": Band(0.2, 9.0, 1e9, 1.00, 0.20),
}

#: Where the letters of a script lie.
SCRIPTS = {
    "Latin": r"[A-Za-zÀ-ɏḀ-ỿ]",
    "Greek": r"[Ͱ-Ͽἀ-῿]",
    "Cyrillic": r"[Ѐ-ԯ]",
    "Hebrew": r"[֐-׿]",
    "Arabic": r"[؀-ۿݐ-ݿ]",
    "Devanagari": r"[ऀ-ॿ]",
    "Kana": r"[぀-ヿ]",
    "Hangul": r"[가-힯]",
    "Han": r"[㐀-䶿一-鿿]",
}
_SCRIPTS = {name: re.compile(letters) for name, letters in SCRIPTS.items()}

MEASURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_tokens long, chars_per_token double, tokens_per_word double, byte_share double, "
    "entropy double, band string, kept boolean"
)


def script_of(text: str) -> str:
    counts = {name: len(letters.findall(text)) for name, letters in _SCRIPTS.items()}
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] else "other"


class Pieces(dict):
    """The ids of a word, as bytes."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        if self.model.get_piece_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.is_byte = np.array([self.model.is_byte(k) for k in range(self.model.get_piece_size())])

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.model.encode(word), "<u2").tobytes()
        if len(word) < 100:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


_PIECES: dict[str, Pieces] = {}


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def repeated_words(own: list[str], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more."""
    n = len(own) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, own), np.int64, len(own)).view(np.uint64)
    runs = np.zeros(n, np.uint64)
    for k in range(window):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    runs = words.mixed(runs)
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    edge = np.zeros(len(own) + 1, np.int64)
    firsts: dict = {}
    pair = np.zeros(n, bool)
    pair[1:] |= same
    pair[:-1] |= same
    # Only windows whose hashes meet are compared as words.
    for at in np.sort(order[pair]).tolist():
        key = tuple(own[at : at + window])
        first = firsts.setdefault(key, at)
        if first != at:
            for start in (first, at):
                edge[start] += 1
                edge[start + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judged(n_words: int, n_tokens: int, chars: int, n_bytes: int, entropy: float, band: Band) -> bool:
    if not n_tokens:
        return False
    per_token, spare = chars / n_tokens, min(SPARE_TOKENS, SPARE_SHARE * n_words)
    return (
        band.least_chars * (n_tokens - spare) <= chars
        and per_token <= band.most_chars
        and n_tokens <= band.most_tokens * n_words + spare
        and n_bytes <= band.most_bytes * n_tokens + SPARE_BYTES
        and entropy >= band.least_entropy * min(np.log2(n_tokens), 10)
    )


def measured(batches: Iterable[pa.RecordBatch], model: str, bands: dict[str, Band]) -> Iterator[pa.RecordBatch]:
    if model not in _PIECES:
        _PIECES[model] = Pieces(model)
    pieces = _PIECES[model]
    names = [part.split()[0] for part in MEASURES.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[part.split()[1]] for part in MEASURES.split(", ")]
    for part, data, offsets in words.pieces(batches, "text"):
        column = {name: part.column(k).to_pylist() for k, name in enumerate(part.schema.names) if name != "text"}
        data = data.tobytes()
        rows = []
        for doc_id, lang, a, b in zip(column["doc_id"], column["lang"], offsets, offsets[1:], strict=False):
            text = data[a:b].decode()
            own = WORD.findall(text)
            chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
            repeated = repeated_words(own)
            failed = len(own) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(own)
            ids = np.frombuffer(b"".join(map(pieces.__getitem__, own)), "<u2")
            n, n_bytes, entropy = len(ids), 0, 0.0
            if n:
                n_bytes = int(pieces.is_byte[ids].sum())
                ordered = np.sort(ids)
                share = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))) / n
                entropy = float(-(share * np.log2(share)).sum()) + 0.0
            band = lang if lang in bands else script_of(text)
            kept = not failed and judged(len(own), n, chars, n_bytes, entropy, bands[band])
            rows.append((
                doc_id, len(own), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, failed, n,
                chars / n if n else None, n / len(own) if own else None, n_bytes / n if n else None,
                entropy, band, bool(kept),
            ))
        if rows:
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def measure(docs: DataFrame, model: str, bands: dict[str, Band] = BANDS) -> DataFrame:
    """The measures and the verdict of each row; ``model`` is the place of a sentencepiece file on every executor."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text"))
    return docs.mapInArrow(lambda batches: measured(batches, model, bands), MEASURES)


def accepted(docs: DataFrame, model: str, bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in words.pieces(batches, "text"):
            column = {name: part.column(k) for k, name in enumerate(part.schema.names)}
            none = pa.nulls(part.num_rows, pa.string())
            own = pa.RecordBatch.from_arrays(
                [pa.nulls(part.num_rows, pa.int64()), column.get("lang", none), column["text"]], names=["doc_id", "lang", "text"]
            )
            verdicts = [row.column(row.schema.get_field_index("kept")) for row in measured([own], model, bands)]
            if verdicts:
                yield part.filter(pa.concat_arrays(verdicts))

    return docs.mapInArrow(keep, docs.schema)


def op2_quality_rules(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return measure(tables.table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
