"""Words of whole Arrow batches as numpy arrays: where they start and end, their hashes, hashes of runs of words.

A word is a run of characters other than space and the control characters 9 to 13. All of these are single bytes in
UTF-8 and never part of another character, so words are found in the bytes. Texts are taken in pieces of about a megabyte
(a longer text alone), so that what is held at once does not depend on the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
LEAST_ID = -(1 << 63)

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_POWERS = 1 << 16
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def mixed(values: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the input reaches every bit of the output."""
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    of_byte = mixed(np.arange(1, 257, dtype=np.uint64) + start)
    base = mixed(np.array([start], np.uint64)) | np.uint64(5)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(base, _POWERS - 1)]))
    more = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(mixed(base) | np.uint64(3), 4095)]))
    return of_byte, powers, more


_SEEDS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


class Words:
    """The words of some texts. ``first[d]`` to ``first[d + 1]`` are the words of text ``d``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE):
        self.data, self.offsets = data, offsets
        n = len(data)
        white = separators[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        if n:
            before, after = np.empty(n, bool), np.empty(n, bool)
            before[0], before[1:] = True, white[:-1]
            after[-1], after[:-1] = True, white[1:]
            self.starts = np.flatnonzero(~white & (before | cut[:n]))
            self.ends = np.flatnonzero(~white & (after | cut[1:])) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.white = white
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """64 bits for each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        return mixed(np.add.reduceat(self._terms(seed), self.starts - self.starts[0]))

    def beginnings(self, length: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The words of more than ``length`` bytes, and 64 bits for the first ``length`` bytes of each."""
        longer = np.flatnonzero(self.ends - self.starts > length)
        if not len(longer):
            return longer, np.zeros(0, np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self._terms(seed))])
        at = self.starts[longer] - self.starts[0]
        return longer, mixed((sums[at + length] - sums[at]) ^ np.uint64(length << 56))

    def _terms(self, seed: int) -> np.ndarray:
        """What each byte from the first word on adds to the hash of its word."""
        if seed not in _SEEDS:
            _SEEDS[seed] = _tables(seed)
        of_byte, powers, more = _SEEDS[seed]
        begin = self.starts[0]
        at = np.arange(begin, len(self.data))
        at -= np.repeat(self.starts, np.diff(np.append(self.starts, len(self.data))))
        values = of_byte[self.data[begin:]]
        values[self.white[begin:]] = 0
        if int((self.ends - self.starts).max()) > _POWERS:
            values *= more[(at // _POWERS) % len(more)]
            at %= _POWERS
        np.minimum(at, _POWERS - 1, out=at)  # white space after a word may reach further; it counts as 0
        values *= powers[at]
        return values

    def runs(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """For each word the hash of the ``length`` words that start there; not meant where ``fits`` is false."""
        total = np.zeros(len(hashes), np.uint64)
        factor = np.uint64(0xD6E8FEB86659FD93)
        for k in range(min(length, len(hashes))):
            total[: len(hashes) - k] += hashes[k:]
            total *= factor
        # The multiplications above weigh word k by factor ** (length - k), so the order of words counts.
        return mixed(total)

    def fits(self, length: int) -> np.ndarray:
        """Whether ``length`` words of the same text start at each word."""
        last = np.repeat(self.first[1:], self.counts)
        return np.arange(len(self.starts)) + length <= last

    def position(self) -> np.ndarray:
        """Of each word in its text, from 0."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """For each text its kept words, joined by one space."""
        lengths = np.where(keep, self.ends - self.starts + 1, 0)
        reach = np.concatenate([[0], np.cumsum(lengths)])
        total = int(reach[-1])
        source = np.repeat(self.starts - reach[:-1], lengths) + np.arange(total)
        out = np.append(self.data, np.uint8(32))[source]
        out[reach[1:][keep] - 1] = 32
        whole = out.tobytes()
        return [whole[a : max(a, b - 1)] for a, b in zip(reach[self.first[:-1]], reach[self.first[1:]], strict=True)]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of strings or binaries; null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = texts.cast(large)
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_large_binary(large) else "")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of one text column, each of about ``most`` bytes of text."""
    for batch in batches:
        data, offsets = raw(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            own = offsets[at : to + 1]
            yield batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0]
            at = to


def ids(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    """A column of longs; null as the smallest long."""
    column = batch.column(batch.schema.get_field_index(column)).cast(pa.int64())
    return pc.fill_null(column, LEAST_ID).to_numpy(zero_copy_only=False)
