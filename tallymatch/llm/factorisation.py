"""Quality as a factorisation machine over hashed words, structure and metadata.

The score of a text with feature values x is ``w0 + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j``, where every feature has a
weight and a vector of ``RANK`` numbers. The sum over pairs is half of ``|sum v_i x_i|^2 - sum |v_i x_i|^2``, so a text costs as
many steps as it has features, not pairs. The logistic function of it is the probability of label 1.

Features of a whole text: its words, lower-cased (A to Z), in ``WORDS`` buckets by a hash, log2(1 + n) for n occurrences, scaled so
that all words together have length 1; statistics of its structure (``STATISTICS``: lengths of words and lines, shares of letters,
capitals, digits, marks and non-ASCII bytes, repeated words and lines), and as metadata its ``n_chars``, each of these in one of ``BINS``
steps, a feature of value 1. Labels, languages, sources and ids are not among them.

The machine is fitted on ``SAMPLE`` labelled rows at most, chosen by the hash of their ids out of those that are not held out, an
equal share for each label, with weights that make up for the choice. Their features are made by all tasks; one task then
fits the machine, by steps of adaptive size on batches of ``BATCH`` rows. That task holds the sample's features: no text, and
a row has fewer than ``WORDS`` + 1,000 of them. The fitted machine has a fixed size and goes to every task.

Null text: no words, so the score of an empty text; null ``n_chars``, or no such column: a step of its own. Null labels and ids
are not fitted on; of rows with the same id one is (the one of least hash), once for each of its labels. A label above 0 counts as 1. Where the rows to learn from
are all of one label, or none, the score is 0.5 for all. Rows are scored one by one, repeated rows and null ids alike (null
ids: not held out). Texts are taken whole, in pieces of a megabyte (a longer text alone). An empty table gives an empty result;
columns other than ``doc_id``, ``text`` and ``n_chars`` are not looked at.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymatch.llm import tables, words
from tallymatch.llm.suffix_tree import LOWER
from tallymatch.plans.staging import Stage

SAMPLE = 12_000
WORDS = 1 << 16
BINS = 24
RANK = 8
PASSES = 8
BATCH = 256
STEP = 0.1
PENALTY = 1e-5
GOOD = 0.7

#: Fixed order of the statistics; each has ``BINS`` features after those of the words, metadata the last ``BINS``.
STATISTICS = (
    "word_length",
    "longest_word",
    "n_words",
    "line_words",
    "different_words",
    "repeated_lines",
    "letters",
    "capitals",
    "digits",
    "sentence_marks",
    "other_marks",
    "non_ascii",
    "words_with_marks",
    "one_letter_words",
)
FEATURES = WORDS + BINS * (len(STATISTICS) + 1)

LETTERS, CAPITALS, DIGITS, SENTENCE, NON_ASCII = (np.zeros(256, bool) for _ in range(5))
LETTERS[[*range(65, 91), *range(97, 123)]] = True
CAPITALS[65:91] = True
DIGITS[48:58] = True
SENTENCE[[*b".,;:'\"!?-()"]] = True
NON_ASCII[128:] = True
OTHER = ~(LETTERS | DIGITS | SENTENCE | NON_ASCII | words.WHITE)
LINE = np.zeros(256, bool)
LINE[10] = True


def held_out(name: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(name).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    reach = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(reach[offsets]).astype(float)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _in_log(values: np.ndarray, steps_per_doubling: int = 2) -> np.ndarray:
    return np.minimum(np.log2(1 + values) * steps_per_doubling, BINS - 2).astype(np.int64)


def _in_share(values: np.ndarray) -> np.ndarray:
    """Finer steps for small shares."""
    return np.minimum(np.sqrt(np.clip(values, 0, 1)) * (BINS - 2), BINS - 2).astype(np.int64)


def _grouped(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text and key once, in order, with its number."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])[: len(key)])
    return text[first], key[first], np.diff(np.append(first, len(key)))


def features(data: np.ndarray, offsets: np.ndarray, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and value of each feature, in order of the texts; no feature of a text comes twice."""
    n = len(offsets) - 1
    found = words.Words(LOWER[data], offsets)
    own = found.text_of_word()
    text, key, count = _grouped(own, (found.hashes() % np.uint64(WORDS)).astype(np.int64))
    value = np.log2(1.0 + count)
    length = np.sqrt(np.bincount(text, value**2, n))
    value = value / np.maximum(length, 1e-9)[text]

    size = (found.ends - found.starts).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, own, size)
    different = _grouped(own, found.hashes().view(np.int64))[0]
    lines = words.Words(data, offsets, LINE)
    in_line = lines.text_of_word()
    different_lines = _grouped(in_line, lines.hashes().view(np.int64))[0]
    n_words, n_lines, n_bytes = found.counts.astype(float), lines.counts.astype(float), np.diff(offsets).astype(float)
    visible = n_bytes - _sums(words.WHITE[data], offsets)
    letters = _sums(LETTERS[data], offsets)
    marks = np.concatenate([[0], np.cumsum(OTHER[data])])
    marked = np.bincount(own, marks[found.ends] > marks[found.starts], n) if len(own) else np.zeros(n)
    statistics = [
        _in_log(_share(visible, n_words), 4),
        _in_log(longest),
        _in_log(n_words, 1),
        _in_log(_share(n_words, n_lines)),
        _in_share(_share(np.bincount(different, minlength=n), n_words)),
        _in_share(1 - _share(np.bincount(different_lines, minlength=n), n_lines)),
        _in_share(_share(letters, visible)),
        _in_share(_share(_sums(CAPITALS[data], offsets), letters)),
        _in_share(_share(_sums(DIGITS[data], offsets), visible)),
        _in_share(_share(_sums(SENTENCE[data], offsets), visible)),
        _in_share(_share(_sums(OTHER[data], offsets), visible)),
        _in_share(_share(_sums(NON_ASCII[data], offsets), visible)),
        _in_share(_share(marked, n_words)),
        _in_share(_share(np.bincount(own[size == 1], minlength=n), n_words)),
    ]
    known = np.array([-1.0 if c is None else max(c, 0) for c in n_chars])
    statistics.append(np.where(known < 0, BINS - 1, _in_log(np.maximum(known, 0), 1)))
    place = np.stack(statistics, 1) + WORDS + BINS * np.arange(len(statistics))
    all_text = np.concatenate([text, np.repeat(np.arange(n), place.shape[1])])
    all_place, all_value = np.concatenate([key, place.reshape(-1)]), np.concatenate([value, np.ones(place.size)])
    order = np.argsort(all_text, kind="stable")
    return all_text[order], all_place[order], all_value[order]


@dataclass
class Machine:
    """Bias, weights, and a vector for each feature."""

    bias: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{field.name: getattr(self, field.name) for field in fields(self)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, whole: bytes) -> Machine:
        with np.load(io.BytesIO(whole)) as arrays:
            return cls(**{field.name: arrays[field.name] for field in fields(cls)})

    def raw(self, text: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """The sum for each text, before the logistic function. Every text has a feature, and features stand in order of texts."""
        if not n:
            return np.zeros(0)
        first = np.searchsorted(text, np.arange(n))
        part = self.vectors[place] * value[:, None]
        total = np.add.reduceat(part, first, axis=0)
        squares = np.add.reduceat((part * part).sum(1), first)
        linear = np.add.reduceat(self.weights[place] * value, first)
        return self.bias[0] + linear + 0.5 * ((total * total).sum(1) - squares)


def fit_rows(
    first: np.ndarray, place: np.ndarray, value: np.ndarray, label: np.ndarray, weight: np.ndarray, n_features: int = FEATURES
) -> Machine:
    """The machine for rows with features from ``first[k]`` to ``first[k + 1]``, by batches in an order of fixed seed."""
    rng = np.random.default_rng(13)
    n = len(label)
    share = np.average(label, weights=weight)
    if not 0 < share < 1:
        return Machine(np.zeros(1), np.zeros(n_features), np.zeros((n_features, RANK)))
    bias, bias_square = np.log(share / (1 - share)), 1e-6
    weights, weights_square = np.zeros(n_features), np.full(n_features, 1e-6)
    vectors, vectors_square = rng.normal(0, 0.02, (n_features, RANK)), np.full((n_features, RANK), 1e-6)
    met = np.zeros(n_features, bool)
    met[place] = True
    vectors[~met] = 0
    weight = weight / weight.mean()
    for _ in range(PASSES):
        order = rng.permutation(n)
        for start in range(0, n, BATCH):
            rows = order[start : start + BATCH]
            lengths = first[rows + 1] - first[rows]
            begin = np.concatenate([[0], np.cumsum(lengths)])
            at = np.repeat(first[rows] - begin[:-1], lengths) + np.arange(begin[-1])
            x, (own, places) = value[at], np.unique(place[at], return_inverse=True)
            row = np.repeat(np.arange(len(rows)), lengths)
            part = vectors[own][places] * x[:, None]
            total = np.add.reduceat(part, begin[:-1], axis=0)
            squares = np.add.reduceat((part * part).sum(1), begin[:-1])
            raw = bias + np.add.reduceat(weights[own][places] * x, begin[:-1]) + 0.5 * ((total * total).sum(1) - squares)
            slope = weight[rows] * (logistic(raw) - label[rows]) / len(rows)
            each = slope[row] * x
            for_weights = np.bincount(places, each, len(own)) + PENALTY * weights[own]
            pulled = each[:, None] * (total[row] - part)
            for_vectors = np.stack([np.bincount(places, pulled[:, k], len(own)) for k in range(RANK)], 1) + PENALTY * vectors[own]
            weights_square[own] += for_weights**2
            weights[own] -= STEP * for_weights / np.sqrt(weights_square[own])
            vectors_square[own] += for_vectors**2
            vectors[own] -= 0.25 * STEP * for_vectors / np.sqrt(vectors_square[own])
            bias_square += slope.sum() ** 2
            bias -= STEP * slope.sum() / np.sqrt(bias_square)
    return Machine(np.array([bias]), weights, vectors)


def _of(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def _described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in words.pieces(batches, "text"):
        text, place, value = features(data, offsets, _of(part, "n_chars").to_pylist())
        bounds = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
        columns = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (place.astype(np.int32), value)]
        yield pa.RecordBatch.from_arrays([_of(part, "labels"), *columns], names=["labels", "places", "values"])


def _fitted(batches: Iterable[pa.RecordBatch], weights: dict[int, float]) -> Iterator[pa.RecordBatch]:
    first, places, values, labels = [np.zeros(1, np.int64)], [], [], []
    for batch in batches:
        own, lists = _of(batch, "labels"), _of(batch, "places")
        place, value = lists.flatten().to_numpy(), _of(batch, "values").flatten().to_numpy()
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        for k, given in enumerate(own.to_pylist()):
            for label in given:
                part = slice(bounds[k], bounds[k + 1])
                first.append(first[-1] + (part.stop - part.start))
                places.append(place[part])
                values.append(value[part])
                labels.append(label)
    if labels:
        label = np.array(labels, float)
        weight = np.array([weights[k] for k in labels])
        machine = fit_rows(np.concatenate([x.reshape(-1) for x in first]), np.concatenate(places), np.concatenate(values), label, weight)
        yield pa.RecordBatch.from_arrays([pa.array([machine.packed()], pa.binary())], names=["machine"])


def _narrow(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), n_chars.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, stage: Stage | None = None) -> Machine:
    """``labels``: doc_id and label. Held-out rows among them are not looked at."""
    stage = stage or Stage(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("label") > 0).cast("int").alias("label"))
    labels = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    kinds = {r.label: r.n for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = labels.limit(0)
    for kind in sorted(kinds):
        own = labels.filter(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // len(kinds))
        chosen = chosen.unionByName(own)
    # ``most`` labels at most: small enough for every task. Of rows with the same id one is taken.
    chosen = chosen.groupBy("doc_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    own = _narrow(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min_by(F.struct("labels", "text", "n_chars"), F.struct(F.xxhash64("text"), "n_chars")).alias("own")
    )
    sample = stage.save(own.select("own.*").mapInArrow(_described, "labels array<int>, places array<int>, values array<double>"), "sample")
    found = {r.label: r.n for r in sample.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = {kind: kinds[kind] / n for kind, n in found.items()}
    made = stage.save(sample.coalesce(1).mapInArrow(lambda batches: _fitted(batches, weights), "machine binary"), "machine").first()
    if made is None:
        return Machine(np.zeros(1), np.zeros(FEATURES), np.zeros((FEATURES, RANK)))
    return Machine.unpacked(bytes(made.machine))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted; a row for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in words.pieces(batches, "text"):
            found = features(data, offsets, _of(part, "n_chars").to_pylist())
            likely = logistic(sent.value.raw(*found, part.num_rows))
            columns = [_of(part, "doc_id"), _of(part, "held_out"), pa.array(likely), pa.array((likely >= GOOD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = _narrow(docs).withColumn("held_out", held_out())
    return rows.mapInArrow(judged, "doc_id long, held_out boolean, score double, predicted int")


def op13_factorisation(spark, folder: str) -> DataFrame:
    docs = tables.table(spark, folder, "documents")
    labels = tables.table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return score(docs, fit(docs, labels))
