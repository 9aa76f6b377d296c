"""Toxicity as ordinal regression: expected severity from sparse text features.

A text has a severity grade 0, 1, ... The cumulative-link model holds one weight for each feature, shared by all grades, and
ordered thresholds: the probability of a grade of k or more is logistic(score - threshold k). The output is the expected
grade, which is the sum of these probabilities, the likeliest grade, and whether a grade of 1 or more is likelier than not.

Features are the words of a text, lower-cased, and their beginnings of ``BEGINNINGS`` bytes, where a word is a run of ASCII
letters and digits and any non-ASCII characters; a feature that occurs n times counts log2(1 + n). The model is fitted on a bounded sample of labelled rows, ``SAMPLE`` at most, as many of each label
as there are but no more than an equal share, chosen by the hash of the id; weights make up for the choice. Words and beginnings
are features if they are found in ``LEAST_ROWS`` rows of the sample or more and are unevenly spread over clean and toxic rows
(a z-score of ``LEAST_Z``); there are ``FEATURES`` of them at most, so the model is small and goes to every task.

Where labels only say toxic or not, toxic rows are graded 1 or 2 by how much they hold of features that mark toxic rows, each
by its z-score: up to the median, or above. Every text is scored whole.

Null text: no words, so the score is that of an empty text. Null labels are left out; where there are no rows of one
kind, nothing can be fitted and the severity is 0. A document labelled several times is used once for each label. Rows are
scored one by one, repeated rows and null ids alike; an empty table gives an empty result; columns other than ``doc_id``,
``text`` and the label are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.llm import tables, words
from tallymatch.llm.suffix_tree import LOWER
from tallymatch.plans.staging import Stage

SAMPLE = 12_000
LEAST_ROWS = 5
LEAST_Z = 4.0
FEATURES = 20_000
BEGINNINGS = (4, 5, 6, 7, 8)
STEPS = 200
PENALTY = 1e-4

SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Ordinal:
    """Sorted word keys, their weights, and the thresholds of grades 1, 2, ..."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """For each score the probabilities of a grade of 1 or more, 2 or more, ..."""
        return logistic(scores[:, None] - self.thresholds[None, :])


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of each occurrence of a feature."""
    found = words.Words(LOWER[data], offsets, SEPARATORS)
    texts, keys = [found.text_of_word()], [found.hashes()]
    for length in BEGINNINGS:
        longer, begin = found.beginnings(length)
        texts.append(texts[0][longer])
        keys.append(begin)
    return np.concatenate(texts), np.concatenate(keys)


def fit_ordinal(
    texts: np.ndarray, places: np.ndarray, values: np.ndarray, grades: np.ndarray, weights: np.ndarray, n_features: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the penalised likelihood, by Adam over the whole sample.

    ``texts`` and ``places`` are the rows and columns of the ``values`` in the matrix of features.
    """
    top = int(grades.max())
    share = np.array([(weights * (grades >= k)).sum() / weights.sum() for k in range(1, top + 1)])
    start = -np.log(share / (1 - share))
    gaps = np.maximum(np.diff(start), 0.1)
    # The thresholds are the first one and the logarithms of the steps between them, so they stay in order.
    fitted = np.concatenate([np.zeros(n_features), start[:1], np.log(gaps)])
    mean, square = np.zeros_like(fitted), np.zeros_like(fitted)
    share_of = weights / weights.sum()
    n = len(grades)
    for step in range(1, STEPS + 1):
        w, steps = fitted[:n_features], np.exp(fitted[n_features + 1 :])
        thresholds = fitted[n_features] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.bincount(texts, w[places] * values, n)
        up = logistic(score[:, None] - thresholds[None, :])
        edges = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], 1)
        own, above = edges[np.arange(n), grades], edges[np.arange(n), grades + 1]
        likely = np.maximum(own - above, 1e-12)
        slope_own, slope_above = own * (1 - own), above * (1 - above)
        by_score = -share_of * (slope_own - slope_above) / likely
        by_threshold = np.zeros((n, top + 2))
        by_threshold[np.arange(n), grades] += share_of * slope_own / likely
        by_threshold[np.arange(n), grades + 1] -= share_of * slope_above / likely
        for_thresholds = by_threshold[:, 1 : top + 1].sum(0)
        from_here = np.cumsum(for_thresholds[::-1])[::-1]
        gradient = np.concatenate([
            np.bincount(places, by_score[texts] * values, n_features) + PENALTY * w,
            from_here[:1],
            from_here[1:] * steps,
        ])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        rate = 0.1 * (1 - step / (STEPS + 1)) + 0.005
        fitted -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-10)
    return fitted[:n_features], fitted[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(fitted[n_features + 1 :]))])


def sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """label and text of the labelled rows that are fitted on, and the number of all rows of each label."""
    labels = labels.filter("label is not null and doc_id is not null")
    kinds = {r.label: r.n for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = labels.limit(0)
    for kind in sorted(kinds):
        own = labels.filter(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // len(kinds))
        chosen = chosen.unionByName(own)
    # ``most`` rows of an id and a label: small enough for every task.
    return docs.join(F.broadcast(chosen), "doc_id").select("label", "text"), kinds


def _by_text(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, key and count of each feature of each text, in order of the texts."""
    text, key = features(data, offsets)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])[: len(key)])
    return text[first], key[first], np.diff(np.append(first, len(key)))


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature the rows of a piece that have it, and the toxic ones among them."""
    for part, data, offsets in words.pieces(batches, "text"):
        toxic = part.column(part.schema.get_field_index("label")).to_numpy(zero_copy_only=False) > 0
        text, key, _ = _by_text(data, offsets)
        keys, place, n = np.unique(key, return_inverse=True, return_counts=True)
        in_toxic = np.bincount(place, toxic[text], len(keys)).astype(np.int64)
        columns = [pa.array(keys.view(np.int64)), pa.array(n), pa.array(in_toxic)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "n_toxic"])


def select(rows: DataFrame, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that are unevenly spread, in order, and their z-scores."""
    counts = rows.mapInArrow(counted, "key long, n long, n_toxic long").groupBy("key")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")).filter(F.col("n") >= LEAST_ROWS)
    both = F.col("n") / (n_toxic + n_clean)
    gap = F.col("n_toxic") / n_toxic - (F.col("n") - F.col("n_toxic")) / n_clean
    z = gap / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * (1 / n_toxic + 1 / n_clean))
    uneven = counts.select("key", z.alias("z")).filter(F.abs("z") >= LEAST_Z)
    found = uneven.orderBy(F.abs("z").desc(), "key").limit(FEATURES).collect()
    keys = np.array([r.key for r in found], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r.z for r in found])[order]


def matrix(rows: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The label of each row; row, place and value of each of its features that are among the keys."""

    def looked_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in words.pieces(batches, "text"):
            text, key, n = _by_text(data, offsets)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            bounds = pa.array(np.searchsorted(text[hit], np.arange(part.num_rows + 1)).astype(np.int32))
            columns = [pa.ListArray.from_arrays(bounds, pa.array(x[hit].astype(np.int64))) for x in (at, n)]
            label = part.column(part.schema.get_field_index("label"))
            yield pa.RecordBatch.from_arrays([label, *columns], names=["label", "places", "counts"])

    # Features are few in a text, and the rows of the sample are bounded.
    found = rows.mapInArrow(looked_up, "label int, places array<long>, counts array<long>").collect()
    texts = np.repeat(np.arange(len(found)), [len(r.places) for r in found])
    places = np.array([at for r in found for at in r.places], int)
    values = np.log2(1.0 + np.array([n for r in found for n in r.counts]))
    return np.array([r.label for r in found], int), texts, places, values


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, stage: Stage | None = None) -> Ordinal:
    """``labels``: doc_id and label, 0 for clean; with labels above 1 these are the grades."""
    chosen, kinds = sample(docs, labels, most)
    rows = (stage or Stage(docs.sparkSession)).save(chosen, "sample")
    found = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic = sum(n for label, n in found.items() if label > 0)
    n_clean = sum(found.values()) - n_toxic
    keys, z = select(rows, n_toxic, n_clean) if n_toxic and n_clean else (np.zeros(0, np.uint64), np.zeros(0))
    if not len(keys):
        return Ordinal(keys, z, np.array([np.inf]))
    label, texts, places, values = matrix(rows, keys)
    toxic, weights = label > 0, np.array([kinds[k] / found[k] for k in label.tolist()])
    grades = np.unique(label, return_inverse=True)[1]
    if grades.max() == 1:
        marks = np.bincount(texts, np.maximum(z[places], 0) * values, len(label))
        grades = np.where(toxic & (marks > np.median(marks[toxic])), 2, grades)
        if grades.max() == 2 and not (grades == 1).any():
            grades = np.minimum(grades, 1)
    fitted, thresholds = fit_ordinal(texts, places, values, grades, weights, len(keys))
    return Ordinal(keys, fitted, thresholds)


def severity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (the expected grade), grade (the likeliest), p_toxic, toxic; a row for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part, data, offsets in words.pieces(batches, "text"):
            score = np.zeros(part.num_rows)
            if len(own.keys):
                text, key = features(data, offsets)
                at = np.searchsorted(own.keys, key)
                at[at == len(own.keys)] = 0
                hit = own.keys[at] == key
                once, n = np.unique(text[hit] * len(own.keys) + at[hit], return_counts=True)
                each = own.weights[once % len(own.keys)] * np.log2(1.0 + n)
                score = np.bincount(once // len(own.keys), each, part.num_rows)
            up = own.at_least(score)
            exactly = np.diff(np.concatenate([np.ones((len(up), 1)), up, np.zeros((len(up), 1))], 1) * -1, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("doc_id")),
                    pa.array(up.sum(1)),
                    pa.array(exactly.argmax(1).astype(np.int32)),
                    pa.array(up[:, 0]),
                    pa.array(up[:, 0] >= 0.5),
                ],
                names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(judged, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def op5_toxicity(spark, folder: str) -> DataFrame:
    docs = tables.table(spark, folder, "documents")
    labels = tables.table(spark, folder, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return severity(docs, fit(docs.select("doc_id", "text"), labels))
