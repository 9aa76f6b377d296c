"""Against a plain suffix tree and plain counts; proper distributions; better than the base on held-out documents."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymatch.llm import suffix_tree, words

FOLDER = "/root/testdata/sf0.01"


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def string(text):
    return " ".join(tokens(text)).encode() + b"\n"


class Plain:
    """The same model, context by context, from its definition."""

    def __init__(self, texts, depth, least_share):
        self.depth = depth
        follow = defaultdict(Counter)
        total = 0
        for text in texts:
            padded = b"\n" * depth + string(text)
            for at in range(depth, len(padded)):
                total += 1
                for k in range(depth + 1):
                    follow[padded[at - k : at]][padded[at]] += 1
        least = max(2, math.ceil(total * least_share))
        candidates = {c: f for c, f in follow.items() if not c or f.total() >= least}
        alike = Counter(c[1:] for c in candidates if c)
        self.smooth = {}
        for c in sorted(candidates, key=len):
            f, n = candidates[c], candidates[c].total()
            if c:
                lower, back = self.smooth[c[1:]], 20 + 0.8 * len(f)
                self.smooth[c] = [(max(f[a] - 0.8, 0) + back * lower[a]) / (n + 20) for a in range(256)]
            else:
                self.smooth[c] = [(f[a] + len(f) / 256) / (n + len(f)) for a in range(256)]
        self.retained = {c for c in candidates if len(c) <= 3}
        for c, f in candidates.items():
            if len(c) > 3:
                lower, n = self.smooth[c[1:]], f.total()
                gain = sum(m * math.log(m / n / lower[a]) for a, m in f.items())
                if gain > 0.5 * len(f) * math.log(n) + math.log(alike[c[1:]]):
                    self.retained |= {c[k:] for k in range(len(c))}

    def score(self, text):
        padded, total = b"\n" * self.depth + string(text), 0.0
        for at in range(self.depth, len(padded)):
            context = next((c for k in range(self.depth, -1, -1) if (c := padded[at - k : at]) in self.retained), b"")
            total += math.log10(self.smooth.get(context, [1 / 256] * 256)[padded[at]])
        return total


def brute(rows, depth, least_share):
    train = [(i, t) for i, t in rows if not held_out(i)]
    counts = Counter(w for _, t in train for w in [*tokens(t), None])
    n = counts.total()
    model = Plain([t for _, t in train], depth, least_share)
    out = []
    for i, t in rows:
        own = [*tokens(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in own)
        out.append((i, held_out(i), len(own), sum(counts[w] > 0 for w in own), n, base, model.score(t)))
    return sorted(out, key=str)


def same(found, expected):
    names = "doc_id held_out n_tokens n_known train_tokens base_score score".split()
    found = sorted((tuple(r[n] for n in names) for r in found), key=str)
    assert len(found) == len(expected)
    for mine, theirs in zip(found, expected):
        assert mine[:5] == theirs[:5]
        assert mine[5:] == pytest.approx(theirs[5:], rel=2e-6, abs=1e-6)


@pytest.mark.parametrize("most", [3, 10**6])
def test_planted(documents, most):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["the", "The", "cat", "sat,", "öl", "on", "mat" * 3, "x\x1cy"], k=rng.randrange(40))) for _ in range(70)]
    texts += ["", None, " \n ", "unseen zebra é中", "a" * 700, texts[3], "the cat " * 400]
    rows = [*enumerate(texts), (3, texts[3]), (None, "the cat sat"), (None, None)]
    found = suffix_tree.score(documents(rows), depth=4, least_share=1e-3, most=most).collect()
    same(found, brute(rows, 4, 1e-3))


def test_nothing_to_learn_from(documents):
    held = [i for i in range(100) if held_out(i)][:2]
    rows = [(i, "a b") for i in held]
    same(suffix_tree.score(documents(rows)).collect(), brute(rows, suffix_tree.DEPTH, 1e-3))
    assert suffix_tree.score(documents(rows).limit(0)).count() == 0


def test_clashing_columns(documents):
    docs = documents(["a b c", "a b", "c"])
    clashing = docs.withColumns({n: F.lit("?") for n in ("key", "train", "row", "rare", "held_out", "score", "n", "a.b")})
    assert sorted(suffix_tree.score(clashing).collect()) == sorted(suffix_tree.score(docs).collect())


def test_proper_and_better(spark, monkeypatch):
    """The next-symbol probabilities of every state add up to 1, and held-out texts are likelier than under the base."""
    held, train = [], suffix_tree.train
    monkeypatch.setattr(suffix_tree, "train", lambda *args: held.append(train(*args)) or held[0])
    rows = suffix_tree.op4_lm_scoring(spark, FOLDER).filter("held_out").collect()
    (model,) = held
    probability = 10.0 ** model.cost.reshape(-1, model.width).astype(float)
    unseen = 256 - (model.width - 1)
    assert np.allclose(probability[:, :-1].sum(1) + unseen * probability[:, -1], 1, atol=1e-4)
    assert len(rows) > 50
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert np.mean([r.score > r.base_score for r in rows]) > 0.6


def test_runs():
    found = words.Words(*words.raw(pa.array(["Ab c", "", "d"])))
    stream, begin = suffix_tree.symbols(found, 2)
    assert bytes(stream) == b"\n\nab c\n\n\n\n\n\nd\n" and begin.tolist() == [0, 7, 10, 14]
    runs = suffix_tree.runs(stream, begin, 2)
    assert [int(r).to_bytes(3, "big") for r in runs] == [b"\n\na", b"\nab", b"ab ", b"b c", b" c\n", b"\n\n\n", b"\n\nd", b"\nd\n"]


def test_seven_bytes(documents):
    """What follows is told by the seventh byte back alone."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["abcdefgx", "zbcdefgy"]) for _ in range(30))) for i in range(60)]
    found = suffix_tree.score(documents(rows), least_share=1e-3).collect()
    same(found, brute(rows, 7, 1e-3))
    shorter = {r.doc_id: r.score for r in suffix_tree.score(documents(rows), depth=5, least_share=1e-3).collect()}
    assert all(r.score > shorter[r.doc_id] + 1 for r in found)


def test_rare_contexts_stay(documents):
    """What is met a few times in a large corpus is learnt; many small chunks and few slots count alike."""
    rows = [(i, "the cat sat on the mat and " * 400) for i in range(100)] + [(i, "qzjxkvw qzjxkvu") for i in range(100, 106)]
    docs = documents(rows)
    same(suffix_tree.score(docs).collect(), brute(rows, 7, 0.0))
    same(suffix_tree.score(docs, chunk=3000, slots=3).collect(), brute(rows, 7, 0.0))


def test_few_among_many(documents):
    """Three documents among a hundred longer ones; far worse if contexts had to make up 2e-6 of all symbols."""
    rows = [(i, "the cat sat on the mat and " * 800) for i in range(100)] + [(i, "qzjxkvw qzjxkvu") for i in (101, 102, 103)]
    docs = documents(rows)
    found = suffix_tree.score(docs).filter("doc_id > 100").collect()
    same(found, [row for row in brute(rows, 7, 0.0) if row[0] > 100])
    rest = suffix_tree.score(docs, least_share=2e-6).filter("doc_id > 100").collect()
    assert min(r.score for r in found) > max(r.score for r in rest) + 3


def test_long_texts(documents):
    """Texts cut into parts score as if they were whole: words, tokens and the symbols across the cuts."""
    rng = random.Random(8)
    vocabulary = ["the", "The", "sat,", "öl", "zebra", "x" * 50, "é中"]
    long = "".join(rng.choice(vocabulary) + rng.choice([" ", "\n ", "\t"]) for _ in range(3000))
    rows = [(1, long), (2, " \n" + long + "   "), (3, "y" * 5000), (4, "a " + "y" * 5000 + " b"), (5, " " * 5000), (6, "the cat"), (20, long[:900])]
    whole = brute(rows, 7, 0.0)
    same(suffix_tree.score(documents(rows).coalesce(1), chunk=2000, part_bytes=700).collect(), whole)


def test_answers_hold_each_cost_once():
    """Numbers that are scored in the same context share a cost; contexts that go on with zeros, or with a length, are told apart."""
    rng = np.random.default_rng(5)
    for depth in (3, 5, 7):
        bytes_of = rng.choice(np.array([0, 3, 4, 5, 6, 97, 98], np.uint8), (4000, 8))
        bytes_of[:, depth:7] = 0
        keys = np.unique(np.ascontiguousarray(bytes_of).view(">u8").ravel().astype(np.uint64))
        length = rng.integers(2, depth + 1, len(keys)).astype(np.uint8)
        told = [(int(n), int(k).to_bytes(8, "big")[:n], int(k) & 255) for k, n in zip(keys, length)]
        each = {pair: cost for cost, pair in enumerate(sorted(set(told)))}
        cost = np.array([each[pair] for pair in told], np.float32)
        data = suffix_tree.answer(keys, cost, length, depth)
        assert suffix_tree.read_answer(keys, data, depth).tolist() == cost.tolist()
        assert len(suffix_tree.unpacked(data, np.uint8, np.float32)[1]) == len(each) < len(keys)


def test_costs_are_not_stored(documents, stage, monkeypatch):
    """Slots answer their rows at once: what was asked is shuffled once, and no table of costs is written; it is gone when it is answered.
    Control bytes score like others."""
    saved, save = [], type(stage).save
    monkeypatch.setattr(type(stage), "save", lambda self, table, name: saved.append(name) or save(self, table, name))
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab \x00\x03\x04\x05\x06") for _ in range(300))) for i in range(60)]
    same(suffix_tree.score(documents(rows), stage, chunk=3000, slots=5).collect(), brute(rows, 7, 0.0))
    assert sorted(saved) == ["answers", "scored", "words"]
    (asked,) = (Path(stage.folder.removeprefix("file:"))).glob("asked-*")
    assert [path.name for path in asked.glob("kind=*")] == ["kind=whole"]
    with pytest.raises(ValueError):
        stage.drop(str(asked.parent.parent))


def test_merged_lists(monkeypatch):
    """Lists of keys as one, stretch by stretch, and the counts of two."""
    monkeypatch.setattr(suffix_tree, "_MERGED", 16)
    rng = np.random.default_rng(6)
    for sizes in ([0], [0, 0], [300], [0, 40, 1], [500, 200, 0, 333], [16, 17, 1000]):
        lists = [np.unique(rng.integers(0, 900, size).astype(np.uint64)) for size in sizes]
        keys, places = suffix_tree.merged(list(lists))
        assert keys.tolist() == np.unique(np.concatenate(lists)).tolist()
        assert all(keys[place].tolist() == own.tolist() for place, own in zip(places, lists, strict=True))
        counts = [np.arange(1, len(own) + 1, dtype=np.int32) for own in (lists[0], lists[-1])]
        keys, n = suffix_tree.joined(lists[0], counts[0], lists[-1], counts[1])
        whole = Counter(dict(zip(lists[0].tolist(), counts[0].tolist())))
        whole.update(dict(zip(lists[-1].tolist(), counts[1].tolist())))
        assert dict(zip(keys.tolist(), n.tolist())) == whole and keys.tolist() == sorted(whole)


def test_memory_of_chunks(monkeypatch):
    """Scoring holds the arrays of one chunk, not of two, and its different numbers about twice."""
    monkeypatch.setattr(suffix_tree, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(3)
    size, n = 3 << 20, 2500
    data = rng.integers(97, 123, 2 * size + (size >> 2), np.uint8)
    data[::8] = 32
    texts = [bytes(data[at : at + n]).decode() for at in range(0, len(data), n)]
    columns = [pa.array(np.arange(len(texts))), pa.array(texts), pa.array(np.zeros(len(texts), bool))]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "held_out"])
    answers = []
    for found in suffix_tree.asked([batch], 7, 16, size, 1 << 20):
        for row in found.to_pylist():
            if row["slot"] >= 0:
                keys = np.cumsum(suffix_tree.unpacked(row["data"], np.uint64)[0], dtype=np.uint64)
                row["data"] = suffix_tree.answer(keys, np.full(len(keys), 0.5, np.float32), np.full(len(keys), 7, np.uint8), 7)
            if row["slot"] >= suffix_tree.TEXTS:
                answers.append({name: row[name] for name in ("chunk", "slot", "data")})
    assert len({row["chunk"] for row in answers}) >= 2
    answers.sort(key=lambda row: (row["chunk"], row["slot"]))
    batches = [pa.RecordBatch.from_pylist([row]) for row in answers]
    frequent = SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)))
    tracemalloc.start(1)
    rows, score = 0, 0.0
    for found in suffix_tree.scored(batches, 7, 16, frequent):
        rows, score = rows + found.num_rows, score + float(np.sum(found.column(6).to_numpy()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts)
    assert score == -0.5 * sum(len(string(text)) for text in texts)
    assert peak < 42 * size


def test_cuts():
    for text in (b"", b"   ", b"abc", b" ab  cd ", b"a" * 30, b"ab " * 20 + b"  ", b"\n" * 25 + b"x" + b" " * 25 + b"y" * 25):
        parts = suffix_tree.cuts(np.frombuffer(text, np.uint8), 10)
        assert [w for a, b in parts for w in text[a:b].split()] == text.split()
        assert all(text[a:b].lstrip() == text[a:b] for a, b in parts) and text[: parts[-1][1] if parts else 0].rstrip() in (b"", text.rstrip())


def test_held_out_at_two_sizes(spark):
    """More text, a better model: most held-out documents beat the word base."""
    found = suffix_tree.op4_lm_scoring(spark, "/root/testdata/sf0.1").filter("held_out").collect()
    assert np.mean([r.score > r.base_score for r in found]) > 0.9
