"""Against plain loops over the tokens: offsets, groups, links, counts over documents."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymatch.llm import alignment

FIRST, SECOND = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cut():
    tokenizer = Tokenizer.from_file(FIRST)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letters = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}

    def of(text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids
        a = [(n, bytes(letters[c] for c in tokenizer.id_to_token(n))) for n in a]
        b = []
        for n in model.encode(text):
            piece = model.id_to_piece(n)
            b.append((n, bytes([int(piece[3:5], 16)]) if model.is_byte(n) else piece.replace("▁", " ").encode()))
        spelled = [b"".join(token for _, token in side) for side in (a, b)]
        return (a, b) if spelled == [whole, whole] else ([], [])

    return of


def spans(tokens):
    at, out = 0, []
    for n, token in tokens:
        out.append((n, at, at + len(token)))
        at += len(token)
    return out


def overlaps(a, b):
    out, at = [], 0
    for x, s, e in a:
        while at < len(b) and b[at][2] <= s:
            at += 1
        out += [(x, y) for y, t, f in b[at : at + e - s] if s < f and t < e]
    return out


def groups_of(a, b):
    at, out = [0, 0], []
    for end in sorted({e for _, _, e in a} & {e for _, _, e in b}):
        names = []
        for k, side in enumerate((a, b)):
            own = []
            while at[k] < len(side) and side[at[k]][2] <= end:
                own.append(str(side[at[k]][0]))
                at[k] += 1
            names.append(",".join(own))
        out.append("|".join(names))
    return out


def brute(texts, cut):
    sides = [tuple(map(spans, cut(text))) for text in texts]
    links = [overlaps(a, b) for a, b in sides]
    documents = Counter(pair for own in links for pair in set(own))
    highest = defaultdict(int)
    for (x, _), n in documents.items():
        highest[x] = max(highest[x], n)
    rows = []
    for (a, b), own in zip(sides, links, strict=True):
        groups = groups_of(a, b)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        best = sum(documents[p] == highest[p[0]] for p in own)
        rows.append((len(a), len(b), len(groups), len(own), best, sum(documents[p] for p in own), digest))
    return rows


NAMES = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
TEXTS = [
    "The cat sat on the mat.",
    "the Cat  sat,\n\n on\tthe mat  ",
    "<|endoftext|> <s> </s> <0x41> <unk>",
    "Größe 中文字 😀 ́e \x00 \x7f",
    "a ▁ b",
    "",
    None,
    " ",
    "x" * 3000 + " tail",
    "The cat sat on the mat.",
    "​zero ﬁ   wide",
    "antidisestablishmentarianism " * 20,
]


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_planted(documents, cut, most):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "The cat")]
    found = alignment.align(documents(rows), FIRST, SECOND, most=most).collect()
    expected = brute([t for _, t in rows], cut)
    key = str
    assert sorted([(r.doc_id, *(r[n] for n in NAMES)) for r in found], key=key) == sorted(
        [(i, *row) for (i, _), row in zip(rows, expected, strict=True)], key=key
    )


def test_given_table(spark, cut):
    found = {r.doc_id: r for r in alignment.op11_alignment(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs}
    expected = brute(list(short.values()), lambda text: cut(text))
    assert {i: tuple(found[i][n] for n in NAMES) for i in short} == dict(zip(short, expected, strict=True))


def test_groups_of_tokens(documents, cut):
    """The operator's own output: every token with its group; groups spell the same bytes on both sides."""
    rows = alignment.tokens(documents(TEXTS), FIRST, SECOND).orderBy("doc_id").collect()
    for row, text in zip(rows, TEXTS, strict=True):
        a, b = cut(text)
        assert (row.a_ids, row.b_ids) == ([n for n, _ in a], [n for n, _ in b])
        spelled = []
        for side, groups in ((a, row.a_groups), (b, row.b_groups)):
            own = defaultdict(bytes)
            for (_, token), group in zip(side, groups, strict=True):
                own[group] += token
            assert list(own) == list(range(len(own)))
            spelled.append(own)
        assert spelled[0] == spelled[1]


def test_long_group_converges(documents, cut):
    """Ends that never meet but at the last byte: the longest chain of pointers there is."""
    a, b = alignment.np.arange(2, 4001, 2), alignment.np.append(alignment.np.arange(1, 4000, 2), 4000)
    assert set(alignment.terminals(a, b).tolist()) == {len(a) + len(b) - 1}


def test_clashing_columns_and_empty(documents):
    docs = documents(["a b c", "a b", None])
    clashing = docs.withColumns({n: F.lit("?") for n in ("row", "pair", "pairs", "times", "n", "best", "a", "a.b")})
    rows = [sorted(alignment.align(d, FIRST, SECOND, most=1).collect()) for d in (docs, clashing)]
    assert rows[0] == rows[1]
    assert alignment.align(docs.limit(0), FIRST, SECOND).count() == 0
