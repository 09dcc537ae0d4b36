"""Token alignment against a walk over the decoded tokens of each whole text."""

import collections
import hashlib
import itertools

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from segrisk.llm import bpe, cuts, queries, spans
from tests.llm.test_tokens import odd_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
NOTHING = (0, 0, 0, 0, "", {})


@pytest.fixture(scope="module")
def brute_force():
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    letters = bpe.byte_letters()

    def piece_bytes(i):
        piece = model.IdToPiece(i)
        return bytes([int(piece[3:5], 16)]) if model.IsByte(i) else piece.replace("▁", " ").encode()

    def align(text):
        if not text:
            return NOTHING
        a, b = library.encode(f" {text}", add_special_tokens=False).ids, model.encode(text)
        a_bytes = [bytes(letters[c] for c in library.id_to_token(i)) for i in a]
        b_bytes = [piece_bytes(i) for i in b]
        if {b"".join(a_bytes), b"".join(b_bytes)} != {f" {text}".encode()}:
            return NOTHING
        a_ends, b_ends = (list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes))
        links, groups, i, j, low = collections.Counter(), [([], [])], 0, 0, 0
        while i < len(a):
            links[a[i] << 32 | b[j]] += 1
            high = min(a_ends[i], b_ends[j])
            ends = a_ends[i] == high, b_ends[j] == high
            for side, token, end in zip((0, 1), (a[i], b[j]), ends, strict=True):
                groups[-1][side].extend([token] * end)
            i, j = i + ends[0], j + ends[1]
            if all(ends):
                groups.append(([], []))
        names = ";".join("|".join(",".join(map(str, ids)) for ids in group) for group in groups[:-1])
        return len(a), len(b), len(groups) - 1, sum(links.values()), names, dict(links)

    return align


def as_tuple(row):
    return row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["groups"], dict(zip(row["pairs"], row["links"]))


def test_aligner(brute_force):
    tool, texts = spans.Aligner(A, B), odd_texts(7, 1500)
    assert tool.b.cuts
    for _ in range(2):  # the second time from memory
        for text, row in zip(texts, tool.align(texts).to_pylist(), strict=True):
            assert as_tuple(row) == brute_force(text), text
    assert sum(brute_force(t) == NOTHING for t in texts) > 20


def test_white_space_at_the_end_of_a_text(brute_force):
    """It is learned beside the chunks of other texts, with which it has no token in common."""
    tool = spans.Aligner(A, B)
    for texts in (["a  ", "  b"], ["x\t ", "  y"], [" ", "  ", "\n", "a"], ["a\u3000", "b", "c\x85 ", "  d"], ["a \n"], ["e", "\n\nf"]):
        for text, row in zip(texts, tool.align(texts).to_pylist(), strict=True):
            assert as_tuple(row) == brute_force(text), text


def test_small_memory_and_whole_texts(brute_force, monkeypatch):
    texts = odd_texts(8, 150)
    monkeypatch.setattr(cuts, "CACHE_KEYS", 60)
    tool = spans.Aligner(A, B)
    for text in texts:
        assert as_tuple(tool.align([text]).to_pylist()[0]) == brute_force(text)
    tool.b.cuts = False  # a vocabulary with pieces across blanks
    tool.forget()
    for text, row in zip(texts, tool.align(texts).to_pylist(), strict=True):
        assert as_tuple(row) == brute_force(text)


def test_ends_inside_shared_characters():
    # Two one-byte characters, one of three bytes that three tokens share (either form of spans), one more.
    at = np.array([0, 1, 2, 5, 6])
    size = np.array([1, 1, 1, 1, 1, 1])
    for shared in ([(2, 3)] * 3, [(2, 2), (2, 2), (2, 3)]):
        found = spans.byte_ends(np.array([(0, 1), (1, 2), *shared, (3, 4)]), size, at)
        assert found.tolist() == [1, 2, 3, 4, 5, 6]


def with_brute_counts(rows, brute_force):
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of all rows."""
    found = [(i, brute_force(t)) for i, t in rows]
    count = collections.Counter(pair for _, own in found for pair in own[5])
    most = collections.Counter()
    for pair, n in count.items():
        most[pair >> 32] = max(most[pair >> 32], n)
    return sorted(
        (-1 if i is None else i, *own[:5],
         sum(n for pair, n in own[5].items() if count[pair] == most[pair >> 32]),
         sum(n * count[pair] for pair, n in own[5].items()))
        for i, own in found
    )


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_counts_by_broadcast_and_by_join(spark, brute_force, monkeypatch, frequent):
    monkeypatch.setattr(spans, "FREQUENT", frequent)
    texts = odd_texts(9, 60)
    rows = [*enumerate(texts), (None, "no id"), (3, texts[3]), (3, "other text of the id"), *((100 + i, "the same") for i in range(50))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, groups string, _row long")
    out = spans.with_counts(spans.align(docs.repartition(3), A, B))
    columns = ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    found = sorted(tuple(r) for r in out.select(F.coalesce("doc_id", F.lit(-1)), *columns).collect())
    assert found == with_brute_counts(rows, brute_force)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spans.with_counts(spans.align(docs, A, B)).collect() == []


def test_query_on_whole_texts(spark, brute_force):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = queries.queries()["op13_token_alignment"](spark, SMALL).collect()
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    want = [
        tuple(hashlib.sha256(v.encode()).hexdigest() if k == 5 and v else v for k, v in enumerate(row))
        for row in with_brute_counts(docs, brute_force)
    ]
    assert sorted(tuple(r[c] for c in columns) for r in rows) == want
