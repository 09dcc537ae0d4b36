"""Byte-pair encoding against the tokenizers library, on odd texts and on texts of random pieces."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from segrisk.llm import bpe, cuts, queries

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"

# White space of all kinds, letters and digits of several scripts, unassigned characters, contractions, long words.
PIECES = [
    "a", "b", "e", "the", "Word", " ", "  ", "\n", "\t", "\r", "\xa0", "\u3000", "\u200b", "\x1c", "\x85", " \t ", "1", "23",
    "'s", "'ll", "é", "ж", "日本", "\u0558", "\U0001F600", "!", "...", "<|endoftext|>", "<|endof", "x" * 70, "ab1" * 40,
    "\ud7ff", "\U00010940", "e\u0301", "\0", "\u2581", "<0x41>", "\ufeff",
]


def odd_texts(seed, n):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 50))) for _ in range(n)]
    return [*made, None, "", " ", "\n", "   \n", "one", made[0], "".join(rng.choice("abcdefgh") for _ in range(50_000))]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chunks_join_to_the_text():
    for text in odd_texts(1, 300):
        found = cuts.chunks(text or "")
        assert "".join(found) == (text or "") and all(found)
        assert all(b[0] in " \n" and a[-1] not in " \n" + cuts.OTHER_SPACE for a, b in zip(found, found[1:]))


def test_encoder_equals_the_library():
    texts, tool = odd_texts(2, 2000), bpe.Encoder(BYTE_BPE)
    library = Tokenizer.from_file(BYTE_BPE)
    for _ in range(2):  # the second time from memory
        ids, offsets = tool.encode(texts)
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_encoder_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(cuts, "CACHE_KEYS", 50)
    texts, tool = odd_texts(3, 200), bpe.Encoder(BYTE_BPE)
    library = Tokenizer.from_file(BYTE_BPE)
    for text in texts[:60]:
        ids, _ = tool.encode([text])
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert len(tool.chunks.known) < 200


def test_scan_and_queue_agree():
    rng = random.Random(4)
    words = ["".join(rng.choice("abestr ing") for _ in range(rng.randrange(1, 65))).encode() for _ in range(500)]
    model = bpe.ByteBpe(BYTE_BPE)
    size, ids = model.merge(words)
    at = 0
    for word, n in zip(words, size.tolist(), strict=True):
        assert ids[at : at + n].tolist() == model._queue(word).tolist()
        at += n
    assert at == len(ids) and [len(x) for x in model.merge([])] == [0, 0]


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_encode_and_decode_tables(spark):
    texts = odd_texts(5, 60)
    rows = [(i, t, "x", None) for i, t in enumerate(texts)] + [(None, "no id", "x", None), (3, texts[3], "x", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string, known long")
    library = Tokenizer.from_file(BYTE_BPE)
    out = bpe.encode(docs.repartition(3), BYTE_BPE).withColumn("back", bpe.decoder(BYTE_BPE)("ids"))
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.ids, r.back) for r in out.collect())
    want = [(-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, *_ in rows]
    assert found == sorted(want)
    assert bpe.encode(docs.where("false"), BYTE_BPE).collect() == []


def test_decode_odd_ids(spark):
    library = Tokenizer.from_file(BYTE_BPE)
    lists = [[50256, 15496], [], [168], [220, 10545, 245], [99999, 15496, -1], [168, 168, 15496, 10545]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(9, None)], "n int, ids array<int>")
    out = {r.n: r.back for r in rows.withColumn("back", bpe.decoder(BYTE_BPE)("ids")).collect()}
    assert out.pop(9) is None
    for i, ids in enumerate(lists):
        known = [x for x in ids if 0 <= x <= 50256]
        assert out[i] == library.decode(known, skip_special_tokens=False)


def test_query_on_whole_texts(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    library = Tokenizer.from_file(BYTE_BPE)
    rows = queries.queries()["op11_bpe_round_trip"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for row in rows:
        ids = library.encode(docs[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids) and row.ids_sha256 == digest(",".join(map(str, ids)))
        assert row.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False))
