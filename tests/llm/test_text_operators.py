"""The text operators against brute-force versions, with odd inputs: NULLs, empty and repeated rows, clashing names."""

import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from segrisk.llm import chat, chunks, decontaminate, fingerprint, html, jaccard, license_texts, licenses, lm, packing, quality, sketch
from segrisk.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.1 else ''}" for _ in range(n))


def docs_df(spark, texts, extra=()):
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], DOCS)


def clashing(df, *names):
    """The same rows with additional columns whose names the operators use themselves."""
    return df.selectExpr("*", *(f"lang AS `{n}`" for n in names))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([1, 3, 12, 60, 200])) for _ in range(40)]
    near = []
    for text in base[:12]:
        words = text.split(" ")
        for _ in range(rng.randrange(1, 4)):
            own = list(words)
            for _ in range(max(1, len(own) // rng.choice([15, 40, 200]))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(999)}"
            near.append(" ".join(own))
    return [*base, *near, base[3], base[3], None, "", "  \n ", "ONE Two", "one two", prose(rng, 30_000)]


# Wu-Manber search


def brute_hits(text, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit, found = pattern.findall(lower(text)), set(), set()
    for item_id, item in items:
        own = pattern.findall(lower(item))
        size = min(10, len(own))
        for j in range(len(own) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[j : j + size]:
                    hit |= set(range(i, i + size))
                    found |= {item_id} - {None}
    digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)


ITEMS = [(1, "W1 w2 w3"), (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, None), (3, ""),
         (1, "W1 w2 w3"), (None, "lone words here"), (7, "ok")]


@pytest.mark.parametrize("block", [1 << 18, 2])
def test_benchmark_hits(spark, texts, block):
    rng = random.Random(1)
    own = [*texts[:30], "a, W1-w2 w3! w2 w3 w1 w2 w3", f"{prose(rng, 700)} {ITEMS[1][1]} {prose(rng, 700)}",
           "beta gamma delta epsilon zeta eta theta iota kappa lambda", "lone words here", "ok", None, ""]
    docs = clashing(docs_df(spark, own), "items", "spans", "row_id", "n_words")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.with_digests(decontaminate.find_benchmark(docs, bench, pattern_block=block))
    got = {r.doc_id: tuple(r)[1:] for r in found.collect()}
    assert got == {i: brute_hits(t, ITEMS) for i, t in enumerate(own)}
    kept = decontaminate.decontaminate(docs, bench, pattern_block=block)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if not g[-1]}


def test_benchmark_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = docs_df(spark, ["a b", None])
    assert [r.contaminated for r in decontaminate.with_digests(decontaminate.find_benchmark(docs, empty)).collect()] == [False, False]
    assert decontaminate.find_benchmark(docs.limit(0), empty).count() == 0


# N-gram Jaccard join


def brute_groups(texts, size, percent):
    sets = {}
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[i] = {tuple(words[j : j + size]) for j in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}
    group = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return {i: (len(sets[i]), group[i]) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_similar_groups(spark, texts, size, percent, monkeypatch):
    docs = clashing(docs_df(spark, texts), "component", "id", "a", "token", "n")
    rule = jaccard.Rule(size, percent)
    expected = brute_groups(list(enumerate(texts)), size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, rule).collect()} == expected
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard, "BITMAP_BITS", 16)
    kept = jaccard.keep_one(docs, rule)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if c == i)


def test_groups_that_only_chain(spark):
    # Each text is near the next one, so only the bucket's middle members link its ends.
    words = [f"t{i}" for i in range(400)]
    chain = [" ".join(words[i * 8 : i * 8 + 200]) for i in range(20)]
    shuffled = list(enumerate(chain))
    random.Random(2).shuffle(shuffled)
    own = [t for _, t in shuffled]
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs_df(spark, own), jaccard.Rule(4, 85)).collect()}
    assert got == {i: c for i, (_, c) in brute_groups(list(enumerate(own)), 4, 85).items()}


@pytest.mark.parametrize("block", [256, 2])
def test_links_and_their_number(spark, texts, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rng = random.Random(14)
    words, triple = prose(rng, 200, 10**6).split(), []
    for i in range(6):  # near copies that all link with each other
        own = list(words)
        own[20 + 30 * i] = "x"
        triple.append(" ".join(own))
    rows = list(enumerate([*texts[:-1], *triple, triple[0], triple[5]]))
    rows += [(len(rows) - 2, texts[3]), (1000, triple[0]), (1000, triple[1]), (1001, triple[2]), (1001, texts[4])]
    rule = jaccard.Rule(4, 85)
    sets = collections.defaultdict(set)
    for i, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        n = min(4, len(found))
        sets[i] |= {frozenset(tuple(found[j : j + n]) for j in range(len(found) - n + 1))} - {frozenset(), frozenset([()])}
    near = {(x, y) for x in set().union(*sets.values()) for y in set().union(*sets.values()) if 100 * len(x & y) >= 85 * len(x | y)}
    rep = {x: min(i for i in sets if x in sets[i]) for x, _ in near}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.a, r.b) for r in jaccard.links(docs, rule).collect())
    assert got == sorted({(rep[x], rep[y]) for x, y in near if rep[x] < rep[y]}) and len(got) > 15
    counts = {i: sum(i != j and any((x, y) in near for x in sets[i] for y in sets[j]) for j in sets) for i in sets if sets[i]}
    assert {r.doc_id: r.n_links for r in jaccard.link_counts(docs, rule).collect()} == counts


def test_tokens_of_one_document_come_first(spark, monkeypatch):
    """However crowded the counters are."""
    monkeypatch.setattr(jaccard, "SKETCH_BITS", 4)
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK", 16)
    common = " ".join(f"c{i}" for i in range(30))
    own = [common + "".join(f" d{k}x{i}" for i in range(40)) for k in range(30)]
    rarity = jaccard.count_rarity(docs_df(spark, own), 4).value
    sets = list(jaccard.shingle_sets(pa.array(own), 4))
    shared = np.intersect1d(sets[0], sets[1])
    assert len(shared) == 27 and rarity.of(shared).min() > 0
    single = np.setdiff1d(np.concatenate(sets), shared)
    assert (rarity.of(single) == 0).mean() > 0.5
    assert not np.isin(jaccard.prefix_of(sets[0], rarity, 10), shared).any()


def test_groups_of_odd_rows(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(5, text), (5, text), (5, "q r s t u v"), (2, "q r s t u v"), (None, text), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in jaccard.similar_groups(docs).collect())
    assert got == [(False, 2, 2), (False, 5, 2), (False, 5, 2), (False, 5, 2), (False, 9, 9), (True, None, None)]
    kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in jaccard.keep_one(docs).collect()), key=str)
    assert kept == [(False, 2, "q r s t u v"), (False, 9, None), (True, 0, text)]
    assert jaccard.similar_groups(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    links = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 3)]
    random.Random(3).shuffle(links)
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


# Main text of pages whose article stands in an element with a misleading name


@pytest.mark.parametrize(
    "around",
    [
        '<div class="site no-sidebar">%s</div>', '<div class="page-content has-header">%s</div>',
        '<section class="social-science">%s</section>', '<div id="header-2"><div class="related">%s</div></div>',
        "<div class=widget>%s",
    ],
)
def test_misleading_names(around):
    paragraphs = [f"{'some running text of the article number %d ' % i * 4}".strip() for i in range(6)]
    article = "<h2>Title of it</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    comments = f'<div class="comments"><p>{"a reader says this " * 20}</p></div><div class="ad">Buy this now</div>'
    page = f'<html><body><nav><a href="x">Home</a></nav>{around % article}{comments}</body></html>'
    if around.endswith("</div>") or around.endswith("</section>"):
        assert html.main_text(page) == "\n".join(["Title of it", *paragraphs])
    else:  # never closed: what follows is inside, and leaves by its own name
        assert html.main_text(page).startswith("\n".join(["Title of it", *paragraphs]))
        assert "reader" not in html.main_text(page)


def test_long_comments_and_short_articles():
    comments = f'<div class="comments">{"<p>comment text that is long</p>" * 50}</div>'
    article = "short article text " * 5
    assert html.main_text(f"<body><h1>T</h1><p>{article}</p>{comments}") == f"T\n{article.strip()}"
    advert = '<div class="ad">An advert that is longer than the article.</div>'
    assert html.main_text(f"<body>{advert}<article><h1>Tiny.</h1><p>Tiny one.</article>") == "Tiny.\nTiny one."


# The mixer of the language model


def scalar_mixer(x, gate, branch):
    """Natural log probability of one text, decision by decision; also that of the other branch of each."""
    weights = [[float(w) for w in row] for row in lm.START_WEIGHTS]
    refined = [1 / (1 + np.exp(-(b - lm.BUCKETS // 2) / 2)) for b in range(lm.BUCKETS)]
    total, others, at, size = 0.0, [], 0, 16
    while at < len(branch):
        gradient, moves = [[0.0] * 4 for _ in weights], {}
        for i in range(at, min(at + size, len(branch))):
            odds = [float(v[i]) for v in x]
            mixed = min(14.0, max(-14.0, sum(w * o for w, o in zip(weights[gate[i]], odds))))
            p, cell = 1 / (1 + np.exp(-mixed)), int(mixed * 2 + lm.BUCKETS // 2 + 0.5)
            both = (p + refined[cell]) / 2
            total += np.log(max(both if branch[i] else 1 - both, 1e-7))
            others.append((both, 1 - both))
            for k in range(4):
                gradient[gate[i]][k] += (branch[i] - p) * odds[k]
            moves.setdefault(cell, []).append(branch[i] - refined[cell])
        for g, row in enumerate(gradient):
            weights[g] = [w + lm.RATE * d for w, d in zip(weights[g], row)]
        for cell, own in moves.items():
            refined[cell] += sum(own) / (len(own) + 1 / lm.REFINE_RATE)
        at, size = at + size, min(2 * size, lm.STEP)
    return total, others


def test_mixer_equals_a_scalar_version():
    rng = np.random.default_rng(3)
    counts = [5, 40, 0, 700, 2500]
    ends = np.concatenate(([0], np.cumsum(counts)))
    x = [rng.normal(0, 2, ends[-1]).astype(np.float32) for _ in range(4)]
    gate = rng.integers(0, 4, ends[-1]).astype(np.uint8)
    branch = rng.integers(0, 2, ends[-1]).astype(np.uint8)
    for v in x:
        v[ends[3] : ends[4]], branch[ends[3] : ends[4]] = 1.0, 1  # the same certain branch over and over
    got = lm.Mixer(len(counts)).read(x, gate, branch, ends)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        want, both = scalar_mixer([v[a:b] for v in x], gate[a:b], branch[a:b])
        assert got[i] == pytest.approx(want, rel=1e-3, abs=1e-4) and got[i] <= 0
        assert all(0 < p < 1 for pair in both for p in pair)


def test_short_texts_are_adapted_to():
    x = [np.full(200, -1.0, np.float32) for _ in range(4)]
    gate, branch = np.full(200, 2, np.uint8), np.ones(200, np.uint8)  # always the branch that was unlikely
    n = np.array([0, 200])
    adapted = lm.Mixer(1).read(x, gate, branch, n)[0]
    first = lm.Mixer(1).read([v[:16] for v in x], gate[:16], branch[:16], np.array([0, 16]))[0]
    assert adapted > 200 / 16 * first + 5


# Substring dedup


def test_passages_of_rows_that_share_a_doc_id(spark):
    """A repeat in one row of an id leaves the other rows of the id alone, also inside their characters."""
    rng = random.Random(12)
    shared, lone, other = prose(rng, 90), "é" * 30 + prose(rng, 150), prose(rng, 60)
    rows = [(1, shared), (2, f"{other} {shared}"), (2, lone), (2, None), (3, f"{lone} {other}"), (2, f"{other} {shared}")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, variant string, start int")
    out = chunks.dedup_substrings(docs.repartition(3)).collect()
    texts = [(r.doc_id, r.text) for r in out]
    assert len(out) == len(rows) and {(r.variant, r.start) for r in out} == {("x", 1)}
    assert (1, shared) in texts and (2, lone) in texts and (2, None) in texts
    cut = [t for i, t in texts if i == 2 and t and t != lone]
    assert len(cut) == 2 and cut[0] == cut[1] and other[:100] in cut[0] and len(cut[0]) < len(other) + 80
    (third,) = (t for i, t in texts if i == 3)
    assert lone[100:400] not in third


def test_repeated_passages(spark):
    rng = random.Random(8)
    passages = [prose(rng, 55, 5000) for _ in range(30)]
    own, repeated = [], set()
    for i in range(90):
        own.append(f"{prose(rng, rng.randrange(5, 80), 10**6)} {passages[i % 30]} {prose(rng, 40, 10**6)}")
        repeated |= {i} if i >= 30 else set()
    clean = [prose(rng, 150, 10**6) for _ in range(60)]
    line = "tick tock " * 100  # repeats inside one document only
    docs = clashing(docs_df(spark, [*own, *clean, line, None, ""]), "start", "size", "row", "_spans", "digest")
    assert {r.doc_id for r in chunks.repeated_passages(docs).collect()} == repeated
    cut = chunks.dedup_substrings(docs)
    assert cut.columns == docs.columns
    after = {r.doc_id: r.text for r in cut.collect()}
    assert all(after[i] == t for i, t in enumerate([*own, *clean, line, None, ""]) if i not in repeated)
    for i in repeated:  # the passage is gone but for its ends, the rest is whole
        head, tail = own[i].split(passages[i % 30])
        assert after[i].startswith(head[:-8]) and after[i].endswith(tail[8:])  # neighbours may share a few bytes
        assert len(after[i]) - len(head) - len(tail) < len(passages[0]) / 2


def test_chunks_that_repeat_one_by_one_are_no_passage(spark):
    rng = random.Random(12)
    text, passage = prose(rng, 200, 10**6).encode(), prose(rng, 60, 10**6)
    starts = chunks.chunk_borders(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist()
    # Every chunk of the text stands in an earlier document, but no 160 consecutive bytes of it do.
    parts = [f"{prose(rng, 9, 10**6)} {text[max(0, s - 25) : s + 110].decode(errors='ignore')} {prose(rng, 9, 10**6)}" for s in starts]
    n = len(parts)
    own = [*parts, text.decode(), f"{prose(rng, 30, 10**6)} {passage}", f"{text.decode()} {passage} {text.decode()}"]
    found = {}
    for r in chunks.repeated_passages(docs_df(spark, own)).collect():
        found.setdefault(r.doc_id, []).append(own[r.doc_id].encode()[r.start : r.start + r.size].decode())
    assert set(found) == {n + 2}
    assert all(len(p.encode()) >= 160 and any(p in t for t in (own[n], own[n + 1])) for p in found[n + 2])
    assert sum(len(p) for p in found[n + 2]) > 0.9 * len(own[n + 2])


def test_passages_are_the_longest_runs_of_chunks():
    rng = random.Random(13)
    data = np.frombuffer("".join(texts := [prose(rng, k) for k in (60, 1, 30, 90)]).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts, ends = chunks.chunk_borders(data, offsets)
    first, last = chunks.chunk_windows(starts, ends, offsets, 160)
    got = set(zip(first.tolist(), last.tolist(), strict=True))
    text = np.searchsorted(offsets, starts, side="right") - 1
    fit = [(i, j) for i in range(len(starts)) for j in range(i, len(starts)) if text[i] == text[j] and ends[j] - starts[i] >= 160]
    least = {(i, min(j for a, j in fit if a == i)) for i, _ in fit} | {(max(i for i, b in fit if b == j), j) for _, j in fit}
    assert got == least


def test_repeated_rows_and_empty_tables(spark):
    text = prose(random.Random(1), 80, 10**6)
    docs = spark.createDataFrame([(4, text), (4, text), (6, text), (None, text), (8, "")], "doc_id long, text string")
    assert {r.doc_id for r in chunks.repeated_passages(docs).collect()} == {6}
    assert sorted((r.doc_id or 0, r.text) for r in chunks.dedup_substrings(docs).collect()) == [(0, text), (4, text), (4, text), (6, ""), (8, "")]
    assert chunks.dedup_substrings(docs.limit(0)).count() == 0


def test_chunks_do_not_depend_on_what_stands_before():
    rng = random.Random(4)
    text = prose(rng, 300).encode()
    one = np.frombuffer(text, np.uint8)
    two = np.frombuffer(b"some other text" + text, np.uint8)
    ends = [set(chunks.chunk_borders(d, np.array([0, len(d)]))[1].tolist()) for d in (one, two)]
    moved = {e - 15 for e in ends[1]}
    assert len(ends[0] ^ moved) <= 4 and len(ends[0]) > 50


def brute_gear(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(chunks._GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_is_the_rolling_one():
    data = random.Random(2).randbytes(500)
    assert chunks.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == brute_gear(data)


# Quality classifier


def labelled(n=300, vocabulary=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        own = prose(rng, 60, vocabulary)
        text = own + "." if good else " ".join(f"{w.upper()}!!" for w in own.split())
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_separates_held_out_texts(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "x")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (3, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known, "crc32(cast(doc_id AS string)) % 4 <> 2")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    held = [(got[i], q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((s >= 0.7) == (q == 1) for s, q in held) >= 0.98 * len(held)
    kept = quality.keep_good(clashing(docs.selectExpr("*", "'en' AS lang"), "score", "row"), known)
    assert kept.columns == ["doc_id", "text", "lang", "score", "row"]
    assert len({r.doc_id for r in kept.collect()} & {i for i, q, _ in labels if not q}) <= 2


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.fit(docs, none, "true")).collect()] == [0.5]
    assert quality.score(docs.limit(0), quality.fit(docs, none, "true")).count() == 0


# Language model


def test_scores_are_probabilities_and_beat_the_base(spark, texts):
    rng = random.Random(9)
    syllables = ["tion", "ment", "ver", "la", "con", "ri", "sta", "pel"]
    made = [" ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(150)) for _ in range(120)]
    own = [*texts[:-1], *made]
    docs = clashing(docs_df(spark, own), "word", "n", "row_id", "held_out")
    held = "crc32(cast(doc_id AS string)) % 5 = 1"
    for limit in (1 << 22, 0):
        got = {r.doc_id: r for r in lm.score_documents(docs, held, limit=limit).collect()}
        counts = collections.Counter()
        tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for i, t in enumerate(own)}
        for i, t in tokens.items():
            if zlib.crc32(str(i).encode()) % 5 != 1:
                counts.update(t)
        total = sum(counts.values())
        for i, t in tokens.items():
            base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in t)
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
                zlib.crc32(str(i).encode()) % 5 == 1, len(t), sum(counts[w] > 0 for w in t), total)
            assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    held_out = [r for r in got.values() if r.held_out and r.doc_id >= len(own) - 120]
    assert len(held_out) > 10 and all(r.score > r.base_score for r in held_out)


def random_tables(seed, counts=None):
    rng = np.random.default_rng(seed)
    odds = rng.integers(-3000, 3000, lm._STARTS[-1]).astype(np.int16)
    gates = rng.integers(0, 4, lm._STARTS[lm.GATE + 1] - lm._STARTS[lm.GATE]).astype(np.uint8)
    return lm.Tables(lm.Code(np.ones(256) if counts is None else counts), odds, gates)


def test_scores_do_not_depend_on_the_other_texts():
    texts = ["ab abc", "b a", "", "abc été a", None, "x" * 700]
    model = random_tables(0, np.bincount(np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8), minlength=256))
    # The code is prefix-free and complete, so the decisions of a byte are a distribution over bytes.
    assert sum(2.0 ** -int(n) for n in model.code.length) == pytest.approx(1)
    scores, n = lm.score_texts(texts, model)
    alone = [lm.score_texts([t], model)[0][0] for t in texts]
    assert scores.tolist() == pytest.approx(alone, rel=1e-4) and n.tolist() == [8, 5, 1, 13, 1, 702]


def test_one_byte_is_a_distribution():
    model = random_tables(3)
    total = 0.0
    for byte in range(256):
        data = np.array([10, 10, 10, 10, 97, byte], np.uint8)
        size, branch, slots = lm.decisions(data, model.code, np.array([False] * 5 + [True]))
        slots = list(slots)
        tables = [model.odds[a:b] for a, b in zip(lm._STARTS[:-1], lm._STARTS[1:], strict=True)]
        x = [table[slot] / np.float32(lm.SCALE) for table, slot in zip(tables, slots, strict=True)]
        cost = lm.Mixer(1).read(x, model.gates[slots[lm.GATE]], branch.astype(np.float32), np.array([0, len(branch)]))
        total += float(np.exp(cost[0]))
    assert total == pytest.approx(1, abs=1e-4)


def test_long_texts_are_scored_in_windows(monkeypatch):
    rng = random.Random(6)
    texts = [prose(rng, 3000), "short"]
    model = random_tables(1)
    whole, n = lm.score_texts(texts, model)
    monkeypatch.setattr(lm, "WINDOW", 2000)
    parts, m = lm.score_texts(texts, model)
    assert n.tolist() == m.tolist() and parts[1] == pytest.approx(whole[1]) and parts[0] == pytest.approx(whole[0], rel=0.02)


def test_stream_bytes_and_counts_need_no_pass_over_the_tables(monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(40)) for _ in range(50)] + [None, "", "  A\tB\x0b\x1cÉé\n", "ZZ zz", "\r"]
    data, offsets, _ = lm.streams(texts)
    scored = lm._scored(data, offsets)
    expected = np.bincount(data[scored], minlength=256)
    assert (lm.stream_bytes(pa.array(texts)) == expected).all() and lm.stream_bytes(pa.array([], pa.string())).sum() == 0
    code = lm.Code(expected)
    tables = [np.zeros(2 << b, np.int32) for b in lm.SLOT_BITS]
    monkeypatch.setattr(lm, "BLOCK", 100)  # block borders inside words
    lm.count_into(tables, data, code, scored)
    _, branch, slots = lm.decisions(data, code, scored)
    for table, slot in zip(tables, slots, strict=True):
        assert (table == np.bincount(2 * slot.astype(np.int64) + branch, minlength=len(table))).all()


def test_equal_bytes_under_a_context_are_looked_up_once(monkeypatch):
    data, offsets, _ = lm.streams(["many words come often in texts of words"] * 300)
    scored = lm._scored(data, offsets)
    code = lm.Code(np.bincount(data, minlength=256))
    seen, looked_up = [], lm._decisions
    monkeypatch.setattr(lm, "_decisions", lambda *args: seen.append(len(args[2])) or looked_up(*args))
    tables = [np.zeros(2 << b, np.int32) for b in lm.SLOT_BITS]
    lm.count_into(tables, data, code, scored)
    assert sum(seen) <= len(tables) * offsets[1]
    assert all(t.sum() == code.length[data[scored]].sum() for t in tables)


def test_training_counts_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(60)) for _ in range(40)] + [None, "", "a", "long" * 8000]
    docs = docs_df(spark, texts).select("text").coalesce(1)
    whole = lm.train(docs).value
    for name, value in (("COUNTED", 20_000), ("GROUP", 300)):
        monkeypatch.setattr(lm, name, value)
    parts = lm.train(docs).value
    assert (whole.odds == parts.odds).all() and (whole.gates == parts.gates).all() and whole.odds.any()


def test_words_are_counted_beyond_what_a_task_holds(spark, monkeypatch):
    texts = [" ".join(f"w{i * j % 97}" for j in range(50)) for i in range(40)] + ["", None]
    docs = docs_df(spark, texts).select("text").coalesce(1)
    want = {tuple(r) for r in lm.word_counts(docs).collect()}
    monkeypatch.setattr(lm, "WORDS_HELD", 10)
    monkeypatch.setattr(lm, "WORD_ROWS", 7)
    assert {tuple(r) for r in lm.word_counts(docs).collect()} == want
    assert sum(n for _, n in want) == 40 * 50 + 42 and len(want) == 98


def test_mixing_takes_few_texts_of_like_length_at_a_time(monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(150)) for _ in range(90)] + ["", None, "x"]
    model = random_tables(5)
    sizes, read = [], lm.Mixer._read
    monkeypatch.setattr(lm.Mixer, "_read", lambda self, lanes, first, count, *rest: sizes.append(count) or read(self, lanes, first, count, *rest))
    scores, n = lm.score_texts(texts, model)
    assert max(map(len, sizes)) <= lm.LANES and (np.diff(np.concatenate(sizes)) <= 0).all()
    alone = [lm.score_texts([t], model) for t in texts]
    assert scores.tolist() == pytest.approx([float(s[0]) for s, _ in alone], rel=1e-6)
    assert n.tolist() == [int(b[0]) for _, b in alone]


def test_a_long_text_among_short_ones(monkeypatch):
    rng = random.Random(4)
    texts = ["short text", prose(rng, 900), None, prose(rng, 700), "another"]
    model = random_tables(6)
    monkeypatch.setattr(lm, "WINDOW", 1500)
    scores, _ = lm.score_texts(texts, model)
    alone = [float(lm.score_texts([t], model)[0][0]) for t in texts]
    assert scores.tolist() == pytest.approx(alone, rel=1e-6)


def test_packed_counters_add_up():
    rng = np.random.default_rng(1)
    total, want = None, np.zeros(100, np.int64)
    for kind, high in ((np.int32, 300), (np.int64, 2**40), (np.int64, 256), (np.int32, 2)):
        own = rng.integers(0, high, 100).astype(kind)
        want += own
        packed = sketch._packed(own)
        total = sketch._add_packed(total, packed)
        assert high > 2 or len(packed) == 8 + 100  # a byte for each small count
    assert (total == want).all()


# Fingerprints


def brute_phrases(data):
    known, low, out = set(), 0, 0
    for i in range(1, len(data) + 1):
        if data[low:i] not in known:
            known.add(data[low:i])
            low, out = i, out + 1
    return known, low < len(data)


def test_phrases_are_those_of_the_parse():
    for text in ("", "a", "aaaaaa", "abracadabra abracadabra", prose(random.Random(1), 80)):
        known, rest = brute_phrases(text.encode())
        got = fingerprint.phrase_hashes(text.encode()) if text else []
        assert len(got) == len(known) + rest and len(set(got)) == len(known)


def test_edited_fingerprints(spark, texts):
    own = [*texts[:30], None, "", "ab"]
    docs = clashing(docs_df(spark, own, [(3, own[3], "en", "s", 0), (None, "no id", "en", "s", 0)]), "id", "range", "lead")
    rows = sorted([*enumerate(own), (3, own[3])], key=lambda r: (-r[0], r[1] or "")) + [(None, "no id")]
    expected = collections.Counter()
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = text or "", following or ""
        changed = fingerprint.edited(text, following)
        own_print, other = (fingerprint.signature(t) for t in (text, changed))
        expected[(i, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint.as_text(own_print), fingerprint.as_text(other),
                  fingerprint.likeness(own_print, other), fingerprint.likeness(own_print, fingerprint.signature(following)))] += 1
    assert collections.Counter(tuple(r) for r in fingerprint.edited_fingerprints(docs).collect()) == expected
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert plain[0] == fingerprint.as_text(fingerprint.signature(own[0])) and plain[30] == plain[31] == ""


def test_fingerprints_tell_near_from_far():
    rng = random.Random(2)
    text, other = prose(rng, 400), prose(rng, 400, 10**6)
    near = fingerprint.edited(text, other)
    own = fingerprint.signature(text)
    assert fingerprint.likeness(own, fingerprint.signature(near)) > 0.4 > fingerprint.likeness(own, fingerprint.signature(other))


def test_fingerprints_of_few_rows(spark):
    docs = spark.createDataFrame([(1, "abc def ghi")], "doc_id long, text string")
    row = fingerprint.edited_fingerprints(docs).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()
    assert fingerprint.edited_fingerprints(docs.limit(0)).count() == 0


# Packing


def test_packing(spark, texts):
    own = [*texts, "İstanbul ΣΑΣ  don't\x85x  é é <|endoftext|>"]
    docs = clashing(docs_df(spark, own), "part", "nth", "ids", "place")
    packed = packing.pack(docs, TOKENIZER, capacity=512)
    rows = packed.collect()
    tool = Tokenizer.from_file(TOKENIZER)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 512
    total = 0
    for i, text in enumerate(own):
        ids = tool.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), 512))
        assert [t for r in pieces for t in r.ids] == ids
        total += len(ids)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by_sequence) <= -(-total // 512) + 2
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == total and len(whole) == len(by_sequence)
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_word_tokenizer_equals_the_library():
    pieces = [
        "a", "The", "don't", "IT'S", "é", "É", "ſ", "İ", "ŉ", "½", "ж", "日本", "e\u0301", "\u0301", "\U0001F600", "<", "<b>", "|",
        "<|endoftext|>", "<|EndOfText|>", "<|endof", "12", "!?", "\xa0", "\x1c", "\x85", "\0", " ", "  ", "\n", "\t", "\x0b",
    ]
    rng = random.Random(9)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(2000)] + [None, "", " "]
    tool, library = packing.WordTokenizer(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for _ in range(2):  # the second time from memory
        ids, offsets = tool.encode(texts)
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 1]
    assert tool.encode([])[1].tolist() == [0]


def test_word_tokenizer_remembers_parts_whatever_stands_beside_them(monkeypatch):
    rng = random.Random(10)
    names = list({"".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(60_000)})
    texts = [" ".join(f"{n}{mark}" for n in names) for mark in ("", ",", ".", "!", "?")]
    tool, learned = packing.WordTokenizer(TOKENIZER), []
    learn = tool._learn
    monkeypatch.setattr(tool, "_learn", lambda words: (learned.extend(words), learn(words)))
    first, _ = tool.encode(texts)
    again, _ = tool.encode(texts)
    assert (first == again).all() and len(learned) <= len(names) + 4
    monkeypatch.setattr(packing, "CACHE_PARTS", 100)
    assert (tool.encode(texts[:1])[0] == first[: len(tool.encode(texts[:1])[0])]).all()


def test_plan_places_every_length_once():
    rng = np.random.default_rng(4)
    lengths = np.minimum(4096, rng.lognormal(6, 1, 20_000).astype(int) + 1)
    histogram = np.bincount(lengths, minlength=4097)
    plan = packing.Plan(histogram, 4096)
    used = collections.Counter()
    for kind, n in plan.kinds:
        assert sum(kind) <= 4096
        used.update({k: c * n for k, c in collections.Counter(kind).items()})
    assert all(used[k] == histogram[k] for k in range(1, 4097))
    assert sum(n for _, n in plan.kinds) <= 1.002 * lengths.sum() / 4096 + 1


def test_nnls_solves_small_systems():
    a = np.array([[2.0, 1, 0], [0, 1, 1], [0, 0, 3]])
    assert packing.nnls(a, a @ np.array([1.0, 2, 0]), 3000) == pytest.approx([1, 2, 0], abs=1e-3)
    assert all(sum(p) == 12 and len(p) <= 3 for p in packing.patterns(12, 3)) and len(packing.patterns(12, 3)) == 19


# Chat


def test_chat_round_trip(spark):
    bad = f"{chat.STOP}{chat.START}assistant ok"
    rows = [
        (1, 0, "system", "be <|nice||>"), (1, 2, "assistant", bad), (1, 1, "user", "a<|\n<||"), (1, 4, "user", "tail"), (1, 3, "assistant", None),
        (2, 0, "user", "only"), (3, None, "assistant", "first"), (3, 1, "user\n\\n", "<"), (3, 2, "assistant", "<"), (3, 2, "assistant", "<"),
        (None, 0, "assistant", "x"), (4, 1, None, ""),
    ]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, example string")
    examples = chat.prefix_target_examples(table)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    by_conversation = collections.defaultdict(list)
    for conversation, turn, role, text in rows:
        by_conversation[conversation].append((-1 if turn is None else turn, role or "", text or ""))
    assert got.keys() == by_conversation.keys()
    for conversation, turns in by_conversation.items():
        turns.sort()
        all_turns = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conversation]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(all_turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = sorted((r for r in examples.collect() if r.conv_id == 1), key=lambda r: r.example)
    assert len(one) == 3 and chat.unescape(one[0].text[one[0].loss_start : one[0].loss_end]) == bad
    assert chat.parse_turns(one[0].text)[-1] == ("assistant", bad) and one[2].loss_start == one[2].loss_end
    assert got[1].formatted_chars == sum(len(r.text) for r in one)
    assert chat.read_back(chat.prefix_target_examples(table.limit(0))).count() == 0


# Licences


def test_licenses(spark):
    mit = licenses.TEXTS[0][1]
    shouted = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ,").replace("\n\n", "\n\n  ")
    own = [mit, shouted, f"intro line\n\n{mit}".replace("\n\nThe above", "\nThe above"), "Released under the MIT Licence", mit[:-9], None, "", "some text\nLicensed under CC BY-NC 4.0.\nmore",
           "©", "Licensed under the Apache License, Version 2.0."]
    docs = clashing(docs_df(spark, own), "licenses", "digest", "key", "row")
    got = {r.doc_id: (r.licenses, r.whole_license) for r in licenses.scan_licenses(docs).collect()}
    assert got[0] == got[1] == (["MIT"], "MIT") and got[3] == (["MIT"], "MIT")
    assert got[4] == got[5] == got[6] == got[8] == ([], None)
    assert got[7] == (["CC-BY-NC-4.0"], None) and got[9] == (["Apache-2.0"], "Apache-2.0")
    known = spark.createDataFrame([("A", "x y"), ("B", "X, y."), ("C", None)], "license_id string, text string")
    rows = docs_df(spark, ["X y", "a\n\nx\ny\n\nb"])
    got = {r.doc_id: (r.licenses, r.whole_license) for r in licenses.scan_licenses(rows, known).collect()}
    assert got == {0: (["A", "B"], "A"), 1: (["A", "B"], None)}
    assert licenses.scan_licenses(rows.limit(0), known).count() == 0


def test_titled_and_embedded_licenses(spark):
    mit = licenses.TEXTS[0][1]
    own = [f"MIT License\n\nCopyright (c) 2020 Somebody\n\n{mit}", f"intro line\n\n{mit}\n\nmore text",
           f"intro line\n\n{mit}".replace("\n\nThe above", "\nThe above"), f"intro\n\n{mit[:-9]}\n\nmore"]
    got = {r.doc_id: (r.licenses, r.whole_license) for r in licenses.scan_licenses(docs_df(spark, own)).collect()}
    assert got == {0: (["MIT"], "MIT"), 1: (["MIT"], None), 2: (["MIT"], None), 3: ([], None)}
    full = [(p.stem, p.read_text()) for p in sorted(licenses.FULL.glob("*.txt"))]
    got = [(r.whole_license, r.licenses) for r in licenses.scan_licenses(docs_df(spark, [t for _, t in full])).orderBy("doc_id").collect()]
    assert [w for w, _ in got] == [i for i, _ in full] and {"Apache-2.0", "GPL-3.0", "MPL-2.0"} <= {w for w, _ in got}


def test_licenses_with_other_line_ends(spark):
    """Every known text at many widths, against a lookup that compares all texts word by word."""
    known = [*licenses.TEXTS, *((p.stem, p.read_text()) for p in sorted(licenses.FULL.glob("*.txt")))]
    own = []
    for name, text in known:
        parts = re.split(r"\n\s*\n", text)
        widths = range(50, 101) if len(text) < 4000 else (50, 61, 72, 80, 93, 100)
        own += [(name, "\n\n".join(textwrap.fill(p, w) for p in parts)) for w in widths]
        own += [(name, "\n\n".join(textwrap.fill(p, w) if len(p) > 200 else p for p in parts)) for w in (60, 77, 90)]

    def words(text):  # all words but those of short paragraphs that begin as a copyright statement, and of titles
        kept = []
        for part in re.split(r"\n\s*\n", text.lower()):
            found = [license_texts.EQUIVALENT.get(w, w) for w in re.findall(r"[^\W_]+", part)]
            stated = re.match(r"[\s*#/-]*(copyright|\(c\)|©|all rights reserved)(\s|\W|\d|$)", part) and len(found) <= 30
            kept += [] if stated or " ".join(found) in license_texts.TITLES else found
        return tuple(kept)

    names = {}
    for name, text in known:
        names.setdefault(words(text), set()).add(name)
    found = {r.doc_id: r for r in licenses.scan_licenses(docs_df(spark, [t for _, t in own])).collect()}
    for i, (name, text) in enumerate(own):
        assert name in names[words(text)] and name in found[i].licenses and found[i].whole_license is not None, (name, i)


# Pages

BODY = "Running text that goes on for quite some time, with commas, and more words than any menu has. "
PAGES = [
    (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; T</h1><p><b>{BODY}<br><p>short.</p></article><footer>f</footer>", f"T & T\n{BODY.strip()}\nshort."),
    (f"<html><head><title>t</title><style>p{{}}</style></head><body><div class='ad'>buy</div><div id=x><h2>H</h2><p>{BODY}</p><p>end</p></div>"
     f"<div class='reader-comments'><p>{BODY}</p></div><form><input>go</form>", f"H\n{BODY.strip()}\nend"),
    (f"<main><p>{BODY}</p><aside>{BODY}</aside><p>last  &nbsp; words</p></main><script>var a = '<p>no</p>'</script>", f"{BODY.strip()}\nlast words"),
    (f"<ul><li><a href=1>one</a><li><a href=2>two</a></ul><hr><p>{BODY}</p><!-- <p>gone</p> --><hr><div class=cookie-notice>We use</div>", BODY.strip()),
    ("<article><p>tiny</article>", "tiny"), ("", ""), (None, ""), ("plain < text &lt;", "plain < text <"), ("<script>x", ""), ("<p>" * 2000 + "deep", "deep"),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html.extract(pages.limit(0)).count() == 0


def test_article_is_a_hint_and_long_blocks_hide_nothing():
    teaser = f"<article><h3>Read on</h3><p>More</p></article><div><p>{BODY}</p><p>{BODY}</p></div>"
    assert html.main_text(teaser) == f"{BODY.strip()}\n{BODY.strip()}"
    gap = "<div class=ad>buy</div>"
    assert html.main_text(f"<p>{BODY * 20}</p>{gap}<p>{BODY}</p>") == f"{(BODY * 20).strip()}\n{BODY.strip()}"


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(7)
    rows, labels = labelled(200, 10**6)
    benchmark = prose(rng, 20, 10**6)
    passage = prose(rng, 80, 10**6)
    start = prose(rng, 100, 10**6)
    extra = [(1000, start), (1001, start), (1002, start + " x"), (1003, f"{prose(rng, 50, 10**6)} {benchmark} {prose(rng, 20, 10**6)}"),
             (1004, f"{prose(rng, 60, 10**6)} {passage}"), (1005, f"{passage} {prose(rng, 60, 10**6)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [*rows, *extra]], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, benchmark)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept.append(spark.createDataFrame(out.collect(), out.schema))
        if len(kept) == 2:  # so few labels say little about the other documents: the next stages get them all
            good = {r.doc_id for r in kept.pop().collect()}
            kept.append(docs)
    assert len(good & {i for i, q, _ in labels if q}) >= 145 and len(good & {i for i, q, _ in labels if not q}) <= 12
    ids = [{r.doc_id for r in k.collect()} for k in kept]
    assert ids[1] - ids[2] == {1001, 1002} and ids[2] == ids[3] and ids[3] - ids[4] == {1003} and ids[4] == ids[5]
    final = {r.doc_id: r.text for r in kept[3].collect()}
    assert passage in final[1004] and len(final[1005]) < 60 * 9 + 80
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == good & ids[5]
