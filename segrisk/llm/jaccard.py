"""N-gram Jaccard join: prefix filters under several global token orders, intersected, then exact verification.

The tokens of a document are its distinct word shingles. Under any order of all tokens, two sets with a Jaccard
similarity of at least t share a token among the first ``n - ceil(t * n) + 1`` of each (n: the set's size). So a pair
is a candidate only if it shares such a prefix token under each of ``ORDERS`` orders, at places in the two prefixes
that leave enough tokens behind. All orders put rare tokens first, so that passages many documents share stay outside
the prefixes; tokens of one rarity are ordered by a hash, another one for each order. Tokens are counted over all
documents. Those in one document only come first, as far as a bitmap of all others tells, whose size grows with their
number; the others are ordered by a sketch of their counts. Any function of a token is a valid order, so an estimate
costs no links.

Documents with equal sets are one class, which takes part once. The prefix tokens of the first order are dealt out
into buckets, one for all tokens that the same classes share. Pairs are never written as rows: classes that buckets
connect form groups, small groups are bundled, large ones dealt into blocks of bounded size, and each task gets the
whole texts of a bundle or of two blocks. It applies the filters of all orders, intersects them, and verifies what is
left, each pair in exactly one task. ``similar_groups`` takes from a task, for each class, the number of its links and
the smallest class they reach; ``links`` and ``link_counts`` take the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrisk.llm.components import connected_components
from segrisk.llm.sketch import BLOCKS, bitmap, in_bitmap, partial_blocks, sum_blocks
from segrisk.llm.text import LOWER, NOT_SPACE, chain, mix, slices, span_hashes, utf8, words
from segrisk.session import materialise, temporary

SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 12  # counters per row of a partial sketch
LEAST_BITS, MOST_BITS = 20, 30  # of the bitmap of tokens that several documents have
BITS_PER_TOKEN = 8
ORDERS = 3
BLOCK_SETS = 1024  # sets in a block, and their tokens
BLOCK_TOKENS = 800_000
BITMAP_BITS = 26
VERIFY_TOKENS = 1 << 20  # tokens compared with a set at a time
BUCKET = ["size", "x", "y"]
CLASS = "xxhash64(n_shingles, d1, d2) AS class"  # documents with equal sets
BROADCAST_IDS = 1_000_000  # candidate ids are broadcast up to this number, joined by a shuffle beyond it

_SALTS = [np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]
_DIGEST_SALTS = _SALTS[2:]


def _order_salt(order: int) -> np.uint64:
    return mix(np.array([_SALTS[0] + np.uint64(order)]))[0]


@dataclass(frozen=True)
class Rule:
    """Shingles of ``size`` words; documents link when 100 * intersection >= percent * union."""

    size: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a text of fewer words is one shingle, without words none."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets, NOT_SPACE)
    ids = span_hashes(data, starts, ends)
    shingles = chain(ids, size)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(shingles[a : b - size + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        else:
            yield chain(ids[a:b], b - a)[:1] if b > a else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Rarity:
    """Which tokens are in several documents (a bitmap), and a byte per counter: how often tokens of that counter occur,
    on a logarithmic scale."""

    repeated: np.ndarray
    levels: np.ndarray

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """0 for tokens in one document, more for more frequent ones."""
        level = self.levels[(tokens & np.uint64(len(self.levels) - 1)).astype(np.int64)].astype(np.uint64)
        return np.where(in_bitmap(self.repeated, tokens), level, np.uint64(0))


def repeated_tokens(docs: DataFrame, size: int) -> DataFrame:
    """(token, n) of the tokens that several documents have."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [*shingle_sets(part.column("text"), size), np.zeros(0, np.uint64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])

    tokens = docs.select("text").mapInArrow(work, "token long")
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def count_rarity(docs: DataFrame, size: int) -> Broadcast:
    """The ``Rarity`` of all tokens. Only its two tables go through the driver, 2 ** MOST_BITS bits at most."""
    repeated = materialise(repeated_tokens(docs, size), "repeated_tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            slot = batch.column("token").to_numpy() & ((1 << SKETCH_BITS) - 1)
            np.add.at(counters, slot, batch.column("n").to_numpy())
        yield from partial_blocks(counters, SKETCH_BLOCK)

    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in sum_blocks(repeated.mapInArrow(count, BLOCKS)).toLocalIterator():
        values = np.frombuffer(row["values"], np.int64)
        levels[row["block"] * SKETCH_BLOCK :][: len(values)] = np.log2(values + 1)
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_TOKEN * repeated.count()).bit_length()))
    found = bitmap(repeated.select("token"), bits)
    rarity = Rarity(found.value, levels)
    found.unpersist()
    return docs.sparkSession.sparkContext.broadcast(rarity)


def prefix_of(tokens: np.ndarray, rarity: Rarity, n: int, order: int = 0) -> np.ndarray:
    """The first ``n`` tokens under a global order: rarer ones first, then by the hash of the order."""
    key = mix(tokens ^ _order_salt(order)) >> np.uint64(8)
    key |= rarity.of(tokens) << np.uint64(56)
    return tokens[np.argsort(key)[:n]]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    out = []
    for salt in _DIGEST_SALTS:
        out.append(pa.array(np.array([mix(s ^ salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)))
    return out


def prefixes(docs: DataFrame, rule: Rule, rarity: Broadcast) -> DataFrame:
    """(doc_id, text_id, n_shingles, d1, d2, prefix) per row: set size, digest of the set, prefix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column("text"), rule.size))
                first = [prefix_of(s, rarity.value, rule.prefix(len(s))) if len(s) else s for s in sets]
                size = pa.array([len(s) for s in sets], pa.int64())
                arrays = [part.column("doc_id"), part.column("text_id"), size, *_digests(sets), _lists(first)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_id", "n_shingles", "d1", "d2", "prefix"])

    return docs.mapInArrow(work, "doc_id long, text_id long, n_shingles long, d1 long, d2 long, prefix array<long>")


def _shared_tokens(sets: DataFrame, known: Broadcast) -> DataFrame:
    """(class, n, token) of the prefix tokens whose slot is set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            token = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), size)
            keep = in_bitmap(known.value, token.view(np.uint64))
            own = batch.select(["class", "n_shingles"]).take(pa.array(row[keep]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(token[keep])], names=["class", "n", "token"])

    return sets.select("class", "n_shingles", "prefix").mapInArrow(work, "class long, n long, token long")


def _groups(buckets: DataFrame, rule: Rule) -> DataFrame:
    """(id, component): classes that may link, directly or over others, are in one component.

    A bucket is cut into bands of sizes so wide that sets of similar sizes are in one band or in neighbouring ones. All
    members of a band are tied to its smallest class, and that to the one of the next band.
    """
    lows = materialise(buckets.groupBy(*BUCKET, "band").agg(F.min("class").alias("low")), "bands")
    ties = buckets.join(lows, [*BUCKET, "band"]).select("class", "low")
    above = lows.select(*BUCKET, (F.col("band") - 1).alias("band"), F.col("low").alias("next"))
    ties = ties.union(lows.join(above, [*BUCKET, "band"]).select("low", "next"))
    return connected_components(ties.toDF("a", "b").where("a <> b").distinct())


def _tasks(buckets: DataFrame, rule: Rule) -> DataFrame:
    """(large, part, low, high, class, side): which classes a task needs.

    A task compares the classes of a bundle of groups, or those of two blocks ``low`` and ``high`` of a large group
    (``side`` 0 and 1), as far as they are in a bucket with members of the other block.
    """
    parts = _groups(buckets, rule).join(buckets.select("class", "n").distinct(), F.col("id") == F.col("class"))
    parts = materialise(parts.select("class", "n", "component"), "grouped_classes")
    load = F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)
    loads = materialise(parts.groupBy("component").agg(load.alias("load")), "group_loads")
    bundles = max(1, math.ceil(loads.where("load <= 1").agg(F.sum("load")).head()[0] or 0))
    place = parts.join(loads, "component")
    none = F.lit(0).cast("long")
    bundled = place.where("load <= 1").select(
        F.lit(False).alias("large"), F.expr(f"pmod(xxhash64(component), {bundles}L)").alias("part"), none.alias("low"),
        none.alias("high"), "class", F.lit(0).alias("side"),
    )
    block = F.expr("pmod(xxhash64(class), cast(ceil(load) AS bigint))").alias("block")
    dealt = place.where("load > 1").select("class", "component", block)
    dealt = materialise(buckets.join(dealt, "class").select(*BUCKET, "band", "component", "block", "class"), "dealt")
    here = dealt.groupBy(*BUCKET, "band", "component", "block").agg(F.count(F.lit(1)).alias("number"))
    # Of each block that a bucket has members in, a member meets those in its own and the neighbouring bands.
    near = here.select(*BUCKET, F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band"), F.col("block").alias("other"), F.col("band").alias("own"), "number")
    met = dealt.join(near, [*BUCKET, "band"]).where("other <> block OR own <> band OR number > 1")
    pairs = met.select(
        F.lit(True).alias("large"), F.col("component").alias("part"), F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"), "class", (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    return bundled.union(pairs.distinct())


def shared_prefixes(sets: list[np.ndarray], rule: Rule, rarity: Rarity, order: int) -> np.ndarray:
    """Matrix of the pairs (i < j) that share a prefix token under an order and may link by sizes and positions."""
    heads = [prefix_of(s, rarity, rule.prefix(len(s)), order) for s in sets]
    size = np.array([len(h) for h in heads], np.int64)
    n = np.array([len(s) for s in sets], np.int64)
    token = np.concatenate([*heads, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), size)
    left = n[owner] - (np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size))
    by_token = np.argsort(token, kind="stable")
    token, owner, left = token[by_token], owner[by_token], left[by_token]
    shared = np.zeros((len(sets), len(sets)), bool)
    at, step = np.arange(len(token)), 1
    while len(at := at[at + step < len(token)]) and len(at := at[token[at + step] == token[at]]):
        a, b = owner[at], owner[at + step]
        ok = 100 * np.minimum(n[a], n[b]) >= rule.percent * np.maximum(n[a], n[b])
        # What may still follow the shared token has to suffice.
        ok &= np.minimum(left[at], left[at + step]) * (100 + rule.percent) >= rule.percent * (n[a] + n[b])
        shared[a[ok], b[ok]] = True
        step += 1
    return shared


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, rule: Rule, rarity: Rarity) -> tuple[np.ndarray, np.ndarray]:
    """All similar pairs (i < j); if there are two sides, only those between them."""
    found = shared_prefixes(sets, rule, rarity, 0)
    if side.any():
        found &= side[:, None] != side
    for order in range(1, ORDERS):
        if found.any():
            found &= shared_prefixes(sets, rule, rarity, order)
    a, b = np.nonzero(found)
    keep = np.zeros(len(a), bool)
    cuts = np.flatnonzero(np.diff(a)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)], strict=True):
        # Sets of one length after the other, some millions of tokens at a time.
        step = max(1, VERIFY_TOKENS // max((len(sets[i]) for i in b[low:high]), default=1))
        for at in range(low, high, step):
            own, others = sets[a[at]], [sets[i] for i in b[at : min(at + step, high)]]
            size = np.array([len(s) for s in others])
            values = np.concatenate(others)
            hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
            common = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
            keep[at : at + len(size)] = 100 * common >= rule.percent * (len(own) + size - common)
    return a[keep], b[keep]


def _smallest_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that the links reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(texts: DataFrame, rule: Rule, rarity: Broadcast, every: bool) -> DataFrame:
    """(a, b, n): all links between classes, n being 1, or from each task one row for each class that has links in it:
    the class, the smallest class they reach, and their number.

    ``texts`` are the rows of ``_tasks`` with a text of the class, and may repeat. Texts are shorter than their sets,
    so they are what is sent to the tasks.
    """

    def work(rows: pa.Table) -> pa.Table:
        _, first = np.unique(rows.column("class").to_numpy(), return_index=True)
        rows = rows.take(pa.array(first))
        batches = rows.select(["text"]).combine_chunks().to_batches()
        own = [s for batch in batches for part in slices(batch, "text") for s in shingle_sets(part.column("text"), rule.size)]
        a, b = similar_pairs(own, rows.column("side").to_numpy(), rule, rarity.value)
        n = np.ones(len(a), np.int64)
        if not every:
            number = np.bincount(np.concatenate((a, b)), minlength=len(own))
            reached = _smallest_reached(a, b, len(own))
            a = np.flatnonzero(number)
            b, n = reached[a], number[a]
        ids = rows.column("class").combine_chunks()
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "n": pa.array(n)})

    columns = ["large", "part", "low", "high", "class", "side", "text"]
    return texts.select(*columns).groupBy("large", "part", "low", "high").applyInArrow(work, "a long, b long, n long")


@dataclass(frozen=True)
class Join:
    """Result of the join: ``base`` (doc_id, n_shingles, class) per row, ``members`` (class, doc_id, rep) and ``links``
    (a, b, n) between classes, as ``verified`` returns them. ``rep`` is the smallest doc_id of a class."""

    base: DataFrame
    members: DataFrame
    links: DataFrame

    def by_document(self) -> DataFrame:
        """The links (a, b) between the representatives of classes."""
        rep = self.members.where("doc_id = rep")
        found = self.links
        for end in "ab":
            own = rep.select(F.col("class").alias(end), F.col("rep").alias(f"{end}_rep"))
            found = found.join(own, end)
        low, high = F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")
        return found.select(low, high).where("a <> b").distinct()


def join(docs: DataFrame, rule: Rule = Rule(), *, every: bool = True) -> Join:
    """The join of all documents, with ``every`` link or what ``verified`` sums up of them."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.withColumn("text_id", F.xxhash64("text"))
    with temporary(docs.sparkSession) as keep:
        rarity = count_rarity(docs, rule.size)
        rows = prefixes(docs, rule, rarity).select("doc_id", "text_id", "n_shingles", "prefix", F.expr(CLASS))
        rows = materialise(rows, "prefixes")
        base = keep(rows.select("doc_id", "n_shingles", "class"), "sets")
        named = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
        first = named.groupBy("class").agg(F.min(F.struct("doc_id", "text_id")).alias("row")).select("class", "row.*")
        first = materialise(first, "classes")
        rep = first.select("class", F.col("doc_id").alias("rep"))
        members = keep(named.select("class", "doc_id").distinct().join(rep, "class"), "members")
        tasks = _tasks(_buckets(named, first, rule), rule).join(first, "class")
        texts = docs.join(_broadcastable(materialise(tasks, "tasks")), ["doc_id", "text_id"])
        return Join(base, members, keep(verified(texts, rule, rarity, every), "links"))


def _buckets(named: DataFrame, first: DataFrame, rule: Rule) -> DataFrame:
    """(size, x, y, class, n, band) of the buckets that several classes are in; size, x and y name a bucket."""
    own = named.join(first, ["class", "doc_id", "text_id"], "left_semi")
    tokens = named.select("class", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    shared = materialise(shared.where("low <> high").select("token"), "shared_tokens")
    at = _shared_tokens(own, bitmap(shared, BITMAP_BITS)).join(shared, "token").distinct()
    at = materialise(at, "shared_prefixes")
    alike = at.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("class")).alias("x"),
        F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"),
    )
    band = F.floor(F.log("n") / (math.log(100 / rule.percent) + 1e-6)).alias("band")
    buckets = at.join(alike, "token").select(*BUCKET, "class", "n", band).distinct()
    return materialise(buckets, "buckets")


def links(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(a, b), a < b: all links between documents with different sets, each set named by its smallest doc_id.

    Documents with equal sets link with each other and have the same links, which are not written out.
    """
    return join(docs, rule).by_document()


def link_counts(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_links) per doc_id with shingles: with how many other documents it links, copies counted.

    A document whose rows have several sets links if any of them does, and counts once.
    """
    found = join(docs, rule)
    several = found.members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    single = materialise(found.members.join(several, "doc_id", "left_anti").select("doc_id", "class"), "single_sets")
    several = materialise(found.members.join(several, "doc_id", "left_semi").select("doc_id", "class"), "several_sets")
    one = F.lit(None).cast("long").alias("doc_id")
    around = found.links.select("a", "b").union(found.links.select("b", "a"))
    around = around.union(found.members.select("class", "class").distinct()).toDF("class", "other")
    # Documents of one set count by class, those of several sets by themselves.
    owner = single.select("class", one).distinct().withColumn("owner", F.col("class")).union(several.withColumn("owner", F.lit(None).cast("long")).select("class", "doc_id", "owner"))
    near = owner.join(around, "class").select("owner", "doc_id", "other").distinct()
    near = materialise(near, "linked_classes")
    sizes = single.groupBy("class").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("class", "other")
    by_class = near.join(sizes, "other").groupBy("owner", "doc_id").agg(F.sum("n").alias("n"))
    others = several.select(F.col("class").alias("other"), F.col("doc_id").alias("whole"))
    by_doc = near.join(others, "other").groupBy("owner", "doc_id").agg(F.count_distinct("whole").alias("n"))
    total = by_class.union(by_doc).groupBy("owner", "doc_id").agg((F.sum("n") - 1).alias("n_links"))
    alone = single.join(total.where("doc_id IS NULL").select(F.col("owner").alias("class"), "n_links"), "class")
    return alone.select("doc_id", "n_links").union(total.where("doc_id IS NOT NULL").select("doc_id", "n_links"))


def similar_groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per document row.

    component_id is the smallest doc_id that links reach; n_links is the number of other sets that the row's set links
    with, all copies of a set counted once. Texts without words, NULL and empty ones too, have no shingles and link
    with nothing. Rows of one doc_id are one document to links, which hold if any of its rows holds. Rows without
    doc_id are returned with component_id NULL and link nothing. Other columns are ignored.
    """
    with temporary(docs.sparkSession) as keep:
        found = join(docs, rule, every=False)
        copies = found.members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        parts = connected_components(found.by_document().union(copies))
        number = found.links.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n_links"))
        linked = found.members.select("doc_id", "class").join(number, "class")
        rows = found.base.join(parts, found.base.doc_id == parts.id, "left").join(linked, ["doc_id", "class"], "left")
        n_links = F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
        return keep(rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), n_links), "groups")


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents without the near copies: one row, that of the smallest doc_id, of each group.

    Texts without words are no copies of each other and stay; so do rows without doc_id. Of several rows with the
    smallest doc_id the one with the smallest text stays.
    """
    with temporary(docs.sparkSession) as keep:
        groups = similar_groups(docs, rule)
        gone = keep(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
        repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        repeated = keep(repeated.select("doc_id"), "repeated_ids")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = docs.join(_broadcastable(gone.union(repeated)), "doc_id", "left_anti").select(*columns)
    if repeated.isEmpty():
        return single
    several = docs.join(_broadcastable(repeated.join(gone, "doc_id", "left_anti")), "doc_id", "left_semi")
    row = F.min_by(F.struct(*columns), F.coalesce("text", F.lit("")))
    return single.unionByName(several.groupBy("doc_id").agg(row.alias("row")).select("row.*"))


def _broadcastable(ids: DataFrame) -> DataFrame:
    """Ids to be joined with texts: broadcast up to ``BROADCAST_IDS`` of them."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
