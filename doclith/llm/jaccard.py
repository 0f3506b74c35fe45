"""Similarity join of word shingle sets by rare-first prefix filtering.

Two documents link if their sets' Jaccard similarity is ``percent`` or more. With every set in one order, rare shingles
first, sets that link share a shingle among the first few of both (the prefix), their sizes are near each other
(length filter), what follows the first shared shingle is long enough (positional filter), and a lower bound of the
Hamming distance between what the two hold is small enough (suffix filter). The pairs that are left are verified, once
each, on the whole sets.

The suffix filter's bound comes from parity sketches: a bit a section of the hash range, one to two bits a shingle, says
whether the set has an odd number of shingles there. Where two sketches differ, the sets differ in a shingle at least. A
sketch is some forty times smaller than its set, so that sets travel only for pairs that are nearly sure to link. In the
last round shorter ones of a fixed size go with the entries, so that pairs too far apart are not made at all.

Equal sets are one class from the start. What is asked for is the classes' components, so two shortcuts lose nothing:
in a bucket (the classes with a given prefix shingle) all are first compared with one pivot, and pairs that are
already connected need no comparison. Only pairs of a bucket that are still apart after PIVOT_ROUNDS are compared all.

Frequencies are counted over the whole table, of words and of shingles that are repeated nearby (in a reader's block of
documents), in 2**WORD_BITS and 2**SHINGLE_BITS sections of their hashes. A shingle's rank is first how far its section
is above the mean, as one that many documents share is, and then the product of its words' frequencies. Any fixed order
is right; one nearer to the true frequencies makes fewer pairs. Words and shingles are compared by 64-bit hashes,
classes by 128 bits; a class's node is one half of these, and the other half where two classes share the first.

Defined cases: a text of fewer words than a shingle is one shingle; null and blank texts have no shingles and link with
nothing, themselves included; null ids take part, and a component of null ids alone has a null id; repeated rows are
one class; ids are of any type that has an order; equally rare shingles are in order of their hashes; a very long text
is a chunk of its own, and its sketch grows with it; further columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from mmap import mmap

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclith.llm import members
from doclith.llm.components import components
from doclith.llm.shared import Drafts, keep
from doclith.llm.text import packed
from doclith.llm.tokens import U, Words, chunks, lists, mix

WORD_BITS, SHINGLE_BITS = 17, 18
BLOCK = 1 << 21  # shingles in which repeated ones are found at once
STEP = 1 << 14  # of a block's shingles, or of sections, that are looked at or sent at once
MARK_WORDS = 8  # of the parities that go with the entries of the last round: 512 sections
PIVOT_ROUNDS = 2
TOKEN_BITS = 24  # of the set of shared tokens: 2 MB


def _section(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64)


def _ranks(seen: np.ndarray) -> np.ndarray:
    """Of sections, words' first and shingles' then: 16 * log2 of a word section's count, and steps of 2**12 for each
    doubling of a shingle section's count beyond twice the mean."""
    words, shingles = seen[: 1 << WORD_BITS], seen[1 << WORD_BITS :]
    return np.concatenate([(16 * np.log2(words + 1)).astype(np.int32), np.log2(1 + shingles / (2 * shingles.mean() + 1)).astype(np.int32) * 4096]).astype(np.int32)


def _sets(w: Words, k: int, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, in order of their hashes or of ranks and then their hashes, and the texts' bounds."""
    grams, at = w.grams(k)
    text = np.searchsorted(w.bounds, at, "right") - 1
    count = np.diff(w.bounds)
    rank = np.zeros(len(grams), np.int32)
    if ranks is not None:
        each = ranks[_section(w.hashes, WORD_BITS)]
        for j in range(k):
            rank += each[at + j]
        rank += ranks[_section(grams, SHINGLE_BITS) + (1 << WORD_BITS)]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        few = np.zeros(len(short), U)
        for j in range(k - 1):
            has = count[short] > j
            few[has] += w.hashes[w.bounds[short][has] + j] * U(2 * j + 3)
        grams = np.concatenate([grams, mix(few + count[short].astype(U))])
        text = np.concatenate([text, short])
        rank = np.concatenate([rank, np.zeros(len(short), np.int32)])
    order = np.lexsort((grams, rank, text))
    grams, text = grams[order], text[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[fresh], text[fresh]
    return grams, np.searchsorted(text, np.arange(len(count) + 1))


def _total(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _signatures(grams: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two of each set, 128 bits that equal sets share."""
    return [mix(_total(mix(grams ^ U(s)), bounds) + U(s)) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]


def _nodes(s1: np.ndarray, s2: np.ndarray, twins: np.ndarray) -> np.ndarray:
    """The classes' names: the first signature, or the second where other classes have that first one too."""
    return np.where(np.isin(s1, twins), s2, s1)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class _Frequencies:
    """Counts of word sections, and of the sections of shingles that are there twice or more in a block."""

    def __init__(self) -> None:
        self.seen = np.zeros((1 << WORD_BITS) + (1 << SHINGLE_BITS), np.int64)
        # The one array of a block's size: it is filled, sorted and read in place, and mapped, so that it goes with the task.
        self.block, self.held = np.frombuffer(mmap(-1, 8 * BLOCK), U), 0

    def add(self, words: np.ndarray, grams: np.ndarray) -> None:
        self.seen[: 1 << WORD_BITS] += np.bincount(_section(words, WORD_BITS), minlength=1 << WORD_BITS)
        while len(grams):
            taken = grams[: BLOCK - self.held]
            self.block[self.held : self.held + len(taken)] = taken
            self.held += len(taken)
            grams = grams[len(taken) :]
            if self.held == BLOCK:
                self.close()

    def close(self) -> None:
        grams, self.held = self.block[: self.held], 0
        grams.sort()
        again = np.zeros(len(grams), bool)
        again[1:] = grams[1:] == grams[:-1]
        again[:-1] |= again[1:]  # the first of equal ones too
        for a in range(0, len(grams), STEP):
            sections, times = np.unique(_section(grams[a : a + STEP][again[a : a + STEP]], SHINGLE_BITS), return_counts=True)
            self.seen[sections + (1 << WORD_BITS)] += times

    def batches(self, kind: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Rows (section, n), few at once: Spark holds a batch outside its heap, and what large ones leave there stays."""
        used = np.flatnonzero(self.seen)
        for a in range(0, len(used), STEP):
            part = used[a : a + STEP]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), kind), none, none, pa.array(self.seen[part]), none, none, pa.array(part.astype(np.int32))], names)


def _describe(k: int):
    """Rows of documents (key, a, b, n, s1, s2), then of sections (section, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, kind = ["key", "a", "b", "n", "s1", "s2", "section"], _Frequencies(), None
        for batch in batches:
            kind = batch.column(0).type
            for x, y, w in chunks(batch.column(1)):
                grams, bounds = _sets(w, k)
                counts.add(w.hashes, grams)
                s1, s2 = _signatures(grams, bounds)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(x, y - x) for i in (0, 2, 3)), pa.array(np.diff(bounds)), _long(s1), _long(s2), pa.nulls(y - x, pa.int32())], names)
        if kind is not None:
            counts.close()
            yield from counts.batches(kind, names)

    return run


def _prefixes(k: int, percent: int, ranks: np.ndarray, repeated: np.ndarray, twins: np.ndarray):
    """a, b, node, n, whether other rows may have the set, and the prefix of each document: its first shingles, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, w in chunks(batch.column(1)):
                grams, bounds = _sets(w, k, ranks)
                s1, s2 = _signatures(grams, bounds)
                n = np.diff(bounds)
                text = np.repeat(np.arange(len(n)), n)
                length = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                inside = np.arange(len(grams)) - bounds[text] < length[text]
                columns = [batch.column(i).slice(x, y - x) for i in (2, 3)]
                columns += [_long(_nodes(s1, s2, twins)), pa.array(n.astype(np.int32)), pa.array(members.may_hold(repeated, s1))]
                yield pa.RecordBatch.from_arrays([*columns, lists(grams[inside], np.concatenate([[0], np.cumsum(length)]))], ["a", "b", "node", "n", "repeated", "prefix"])

    return run


def _parities(grams: np.ndarray, bounds: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set whether an odd number of shingles falls into each of as many sections as ``bits`` says (a power of two,
    64 at least), as 64-bit words; and the sets' bounds in them."""
    first = np.concatenate([[0], np.cumsum(bits)])
    text = np.repeat(np.arange(len(bits)), np.diff(bounds))
    place = first[text] + (grams & (bits[text] - 1).astype(U)).astype(np.int64)
    odd = np.bincount(place, minlength=int(first[-1])) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U), first >> 6


def _sketches(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities in 64 sections, or in the power of two that is the set's size or more."""
    n = np.diff(bounds)
    return _parities(grams, bounds, np.left_shift(1, np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))))


def _marks(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities in MARK_WORDS * 64 sections, for sets of any size."""
    return _parities(grams, bounds, np.full(len(bounds) - 1, MARK_WORDS << 6))


def _whole_sets(k: int, wanted: np.ndarray, repeated: np.ndarray, twins: np.ndarray):
    """node, n, whether other rows may have the set, mark, sketch and shingles of the rows whose number ``a`` may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = members.may_hold(wanted, batch.column(2).to_numpy())
            for x, y, w in chunks(batch.column(1).filter(pa.array(asked))):
                grams, bounds = _sets(w, k)
                s1, s2 = _signatures(grams, bounds)
                columns = [_long(_nodes(s1, s2, twins)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(members.may_hold(repeated, s1))]
                yield pa.RecordBatch.from_arrays([*columns, lists(*_marks(grams, bounds)), lists(*_sketches(grams, bounds)), lists(grams, bounds)], ["node", "n", "repeated", "mark", "sketch", "shingles"])

    return run


def _least(percent: int, a: Column, b: Column) -> Column:
    """The shingles that sets of these sizes must share: percent * (a + b) / (100 + percent), rounded up."""
    return F.ceil((a + b) * percent / F.lit(100 + percent) - 1e-9)


def _may_link(percent: int, x: str = "", y: str = "o_") -> Column:
    """Length and positional filter of two entries (n, pos) with one shingle."""
    n, m, i, j = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}pos"), F.col(f"{y}pos")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (1 + F.least(n - i, m - j) >= _least(percent, n, m))


def _distance(p: Column, q: Column) -> Column:
    """A lower bound of the number of shingles that one set has and the other hasn't, from their sketches; 0 where one
    sketch is over twice the other. The longer one is folded: sections of the shorter are two of its own."""
    size = F.least(F.size(p), F.size(q))
    at = lambda x, i: F.when(F.size(x) > size, F.get(x, i).bitwiseXOR(F.get(x, i + size))).otherwise(F.get(x, i))
    apart = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda a, i: a + F.bit_count(at(p, i).bitwiseXOR(at(q, i))))
    return F.when(F.greatest(F.size(p), F.size(q)) <= 2 * size, apart).otherwise(0)


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that pass the suffix filter. Sketches travel here, no sets."""
    side = lambda c, x: members.filtered(sets.select(F.col("node").alias(c), F.col("n").alias(f"_n{x}"), F.col("sketch").alias(f"_s{x}")), c, members.collect(pairs, c))
    n = F.col("_nu") + F.col("_nv")
    both = pairs.join(side("u", "u"), "u").join(side("v", "v"), "v")
    return both.where(_distance(F.col("_su"), F.col("_sv")) <= n - 2 * _least(percent, F.col("_nu"), F.col("_nv"))).select("u", "v")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v of the pairs (u, v) that link. Sets of other rows are left out before the joins: there may be few pairs."""
    side = lambda c, x: members.filtered(sets.select(F.col("node").alias(c), F.col("shingles").alias(x)), c, members.collect(pairs, c))
    both = pairs.join(side("u", "s"), "u").join(side("v", "t"), "v")
    return both.where(F.size(F.array_intersect("s", "t")) >= _least(percent, F.size("s"), F.size("t"))).select("u", "v")


def _met(apart: DataFrame, others: DataFrame, percent: int, marked: bool = False) -> DataFrame:
    """Pairs (u, v) of entries that share a token with one of the others, v, aren't connected and may link. Where entries
    are marked, both sides are the same, each pair counts once and marks filter too: pairs that share many tokens and
    yet are too far apart would else be made at each of them."""
    others = others.select(F.col("token").alias("_token"), *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "pos", "label", *["mark"] * marked)))
    may = (F.col("label") != F.col("o_label")) & _may_link(percent)
    if marked:
        apart_by = sum((F.bit_count(F.get("mark", F.lit(i)).bitwiseXOR(F.get("o_mark", F.lit(i)))) for i in range(MARK_WORDS)), F.lit(0))
        may = (F.col("node") < F.col("o_node")) & may & (apart_by <= F.col("n") + F.col("o_n") - 2 * _least(percent, F.col("n"), F.col("o_n")))
    met = apart.join(others, (F.col("token") == F.col("_token")) & may)
    return met.select(F.col("node").alias("u"), F.col("o_node").alias("v")).distinct()


def _links(entries: DataFrame, sets: DataFrame, percent: int, drafts: Drafts) -> DataFrame:
    """Links (u, v) that connect whatever the classes' links connect. entries: token, node, n, pos, of shared tokens."""
    found = done = None
    apart = entries.withColumn("label", F.col("node"))
    for turn in range(PIVOT_ROUNDS + 1):
        # At first the pivot has the token earliest: it has the fewest shingles of its own, as an original among copies.
        order = F.struct(F.col("pos") if turn == 0 else F.lit(0).alias("pos"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", F.col("pos").alias("at"), "label")
        buckets = apart.groupBy("token").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.min(order).alias("_p")).where("_low < _high")
        if turn < PIVOT_ROUNDS:
            pairs = _met(apart, buckets.select("token", "_p.node", "_p.n", F.col("_p.at").alias("pos"), "_p.label"), percent)
        else:
            mixed = apart.join(buckets.select(F.col("token").alias("_in")), F.col("token") == F.col("_in"), "left_semi")
            marks = members.filtered(sets.select(F.col("node").alias("_of"), "mark"), "_of", members.collect(mixed, "node"))
            mixed = drafts.keep(mixed.join(marks, F.col("node") == F.col("_of")).drop("_of"), "jaccard-mixed")
            pairs = _met(mixed, mixed, percent, marked=True)
        if done is not None:
            pairs = pairs.join(done, (F.least("u", "v") == F.col("_a")) & (F.greatest("u", "v") == F.col("_b")), "left_anti")
        pairs = drafts.keep(pairs, "jaccard-pairs")
        both = pairs.select(F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b"))
        done = both if done is None else done.union(both)
        likely = drafts.keep(_likely(pairs, sets, percent), "jaccard-likely")
        more = drafts.keep(_verified(likely, sets, percent), "jaccard-links")
        found = more if found is None else found.union(more)
        if turn < PIVOT_ROUNDS and not more.isEmpty():
            label = components(found, drafts.keep).select(F.col("node").alias("_node"), F.col("component").alias("_label"))
            apart = drafts.keep(entries.join(label, F.col("node") == F.col("_node"), "left").select("token", "node", "n", "pos", F.coalesce("_label", "node").alias("label")), "jaccard-apart")
    return found


def _shared(entries: DataFrame, percent: int, drafts: Drafts) -> DataFrame:
    """The entries whose token another one has, and that can still link with one that has it.

    Of two entries with a token each is tested against the other, as sums less one's own tell the other's size and rest; of
    more, against the smallest size. Most tokens are in one set alone; their entries are left out before the join.
    """
    rest = F.col("n") - F.col("pos")
    bucket = entries.groupBy(F.col("token").alias("_token")).agg(F.count(F.lit(1)).alias("_m"), F.min("n").alias("_n"), F.sum("n").alias("_sizes"), F.sum(rest).alias("_rests")).where("_m > 1")
    bucket = drafts.keep(bucket, "jaccard-tokens")
    partner = F.greatest(F.col("_n"), F.ceil(F.col("n") * percent / F.lit(100.0) - 1e-9))
    size = F.col("_sizes") - F.col("n")
    pair = (100 * F.least("n", size) >= percent * F.greatest("n", size)) & (1 + F.least(rest, F.col("_rests") - rest) >= _least(percent, F.col("n"), size))
    may = (F.col("token") == F.col("_token")) & F.when(F.col("_m") == 2, pair).otherwise(1 + rest >= _least(percent, F.col("n"), partner))
    likely = members.filtered(entries, "token", members.collect(bucket, "_token", TOKEN_BITS))
    return drafts.keep(likely.join(bucket, may).select(*entries.columns), "jaccard-shared")


def _numbers(key: str, text: str) -> dict[str, Column]:
    """a and b: 128 bits that rows equal in key and text share."""
    key, text = F.col(key), F.col(text).cast("string")
    return {"a": F.xxhash64(key, text), "b": F.xxhash64(text, key, F.lit(1))}


def _entries(prefixes: DataFrame, kinds: DataFrame) -> DataFrame:
    """token, node, n, pos of one row of each class: only rows whose set may be there again are looked up."""
    first = kinds.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    taken = prefixes.where("repeated").join(first, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_semi")
    every = prefixes.where("NOT repeated").unionByName(taken).select("node", "n", F.posexplode("prefix").alias("at", "token"))
    return every.select("token", "node", "n", (F.col("at") + 1).alias("pos"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """key, n_shingles, component_id, a, b, kept_a, kept_b of every document.

    component_id is the smallest key of the component; a and b are the row's number, of key and text, and kept_a and
    kept_b that of the row with the component's smallest key.
    """
    spark = docs.sparkSession
    first, second = Drafts(spark), Drafts(spark)
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *(c.alias(name) for name, c in _numbers(key, text).items()))
    kind = plain.schema["key"].dataType.simpleString()
    told = keep(plain.mapInArrow(_describe(k), f"key {kind}, a long, b long, n long, s1 long, s2 long, section int"), "jaccard-sets")
    seen = np.zeros((1 << WORD_BITS) + (1 << SHINGLE_BITS), np.int64)
    by_section = told.where("section IS NOT NULL").groupBy("section").agg(F.sum("n").alias("n")).toArrow()  # as many rows as sections
    seen[by_section["section"].to_numpy()] = by_section["n"].to_numpy()
    del by_section
    rows = told.where("section IS NULL").drop("section")
    least = F.min(F.struct(F.col("key").isNull().alias("z"), "key", "a", "b"))
    kinds = rows.where("n > 0").groupBy("s1", "s2", "n").agg(least.alias("_m"), (F.count(F.lit(1)) > 1).alias("repeated"))
    kinds = keep(kinds.select("s1", "s2", "n", "repeated", F.col("_m.key").alias("key"), "_m.a", "_m.b"), "jaccard-classes")
    # Of 10**10 classes about three pairs share 64 bits.
    twins = np.array([r["s1"] for r in kinds.groupBy("s1").count().where("count > 1").select("s1").collect()], np.int64)
    kinds = kinds.withColumn("node", F.when(F.col("s1").isin(*map(int, twins)), F.col("s2")).otherwise(F.col("s1")) if len(twins) else F.col("s1"))
    twins, repeated = twins.view(U), members.collect(kinds.where("repeated"), "s1")
    prefixes = first.keep(plain.mapInArrow(_prefixes(k, percent, _ranks(seen), repeated, twins), "a long, b long, node long, n int, repeated boolean, prefix array<long>"), "jaccard-prefixes")
    entries = _shared(_entries(prefixes, kinds), percent, first)
    entries = second.keep(_shared(entries, percent, first).distinct(), "jaccard-entries")
    first.remove()
    asked = kinds.join(entries.select(F.col("node").alias("_node")), F.col("node") == F.col("_node"), "left_semi")
    wholes = second.keep(plain.mapInArrow(_whole_sets(k, members.collect(asked, "a"), repeated, twins), "node long, n int, repeated boolean, mark array<long>, sketch array<long>, shingles array<long>"), "jaccard-wholes")
    sets = wholes.where("NOT repeated").unionByName(second.keep(wholes.where("repeated").dropDuplicates(["node"]), "jaccard-repeated"))
    label = components(_links(entries, sets, percent, second)).select(F.col("node").alias("_node"), "component")
    second.remove()
    named = kinds.join(label, F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "node"))
    kept = named.groupBy("component").agg(least.alias("_m")).select("component", F.col("_m.key").alias("component_id"), F.col("_m.a").alias("kept_a"), F.col("_m.b").alias("kept_b"))
    named = named.join(kept, "component").select("s1", "s2", "n", "component_id", "kept_a", "kept_b")
    out = rows.join(named, ["s1", "s2", "n"], "left")
    own = lambda c, other: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col(other))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own("component_id", "key").alias("component_id"), "a", "b", own("kept_a", "a").alias("kept_a"), own("kept_b", "b").alias("kept_b"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """The input with one row of each component, that of the smallest key; of rows that are equal in key and text, one.

    Texts of rows that stay are moved only where a row may be there more than once.
    """
    found = keep(classes(docs, key, text, k, percent).where("n_shingles > 0").select("a", "b", "kept_a", "kept_b"), "jaccard-found")
    gone = (F.col("a") != F.col("kept_a")) | (F.col("b") != F.col("kept_b"))
    told = found.groupBy("a", "b").agg(F.bool_or(gone).alias("_gone"), F.count(F.lit(1)).alias("_n")).where("_gone OR _n > 1")
    told = keep(told.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "_gone"), "jaccard-told")
    own = docs.select(packed(docs), *(c.alias(name) for name, c in _numbers(key, text).items()))
    maybe = members.column("a", members.collect(told, "_a"))
    met = own.where(maybe).join(told, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    kept = own.where(~maybe).select("own").unionByName(met.where("_gone IS NULL").select("own"))
    if not told.where("NOT _gone").isEmpty():
        kept = kept.unionByName(met.where("NOT _gone").dropDuplicates(["a", "b"]).select("own"))
    return kept.select("own.*")


def oracle_sql(table: str = "documents", k: int = 3, percent: int = 90) -> str:
    """doc_id, n_shingles, component_id in DuckDB's SQL, by all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= {percent} * (a.n + b.n - m)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id
FROM d JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id"""
