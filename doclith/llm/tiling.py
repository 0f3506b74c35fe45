"""Benchmark decontamination by greedy string tiling.

A tile is a run of words, LEAST at least, that a document and a test item share; tiles overlap in neither. The longest
are marked first, so passages are found in whatever order the document has them. An item is covered by the share of
its words that tiles hold; a document that covers SHARE of an item is contaminated by it.

Tiles consist of seeds, windows of LEAST words. Documents keep the windows that may be seeds (a fixed-size set of the
benchmark's is sent to the readers), and a join on the seed's hash pairs documents and items; only the words inside
such windows travel, never texts. Words are compared by 64-bit hashes, capitals and punctuation ignored.

Tiles cover at most LEAST words for each of an item's windows that a document has, so that a contaminated document has a
known number of them: the windows are counted over all documents, and each item is looked up by its rarest only, all but
one less than that number. A phrase that many documents and items begin with pairs none of them. Of the pairs that are
left, those whose shared windows cover too little of the item are not tiled.

Defined cases: null and empty texts share nothing; an item of fewer than LEAST words is found where it is a document's
whole text; repeated rows are reported each, and so are items with equal text; of equally long matches that overlap the
one earlier in the document, and then in the item, is marked; a very long text sends its shared windows alone; a null id
is reported as null; further columns do not matter; an empty table on either side gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclith.llm import members
from doclith.llm.shared import keep
from doclith.llm.tokens import U, Words, chunks, lists, mix

LEAST = 4
SHARE = 0.5
LONGEST_FIRST = 32  # the first length that is searched for
_BASE = U(0x9E3779B97F4A7C15)


def _windows(words: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of the windows of that size in which all words are free, and where they start."""
    if len(words) < size:
        return np.zeros(0, U), np.zeros(0, int)
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[size:] == taken[:-size])
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), U)
        for j in range(size):
            total = total * _BASE + words[at + j]
    return total, at


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of hashes: (start in item, start in text, length), in the order of marking."""
    out, free = [], (np.ones(len(item), bool), np.ones(len(text), bool))
    size = max(least, min(LONGEST_FIRST, len(item)))
    while True:
        hashes, starts = _windows(item, free[0], size)
        order = np.argsort(hashes, kind="stable")
        hashes, starts = hashes[order], starts[order]
        there, at = _windows(text, free[1], size)
        left, right = np.searchsorted(hashes, there), np.searchsorted(hashes, there, "right")
        found = []
        for p, a, b in zip(at[right > left], left[right > left], right[right > left], strict=True):
            for q in starts[a:b]:
                if q and p and free[0][q - 1] and free[1][p - 1] and item[q - 1] == text[p - 1]:
                    continue  # a part of the match that starts one word before
                n = 0
                while q + n < len(item) and p + n < len(text) and free[0][q + n] and free[1][p + n] and item[q + n] == text[p + n]:
                    n += 1
                if n >= size:
                    found.append((-n, int(p), int(q)))
        longest = -min(found)[0] if found else 0
        if longest > 2 * size:
            size = longest
            continue
        again = False
        for n, p, q in sorted(found):
            if free[0][q : q - n].all() and free[1][p : p - n].all():
                free[0][q : q - n] = free[1][p : p - n] = False
                out.append((q, p, -n))
            else:
                again = True  # what the longer ones leave of it may still be long enough
        if again:
            continue
        if size == least:
            return out
        size = max(least, size // 2)


def _seeds(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of LEAST words and of whole texts that are shorter, and the word at which each starts."""
    hashes, at = w.grams(LEAST)
    count = np.diff(w.bounds)
    short = np.flatnonzero((count > 0) & (count < LEAST))
    if len(short):
        first = w.bounds[short]
        total = count[short].astype(U)
        for j in range(LEAST - 1):
            has = count[short] > j
            total[has] += mix(w.hashes[first[has] + j] + U(j + 1))
        hashes, at = np.concatenate([hashes, mix(total)]), np.concatenate([at, first])
        order = np.argsort(at, kind="stable")
        hashes, at = hashes[order], at[order]
    return hashes, at


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in chunks(batch.column(1), letters=True):
            hashes, at = _seeds(w)
            bounds = np.searchsorted(at, w.bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists(w.hashes, w.bounds), lists(hashes, bounds)], ["_row", "_words", "_seeds"])


def _likely(seeds: np.ndarray):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in chunks(batch.column(1), letters=True):
                hashes, at = _seeds(w)
                hit = members.may_hold(seeds, hashes)
                hashes, at = hashes[hit], at[hit]
                if not len(at):
                    continue
                inside = np.zeros(len(w.hashes) + LEAST, bool)
                last = w.bounds[np.searchsorted(w.bounds, at, "right")]
                for j in range(LEAST):
                    inside[np.minimum(at + j, last - 1)] = True
                words = np.flatnonzero(inside)
                text = np.searchsorted(w.bounds, at, "right") - 1
                rows = np.unique(text)
                cut = lambda x: np.append(np.searchsorted(x, w.bounds[rows]), len(x))  # noqa: B023, E731
                places = words - np.repeat(w.bounds[rows], np.diff(cut(words)))
                columns = [batch.column(0).slice(a, b - a).take(pa.array(rows)), lists(places.view(U), cut(words)), lists(w.hashes[words], cut(words)), lists(hashes, cut(at))]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "_at", "_words", "_seeds"])

    return find


def _spread(at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The words with a mark wherever some are left out, so that no tile spans a gap."""
    gaps = np.flatnonzero(np.diff(at) != 1) + 1
    return np.insert(words.view(U), gaps, mix(np.arange(len(gaps), dtype=U) + U(1)) if len(gaps) else [])


def _reach(item: np.ndarray, text: np.ndarray) -> float:
    """The share of the item's words that are in a window that the text has: tiles cover no more."""
    (a, at), (b, _) = (_windows(x, np.ones(len(x), bool), LEAST) for x in (item, text))
    inside = np.zeros(len(item) + LEAST, bool)
    for j in range(LEAST):
        inside[at[np.isin(a, b)] + j] = True
    return inside.sum() / len(item)


def _cover(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            found = []
            for i in range(batch.num_rows):
                item, at, text = (get(c)[i].values.to_numpy(zero_copy_only=False) for c in ("_item_words", "_at", "_words"))
                item, text = item.view(U), _spread(at, text)
                if len(item) < LEAST:
                    made = [(0, 0, len(item))] if np.array_equal(item, text) else []
                else:
                    made = tiles(item, text) if _reach(item, text) >= share else []
                found.append((sum(t[2] for t in made) / len(item), len(made), max((t[2] for t in made), default=0)))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([get("_row"), get("item_id"), pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["_row", "item_id", "coverage", "n_tiles", "longest_tile"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """key, item_id, coverage, n_tiles, longest_tile of each document and item that it contains."""
    items = keep(benchmark.select(F.col(item).cast("long").alias("_row"), F.col(item_text)).mapInArrow(_item_words, "_row long, _words array<long>, _seeds array<long>"), "tiling-items")
    items = items.where(F.size("_words") > 0).select(F.monotonically_increasing_id().alias("_item"), F.col("_row").alias("item_id"), F.col("_words").alias("_item_words"), "_seeds")
    items = keep(items, "tiling-tests")
    seeds = items.select("_item", F.size("_item_words").alias("_size"), F.explode("_seeds").alias("_seed")).groupBy("_item", "_size", "_seed").agg(F.count(F.lit(1)).alias("_times"))
    # The row number is written with the rows, once: later steps can't see another one.
    numbered = docs.select(F.struct(F.monotonically_increasing_id().alias("n"), F.col(key).alias("key")).alias("_row"), F.col(text).cast("string"))
    kind = numbered.schema["_row"].dataType.simpleString()
    hits = keep(numbered.mapInArrow(_likely(members.collect(seeds, "_seed")), f"_row {kind}, _at array<long>, _words array<long>, _seeds array<long>"), "tiling-hits")
    there = hits.select("_row.n", F.explode(F.array_distinct("_seeds")).alias("_seed"))
    # All that follows of items has a row a window of the benchmark at most.
    often = there.groupBy(F.col("_seed").alias("_s")).agg(F.count(F.lit(1)).alias("_often"))
    common = Window.partitionBy("_item").orderBy(F.desc("_often"), "_seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = F.ceil(F.col("_size") * F.lit(share) / LEAST - 1e-9)
    rare = seeds.join(often, F.col("_seed") == F.col("_s")).withColumn("_upto", F.sum("_times").over(common)).where(F.col("_upto") >= needed)
    met = there.join(keep(rare.select("_item", "_seed"), "tiling-rare"), "_seed").select("n", "_item").distinct()
    both = met.join(hits.select("_row.n", "_row", "_at", "_words"), "n").join(items.select("_item", "item_id", "_item_words"), "_item")
    out = both.select("_row", "item_id", "_item_words", "_at", "_words").mapInArrow(_cover(share), f"_row {kind}, item_id long, coverage double, n_tiles int, longest_tile int")
    return out.where(F.col("coverage") >= share).select(F.col("_row.key").alias(key), "item_id", "coverage", "n_tiles", "longest_tile")
