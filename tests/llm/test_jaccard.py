"""The similarity join's own parts: sketches, names of classes, ids of any type, large groups of near copies."""

from __future__ import annotations

import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from doclith.llm import jaccard, members, shared  # noqa: E402


def test_sketches_never_overstate_the_distance(spark):
    chance = np.random.default_rng(3)
    rows, truth = [], []
    for size in (1, 3, 60, 64, 65, 120, 130, 700, 5000):
        for edits in (0, 1, 5, size // 5):
            a = chance.integers(0, 1 << 63, size, dtype=np.uint64)
            b = np.concatenate([a[edits:], chance.integers(0, 1 << 63, chance.integers(0, edits + 1), dtype=np.uint64)])
            words, bounds = jaccard._sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            rows.append((len(rows), *([int(x) for x in words[s:e].view(np.int64)] for s, e in zip(bounds[:-1], bounds[1:], strict=True))))
            truth.append((len(set(a) ^ set(b)), len(a), len(b)))
    found = spark.createDataFrame(rows, "i int, p array<long>, q array<long>").select("i", jaccard._distance(F.col("p"), F.col("q")).alias("d"), jaccard._distance(F.col("q"), F.col("p")).alias("e")).collect()
    for r in found:
        apart, n, m = truth[r.i]
        assert r.d == r.e and r.d <= apart and (apart or not r.d)
        assert 3 * r.d >= apart or apart * 4 > min(n, m) or min(n, m) <= 64  # and it is near it where sets are alike


def test_sketches_tell_sets_apart(spark):
    words, bounds = jaccard._sketches(np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64), np.array([0, 2000, 4000]))
    p, q = ([int(x) for x in words[s:e].view(np.int64)] for s, e in zip(bounds[:-1], bounds[1:], strict=True))
    (r,) = spark.createDataFrame([(p, q)], "p array<long>, q array<long>").select(jaccard._distance(F.col("p"), F.col("q")).alias("d")).collect()
    assert len(p) == 32 and r.d > 0.222 * 4000 / 2  # what 80 percent allows


def test_names_of_classes_that_share_half_their_signature():
    s1, s2 = np.array([5, 7, 5, 9], np.uint64), np.array([1, 2, 3, 4], np.uint64)
    assert jaccard._nodes(s1, s2, np.array([5], np.uint64)).tolist() == [1, 7, 3, 9]
    assert jaccard._nodes(s1, s2, np.zeros(0, np.uint64)).tolist() == [5, 7, 5, 9]


def test_ids_of_any_type(spark):
    rows = [("b", "one two three four"), ("a", "one two three four"), ("c", "another text of its own"), (None, "one two three four")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.classes(df).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "c"), (None, "a")}
    assert {r.doc_id for r in jaccard.deduplicate(df).collect()} == {"a", "c"}


def test_hot_groups(spark):
    """Hundreds of exact and of near copies, a passage in many documents, and chains: the plain version's components."""
    chance = random.Random(8)
    word = lambda: f"w{chance.randrange(4000)}"
    base, passage = [word() for _ in range(80)], " ".join(word() for _ in range(60))
    rows = [(i, " ".join(base)) for i in range(150)]
    for i in range(150, 320):
        text = list(base)
        text[chance.randrange(80)] = word()
        rows.append((i, " ".join(text)))
    rows += [(i, f"{passage} {' '.join(word() for _ in range(chance.randrange(4, 40)))}") for i in range(320, 420)]
    chain = [word() for _ in range(70)]
    for i in range(420, 440):
        chain[chance.randrange(70)] = word()
        rows.append((i, " ".join(chain)))
    chance.shuffle(rows)
    for k, percent in ((3, 90), (5, 80)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df, k=k, percent=percent).collect()}
        assert got == plain.components(rows, k, percent)


def test_memory_of_executors(spark, tmp_path):
    """Workers that look numbers up load no pandas; a task that writes a table holds a small row group, not all it writes."""
    import pyarrow.parquet as pq

    code = "import sys; import doclith.llm.jaccard; assert 'pandas' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])
    rows = spark.range(0, 6_000_000, 1, 1).select(F.xxhash64("id").alias("a"))
    some = rows.where("a % 1000 = 0")
    assert members.filtered(rows, "a", members.collect(some, "a")).where("a % 1000 = 0").count() == some.count()
    shared._write(rows, str(tmp_path / "t"))
    groups = [pq.ParquetFile(f).metadata for f in (tmp_path / "t").glob("*.parquet")]
    assert max(m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)) < 2 * shared.GROUP_BYTES < sum(m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups))


def test_sections_are_sent_few_at_once():
    """All words are counted, and no batch is large, however many sections are used."""
    n = 200_000
    text = pa.array([" ".join(f"w{i}" for i in range(a, a + 1000)) for a in range(0, n, 1000)])
    ids = pa.array(range(len(text)), pa.int64())
    batches = list(jaccard._describe(3)(iter([pa.RecordBatch.from_arrays([ids, text, ids, ids], ["key", "text", "a", "b"])])))
    rows = pa.Table.from_batches(batches)
    section = rows["section"].to_numpy()
    assert rows["n"].to_numpy()[section < 1 << jaccard.WORD_BITS].sum() == n
    assert rows["n"].to_numpy()[np.isnan(section.astype(float))].sum() == n - 2 * len(text)
    assert max(b.nbytes for b in batches) < 1 << 20 and (section >= 0).sum() > 100_000


def test_a_block_is_held_once():
    """Shingles repeated within a block are counted as plainly, in little more than the block's own memory."""
    chance = np.random.default_rng(5)
    grams = chance.integers(0, 1 << 63, jaccard.BLOCK, dtype=np.uint64) * np.uint64(2)
    grams[jaccard.BLOCK // 2 :] = grams[: jaccard.BLOCK // 2]
    rest = chance.integers(0, 1 << 63, 1000, dtype=np.uint64)
    rest[:10] = rest[10]
    tracemalloc.start()
    counts = jaccard._Frequencies()
    for a in range(0, len(grams), 1 << 16):
        counts.add(grams[:0], grams[a : a + (1 << 16)])
    counts.add(grams[:0], rest)
    counts.close()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.bincount((np.concatenate([grams, rest[:11]]) >> np.uint64(64 - jaccard.SHINGLE_BITS)).astype(int), minlength=1 << jaccard.SHINGLE_BITS)
    assert (counts.seen[1 << jaccard.WORD_BITS :] == want).all()
    assert peak < 16 << 20  # the block has 16 MB
