"""Decontamination against the plain version: near half coverage, hot phrases, short items."""

from __future__ import annotations

import random
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from doclith.llm import tiling  # noqa: E402


def test_near_half_coverage_against_plain(spark):
    chance = random.Random(6)
    word = lambda n=60: f"w{chance.randrange(n)}"
    phrase = "which of these answers is right".split()
    items = [(i, phrase + [word() for _ in range(chance.randrange(4, 26))]) for i in range(12)] + [(20, ["w1"] * 12), (21, ["a", "b", "c", "d"]), (22, ["two", "words"])]
    texts = [(0, ["two", "words"]), (1, ["has", "two", "words"]), (2, ["a", "b", "c", "d", "e"]), (3, ["w1"] * 30), (4, phrase)]
    for i in range(5, 120):
        _, item = chance.choice(items)
        text = [word() for _ in range(6)]
        for _ in range(chance.randrange(1, 4)):
            a = chance.randrange(len(item))
            text += item[a : a + chance.randrange(3, 14)] + [word(9)]
        texts.append((i, text))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.coverage, 6) for r in tiling.leaks(df, benchmark).collect()}
    want = {(i, j): round(plain.coverage(item, text), 6) for i, text in texts for j, item in items if len(item) >= 4}
    want |= {(i, j): 1.0 for i, text in texts for j, item in items if len(item) < 4 and item == text}
    assert got == {k: c for k, c in want.items() if c >= 0.5} and len({round(c, 1) for c in got.values()}) > 3


def test_a_hot_phrase_makes_no_pairs(spark):
    chance = random.Random(7)
    word = lambda: f"w{chance.randrange(9000)}"
    phrase = "which of these is the"
    df = spark.createDataFrame([(i, f"{phrase} {' '.join(word() for _ in range(30))}") for i in range(1500)], "doc_id long, text string")
    items = [(i, f"{phrase} {' '.join(word() for _ in range(20))}") for i in range(300)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    began = time.time()
    leaking = spark.createDataFrame([(9000, "so " + items[7][1])], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in tiling.leaks(df.union(leaking), benchmark).collect()] == [(9000, 7)]
    assert time.time() - began < 60
