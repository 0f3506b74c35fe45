"""Texts with very many matches, and places of overlapping spans."""

from __future__ import annotations

import hashlib
import random
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from doclith.llm import pii  # noqa: E402


def test_many_matches_in_one_text(spark):
    text = " ".join(f"10.0.{i % 256}.{i % 7}" if i % 2 else f"ü{i % 1000}" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (r,) = pii.find(df).collect()
    assert time.time() - began < 60
    want = plain.spans(text)
    assert r.n_ip == 50_000 and r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert pii.redact(df).first().text.count("[IP]") == 50_000


def test_redaction_against_plain(spark):
    """Spans of all kinds, some of them overlapping: what starts first gives the label."""
    chance = random.Random(5)
    parts = ["a@b.cd", "1.2.3.4", "4635346203346400", "+1 (437) 555-0689", "+4635346203346400", "1.2.3.4@x.yz", "\U0001f600", "word", "ü", "\n", ",", "+1 2.3.4.5 55 66"]
    rows = [(i, " ".join(chance.choice(parts) for _ in range(chance.randrange(12)))) for i in range(80)]

    def masked(text):
        spans = sorted((int(a), pii.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in plain.spans(text)))
        out, at = [], 0
        for a, k, b in spans:
            if a >= at:
                out += [text[at:a], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join(out) + text[at:]

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df, rounds=0).collect()}
    assert got == {i: masked(t) for i, t in rows}
