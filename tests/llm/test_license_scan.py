"""The gate loses nothing: whatever gets a verdict has a sign."""

from __future__ import annotations

import random

import numpy as np

from doclith.llm import license_scan


def test_no_verdict_without_a_sign():
    chance = random.Random(3)
    model = license_scan.train(["Some other text about a public road and its version of the terms of trade"] * 5)
    signs = np.unique(np.concatenate([model.alone, *(t for texts in model.templates for t in texts)]))
    words = sorted({w for texts in license_scan.TEMPLATES.values() for t in texts for w in t.split()}) + ["road", "tree"] * 20
    named = 0
    for k in range(600):
        template = chance.choice([t for texts in license_scan.TEMPLATES.values() for t in texts]).split()
        text = template[: chance.randrange(2, 30)] if k % 2 else [chance.choice(words) for _ in range(chance.randrange(3, 30))]
        hashes = license_scan._plain(" ".join(text))
        family, _, _ = license_scan.judge(model, hashes)
        named += family is not None
        found = np.concatenate([hashes, license_scan._ngrams(hashes)[-1]])
        assert family is None or np.isin(found, signs).any()
    assert named > 100


def test_one_licence_word_is_reported(spark):
    df = spark.createDataFrame([(1, "The copyright belongs to somebody."), (2, "Nothing of that kind is here.")], "doc_id long, text string")
    assert [(r.doc_id, r.family) for r in license_scan.scan(df).collect()] == [(1, "unknown")]
