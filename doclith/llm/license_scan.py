"""Licence scans: a trained classifier of paragraphs, with an unknown class, confirmed by comparison with templates.

Paragraphs are blocks of lines that blank ones part. Lines are judged, long ones in overlapping windows, and so are windows
that run on over the line breaks of a paragraph, so that wrapped notices are seen whole. Features are word n-grams, one to three words, of the templates;
a window without any of the longest, licence words counted too, is no licence text: no verdict on it were possible. A multinomial logistic regression over them, trained on
templates with words dropped, cut and set among other text, gives each family and a class of unknown texts (corpus
paragraphs, other notices, shuffled templates) a probability. The threshold is calibrated on texts that it wasn't
trained on: at most UNKNOWN_ERRORS of the unknown ones reach it. A prediction is confirmed if enough of a template's
three-word sequences are in the paragraph; both are needed for a family, and what speaks of a licence without them is
reported as ``unknown``.

Training takes paragraphs from about BACKGROUND documents, by a hash of the text; all documents are scanned.

Defined cases: null and empty texts have no paragraphs; a very long text is judged window by window like others; of two
families equally likely the first listed counts; repeated rows are reported each; null ids are reported as null;
further columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclith.llm.shared import sampled
from doclith.llm.tokens import _BLANK as BLANK
from doclith.llm.tokens import U, Words, chunks, words

# How notices of these families read.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is licensed under the terms of the Apache License 2.0",
        "Released under the Apache 2.0 license",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License",
        "Licensed under the MIT license, see the LICENSE file for details",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Released under the GNU GPL version 3",
        "Licensed under the GPLv3",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is licensed under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "Released into the public domain under CC0 1.0",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without prior written permission",
        "Copyright by the author, all rights reserved",
    ),
}
# Notices of no family above, for the unknown class.
OTHER_NOTICES = (
    "Licensed under the terms of the agreement between the parties",
    "This work is licensed under a license that is described elsewhere",
    "The driving license was issued by the public office in version two",
    "The general public may use this work free of charge",
    "Terms and conditions of use apply, see the following notice",
    "Distributed under the Eclipse Public License 2.0",
    "Released under the Artistic License 2.0",
    "Licensed under the Boost Software License, Version 1.0",
    "Used under license from the owner of the trademark",
    "The software foundation published its report on the terms of trade",
)
UNKNOWN = "unknown"
NGRAMS = 3
GATE = 1  # a window with no sign has no word of ALONE and no sequence of a template: it can get no verdict
WINDOW, STRIDE = 64, 32
VARIANTS = 60  # of each template
BACKGROUND = 400
UNKNOWN_ERRORS = 0.002
CONFIRM = 0.5
ALONE = "licensed license licence copyright lizenz licencia licence copyleft".split()
SEED = 5


@dataclass
class Model:
    """features: hashes in order; weights by feature and class (the unknown class last), bias; a threshold for families."""

    families: tuple[str, ...]
    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    threshold: float
    templates: tuple[tuple[np.ndarray, ...], ...]
    alone: np.ndarray


def _plain(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), letters=True).hashes


def _ngrams(hashes: np.ndarray) -> list[np.ndarray]:
    one = Words(hashes, np.array([0, len(hashes)]), hashes, hashes, hashes, hashes)
    return [one.grams(k)[0] for k in range(1, NGRAMS + 1)]


def _vector(found: np.ndarray, size: int) -> np.ndarray:
    """Of a paragraph's features, once each, one over the root of their number."""
    out = np.zeros(size)
    found = np.unique(found)
    out[found] = 1 / np.sqrt(max(len(found), 1))
    return out


def _indices(features: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    every = np.concatenate(_ngrams(hashes))
    at = np.minimum(np.searchsorted(features, every), len(features) - 1)
    return at[features[at] == every]


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _descend(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by Adam over all rows, classes weighted alike."""
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    share = 1 / np.bincount(y, minlength=classes).clip(1)[y]
    share /= share.sum()
    wanted = np.eye(classes)[y]
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        error = (_softmax(x @ w + b) - wanted) * share[:, None]
        for k, (p, g) in enumerate(((w, x.T @ error + ridge * w / classes), (b, error.sum(0)))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, b


def train(background: list[str], templates: dict[str, tuple[str, ...]] = TEMPLATES) -> Model:
    """background: paragraphs of other text."""
    chance, families = np.random.default_rng(SEED), tuple(templates)
    known = [[_plain(t) for t in texts] for texts in templates.values()]
    features = np.unique(np.concatenate([g for texts in known for t in texts for g in _ngrams(t)]))
    around = [h for h in (_plain(p) for p in background) if len(h)] or [_plain(t) for t in OTHER_NOTICES]
    own = {t.tobytes() for texts in known for t in texts}
    around = [h for h in around if not any(o in h.tobytes() for o in own)] or [_plain(t) for t in OTHER_NOTICES]

    def among(t: np.ndarray) -> np.ndarray:
        noise = around[chance.integers(len(around))]
        a, b = chance.integers(0, 12, 2)
        return np.concatenate([noise[:a], t, noise[-b:] if b else noise[:0]])

    def variant(t: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return t
        kept = t[chance.random(len(t)) > 0.1] if len(t) > 12 else t  # a short one's every word can tell its family
        if k % 3 == 0 and len(kept) > 8:
            kept = kept[: max(6, int(len(kept) * chance.uniform(0.6, 1)))]
        return among(kept) if k % 2 else kept

    rows = [(variant(t, k), i) for i, texts in enumerate(known) for t in texts for k in range(VARIANTS)]
    last = len(families)
    rows += [(h[:WINDOW], last) for h in around]
    rows += [(variant(_plain(t), k), last) for t in OTHER_NOTICES for k in range(VARIANTS)]
    rows += [(chance.permutation(np.concatenate([texts[chance.integers(len(texts))] for texts in (known[a], known[b])]))[: chance.integers(4, 20)], last) for a in range(last) for b in chance.integers(0, last, 20)]
    x = np.stack([_vector(_indices(features, h), len(features)) for h, _ in rows])
    y = np.array([c for _, c in rows])
    held = chance.random(len(rows)) < 0.25
    w, b = _descend(x[~held], y[~held], last + 1)
    outside = _softmax(x[held & (y == last)] @ w + b)[:, :last].max(1)
    threshold = float(max(0.5, np.quantile(outside, 1 - UNKNOWN_ERRORS)))
    return Model(families, features, w, b, threshold, tuple(tuple(np.unique(_ngrams(t)[-1]) for t in texts) for texts in known), np.concatenate([_plain(t) for t in ALONE]))


def judge(model: Model, hashes: np.ndarray) -> tuple[str | None, float, float]:
    """Family (``unknown`` for another licence, None for other text), its probability, and the likeness of a template."""
    found = _indices(model.features, hashes)
    p = _softmax(_vector(found, len(model.features)) @ model.weights + model.bias)
    best = int(p[:-1].argmax())
    own = _ngrams(hashes)[-1]
    alike = max((float(np.isin(t, own).mean()) for t in model.templates[best] if len(t)), default=0.0)
    if p[best] >= model.threshold and alike >= CONFIRM:
        return model.families[best], float(p[best]), alike
    return (UNKNOWN, float(p[-1]), alike) if np.isin(model.alone, hashes).any() else (None, float(p[-1]), alike)


def _windows(edges: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    """Of a paragraph, words start to end, with its lines' edges: windows within lines, and such as run on into the next."""
    out = []
    lines = edges[np.searchsorted(edges, start) : np.searchsorted(edges, end) + 1]
    for s, e in zip(lines[:-1].tolist(), lines[1:].tolist(), strict=True):
        out += [(at, min(at + WINDOW, e)) for at in range(s, max(s + 1, e - STRIDE), STRIDE)]
        out += [(at, min(at + WINDOW, end)) for at in range(s, e, STRIDE) if e < min(at + WINDOW, end)]
    return out


def _scan(model: Model):
    signs = np.unique(np.concatenate([model.alone, *(t for texts in model.templates for t in texts)]))
    bits = 16
    maybe = np.zeros(1 << bits, bool)
    maybe[(signs & U((1 << bits) - 1)).astype(int)] = True
    names = ["key", "family", "n_paragraphs", "first_paragraph", "probability", "likeness"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in chunks(batch.column(1), letters=True):
                breaks = np.flatnonzero(w.data == 10)
                text = np.searchsorted(w.offsets[1:], w.starts, "right")
                line = np.searchsorted(breaks, w.starts) + text  # grows by text and line
                edges = np.flatnonzero(np.diff(line, prepend=-1, append=-2))
                filled = np.cumsum(~BLANK[w.data])
                blank = breaks[1:][filled[breaks[1:]] == filled[breaks[:-1]]]
                block = np.searchsorted(blank, w.starts) + text
                blocks = np.flatnonzero(np.diff(block, prepend=-1, append=-2))
                hits = np.zeros(len(w.hashes) + 1, np.int64)
                for grams, at in ((w.hashes, np.arange(len(w.hashes))), w.grams(NGRAMS)):
                    likely = np.flatnonzero(maybe[(grams & U((1 << bits) - 1)).astype(int)])
                    place = np.minimum(np.searchsorted(signs, grams[likely]), len(signs) - 1)
                    np.add.at(hits, at[likely[signs[place] == grams[likely]]] + 1, 1)
                sums = np.cumsum(hits)
                found: dict[tuple[int, str], list] = {}
                likely = sums[blocks[1:]] - sums[blocks[:-1]] >= GATE
                for s, e in zip(blocks[:-1][likely], blocks[1:][likely], strict=True):
                    text = int(np.searchsorted(w.bounds, s, "right") - 1)
                    order = int(np.searchsorted(blocks, s) - np.searchsorted(blocks, w.bounds[text]))
                    seen: dict[str, tuple[float, float]] = {}
                    named, unknown = [], []
                    for at, upto in _windows(edges, s, e):
                        if sums[upto] - sums[at] < GATE:
                            continue
                        family, p, alike = judge(model, w.hashes[at:upto])
                        if family == UNKNOWN:
                            unknown.append((at, upto, p, alike))
                        elif family:
                            named.append((at, upto))
                            seen[family] = max(seen.get(family, (0.0, 0.0)), (p, alike))
                    for at, upto, p, alike in unknown:  # what overlaps a family's window is a piece of its notice
                        if not any(first < upto and at < last for first, last in named):
                            seen[UNKNOWN] = max(seen.get(UNKNOWN, (0.0, 0.0)), (p, alike))
                    for family, (p, alike) in seen.items():
                        one = found.setdefault((text, family), [0, order, p, alike])
                        one[0], one[2], one[3] = one[0] + 1, max(one[2], p), max(one[3], alike)
                if found:
                    keys = batch.column(0).slice(a, b - a).take(pa.array([t for t, _ in found]))
                    n, first, p, alike = zip(*found.values(), strict=True)
                    yield pa.RecordBatch.from_arrays([keys, pa.array([f for _, f in found]), pa.array(n, pa.int32()), pa.array(first, pa.int32()), pa.array(p, pa.float64()), pa.array(alike, pa.float64())], names)

    return run


def background(docs: DataFrame, text: str = "text", most: int = BACKGROUND) -> list[str]:
    """A line each of about ``most`` documents, for training alone."""
    line = F.substring_index(F.col(text), "\n", 1)
    rows = sampled(docs, F.xxhash64(text), most).select(line.alias("t")).where("length(t) > 20").distinct()  # copies share a hash
    return sorted(r["t"] for r in rows.collect())


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """key, family, n_paragraphs, first_paragraph (from 0), probability, likeness: a row for each
    document and family that it names."""
    model = model or train(background(docs, text))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scan(model), f"key {kind}, family string, n_paragraphs int, first_paragraph int, probability double, likeness double").withColumnRenamed("key", key)
