"""Operators on what a fixed cut would lose."""

from __future__ import annotations

import random
import textwrap
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from doclith.llm import license_scan, pii, pseudo_likelihood, quality_rules, tokens, url_filter


def test_vocabulary_of_tied_words(spark):
    counts = spark.range(5000).select(F.xxhash64("id").alias("word"), F.when(F.col("id") < 10, 900).otherwise(100).alias("n"))
    frequent = lambda size: {r.word: r.n for r in pseudo_likelihood._frequent(counts, size).collect()}
    assert [len(frequent(size)) for size in (0, 10, 11, 3000, 5000, 9000)] == [0, 10, 11, 3000, 5000, 5000]
    assert sorted(frequent(300).values())[-11:] == [100] + [900] * 10
    texts = [(i, " ".join(f"w{(37 * i + j) % 400}" for j in range(60))) for i in range(400)]
    _, known, *_ = pseudo_likelihood.fit(spark.createDataFrame(texts, "doc_id long, text string"), size=256)
    assert len(known.hashes) == 256 and len(np.unique(known.classes[1:-1])) > 50


def test_words_outside_the_vocabulary_are_scored_by_their_count(spark):
    texts = [(i, "all of these stay " * 20 + "rather " * 9 + "seldom") for i in range(30)] + [(100, "rather"), (101, "seldom"), (102, "typo"), (103, "unseen"), (103, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = pseudo_likelihood.fit(df.where("doc_id < 103"), size=4)
    rows = {r.doc_id: r for r in pseudo_likelihood.score(df, model).where("n_tokens > 0").collect()}
    gain = lambda a, b: rows[a].log_likelihood - rows[b].log_likelihood
    assert len(model[1].hashes) == 4 and model[2].count() == 7
    assert abs(gain(100, 101) - np.log(271 / 31)) < 1e-4 and abs(gain(101, 102) - np.log(31)) < 1e-4 and abs(gain(102, 103) - np.log(2)) < 1e-4


def test_network_steps_against_plain_softmax_and_in_little_memory():
    chance = np.random.default_rng(1)
    (_, _, w), = tokens.chunks(pa.array([" ".join(f"w{j}" for j in chance.integers(0, 300, 9000))]), letters=True)
    found, counts = np.unique(w.hashes, return_counts=True)
    known = pseudo_likelihood.vocabulary(found, counts.astype(float), len(w.hashes), len(found))
    network = pseudo_likelihood.Network.new(known)
    ids, at, _ = pseudo_likelihood._padded(w, known)
    tracemalloc.start()
    got = pseudo_likelihood.log_probabilities(network, known, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 << 20  # the chances of all positions and classes alone are 4.6 MB
    embeddings, places, vectors, biases = (x.astype(float) for x in network.parts())
    hidden = np.tanh(sum(embeddings[ids[at + j]] * places[i] for i, j in enumerate(pseudo_likelihood.PLACES)))
    chances = np.exp(hidden @ vectors.T + biases)
    chances /= chances.sum(1, keepdims=True)
    right = known.classes[ids[at]]
    assert np.allclose(got, np.log(chances[np.arange(len(at)), right]) + known.shares[ids[at]], atol=1e-4)
    trainer, first = pseudo_likelihood.Trainer(network), at[: pseudo_likelihood.BATCH]
    trainer.learn(ids, first, known.classes)
    error = chances[: len(first)] - np.eye(pseudo_likelihood.CLASSES)[right[: len(first)]]
    for mine, old, gradient in ((2, vectors, error.T @ hidden[: len(first)] / len(first)), (3, biases, error.mean(0))):
        want = old - pseudo_likelihood.RATE * gradient / np.sqrt(0.1 + gradient * gradient)
        assert np.allclose(trainer.network.parts()[mine], want, atol=1e-5)


def test_training_covers_every_position_once(monkeypatch):
    texts = ["one", "", *(" ".join(f"w{j}" for j in range(n)) for n in (2, 7, 500, 3000))]
    (_, _, w), = tokens.chunks(pa.array(texts), letters=True)
    found, counts = np.unique(w.hashes, return_counts=True)
    known = pseudo_likelihood.vocabulary(found, counts.astype(float), len(w.hashes), len(found))
    trained = []
    monkeypatch.setattr(pseudo_likelihood.Trainer, "learn", lambda self, ids, at, classes: trained.append(at))
    for turn in range(pseudo_likelihood.ROUNDS):
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
        list(pseudo_likelihood._train(pseudo_likelihood.Network.new(known), known, turn)(iter([batch])))
    assert sorted(np.concatenate(trained)) == sorted(pseudo_likelihood._padded(w, known)[1])
    assert min(map(len, trained)) > 1500


def test_contamination_removes_rows_not_ids(spark, tmp_path):
    item = "which of these seven planets has the largest number of known moons today"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"leaked: {item}"), (None, "a clean text without an id"), (None, None), (7, f"{item} again"), (7, "a clean text that shares its id"), (7, f"{item} again"), (8, "another clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.contamination(spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, (rows[k] for k in (1, 2, 4, 6))))


def test_url_models_see_the_query(spark):
    chance = random.Random(2)
    word = lambda: "".join(chance.choice("aeiostrn") for _ in range(6))
    rows = [(i, f"http://x.org/r?to={word()}" if i % 3 else f"http://x.org/r?to=Casino-{word()}") for i in range(600)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {(r.host, r.path, r.rule) for r in got.values()} == {("x.org", "/r", None)}
    assert sum(got[i].verdict == ("allow" if i % 3 else "block") for i in range(600)) >= 590


def test_bootstrap_takes_whole_identifiers_until_none_is_new(spark):
    texts = [(i, f"reach me by telephone at +1 (437) 555-{1000 + i} today") for i in range(60)]
    texts += [(100 + i, f"the host answers from 10.0.{i}.7 only") for i in range(60)]
    texts += [(200, "reach me by telephone at (437) 555-0689 today"), (201, "reach me by telephone at 555 123 4567 today"), (202, "the host answers from 1-2-3-4 only")]
    texts += [(300, "reach me by telephone at 555-867-5000 today")]
    for k, w in enumerate(["alder", "birch", "cedar", "elder", "hazel"]):  # seven of nine instances are known, eight once the step before is done
        texts += [(None, f"{w} {w} +1 (437) 556-{1000 + 10 * k + j} {w}") for j in range(7)]
        texts += [(None, f"{w} {w} 555-867-{5000 + k} {w}"), (301 + k, f"{w} {w} 555-867-{5001 + k} {w}")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(df).collect()}
    assert [rows[i].spans for i in (200, 201, 202)] == ["phone:25:39", "phone:25:37", "ip:22:29"]
    few = {r.doc_id: r.spans for r in pii.find(df, rounds=3).collect()}
    assert all(rows[301 + k].spans == "phone:12:24" for k in range(5))
    assert [few[301 + k] for k in range(5)] == ["phone:12:24"] * 2 + [""] * 3
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[200] == "reach me by telephone at [PHONE] today"


def test_wrapped_notices(spark):
    families = ("GPL-3.0", "LGPL", "AGPL-3.0", "BSD", "Apache-2.0", "MPL-2.0")
    notices = [(f, max(license_scan.TEMPLATES[f], key=len)) for f in families]
    texts = [(f, "\n".join(textwrap.wrap(t, width))) for f, t in notices for width in (30, 72)]
    bsd = next(t for ts in license_scan.TEMPLATES.values() for t in ts if t.startswith("Redistribution"))
    own = next(f for f, ts in license_scan.TEMPLATES.items() if bsd in ts)
    texts += [(own, bsd.replace("with or without ", "with or without\n")), (own, f"A line above.\n{bsd[:60]}\r\n{bsd[60:]}\nA line below.")]
    texts += [(None, bsd.replace(" ", "\n \t\n"))]  # blank lines part paragraphs
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.family, r.n_paragraphs) for r in license_scan.scan(df).collect()}
    assert got == {(i, f, 1) for i, (f, _) in enumerate(texts) if f}, got


def test_stop_words_are_asked_of_listed_languages_only(spark):
    russian = "Сегодня утром пришла хорошая погода поэтому соседи решили поехать вместе далеко загород чтобы собирать грибы ягоды потом варить варенье пить горячий чай"
    names = "Paris London Berlin Madrid Vienna Lisbon Dublin Warsaw Prague Athens Oslo Rome Bern Riga Minsk Kyiv Sofia Tirana Skopje Ankara Cairo Tunis Algiers Rabat"
    rows = [(0, russian, "ru"), (1, names, "pl"), (2, names, "en"), (3, names, "de-AT"), (4, names, None), (5, "zwei Worte", "ru")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {0, 1}
    assert {r.doc_id for r in quality_rules.judge(df).where("kept").collect()} == want == {r.doc_id for r in quality_rules.passing(df).collect()}
    assert quality_rules.passing(df.drop("lang")).count() == 0
