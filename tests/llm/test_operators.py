"""Each operator against its plain version, and on rows that break things."""

from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

import corpus_pipeline  # noqa: E402
from doclith.llm import components, jaccard, license_scan, mixing, pii, pseudo_likelihood, quality_rules, queries, ranker, tiling, tokens, url_filter, warc  # noqa: E402

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [
    "", " \t\n\x0b\f\r ", "one", "two words", "One two THREE", "one two three", "a b c d e f g h i j", "the the the the the the the the the the the the",
    "w " * 3000, "x" * 20000, "line one here\nline one here\n\nline one here\nother", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.004", "4635346203346400 4635-3462 0334 6400",
    "+1 (437) 555-0689. +49 12", "\U0001f600 me@x.yz \U0001f600 1.2.3.255 é", "1" * 3000 + ".1" * 2000, "Ünïcode wörds ärë fine, très bien — niño", "# * $ % & | < >", "Licensed under CC BY 4.0.\n" * 3,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def hard(spark):
    """Odd texts, repeated rows, nulls in every column."""
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(HARD)]
    rows += [(100, None, None, None, None), (None, "a text without an id of its own", None, None, 3), (None, "another text without an id of its own", "en", None, 3), rows[5], rows[5], (101, HARD[6], "de", None, 1)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(hard):
    """More columns, with names that operators use or return."""
    names = ["kept", "n_words", "size", "source_size", "copies", "score", "spans", "row", "_row", "_t", "_k", "_h", "_w", "key", "n", "token", "_x", "_seen", "_base", "host", "component_id", "item_id", "family", "own", "at"]
    return hard.withColumns({n: F.lit("clash") for n in names})


def key(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_tokens_match_python():
    import pyarrow as pa

    texts = [*HARD, None]
    rows = [w for _, _, w in tokens.chunks(pa.array(texts))]
    counts = np.concatenate([np.diff(w.bounds) for w in rows])
    assert list(counts) == [len(plain.words(t)) for t in texts]
    hashes, seen = np.concatenate([w.hashes for w in rows]), {}
    for h, word in zip(hashes, (x for t in texts for x in plain.words(plain.lowered(t))), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_quality_rules(which, request):
    df = request.getfixturevalue(which)
    got = quality_rules.judge(df).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain.quality(r.text)
        assert r.kept in (True, False) and not (r.kept and r.base_failed)
        if which == "docs":
            assert r.n_stop_words == plain.stop_words(r.text)
    assert quality_rules.passing(df).count() == sum(r.kept for r in got)


def test_quality_rules_keep_good_documents(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality_rules.judge(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in rows)


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    got = mixing.mix(df).collect()
    sizes = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(plain.words(r.text))
    want = plain.targets(sizes)
    assert len(got) == df.count() and key(got, "doc_id", "size") == sorted(((r.doc_id, len(plain.words(r.text))) for r in df.collect()), key=repr)
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(x, 6) for x in want.values()})
    taken = {}
    for r in mixing.mix(df.withColumn("doc_id", F.col("doc_id"))).collect():
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken.setdefault((r.source_size, round(r.target, 6)), [0, 0])
        taken[r.source_size, round(r.target, 6)][0] += r.taken
        taken[r.source_size, round(r.target, 6)][1] = max(taken[r.source_size, round(r.target, 6)][1], r.size)
    if which == "docs":
        assert all(abs(t - target) <= largest for (_, target), (t, largest) in taken.items())
    assert key(got, "doc_id", "taken") == key(mixing.mix(df.repartition(3)).collect(), "doc_id", "taken")


@pytest.mark.parametrize(("which", "k", "percent"), [("docs", 3, 90), ("docs", 5, 80), ("hard", 3, 90)])
def test_jaccard(which, k, percent, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None]
    want = plain.components(rows, k, percent)
    got = jaccard.classes(df, k=k, percent=percent).collect()
    assert len(got) == df.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, *x) for i, x in want.items()}


@pytest.mark.parametrize("percent", [90, 80])
def test_jaccard_on_edited_copies(spark, percent):
    """Groups of copies with random edits: links on both sides of the bound, chains among them."""
    chance = random.Random(4)
    rows = []
    for group in range(6):
        base = [f"w{chance.randrange(300)}" for _ in range(60)]
        for _ in range(12):
            text = list(base)
            for _ in range(chance.randrange(4)):
                at = chance.randrange(len(text))
                text[at : at + chance.randrange(2)] = [f"e{chance.randrange(9)}"] * chance.randrange(2)
            rows.append((len(rows), " ".join(text)))
            if group == 0:
                base = text
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.components(rows, 3, percent)


def test_deduplicate(spark, hard):
    kept = jaccard.deduplicate(hard).collect()
    assert hard.columns == list(kept[0].asDict()) and sum(r.doc_id == 5 for r in kept) == 0 and sum(r.doc_id == 4 for r in kept) == 1
    assert sum(r.text is None or not r.text.strip() for r in kept) == 3 and sum(r.doc_id is None for r in kept) == 2
    assert {r.doc_id for r in kept if r.text == HARD[6]} == {6}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 8), (5, 5), *((i, i + 1) for i in range(20, 60))], "u long, v long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 20 for i in range(20, 61)}


def test_tiles_against_plain():
    chance = random.Random(2)
    for _ in range(60):
        item = [chance.randrange(6) for _ in range(chance.randrange(4, 25))]
        cut = chance.randrange(len(item))
        text = [chance.randrange(6) for _ in range(5)] + item[cut:] + [9] + item[:cut] + [chance.randrange(6) for _ in range(8)]
        made = tiling.tiles(np.array(item, np.uint64), np.array(text, np.uint64))
        assert abs(sum(n for _, _, n in made) / len(item) - plain.coverage(item, text)) < 1e-9
        assert all(item[q : q + n] == text[p : p + n] for q, p, n in made)


def test_leaks(spark, docs, hard):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "too short"), (3, None), (None, "one two three four five six seven eight")]
    texts = [
        (1, "Intro words. Eta theta iota kappa lambda MU! and then alpha, beta gamma delta epsilon zeta: end"), (2, "alpha beta gamma delta only"), (3, "nothing here"), (None, "x one two three four five six seven eight y"), (5, None),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = tiling.leaks(spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (None, None)} and min(r.coverage for r in got) == 1.0
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    found = {r.doc_id for r in tiling.leaks(docs, benchmark).collect()}
    passages = [" ".join(plain.words(r.text)) for r in benchmark.collect()]
    assert found == {r.doc_id for r in docs.collect() if any(p in " ".join(plain.words(r.text)) for p in passages)}
    assert tiling.leaks(hard, benchmark).count() == 0


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_base_spans(which, request):
    df = request.getfixturevalue(which)
    texts = [(r.doc_id, r.text) for r in df.collect()]
    got = pii.find(df).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            want = plain.spans(dict(texts)[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert set(want) <= set(r.spans.split(",") if r.spans else [])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(f"{k}:") for s in want) for k in pii.KINDS]


def test_discovered_spans(spark):
    known = [(i, f"Customer {i} says: reach me by telephone at +1 (437) 555-{1000 + i} today. Order {70000 + i} shipped") for i in range(20)]
    new = [(50, "Reach me by telephone at 555-867-5309 today."), (51, "The order 555-867-5309 is a serial number 12345678"), (52, "My part is 999-888-7777 and no phone")]
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame(known + new, "doc_id long, text string")).collect()}
    assert rows[50].spans == "phone:25:37" and rows[50].n_phone == 0 and rows[50].n_discovered == 1
    assert rows[51].spans == "phone:10:22" and rows[52].spans == ""  # the instance is known by now; the other isn't
    assert rows[3].spans.startswith("phone:") and rows[3].n_discovered == 0


def test_redact(spark, hard):
    df = spark.createDataFrame([(1, "to me@x.yz and +1 (437) 555-0689, 10.0.0.1; ü"), (2, None), (3, "none")], "doc_id long, text string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["to [EMAIL] and [PHONE], [IP]; ü", None, "none"]
    assert pii.redact(hard).count() == hard.count()


def test_url_rules(spark):
    urls = [
        "http://example.com/en/1", "https://www.example.com/en/2?x", "http://M.Example.com/en/", "http://example.com", "http://a.net/es/", "http://net/fr/x", "http://b.net/de/", "http://x.org/en/1", "https://cheap-pills.org/a", None, "", "no scheme", "http://",
        "ftp://h?q://z/en/", "http://Ä.COM/x#y", "http://x.org/en/1", "http://example.community/en/", "http://notexample.com/en/",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain.rule(u, url_filter.RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict in ("allow", "block")
        assert verdict is None or got[i].verdict == verdict


def test_url_model_tells_seeds_apart(spark):
    chance = random.Random(1)
    word = lambda: "".join(chance.choice("aeiostrn") for _ in range(6))
    rows = [(i, f"http://{word()}.org/{word()}/{i}" if i % 3 else f"http://cheap-pills-{word()}.org/buy/{i}") for i in range(600)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[i].verdict == ("allow" if i % 3 else "block") for i in range(600)) >= 590


def test_url_model_against_plain(spark):
    """Witten-Bell interpolation over contexts of four characters down to none, counted by hand."""
    texts = {"accepted": ["ab.com/x", "abc.com/y", "ab.org/x"], "rejected": ["zz.com/x", "ab.zz/q"]}
    order, counts = url_filter.ORDER, {}
    for column, (_, names) in enumerate(texts.items()):
        for t in names:
            padded = url_filter.START * order + t + url_filter.END
            for i in range(len(padded) - order):
                counts.setdefault(padded[i : i + order + 1], [0, 0])[column] += 1

    def chance(gram, column):
        p = 1 / url_filter.ALPHABET
        for k in range(1, order + 2):
            tails = {}
            for g, n in counts.items():
                tails[g[-k:]] = tails.get(g[-k:], 0) + n[column]
            own = {g: n for g, n in tails.items() if g[:-1] == gram[-k:-1] and n}
            if own:
                p = (own.get(gram[-k:], 0) + len(own) * p) / (sum(own.values()) + len(own))
        return p

    df = spark.createDataFrame([(g, *n) for g, n in counts.items()], "gram string, n_acc long, n_rej long")
    got = {r.gram: r.llr for r in url_filter._log_ratio(df).collect()}
    assert set(got) == set(counts)
    for g in counts:
        assert abs(got[g] - np.log(chance(g, 1) / chance(g, 0))) < 1e-9


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "<p>x</p>"), (1, "http://b/\r\nX: y", "<p>x</p>"), (2, None, None), (4, "u", ""), (5, "u", "é" * 1000 + "\r\n\r\nWARC/1.1"), (6, "u", "z"), (7, "u", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == plain.warc([(i, h) for i, _, h in rows])
    index = warc.write(df, str(tmp_path / "w"), min_bytes=5)
    kinds = {r.id: r.record_type for r in index.collect()}
    assert kinds[4] == "response" and kinds[3] == "revisit" and kinds[1] == "response"
    back = {r.id: bytes(r.payload).decode() for r in warc.read(index.where("id IN (5, 6)"), str(tmp_path / "w")).collect()}
    assert back == {5: rows[4][2], 6: "z"}
    odd = spark.createDataFrame([(None, "u", "q"), (None, "u", "q"), (8, "u", "q")], "page_id long, url string, html string")
    assert sorted(r.record_type for r in warc.round_trip(odd).collect()) == ["response"] * 3


def test_ranker_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = ranker.score(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_ranker_needs_no_labels(hard, spark):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in ranker.score(hard, labels).collect()} == {0.5}


def test_licence_families(spark):
    texts = [(i, f"Some text of a page.\n{t}\nMore of it.", f) for i, (f, ts) in enumerate(license_scan.TEMPLATES.items()) for t in ts]
    texts += [(90, "The foundation of the city was laid in the year of the plague, as the general public knows.", None), (91, "Released under the Zlib License, a license of its own.", "unknown"), (92, None, None), (93, "w " * 200 + "released under the MIT License " + "w " * 200, "MIT")]
    df = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    got = {(r.doc_id, r.family) for r in license_scan.scan(df).collect()}
    want = {(i, f) for i, _, f in texts if f}
    assert len(got ^ want) <= 2, (got ^ want)


def test_network_learns_context(spark):
    chance = random.Random(3)
    follow = {f"w{i}": f"w{(i * 7 + 3) % 40}" for i in range(40)}
    texts = []
    for i in range(200):
        w = [f"w{chance.randrange(40)}"]
        while len(w) < 100:
            w.append(follow[w[-1]])
        texts.append((i, " ".join(w)))
    texts += [(900, " ".join(f"w{chance.randrange(40)}" for _ in range(100))), (901, None), (902, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    rows = {r.doc_id: r for r in pseudo_likelihood.score(df, pseudo_likelihood.fit(df)).collect()}
    usual = sorted(rows[i].mean_log_likelihood for i in range(200))[100]
    assert rows[900].mean_log_likelihood < usual - 0.3 and usual > -np.log(40)
    assert rows[901].n_tokens == 0 and rows[902].log_likelihood == 0 and rows[902].mean_log_likelihood is None


def test_network_gradient():
    """Training lowers the loss, and log-probabilities of all words sum to one."""
    import pyarrow as pa

    (_, _, w), = tokens.chunks(pa.array(["a b c d e f g h " * 50]), letters=True)
    found, counts = np.unique(w.hashes, return_counts=True)
    known = pseudo_likelihood.vocabulary(found, counts.astype(float), len(w.hashes), len(found))
    network = pseudo_likelihood.Network.new(known)
    total = np.exp(known.priors[known.classes[1:-1]] + known.shares[1:-1]).sum() + np.exp(known.priors[0])
    assert abs(total - 1) < 0.05
    before = pseudo_likelihood.log_probabilities(network, known, w).sum()
    trainer = pseudo_likelihood.Trainer(network)
    ids, at, _ = pseudo_likelihood._padded(w, known)
    for _ in range(20):
        trainer.learn(ids, at, known.classes)
    assert pseudo_likelihood.log_probabilities(trainer.network, known, w).sum() > before / 2


def test_words_are_looked_up_once(monkeypatch):
    """Scoring looks each word up once; known words are found whatever leading bits they share, and no others."""
    import pyarrow as pa

    chance = np.random.default_rng(4)
    hashes = np.unique(np.concatenate([chance.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2), np.arange(50, dtype=np.uint64) + np.uint64(1 << 63), [np.uint64(0), ~np.uint64(0)]]))
    known = pseudo_likelihood.vocabulary(hashes, np.ones(len(hashes)), len(hashes), len(hashes))
    asked = np.concatenate([hashes, hashes + np.uint64(1), chance.permutation(hashes)])
    at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
    assert (known.ids(asked) == np.where(hashes[at] == asked, at + 1, 0)).all()
    lookups, ids = [], pseudo_likelihood.Vocabulary.ids
    monkeypatch.setattr(pseudo_likelihood.Vocabulary, "ids", lambda self, h: lookups.append(len(h)) or ids(self, h))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c", "d"])], ["key", "text"])
    (out,) = pseudo_likelihood._score(pseudo_likelihood.Network.new(known), known)(iter([batch]))
    assert lookups == [4] and [len(x) for x in out.column(3).to_pylist()] == [3, 1]


def test_changes_by_word():
    """Sums by id over the root of their number, without the padding; the same for ids that are there once or often."""
    chance = np.random.default_rng(6)
    for ids, n in ((chance.integers(0, 40, 500), 41), (chance.permutation(300), 300), (np.full(9, 7), 8), (np.full(9, 3), 8), (chance.integers(0, 90_000, 4000), 90_001)):
        changes = chance.normal(size=(len(ids), pseudo_likelihood.WIDTH)).astype(np.float32)
        used, sums, times = pseudo_likelihood._by_word(ids.astype(np.int32), changes, n)
        assert sorted(used.tolist()) == sorted({*ids.tolist()} - {n - 1})
        for i, got, many in zip(used, sums, times, strict=True):
            assert many == (ids == i).sum() and np.allclose(got, changes[ids == i].sum(0) / np.sqrt(many), atol=1e-5)


OPERATORS = {
    "quality_rules": lambda df, spark: quality_rules.judge(df),
    "passing": lambda df, spark: quality_rules.passing(df),
    "mix": lambda df, spark: mixing.mix(df),
    "mixed_rows": lambda df, spark: mixing.mixed_rows(df),
    "jaccard": lambda df, spark: jaccard.classes(df),
    "deduplicate": lambda df, spark: jaccard.deduplicate(df),
    "leaks": lambda df, spark: tiling.leaks(df, spark.read.parquet(f"{DATA}/benchmark.parquet")),
    "pii": lambda df, spark: pii.find(df),
    "redact": lambda df, spark: pii.redact(df),
    "licences": lambda df, spark: license_scan.scan(df),
    "ranker": lambda df, spark: ranker.score(df, spark.read.parquet(f"{DATA}/labels.parquet")),
    "likelihood": lambda df, spark: pseudo_likelihood.score(df, pseudo_likelihood.fit(df)),
    "url_filter": lambda df, spark: url_filter.judge(df.withColumn("url", F.col("text"))),
    "warc": lambda df, spark: warc.round_trip(df.select(*(c for c in df.columns if c != "doc_id"), F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_and_clashing(name, spark, empty, hard, clashing):
    assert OPERATORS[name](empty, spark).count() == 0
    want, got = OPERATORS[name](hard, spark), OPERATORS[name](clashing, spark)
    mine = [c for c in want.columns if c in got.columns and c not in ("probability", "log_likelihood", "mean_log_likelihood", "perplexity")]
    assert key(got.select(*mine).collect(), *mine) == key(want.select(*mine).collect(), *mine)


@pytest.mark.parametrize("which", ["docs", "hard", "empty", "clashing"])
def test_pipeline_stages(which, spark, request, tmp_path):
    df = request.getfixturevalue(which)
    columns = df.columns
    counts = [df.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = df
        stage(spark, df, DATA).write.parquet(str(tmp_path / str(n)))
        df = spark.read.parquet(str(tmp_path / str(n)))
        counts.append(df.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == columns
        if which == "docs":
            check_stage(spark, name, before.collect(), df.collect())
    assert counts == sorted(counts, reverse=True)
    if which == "docs":
        assert counts[-1] > 0


def check_stage(spark, name, before, after):
    ids = {r.doc_id for r in after}
    if name == "quality rules":
        assert not any(plain.quality(r.text)[-1] for r in after)
    if name == "n-gram Jaccard join":
        assert ids == {c for _, c in plain.components([(r.doc_id, r.text) for r in before], 5, 80).values()}
    if name == "benchmark decontamination":
        passages = [" ".join(plain.words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
        assert ids == {r.doc_id for r in before if not any(p in " ".join(plain.words(r.text)) for p in passages)}
    if name == "PII":
        assert len(after) == len(before) and not any(plain.spans(r.text) for r in after) and all(r.n_chars == len(r.text) for r in after)
    if name == "mixing sources":
        assert {r.doc_id for r in after} <= {r.doc_id for r in before} and all(1 <= r.copies <= 3 for r in after)


def test_queries_and_sql_have_the_same_columns(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, DATA)
        names = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want)), name
