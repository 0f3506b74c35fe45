"""Masked pseudo-likelihood of documents under a small bidirectional network, trained on the corpus itself.

The network sees WINDOW words on both sides of a position, never the word there: their embeddings, weighted by place,
sum to a hidden layer whose softmax gives the class of the missing word; the word's share of its class's count gives
the rest. A document's score is the sum, over all its words, of the log-probability of each given those around it.

Words are counted over the whole corpus, and the counts of all are kept in a table. The most frequent ones, VOCABULARY
at most, have embeddings and, by frequency, classes of about equal mass; all others share one embedding and one class,
in which a word is as likely as its own count says: a join with the table tells it. In each
of ROUNDS every partition trains on its share of the positions of every text, a random one by place; the rounds' shares
are disjoint and together all positions. Spark averages the parameters, row by row, weighted by how often a partition has trained them: what a partition sends is bounded by the model and the number of
partitions follows the corpus, and what the driver gets is one model.

Defined cases: null and empty texts have no words, a score of 0 and no mean; repeated rows are scored each; null ids
pass through; further columns do not matter; an empty table gives an empty table; a word that the corpus has not counts
as half an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclith.llm.shared import keep
from doclith.llm.tokens import U, Words, chunks, lists, mix

VOCABULARY = 1 << 15
CLASSES = 128
WIDTH = 16
WINDOW = 2
ROUNDS = 2
BLOCK = 1024  # positions at once: their chances of all classes stay in a core's cache
BATCH = 1024  # positions a training step
RATE = 0.1
UNSEEN = 0.5  # the count of words that the corpus has not
SEED = 11
LEAD_BITS = 17  # of a word's hash, by which it is looked up
HASH_BITS = 60  # of a word, leading ones, by which equally frequent words are chosen
PLACES = [j for j in range(-WINDOW, WINDOW + 1) if j]


@dataclass
class Vocabulary:
    """Known words by hash, in order; their classes; the log-share of each word in its class; 0 is all other words."""

    hashes: np.ndarray
    classes: np.ndarray  # by id; ids follow hashes from 1 on, then comes the padding
    shares: np.ndarray
    priors: np.ndarray  # log-probability of each class
    usual: float  # logarithm of the mean count of a kind of other words

    @property
    def padding(self) -> int:
        return len(self.hashes) + 1

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        lead = (hashes >> U(64 - LEAD_BITS)).astype(np.int64)
        at, end, out = self._first[lead], self._first[lead + 1], np.zeros(len(hashes), np.int32)
        left = np.flatnonzero(at < end)
        while len(left):  # the first of the known words with these leading bits, then the second one, and so on
            here = at[left]
            same = self.hashes[here] == hashes[left]
            out[left[same]] = here[same] + 1
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    @cached_property
    def _first(self) -> np.ndarray:
        """Of each value of the leading bits the first known word that has it or a higher one."""
        return np.searchsorted(self.hashes >> U(64 - LEAD_BITS), np.arange((1 << LEAD_BITS) + 1, dtype=U)).astype(np.int32)


def vocabulary(hashes: np.ndarray, counts: np.ndarray, all_words: int, all_kinds: int) -> Vocabulary:
    """From the most frequent words and the totals of the corpus."""
    order = np.argsort(-counts, kind="stable")
    mass = counts.sum()
    classes = np.zeros(len(counts) + 2, np.int32)
    if len(counts):
        middle = np.cumsum(counts[order]) - counts[order] / 2
        label = 1 + np.minimum((middle / mass * (CLASSES - 1)).astype(int), CLASSES - 2)
        by_hash = np.argsort(hashes)
        classes[1:-1] = label[np.argsort(order)][by_hash]
        hashes, counts = hashes[by_hash], counts[by_hash]
    total = np.bincount(classes[1:-1], weights=counts, minlength=CLASSES).astype(float)
    total[0] = max(all_words - mass, 0) + UNSEEN  # texts scored later can have other words where this corpus has none
    shares = np.zeros(len(counts) + 2)
    shares[0] = -np.log(max(all_kinds - len(counts), 1))
    shares[1:-1] = np.log(counts / total[classes[1:-1]])
    return Vocabulary(hashes, classes, shares.astype(np.float32), np.log(np.maximum(total / max(total.sum(), 1), 1e-17)).astype(np.float32), float(np.log(total[0]) + shares[0]))


@dataclass
class Network:
    """Rows of WIDTH numbers: an embedding for each id, a weight for each place, a vector for each class, its bias."""

    rows: np.ndarray

    @staticmethod
    def new(known: Vocabulary) -> Network:
        n = known.padding + 1
        rows = np.random.default_rng(SEED).normal(0, 0.3, (n + len(PLACES) + CLASSES + CLASSES // WIDTH, WIDTH)).astype(np.float32)
        rows[known.padding] = 0
        rows[n : n + len(PLACES)] = 1
        rows[n + len(PLACES) : -(CLASSES // WIDTH)] *= 0.3
        rows[-(CLASSES // WIDTH) :] = known.priors.reshape(-1, WIDTH)
        return Network(rows)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views: embeddings, places, class vectors, biases."""
        k = len(self.rows) - CLASSES // WIDTH
        return self.rows[: k - CLASSES - len(PLACES)], self.rows[k - CLASSES - len(PLACES) : k - CLASSES], self.rows[k - CLASSES : k], self.rows[k:].reshape(-1)


def _padded(w: Words, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with padding around every text, the place of each word in them, and each word's text."""
    n = np.diff(w.bounds)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(text)) + WINDOW * (text + 1)
    ids = np.full(len(text) + WINDOW * (len(n) + 1), known.padding, np.int32)
    ids[at] = known.ids(w.hashes)
    return ids, at, text


def _forward(parts: tuple, ids: np.ndarray, at: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Ids around the positions, their embeddings, the hidden layer and a unit of one, and the classes' chances there, which
    do not sum to one: they are written to ``room``, so that no large array is made anew each step."""
    embeddings, places, vectors, biases = parts
    near = np.stack([ids[at + j] for j in PLACES])
    around = [embeddings.take(n, 0) for n in near]
    hidden = np.ones((len(at), WIDTH + 1), np.float32)
    layer = around[0] * places[0]
    for x, place in zip(around[1:], places[1:], strict=True):
        layer += x * place
    np.tanh(layer, out=hidden[:, :WIDTH])
    logits = np.matmul(hidden, np.concatenate([vectors, biases[:, None]], 1).T, out=room[: len(at)])
    if np.abs(vectors).sum(1).max() + np.abs(biases).max() > 40:  # no hidden unit is above 1
        np.clip(logits, -40, 40, out=logits)
    return near, around, hidden, np.exp(logits, out=logits)


def log_probabilities(network: Network, known: Vocabulary, w: Words) -> np.ndarray:
    """Of each word given the words around it; other words as if each kind had their mean count."""
    return _scored(network, known, *_padded(w, known)[:2])


def _scored(network: Network, known: Vocabulary, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same, of the words at these places of padded ids."""
    out, parts, room, ones = np.empty(len(at), np.float32), network.parts(), np.empty((BLOCK, CLASSES), np.float32), np.ones(CLASSES, np.float32)
    for a in range(0, len(at), BLOCK):
        here = at[a : a + BLOCK]
        *_, chances = _forward(parts, ids, here, room)
        word = ids[here]
        out[a : a + BLOCK] = np.log(chances[np.arange(len(here)), known.classes[word]] / (chances @ ones)) + known.shares[word]
    return out


def _order(ids: np.ndarray, n: int) -> np.ndarray:
    """An order of ids below n; 16 bits are sorted by digits, in a fraction of the time."""
    return np.argsort(ids.astype(np.uint16), kind="stable") if n <= 1 << 16 else np.argsort(ids)


def _by_word(ids: np.ndarray, changes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of changes for ids below n: each id but the last, the padding, which stays 0; the sum of its changes by the root of
    their number; this number. Most ids are there once: only others need sums, and come first."""
    order = _order(ids, n)
    ids = ids[order]
    behind = np.searchsorted(ids, n - 1)
    ids, order = ids[:behind], order[:behind]
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    times = np.diff(first, append=behind)
    often = times > 1
    many = times[often]
    out = np.empty((len(first), WIDTH), np.float32)
    if len(many):
        np.add.reduceat(changes.take(order[np.repeat(often, times)], 0), np.cumsum(many) - many, axis=0, out=out[: len(many)])
        out[: len(many)] /= np.sqrt(many[:, None], dtype=np.float32)
    once = first[~often]
    changes.take(order[once], 0, out=out[len(many) :], mode="clip")
    return np.concatenate([ids[first[often]], ids[once]]), out, np.concatenate([many, times[~often]])


class Trainer:
    """Adagrad on one partition; counts how often each row was trained."""

    def __init__(self, network: Network) -> None:
        self.network = Network(network.rows.copy())
        self.squares = np.full_like(self.network.rows, 0.1)
        self.times = np.zeros(len(self.network.rows), np.int64)

    def _step(self, rows: np.ndarray | slice, gradient: np.ndarray, times: np.ndarray | int) -> None:
        squares = self.squares[rows] + gradient * gradient
        self.squares[rows] = squares
        self.network.rows[rows] -= RATE * gradient / np.sqrt(squares)
        self.times[rows] += times

    def _step_each(self, rows: np.ndarray, gradient: np.ndarray, times: np.ndarray) -> None:
        """The same for single rows, none twice; the gradient is overwritten."""
        squares = self.squares.take(rows, 0)
        squares += gradient * gradient
        self.squares[rows] = squares
        gradient *= RATE
        gradient /= np.sqrt(squares, out=squares)
        self.network.rows[rows] = np.subtract(self.network.rows.take(rows, 0), gradient, out=gradient)
        self.times[rows] += times

    def learn(self, ids: np.ndarray, at: np.ndarray, classes: np.ndarray) -> None:
        parts = self.network.parts()
        embeddings, places, vectors, _ = parts
        n, m = len(embeddings), len(places)
        room, ones, changes = np.empty((BATCH, CLASSES), np.float32), np.ones(CLASSES, np.float32), np.empty((m, BATCH, WIDTH), np.float32)
        for a in range(0, len(at), BATCH):
            here = at[a : a + BATCH]
            near, around, hidden, error = _forward(parts, ids, here, room)
            total = error @ ones
            error[np.arange(len(here)), classes[ids[here]]] -= total
            part = (1 / total)[:, None]  # the error is this times what stands in error
            layer = hidden[:, :WIDTH]
            back = (error @ vectors) * (part * (1 - layer * layer))
            by_class = error.T @ (hidden * (part / np.float32(len(here))))
            change = changes[:, : len(here)]
            np.multiply(back, places[:, None], out=change)
            used, by_word, times = _by_word(near.reshape(-1), change.reshape(-1, WIDTH), n)
            by_place = np.stack([np.einsum("ij,ij->j", back, x) for x in around]) / np.float32(len(here))
            self._step(slice(n + m, n + m + CLASSES), by_class[:, :WIDTH], len(here))
            self._step(slice(n + m + CLASSES, None), by_class[:, WIDTH].reshape(-1, WIDTH), len(here))
            self._step(slice(n, n + m), by_place, len(here))
            self._step_each(used, by_word, times)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, w in chunks(batch.column(0), letters=True):
            found, times = np.unique(w.hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["word", "n"])


def _turns(w: Words) -> np.ndarray:
    """The round in which each position is trained: a fixed function of its place in the text."""
    n = np.diff(w.bounds)
    place = np.arange(len(w.hashes)) - np.repeat(w.bounds[:-1], n)
    return (mix(place.astype(U) + U(SEED)) % U(ROUNDS)).astype(int)


def _train(network: Network, known: Vocabulary, turn: int):
    names = ["row", "times", *(f"x{i}" for i in range(WIDTH))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, chance = Trainer(network), np.random.default_rng((SEED, turn))
        for batch in batches:
            for _, _, w in chunks(batch.column(0), letters=True):
                ids, at, _ = _padded(w, known)
                trainer.learn(ids, chance.permutation(at[_turns(w) == turn]), known.classes)
        used = np.flatnonzero(trainer.times)
        times = trainer.times[used].astype(float)
        values = trainer.network.rows[used] * times[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(times), *(pa.array(values[:, i]) for i in range(WIDTH))], names)

    return run


def _frequent(counts: DataFrame, size: int) -> DataFrame:
    """The most frequent words, ``size`` of them or all: a histogram by the logarithm of the count, of a few hundred rows,
    tells from which count on they fit. Where not all of a count's bin fit, its words are taken by their hash, up to a
    bound that histograms of the hash's leading bits find, the next bits within one bucket each."""
    step = F.floor(16 * F.log2("n")).cast("int")
    left, edge = size, -1
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        if r["count"] > left:
            edge = r["step"]
            break
        left -= r["count"]
    inside, bound, bits = counts.where(step == edge), 0, 0
    while edge >= 0 and left and bits < HASH_BITS:
        bits += 12
        bucket = F.shiftrightunsigned("word", 64 - bits)
        for r in sorted(inside.groupBy(bucket.alias("bucket")).count().collect(), key=lambda r: r["bucket"]):
            bound = r["bucket"] << (HASH_BITS - bits)
            if r["count"] > left:
                break
            left -= r["count"]
        inside = inside.where(bucket == r["bucket"])
    return counts.where((step > edge) | ((step == edge) & (F.shiftrightunsigned("word", 64 - HASH_BITS) < bound)))


def fit(docs: DataFrame, text: str = "text", size: int = VOCABULARY) -> tuple[Network, Vocabulary, DataFrame]:
    """Counts and trains on all texts; the table has all words' counts: word, n."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    counts = keep(texts.mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "likelihood-words")
    words, kinds = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    top = _frequent(counts, size).toPandas()
    known = vocabulary(top["word"].to_numpy(np.int64).view(U), top["n"].to_numpy(float), words or 0, kinds)
    network = Network.new(known)
    schema = "row long, times double, " + ", ".join(f"x{i} double" for i in range(WIDTH))
    for turn in range(ROUNDS):
        sums = texts.mapInArrow(_train(network, known, turn), schema).groupBy("row").agg(F.sum("times").alias("times"), *(F.sum(f"x{i}").alias(f"x{i}") for i in range(WIDTH))).toPandas()
        rows = network.rows.copy()
        rows[sums["row"].to_numpy(int)] = sums[[f"x{i}" for i in range(WIDTH)]].to_numpy() / sums[["times"]].to_numpy()
        network = Network(rows)
    return network, known, counts


def _score(network: Network, known: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in chunks(batch.column(1), letters=True):
                n = np.diff(w.bounds)
                ids, at, text = _padded(w, known)
                total = np.bincount(text, weights=_scored(network, known, ids, at), minlength=len(n))
                others = np.flatnonzero(ids[at] == 0)
                found = lists(w.hashes[others], np.searchsorted(others, w.bounds))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(total), found], ["key", "n", "total", "others"])

    return run


def score(docs: DataFrame, model: tuple[Network, Vocabulary, DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, log_likelihood (the sum), mean_log_likelihood, perplexity of every document."""
    *model, counts = model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    run = lambda batches: _score(*shared.value)(batches)
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n long, total double, others array<long>")
    # The row number is written with the rows, once: the join below can't see another one.
    out = keep(out.withColumn("row", F.monotonically_increasing_id()), "likelihood-scores")
    counted = out.select("row", F.explode("others").alias("word")).join(counts.withColumnRenamed("n", "times"), "word", "left")
    more = counted.groupBy("row").agg(F.sum(F.log(F.coalesce(F.col("times").cast("double"), F.lit(UNSEEN))) - F.lit(model[1].usual)).alias("more"))
    out = out.select("row", "key", "n", "total").join(more, "row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_tokens"), F.col("total").alias("log_likelihood"), mean.alias("mean_log_likelihood"), F.exp(-mean).alias("perplexity"))
