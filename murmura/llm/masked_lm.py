"""Masked pseudo-likelihood with a bidirectional window network in numpy.

The network predicts a word from those around it on both sides.  Training masks
a seeded share of the positions of every document; each task trains on its own
part of the corpus and the weights are averaged over the words trained on, for
a few rounds.  A document's score is the sum of the logarithms of every word's
probability given both sides: the network's probability of the word's output,
times, where words share an output, the word's own share of it by the counts of
all words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.textarrays import TextArrays, mix
from murmura.scratch import materialize, small_batches

#: Words with an output of their own; the others share ``OTHERS`` hashed outputs.
FREQUENT = 384
OTHERS = 127
#: The last input stands for what lies beyond a document's ends.
EDGE = FREQUENT + OTHERS
OUTPUTS = EDGE
SIDE = 2
WIDTH = 16
MASKED = 0.15
ROUNDS = 2
BATCH = 512
#: Words scored at once.
SCORED = 512
RATE = 0.15
SEED = 11
#: Distinct words that a task counts before it hands its counts on.
WORDS_HELD = 1 << 20
#: Counts that travel to every task; rarer words are joined to theirs.
COMMON = 1 << 18
#: Sums of weights are made over at most so many parts at once.
FAN_IN = 64


def offsets() -> list[int]:
    return [d for d in range(-SIDE, SIDE + 1) if d]


@dataclass
class Network:
    """Embeddings ``[2 * SIDE, EDGE + 1, WIDTH]``, hidden bias, output weights and biases."""

    embed: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, prior: np.ndarray, seed: int = SEED) -> Network:
        """Small seeded weights; the output biases are the words' own log-probabilities."""
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (2 * SIDE, EDGE + 1, WIDTH)).astype(np.float32), np.zeros(WIDTH, np.float32), rng.normal(0, 0.1, (WIDTH, OUTPUTS)).astype(np.float32), np.log(prior).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embed, self.hidden, self.out, self.bias)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        shapes = [(2 * SIDE, EDGE + 1, WIDTH), (WIDTH,), (WIDTH, OUTPUTS), (OUTPUTS,)]
        cut = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
        return cls(*[flat[a:b].reshape(s).astype(np.float32) for a, b, s in zip(cut, cut[1:], shapes, strict=False)])

    def state(self, around: np.ndarray) -> np.ndarray:
        """Hidden values for contexts ``[n, 2 * SIDE]``."""
        h = self.hidden + self.embed[0, around[:, 0]]
        for j in range(1, around.shape[1]):
            h = h + self.embed[j, around[:, j]]
        return np.tanh(h)

    def log_probs(self, around: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log p(word | both sides), in blocks that fit into a core's cache.

        Hidden values lie within -1 and 1, so logits are bounded by the weights
        and exponentials are taken as they are; ``scale`` keeps them in range.
        """
        got = np.empty(len(words), np.float64)
        weights = np.vstack([self.out, self.bias])
        scale = np.float32(max(0.0, float(np.abs(self.out).sum(0).max() + self.bias.max()) - 60.0))
        weights[-1] -= scale
        columns = np.ascontiguousarray(weights.T)
        h = np.ones((SCORED, WIDTH + 1), np.float32)
        z = np.empty((SCORED, OUTPUTS), np.float32)
        ones = np.ones(OUTPUTS, np.float32)
        for a in range(0, len(words), SCORED):
            at = words[a : a + SCORED]
            n = len(at)
            h[:n, :WIDTH] = self.state(around[a : a + n])
            np.matmul(h[:n], weights, out=z[:n])
            own = np.einsum("ij,ij->i", h[:n], columns[at])
            np.exp(z[:n], out=z[:n])
            got[a : a + n] = own - np.log(z[:n] @ ones)
        return got

    def step(self, around: np.ndarray, words: np.ndarray, rate: float) -> None:
        """One gradient step on a batch."""
        n = len(words)
        h = self.state(around)
        p = h @ self.out
        p += self.bias
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p *= rate / p.sum(1, keepdims=True)
        p[np.arange(n), words] -= rate
        back = (p @ self.out.T) * (1 - h * h)
        root = np.float32(1 / np.sqrt(n))
        self.out -= (h.T @ p) * root
        self.bias -= p.mean(0)
        self.hidden -= back.mean(0)
        back *= root
        for j in range(around.shape[1]):
            by = np.argsort(around[:, j], kind="stable")
            at = around[by, j]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            self.embed[j, at[first]] -= np.add.reduceat(back[by], first, axis=0)


def word_ids(arrays: TextArrays, vocabulary: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output number and row of every word; frequent words by rank of their hash, others by hash."""
    starts, ends, row = arrays.words(data, off)
    h = arrays.span_hashes(data, starts, ends)
    return outputs(h, vocabulary), row


def outputs(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Output number of each hashed word."""
    other = (FREQUENT + (mix(h) >> np.uint64(32)) % np.uint64(OTHERS)).astype(np.int64)
    if not len(vocabulary):
        return other
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, other)


def contexts(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The words around each word, ``EDGE`` beyond its document's ends."""
    around = np.full((len(ids), 2 * SIDE), EDGE, np.int64)
    for j, d in enumerate(offsets()):
        a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
        if len(ids) > abs(d):
            around[a, j] = np.where(row[a] == row[b], ids[b], EDGE)
    return around


def count_words(docs: DataFrame) -> DataFrame:
    """word (its hash) and n over all documents; written, since it is read twice."""

    def run(batches):
        arrays, held = TextArrays(), []

        def settle():
            word, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        size = 0
        for b in batches:
            for _, _, data, off in arrays.batches(b.column(0)):
                starts, ends, _ = arrays.words(data, off)
                held.append(arrays.span_hashes(data, starts, ends))
                size += len(starts)
                if size >= 4 * WORDS_HELD:
                    yield settle()
                    size = 0
        if held:
            yield settle()

    return materialize(docs.select("text").transform(small_batches).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def averaged(parts: DataFrame) -> np.ndarray | None:
    """The mean of the parts' weights by the words they trained on, summed in a tree."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float64) for x in pdf["sums"]], axis=0)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN_IN], "words": [int(pdf["words"].sum())], "sums": [total.tobytes()]})

    fields = "part long, words long, sums binary"
    rows = materialize(parts, "lm-weights")
    while rows.count() > FAN_IN:
        key = F.floor(F.col("part") / FAN_IN)
        rows = materialize(rows.groupBy(key.alias("_group")).applyInPandas(add, fields), "lm-weights")
    got = rows.collect()  # FAN_IN rows at most
    words = sum(r["words"] for r in got)
    return np.sum([np.frombuffer(r["sums"], np.float64) for r in got], axis=0) / words if words else None


@dataclass
class Shares:
    """Counts of all words, for the words' shares of the outputs that they have in common.

    A word seen n times has n / (words + distinct words of its output), and one
    never seen 1 / (words + distinct words): as many words are taken to be unseen
    as are seen.  ``sizes`` are the denominators by output, 1 for those of a
    single word.  ``common`` are sorted hashes of at most ``COMMON`` words, those
    seen ``least`` times or more, and ``times`` their counts.
    """

    counts: DataFrame
    sizes: np.ndarray
    least: int
    common: np.ndarray
    times: np.ndarray


def shares(counts: DataFrame, vocabulary: np.ndarray) -> Shares:
    """``Shares`` from the table of ``count_words``; the driver gets sums and ``COMMON`` words at most."""
    shared = counts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary = shared.value
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            n = b.column(1).to_numpy()
            # outputs, then binary magnitudes of the counts
            key = np.concatenate([outputs(h, vocabulary), OUTPUTS + np.frexp(n.astype(float))[1] - 1])
            n = np.concatenate([n, n])
            some, at = np.unique(key, return_inverse=True)
            yield pa.record_batch([pa.array(some.astype(np.int64)), pa.array(np.bincount(at, n).astype(np.int64)), pa.array(np.bincount(at).astype(np.int64))], ["key", "n", "distinct"])

    sizes, magnitude = np.zeros(OUTPUTS), np.zeros(64, np.int64)
    for key, n, distinct in counts.select("word", "n").mapInArrow(run, "key long, n long, distinct long").groupBy("key").agg(F.sum("n"), F.sum("distinct")).collect():
        if key < OUTPUTS:
            sizes[key] = n + distinct  # one row for each output
        else:
            magnitude[key - OUTPUTS] = distinct
    sizes[:FREQUENT] = 1
    over = magnitude[::-1].cumsum()[::-1]
    least = 1 << max(1, int((over > COMMON).sum()))
    top = counts.where(F.col("n") >= least).select("word", "n").toArrow()
    word, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by = np.argsort(word)
    return Shares(counts, np.maximum(sizes, 1), least, word[by], n[by])


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, Network]:
    """The sorted hashes of the frequent words, and the network.

    Every document takes part: all its words are counted, and a share of
    ``MASKED`` of its positions, drawn by a seeded hash, is predicted in each
    round.
    """
    return fit(docs, count_words(docs), rounds)


def fit(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, Network]:
    """``train`` with the counts already made."""
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    by = np.argsort(hashes)
    vocabulary = hashes[by]
    prior = np.ones(OUTPUTS)
    prior[: len(by)] += np.array([r["n"] for r in top], float)[by]
    rest = (counts.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in top)
    prior[FREQUENT:] += rest / OTHERS
    net = Network.fresh(prior / prior.sum())
    for turn in range(rounds):
        net_now = net.flat()
        shared = docs.sparkSession.sparkContext.broadcast((vocabulary, net_now))
        mean = averaged(docs.select("text").transform(small_batches).mapInArrow(_trainer(shared, turn), "part long, words long, sums binary"))
        if mean is not None:
            net = Network.of(mean)
    return vocabulary, net


def _trainer(shared, turn: int):
    def run(batches):
        from pyspark import TaskContext

        vocabulary, flat = shared.value
        net, arrays, words = Network.of(flat), TextArrays(), 0
        for b in batches:
            for _, _, data, off in arrays.batches(b.column(0)):
                ids, row = word_ids(arrays, vocabulary, data, off)
                around = contexts(ids, row)
                draw = mix(np.arange(len(ids), dtype=np.uint64) + np.uint64(len(ids) * 0x9E3779B9 + turn)) >> np.uint64(40)
                chosen = np.flatnonzero(draw < np.uint64(int(MASKED * (1 << 24))))
                chosen = chosen[np.argsort(draw[chosen], kind="stable")]
                for a in range(0, len(chosen), BATCH):
                    at = chosen[a : a + BATCH]
                    words += len(at)
                    net.step(around[at], ids[at], RATE / (1 + turn))
        if words:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([words], pa.int64()), pa.array([(net.flat().astype(np.float64) * words).tobytes()], pa.binary())], ["part", "words", "sums"])

    return run


def score(docs: DataFrame, vocabulary: np.ndarray, net: Network, words: Shares | None = None) -> DataFrame:
    """doc_id, n_words, log_likelihood and mean_log_prob (null without words) of every whole text.

    With ``words`` every word is predicted; without, words of one output count
    as one.  Null and empty texts have no words and a log-likelihood of 0.  Ids
    may be null or repeated, an empty table gives an empty result, other columns
    are ignored.
    """
    # a word's count is a join for all but the common ones: the counts grow with the corpus
    known = None if words is None else (np.log(words.sizes), words.common, np.log(words.times))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, net.flat(), known))
    names = ["_row", "doc_id", "n_words", "log_likelihood", "word"]

    def run(batches):
        from pyspark import TaskContext

        vocabulary, flat, known = shared.value
        net, arrays = Network.of(flat), TextArrays()
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            for first, n, data, off in arrays.batches(b.column(1)):
                starts, ends, row = arrays.words(data, off)
                h = arrays.span_hashes(data, starts, ends)
                ids = outputs(h, vocabulary)
                got = net.log_probs(contexts(ids, row), ids)
                doc = b.column(0).slice(first, n)
                if known is not None:
                    sizes, common, times = known
                    got -= sizes[ids]
                    open_ = np.flatnonzero(ids >= FREQUENT)
                    if len(common):
                        to = np.minimum(np.searchsorted(common, h[open_]), len(common) - 1)
                        same = common[to] == h[open_]
                        got[open_[same]] += times[to[same]]
                        open_ = open_[~same]
                    if len(open_):
                        k = len(open_)
                        yield pa.record_batch([pa.array(at + row[open_]), pa.nulls(k, doc.type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.array(h[open_].view(np.int64))], names)
                count = np.bincount(row, minlength=n).astype(np.int64)
                total = np.bincount(row, got, n).astype(float)
                yield pa.record_batch([pa.array(at + np.arange(n)), doc, pa.array(count), pa.array(total), pa.nulls(n, pa.int64())], names)
                at += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").transform(small_batches).mapInArrow(run, f"_row long, doc_id {kind}, n_words long, log_likelihood double, word long")
    if words is not None:
        rows = materialize(rows, "lm-scores")
        # words seen once or never have a count of 1, whose logarithm is 0
        rare = words.counts.where((F.col("n") > 1) & (F.col("n") < words.least))
        told = rows.where("word is not null").select("_row", "word").join(rare, "word").groupBy("_row").agg(F.sum(F.log("n")).alias("_more"))
        rows = rows.where("word is null").join(told, "_row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("_more", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return rows.select("doc_id", "n_words", "log_likelihood", mean.alias("mean_log_prob"))


def train_and_score(docs: DataFrame) -> DataFrame:
    """``score`` of every word of every document by the network and the counts of all of them."""
    counts = count_words(docs)
    vocabulary, net = fit(docs, counts)
    return score(docs, vocabulary, net, shares(counts, vocabulary))
