"""Quality by importance resampling.

Hashed n-grams of target and raw text give two generative models; a document's
weight is the ratio of its probabilities under both, and Gumbel top-k samples
documents by weight.

The key is the weight's logarithm less a threshold for each n-gram, in nats,
divided by ``temperature``, plus standard Gumbel noise: at temperature 1 the
documents are drawn without replacement in proportion to their weights.  k is
the number of documents whose weight is over the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm.textarrays import BASE, TextArrays, mix
from murmura.scratch import materialize, small_batches

#: Hash buckets of each n-gram order.
BUCKETS = 1 << 12
ORDERS = 2
#: Labelled documents that the target model and the threshold learn from, at most.
TARGET_ROWS = 20_000
#: Share of the raw model in the target model; bounds an n-gram's penalty.
SMOOTHING = 0.1
SEED = 7


def grams(arrays: TextArrays, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of a chunk, in text order within a row and order.

    Tokens are runs of letters and digits or of symbols.  A token that repeats
    its predecessor makes one common repeat bigram, whatever the word.
    """
    starts, ends, row = arrays.tokens(data, off)
    h = arrays.span_hashes(data, starts, ends)
    bits = np.uint64(64 - BUCKETS.bit_length() + 1)
    one = (mix(h) >> bits).astype(np.int64)
    at = np.flatnonzero(row[1:] == row[:-1])
    pair = mix(h[at] * np.uint64(BASE) + h[at + 1])
    pair[h[at] == h[at + 1]] = np.uint64(1)
    two = (mix(pair) >> bits).astype(np.int64) + BUCKETS
    return np.concatenate([one, two]), np.concatenate([row, row[at]])


@dataclass
class Resampler:
    """Log-ratios of the n-gram buckets, the threshold per n-gram, the cut, and how keys are drawn."""

    ratio: np.ndarray
    bar: float = 0.0
    temperature: float = 1.0
    seed: int = SEED
    cut: tuple[float, str] | None = None

    def weights(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """The columns of ``keep``, n_grams and log_weight (natural logarithm)."""
        ratio = self.ratio

        def run(batches):
            arrays = TextArrays()
            for b in batches:
                for first, n, data, off in arrays.batches(b.column(len(keep))):
                    bucket, row = grams(arrays, data, off)
                    part = b.slice(first, n)
                    count = np.bincount(row, minlength=n)
                    weight = np.bincount(row, ratio[bucket], n).astype(float)
                    yield pa.record_batch([*[part.column(i) for i in range(len(keep))], pa.array(count.astype(np.int64)), pa.array(weight)], [*keep, "_grams", "_weight"])

        fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
        return docs.select(*[F.col(f"`{c}`") for c in keep], "text").transform(small_batches).mapInArrow(run, f"{fields}, _grams long, _weight double")

    def keyed(self, weights: DataFrame) -> DataFrame:
        """Adds the Gumbel key of each row; no n-grams, no key."""
        u = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(self.seed)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
        key = (F.col("_weight") - F.col("_grams") * F.lit(self.bar)) / F.lit(self.temperature) - F.log(-F.log(u))
        return weights.withColumn("_key", F.when(F.col("_grams") > 0, key))


def fit(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> tuple[Resampler, DataFrame]:
    """The models, the threshold and the documents' keys (doc_id, n-grams, weight, key).

    Target text: labelled documents of quality 1 that aren't toxic; at most
    ``target_rows`` labelled documents, first by a hash of the id.  Half of them
    make the target model; on the other half the threshold per n-gram is set
    where it loses the fewest good and keeps the fewest bad, a lost one weighing
    ten times.  The raw model counts all documents.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("string").alias("_id")).agg(F.min("quality").alias("_good"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("_toxic"))
    order = F.xxhash64("_id", F.lit(SEED))
    known = known.orderBy(order, "_id").limit(target_rows).withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(SEED + 1)), F.lit(2)))
    known = materialize(known, "importance-labels")
    target = F.broadcast(known.where("_good = 1 and _toxic = 0 and _fold = 0").select("_id", F.lit(True).alias("_target")))
    flagged = docs.select("doc_id", "text", F.col("doc_id").cast("string").alias("_key")).join(target, F.col("_key") == F.col("_id"), "left")

    def count(batches):
        arrays, total = TextArrays(), np.zeros((2, BUCKETS * ORDERS), np.int64)
        for b in batches:
            wanted = np.array([bool(x) for x in b.column(1).to_pylist()], bool)
            for first, n, data, off in arrays.batches(b.column(0)):
                bucket, row = grams(arrays, data, off)
                total[0] += np.bincount(bucket, minlength=total.shape[1])
                total[1] += np.bincount(bucket[wanted[first : first + n][row]], minlength=total.shape[1])
        some = np.flatnonzero(total[0])
        yield pa.record_batch([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "target"])

    sums = flagged.select("text", "_target").transform(small_batches).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, wanted = np.zeros(BUCKETS * ORDERS), np.zeros(BUCKETS * ORDERS)
    for bucket, a, b in sums.collect():  # one row for each bucket
        raw[bucket], wanted[bucket] = a, b
    ratio = np.zeros(BUCKETS * ORDERS)
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        if wanted[part].sum():
            seen = raw[part] > 0
            p, q = wanted[part] / wanted[part].sum(), raw[part] / raw[part].sum()
            ratio[part][seen] = np.log(((1 - SMOOTHING) * p[seen] + SMOOTHING * q[seen]) / q[seen])
    model = Resampler(ratio)
    weighed = materialize(model.weights(docs, ["doc_id"]), "importance-weights")
    check = F.broadcast(known.where("_fold = 1 and (_good = 0 or _toxic = 0)").select("_id", "_good"))
    rows = weighed.where("_grams > 0").join(check, F.col("doc_id").cast("string") == F.col("_id")).select("_good", (F.col("_weight") / F.col("_grams")).alias("_mean"))
    model.bar = threshold([tuple(r) for r in rows.orderBy(F.xxhash64("_mean"), "_good", "_mean").limit(target_rows).collect()])
    return model, model.keyed(weighed)


def threshold(rows: list[tuple[int, float]], price: float = 10.0) -> float:
    """Where ``price`` times the share of lost good plus that of kept bad is least.

    It lies in the middle of the widest gap that is best; without both kinds
    everything passes.
    """
    good, bad = np.sort([v for g, v in rows if g]), np.sort([v for g, v in rows if not g])
    if not len(good) or not len(bad):
        return -1e3
    at = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    loss = price * np.searchsorted(good, cuts) / len(good) + (len(bad) - np.searchsorted(bad, cuts)) / len(bad)
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    width = np.diff(np.concatenate([[at[0]], at, [at[-1]]]))
    return float(cuts[best[np.argmax(width[best])]])


def cut_at(keyed: DataFrame, k: int) -> tuple[float, str] | None:
    """The k-th largest ``(key, id as text)``; None if there are fewer.

    Keys are range-partitioned, so no task holds more than its share.
    """
    ordered = [F.desc("_key"), F.desc("_id")]
    rows = keyed.where("_key is not null").select("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"))
    parts = materialize(rows.repartitionByRange(*ordered).withColumn("_part", F.spark_partition_id()), "importance-order")
    rest = k
    for part, n in sorted(tuple(r) for r in parts.groupBy("_part").count().collect()):
        if rest <= n:
            place = F.row_number().over(Window.partitionBy("_part").orderBy(*ordered))
            return tuple(parts.where(F.col("_part") == part).withColumn("_n", place).where(F.col("_n") == rest).select("_key", "_id").first())
        rest -= n
    return None


def select(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> tuple[Resampler, DataFrame]:
    """The fitted sampler and the sampled rows: doc_id, n_grams, log_weight, key, kept.

    The sample's size is the number of documents whose evidence is over the
    threshold.  Texts that are null, empty or without any token are rejected;
    without usable labels every other document is kept.  Null ids share one
    draw, copies have draws of their own, ties go to the larger id as text, and
    an empty table gives an empty result.
    """
    model, keyed = fit(docs, labels, target_rows)
    k = keyed.where((F.col("_grams") > 0) & (F.col("_weight") >= F.col("_grams") * F.lit(model.bar))).count()
    model.cut = cut_at(keyed, k) if k else (float("inf"), "")
    kept = keyed.where(passes(model))
    return model, kept.select("doc_id", F.col("_grams").alias("n_grams"), F.col("_weight").alias("log_weight"), F.col("_key").alias("key"), F.lit(True).alias("kept"))


def passes(model: Resampler):
    if model.cut is None:
        return F.col("_key").isNotNull()
    key, name = model.cut
    same = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return (F.col("_key") > F.lit(key)) | ((F.col("_key") == F.lit(key)) & (same >= F.lit(name)))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled documents with their own columns; weights are taken again, texts stay where they are."""
    model, _ = select(docs, labels)
    columns = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, columns, strict=True)], F.col("doc_id"), F.col("text"))
    weighed = model.weights(renamed, ["doc_id", *columns])
    return model.keyed(weighed).where(passes(model)).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, columns, strict=True)])
