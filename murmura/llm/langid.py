"""Language identification: sparse multinomial regression on TF-IDF character n-grams.

Weights come from follow-the-regularised-leader with an elastic net, and a
temperature fitted on rows that the weights have not seen calibrates scores.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.scratch import small_batches

BUCKETS = 1 << 14
#: Rows of the training sample in all.
TRAIN_ROWS = 4000
UNKNOWN = "und"
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def letter_codes(text: str) -> np.ndarray:
    """Lower-case code points between two blanks; ASCII that is no letter is blank."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).copy()
    code[(code < 97) | ((code > 122) & (code < 128))] = 32
    return code


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of the text's one-, two- and three-character n-grams."""
    code = letter_codes(text)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    a, b, c = (code * np.uint32(m) for m in MULTIPLIERS)
    keys = [a, a[:-1] ^ (b[1:] + np.uint32(1)), a[:-2] + (b[1:-1] ^ (c[2:] + np.uint32(2)))]
    keys = [(k ^ (k >> np.uint32(15))) * np.uint32(0x2C1B3C6D) for k in keys]
    return np.bincount(np.concatenate([k >> shift for k in keys]), minlength=BUCKETS)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(-1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights ``[buckets, classes]`` and biases from sparse rows ``(indices, values)``.

    Per-coordinate proximal steps; ``l1`` leaves coordinates at exactly zero.
    """
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) > l1, w, 0.0)

    for _ in range(epochs):
        for (at, value), k in zip(rows, y, strict=True):
            at, value = np.append(at, BUCKETS), np.append(value, 1.0)
            w = weights(at)
            p = softmax(value @ w)
            p[k] -= 1
            g = value[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:BUCKETS], w[BUCKETS]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log-loss, on a fine grid."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.02, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    heat: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A label and its calibrated probability for each whole text."""
        said, score = [], np.zeros(len(texts))
        fit = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.labels else []
        best = {}
        for a in range(0, len(fit), 64):
            part = fit[a : a + 64]
            x = tfidf(np.stack([gram_counts(texts[i]) for i in part]), self.idf)
            p = softmax((x @ self.weights + self.bias) / self.heat)
            for i, row in zip(part, p, strict=True):
                best[i] = self.labels[int(row.argmax())]
                score[i] = row.max()
        said = [best.get(i, UNKNOWN) for i in range(len(texts))]
        return said, score


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def level(sizes: list[int], room: int) -> int:
    """The least rows for each size, or all of a smaller one, that fill the room together."""
    left = sorted(sizes)
    for i, n in enumerate(left):
        each = -(-room // (len(left) - i))
        if n >= each:
            return max(1, each)
        room -= n
    return max(1, left[-1])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from the text and non-null lang of documents that aren't held out.

    Document frequencies count all of these documents.  The weights learn from a
    sample of at most ``train_rows`` of them, chosen by a hash of the id: every
    language has as many as any other, or all that it has.  Their whole texts
    are learned; one in five of each language only sets the temperature.
    Without such documents the model knows no label and says ``und``.
    """
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches):
        total = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                for text in b.column(0).slice(a, 256).to_pylist():
                    total[:BUCKETS] += gram_counts(text) > 0
                    total[BUCKETS] += 1
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    seen = np.zeros(BUCKETS + 1)
    for bucket, n in rows.select("text").transform(small_batches).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        seen[bucket] = n  # one row for each bucket
    idf = np.log((1 + seen[BUCKETS]) / (1 + seen[:BUCKETS])) + 1

    # the largest languages: the sample has no room for more
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(train_rows).collect()}
    if not sizes:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    each = level(list(sizes.values()), train_rows)
    wide = 1 << 30
    # more than are needed, as draws scatter; ranks within the language then cut them
    shares = docs.sparkSession.createDataFrame([(k, min(wide, int(wide * (1.5 * each + 30) / v) + 1)) for k, v in sizes.items()], "_lang string, _share long")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(wide))
    drawn = rows.withColumn("_draw", draw).join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(F.col("_draw") < F.col("_share"))

    def features(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                at, value = [], []
                for text in part.column(3).to_pylist():
                    v = tfidf(gram_counts(text), idf)
                    at.append(np.flatnonzero(v).astype(np.uint16))
                    value.append(v[at[-1]].astype(np.float32).tobytes())
                yield pa.record_batch([*[part.column(i) for i in range(3)], pa.array([x.tobytes() for x in at], pa.binary()), pa.array(value, pa.binary())], ["draw", "id", "lang", "at", "value"])

    vectors = drawn.select("_draw", F.col("doc_id").cast("string"), "lang", "text").transform(small_batches).mapInArrow(features, "draw long, id string, lang string, at binary, value binary")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "at", "value"))
    sample = vectors.withColumn("rank", rank).orderBy("rank", "draw", "id", "lang", "at", "value").limit(train_rows).collect()
    # one in five of each language aside; then in an order that languages have no part in
    sample = sorted(((zlib.crc32(f"{r['id']}:{r['rank']}".encode()), r["lang"], r["rank"], r["at"], r["value"]) for r in sample))
    labels = sorted({r[1] for r in sample})
    y = np.array([labels.index(r[1]) for r in sample])
    sparse = [(np.frombuffer(at, np.uint16).astype(np.int32), np.frombuffer(value, np.float32)) for *_, at, value in sample]
    aside = np.array([r[2] % 5 == 0 for r in sample])
    w, b = follow_the_leader([s for s, out in zip(sparse, aside, strict=True) if not out], y[~aside], len(labels))
    logits = np.stack([sparse[i][1] @ w[sparse[i][0]] + b for i in np.flatnonzero(aside)]) if aside.any() else np.zeros((0, len(labels)))
    return Model(labels, idf, w.astype(np.float32).astype(float), b, temperature(logits, y[aside]))


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` with ``_lang_pred`` and ``_score`` for every row's whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text for a model without labels.  Ids may be null or repeated, empty tables
    give empty results, and other columns are ignored.
    """
    # buckets x labels numbers; plain values, as broadcasts travel without this module
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.idf, model.weights, model.bias, model.heat))

    def run(batches):
        model = Model(*shared.value)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                said, score = model.predict(part.column(len(keep)).to_pylist())
                yield pa.record_batch([*[part.column(i) for i in range(len(keep))], pa.array(said, pa.string()), pa.array(score)], [*keep, "_lang_pred", "_score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text")).transform(small_batches).mapInArrow(run, f"{fields}, _lang_pred string, _score double")


def predict(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, after ``fit`` on the same table."""
    out = identify(docs, fit(docs, train_rows), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def keep_known(docs: DataFrame, least: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Documents, with their own columns, whose language is known with at least that probability.

    Null texts and texts without a letter go.  Columns travel under numbers, so
    any names may come; ids may be null or repeated, and an empty table gives an
    empty result.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    numbered = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("text"))
    out = identify(numbered, fit(docs, train_rows), names)
    return out.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= least)).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
