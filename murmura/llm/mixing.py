"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, each source's target over its tokens is its
repetition rate, and a document is emitted floor(rate) times plus once more
with the probability of the rate's fraction, drawn from a hash of its id.

One step goes beyond a single Bernoulli draw: each source takes, of ``DRAWS``
independent ones, that whose copies come nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.operators.ranks import numbered
from murmura.scratch import bounded_broadcast, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this many are broadcast; beyond, the join is salted and shuffled.
BROADCAST_SOURCES = 100_000
#: Independent draws that are tried for each source; the one nearest to its target counts.
DRAWS = 64
BITS = 48


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int, k: Column) -> Column:
    """12 hexadecimal digits, a number below 2**48, from the id (null as the text 'null'), the seed and the try."""
    return F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(str(seed)), k.cast("string"))), 1, BITS // 4)


def bar(rate: Column) -> Column:
    """The hexadecimal digits below which a draw gives one copy more: the rate's fraction of 2**48."""
    most = F.ceil((rate - F.floor(rate)) * F.lit(float(1 << BITS)))
    return F.format_string(f"%0{BITS // 4}x", F.least(most, F.lit((1 << BITS) - 1)).cast("long"))


def with_targets(sources: DataFrame, weight: Column, cap: int) -> DataFrame:
    """Adds ``target``: all sizes shared by weight, none above cap times its source's size.

    The excess of capped sources goes to the others by weight until none is
    above.  Each round is one distributed sum, and there are at most as many
    rounds as there are sources that reach the cap one after the other.
    """
    s = materialize(sources.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * cap), "mix-weights")
    total, weights = s.agg(F.sum("source_size"), F.sum("_w")).first()
    total, weights, full = total or 0, weights or 1, 0
    rest, share = total, weights
    while True:
        over = F.col("_w").cast("double") * F.lit(float(rest)) > F.col("_cap").cast("double") * F.lit(float(share))
        n, used, freed = s.where(over).agg(F.count("*"), F.sum("_cap"), F.sum("_w")).first()
        if n == full or n == 0 or weights == freed:
            break
        full, rest, share = n, total - used, weights - freed
    return s.withColumn("target", F.when(over, F.col("_cap").cast("double")).otherwise(F.lit(float(rest)) * F.col("_w") / F.lit(float(share)))).drop("_w", "_cap")


def source_rates(docs: DataFrame, weights, cap: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes, and each source's size, target, rate and draw."""
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    ranked = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = materialize(with_targets(ranked, weight, cap).withColumn("rate", rate).withColumn("_bar", bar(F.col("rate"))), "mix-rates")
    tries = (
        join_source(sizes, rates)
        .groupBy("source")
        .agg(
            F.first("rate").alias("rate"),
            F.first("source_size").alias("source_size"),
            *[F.sum(F.when(hit(seed, F.lit(k)), F.col("size")).otherwise(0)).alias(f"_t{k}") for k in range(DRAWS)],
        )
    )
    wish = (F.col("rate") - F.floor("rate")) * F.col("source_size")
    best = F.least(*[F.struct(F.abs(F.col(f"_t{k}") - wish).alias("d"), F.lit(k).alias("k")) for k in range(DRAWS)])
    chosen = tries.select(F.col("source").alias("_source"), best["k"].alias("_try"))
    return sizes, materialize(rates.join(chosen, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "mix-draws")


def hit(seed: int, k: Column) -> Column:
    return draw(F.col("doc_id"), seed, k) < F.col("_bar")


def copies(seed: int) -> Column:
    return (F.floor("rate") + F.when(hit(seed, F.col("_try")), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, seed: int = 20) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, rate, copies.

    Sources by code point, null last, take ``weights`` in turn.  Among ``DRAWS``
    independent seeded draws each source keeps the one whose copies come nearest
    to its target (ties: the first), so small sources meet theirs as well.  Null
    text has size 0, a null source is a source of its own, repeated ids draw
    alike, an empty table gives an empty result, and other columns are ignored.
    """
    sizes, rates = source_rates(docs, weights, cap, seed)
    return join_source(sizes, rates).select("doc_id", "source", "size", "source_size", "target", "rate", copies(seed).alias("copies"))


def emit(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, seed: int = 20) -> DataFrame:
    """The mixed rows: each input row as often as ``mix`` says, with its own columns.

    Texts are not shuffled: the source's rate comes to the document and the
    copies follow from its id.  Extra columns of any name pass through.
    """
    _, rates = source_rates(docs, weights, cap, seed)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "source", "doc_id")
    out = join_source(keyed, rates).withColumn("_n", copies(seed).cast("int")).where("_n > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_doc.*")


def join_source(sizes: DataFrame, rates: DataFrame, limit: int = BROADCAST_SOURCES) -> DataFrame:
    """Attaches a source's row to its documents; a hot source is never dealt to one task."""
    small, fits = bounded_broadcast(rates, limit)
    if fits:
        return sizes.join(small, sizes["source"].eqNullSafe(small["source"])).drop(small["source"])
    salted = sizes.withColumn("_salt", (F.monotonically_increasing_id() % 64).cast("int"))
    spread = rates.withColumnRenamed("source", "_source").withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(63))))
    on = salted["source"].eqNullSafe(spread["_source"]) & (salted["_salt"] == spread["_salt2"])
    return salted.join(spread, on).drop("_source", "_salt", "_salt2")
