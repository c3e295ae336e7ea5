"""N-gram Jaccard join by token-combination prefixes.

A token is a word shingle, a document is its set of tokens.  Tokens are ordered
rare ones first, and two documents with a similarity of ``num / den`` share at
least ``K`` tokens within their extended prefixes, the first
``n - ceil(n * num / den) + K`` of each.  The index holds single tokens for rare
classes and K-token combinations for frequent ones; candidates are then verified
on their whole sets.

Equal sets are one class from the start.  For components, classes that are
already linked need no further links: each list of the index links its classes
to one pivot first, and only lists that still hold several components are
searched for all remaining links.  A pair comes from its first common list only,
and only if enough tokens are left from there on.  So the work on a group of
copies grows with its size, not with its pairs, and no link between different
components is missed.

Sets hold 64-bit hashes; two different tokens of a compared pair share one with
a probability below 1e-12.  Lists are named by 64-bit hashes as well; that two of
a billion share one has a probability below 0.03, and even then a pair is lost
only if it has no other list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm.textarrays import BASE, TextArrays, mix, shingle_hashes
from murmura.scratch import bounded_broadcast, materialize, small_batches

#: Tokens that documents must share within their extended prefixes.
K = 2
#: An index entry with more documents belongs to the frequent class.
RARE = 128
#: An index entry with more documents draws a pivot of its own.
SMALL = 8
#: Documents from which on a token is ordered behind the rare ones.
COMMON = 24
#: Tokens counted as frequent when ordering, at most; they are broadcast, 16 bytes each.
ORDERED = 1 << 17
#: Sets from this size on are indexed by single tokens in any class, smaller ones by combinations.
LONG = 512
#: Rounds of links to pivots, at most; they end once a round adds a smaller share than ``FEW``, or
#: at most ``PAIRS`` pairs are left for each index entry.
ROUNDS = 8
PAIRS = 8
FEW = 0.05
#: Preceding keys that tell whether a pair has come up already.
BEFORE = 4
#: Ids of documents to verify or to drop that are broadcast, 8 bytes each.
BROADCAST_IDS = 2_000_000
WORDS_COUNTED = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Shingle width and the least similarity ``num / den`` of linked documents."""

    width: int = 4
    num: int = 85
    den: int = 100
    lower: bool = True

    def needed(self, total):
        """Tokens that sets of ``total`` tokens together must share."""
        return -(-self.num * total // (self.num + self.den))


def row_sets(arrays: TextArrays, column: pa.Array, rule: Rule):
    """``(row, sorted distinct token hashes)`` of each row of a text column."""
    for first, n, data, off in arrays.batches(column, rule.lower):
        starts, ends, row = arrays.words(data, off)
        tokens, at = shingle_hashes(arrays.span_hashes(data, starts, ends), row, n, rule.width)
        for i in range(n):
            yield first + i, np.unique(tokens[at[i] : at[i + 1]])


def frequent_tokens(docs: DataFrame, rule: Rule, least: int = COMMON, limit: int = ORDERED) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and document counts of at most ``limit`` frequent tokens.

    Counts cover all documents; tokens that stay rare within every run of about
    a million are left out.  The order of tokens rests on this, not the result.
    """

    def count(batches):
        arrays, kept, room = TextArrays(), [], []

        def settle():
            if room:
                token, n = np.unique(np.concatenate(room), return_counts=True)
                kept.append((token[n > 2], n[n > 2]))
                room.clear()

        size = 0
        for b in batches:
            for _, tokens in row_sets(arrays, b.column(0), rule):
                room.append(tokens)
                size += len(tokens)
                if size >= WORDS_COUNTED:
                    settle()
                    size = 0
        settle()
        if kept:
            token, inverse = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([k[1] for k in kept]), len(token)).astype(np.int64)
            yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    sums = docs.select("text").transform(small_batches).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    sums = materialize(sums, "join-frequent")
    return bounded_counts(sums, limit)


def bounded_counts(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of fewer than ``limit`` of the most frequent tokens ``(token, n)``."""
    # fewer than ``limit`` tokens can have more than this share of all
    bar = (counts.agg(F.sum("n")).first()[0] or 0) / limit
    found = counts.where(F.col("n") > bar).toPandas()
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(token)
    return token[by], found["n"].to_numpy(np.int64)[by]


def merged_counts(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both sets of counts; where a token is in both, the first holds."""
    new = ~np.isin(second[0], first[0])
    token, n = np.concatenate([first[0], second[0][new]]), np.concatenate([first[1], second[1][new]])
    by = np.argsort(token)
    return token[by], n[by]


def signatures(docs: DataFrame, rule: Rule, frequent: tuple[np.ndarray, np.ndarray], k: int = K) -> DataFrame:
    """doc_id, n (set size), set digest (two longs), parity bits and extended prefix.

    ``b0`` to ``b3`` are 256 parity bits of the set, ``bits`` as many as a power
    of two from 256 and ``n`` on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        arrays, (heavy, count) = TextArrays(), shared.value
        for b in batches:
            sizes, digests, parity, wide, prefixes = [], [], [], [], []
            for _, tokens in row_sets(arrays, b.column(1), rule):
                n = len(tokens)
                take = min(n, n - -(-rule.num * n // rule.den) + k)
                rank = np.zeros(n, np.int64)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
                    rank = np.where(heavy[at] == tokens, count[at], 0)
                head = tokens[np.argsort(rank, kind="stable")[:take]] if rank.any() else tokens[:take]
                sizes.append(n)
                digests.append((mix(tokens ^ np.uint64(BASE)).sum(dtype=np.uint64), mix(tokens + np.uint64(1)).sum(dtype=np.uint64)))
                room = max(256, 1 << (n - 1).bit_length())
                bits = np.bincount((tokens & np.uint64(room - 1)).astype(np.int64), minlength=room) & 1
                wide.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                parity.append(np.bitwise_xor.reduce(wide[-1].reshape(-1, 4)))
                prefixes.append(head.view(np.int64))
            d = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
            p = np.array(parity, np.int64).reshape(-1, 4)
            yield pa.record_batch(
                [b.column(0), pa.array(np.array(sizes, np.int64)), *[pa.array(d[:, i].copy()) for i in range(2)], *[pa.array(p[:, i].copy()) for i in range(4)], lists(wide), lists(prefixes)],
                ["doc_id", "n", "d0", "d1", "b0", "b1", "b2", "b3", "bits", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(small_batches).mapInArrow(run, "doc_id long, n long, d0 long, d1 long, b0 long, b1 long, b2 long, b3 long, bits array<long>, prefix array<long>")


def lists(rows: list[np.ndarray]) -> pa.Array:
    """An Arrow list column of long arrays."""
    off = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def far_apart(rule: Rule, total: Column) -> Column:
    """Tokens in one set only that a similar pair of ``total`` tokens has at most."""
    return total - 2 * F.ceil(total * rule.num / F.lit(float(rule.num + rule.den)) - F.lit(1e-6))


def close(rule: Rule, a: str, b: str) -> Column:
    """What sizes and parity bits of a similar pair must satisfy.

    Every token in one set only flips one bit, so the bits differ in no more
    places than the sets.
    """
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = (x * rule.den >= y * rule.num) & (y * rule.den >= x * rule.num)
    differ = sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(4)), F.lit(0))
    return sizes & (differ <= far_apart(rule, x + y))


def differing_bits(a: str, b: str) -> Column:
    """Places in which two arrays of parity bits differ, the longer one folded upon itself."""

    def folded(x: Column, y: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(x)

    x, y = F.col(a), F.col(b)
    each = F.zip_with(folded(x, y), folded(y, x), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v)


def verify(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs ``(a, b)`` of ids whose whole sets are similar enough, with shared and union sizes."""
    need = materialize(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), "join-needed")
    small, _ = bounded_broadcast(need, BROADCAST_IDS)
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small, F.col("doc_id") == F.col("_id"), "left_semi")

    def run(batches):
        arrays = TextArrays()
        for b in batches:
            yield pa.record_batch([b.column(0), lists([s.view(np.int64) for _, s in row_sets(arrays, b.column(1), rule)])], ["id", "tokens"])

    sets = materialize(wanted.transform(small_batches).mapInArrow(run, "id long, tokens array<long>"), "join-sets")
    x, y = sets.toDF("a", "_x"), sets.toDF("b", "_y")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("_x", "_y")).cast("long").alias("shared"), (F.size("_x") + F.size("_y")).cast("long").alias("_total"))
    return both.withColumn("union", F.col("_total") - F.col("shared")).drop("_total").where((F.col("shared") > 0) & (rule.den * F.col("shared") >= rule.num * F.col("union")))


def components(edges: DataFrame) -> DataFrame:
    """``(v, c)``: the smallest vertex that each vertex of the edges ``(a, b)`` reaches.

    Labels fall to the least of their neighbours' and jump to their label's
    label until none changes; nothing is collected.
    """
    ends = edges.select("a", "b").union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b"))
    ends = materialize(ends.toDF("v", "w").distinct(), "join-edges")
    label = materialize(ends.groupBy("v").agg(F.min("w").alias("c")), "join-labels")
    while True:
        least = ends.join(label.select(F.col("v").alias("w"), "c"), "w").groupBy("v").agg(F.min("c").alias("c"))
        after = materialize(least.join(label.select("v", F.col("c").alias("_old")), "v"), "join-labels")
        if after.where("c != _old").limit(1).count() == 0:
            return after.select("v", "c")
        up = after.select(F.col("v").alias("c"), F.col("c").alias("_up"))
        label = materialize(after.select("v", "c").join(up, "c").select("v", F.col("_up").alias("c")), "join-labels")


def able(entries: DataFrame) -> DataFrame:
    """Entries of the classes whose lists and room can make up what a partner must share."""
    enough = F.col("room") + F.sum("m").over(Window.partitionBy("rep")) >= F.col("least")
    return entries.withColumn("_enough", enough).where("_enough").drop("_enough")


class Join:
    """The index of one table: signatures, classes of equal sets, and index entries.

    Tokens that exactly the same classes have in their prefixes make one list of
    the index: they say the same about every pair.  An entry ``(rep, list)``
    holds how many tokens the list stands for, ``m``, and the place of the first.
    """

    def __init__(self, docs: DataFrame, rule: Rule, rare: int = RARE, long: int = LONG):
        self.docs, self.rule, self.rare, self.long = docs, rule, rare, long
        frequent = frequent_tokens(docs, rule)
        self.signed = materialize(signatures(docs, rule, frequent), "join-signatures")
        narrow = self.signed.where("n > 0 and doc_id is not null").select("doc_id", "n", "d0", "d1")
        self.classes = materialize(narrow.groupBy("d0", "d1", "n").agg(F.min("doc_id").alias("rep")), "join-classes")
        copies = materialize(narrow.join(self.classes, ["d0", "d1", "n"]).where("doc_id != rep").select(F.col("doc_id").alias("_id"), F.col("d0").alias("_d0")), "join-copies")
        small, _ = bounded_broadcast(copies, BROADCAST_IDS)
        firsts = self.signed.where("n > 0 and doc_id is not null").join(small, (F.col("doc_id") == F.col("_id")) & (F.col("d0") == F.col("_d0")), "left_anti").withColumnRenamed("doc_id", "rep")
        if narrow.groupBy("doc_id").count().where("count > 1").limit(1).count():
            firsts = firsts.dropDuplicates(["rep", "d0", "d1", "n"])
        counts = firsts.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        late = bounded_counts(materialize(counts.where(F.col("n") > COMMON), "join-late"), ORDERED)
        if len(late[0]):
            firsts = self.reordered(firsts, late[0], merged_counts(frequent, late))
        self.light = firsts.select("rep", "n", "b0", "b1", "b2", "b3")
        self.bits = firsts.select("rep", "n", "bits")
        self.entries = self.indexed(firsts, self.postings(firsts))

    @staticmethod
    def postings(firsts: DataFrame) -> DataFrame:
        """token, n (classes with it in their prefixes) and list (a hash of those classes) of shared tokens."""
        entries = firsts.select(F.xxhash64("rep").alias("_who"), F.explode("prefix").alias("token"))
        shared = entries.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("_who").alias("_who")).where("n > 1")
        # written, so that both sides of the join with entries are dealt anew and hot tokens can be split
        return materialize(shared.select("token", "n", F.xxhash64("n", "_who").alias("list")), "join-postings")

    def indexed(self, firsts: DataFrame, postings: DataFrame) -> DataFrame:
        """Entries ``(rep, list, n, m, place, least, room, middle)`` of classes that may have a partner.

        ``n`` classes have the list; ``least`` is what a class must share with
        any partner, ``room`` how many of its tokens lie behind its prefix.  What
        it shares is no more than these and its lists' tokens.  ``middle`` is the
        share of its prefix that others have as well.
        """
        size, head = F.col("n"), F.size("prefix")
        least = F.ceil(size * self.rule.num / F.lit(float(self.rule.den)) - F.lit(1e-6)).cast("long")
        tokens = firsts.select("rep", least.alias("least"), (size - head).cast("long").alias("room"), head.alias("_head"), F.posexplode("prefix").alias("place", "token"))
        both = tokens.join(postings, "token").select("rep", "list", "n", "place", "least", "room", "_head").repartition("rep")
        lists = both.groupBy("rep", "list").agg(F.count("*").alias("m"), F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("n", "least", "room", "_head")])
        return materialize(able(lists.withColumn("middle", F.sum("m").over(Window.partitionBy("rep")) / F.col("_head")).drop("_head")), "join-entries")

    def reordered(self, firsts: DataFrame, late: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """Signatures in the order of ``frequent``, which has the tokens ``late`` anew.

        Only classes with such a token in their prefix are signed again: all
        others have the same prefix in either order.
        """
        spark = self.docs.sparkSession
        token = F.broadcast(spark.createDataFrame(pd.DataFrame({"token": late.view(np.int64)}), "token long"))  # ORDERED rows at most
        hit = firsts.select("rep", F.explode("prefix").alias("token")).join(token, "token", "left_semi").select("rep").distinct()
        small, _ = bounded_broadcast(materialize(hit.select(F.col("rep").alias("_id")), "join-reordered"), BROADCAST_IDS)
        again = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small, F.col("doc_id") == F.col("_id"), "left_semi")
        signed = signatures(again, self.rule, frequent).where("n > 0").withColumnRenamed("doc_id", "rep")
        kept = firsts.join(small, F.col("rep") == F.col("_id"), "left_anti")
        return kept.unionByName(materialize(signed.select(*kept.columns), "join-again"))

    def pivots(self, entries: DataFrame, turn: int) -> DataFrame:
        """One candidate ``(a, b)`` for each class: of its lists' pivots, the one nearest by parity bits.

        A list's pivot is its class that shares most of its prefix with others,
        so it lies in the middle of a group of copies; later turns add noise that
        is drawn for each frequent list.  A class and its pivot are of different
        components.
        """
        seed = F.when(F.col("n") > SMALL, F.col("list")).otherwise(F.lit(0))
        noise = F.pmod(F.xxhash64("rep", seed, F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        order = F.struct((noise * (0.001 + 0.15 * turn) - F.col("middle")).alias("h"), F.col("rep").alias("pivot"), F.col("comp").alias("_theirs"))
        first = materialize(entries.groupBy("list").agg(F.min(order).alias("_first")).select("list", "_first.pivot", "_first._theirs"), "join-first")
        votes = entries.join(first, "list").where("comp != _theirs").select(F.col("rep").alias("_rep"), "pivot").distinct()
        x, y = self.light.alias("x"), self.light.alias("y")
        near = votes.join(x, F.col("_rep") == F.col("x.rep")).join(y, F.col("pivot") == F.col("y.rep")).where(close(self.rule, "x", "y"))
        near = self.pruned(near.select(F.col("x.rep").alias("a"), F.col("pivot").alias("b")))
        return near.groupBy("a").agg(F.min(F.struct("apart", "b"))["b"].alias("b"))

    def pruned(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose parity bits differ in no more places than a similar pair's sets may, with that share."""
        x = self.bits.select(F.col("rep").alias("a"), F.col("n").alias("_n1"), F.col("bits").alias("_bits1"))
        y = self.bits.select(F.col("rep").alias("b"), F.col("n").alias("_n2"), F.col("bits").alias("_bits2"))
        total = F.col("_n1") + F.col("_n2")
        measured = pairs.join(x, "a").join(y, "b").withColumn("_d", differing_bits("_bits1", "_bits2"))
        return measured.where(F.col("_d") <= far_apart(self.rule, total)).select("a", "b", (F.col("_d") / total).alias("apart"))

    @staticmethod
    def named(entries: DataFrame, label: DataFrame | None) -> DataFrame:
        """The entries with each class's component as ``comp``."""
        if label is None:
            return entries.withColumn("comp", F.col("rep"))
        small, _ = bounded_broadcast(label.select(F.col("v").alias("rep"), "c"), BROADCAST_IDS)
        return entries.drop("comp").join(small, "rep", "left").withColumn("comp", F.coalesce("c", "rep")).drop("c")

    def mixed(self, label: DataFrame | None) -> DataFrame:
        """Entries with ``comp`` whose lists hold several components, of classes that may link to another one."""
        named = self.named(self.entries, label)
        if label is None:
            return named
        several = named.groupBy("list").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo != _hi").select("list")
        return materialize(able(named.join(materialize(several, "join-several"), "list", "left_semi")), "join-mixed")

    def heavy(self, entries: DataFrame) -> DataFrame | None:
        """Entries of the lists with more than ``PAIRS`` pairs of different components for each entry.

        None if the pairs of all lists with several components are no more than
        that.  Links only take pairs away, so a list that is left out once stays
        out.
        """
        sizes = entries.groupBy("list", "comp").agg(F.count("*").alias("n"))
        lists = sizes.groupBy("list").agg(F.sum("n").alias("_size"), F.sum(F.col("n") * F.col("n")).alias("_own"))
        lists = materialize(lists.withColumn("_pairs", (F.col("_size") * F.col("_size") - F.col("_own")) / 2).where("_pairs > 0"), "join-work")
        pairs, n = lists.agg(F.sum("_pairs"), F.sum("_size")).first()
        if (pairs or 0) <= PAIRS * (n or 0):
            return None
        return materialize(entries.join(lists.where(F.col("_pairs") > PAIRS * F.col("_size")).select("list"), "list", "left_semi"), "join-heavy")

    def candidates(self, entries: DataFrame) -> DataFrame:
        """All pairs ``(a, b)`` of classes of different components that may be similar.

        A pair comes from the first list that both have, in the order of places.
        What both share then is bounded: by the tokens behind the prefix, by
        this list's and by those of lists that come later.
        """
        rule = self.rule
        # a list of several tokens is a combination of them
        rows = entries.withColumn("_one", (F.col("n") <= self.rare) | (F.col("m") >= K)).drop("n")
        kind = Window.partitionBy("rep", "_one").orderBy("place")
        gone = F.coalesce(F.sum("m").over(kind.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bound = F.col("room") + F.sum("m").over(Window.partitionBy("rep")) - gone
        before = F.array_compact(F.array(*[F.lag("list", i).over(kind) for i in range(1, BEFORE + 1)]))
        rows = rows.withColumn("bound", bound).withColumn("before", before).withColumnRenamed("list", "key")
        body = ["rep", "comp", "n", "b0", "b1", "b2", "b3"]
        rows = materialize(rows.select("key", "rep", "comp", "_one", "place", "least", "bound", "before").join(self.light, "rep"), "join-rows")
        single = ["key", *body, "bound", "before"]

        def pairs(keyed: DataFrame) -> DataFrame:
            """A pair comes from its first common key; where an earlier one is in sight, this one is passed over."""
            x, y = keyed.alias("x"), keyed.alias("y")
            on = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp"))
            needed = F.ceil((F.col("x.n") + F.col("y.n")) * rule.num / F.lit(float(rule.num + rule.den)) - F.lit(1e-6))
            may = F.least("x.bound", "y.bound") >= needed
            seen = F.arrays_overlap("x.before", "y.before")
            return x.join(y, on & close(rule, "x", "y") & may & ~seen).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))

        fit = F.col("bound") >= F.col("least")
        few, many = rows.where(F.col("_one") & fit).select(*single), rows.where(~F.col("_one"))
        long = many.where((F.col("n") >= self.long) & fit).select(*single)
        # similar sets on both sides of ``long`` are both below long * den / num
        lists = many.where(F.col("n") * rule.num <= self.long * rule.den).groupBy(*body, "least").agg(F.array_sort(F.collect_list(F.struct("place", "key", "bound"))).alias("_t"))
        earlier = lambda j: F.slice("_t", F.greatest(F.lit(1), j - BEFORE + 1), F.least(j, F.lit(BEFORE)))
        combined = F.flatten(
            F.transform("_t", lambda u, j: F.transform(F.slice("_t", 1, j), lambda t: F.struct(F.xxhash64(t["key"], u["key"]).alias("key"), t["bound"].alias("bound"), F.filter(earlier(j)["key"], lambda w: w != t["key"]).alias("before"))))
        )
        combos = lists.select(*body, "least", F.explode(combined).alias("_k")).select("_k.key", *body, "least", "_k.bound", "_k.before").where(fit)
        combos = materialize(combos.select(*single), "join-combinations")
        live = combos.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo != _hi").select("key")
        live = materialize(live, "join-live")
        return self.pruned(pairs(few).union(pairs(long)).union(pairs(combos.join(live, "key").select(*single))).distinct()).select("a", "b")

    def labels(self) -> DataFrame | None:
        """``(v, c)``: component of every linked class; None if there are no links.

        Links to pivots come first, of all lists and then of those with many
        pairs left.  They end once a round finds few or the pairs that are left are
        few for the entries; all of those are tried.
        """
        label, part, total = None, self.mixed(None), 0
        for turn in range(ROUNDS):
            links = materialize(verify(materialize(self.pivots(part, turn), "join-pivots"), self.docs, self.rule).select("a", "b"), "join-links")
            n = links.count()
            total += n
            if n:
                label = self.merged(label, links)
            if n <= FEW * total:
                break
            part = self.heavy(self.named(part, label))
            if part is None:
                break
        rest = self.mixed(label)
        pairs = materialize(self.candidates(rest), "join-candidates")
        if pairs.limit(1).count():
            links = materialize(verify(pairs, self.docs, self.rule).select("a", "b"), "join-links")
            if links.limit(1).count():
                label = self.merged(label, links)
        return label

    def merged(self, label: DataFrame | None, links: DataFrame) -> DataFrame:
        """Labels after further links."""
        if label is None:
            return components(links)
        old = label.select("v", F.col("c"))
        named = links.join(old.toDF("a", "_a"), "a", "left").join(old.toDF("b", "_b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        grown = components(named)
        moved = old.join(grown.toDF("c", "_c"), "c", "left").select("v", F.coalesce("_c", "c").alias("c"))
        fresh = grown.join(old, "v", "left_anti")
        return materialize(moved.union(fresh), "join-labels")


def cluster(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row.

    Null and empty texts, and texts without words, have no tokens and are linked
    with nothing.  Rows with a null id have a null component.  Rows that repeat
    an id are judged by their own text.  An empty table gives an empty result;
    other columns are ignored.
    """
    return _clustered(Join(docs, rule))


def _clustered(join: Join) -> DataFrame:
    label = join.labels()
    reps = join.classes.select("d0", "d1", "n", "rep")
    if label is not None:
        reps = reps.join(label.select(F.col("v").alias("rep"), "c"), "rep", "left").withColumn("rep", F.coalesce("c", "rep")).drop("c")
    return join.signed.select("doc_id", "n", "d0", "d1").join(reps, ["d0", "d1", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("component_id"))


def links(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """All links ``(a, b, shared, union)``, a < b, between classes of equal sets, by their smallest ids.

    ``cluster``'s treatment of nulls, empty texts and repeated rows holds; equal
    sets appear as their class only.
    """
    join = Join(docs, rule)
    return verify(materialize(join.candidates(join.mixed(None)), "join-candidates"), docs, rule)


def representatives(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One document of each component, that with the smallest id, with its own columns.

    Rows that repeat a kept id and are equal to it in text stay once; rows with a
    null id stay, since nothing tells them apart.  Extra columns of any name
    pass through.
    """
    named = materialize(cluster(docs, rule), "join-clustered")
    key = F.col("_doc.doc_id").cast("long") == F.col("_id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    gone = materialize(named.where("doc_id is not null and doc_id != component_id").select(F.col("doc_id").alias("_id")).distinct(), "join-dropped")
    small, _ = bounded_broadcast(gone, BROADCAST_IDS)
    kept = rows.join(small, key, "left_anti")
    twice = materialize(named.where("doc_id is not null and doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "join-twice")
    if twice.limit(1).count():
        same = kept.join(twice, key, "left_semi").withColumns({"_id": F.col("_doc.doc_id"), "_text": F.col("_doc.text")}).dropDuplicates(["_id", "_text"])
        kept = kept.join(twice, key, "left_anti").unionByName(same.select("_doc"))
    return kept.select("_doc.*")
