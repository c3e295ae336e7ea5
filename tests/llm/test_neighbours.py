"""Joins and searches against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.llm import ngram_join, vantage
from tests.conftest import DATA

SCHEMA = "doc_id bigint, text string, lang string, rep bigint, token string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, rule):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w, k = WORD.findall(text), rule.width
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, rule):
    """n, component and links between different sets, of rows with distinct ids."""
    sets, shared, seen = {i: shingles(t, rule) for i, t in rows}, Counter(), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            for j in seen[x]:
                shared[min(i, j), max(i, j)] += 1
            seen[x].append(i)
    links = {p for p, n in shared.items() if rule.den * n >= rule.num * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    between = {(min(first[sets[a]], first[sets[b]]), max(first[sets[a]], first[sets[b]])) for a, b in links if sets[a] != sets[b]}
    return {i: (len(s), find(i)) for i, s in sets.items()}, between


def assert_cluster(spark, rows, rule):
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], SCHEMA)
    want, _ = brute(rows, rule)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.cluster(df, rule).collect()} == want


def edited(base, rng, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.integers(len(words))] = f"e{rng.integers(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("rule", [ngram_join.Rule(), ngram_join.Rule(5, 80, 100)])
def test_cluster_on_documents(spark, rule):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert_cluster(spark, rows, rule)


def test_chains_groups_and_shared_passages(spark):
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(400)}" for _ in range(120)]
    rows = [(i, edited(base, rng, i % 5)) for i in range(150)]
    chain = [f"c{i}" for i in range(100)]
    rows += [(200 + i, " ".join(chain[i * 3 : i * 3 + 60])) for i in range(14)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(300 + i, passage + " " + " ".join(f"q{i}.{j}" for j in range(5 + i % 20))) for i in range(80)]
    rows += [(500 + i, "the same words again and again here") for i in range(40)]
    rows = [(int(a), t) for a, t in (rows[i] for i in rng.permutation(len(rows)))]
    for rule in (ngram_join.Rule(), ngram_join.Rule(2, 50, 100)):
        assert_cluster(spark, rows, rule)


def test_every_class_of_entries_alone(spark, monkeypatch):
    """Without pivots, by single tokens, by combinations and by long sets' tokens."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, edited(base, rng, i % 4)) for i in range(60)]
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], SCHEMA)
    rule = ngram_join.Rule()
    want, links = brute(rows, rule)
    for rare, long in ((10**6, 512), (1, 512), (1, 1)):
        join = ngram_join.Join(df, rule, rare=rare, long=long)
        got = ngram_join.verify(join.candidates(join.mixed(None)), df, rule)
        assert {(min(r.a, r.b), max(r.a, r.b)) for r in got.collect()} == links
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    assert_cluster(spark, rows, rule)


def test_links(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rule = ngram_join.Rule(5, 80, 100)
    _, want = brute([(r.doc_id, r.text) for r in docs.collect()], rule)
    assert {(r.a, r.b) for r in ngram_join.links(docs, rule).collect()} == want


def test_refined_order_changes_nothing(spark, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(ngram_join, "COMMON", 3)
    shared = [" ".join(f"s{k}.{i}" for i in range(40)) for k in range(3)]
    rows = [(i, shared[i % 3] + " " + " ".join(f"u{rng.integers(30)}" for _ in range(30))) for i in range(60)]
    assert_cluster(spark, rows, ngram_join.Rule(3, 60, 100))


def test_cluster_odd_rows(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", 1, "x"), (3, " \n", "en", 1, "x"), (4, "a b", "en", 1, "x"), (5, "A B", "en", 1, "x"), (5, "A B", "en", 1, "x"),
        (None, "a b", "en", 1, "x"), (6, "É b", "en", 1, "x"), (7, "é b", "en", 1, "x"), (8, "long word " * 20_000, "en", 1, "x"), (9, "x" * 100_000, "en", 1, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.cluster(df).collect())
    assert got == sorted([("1", 0, 1), ("2", 0, 2), ("3", 0, 3), ("4", 1, 4), ("5", 1, 4), ("5", 1, 4), ("None", 1, None), ("6", 1, 6), ("7", 1, 7), ("8", 2, 8), ("9", 1, 9)])
    kept = ngram_join.representatives(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "6", "7", "8", "9"])
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.cluster(empty).count() == 0 and ngram_join.representatives(empty).count() == 0 and ngram_join.links(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(1, 2), (2, 3), (9, 1), (100, 101)]
    got = {r.v: r.c for r in ngram_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, 1: 1, 2: 1, 3: 1, 9: 1, 100: 100, 101: 100}


def near_copies(n, seed):
    """One group of n near copies, some too far from the middle, and n texts that share a passage."""
    rng = np.random.default_rng(seed)
    base, passage = [f"b{i}" for i in range(160)], [f"p{i}" for i in range(90)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.choice(160, rng.integers(0, 9), replace=False):
            w[at] = f"x{rng.integers(10**9)}"
        rows.append((2 * i, " ".join(w)))
        own = [f"o{rng.integers(10**9)}" for _ in range(60)]
        rows.append((2 * i + 1, " ".join(own + passage)))
    return rows


def test_pairs_grow_with_the_group_not_its_square(spark, monkeypatch):
    written, made = ngram_join.materialize, {}

    def counted(df, name):
        out = written(df, name)
        if name in ("join-pivots", "join-candidates"):
            made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    seen = []
    for n in (60, 300):
        made.clear()
        rows = near_copies(n, 5)
        df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], SCHEMA)
        got = {r.doc_id: r.component_id for r in ngram_join.cluster(df).collect()}
        want, _ = brute(rows, ngram_join.Rule())
        assert got == {i: c for i, (_, c) in want.items()}
        seen.append(sum(made.values()))
    assert seen[1] <= 8 * seen[0]


def test_representatives_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e", 1, "x", 2), (2, "a b c d e", 1, "x", 2), (3, None, 1, "x", 2), (1, "a b c d e", 1, "x", 2), (None, "a b c d e", 1, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _id int, _doc string, component_id int")
    kept = ngram_join.representatives(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


# --- vantage-point trees


def exact(rows, every, k):
    rows = {i: np.asarray(v, float) for i, v in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in rows.items()}
    return {(q, n + 1): p for q in rows if q % every == 0 for n, (_, p) in enumerate(sorted((-float(unit[q] @ unit[p]), p) for p in rows if p != q)[:k])}


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_factor_one_is_exact(spark, shard_rows):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vantage.nearest(df, factor=1.0, shard_rows=shard_rows).collect()}
    assert got == exact(rows, 50, 5)


def test_recall_and_scores_at_the_production_factor(spark):
    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = exact(rows, 50, 5), vantage.nearest(df).collect()
    assert len(got) == len(want)
    truth = defaultdict(set)
    for (q, _), p in want.items():
        truth[q].add(p)
    assert np.mean([r.vec_id in truth[r.query_id] for r in got]) >= 0.95
    vectors = {i: np.asarray(v, float) for i, v in rows}
    for r in got[:40]:
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_relaxed_search_visits_less():
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(4000, 3))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids = np.arange(4000)
    tree = vantage.Tree.load(vantage.Tree(unit, ids).dump())
    want = np.argsort(-(unit[:50] @ unit.T), axis=1)[:, 1:6]
    found, _ = tree.search(unit[:50], ids[:50], 5, 1.0)
    assert (np.sort(found) == np.sort(want)).all()


def test_vectors_of_odd_kinds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 2.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (6, [1.0, 0.0]), (50, [1e30, 1e30])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string")
    got = [(r.query_id, r["rank"], r.vec_id) for r in vantage.nearest(df, factor=1.0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6), (0, 2, 7), (0, 3, 50), (0, 4, 8), (50, 1, 0), (50, 2, 6), (50, 3, 7), (50, 4, 8)]
    assert vantage.nearest(df.where("false")).count() == 0
    assert vantage.nearest(df.where("vec_id = 0")).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(60)], "vec_id bigint, embedding array<float>").select("*", F.lit(1).alias("rank"))
    got = [r.vec_id for r in vantage.nearest(df, factor=1.0, shard_rows=7).where("query_id = 0").orderBy("rank").collect()]
    assert got == [2, 4, 6, 8, 10]


def test_many_equal_vectors_over_several_shards_and_blocks(spark):
    rng = np.random.default_rng(6)
    same = rng.normal(size=16)
    rows = [(3 * i + 1, [float(x) for x in (same if i < 100 else rng.normal(size=16))]) for i in range(400)] + [(50 * i, [float(x) for x in same]) for i in range(12)]
    df = spark.createDataFrame(sorted({r[0]: r for r in rows}.values()), "vec_id bigint, embedding array<double>")
    ids = sorted(i for i, v in {r[0]: r[1] for r in rows}.items() if v == [float(x) for x in same])
    got = defaultdict(list)
    for r in vantage.nearest(df, shard_rows=32, query_rows=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert len(got) >= 12
    for q in (50 * i for i in range(12)):
        if q in ids:
            assert got[q] == [i for i in ids if i != q][:5]
