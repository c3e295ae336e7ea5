"""Classifiers and the language model: importance resampling, language ID, rules, masked LM."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.llm import importance, langid, masked_lm, quality_rules
from murmura.llm.textarrays import TextArrays
from tests.conftest import DATA

SCHEMA = "doc_id bigint, text string, lang string, source string, score double, kept string"
LABELS = "doc_id bigint, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    return [
        (1, None, None, None, None, None), (2, "", "en", "a", 1.0, "x"), (3, " \t\n ", "en", "a", 1.0, "x"), (4, "one", "en", "a", 1.0, "x"), (4, "one", "en", "a", 1.0, "x"),
        (None, "no id at all", "en", "a", 1.0, "x"), (5, "mot é " * 4000, "fr", "b", 1.0, "x"), (6, "x" * 50_000, "en", "a", 1.0, "x"), (7, "123 456 !!", None, "a", 1.0, "x"), (8, "a\nb\na\nb\n\n", "en", "a", 1.0, "x"),
    ]


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet")
    return read("documents"), read("labels")


# --- importance resampling


def test_importance_keeps_good_and_drops_bad(spark, tables):
    docs, labels = tables
    _, kept = importance.select(docs, labels)
    ids = {r.doc_id for r in kept.collect()}
    rows = labels.toPandas()
    good, bad = set(rows[(rows.quality == 1) & (rows.toxic == 0)].doc_id), set(rows[rows.quality == 0].doc_id)
    assert len(good & ids) >= 0.99 * len(good) and len(bad & ids) <= 0.05 * len(bad)


def test_importance_keep_returns_the_same_documents(spark, tables):
    docs, labels = tables
    _, kept = importance.select(docs, labels)
    extra = docs.withColumn("_key", F.lit(1)).withColumn("_grams", F.lit("x"))
    out = importance.keep(extra, labels)
    assert out.columns == extra.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in kept.collect())


def test_gram_counts_against_brute_force():
    arrays = TextArrays()
    texts = ["to be or not", "", "be be be!", "é-é"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    bucket, row = importance.grams(arrays, data, off)
    tokens = [re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff\s]+", t) for t in texts]
    assert [int((row[bucket < importance.BUCKETS] == i).sum()) for i in range(4)] == [len(t) for t in tokens]
    assert [int((row[bucket >= importance.BUCKETS] == i).sum()) for i in range(4)] == [max(0, len(t) - 1) for t in tokens]
    repeats = bucket[(row == 2) & (bucket >= importance.BUCKETS)]
    assert len(set(repeats[:2])) == 1 and repeats[2] != repeats[0]


def test_cut_is_the_kth_key(spark):
    df = spark.createDataFrame([(i, 1, 0.0, float(i // 2)) for i in range(50)], "doc_id bigint, _grams int, _weight double, _key double")
    order = sorted(((float(i // 2), str(i)) for i in range(50)), reverse=True)
    for k in (1, 7, 8, 50):
        assert importance.cut_at(df, k) == order[k - 1]
    assert importance.cut_at(df, 51) is None


@pytest.mark.parametrize("rows, low, high", [([(1, 1.0), (1, 2.0), (0, -1.0)], -1.0, 1.0), ([(1, 0.0)], -1e9, -1.0), ([], -1e9, 0.0)])
def test_threshold(rows, low, high):
    assert low <= importance.threshold(rows) <= high


def test_importance_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    none = spark.createDataFrame([], LABELS)
    kept = importance.keep(docs, none)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "5", "6", "7", "8", "None"]
    empty = spark.createDataFrame([], SCHEMA)
    assert importance.keep(empty, none).count() == 0


def test_gumbel_draws_follow_the_weights(spark):
    want = np.array([1, 2, 5, 0.5]) / 8.5
    df = spark.range(3000).select(F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(np.log(w))).alias("_weight")) for j, w in enumerate(want)])).alias("r"), "id")
    df = df.select(F.concat_ws(":", "id", "r.j").alias("doc_id"), "id", "r.j", "r._weight", F.lit(1).alias("_grams"))
    seen = []
    for seed in (1, 2):
        keyed = importance.Resampler(np.zeros(1), seed=seed).keyed(df)
        first = keyed.groupBy("id").agg(F.max_by("j", "_key").alias("j"))
        seen.append({r.id: r.j for r in first.collect()})
        share = np.bincount(list(seen[-1].values()), minlength=4) / 3000
        assert np.abs(share - want).max() < 0.03
    assert 0.3 < np.mean([seen[0][i] != seen[1][i] for i in range(3000)])
    cold = importance.Resampler(np.zeros(1), temperature=0.01).keyed(df).groupBy("id").agg(F.max_by("j", "_key").alias("j"))
    assert cold.where("j != 2").count() == 0


# --- language ID


def test_leader_against_a_scalar_version():
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(60)]
    y = rng.integers(0, 3, 60)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.02
    z, n = {}, {}

    def weight(i, k):
        v = z.get((i, k), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((beta + np.sqrt(n.get((i, k), 0.0))) / alpha + l2)

    for _ in range(2):
        for (at, value), label in zip(rows, y, strict=True):
            x = [*zip(at, value, strict=True), (langid.BUCKETS, 1.0)]
            logit = [sum(v * weight(i, k) for i, v in x) for k in range(3)]
            p = [np.exp(t) / sum(np.exp(u) for u in logit) for t in logit]
            now = {(i, k): weight(i, k) for i, _ in x for k in range(3)}
            for i, v in x:
                for k in range(3):
                    g = v * (p[k] - (k == label))
                    sigma = (np.sqrt(n.get((i, k), 0.0) + g * g) - np.sqrt(n.get((i, k), 0.0))) / alpha
                    z[i, k] = z.get((i, k), 0.0) + g - sigma * now[i, k]
                    n[i, k] = n.get((i, k), 0.0) + g * g
    w, b = langid.follow_the_leader(rows, y, 3)
    assert np.allclose([[weight(i, k) for k in range(3)] for i in range(12)], w[:12]) and np.allclose([weight(langid.BUCKETS, k) for k in range(3)], b)


def test_known_languages_keep_columns_of_any_name(spark, tables):
    docs, _ = tables
    named = docs.select("*", F.lit(1).alias("_score"), F.lit("x").alias("_lang_pred"), F.lit(2).alias("_text"), F.lit(3).alias("_c0"))
    out = langid.keep_known(named)
    assert out.columns == named.columns and sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in langid.keep_known(docs).collect())


def test_language_accuracy_on_held_out_rows(spark, tables):
    docs, _ = tables
    got = langid.predict(docs).join(docs.select(F.col("doc_id").alias("i"), "lang"), F.col("doc_id") == F.col("i")).where("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_model_learns_nothing_from_held_out_rows(spark, tables):
    docs, _ = tables
    swapped = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.predict(d).collect())) for d in (docs, swapped))
    assert a == b


def test_language_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    got = langid.predict(docs).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        if r.doc_id in (1, 2, 3, 7):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.predict(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.keep_known(docs).columns == docs.columns


def test_rare_languages_and_long_texts_are_learned(spark):
    kinds = {"aa": (6000, "banana cabana "), "bb": (4000, "merry kelp tree "), "cc": (60, "sumum durum tutum "), "dd": (40, "posto zolto rok ")}
    rows = [(i * 10 + k, text * (2000 if lang == "dd" else 3), lang) for k, (lang, (n, text)) in enumerate(kinds.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, train_rows=400)
    assert model.labels == sorted(kinds)
    said, _ = model.predict([text * 3 for _, text in kinds.values()])
    assert said == list(kinds)


def test_level_fills_the_room():
    assert langid.level([400, 250, 200, 10], 100) == 30
    assert langid.level([400, 250, 200, 140, 10], 4000) == 400
    assert langid.level([5, 5], 1) == 1


def test_elastic_net_leaves_zeros_and_temperature_calibrates():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(200):
        k = i % 2
        rows.append((np.array([k, 10 + rng.integers(20)]), np.ones(2)))
        y.append(k)
    w, _ = langid.follow_the_leader(rows, np.array(y), 2)
    assert w[0, 0] > 0 > w[1, 0] and (w == 0).sum() > 0.9 * w.size
    logits = rng.normal(size=(500, 3))
    labels = np.array([rng.choice(3, p=langid.softmax(z / 2)) for z in logits])
    assert 1.3 < langid.temperature(logits, labels) < 3


# --- rules


def brute_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_statistics_against_brute_force(spark, tables):
    docs, _ = tables
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    for df in (docs, odd):
        got = sorted(((str(r.doc_id), *tuple(r)[1:6]) for r in quality_rules.statistics(df).collect()))
        assert got == sorted((str(r.doc_id), *brute_counts(r.text)) for r in df.select("doc_id", "text").collect())


def test_rules_keep_good_documents(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    assert len(got) == docs.count()
    rows = [(r, got[r.doc_id]) for r in labels.collect()]
    kept = [g.kept for r, g in rows if r.quality == 1 and not g.base_failed]
    assert np.mean(kept) > 0.97
    assert np.mean([g.kept for r, g in rows if r.quality == 0]) < 0.05
    for g in got.values():
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.base_failed and g.kept)


def test_forest_is_monotone_and_matches_a_walk():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(800, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=800) < 0.5).astype(float)
    forest = quality_rules.grow_forest(x, y, trees=15, directions=(-1, 0, 1))
    grid = np.tile(rng.uniform(size=(50, 1, 3)), (1, 30, 1))
    for j, sign in ((0, -1), (2, 1)):
        moved = grid.copy()
        moved[:, :, j] = np.linspace(0, 1, 30)
        score = forest.score(moved.reshape(-1, 3)).reshape(50, 30)
        assert (sign * np.diff(score, axis=1) >= -1e-12).all()

    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] >= 0:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return total

    assert np.allclose(forest.score(x[:50]), [walk(r) for r in x[:50]])
    assert ((forest.score(x) > 0) == (x[:, 0] < 0.5)).mean() > 0.85


def test_rules_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    got = quality_rules.judge(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(odd_rows()) and all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules.judge(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).count() == 0


# --- masked language model


def test_masked_scores_against_brute_force(spark, tables):
    docs = tables[0].limit(40)
    vocabulary, net = masked_lm.train(docs, rounds=1)
    arrays = TextArrays()
    for r in masked_lm.score(docs, vocabulary, net).join(docs.select("doc_id", "text"), "doc_id").collect()[:8]:
        raw = np.frombuffer(r.text.encode(), np.uint8)
        ids, _ = masked_lm.word_ids(arrays, vocabulary, raw, np.array([0, len(raw)]))
        assert len(ids) == len(WORD.findall(r.text)) == r.n_words
        total = 0.0
        for i in range(len(ids)):
            near = [ids[i + d] if 0 <= i + d < len(ids) else masked_lm.EDGE for d in masked_lm.offsets()]
            h = np.tanh(net.hidden + sum(net.embed[j, w] for j, w in enumerate(near)))
            z = (h @ net.out + net.bias).astype(float)
            total += z[ids[i]] - np.log(np.exp(z).sum())
        assert r.log_likelihood == pytest.approx(total, rel=1e-4)


def test_training_lowers_the_loss(spark, tables):
    docs = tables[0].repartition(3)
    loss = []
    for rounds in (0, 2):
        s = masked_lm.score(docs, *masked_lm.train(docs, rounds)).agg(F.sum("log_likelihood"), F.sum("n_words")).first()
        loss.append(-s[0] / s[1])
    assert loss[1] < loss[0] - 0.02


def test_step_follows_the_gradient():
    rng = np.random.default_rng(3)
    net = masked_lm.Network.fresh(np.full(masked_lm.OUTPUTS, 1 / masked_lm.OUTPUTS))
    around, words = rng.integers(0, 20, (400, 2 * masked_lm.SIDE)), rng.integers(0, 20, 400)
    before = net.log_probs(around, words).mean()
    for _ in range(20):
        net.step(around, words, 0.1)
    assert net.log_probs(around, words).mean() > before + 0.5


def test_tree_of_averages(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "FAN_IN", 3)
    rows = [(i, i + 1, np.full(4, float(i) * (i + 1)).tobytes()) for i in range(20)]
    got = masked_lm.averaged(spark.createDataFrame(rows, "part long, words long, sums binary"))
    assert np.allclose(got, sum(i * (i + 1) for i in range(20)) / sum(range(1, 21)))


def test_masked_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    got = masked_lm.train_and_score(docs).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert np.isfinite(r.log_likelihood) and (r.mean_log_prob is None) == (r.n_words == 0)
    assert masked_lm.train_and_score(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("common", [1 << 18, 1000, 0])
def test_every_word_has_its_own_probability(spark, tables, monkeypatch, common):
    monkeypatch.setattr(masked_lm, "COMMON", common)
    docs = tables[0].limit(300).select("doc_id", "text")
    counts = masked_lm.count_words(docs)
    vocabulary, net = masked_lm.fit(docs, counts, rounds=0)
    words = masked_lm.shares(counts, vocabulary)
    assert len(words.common) <= common
    odd = spark.createDataFrame([(-1, "zqxv0 zqxv1 zqxv0"), (-2, ""), (-3, None), (None, "zqxv0")], "doc_id bigint, text string")
    some = docs.limit(20).union(odd)
    seen = Counter(w for r in docs.collect() for w in WORD.findall(r.text or ""))
    arrays = TextArrays()

    def ids_of(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return masked_lm.word_ids(arrays, vocabulary, raw, np.array([0, len(raw)]))[0]

    total, distinct = Counter(), Counter()
    for w, n in seen.items():
        (k,) = ids_of(w)
        total[k] += n
        distinct[k] += 1
    by_class = {str(r.doc_id): r.log_likelihood for r in masked_lm.score(some, vocabulary, net).collect()}
    got = {str(r.doc_id): r for r in masked_lm.score(some, vocabulary, net, words).collect()}
    assert len(got) == some.count()
    for r in some.collect():
        want = by_class[str(r.doc_id)]
        for w, k in zip(WORD.findall(r.text or ""), ids_of(r.text or ""), strict=True):
            if k >= masked_lm.FREQUENT:
                want += np.log(max(1, seen[w]) / (total[k] + distinct[k]))
        assert got[str(r.doc_id)].log_likelihood == pytest.approx(want, rel=1e-6)
    rarest = min(seen[w] for w in seen if ids_of(w)[0] < masked_lm.FREQUENT)
    assert got["None"].mean_log_prob < np.log(rarest / sum(seen.values()))


def test_probabilities_of_the_language_model_add_up(spark, tables):
    docs = tables[0].limit(60)
    counts = masked_lm.count_words(docs)
    vocabulary, net = masked_lm.fit(docs, counts, 1)
    told = masked_lm.shares(counts, vocabulary)
    around = np.random.default_rng(2).integers(0, masked_lm.EDGE + 1, (5, 2 * masked_lm.SIDE))
    every = np.arange(masked_lm.OUTPUTS)
    for context in around:
        assert np.exp(net.log_probs(np.tile(context, (len(every), 1)), every)).sum() == pytest.approx(1, abs=1e-4)
    rows = counts.toPandas()
    out = masked_lm.outputs(rows["word"].to_numpy(np.int64).view(np.uint64), vocabulary)
    n = rows["n"].to_numpy(float)
    # seen words, and as many unseen ones
    for k in range(masked_lm.FREQUENT, masked_lm.OUTPUTS):
        if (out == k).any():
            assert ((n[out == k].sum() + (out == k).sum()) / told.sizes[k]) == pytest.approx(1)
