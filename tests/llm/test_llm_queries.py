import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests_llm_util import near_classes

from timeloom.llm import chat, decontamination, graph, jaccard_join, language_id, line_dedup, lm_scoring, mixing, quality_classifier, quality_rules, url_filters
from timeloom.llm.queries import QUERIES, SQL

#: Null, empty, blank, one word, repeated rows, ties, a long text; columns whose names clash with outputs.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (6, "A b c d e f g h"), (7, "x " * 30_000), (None, "z z z z z z")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    names = ("node", "score", "kept", "n_words", "block", "epoch", "component", "n_lines", "lang_pred", "position")
    return df.withColumns({n: F.lit("clash") for n in names} | {"lang": F.lit("en"), "source": F.when(F.col("doc_id") > 4, "s")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf, same):
    same(QUERIES[name](spark, sf), SQL[name])


# chat


def test_escape_is_reversible_and_hides_controls(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["#", "\\", "</turn>", "<", "/turn>", "### ", "a", ": ", "\n"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r.t == r.u and "</turn>" not in r.e and "###" not in r.e


def test_best_branch_of_a_tree(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "thanks", 0.5), ("t", 5, 9, "odd:role", None, None), ("u", 1, 1, None, None, None)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit(0))
    got = {r.tree: r for r in chat.format_trees(df, best=1).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got["t"].turns] == [("user", "q"), ("assistant", "good"), ("user", "thanks")]
    assert [(t.role, t.text) for t in got["u"].turns] == [("", "")]
    every = chat.format_trees(df, best=None).withColumn("turns", chat.parse(F.col("formatted")))
    assert every.count() == 4 and ("odd:role", "") in [(r.turns[0].role, r.turns[0].text) for r in every.collect()]
    s = got["t"].loss[0]
    assert got["t"].formatted[s.start : s.start + s.length] == "good"
    assert chat.format_trees(df.limit(0)).count() == 0


# rules


def test_rules_on_odd_rows(odd, none):
    got = {r.doc_id: r for r in quality_rules.apply_rules(odd).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[7].n_words == 30_000 and got[7].n_repeat_words == 30_000
    assert quality_rules.apply_rules(none).count() == 0


# urls


@pytest.mark.parametrize("most", [1 << 20, 16])
def test_cascade_is_exact(spark, most):
    rng = random.Random(3)
    keys = [f"k{rng.randrange(10**6)}" for _ in range(3000)]
    listed = set(keys[:400]) | {"absent"}
    u, good = spark.createDataFrame([(k,) for k in [*keys, None]], "key string"), spark.createDataFrame([(k,) for k in listed], "key string")
    c = url_filters.Cascade(u, good, bits_per_key=4, most_bytes=most, shard_bytes=64)
    assert (c.shards > 1) == (most == 16) and len(c.levels) > 1
    got = c.flag(u.select(F.col("key"), F.array("key").alias("ks")), "ks", "hit").collect()
    assert len(got) == 3001 and all(r.hit == (r.key in listed) for r in got)


def test_the_universe_counts_for_the_size(spark):
    """Few listed keys and many others: level 1 holds the errors among the others, so filters are sharded although the list is small."""
    u = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"))
    listed = spark.createDataFrame([(f"h{k}",) for k in (1, 5, 9)], "key string")
    c = url_filters.Cascade(u, listed, most_bytes=200, shard_bytes=100)
    assert c.shards > 1
    got = c.flag(u.select("key", F.array("key").alias("ks"), F.lit(1).alias("_row"), F.lit(1).alias("_l0")), "ks", "hit")
    assert {"_row", "_l0"} <= set(got.columns) and {r.key for r in got.where("hit").collect()} == {"h1", "h5", "h9"} and got.count() == 20_000


def test_urls_on_odd_rows(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.SPAM.x:80?q"), (5, "x://spam.x/en/"), (6, "x://com/"), (7, "x://com")]
    pages = spark.createDataFrame(rows, "page_id int, url string").withColumns({"host": F.lit(1), "verdict": F.lit(2)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages, spark.createDataFrame([("Spam.x",)], "key string")).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("a.spam.x:80", "", None, "allow"), 5: ("spam.x", "/en/", None, "block"), 6: ("com", "/", "com/", "allow"), 7: ("com", "", None, "allow")}
    assert url_filters.filter_urls(pages, spark.createDataFrame([], "key string")).where("verdict = 'block'").count() == 0
    assert url_filters.filter_urls(pages.limit(0), spark.createDataFrame([("Spam.x",)], "key string")).count() == 0


# quality classifier and language


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality_classifier"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in got) / len(got)
    assert right > 0.9 and all(0 <= r.score <= 1 for r in got)


def test_isotonic_is_the_least_squares_rise():
    x, v = quality_classifier.isotonic(np.arange(4.0), np.array([0.0, 3.0, 1.0, 4.0]), np.array([2.0, 4.0, 4.0, 4.0]))
    assert v.tolist() == [0.0, 0.5, 0.5, 1.0]


def test_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, False), (5, 0, True), (5, None, False), (99, 1, False)], "doc_id long, y int, calibrate boolean")
    assert quality_classifier.classify(odd, labels).count() == len(ODD)
    assert {r.score for r in quality_classifier.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(none, labels).count() == 0


def test_fit_is_plain_ridge_on_fourier_features(spark, sf):
    """The normal equations summed by partition give the coefficients that numpy gives on all rows at once; features approximate the Gaussian kernel."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality, r.doc_id % 5 == 1) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in docs]
    known = spark.createDataFrame(labels, "doc_id long, y int, calibrate boolean")
    stats = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3).mapInArrow(quality_classifier.statistics_rows, "doc_id long, stats array<double>")
    model = quality_classifier.fit(stats, known)
    x = np.array([quality_classifier.statistics(docs[d]) for d, _, _ in labels])
    plain = quality_classifier.Model(x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0))
    some = np.array([not c for _, _, c in labels])
    z, y = plain.features(x[some]), np.array([float(q) for _, q, _ in labels])
    beta = np.linalg.solve(z.T @ z + quality_classifier.RIDGE * some.sum() * np.eye(z.shape[1]), z.T @ y[some])
    assert np.abs(model.beta - beta).max() < 1e-6 * np.abs(beta).max()
    plain.beta = beta
    assert (np.abs(model.raw(x) - plain.raw(x)) <= 1).all()
    rest = ~some
    bins = np.unique(plain.raw(x[rest]))
    sums = [y[rest][plain.raw(x[rest]) == b].sum() for b in bins]
    _, values = quality_classifier.isotonic(bins, np.array(sums), np.array([(plain.raw(x[rest]) == b).sum() for b in bins], float))
    assert np.abs(np.interp(plain.raw(x), bins, values) - model.score(x)).max() < 0.05
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 50, x.shape[1]))
    wide = quality_classifier.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), features=20_000)
    got = (wide.features(a)[:, :-1] * wide.features(b)[:, :-1]).sum(1)
    assert np.abs(got - np.exp(-((a - b) ** 2).sum(1) / (2 * quality_classifier.WIDTH**2))).max() < 0.05


def test_language_is_that_of_plain_counting(spark, sf):
    """Sets of n-grams in plain Python, without filters: the same language wherever the two best differ by more than the filters' error."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    learned = [r for r in rows if r.doc_id % 3]
    counts = {}
    for r in learned:
        counts.setdefault(r.lang, Counter()).update(language_id.grams(language_id.letters(r.text or "")).tolist())
    # texts are joined before they are counted, so n-grams that span two are counted too; they are of spaces and letters at a text's ends
    members = {lang: {g for g, n in c.items() if n >= 2 * language_id.LEAST * sum(c.values())} for lang, c in counts.items()}
    model = language_id.learn(spark.createDataFrame([(r.lang, r.text) for r in learned], "lang string, text string").repartition(3))
    same = total = 0
    for r in rows:
        g = language_id.grams(language_id.letters(r.text or "")).tolist()
        hits = sorted(((sum(x in m for x in g), lang) for lang, m in members.items()), reverse=True)
        if language_id.LETTER.search(r.text or "") and hits[0][0] > 1.2 * hits[1][0] + 5:
            total += 1
            same += model.judge(r.text)[0] == hits[0][1]
    assert total > 100 and same == total


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op6_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_filter_returns_all_languages_and_few_others():
    rng = np.random.default_rng(5)
    members = {f"l{i:02}": np.unique(rng.integers(0, 1 << 32, 2000, dtype=np.uint64)).astype(np.int64) for i in range(70)}
    f = language_id.Filter(members, {})
    for i, lang in enumerate(f.langs):
        row = f.masks[i // 64]
        a, b, c = f.spots(members[lang])
        assert (((row[a] & row[b] & row[c]) >> np.uint64(i % 64)) & np.uint64(1)).all()
    assert f.wrong.max() < 0.05


def test_language_on_odd_rows(odd, none):
    model = language_id.learn(odd)
    got = language_id.identify(odd, model)
    assert got.count() == len(ODD) and {r.lang_pred for r in got.where("text is null or trim(text) = ''").collect()} <= {"und", "en"}
    assert got.where("doc_id = 1").first().lang_pred == "und" and "block" in got.columns
    assert {r.lang_pred for r in language_id.identify(odd, language_id.learn(none)).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


# Jaccard join


def classes(docs):
    least = near_classes(docs)
    sizes = {}
    for d, t in docs:
        w = jaccard_join.words_of(t)
        sizes[d] = len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0
    return {d: (sizes[d], least[d]) for d, _ in docs}


def near_copies(seed, bases=12, size=120):
    rng, docs = random.Random(seed), []
    shared = [f"p{i}" for i in range(60)]
    for _ in range(bases):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(3, size))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 18))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            if rng.random() < 0.4:
                w += shared[: rng.randrange(10, 60)]
            docs.append(" ".join(w))
    return list(enumerate(docs, 3))


@pytest.mark.parametrize("seed, few", [(1, 128), (2, 2)])
def test_jaccard_join_is_exact(spark, seed, few, monkeypatch):
    """few = 2: nearly all meetings go by way of the n-gram's own node."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 150)  # components are dealt over blocks
    docs = near_copies(seed)
    got = jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(docs)


@pytest.mark.parametrize("seed", range(6))
def test_tree_links_what_brute_force_links(seed):
    rng = random.Random(seed)
    base = [np.array(sorted(rng.sample(range(400), 60)), np.uint64) for _ in range(4)]
    sets = [np.array(sorted(set(rng.choice(base).tolist()) - set(rng.sample(range(400), rng.randrange(60)))), np.uint64) for _ in range(80)]
    sets = sorted([s for s in sets if len(s)], key=len)
    tree = jaccard_join.Tree(75)
    for s in sets:
        tree.add(s)
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                up[find(i)] = find(j)
    assert all((find(i) == find(j)) == (tree.find(i) == tree.find(j)) for i in range(len(sets)) for j in range(i))


def near_sets(rng, clusters, copies, edits, tie):
    """Clusters of near copies, with members that all sets have."""
    sets = []
    for _ in range(clusters):
        base = rng.sample(range(1000, 1 << 40), 300)
        for _ in range(copies):
            s = list(base)
            for at in rng.sample(range(300), rng.randrange(edits)):
                s[at] = rng.randrange(1000, 1 << 40)
            sets.append(np.unique(np.array([*s, *range(tie)], np.uint64)))
    return sets


def test_crowds_of_near_copies_are_joined_in_time():
    """Three clusters in one world, 1,200 sets: a tree alone compares about each set with each of another cluster."""
    rng = random.Random(5)
    sets = near_sets(rng, 3, 400, 40, 20)
    rng.shuffle(sets)
    batch = pa.RecordBatch.from_pydict({"world": [1] * 1200, "lo": [0] * 1200, "hi": [0] * 1200, "node": list(range(1200)), "members": [s.tobytes() for s in sets]})
    began = time.process_time()
    (got,) = jaccard_join.tree_join(75)([batch])
    assert time.process_time() - began < 12
    others, owned = dict(zip(*(c.to_pylist() for c in got.columns))), {}
    for k, s in enumerate(sets):
        for g in set(s.tolist()) - set(range(20)):
            owned.setdefault(g, []).append(k)
    clusters = {tuple(v) for v in owned.values() if len(v) > 200}
    assert len({others[k] for k in others}) == 3 and all(len({others[k] for k in v}) == 1 for v in clusters)


@pytest.mark.parametrize("percent", [40, 75, 90])
@pytest.mark.parametrize("seed", range(4))
def test_crowds_link_what_brute_force_links(seed, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", seed + 1)
    rng, sets = random.Random(seed), []
    for _ in range(5):
        base = rng.sample(range(rng.choice([80, 10**9])), rng.randrange(3, 60))
        for _ in range(rng.randrange(1, 30)):
            s = [rng.randrange(rng.choice([80, 10**9])) if rng.random() < 0.15 else g for g in base]
            base = s if rng.random() < 0.3 else base  # chains of copies of copies
            sets.append(np.unique(np.array(s, np.uint64)))
    roots, up = jaccard_join.roots_of(sets, percent), jaccard_join.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                up.link(i, [j])
    assert all((up.find(i) == up.find(j)) == (roots[i] == roots[j]) for i in range(len(sets)) for j in range(i))


def test_jaccard_on_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(odd).collect()), key=str)
    assert (1, 0, 1) in got and (4, 1, 4) in got and got.count((5, 4, 5)) == 2 and (6, 4, 5) in got and (7, 1, 7) in got and (None, 1, None) in [(a, b, c) for a, b, c in got if a is None]
    assert jaccard_join.join(none).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None"]


def test_rows_without_an_id_of_their_own_stay_apart(spark):
    """Null and repeated ids: one row of each group of similar texts stays, and only rows that leak go."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(None, text(k)) for k in range(5)] + [(7, text(0)), (None, text(1)), (8, text(5)), (8, text(6)), (8, text(6)), (None, None), (None, " "), (9, text(5) + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(3)
    kept = jaccard_join.keep_one(df)
    want = [(7, text(0)), *((None, text(k)) for k in range(1, 5)), (8, text(5)), (8, text(6)), (None, None), (None, " ")]
    assert kept.columns == df.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    items = spark.createDataFrame([(1, text(2)), (2, text(5))], "item_id long, text string")
    left = decontamination.drop_leaks(df, items)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([x for x in rows if x[1] not in (text(2), text(5), text(5) + " x")], key=str)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 1)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}


# mixing


def test_exponent_meets_the_target():
    tokens = [1000.0, 100.0, 10.0, 0.0]
    a = mixing.solve(tokens, target_entropy=0.8)
    assert abs(mixing.entropy(mixing.weights(tokens, a)) - 0.8) < 1e-6
    a = mixing.solve(tokens, limit=4.0)
    assert abs(mixing.repeats(tokens, mixing.weights(tokens, a), None) - 4.0) < 1e-6
    assert mixing.solve([5.0]) == 1.0 and mixing.weights(tokens, 1.0)[3] == 0.0


def test_mix_keeps_all_and_meets_quotas(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 10)
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 30), "big" if i % 10 else "small") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("big", "small")}
    took = {s: sum(r.n_tokens for r in got if r.source == s) for s in size}
    assert {r.doc_id for r in got} == set(range(600)) and took["big"] == size["big"]
    assert 3.9 < took["small"] / size["small"] <= 4.0
    ids = [(r.doc_id, r.epoch) for r in got]
    assert len(ids) == len(set(ids))
    few = mixing.mix(df, budget=2000.0, limit=None).collect()
    assert 1900 < sum(r.n_tokens for r in few) <= 2000


def test_equal_rows_keep_the_budget(spark):
    """Seven equal rows of 10 tokens and many others: no more than each source's quota is taken."""
    rows = [(1, "w " * 10, "a")] * 7 + [(100 + i, "w " * 10, "a") for i in range(60)] + [(1000 + i, "w " * 10, "b") for i in range(67)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({n: F.lit("clash") for n in ("_s", "_h", "_run", "_copies")})
    for budget in (1000.0, 100.0, 333.0):
        got = mixing.mix(df, budget=budget, limit=None).collect()
        for source in "ab":
            took = sum(r.n_tokens for r in got if r.source == source)
            assert budget / 2 - 10 < took <= budget / 2
        assert {r._run for r in got} == {"clash"}


def test_mix_matches_plain_mixing(spark, sf, monkeypatch):
    """Weights, quotas and every source's rows by plain Python over the whole table; positions say in which order the last epoch takes them."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 7)
    monkeypatch.setattr(mixing, "GROUP", 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {}
    for r in docs:
        size.setdefault(r.source, []).append(len((r.text or "").encode().split()))
    names = sorted(size)
    tokens = [float(sum(size[n])) for n in names]
    alpha = mixing.solve(tokens)
    w = mixing.weights(tokens, alpha)
    total = max(t / x for t, x in zip(tokens, w))
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    for name, t, x in zip(names, tokens, w):
        mine = [r for r in got if r.source == name]
        assert abs(mine[0].weight - x) < 1e-8
        quota = np.ceil(x * total - 1e-3)
        rows = {r.doc_id: r for r in mine if r.epoch == 0}
        whole, left = int(quota // t), quota % t
        copies = Counter(r.doc_id for r in mine)
        run = 0
        for r in sorted(rows.values(), key=lambda r: (r.block, r.position)):
            run += r.n_tokens
            assert copies[r.doc_id] == whole + (left > 0 and run <= left) or abs(run - left) < 3


def test_mix_on_odd_rows(odd, none):
    got = mixing.mix(odd)
    assert sum(r.epoch == 0 for r in got.collect()) == len(ODD)
    assert mixing.mix(none).count() == 0


# lines


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_automaton_is_edit_distance(spark, edits):
    rng = random.Random(edits)

    def edit(s):
        s = list(s)
        for _ in range(rng.randrange(edits + 2)):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(2)] = rng.choice(["", "a", "é", "😀"])
        return "".join(s)

    pairs = [(s, edit(s)) for s in ("".join(rng.choice("abé😀") for _ in range(rng.randrange(6, 40))) for _ in range(300))]
    df = spark.createDataFrame(pairs, "s string, t string")
    df = df.select("s", "t", *[F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)).alias(f"{c}_") for c in "st"])

    def distance(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            row, old = [i], row
            for j, d in enumerate(t, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (c != d)))
        return row[-1]

    for r in df.withColumn("ok", line_dedup.within("s_", "t_", edits)).collect():
        assert r.ok == (distance(r.s, r.t) <= edits), (r.s, r.t)


def near(s, t, edits):
    row = list(range(len(t) + 1))
    for i, c in enumerate(s, 1):
        row, old = [i], row
        for j, d in enumerate(t, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (c != d)))
    return row[-1] <= edits


def brute_lines(docs, edits, least_chars, least_near):
    """The text that stays of each document: a line goes if an earlier one is equal, or near and both are long enough."""
    seen, want = [], {}
    for i, t in docs:
        keep = []
        for line in t.split("\n"):
            again = line in seen or (len(line) >= least_near and any(len(s) >= least_near and abs(len(s) - len(line)) <= edits and near(line, s, edits) for s in seen))
            if not again or len(line) < least_chars:
                keep.append(line)
            seen.append(line)
        want[i] = "\n".join(keep)
    return want


@pytest.mark.parametrize("edits, few", [(1, 16), (1, 1), (2, 16), (3, 16)])
def test_near_lines_lose_nothing(spark, edits, few, monkeypatch):
    monkeypatch.setattr(line_dedup, "SEGMENT_CHARS", 4)
    monkeypatch.setattr(line_dedup, "FEW", few)
    rng = random.Random(7)
    lines = []
    for _ in range(40):
        s = "".join(rng.choice("abcd") for _ in range(rng.randrange(13, 30)))
        lines += [s, s]
        for _ in range(3):
            k = rng.randrange(len(s))
            s = s[:k] + rng.choice(["", "x", "yz"]) + s[k + rng.randrange(2) :]
            lines.append(s)
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(len(lines) // 3)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), edits).collect()}
    assert got == brute_lines(docs, edits, line_dedup.LEAST_CHARS, 4 * (edits + 1))


@pytest.mark.parametrize("least_chars", [0, 10])
def test_crowded_lines_lose_nothing(spark, least_chars):
    """Hundreds of lines that share all but a number, a tail or an inserted character; helper columns' names in the input."""
    rng = random.Random(3)
    lines = [f"The committee met again to discuss item {rng.randrange(900)} of the long agenda for the year" for _ in range(150)]
    lines += [f"All of these begin alike, whatever {''.join(rng.choice('ab') for _ in range(7))}" for _ in range(90)]
    lines += ["x" * k + "Every line has one more of the same letter" for k in (0, 1, 2, 4)] + [f"{c}ero or one letter differs in this sentence" for c in "zZyx"]
    lines += ["", "ab", "ab", "short", "short", "tiny line"]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(-(-len(lines) // 4))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("_x", "_lines", "_kept", "_had", "_stays", "_id", "_s")})
    got = line_dedup.dedup_lines(df, 1, least_chars)
    assert {"_x", "_lines", "_kept", "_had", "_stays", "_id", "_s"} <= set(got.columns)
    rows = got.collect()
    assert {r._stays for r in rows} == {"clash"}
    assert {r.doc_id: r.text for r in rows} == brute_lines(docs, 1, least_chars, 20)


def test_lines_on_odd_rows(odd, none):
    got = line_dedup.dedup_lines(odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ODD) and rows[1].text is None and rows[2].text == "" and not rows[2].emptied and not rows[3].emptied and not rows[5].emptied
    assert line_dedup.dedup_lines(none).count() == 0


# language-model scoring


def brute_scores(docs, held, order=3, d=0.5, least=1):
    """Interpolated probabilities straight from counts of token tuples."""
    from collections import Counter
    from math import log10

    texts = {i: lm_scoring.tokens(t) + [lm_scoring.END] for i, t in docs}
    train = [t for i, t in texts.items() if i not in held]
    uni = Counter(w for t in train for w in t)
    total, kinds = sum(uni.values()), len(uni)
    counts = [{(w,): c for w, c in uni.items()}]
    for k in range(2, order + 1):
        counts.append(Counter(tuple(s[i : i + k]) for t in train for s in [[lm_scoring.END, *t]] for i in range(len(s) - k + 1)))
    grams = [{g: c for g, c in level.items() if c >= least} for level in counts]

    def p(w, h):
        if not h:
            return (uni[w] + 1) / (total + kinds + 1)
        n = counts[len(h) - 1].get(h, 0)
        if not n:
            return p(w, h[1:])
        seen = {g[-1]: c for g, c in grams[len(h)].items() if g[:-1] == h}
        left = 1 - sum((c - d) / n for c in seen.values())
        return ((seen[w] - d) / n if w in seen else 0) + left * p(w, h[1:])

    some = {h for level in counts[:-1] for h in list(level)[:5]}
    for h in some:  # the distribution of a state sums to 1 over known words and one unknown
        assert abs(sum(p(w, h) for w in [*uni, "unknown"]) - 1) < 1e-9
    out = {}
    for i, t in texts.items():
        s = [lm_scoring.END, *t]
        out[i] = (sum(log10((uni[w] + 1) / (total + kinds + 1)) for w in t), sum(log10(p(s[k], tuple(s[max(0, k - order + 1) : k]))) for k in range(1, len(s))))
    return out


@pytest.mark.parametrize("order, least, block_bytes, split", [(3, 1, 60, 4), (3, 1, 1 << 20, 1), (3, 2, 100, 50), (4, 1, 200, 4), (2, 1, 40, 4)])
def test_automaton_matches_brute_force(spark, monkeypatch, order, least, block_bytes, split):
    """Also with many small blocks, with hot states that are split over parts, and with a least count."""
    monkeypatch.setattr(lm_scoring, "SPLIT", split)
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("a a a b b c d E f g h".split()) for _ in range(rng.randrange(0, 25)))) for i in range(40)]
    held = {i for i, _ in docs if i % 5 == 0}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.score_documents(df, F.col("doc_id") % 5 == 0, order, least, block_bytes).collect()}
    for i, (base, score) in brute_scores(docs, held, order, least=least).items():
        assert abs(got[i].base_score - base) < 1e-9 and abs(got[i].score - score) < 1e-9, i
        assert got[i].held_out == (i in held)


def test_packed_numbers_come_back():
    arrays = [np.array([3, 0, 255]), np.array([], np.int64), np.array([1 << 40, 7]), np.array([-5, 9]), np.array([True, False]), np.array([1 << 63, 1], np.uint64)]
    for a, b in zip(arrays, lm_scoring.unpack(lm_scoring.pack(*arrays))):
        assert a.tolist() == b.tolist()


def test_every_gram_counts_in_a_large_corpus(spark):
    """Words and grams that occur once or twice among 300,000 words, in blocks of their own, are part of the model as it comes."""
    rng = random.Random(12)
    docs = [(i, " ".join(f"r{rng.randrange(300)}" for _ in range(6000))) for i in range(50)]
    docs += [(100 + i, "odd1 odd2 odd3 odd4") for i in range(2)] + [(110, "one1 one2 one3")] + [(200, "odd1 odd2 odd3 odd4"), (201, "odd2 odd3 r1"), (202, "one1 one2 one3")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.score_documents(df, F.col("doc_id") >= 200).where("doc_id >= 100").collect()}
    total = sum(len(t.split()) + 1 for i, t in docs if i < 200)
    assert {r.train_tokens for r in got.values()} == {total}
    kinds = 300 + 4 + 3 + 1
    root = lambda c: (c + 1) / (total + kinds + 1)

    def chain(n, words, first, starts):
        """Each step after the first is seen n of n times, in both states."""
        p = [(n - 0.5) / 53 + 0.5 * starts / 53 * root(n)]
        for k in range(words):
            last = root(53) if k == words - 1 else root(n)
            two = (n - 0.5) / n + 0.5 / n * last
            p.append((n - 0.5) / n + 0.5 / n * two)
        return np.log10(p).sum()

    starts = len({t.split()[0] for i, t in docs if i < 200})
    assert abs(got[200].score - chain(2, 4, "odd1", starts)) < 1e-9 and abs(got[100].score - got[200].score) < 1e-9
    assert abs(got[202].score - chain(1, 3, "one1", starts)) < 1e-9
    assert got[201].score > got[201].base_score and got[200].n_known == 5


def test_scores_beat_the_base_on_held_out_text(spark, sf):
    rows = QUERIES["op9_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_scoring_on_odd_rows(odd, none):
    got = lm_scoring.score_documents(odd, F.col("doc_id") == 5).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert lm_scoring.score_documents(none, F.lit(False)).count() == 0
    alone = lm_scoring.score_documents(odd, F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known, r.score) for r in alone} == {(0, 0, 0.0)}


# decontamination


def test_local_alignment_matches_plain_recursion():
    rng = random.Random(2)
    for _ in range(60):
        a = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))])
        b = np.array([rng.randrange(0, 5) for _ in range(rng.randrange(0, 14))], np.int64)
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontamination.best_local(a, b)[0] == h.max()


def test_leaks_match_alignment_of_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 40)))) for i in range(8)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            own = items[rng.randrange(8)][1].split()
            for _ in range(rng.randrange(0, len(own) // 4)):
                own[rng.randrange(len(own))] = word()
            k = rng.randrange(len(w) + 1)
            w[k:k] = own
        docs.append((i, " ".join(w).capitalize() + "."))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)  # several blocks
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in items:
        number = {}
        a = np.array([number.setdefault(w, len(number) + 1) for w in decontamination.words_of(t)])
        for d, x in docs:
            b = np.array([number.get(w, 0) for w in decontamination.words_of(x)], np.int64)
            s = decontamination.best_local(a, b)[0] / (2 * len(a))
            if s >= decontamination.LEAST_SCORE:
                want[d, i] = s
    assert len(want) >= 15 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaks_of_edited_and_half_copies(spark):
    """Copies that have lost half of their trigrams or more, alone and beside exact copies."""
    changes = [
        lambda t: [f"x{i}" if i % 4 == 3 else w for i, w in enumerate(t)],
        lambda t: [f"x{i}" if i % 5 == 4 else w for i, w in enumerate(t)],
        lambda t: t[:31],
        lambda t: t[29:],
        lambda t: [x for i, w in enumerate(t) for x in ([w, "y"] if i % 3 == 2 else [w])],
    ]
    items, docs, want = [], [], {}
    for k, change in enumerate(changes * 2):
        item = [f"w{k}_{i}" for i in range(60)]
        items.append((k, " ".join(item)))
        for t in [change(item)] + ([item, item] if k >= len(changes) else []):
            docs.append((len(docs), " ".join(["a", "b", "c", *t, "d", "e"])))
            number = {w: i + 1 for i, w in enumerate(decontamination.words_of(items[-1][1]))}
            ids = np.array([number.get(w, 0) for w in decontamination.words_of(docs[-1][1])])
            want[docs[-1][0], k] = decontamination.best_local(np.arange(1, 61), ids)[0] / 120
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert min(want.values()) >= 0.5 and got == want


def test_items_of_one_and_two_words(spark):
    items = spark.createDataFrame([(1, "Gondwana"), (2, "blue whale"), (3, ""), (4, "a b c d e")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the Blue, Whale swims"), (2, "blue sky, whale"), (3, "gondwana gondwana"), (4, None), (5, "blue\n whale x blue whale")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.score) for r in decontamination.leaks(docs, items).collect())
    assert got == [(1, 2, 1.0), (3, 1, 1.0), (5, 2, 1.0)]
    assert list(decontamination.pieces([1, decontamination.AT_ONCE_BYTES + 5, 2])) == [(0, 1), (1, 2), (2, 3)] and list(decontamination.pieces([])) == []


def test_leaks_on_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, "two words"), (3, "a b c d e"), (3, "a b c d e")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.leaks(odd, items).collect()) == [(5, 3)] * 4 + [(6, 3)] * 2
    assert decontamination.leaks(none, items).count() == 0 and decontamination.leaks(odd, items.limit(0)).count() == 0
    assert decontamination.drop_leaks(odd, items).count() == len(ODD) - 3
