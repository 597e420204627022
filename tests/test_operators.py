import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from timeloom.functions import kernel, numeric, text
from timeloom.operators import aggregates, containment, gates, intervals, lineage, reasons, selection, sequences, vectors
from timeloom.sources import tables


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()[0]


def test_overlap_argmax_and_tie(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0), (1, 2, 2.0, 3.0)], "k int, pos int, l_start double, l_end double")
    chunks = spark.createDataFrame([(1, 0, 0.0, 0.5, 0.8), (1, 1, 0.5, 1.0, 0.4), (1, 2, 1.2, 1.8, 0.9), (1, 3, 1.5, 2.5, 0.1)], "k int, chunk_id int, r_start double, r_end double, c double")
    got = intervals.assign_by_overlap(segments, chunks, ["k"], 1.0)
    assert {r.chunk_id: r.pos for r in got.collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    mean = got.where("pos = 0").agg(intervals.weighted_mean(F.col("c"), F.col("overlap"))).first()[0]
    assert math.isclose(mean, 0.6)


def test_overlap_join_reports_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0.0, 10.0)], "k int, l_start double, l_end double")
    b = spark.createDataFrame([(1, 2.0, 9.0), (1, 10.0, 11.0), (2, 2.0, 9.0)], "k int, r_start double, r_end double")
    assert [r.overlap for r in intervals.overlap_join(a, b, ["k"], 1.5).collect()] == [7.0]


def test_part_of_point_last_is_closed(spark):
    parts = spark.createDataFrame([(1, 0, 0.0, 5.0, False), (1, 1, 5.0, 9.0, True)], "k int, part int, l_start double, l_end double, is_last boolean")
    points = spark.createDataFrame([(1, 5.0), (1, 9.0), (1, 9.5)], "k int, at double")
    assert sorted((r.at, r.part) for r in intervals.part_of_point(points, parts, ["k"], 2.0).collect()) == [(5.0, 1), (9.0, 1)]


def test_reasons_keep_order_and_ignore_null(spark):
    got = one(spark, reasons.reasons((F.col("a") > 1, "first"), (F.col("b") > 1, "null"), (F.col("a") > 0, "second"), (F.col("a") > 1, "first")), a=2, b=0)
    assert got == ["first", "second"]


@pytest.mark.parametrize("values, want", [([3, 2, 1], True), ([3, 2], False), ([3, 1, 0], False)])
def test_countdown(spark, values, want):
    assert one(spark, numeric.is_countdown("v"), v=values) is want


def test_missing_values_use_up_the_scan(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 3])], "e array<bigint>, o array<bigint>")
    assert df.select(numeric.missing_values("e", "o")).first()[0] == [2, 3]


def test_contains_run(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3]), ([1, 2, 3], [1, 3]), ([1], [])], "w array<bigint>, p array<bigint>")
    assert [r[0] for r in df.select(numeric.contains_run("w", "p")).collect()] == [True, False, True]


@pytest.mark.parametrize("s, o, want", [(0.6, 0.8, "pass"), (4.0, 6.0, "too_long"), (4.0, 2.0, "too_short"), (0.6, 0.3, "too_short"), (None, 1.0, "unknown")])
def test_duration_policy(spark, s, o, want):
    df = spark.createDataFrame([(s, o)], "s double, o double")
    assert df.select(numeric.duration_policy(F.col("s"), F.col("o"))["verdict"]).first()[0] == want


def test_numeric_stats(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 4.0, 9.0, float("nan"), None)], "k int, v double")
    r = aggregates.numeric_stats(df, ["k"], "v").first()
    assert (r.n, r.p10, r.median, r.greatest) == (4, 1.3, 3.0, 9.0)


def test_budgets(spark):
    df = spark.createDataFrame([(1, 1, 50.0), (1, 2, 30.0), (1, 3, 20.0)], "k int, i int, d double")
    assert [r.i for r in selection.budget_skip(df, ["k"], ["i"], "d", 60.0).where("kept").collect()] == [1]
    assert sorted(r.i for r in selection.budget_prefix(df, ["k"], [F.asc("i")], "d", 60.0).collect()) == [1, 2]


def test_missing_numbers(spark):
    df = spark.createDataFrame([(1, x) for x in (1, 2, 4)], "k int, n int")
    assert selection.missing_numbers(df, ["k"], "n").first().missing == [3]


def test_vote_needs_two(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1), (1, "a", 2.0, 2), (1, "b", 9.0, 3), (2, "c", 1.0, 4)], "k int, t string, s double, i int")
    assert [(r.k, r.t, r.winner) for r in selection.vote(df, ["k"], "t", "s", "i").collect()] == [(1, "a", 2)]


def test_islands(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, 2.0), (1, 5.5, 6.0), (1, 9.0, 9.5)], "k int, s double, e double")
    got = sequences.islands(df, ["k"], "s", "e", 1.0, ["s"]).orderBy("s").collect()
    assert [r.island for r in got] == [1, 1, 1, 2]


def test_span_groups_look_at_the_groups_start(spark):
    df = spark.createDataFrame([(1, float(i), i + 0.9) for i in range(6)], "k int, start double, end double")
    got = sequences.span_groups(df, ["k"], ["start"], 2.0, 0.2).orderBy("start").collect()
    assert [r.grp for r in got] == [0, 0, 0, 1, 1, 1]


def test_leader_clusters_move(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.76, 0.649923]), (1, 2, [0.0, 1.0])], "k int, i int, v array<double>")
    assert [r.cluster for r in vectors.leader_clusters(df, "k", "i", "v", 0.75).orderBy("i").collect()] == [0, 0, 1]


def test_nearest_has_threshold_and_smaller_center_wins(spark):
    c = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0])], "c int, v array<double>")
    df = spark.createDataFrame([(1, [2.0, 0.0]), (2, [-1.0, -1.0])], "i int, v array<double>")
    assert [(r.i, r.c) for r in vectors.nearest(df, "i", "v", c, "c", 0.5).orderBy("i").collect()] == [(1, 1), (2, None)]


def test_follow_ends_on_chains_and_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (7, 8), (8, 7), (9, 7), (10, 9)], "s int, t int")
    got = {r.s: r.t for r in lineage.follow(e, "s", "t").collect()}
    assert got[1] == got[2] == got[3] == 3 and (got[7], got[8], got[9], got[10]) == (7, 8, 7, 7)


def test_follow_long_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)], "s int, t int")
    assert {r.t for r in lineage.follow(e, "s", "t").collect()} == {300}


def test_nearest_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_BROADCAST_ROWS", 3)
    c = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(10)], "c int, v array<double>")
    df = spark.createDataFrame([(1, [3.0, 1.0]), (2, [0.0, 2.0]), (3, None), (4, [1.0])], "i int, v array<double>")
    assert {r.i: r.c for r in vectors.nearest(df, "i", "v", c, "c", 0.5).collect()} == {1: 3, 2: 0, 3: None, 4: None}
    assert vectors.nearest(df, "i", "v", c.limit(0), "c", 0.5).where("c is null").count() == 4


def test_contained_texts(spark):
    docs = spark.createDataFrame([(1, "xalpha beta gamma delta epsilon"), (2, "one two three"), (3, None), (4, "alpha beta")], "d int, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta eps"), (2, "one two three"), (3, ""), (4, "lpha b")], "i int, text string")
    got = sorted((r.d, r.i) for r in containment.contained(docs, "d", items, "i").collect())
    assert got == [(1, 1), (1, 4), (2, 2), (4, 4)]


def test_invalidate(spark):
    df = spark.createDataFrame([("b", 1, 2, 3), (None, 1, 2, 3)], "n string, a int, b int, c int")
    got = lineage.invalidate(df, ["a", "b", "c"], F.col("n")).collect()
    assert (got[0].a, got[0].b, got[0].c, got[0].invalidated) == (1, None, None, ["b", "c"])
    assert (got[1].c, got[1].invalidated) == (3, [])


def test_patterns_of_either_engine(spark):
    hit = gates.pattern_hits(F.col("t"), ["(?P<x>a)", "((", " ", "b+", "b+"])
    assert one(spark, hit, t="a bb ((") == ["((", "b+"]
    assert one(spark, hit, t="(?P<x>a)") == ["(?P<x>a)"]


def test_balanced_objects_within_others():
    assert kernel.balanced('{ {"a":1}') == ['{"a":1}'] and kernel.loose('x { {"a":1,}') == '{"a":1}'
    assert kernel.loose('{"a": ",}"}') == '{"a":",}"}'


def test_text_functions(spark):
    assert one(spark, text.strip(F.col("t")), t="　 a b　") == "a b"
    assert one(spark, text.longest_run(F.col("t")), t="abbbcc") == 3
    assert one(spark, text.replace_all(F.col("t"), [("ab", "a")]), t="abbbbb") == "abb"
    assert one(spark, text.natural_key(F.col("t")), t="a10") > one(spark, text.natural_key(F.col("t")), t="a9")
    for value, want in (("80%", 0.8), ("high", 0.9), ("true", 1.0), ("none", None), ("7", 0.07), ("0.4", 0.4)):
        assert one(spark, text.confidence(F.col("t")), t=value) == want
    for value, want in (("a.b", True), ("..", False), (" a", False), ("a/b", False)):
        assert one(spark, text.safe_id(F.col("t")), t=value) is want


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (7.0,)], "v double")
    assert [r[0] for r in df.select(numeric.clamp(F.col("v"), 0.0, 1.0)).collect()] == [None, 1.0]
    assert [r[0] for r in df.select(numeric.soft_upper_penalty(F.col("v"), 1.0, 2.0, 0.5)).collect()] == [0.0, 0.5]


def test_manifest_round_trip(spark, tmp_path):
    rows = [("p", i, f"s{i}", float(i), i + 1.0, 1.0, "a", "ok", "hi", "{}") for i in range(3)]
    df = spark.createDataFrame(rows, "project_id string, pos int, id string, start double, end double, duration double, speaker_id string, status string, text string, analysis string")
    tables.write_manifest(df, str(tmp_path / "m"))
    back = tables.read_manifest(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.select(df.columns).collect())) == rows
    good, bad = tables.check_segments(df.withColumn("duration", F.when(F.col("pos") == 1, 5.0).otherwise(1.0)))
    assert good.count() == 2 and bad.first().reasons == ["duration_mismatch"]


def test_kernel_functions():
    from timeloom.functions import kernel

    assert kernel.lcs(list("abcde"), list("xaxcxe")) == 3 and kernel.lcs([], [1]) == 0
    assert kernel.balanced('x {"a": "}"} y {"b": {"c": 1}}') == ['{"a": "}"}', '{"b": {"c": 1}}', '{"c": 1}']
    assert kernel.loose('```json\n{"a": 1,}\n```') == '{"a":1}' and kernel.loose("no") is None
    assert kernel.repeated_share("ab" * 10) == 1.0 and kernel.repeated_share("abcdefgh") == 0.0
    assert kernel.numeric_values("３, 2 1") == [3, 2, 1] and kernel.numeric_values("a 1") is None


def test_words(spark):
    from timeloom.operators import words

    df = spark.createDataFrame([([(0.0, 1.0, "a"), (1.1, 2.0, "b"), (5.0, 6.0, "c")],), ([],)], "w array<struct<start: double, end: double, text: string>>")
    got = df.select(words.split_at_gaps("w", 0.8).alias("p"), words.join_text("w").alias("t")).collect()
    assert [[w.text for w in p] for p in got[0].p] == [["a", "b"], ["c"]] and got[0].t == "a b c" and got[1].p == []


def test_absorb_and_pick(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.2, 5.4), (1, 6.0, 9.0), (1, 50.0, 50.1)], "k int, start double, end double")
    got = [(r.start, r.end, r.n) for r in sequences.absorb_short(df, ["k"], 1.0, 1.0, 20.0).orderBy("start").collect()]
    assert got == [(0.0, 5.4, 2), (6.0, 9.0, 1), (50.0, 50.1, 1)]
    df = spark.createDataFrame([(1, 1, 0.0, 5.0, 1.0), (1, 2, 4.0, 6.0, 2.0), (1, 3, 6.0, 7.0, 0.5)], "k int, i int, start double, end double, s double")
    assert sorted(r.i for r in sequences.pick_apart(df, ["k"], "s", "i", 2).collect()) == [2, 3]


def test_streaming_counts(spark, tmp_path):
    from timeloom.streaming import attempts

    spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, event_type string").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = attempts.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.event_type, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def test_gates(spark, tmp_path):
    from timeloom.operators import gates

    assert one(spark, gates.pattern_hits(F.col("t"), ["a+", "((", "z"]), t="xaa((") == ["a+", "(("]
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    policy = spark.createDataFrame([(1, True), (2, True), (2, False), (3, None)], "k int, allowed boolean")
    assert [r.k for r in gates.policy_gate(df, policy, "k").collect()] == [1]
    with pytest.raises(PermissionError):
        gates.policy_gate(df, None, "k")
    assert gates.inside(str(tmp_path), "a/../b").endswith("b")
    with pytest.raises(ValueError):
        gates.inside(str(tmp_path), "../x")
    d = one(spark, gates.decide([(F.col("a") > 1, "x", "s")], F.col("n"), 3), a=2, n=3)
    assert (d.action, d.stage, d.terminal) == ("manual_review", None, True)


def test_more_text_and_numbers(spark):
    for t, want in (("(1.5秒)", 1.5), ("800ms", 0.8), ("pause", 0.4)):
        assert one(spark, text.pause_seconds(F.col("t"), 0.4), t=t) == want
    assert one(spark, text.pronunciation_count(F.col("t")), t="きゃっとー x漢") == 7
    assert one(spark, text.safe_name(F.col("t")), t="..a b/c") == "a_b_c"
    key = lambda t: one(spark, text.natural_key(F.col("t")), t=t)
    assert key("a1234567890123") < key("a1234567890129") < key("a" + "9" * 40) and key("a007") == key("a7")
    assert [int(x) for x in one(spark, text.numbers(F.col("t")), t="x123456789012 7")] == [123456789012, 7]
    for tempo in (0.1, 0.5, 1.3, 2.0, 7.0):
        steps = one(spark, numeric.tempo_steps(F.col("v")), v=tempo)
        assert all(0.5 - 1e-9 <= s <= 2 + 1e-9 for s in steps) and math.isclose(math.prod(steps), tempo)


def test_texts_match_whole_and_normalised(spark):
    from timeloom.operators import selection

    docs = spark.createDataFrame([(1, "「Hello」, wide\u3000World!"), (2, "hello wide word"), (3, None), (4, "?!")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "hello wide world"), (8, "HELLO WIDE WORLD."), (7, "he"), (6, "..")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in selection.first_equal_text(docs, items, "item_id").select("doc_id", "item_id").collect()) == [(1, 8), (2, None), (3, None), (4, None)]
