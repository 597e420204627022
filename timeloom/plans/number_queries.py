"""Numerals, countdowns, plans and budgets; words with times; small gates and measures."""

from pyspark.sql import functions as F

from timeloom.functions import counting, numeric, spoken, text
from timeloom.operators import aggregates, gates, words
from timeloom.plans.case_queries import cases
from timeloom.plans.catalog import query
from timeloom.sources.tables import load

ONES, TENS = str(counting.NATIVE_ONES), str(counting.NATIVE_TENS)
NATIVE = f"CASE WHEN {{0}} < 10 THEN ({ONES})[{{0}} + 1] ELSE ({TENS})[{{0}} // 10 + 1] || CASE WHEN {{0}} % 10 = 0 THEN '' ELSE ({ONES})[{{0}} % 10 + 1] END END"
D = str(spoken.DIGITS)
UNIT = f"CASE WHEN {{0}} // {{1}} % 10 = 0 THEN '' WHEN {{0}} // {{1}} % 10 = 1 THEN '{{2}}' ELSE ({D})[{{0}} // {{1}} % 10 + 1] || '{{2}}' END"
BELOW = lambda v: " || ".join(UNIT.format(v, n, w) for n, w in ((1000, "천"), (100, "백"), (10, "십"))) + f" || CASE WHEN {v} % 10 = 0 THEN '' ELSE ({D})[{v} % 10 + 1] END"


@query("numerals", f"""SELECT o_orderkey, CASE WHEN n < 100 THEN {NATIVE.format('n')} END AS native, CASE WHEN n = 0 THEN '영' WHEN n >= 100000 THEN array_to_string(list_transform(string_split(n::VARCHAR, ''), lambda d: ({D})[d::INT + 1]), '')
WHEN n >= 10000 THEN CASE WHEN n // 10000 = 1 THEN '' ELSE {BELOW('(n // 10000)')} END || '만' || {BELOW('(n % 10000)')} ELSE {BELOW('n')} END AS words FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 100 ELSE o_orderkey * 7919 % 130000 END AS n FROM orders)""")
def numerals(spark, sf):
    n = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 100).otherwise(F.col("o_orderkey") * 7919 % 130000)
    return load(spark, sf, "orders").select("o_orderkey", counting.native_numeral(n).alias("native"), spoken.integer_words(n).alias("words"))


RUNS = """c AS (SELECT o_orderkey, o_orderkey % 5 AS how, 5 + o_orderkey % 4 AS n, 20 + o_custkey % 30 AS s FROM orders), b AS (SELECT *, list_transform(generate_series(0, n - 1), lambda i: s - i) AS base FROM c)"""


@query("mended_countdowns", f"""WITH {RUNS} SELECT o_orderkey, CASE how WHEN 0 THEN NULL WHEN 4 THEN NULL ELSE array_to_string(base, ' ') END AS mended FROM b""")
def mended_countdowns(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("how"), (5 + F.col("o_orderkey") % 4).cast("int").alias("n"), (20 + F.col("o_custkey") % 30).cast("int").alias("s"))
    base = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("s") - i)
    how = F.col("how")
    wrong = lambda *at: F.transform(base, lambda x, i: F.when(i.isin(*at), 3 + i).otherwise(x))
    left_out = F.filter(base, lambda x, i: i != 2)
    values = F.when(how == 0, base).when(how == 1, wrong(2)).when(how == 2, left_out).when(how == 3, F.concat(base, F.slice(base, -1, 1), F.slice(base, -1, 1))).otherwise(wrong(1, 3))
    return o.select("o_orderkey", counting.repaired_text(F.array_join(F.transform(values, lambda v: v.cast("string")), ", ")).alias("mended"))


@query("render_plans", f"""SELECT o_orderkey, CASE k WHEN 0 THEN 'countdown_10_to_1' WHEN 1 THEN 'descending_countdown' WHEN 2 THEN 'numeric_cadence' END AS kind, CASE k WHEN 0 THEN array_to_string(t, ', ') || '.' WHEN 1 THEN array_to_string(t, ' ') || '.' WHEN 2 THEN array_to_string(t, '. ') || '.' END AS text
FROM (SELECT *, list_transform(v, lambda x: {NATIVE.format('x')}) AS t FROM (SELECT *, CASE k WHEN 0 THEN [10, 9, 8, 7, 6, 5, 4, 3, 2, 1] WHEN 1 THEN [s + 2, s + 1, s] WHEN 2 THEN [s, s + 1, s] ELSE [s] END AS v FROM (SELECT o_orderkey, o_orderkey % 4 AS k, o_custkey % 90 AS s FROM orders)))""")
def render_plans(spark, sf):
    k, s = F.col("o_orderkey") % 4, (F.col("o_custkey") % 90).cast("int")
    v = F.when(k == 0, F.array(*map(F.lit, range(10, 0, -1)))).when(k == 1, F.array(s + 2, s + 1, s)).when(k == 2, F.array(s, s + 1, s)).otherwise(F.array(s))
    plan = counting.render_plan(v)
    return load(spark, sf, "orders").select("o_orderkey", plan["kind"].alias("kind"), plan["text"].alias("text"))


@query("sequence_checks", """SELECT o_orderkey, CASE k WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'fail' WHEN 3 THEN 'fail' ELSE 'unavailable' END AS gate, CASE k WHEN 1 THEN (s + 1)::VARCHAR || ',' || s WHEN 3 THEN (s + 2)::VARCHAR || ',' || (s + 1) || ',' || s ELSE '' END AS missing, CASE k WHEN 0 THEN '' WHEN 1 THEN 'numeric_sequence_order_mismatch,numeric_sequence_missing_values,numeric_sequence_contiguous_mismatch' WHEN 2 THEN 'numeric_sequence_contiguous_mismatch' WHEN 3 THEN 'empty_numeric_transcript' ELSE 'numeric_sequence_too_short' END AS issues FROM (SELECT o_orderkey, o_orderkey % 5 AS k, o_custkey % 50 AS s FROM orders)""")
def sequence_checks(spark, sf):
    k, s = F.col("o_orderkey") % 5, (F.col("o_custkey") % 50).cast("int")
    full, none = F.array(s + 2, s + 1, s), F.array().cast("array<int>")
    heard = F.when(k == 0, F.concat(F.array(F.lit(99)), full)).when(k == 1, F.array(s + 2, s)).when(k == 2, F.array(s + 2, F.lit(99), s + 1, s)).when(k == 3, none).otherwise(full)
    df = load(spark, sf, "orders").withColumns({"e": F.when(k == 4, F.slice(full, 1, 2)).otherwise(full), "o": heard})
    got = counting.sequence_check("e", "o")
    return df.select("o_orderkey", got["gate"].alias("gate"), F.array_join(F.transform(got["missing"], lambda x: x.cast("string")), ",").alias("missing"), F.array_join(got["issues"], ",").alias("issues"))


@query("slot_budgets", "SELECT l_orderkey, l_linenumber, greatest(4, floor(l_quantity * 4))::INT AS target, greatest(greatest(4, floor(l_quantity * 4)) + 2, floor(greatest(4, floor(l_quantity * 4)) * 1.12), 6)::INT AS most FROM lineitem")
def slot_budgets(spark, sf):
    got = counting.slot_budget(F.col("l_quantity"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", got["target"].alias("target"), got["most"].alias("most"))


@query("shifted_words", "SELECT l_orderkey, string_agg(round(l_quantity + l_orderkey % 10, 3)::DOUBLE || '-' || round(l_quantity + 1 + l_orderkey % 10, 3)::DOUBLE, ',' ORDER BY l_linenumber, l_quantity) AS times FROM lineitem GROUP BY 1")
def shifted_words(spark, sf):
    w = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("start"), (F.col("l_quantity") + 1).alias("end")))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    df = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(w.alias("w"))
    moved = words.shift("w", F.col("l_orderkey") % 10)
    return df.select("l_orderkey", F.array_join(F.transform(moved, lambda x: F.concat(F.round(x["start"], 3).cast("string"), F.lit("-"), F.round(x["end"], 3).cast("string"))), ",").alias("times"))


@query("moot_reasons", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'late' ELSE 'late,asr_low' END AS kept, o_orderstatus <> 'F' AS triggered FROM orders")
def moot_reasons(spark, sf):
    df = load(spark, sf, "orders").withColumn("r", F.array(F.lit("late"), F.lit("asr_low")))
    df = df.withColumn("k", gates.without_moot("r", F.col("o_orderstatus") == "F", ["asr_low"]))
    return df.select("o_orderkey", F.array_join("k", ",").alias("kept"), gates.has_reason("k", ["other"], ["asr_"]).alias("triggered"))


@query("tempo_steps", "SELECT l_orderkey, l_linenumber, CASE WHEN t > 8 THEN 4 WHEN t > 4 THEN 3 WHEN t > 2 THEN 2 WHEN t < 0.0625 THEN 5 WHEN t < 0.125 THEN 4 WHEN t < 0.25 THEN 3 WHEN t < 0.5 THEN 2 ELSE 1 END AS n, round(pow(10, -l_discount), 6) AS gain FROM (SELECT *, l_quantity / 10 AS t FROM lineitem)")
def tempo_steps(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.size(numeric.tempo_steps(F.col("l_quantity") / 10)).alias("n"), F.round(numeric.gain(-20 * F.col("l_discount")), 6).alias("gain"))


@query("value_counts", "SELECT v AS value, count(*) AS n FROM (SELECT unnest([l_returnflag, l_linestatus]) AS v FROM lineitem) GROUP BY 1")
def value_counts(spark, sf):
    return aggregates.count_values(load(spark, sf, "lineitem"), F.array("l_returnflag", "l_linestatus"))


cases("safe_ids", lambda t: text.safe_id(t).cast("string"), [("a.b", "true"), ("..", "false"), (" a", "false"), ("a/b", "false"), ("", "false")])
cases("safe_names", text.safe_name, [("a b/c", "a_b_c"), ("..", "unnamed"), ("x.wav", "x.wav")])
cases("pause_hints", lambda t: spoken.pause_hint(t).cast("string"), [("1.5秒", "1.5"), ("800ms", "0.8"), ("2 sec", "2.0"), ("長い間", "0.8"), ("short pause", "0.25"), ("待つ", "0.45"), ("other", None)])
cases("pronunciation_counts", lambda t: text.pronunciation_count(t).cast("string"), [("きょうは", "3"), ("漢字とカー", "7"), ("ab1、", "3"), ("っ", "1"), ("", "0")])
cases("japanese_marks", spoken.japanese_punctuation, [("はい , ええ..そう", "はい、ええ。そう"), ("......", "……"), ("！！？", "！")])
