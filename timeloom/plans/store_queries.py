"""Updates, generation ids, answers of models, fingerprints, resampling and mix plans."""

from pyspark.sql import functions as F

from timeloom.operators import generations
from timeloom.plans.case_queries import cases
from timeloom.plans.catalog import query
from timeloom.sources import stores
from timeloom.sources.tables import load


@query("upserted_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey > 0")
def upserted_rows(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where(F.col("o_orderkey") % 3 == 0).select("o_orderkey", F.lit("new").alias("o_orderstatus")).unionByName(o.where((F.col("o_orderkey") % 10 == 0) & (F.col("o_orderkey") > 0)).select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("new").alias("o_orderstatus")))
    return stores.upsert(o, new, ["o_orderkey"])


@query("whole_file_rows", "SELECT c_custkey, coalesce(s, 0) AS start, coalesce(e, c_acctbal) AS \"end\" FROM customer LEFT JOIN (SELECT o_custkey, o_totalprice AS s, o_totalprice + 1 AS e FROM orders WHERE o_orderkey % 50 = 0) ON o_custkey = c_custkey")
def whole_file_rows(spark, sf):
    segments = load(spark, sf, "orders").where(F.col("o_orderkey") % 50 == 0).select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("start"), (F.col("o_totalprice") + 1).alias("end"))
    segments = segments.join(load(spark, sf, "customer").select("c_custkey"), "c_custkey", "left_semi")
    return stores.or_whole(segments, load(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("duration")), "c_custkey")


cases("inside_paths", lambda t: stores.inside_path(t).cast("string"), [("a/b.wav", "true"), ("../b", "false"), ("a/../../b", "false"), ("a/../b", "true"), ("/etc", "false"), ("C:\\x", "false")])

CHAIN = """c AS (SELECT o_orderkey, 't' || o_orderkey AS sel, CASE WHEN o_orderkey % 7 = 0 THEN 'x' WHEN o_orderkey % 5 = 0 THEN '' ELSE 't' || o_orderkey END AS tts, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 't' || o_orderkey END AS ri, 'r' || o_orderkey AS rvc, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE 'r' || o_orderkey END AS qi FROM orders)"""


@query("chain_issues", f"""WITH {CHAIN} SELECT o_orderkey, concat_ws(';', CASE WHEN tts = '' THEN 'missing_tts_generation_id' END, 'missing_qc_generation_id', CASE WHEN tts = 'x' THEN 'tts_generation_selected_tts_generation_mismatch' END, CASE WHEN ri = 'x' THEN 'rvc_input_selected_tts_generation_mismatch' END, CASE WHEN qi = 'x' THEN 'qc_input_rvc_generation_mismatch' END) AS issues FROM c""")
def chain_issues(spark, sf):
    o = F.col("o_orderkey")
    t, r = F.concat(F.lit("t"), o.cast("string")), F.concat(F.lit("r"), o.cast("string"))
    got = generations.chain_issues(t, F.when(o % 7 == 0, "x").when(o % 5 == 0, "").otherwise(t), F.when(o % 3 == 0, "x").otherwise(t), r, F.when(o % 4 == 0, "x").otherwise(r), F.lit(None).cast("string"), strict=True)
    return load(spark, sf, "orders").select("o_orderkey", F.array_join(got, ";").alias("issues"))


@query("filled_ids", """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'script:given' ELSE 'script:' || substr(sha256(o_orderpriority), 1, 20) END AS ti FROM orders),
b AS (SELECT *, 'tts:' || substr(sha256(o_orderkey || chr(31) || 'a.wav' || chr(31) || ti), 1, 20) AS tid FROM a)
SELECT o_orderkey, ti AS tts_input, tid AS tts_id, tid AS rvc_input, 'rvc:' || substr(sha256(o_orderkey || chr(31) || 'b.wav' || chr(31) || tid), 1, 20) AS rvc_id, NULL::VARCHAR AS qc_id FROM b""")
def filled_ids(spark, sf):
    none = F.lit(None).cast("string")
    o = load(spark, sf, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("script"), F.lit("a.wav").alias("tts_path"), F.when(F.col("o_orderkey") % 2 == 0, "script:given").alias("tts_input"), none.alias("tts_id"), F.lit("b.wav").alias("rvc_path"), none.alias("rvc_input"), F.lit("").alias("rvc_id"), none.alias("qc_verdict"), none.alias("qc_input"), none.alias("qc_id"))
    return generations.fill_ids(o).select("o_orderkey", "tts_input", "tts_id", "rvc_input", "rvc_id", "qc_id")


@query("scheduled_ids", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000")
def scheduled_ids(spark, sf):
    o = load(spark, sf, "orders")
    return generations.scheduled(o.where(F.col("o_orderstatus") == "F"), o.where("o_totalprice > 200000"), "o_custkey")


@query("stable_hashes", """SELECT o_orderkey, substr(sha256('{"a": ' || o_custkey || ', "b": "' || o_orderstatus || '"}'), 1, 20) AS hash FROM orders""")
def stable_hashes(spark, sf):
    payload = F.concat(F.lit('{"b":"'), "o_orderstatus", F.lit('",  "a":'), F.col("o_custkey").cast("string"), F.lit("}"))
    return load(spark, sf, "orders").select("o_orderkey", generations.stable_hash(payload).alias("hash"))


@query("dataset_fingerprints", "SELECT l_orderkey, sha256('v1' || chr(30) || array_to_string(list_sort(list(l_partkey || chr(31) || l_returnflag)), chr(30))) AS fingerprint FROM lineitem GROUP BY 1")
def dataset_fingerprints(spark, sf):
    return generations.dataset_fingerprint(load(spark, sf, "lineitem"), ["l_orderkey"], "v1", "l_partkey", "l_returnflag")


items = lambda t, f: F.array_join(F.transform(generations.answer_items(t), f), ";")
cases("parsed_translations", lambda t: items(t, lambda x: F.concat_ws("/", x["id"], x["literal"], x["natural"], F.array_join(x["notes"], "+"))), [('```json\n[{"segment_id":"s1","ko_natural":"가","notes":"none"},]\n```', "s1/가/가/"), ('{"translations":[{"segment_id":"a","ko_natural":"나","ko_literal":"다","notes":["x","y"]}]}', "a/다/나/x+y"), ('say: [{"segment_id":"a","ko_natural":"1"},{"segment_id":"a","ko_natural":"2"}] ok', "a/2/2/"), ('[{"ko_natural":"x"}]', None), ("nothing", None)])
cases("parsed_reviews", lambda t: F.array_join(F.transform(generations.review_items(generations.answer_items(t)), lambda x: F.concat_ws("/", x["id"], x["decision"], x["selected"], x["confidence"])), ";"), [('[{"chunk_id":"c","decision":"Keep","selected_id":"k1","confidence":0.5}]', "c/keep/k1/0.5"), ('[{"segment_id":"c","candidate_id":"k2","decision":"needs-manual"}]', "c/manual_review/k2"), ('[{"chunk_id":"c","decision":"keep"}]', None)])


@query("resampled_signals", "SELECT vec_id, round(list_sum(e) + list_sum(e) - (e[1] + e[-1]) / 2 + e[-1], 3)::DOUBLE AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def resampled_signals(spark, sf):
    more = generations.resampled("embedding", F.lit(8000), F.lit(16000))
    return load(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(more, F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


@query("mix_plans", """SELECT event_id, greatest(0, s - 0.75)::DOUBLE AS overlay_start, s::DOUBLE AS voice_start, least(0.25, s)::DOUBLE AS pre_pad, CASE WHEN event_type = 'click' THEN value / 100 - 1 ELSE 0.5 END AS pan FROM (SELECT event_id, event_type, least(200, greatest(0, value)) AS value, (event_id % 20) / 4.0::DOUBLE AS s FROM events)""")
def mix_plans(spark, sf):
    e = load(spark, sf, "events")
    v = F.least(F.lit(200.0), F.greatest(F.lit(0.0), F.col("value")))
    plan = generations.mix_plan((F.col("event_id") % 20) / F.lit(4.0), v / 100 - 1, F.lit(0.25), F.lit(0.5), F.col("event_type") == "click", F.lit(0.5), F.lit(-3.0))
    return e.select("event_id", plan.alias("p")).select("event_id", "p.overlay_start", "p.voice_start", "p.pre_pad", "p.pan")
