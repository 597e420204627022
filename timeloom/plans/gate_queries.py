"""Pattern gates, readiness of projects, policies, decisions and budgets."""

from pyspark.sql import functions as F

from timeloom.functions import numeric, text
from timeloom.operators import gates
from timeloom.plans.catalog import query
from timeloom.sources.tables import load


@query("suspicious_patterns", """SELECT doc_id, concat_ws(' ', CASE WHEN regexp_matches(text, '[0-9]{3}-[0-9]{2}') THEN '[0-9]{3}-[0-9]{2}' END, CASE WHEN contains(text, '((') THEN '((' END, CASE WHEN regexp_matches(text, '@[a-z]+') THEN '@[a-z]+' END, CASE WHEN regexp_matches(text, 'rights') THEN 'rights' END) AS hits FROM documents""")
def suspicious_patterns(spark, sf):
    hits = gates.pattern_hits(F.col("text"), ["[0-9]{3}-[0-9]{2}", "((", "@[a-z]+", "rights"])
    return load(spark, sf, "documents").select("doc_id", F.array_join(hits, " ").alias("hits"))


@query("project_readiness", "SELECT o_custkey, count(*) AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_orderstatus = 'P'), '') AS blocking, count(*) FILTER (o_orderstatus = 'P') = 0 AS ready FROM orders GROUP BY 1")
def project_readiness(spark, sf):
    got = gates.readiness(load(spark, sf, "orders"), ["o_custkey"], F.col("o_orderstatus") == "P", "o_orderkey")
    return got.select("o_custkey", "n", F.array_join(F.transform("blocking", lambda x: x.cast("string")), ",").alias("blocking"), "ready")


@query("policy_gate", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(toxic) = 0)")
def policy_gate(spark, sf):
    policy = load(spark, sf, "labels").select("doc_id", (F.col("toxic") == 0).alias("allowed"))
    return gates.policy_gate(load(spark, sf, "documents").select("doc_id", "lang"), policy, "doc_id")


@query("repair_decisions", """WITH a AS (SELECT o_orderkey, o_custkey % 4 AS tries, CASE WHEN o_orderstatus = 'P' THEN 'rerun' WHEN o_totalprice > 300000 THEN 'split' WHEN o_orderpriority LIKE '1%' THEN 'review_text' ELSE 'none' END AS act, CASE WHEN o_orderstatus = 'P' THEN 'tts' WHEN o_totalprice > 300000 THEN 'segment' WHEN o_orderpriority LIKE '1%' THEN 'script' END AS stage FROM orders)
SELECT o_orderkey, CASE WHEN act <> 'none' AND tries >= 3 THEN 'manual_review' ELSE act END AS action, CASE WHEN NOT (act <> 'none' AND tries >= 3) THEN stage END AS stage, act = 'none' OR tries >= 3 AS terminal FROM a""")
def repair_decisions(spark, sf):
    rules = [(F.col("o_orderstatus") == "P", "rerun", "tts"), (F.col("o_totalprice") > 300000, "split", "segment"), (F.col("o_orderpriority").startswith("1"), "review_text", "script")]
    return load(spark, sf, "orders").select("o_orderkey", gates.decide(rules, F.col("o_custkey") % 4, 3).alias("d")).select("o_orderkey", "d.action", "d.stage", "d.terminal")


@query("error_classes", "SELECT doc_id, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'scum') THEN 'insult' WHEN contains(lower(text), 'rights reserved') THEN 'license' WHEN contains(text, '|') THEN 'table' END AS class FROM documents")
def error_classes(spark, sf):
    return load(spark, sf, "documents").select("doc_id", gates.classify(F.col("text"), [("insult", ("idiot", "scum")), ("license", ("rights reserved",)), ("table", ("|",))]).alias("class"))


@query("retry_speeds", """SELECT l_orderkey, l_linenumber, round(greatest(0.5, least(2.0, CASE WHEN a > t THEN greatest(a / t, 1.05) ELSE a / t END)), 4) AS speed, CAST(greatest(1, floor(t * 4)) AS INT) AS chars FROM (SELECT l_orderkey, l_linenumber, l_quantity * (0.7 + 8 * l_discount) AS a, l_quantity AS t FROM lineitem)""")
def retry_speeds(spark, sf):
    q = F.col("l_quantity")
    speed = numeric.next_speed(F.lit(1.0), q * (0.7 + 8 * F.col("l_discount")), q)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", speed.alias("speed"), numeric.char_budget(q, F.lit(None).cast("int")).alias("chars"))


@query("rewritten_text", "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[!?]+', '.', 'g'), ' +', ' ', 'g'), '[|#*$%&]+', '', 'g')) AS text_md5 FROM documents")
def rewritten_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(text.rewrite(F.col("text"), [("[!?]+", "."), (" +", " "), ("[|#*$%&]+", "")])).alias("text_md5"))
