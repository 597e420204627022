"""Subsets of clips, groups, variants and histories. Parts stand in for clips."""

from pyspark.sql import functions as F

from timeloom.operators import subsets
from timeloom.plans.case_queries import cases
from timeloom.plans.catalog import query
from timeloom.sources.tables import load

SHARES = {"STANDARD": 0.5, "PROMO": 0.3, "SMALL": 0.2}


def clips(spark, sf):
    p = load(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(F.col("p_brand").alias("speaker"), k.alias("id"), F.col("p_size").cast("double").alias("seconds"), ((k % 7 + 3) / 2.0).cast("double").alias("pace"), ((k % 11) / 10.0).cast("double").alias("quality"), ((k % 13) / 12.0).cast("double").alias("score"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("bucket"))


@query("balanced_subset")
def balanced_subset(spark, sf):
    return subsets.select(clips(spark, sf), ["speaker"], lambda rows: subsets.balanced(rows, SHARES, 120.0)).select("speaker", "id", "place")


@query("paced_subset")
def paced_subset(spark, sf):
    return subsets.select(clips(spark, sf), ["speaker"], lambda rows: subsets.paced(rows, 3.0, 60.0, SHARES, beam=32, iterations=100)).select("speaker", "id", "place")


@query("score_filter", "SELECT p_partkey AS id, CASE WHEN (p_partkey % 13) / 12.0::DOUBLE < 0.4 THEN 'training_selection_score_below_min:' || format('{:.3f}', (p_partkey % 13) / 12.0::DOUBLE) || '<0.400' END AS reason FROM part")
def score_filter(spark, sf):
    return subsets.score_filter(clips(spark, sf), "score", 0.4).select("id", "reason")


@query("best_groups", """WITH g AS (SELECT l_orderkey, l_returnflag AS grp, max(l_tax) AS s, count(*) AS n, sum(l_quantity) AS seconds FROM lineitem GROUP BY 1, 2), t AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, n DESC, seconds DESC, grp DESC) = 1)
SELECT l_orderkey, grp, n, seconds FROM t WHERE n = 2 OR seconds / 60 BETWEEN 0.75 AND 1.25""")
def best_groups(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("grp"), "l_tax", "l_quantity")
    return subsets.best_group(rows, ["l_orderkey"], "grp", F.col("l_tax"), "l_quantity", F.lit(60.0), F.lit(2))


cases("variant_keys", subsets.variant_key, [("Disc1/Track 01_noSE.wav", "disc1/track 01"), ("a/b_dry_mix.flac", "a/b"), ("ｘ／Ｙ.mp3", "x/y"), ("a/b.c.wav", "a/b.c")])


@query("appended_candidates", "SELECT o_orderkey, 'F' || CASE WHEN o_orderstatus <> 'F' THEN ',' || o_orderstatus ELSE '' END AS texts FROM orders")
def appended_candidates(spark, sf):
    one = F.array(F.struct(F.lit("a").alias("id"), F.lit("F").alias("text")))
    df = load(spark, sf, "orders").withColumn("found", one)
    return df.select("o_orderkey", F.array_join(F.transform(subsets.appended("found", F.lit("b"), F.concat(F.col("o_orderstatus"), F.lit(" "))), lambda x: x["text"]), ",").alias("texts"))


@query("merged_histories", """SELECT coalesce(a.c, b.c) AS c, coalesce(b.s, a.s) AS s, concat_ws(',', a.h, b.h) AS h FROM (SELECT o_custkey AS c, min(o_orderstatus) AS s, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS h FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS c, max(o_orderstatus) AS s, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS h FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.c = b.c""")
def merged_histories(spark, sf):
    def side(odd, head):
        return load(spark, sf, "orders").where(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_custkey").alias("c")).agg(head("o_orderstatus").alias("s"), F.array_sort(F.collect_list("o_orderkey")).alias("h"))

    got = subsets.merged_history(side(0, F.min), side(1, F.max), ["c"], ["s"], "h")
    return got.select("c", "s", F.array_join(F.transform("h", lambda x: x.cast("string")), ",").alias("h"))


@query("distinct_clips", "SELECT l_orderkey, arg_min(l_linenumber, l_extendedprice) AS l_linenumber, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1")
def distinct_clips(spark, sf):
    return subsets.distinct_by(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], F.col("l_extendedprice"))
