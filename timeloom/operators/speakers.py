"""Which speaker a row belongs to: overlaps counted for merged speakers, neighbours that agree, small speakers merged into large ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.operators.intervals import overlap_join
from timeloom.operators.vectors import centroids, leader_clusters, nearest

# Shares of overlap that decide, and the gap up to which neighbours count.
BORDERLINE, CONTEXT, LEAST, RULING = 0.45, 0.30, 0.20, 0.60
CONTEXT_GAP = 3.0
LONGEST_INHERITED = 12.0


def matching_items(rows: DataFrame, items: DataFrame, keys: list[str], width: float, least: float = 0.3) -> DataFrame:
    """rows(l_start, l_end, row_id, text), items(r_start, r_end, item_row, item_text): pairs that overlap by ``least`` of the shorter one, agree on the row id if the item
    names one, and one of whose texts is part of the other (an item without text fits). Adds ``ratio``."""
    shorter = F.least(F.greatest(F.lit(0.001), F.col("l_end") - F.col("l_start")), F.greatest(F.lit(0.001), F.col("r_end") - F.col("r_start")))
    met = overlap_join(rows, items, keys, width).withColumn("ratio", F.col("overlap") / shorter)
    same = F.col("item_row").isNull() | (F.col("item_row") == F.col("row_id"))
    text = F.coalesce(F.col("item_text"), F.lit(""))
    return met.where((F.col("ratio") >= least) & same & ((text == "") | F.contains(F.col("text"), text) | F.contains(text, F.col("text"))))


def merged_overlaps(df: DataFrame, keys: list[str], speaker: str, overlap: str, merges: DataFrame, seconds: str) -> DataFrame:
    """df(keys, speaker, overlap, seconds), merges(speaker, target), followed to its end: overlaps summed by final speaker; one is accepted if it is alone or has ``RULING`` of the row.

    Returns keys, n (speakers left), speaker (the greatest overlap, of equal ones the greater name), ratio, accepted.
    """
    ends = merges.select(F.col("speaker").alias("_s"), F.col("target").alias("_t"))
    named = df.join(ends, F.col(speaker) == F.col("_s"), "left").withColumn(speaker, F.coalesce("_t", speaker)).drop("_s", "_t")
    sums = named.groupBy(*keys, speaker).agg(F.sum(overlap).alias("_o"), F.first(seconds).alias("_d"))
    best = sums.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.struct("_o", speaker)).alias("_b"), F.first("_d").alias("_d"))
    out = best.select(*keys, "n", F.col(f"_b.{speaker}").alias("speaker"), (F.col("_b._o") / F.greatest(F.lit(0.001), F.col("_d"))).alias("ratio"))
    return out.withColumn("accepted", (F.col("n") == 1) | (F.col("ratio") >= RULING))


def neighbour_speaker(rows: list, i: int, close: bool = True) -> str | None:
    """The speaker of the nearest rows before and after, if they agree (and are near). Skipped rows are passed over; another row without a speaker ends the search."""

    def seek(step: int):
        k = i + step
        while 0 <= k < len(rows):
            if not rows[k]["skip"]:
                return rows[k] if rows[k]["speaker"] else None
            k += step
        return None

    before, after = seek(-1), seek(1)
    if before is None or after is None or before["speaker"] != after["speaker"]:
        return None
    if close and (rows[i]["start"] - before["end"] > CONTEXT_GAP or after["start"] - rows[i]["end"] > CONTEXT_GAP):
        return None
    return before["speaker"]


def route(rows: list[dict]) -> None:
    """Two passes in order over rows of a project; a row that gets a speaker in them is a neighbour for later rows."""
    for i, r in enumerate(rows):
        if r["skip"] or r["speaker"] or r["n"] is None:
            continue
        if r["n"] == 1 and r["candidate"] and r["ratio"] is not None:
            if r["ratio"] >= BORDERLINE:
                r["speaker"], r["reason"] = r["candidate"], "borderline_single_speaker_overlap"
            elif r["ratio"] >= CONTEXT:
                agreed = neighbour_speaker(rows, i) == r["candidate"]
                r["speaker"], r["reason"] = r["candidate"], "neighbor_confirmed_single_speaker_overlap" if agreed else "single_speaker_overlap_tts_routing"
            elif r["ratio"] >= LEAST:
                r["speaker"], r["reason"] = r["candidate"], "single_speaker_overlap_tts_routing"
        elif r["n"] == 0 and r["texture"]:
            r["skip"], r["reason"] = True, "source_speaker_no_overlap_short_texture"
        elif r["n"] > 1:
            found = r["candidate"] if (r["ratio"] or 0) >= RULING else None
            reason = "dominant_multi_speaker_overlap_tts_routing"
            if not found:
                found, reason = neighbour_speaker(rows, i), "neighbor_confirmed_multi_speaker_overlap"
            r["speaker"], r["reason"], r["skip"] = found, reason if found else "multi_speaker_overlap", not found
    for i, r in enumerate(rows):
        if not r["skip"] and not r["speaker"] and r["n"] == 0 and r["end"] - r["start"] <= LONGEST_INHERITED and r["has_text"]:
            found = neighbour_speaker(rows, i, close=False)
            if found:
                r["speaker"], r["reason"] = found, "neighbor_same_speaker_context"


def route_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """df(keys, pos, start, end, speaker, skip, n, candidate, ratio, texture, has_text) with ``speaker`` filled in and ``reason``. One project is one task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", reason string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        rows = [{k: None if v is None or v != v else v for k, v in r.items()} | {"reason": None} for r in pdf.to_dict("records")]
        route(rows)
        return pd.DataFrame(rows)[[*pdf.columns, "reason"]]

    return df.groupBy(*keys).applyInPandas(run, schema)


def merge_small(stats: DataFrame, vectors: DataFrame, target_seconds: float, least_cosine: float, distinct_rows: int = 5) -> DataFrame:
    """stats(speaker, seconds, n), vectors(speaker, vector), one a speaker: what happens to speakers with too little material.

    Each goes to the most similar large speaker (without a vector of its own to the one with most seconds, of equal ones the smaller name): by its centroid if similar enough, else as a fallback, unless it has
    ``distinct_rows`` rows or more and is then preserved with that one's model. Returns speaker, target, cosine, basis, action; nothing if no speaker is large.
    """
    large = stats.where(F.col("seconds") >= target_seconds)
    small = stats.where(F.col("seconds") < target_seconds)
    centers = vectors.join(large.select("speaker"), "speaker", "left_semi")
    near = nearest(vectors, "speaker", "vector", centers.select(F.col("speaker").alias("target"), "vector"), "target", -1.0)
    longest = large.agg(F.min(F.struct((-F.col("seconds")).alias("s"), "speaker"))["speaker"].alias("longest"))
    met = small.join(near, "speaker", "left").withColumn("longest", longest.scalar()).withColumn("target", F.coalesce("target", "longest")).where(F.col("target").isNotNull())
    alike = F.coalesce(F.col("cosine") >= least_cosine, F.lit(False))
    basis = F.when(alike, "clean_centroid").when(F.col("n") >= distinct_rows, "distinct_low_similarity").otherwise("major_bucket_fallback")
    return met.select("speaker", "target", F.round("cosine", 6).alias("cosine"), basis.alias("basis"), F.when(basis == "distinct_low_similarity", "preserve").otherwise("merge").alias("action"))


def source_clusters(turns: DataFrame, by: str, labels: list[str], start: str, vector: str, least: float) -> DataFrame:
    """Turns of one label are one: their centroids, in order of their first start, are clustered. Returns by, labels and cluster; labels without a vector are left out."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [by, *labels]])
    named = turns.withColumn("_key", key)
    made = centroids(named.where(F.col(vector).isNotNull()), "_key", vector)
    first = named.groupBy("_key", by, *labels).agg(F.min(start).alias("_start"))
    order = F.struct("_start", "_key")
    groups = made.join(first, "_key").withColumn("_order", order)
    found = leader_clusters(groups.withColumn("_text", F.concat(F.format_string("%025.6f", F.col("_start").cast("double")), F.lit("|"), F.col("_key"))), by, "_text", vector, least)
    return groups.withColumn("_text", F.concat(F.format_string("%025.6f", F.col("_start").cast("double")), F.lit("|"), F.col("_key"))).join(found, [by, "_text"]).select(by, *labels, "cluster")


def attempts_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Of attempts (round, status, verified, stale): the last round, and counts of those sent to review, put aside, not verified, and of stale candidates."""
    return df.groupBy(*by).agg(
        F.coalesce(F.max("round"), F.lit(0)).alias("rounds"),
        F.count_if(F.col("status") == "needs_manual_review").alias("manual_review"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"),
        F.count_if(~F.col("verified")).alias("verification_failed"),
        F.coalesce(F.sum("stale"), F.lit(0)).alias("stale_filtered"),
    )


def merged_summaries(df: DataFrame, by: list[str], counts: list[str], items: str, order: str) -> DataFrame:
    """Summaries put together: counts added up, items one after the other."""
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(items), F.slice(F.col(items), 1, 0)).alias("i")))), lambda x: x["i"]))
    return df.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], lists.alias(items))


def clean_seconds(real: Column, clean: Column) -> Column:
    return F.coalesce(real, clean, F.lit(0.0))
