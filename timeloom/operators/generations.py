"""Generation ids of a chain script, voice, conversion, check: filled in, compared, and what follows from them; answers of models read by id."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.operators.lineage import content_id
from timeloom.operators.reasons import reasons


def fill_ids(df: DataFrame) -> DataFrame:
    """Missing ids of a row: what a step was made from is the id of the step before, and its own is made of its content. Columns: id, script, tts_path, tts_input, tts_id, rvc_path,
    rvc_input, rvc_id, qc_verdict, qc_input, qc_id; a step without its content gets none."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    made = lambda c, has, v: F.when(empty(c) & ~empty(has), v).otherwise(F.col(c))
    df = df.withColumn("tts_input", made("tts_input", "tts_path", content_id("script", F.col("script"))))
    df = df.withColumn("tts_id", made("tts_id", "tts_path", content_id("tts", F.col("id"), F.col("tts_path"), F.col("tts_input"))))
    df = df.withColumn("rvc_input", made("rvc_input", "rvc_path", F.col("tts_id")))
    df = df.withColumn("rvc_id", made("rvc_id", "rvc_path", content_id("rvc", F.col("id"), F.col("rvc_path"), F.col("rvc_input"))))
    df = df.withColumn("qc_input", made("qc_input", "qc_verdict", F.col("rvc_id")))
    return df.withColumn("qc_id", made("qc_id", "qc_verdict", content_id("qc", F.col("id"), F.col("qc_verdict"), F.col("qc_input"))))


def chain_issues(selected: Column, tts: Column, rvc_input: Column, rvc: Column, qc_input: Column, qc: Column, strict: bool = False) -> Column:
    """Where ids do not agree along the chain; strictly also which are missing."""
    no = lambda c: F.coalesce(c, F.lit("")) == ""
    checks = []
    if strict:
        names = ("selected_tts_generation_id", "tts_generation_id", "rvc_generation_id", "rvc_input_selected_tts_generation_id", "qc_generation_id", "qc_input_rvc_generation_id")
        checks = [(no(c), f"missing_{n}") for n, c in zip(names, (selected, tts, rvc, rvc_input, qc, qc_input))]
    both = lambda a, b: ~no(a) & ~no(b) & (a != b)
    return reasons(*checks, (both(tts, selected), "tts_generation_selected_tts_generation_mismatch"), (both(rvc_input, selected), "rvc_input_selected_tts_generation_mismatch"), (both(qc_input, rvc), "qc_input_rvc_generation_mismatch"))


def scheduled(first: DataFrame, second: DataFrame, ident: str) -> DataFrame:
    """Ids that either stage has scheduled."""
    return first.select(ident).union(second.select(ident)).where(F.col(ident).isNotNull()).distinct()


def goes_on(df: DataFrame, target: Column, done_rounds: int, most_rounds: int) -> bool:
    """Whether another round is due: rounds are left, and a target exists."""
    return done_rounds < most_rounds and bool(df.where(target).limit(1).count())


def skip_for_lack(summary: dict, policy: str, least_seconds: float) -> dict | None:
    """With too little material, a record of why the stage is skipped, if the policy has a fallback; an error if it has none; nothing if there is enough."""
    if summary.get("seconds", 0.0) >= least_seconds:
        return None
    if policy not in ("fallback", "skip"):
        raise ValueError(f"{summary.get('seconds', 0.0):.3f} s of material, {least_seconds:.3f} s are needed")
    return {"status": "skipped", "reason": "insufficient_training_data", "policy": policy, "seconds": summary.get("seconds", 0.0), "needed": least_seconds}


@F.pandas_udf(T.StringType())
def stable_hash(payload: pd.Series) -> pd.Series:
    """The first 20 hex digits of the sha-256 of a JSON text with sorted keys and no escapes; null for null, and the text itself is hashed if it is no JSON."""
    import hashlib

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            text = json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)
        except ValueError:
            pass
        return hashlib.sha256(text.encode("utf-8")).hexdigest()[:20]

    return payload.map(one)


def dataset_fingerprint(df: DataFrame, by: list[str], config: str, *columns: str) -> DataFrame:
    """A fingerprint of a configuration with the rows of each group, whatever their order: equal inputs need no new run."""
    rows = F.array_sort(F.collect_list(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])))
    return df.groupBy(*by).agg(F.sha2(F.concat(F.lit(config + "\x1e"), F.array_join(rows, "\x1e")), 256).alias("fingerprint"))


def arrays(text: str) -> list[str]:
    """All balanced ``[...]`` of a text; brackets in JSON strings do not count."""
    out, opened, quoted, escaped = [], [], False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"' and opened:
            quoted = True
        elif c == "[":
            opened.append(i)
        elif c == "]" and opened:
            out.append(text[opened.pop() : i + 1])
    return out


def loose_items(text: str | None) -> list[dict] | None:
    """The objects of the first readable array in a loose text (fences, prose, trailing commas, or an object that holds it as ``translations``); null if none is."""
    from timeloom.functions.kernel import without_commas

    if text is None:
        return None
    inner = text.strip()
    if inner.startswith("```"):
        inner = inner.split("\n", 1)[-1].rsplit("```", 1)[0].strip()
    for part in [inner, *sorted(arrays(inner), key=len, reverse=True)[:1]]:
        for form in (part, without_commas(part)):
            try:
                got = json.loads(form)
            except ValueError:
                continue
            if isinstance(got, dict):
                got = got.get("translations")
            if isinstance(got, list) and all(isinstance(x, dict) for x in got):
                return got
    return None


ITEMS = "array<struct<id:string,literal:string,natural:string,decision:string,selected:string,confidence:string,notes:array<string>>>"


def answer_items(answer: Column) -> Column:
    """The items of a model's answer as array<struct<id, literal, natural, decision, selected, confidence, notes>> (see ``answer_json``)."""
    return F.from_json(answer_json(answer), ITEMS)


@F.pandas_udf(T.StringType())
def answer_json(answers: pd.Series) -> pd.Series:
    """The items of a model's answer as strict JSON, by their names or other names in use. The last of equal ids wins; an answer
    with an item without an id, and an unreadable one, is null. A literal form that is missing is the natural one."""

    def notes(value) -> list[str]:
        if isinstance(value, str):
            value = [] if value.strip().lower() in ("", "none", "n/a", "null") else [value.strip()]
        return [str(v) for v in value or [] if str(v).strip()]

    def one(text: str | None):
        items = loose_items(text)
        if items is None:
            return None
        out: dict[str, dict] = {}
        for x in items:
            pick = lambda *names, x=x: next((str(x[n]).strip() for n in names if x.get(n) not in (None, "")), "")
            ident = pick("segment_id", "chunk_id")
            if not ident:
                return None
            confidence = x.get("confidence")
            decision = pick("decision").lower().replace("-", "_")
            decision = decision if decision in ("replace", "keep") else "manual_review"
            out[ident] = {"id": ident, "literal": pick("ko_literal", "ko_natural"), "natural": pick("ko_natural"), "decision": decision, "selected": pick("selected_candidate_id", "selected_id", "candidate_id"), "confidence": None if confidence is None else str(confidence).lower(), "notes": notes(x.get("notes"))}
        return json.dumps(list(out.values()), ensure_ascii=False)

    return answers.map(one)


def by_id(items: Column) -> Column:
    """Items as a map by id."""
    return F.map_from_entries(F.transform(items, lambda x: F.struct(x["id"], x)))


def review_items(items: Column) -> Column:
    """Decisions, all of which must name a candidate; null if one does not."""
    return F.when(F.forall(items, lambda x: x["selected"] != ""), items)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def resampled(samples: pd.Series, rate: pd.Series, new_rate: pd.Series) -> pd.Series:
    """Samples at another rate, by linear interpolation; the last sample is held."""
    import numpy as np

    def one(x, a, b):
        if x is None or not len(x) or a == b:
            return x
        n = max(1, round(len(x) * b / a))
        return np.interp(np.arange(n) * (len(x) / n), np.arange(len(x)), np.asarray(x, float)).astype(np.float32)

    return pd.Series([one(*r) for r in zip(samples, rate, new_rate)])


def mix_plan(start: Column, pan: Column, pre_pad: Column, pause_before: Column, use_pan: Column, profile_pan: Column, gain: Column, offset: float = 0.0) -> Column:
    """struct<overlay_start, voice_start, pre_pad, pause, pan, gain>: where a clip goes on the timeline by its style's profile; nothing starts before 0."""
    overlay = F.greatest(F.lit(0.0), start - pre_pad - pause_before)
    room = F.greatest(F.lit(0.0), start - overlay)
    pad = F.least(pre_pad, room)
    side = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(use_pan, pan).otherwise(profile_pan)))
    return F.struct(overlay.alias("overlay_start"), (overlay + room).alias("voice_start"), pad.alias("pre_pad"), F.greatest(F.lit(0.0), room - pad).alias("pause"), side.alias("pan"), (gain + offset).alias("gain"))


def sound_check(levels: DataFrame, target: str) -> DataFrame:
    """Adds ``duration_ratio`` to measured levels with seconds and a target; 0 for a target of 0 or less."""
    return levels.withColumn("duration_ratio", F.when(F.col(target) > 0, F.try_divide("seconds", target)).otherwise(0.0))
