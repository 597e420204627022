"""From recognised chunks to segments: cleaning, splitting, merging, growing and cutting by activity.

Rows have start and end in seconds (or any unit, if limits are given in it) and a text. Rows with a null time or a null text are not valid chunks. Where a rule looks at the
beginning of its group, one project is one task (``fold``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeloom.functions.counting import source_values
from timeloom.functions.numeric import is_countdown
from timeloom.functions.spoken import let
from timeloom.functions.text import strip
from timeloom.operators.sequences import absorb_short, fold, span_groups

#: Shorter rows are dropped.
LEAST_SECONDS = 0.05


def valid_chunks(df: DataFrame, duration: Column, sparse_longest: float | None = 30.0, least_density: float = 0.5) -> DataFrame:
    """Texts stripped and times within 0 and the duration (null: open); rows without text, without length, or long with hardly any text go. ``sparse_longest`` null keeps the last."""
    known = F.col("_known")
    df = df.withColumn("_known", F.col("start").isNotNull() & F.col("end").isNotNull())
    start = F.greatest(F.lit(0.0), F.col("start").cast("double"))
    end = F.least(F.greatest(start, F.col("end").cast("double")), duration)
    out = df.withColumns({"start": start, "end": end, "text": strip(F.col("text"))})
    out = out.where(known & (F.col("text") != "") & (F.col("end") - F.col("start") > LEAST_SECONDS)).drop("_known")
    if sparse_longest is None:
        return out
    length = F.col("end") - F.col("start")
    return out.where(~((length > sparse_longest) & (F.try_divide(F.length("text"), length) < least_density)))


# Marks, endings and particles at which a Japanese text may be cut.
STRONG = " \t\n\r。、，,.！？!?…♪　"
ENDINGS = ["ください", "でした", "ました", "ません", "です", "ます"]
SOFT_ENDS = "よねわぞぜ"
PARTICLES = "はがをにでともへや"


def boundary_score(text: Column, at: Column) -> Column:
    """How well a text can be cut before character ``at`` (from 0): white space 100, marks 95, endings 85, soft ends 70, a particle after an ideograph 60, else 0."""
    left, right = F.substring(text, at, F.lit(1)), F.substring(text, at + 1, F.lit(1))
    any_of = lambda c, chars: F.instr(F.lit(chars), c) > 0
    ending = F.lit(False)
    for e in ENDINGS:
        ending = ending | F.substring(text, F.lit(1), at).endswith(e)
    score = F.when(F.regexp_like(left, F.lit("[\\s　]")) | F.regexp_like(right, F.lit("[\\s　]")), 100).when(any_of(left, STRONG) | any_of(right, STRONG), 95).when(ending, 85)
    score = score.when(any_of(left, SOFT_ENDS), 70).when(F.regexp_like(left, F.lit("[㐀-䶿一-鿿]")) & any_of(right, PARTICLES), 60)
    return F.when((at <= 0) | (at >= F.length(text)), 0).otherwise(score.otherwise(0))


def split_point(text: Column, target: Column, least: Column, most: Column, parts: Column) -> Column:
    """The best place to cut near ``target``: the highest score within a window, then the nearest, then the first; the target itself if no place is good."""
    window = F.greatest(F.lit(8), F.ceil(F.length(text) / parts * 0.45).cast("int"))
    lo, hi = F.greatest(least, target - window), F.least(most, target + window)
    scored = F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda i: F.struct(boundary_score(text, i).alias("score"), (-F.abs(i - target)).alias("near"), (-i).alias("first"), i.alias("i")))
    best = F.array_max(F.filter(scored, lambda s: (s["score"] > 0) & (s["i"] <= hi)))
    return F.coalesce(best["i"], F.least(F.greatest(target, least), most))


def split_text(text: Column, parts: Column) -> Column:
    """A text in at most ``parts`` parts, cut where it reads best; parts that would be empty are left out."""

    def points(t: Column, k: Column) -> Column:
        n = F.length(t)
        start = F.struct(F.lit(0).alias("last"), F.slice(F.array(F.lit(0)), 1, 0).alias("at"))

        def step(a: Column, i: Column) -> Column:
            target = F.bround(n * i / k, 0).cast("int")
            p = split_point(t, target, a["last"] + 1, n - (k - i), k)
            fits = a["last"] + 1 <= n - (k - i)
            return F.struct(F.when(fits, p).otherwise(a["last"]).alias("last"), F.when(fits, F.concat(a["at"], F.array(p))).otherwise(a["at"]).alias("at"))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), start, step, lambda a: a["at"])

    def cut(t: Column, at: Column) -> Column:
        begins, ends = F.concat(F.array(F.lit(0)), at), F.concat(at, F.array(F.length(t)))
        return F.filter(F.transform(F.zip_with(begins, ends, lambda a, b: F.substring(t, a + 1, b - a)), strip), lambda p: p != "")

    def made(t: Column) -> Column:
        k = F.least(parts, F.length(t)).cast("int")
        return F.when(k <= 1, F.array(t)).otherwise(let(points(t, k), lambda at: cut(t, at)))

    return let(strip(text), made)


def split_long_chunks(df: DataFrame, longest: float) -> DataFrame:
    """Rows longer than ``longest`` become equal parts in time, with the text cut where it reads best. Adds ``part``."""
    length = F.col("end") - F.col("start")
    texts = F.when(length > longest, split_text(F.col("text"), F.ceil(length / longest).cast("int"))).otherwise(F.array("text"))
    out = df.withColumn("_t", texts).withColumn("_n", F.size("_t")).select("*", F.posexplode("_t").alias("part", "_p"))
    size = length / F.col("_n")
    return out.withColumns({"end": F.when(F.col("part") == F.col("_n") - 1, F.col("end")).otherwise(F.col("start") + size * (F.col("part") + 1)), "start": F.col("start") + size * F.col("part"), "text": F.col("_p")}).drop("_t", "_n", "_p")


def group_rows(df: DataFrame, keys: list[str], group: str, joiner: str = "") -> DataFrame:
    """One row a group: start, end, text joined in order, and n."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "text"))), lambda r: r["text"])
    return df.groupBy(*keys, group).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(texts, joiner).alias("text"), F.count("*").alias("n"))


def merge_countdowns(df: DataFrame, keys: list[str], order: list[str], most_gap: float, most_span: float) -> DataFrame:
    """Adds ``grp``: rows whose texts together count down by one are one group, if gaps and the span allow; all others are alone. A row's text holds one or more numbers, or is no count."""
    values = source_values(F.col("text"))
    v = df.withColumns({"first_v": F.get(values, 0), "last_v": F.element_at(values, -1), "own_v": F.coalesce((F.size(values) == 1) | is_countdown(values, 2), F.lit(False))})
    run = fold(v, keys, order, lambda first, last, n, row: bool(last.own_v and row.own_v and row.first_v == last.last_v - 1 and row.start - last.end <= most_gap and row.end - first.start <= most_span), "_run")
    w = W.partitionBy(*keys, "_run")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(source_values(F.col("text")), F.array().cast("array<int>")).alias("v"))).over(w)), lambda x: x["v"]))
    counts = run.withColumn("_all", is_countdown(whole))
    opens = (~F.col("_all")) | F.coalesce(F.lag("_run").over(W.partitionBy(*keys).orderBy(*order)) != F.col("_run"), F.lit(True))
    return counts.withColumn("_o", opens.cast("int")).withColumn("grp", F.sum("_o").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - 1).drop("first_v", "last_v", "own_v", "_run", "_all", "_o")


def without_overlap(df: DataFrame, keys: list[str], order: list[str], digits: int = 3) -> DataFrame:
    """Starts moved behind everything that ended before, ends at least a little later, rounded; adds ``duration`` and numbers rows as ``seg_0001``. Rows left without length go.

    A row's end is the greatest of its own, and of all before it plus the least length, so running maxima are enough where rows are longer than that.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    out = df.withColumn("start", F.greatest(F.col("start"), F.coalesce(before, F.col("start")))).withColumn("end", F.greatest(F.col("end"), F.col("start") + LEAST_SECONDS))
    out = out.withColumns({"id": F.format_string("seg_%04d", F.row_number().over(w)), "start": F.bround("start", digits), "end": F.bround("end", digits)})
    return out.withColumn("duration", F.bround(F.col("end") - F.col("start"), digits)).where("end > start")


def assemble(chunks: DataFrame, keys: list[str], duration: Column, least: float, gap: float, longest: float = 20.0) -> DataFrame:
    """Chunks (start, end, text) to segments: valid ones split where too long, grouped while short, countdowns and short groups merged, overlaps taken out, numbered."""
    parts = split_long_chunks(valid_chunks(chunks, duration), longest)
    grouped = group_rows(span_groups(parts, keys, ["start", "end", "part"], least, gap), keys, "grp").drop("grp", "n")
    counted = group_rows(merge_countdowns(grouped, keys, ["start", "end"], 2.5, 60.0), keys, "grp").drop("grp", "n")
    micro = absorb_short(counted, keys, 0.6, gap, longest, "text").drop("n")
    return without_overlap(absorb_short(micro, keys, least, gap, longest, "text").drop("n"), keys, ["start", "end"])


def repair_groups(df: DataFrame, keys: list[str], order: list[str], needs: str, most_gap: float, most_span: float) -> DataFrame:
    """Adds ``grp``: consecutive rows that need repair go together, if gap and span allow; other rows are passed through alone."""
    return fold(df, keys, order, lambda first, last, n, row: bool(getattr(row, needs) and getattr(last, needs) and row.start - last.end <= most_gap and row.end - first.start <= most_span))


def apply_repairs(df: DataFrame, repaired: DataFrame, keys: list[str]) -> DataFrame:
    """Groups (grp) with an accepted candidate (grp, text) become one row with its text; others keep their rows."""
    got = repaired.select(*keys, "grp", F.col("text").alias("_new"))
    met = df.join(got, [*keys, "grp"], "left")
    kept = met.where(F.col("_new").isNull()).drop("_new", "grp").withColumn("repaired", F.lit(False))
    merged = met.where(F.col("_new").isNotNull()).groupBy(*keys, "grp").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("_new").alias("text"))
    return kept.select(*keys, "start", "end", "text", "repaired").unionByName(merged.select(*keys, "start", "end", "text", F.lit(True).alias("repaired")))


def activity_pieces(start: Column, end: Column, text: Column, spans: Column, most_active: float = 0.35, pad: float = 0.25, least_texture: float = 1.0) -> Column:
    """A row with little activity as pieces: array<struct<kind, start, end, text>> of padded speech spans with the text dealt over them, and of texture where at least so long between them.

    ``spans``: array<struct<start, end>> relative to the row's start, in order. Null if there is no span, too much activity, or less text than spans.
    """
    piece = lambda kind, s, e, t: F.struct(F.lit(kind).alias("kind"), s.alias("start"), e.alias("end"), t.alias("text"))
    active = F.aggregate(spans, F.lit(0.0), lambda a, x: a + (x["end"] - x["start"]))
    first = F.struct(start.alias("at"), F.slice(F.array(piece("speech", start, end, text)), 1, 0).alias("out"))

    def dealt(texts: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            s, e = F.greatest(start, start + x["span"]["start"] - pad), F.least(end, start + x["span"]["end"] + pad)
            between = F.when(s - a["at"] >= least_texture, F.array(piece("texture", a["at"], s, F.lit("…")))).otherwise(F.slice(a["out"], 1, 0))
            return F.struct(e.alias("at"), F.concat(a["out"], between, F.array(piece("speech", s, e, x["text"]))).alias("out"))

        rows = F.zip_with(spans, texts, lambda x, t: F.struct(x.alias("span"), t.alias("text")))
        made = F.aggregate(rows, first, step)
        rest = let(made, lambda m: F.concat(m["out"], F.when(end - m["at"] >= least_texture, F.array(piece("texture", m["at"], end, F.lit("…")))).otherwise(F.slice(m["out"], 1, 0))))
        return F.when(F.size(texts) == F.size(spans), rest)

    good = (F.size(spans) > 0) & (active / F.greatest(F.lit(0.001), end - start) <= most_active)
    return F.when(good, let(split_text(text, F.size(spans)), dealt))


def word_timeline(words: Column, values: Column, fallback: Column) -> Column:
    """array<struct<value, text, start, end>> of the words that are one number each, if they say exactly ``values``; else ``fallback``."""
    one = F.transform(words, lambda w: F.struct(source_values(F.regexp_replace(w["text"], "^[.,、。]+|[.,、。]+$", "")).alias("v"), w.alias("w")))
    said = F.filter(one, lambda x: (F.size(x["v"]) == 1) & (x["w"]["end"] > x["w"]["start"]))
    line = F.transform(said, lambda x: F.struct(F.get(x["v"], 0).alias("value"), x["w"]["text"].alias("text"), F.round(x["w"]["start"], 6).alias("start"), F.round(x["w"]["end"], 6).alias("end")))
    return let(line, lambda t: F.when(F.transform(t, lambda x: x["value"]) == values, t).otherwise(fallback))


def forward_spans(df: DataFrame, keys: list[str], order: list[str], least: float, most: float, most_gap: float) -> DataFrame:
    """From each row (``pos``) on, rows are added until their durations reach ``least``; a gap above ``most_gap`` or more than ``most`` ends it. Returns keys, pos, n, seconds of those that reach it."""
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values(order, kind="stable")[["pos", "start", "end"]].itertuples(index=False))
        out = []
        for i, r in enumerate(rows):
            total, n, last = 0.0, 0, None
            for x in rows[i:]:
                if n and max(0.0, x.start - last) > most_gap or total + (x.end - x.start) > most:
                    break
                total, n, last = total + (x.end - x.start), n + 1, x.end
                if total >= least:
                    out.append((r.pos, n, total))
                    break
        made = pd.DataFrame(out, columns=["pos", "n", "seconds"])
        return made.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "pos", "n", "seconds"]]

    return df.groupBy(*keys).applyInPandas(run, f"{head}, pos {df.schema['pos'].dataType.simpleString()}, n int, seconds double")


def grown_spans(df: DataFrame, keys: list[str], order: list[str], least: float, most: float, most_gap: float) -> DataFrame:
    """Rows shorter than ``least`` grow by neighbours, each time by the one with the smaller gap (the next of equal ones), until long enough; none for those that cannot. Returns keys, pos, first, last (pos), seconds."""
    kind = df.schema["pos"].dataType.simpleString()
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values(order, kind="stable")[["pos", "start", "end"]].itertuples(index=False))
        out = []
        for i, r in enumerate(rows):
            lo = hi = i
            total = r.end - r.start
            if not 0 < total < least or total > most:
                continue
            while total < least:
                options = []
                if hi + 1 < len(rows) and total + rows[hi + 1].end - rows[hi + 1].start <= most:
                    options.append((max(0.0, rows[hi + 1].start - rows[hi].end), 0))
                if lo > 0 and total + rows[lo - 1].end - rows[lo - 1].start <= most:
                    options.append((max(0.0, rows[lo].start - rows[lo - 1].end), 1))
                options = [o for o in options if o[0] <= most_gap]
                if not options:
                    break
                if min(options)[1]:
                    lo -= 1
                    total += rows[lo].end - rows[lo].start
                else:
                    hi += 1
                    total += rows[hi].end - rows[hi].start
            if total >= least:
                out.append((r.pos, rows[lo].pos, rows[hi].pos, total))
        made = pd.DataFrame(out, columns=["pos", "first", "last", "seconds"])
        return made.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "pos", "first", "last", "seconds"]]

    return df.groupBy(*keys).applyInPandas(run, f"{head}, pos {kind}, first {kind}, last {kind}, seconds double")


def absorb_into(df: DataFrame, keys: list[str], pos: str, target: str, per_second: float = 4.0) -> DataFrame:
    """Rows with a ``target`` (pos of a row that has none) are absorbed by it: it spans both, its text is joined in order and its estimate made anew; they keep their times,
    lose their text and have status ``absorbed``. Adds estimate, status and absorbed (pos of what a row took in)."""
    owner = F.coalesce(F.col(target), F.col(pos))
    w = W.partitionBy(*keys, "_owner")
    rows = F.array_sort(F.collect_list(F.struct("start", pos, "text")).over(w))
    joined = F.array_join(F.filter(F.transform(rows, lambda r: r["text"]), lambda t: t.isNotNull() & (t != "")), " ")
    out = df.withColumn("_owner", owner).withColumns({"_text": joined, "_start": F.min("start").over(w), "_end": F.max("end").over(w), "_rows": F.transform(rows, lambda r: r[pos])})
    gone = F.col(target).isNotNull()
    out = out.withColumns({"text": F.when(~gone, F.col("_text")), "start": F.when(gone, F.col("start")).otherwise(F.col("_start")), "end": F.when(gone, F.col("end")).otherwise(F.col("_end"))})
    out = out.withColumns({"estimate": F.length(F.regexp_replace("text", "[^\\p{L}\\p{N}]", "")) / per_second, "status": F.when(gone, "absorbed").otherwise("kept"), "absorbed": F.when(~gone, F.array_remove("_rows", F.col(pos)))})
    return out.drop("_owner", "_text", "_start", "_end", "_rows")


def split_inside_word(left: Column, right: Column) -> Column:
    """Whether a Japanese text was cut within a word: an ideograph before hiragana, or a small kana or long mark at the cut."""
    a, b = F.substring(strip(left), -1, 1), F.substring(strip(right), 1, 1)
    small = "[ぁぃぅぇぉゃゅょっァィゥェォャュョッ]"
    is_in = lambda c, p: F.regexp_like(c, F.lit(p))
    kana = lambda block: is_in(a, block) & is_in(b, block)
    return (is_in(a, "[㐀-䶿一-鿿]") & is_in(b, "[ぁ-ゖ]")) | ((kana("[ぁ-ゖ]") | kana("[ァ-ヺー]")) & (is_in(a, small) | is_in(b, small))) | (is_in(a, "[ァ-ヺ]") & (b == "ー"))


def span_reasons(rows: str, seconds: Column, least_density: float = 1.0, least_repeats: int = 3) -> Column:
    """Why a span of rows (array<struct<id, text>>) is no good prompt: hardly any text, one phrase again and again, or a cut within a word between two rows."""
    r = F.col(rows)
    text = F.array_join(F.transform(r, lambda x: x["text"]), "")
    compact = F.regexp_replace(text, "[\\s　、。,.，．!！?？…]", "")
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda i: F.when((i < F.size(r)) & split_inside_word(F.get(r, i - 1)["text"], F.get(r, i)["text"]), F.concat(F.lit("source_split_inside_japanese_word:"), F.get(r, i - 1)["id"].cast("string"), F.lit("->"), F.get(r, i)["id"].cast("string")))), lambda x: x.isNotNull())
    sparse = F.length(compact) / F.greatest(F.lit(0.001), seconds) < least_density
    repeated = F.regexp_like(compact, F.lit(f"^(.{{2,}}?)\\1{{{least_repeats - 1},}}$"))
    return F.concat(F.array_compact(F.array(F.when(sparse, "sparse_prompt"), F.when(repeated, "repetitive_prompt"))), cuts)
