"""What SQL does not say: growing, routing, assembling, searching for subsets, and stores in a folder."""

import itertools
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.operators import assembly, generations, speakers, subsets
from timeloom.sources import stores


def test_rows_grow_by_the_nearer_neighbour(spark):
    rows = [(1, 0, 0.0, 1.0), (1, 1, 1.5, 2.5), (1, 2, 2.7, 3.7), (1, 3, 9.0, 9.5)]
    df = spark.createDataFrame(rows, "k int, pos int, start double, end double")
    got = {r.pos: (r.first, r.last, round(r.seconds, 6)) for r in assembly.grown_spans(df, ["k"], ["start"], 2.0, 10.0, 1.0).collect()}
    assert got == {0: (0, 1, 2.0), 1: (1, 2, 2.0), 2: (1, 2, 2.0)}
    assert assembly.grown_spans(df.limit(0), ["k"], ["start"], 2.0, 10.0, 1.0).count() == 0


def test_spans_end_at_gaps_and_limits(spark):
    rows = [(1, 0, 0.0, 1.0), (1, 1, 1.0, 3.0), (1, 2, 8.0, 9.0), (1, 3, 9.0, 14.0)]
    df = spark.createDataFrame(rows, "k int, pos int, start double, end double")
    got = {r.pos: (r.n, r.seconds) for r in assembly.forward_spans(df, ["k"], ["start"], 3.0, 5.5, 1.0).collect()}
    assert got == {0: (2, 3.0), 3: (1, 5.0)}


def test_rows_in_order_do_not_overlap(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 2.5, 2.8), (1, 5.0, 6.0)], "k int, start double, end double")
    got = [(r.id, r.start, r.end) for r in assembly.without_overlap(df, ["k"], ["start"]).orderBy("id").collect()]
    assert got == [("seg_0001", 0.0, 2.0), ("seg_0002", 2.0, 3.0), ("seg_0003", 3.0, 3.05), ("seg_0004", 5.0, 6.0)]


def test_chunks_become_segments(spark):
    rows = [(1, 0.0, 0.4, "a"), (1, 0.5, 4.0, "b"), (1, 10.0, 11.0, "3"), (1, 12.0, 13.0, "2"), (1, 14.0, 15.0, "1"), (1, 40.0, 70.0, "one long text of words"), (1, 80.0, 80.01, "x"), (1, 90.0, 95.0, " "), (1, None, 3.0, "y")]
    df = spark.createDataFrame(rows, "k int, start double, end double, text string")
    got = [(r.text, r.start, r.end) for r in assembly.assemble(df, ["k"], F.lit(100.0), 2.0, 0.5).orderBy("start").collect()]
    assert got == [("ab", 0.0, 4.0), ("321", 10.0, 15.0), ("one long", 40.0, 55.0), ("text of words", 55.0, 70.0)]
    assert assembly.assemble(df.limit(0), ["k"], F.lit(100.0), 2.0, 0.5).count() == 0


def test_countdowns_stop_at_the_span(spark):
    rows = [(1, i, float(i), i + 0.5, str(9 - i)) for i in range(6)]
    df = spark.createDataFrame(rows, "k int, pos int, start double, end double, text string")
    assert [r.grp for r in assembly.merge_countdowns(df, ["k"], ["pos"], 1.0, 100.0).orderBy("pos").collect()] == [0] * 6
    assert [r.grp for r in assembly.merge_countdowns(df, ["k"], ["pos"], 1.0, 3.0).orderBy("pos").collect()] == [0, 0, 0, 1, 1, 1]
    assert [r.grp for r in assembly.merge_countdowns(df, ["k"], ["pos"], 0.1, 100.0).orderBy("pos").collect()] == list(range(6))


def row(start, speaker=None, n=None, candidate=None, ratio=None, skip=False, texture=False, length=1.0):
    return {"start": start, "end": start + length, "speaker": speaker, "n": n, "candidate": candidate, "ratio": ratio, "skip": skip, "texture": texture, "has_text": True, "reason": None}


def test_routing_passes_on_what_it_assigns():
    rows = [row(0, "A"), row(1, n=1, candidate="A", ratio=0.5), row(2, n=2, ratio=0.3), row(3, n=1, candidate="A", ratio=0.25), row(4, n=0), row(5, skip=True), row(6, "A"), row(7, n=2, ratio=0.3), row(8, "B"), row(9, n=0, texture=True), row(10)]
    speakers.route(rows)
    assert [r["speaker"] for r in rows] == ["A", "A", None, "A", "A", None, "A", None, "B", None, None]
    assert rows[1]["reason"] == "borderline_single_speaker_overlap" and rows[2]["reason"] == "multi_speaker_overlap" and rows[4]["reason"] == "neighbor_same_speaker_context"
    assert rows[9]["skip"] and rows[10]["reason"] is None
    far = [row(0, "A"), row(10, n=2, ratio=0.1), row(12, "A")]
    speakers.route(far)
    assert far[1]["speaker"] is None and far[1]["skip"]


def test_clusters_of_labels(spark):
    rows = [(1, "s1", "a", 0.0, [1.0, 0.0]), (1, "s1", "a", 1.0, [1.0, 0.1]), (1, "s2", "a", 2.0, [0.0, 1.0]), (1, "s2", "b", 3.0, [1.0, 0.05]), (1, "s3", "c", 4.0, None)]
    df = spark.createDataFrame(rows, "p int, source string, label string, start double, v array<double>")
    got = {(r.source, r.label): r.cluster for r in speakers.source_clusters(df, "p", ["source", "label"], "start", "v", 0.75).collect()}
    assert got == {("s1", "a"): 0, ("s2", "a"): 1, ("s2", "b"): 0}


CLIPS = [{"id": i, "seconds": float(2 + i % 4), "pace": 2.0 + (i * 7 % 5) / 2, "quality": i % 3 / 2, "score": i % 5 / 4, "bucket": "ab"[i % 2]} for i in range(10)]


def test_beam_finds_the_best_subset():
    """A beam that holds every bin is as good as the best that plain enumeration finds within the bins' coarseness."""
    target, most, pace, tolerance = 12.0, 14.0, 3.0, 0.2
    good = []
    for k in range(1, len(CLIPS) + 1):
        for some in itertools.combinations(CLIPS, k):
            c = subsets.Choice()
            for r in some:
                c = c.plus(r)
            if c.seconds <= most and c.good(pace, target, tolerance):
                good.append(c)
    found = subsets.Choice()
    for r in subsets.beam_search(CLIPS, pace, target, most, tolerance, beam=4096):
        found = found.plus(r)
    best = max(good, key=lambda c: c.merit(pace, target))
    assert found.good(pace, target, tolerance) and found.seconds <= most
    assert found.merit(pace, target)[0] >= 0.8 * best.merit(pace, target)[0]
    assert len({r["id"] for r in found.rows}) == len(found.rows)


def test_local_search_is_repeatable_and_valid():
    got = [subsets.local_search(CLIPS, 3.0, 12.0, 14.0, 0.2, 300) for _ in range(2)]
    assert got[0] == got[1] and got[0]
    assert 12 <= sum(r["seconds"] for r in got[0]) <= 14
    assert subsets.local_search([], 3.0, 12.0, 14.0, 0.2, 300) == []


def test_balance_and_fallback():
    got = subsets.balanced(CLIPS, {"a": 0.5, "b": 0.5}, 16.0)
    by = {b: sum(r["seconds"] for r in got if r["bucket"] == b) for b in "ab"}
    assert 16 <= sum(by.values()) <= 21 and abs(by["a"] - by["b"]) <= 5
    assert len(subsets.balanced(CLIPS, {}, 1e9)) == len(CLIPS)
    assert subsets.paced(CLIPS, None, 16.0, {"a": 0.5, "b": 0.5}) == got
    assert subsets.paced(CLIPS, 90.0, 16.0, {"a": 0.5, "b": 0.5}, 8, 10) == got
    assert subsets.tolerances(0.1, 0.3) == [0.1, 0.2, 0.3]


def test_documents_and_configurations(spark, tmp_path):
    at = str(tmp_path / "c.json")
    stores.write_json(spark, at, {"b": 1, "a": {"x": 2}})
    stores.write_json(spark, str(tmp_path / "fix.json"), {"a.x": 3, "n.m": "new"})
    assert stores.read_config(spark, at, str(tmp_path / "fix.json")) == {"a": {"x": 3}, "b": 1, "n": {"m": "new"}}
    assert (tmp_path / "c.json").read_text().index('"a"') < (tmp_path / "c.json").read_text().index('"b"')
    assert stores.read_config(spark, str(tmp_path / "none.json")) == {}
    with pytest.raises(ValueError):
        stores.set_path({"a": 1}, "a.b", 2)
    rules = stores.rule_table(spark, {"replacements": {"a": "b"}, "patterns": ["x+"], "guarded": [{"source": "s", "target": "t", "required": ["r"]}]})
    assert sorted((r.kind, r.source, r.target, list(r.required)) for r in rules.collect()) == [("guarded", "s", "t", ["r"]), ("pattern", "x+", None, []), ("replacement", "a", "b", [])]


def test_reference_maps_and_caches(spark, tmp_path):
    (tmp_path / "refs.json").write_text(json.dumps({"soft": {"prompt_lang": "ja", "prompt_text": "x", "ref_audio_path": "a/b.wav"}, "bad": {"ref_audio_path": "../../b.wav"}}))
    got = {r.style: (r.path, r.inside) for r in stores.read_reference_map(spark, str(tmp_path / "refs.json"), "/root/p").collect()}
    assert got == {"soft": ("/root/p/a/b.wav", True), "bad": ("/root/p/../../b.wav", False)}
    at = str(tmp_path / "cache.json")
    stores.write_cache(spark, at, "v1", [{"k": 1, "t": "x"}])
    read = lambda s, p=at: [tuple(r) for r in stores.read_cache(spark, p, s, "k int, t string").collect()]
    assert read("v1") == [(1, "x")] and read("v2") == [] and read("v1", str(tmp_path / "no.json")) == []
    (tmp_path / "broken.json").write_text("{")
    assert read("v1", str(tmp_path / "broken.json")) == []


def test_sound_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "BLOCK_FRAMES", 65_536)
    x = np.sin(np.arange(70_000)).astype("<f4")
    x[5] = np.nan
    head = lambda form, bits, n: b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, form, 1, 8000, 8000 * bits // 8, bits // 8, bits) + b"data" + struct.pack("<I", n)
    (tmp_path / "f.wav").write_bytes(head(3, 32, x.nbytes) + x.tobytes())
    y = np.array([0, 16384, -32768, 1], "<i2")
    (tmp_path / "i.wav").write_bytes(head(1, 16, y.nbytes) + y.tobytes())
    (tmp_path / "broken.wav").write_bytes(b"RIFF")
    blocks = stores.read_pcm(spark, str(tmp_path))
    got = sorted((r.path.rsplit("/", 1)[1], r.block, r.at, len(r.samples)) for r in blocks.collect())
    assert got == [("f.wav", 0, 0, 65_536), ("f.wav", 1, 65_536, 70_000 - 65_536), ("i.wav", 0, 0, 4)]
    whole = {r.path.rsplit("/", 1)[1]: r.samples for r in stores.whole_pcm(blocks).collect()}
    assert whole["f.wav"][5] == 0.0 and whole["f.wav"][69_999] == x[-1] and whole["i.wav"] == [0.0, 0.5, -1.0, 1 / 32768]


def test_delimited_lines(spark, tmp_path):
    (tmp_path / "l.list").write_text("a.wav|s|ja|x\nb.wav|s|ja\nc.wav|s|ja|y z\n")
    got = [tuple(r) for r in stores.read_delimited(spark, str(tmp_path / "l.list"), "file string, speaker string, lang string, text string").orderBy("file").collect()]
    assert got == [("a.wav", "s", "ja", "x"), ("c.wav", "s", "ja", "y z")]
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "t string, k int")
    stores.write_list(df, str(tmp_path / "out"), ["t", "k"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a b|1", "|2"]


def test_files_in_natural_order(spark, tmp_path):
    from timeloom.sources import tables

    for name in ("t10.wav", "t9.wav", "t1.mp3", ".t0.wav", "x/raw/t2.wav", "x/t3.wav"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert names(tables.list_files(spark, str(tmp_path), ["wav"], ["raw"], limit=2)) == ["t9.wav", "t10.wav"]
    assert names(tables.list_files(spark, str(tmp_path), ["wav", "mp3"], included=["/x/"], limit=9)) == ["t2.wav", "t3.wav"]
    (tmp_path / "l.json").write_text('{"a": 1}\n{broken\n')
    assert [r.a for r in tables.read_loose_json(spark, str(tmp_path / "l.json"), "a int").collect()] == [1]
    rows = spark.createDataFrame([("s1", "b", 1)], "segment_id string, backend string, k int")
    tables.write_candidates(rows, str(tmp_path / "c"))
    assert tables.read_candidates(spark, str(tmp_path / "c"), "s1").count() == 1 and tables.read_candidates(spark, str(tmp_path / "c"), "s2").count() == 0
    for _ in range(2):
        tables.append_audit(rows, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2


def test_candidates_in_their_store(spark, tmp_path):
    at = str(tmp_path / "candidates")
    rows = lambda *r: spark.createDataFrame(list(r), "segment_id string, backend string, candidate_id string, score double")
    stores.save_candidates(rows(("s1", "x", "c1", 1.0), ("s2", "x", "c1", 2.0)), at)
    stores.save_candidates(rows(("s1", "x", "c1", 5.0), ("s1", "x", "c2", 3.0)), at)
    read = lambda: sorted((r.segment_id, r.candidate_id, r.score) for r in spark.read.parquet(at).collect())
    assert read() == [("s1", "c1", 5.0), ("s1", "c2", 3.0), ("s2", "c1", 2.0)]
    assert stores.drop_segment(spark, at, "s1") and not stores.drop_segment(spark, at, "s1")
    assert read() == [("s2", "c1", 2.0)]
    chosen = str(tmp_path / "selected")
    stores.save_selected(rows(("s1", "x", "c1", 1.0), ("s2", "x", "c9", 2.0)), chosen)
    stores.save_selected(rows(("s1", "y", "c7", 1.0)), chosen)
    assert sorted((r.segment_id, r.candidate_id) for r in spark.read.parquet(chosen).collect()) == [("s1", "c7"), ("s2", "c9")]
    filled = stores.fill_missing(rows(("s", "", "c", 1.0)), {"backend": F.lit("b"), "candidate_id": F.lit("z")}).first()
    assert (filled.backend, filled.candidate_id) == ("b", "c")


def test_dataset_and_diagnostics(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "id string, seconds double")
    rejects = spark.createDataFrame([("c", ["short:1", "loud"]), ("d", ["short:2"])], "id string, reasons array<string>")
    assert stores.write_dataset(rows, rejects, str(tmp_path / "d"), "seconds") == {"rows": 2, "seconds": 4.0, "rejects": {"short": 2, "loud": 1}}
    assert spark.read.json(str(tmp_path / "d/rejects")).count() == 2
    stores.write_json_lines(rows.limit(1), str(tmp_path / "d/rows"))
    assert spark.read.json(str(tmp_path / "d/rows")).count() == 1
    hits = spark.createDataFrame([("a", [("x", "y", 1)]), ("a", [("x", "y", 1), ("", "q", 1)])], "id string, hits array<struct<source:string,target:string,count:int>>")
    got = {r.id: r.hits and [tuple(h) for h in r.hits] for r in stores.with_hits(rows, hits, "id").collect()}
    assert got == {"a": [("x", "y", 1)], "b": None}
    stores.write_catalog(spark, str(tmp_path / "cat.json"), {"s1": {"n": 1}})
    assert json.loads((tmp_path / "cat.json").read_text()) == {"speakers": {"s1": {"n": 1}}}
    read = lambda name: [tuple(r) for r in stores.read_catalog(spark, str(tmp_path / name), "n int, t string").collect()]
    assert read("cat.json") == [("s1", 1, None)] and read("no.json") == []
    assert {len(r.sha256) for r in stores.file_hashes(spark, str(tmp_path / "cat.json")).collect()} == {64}


def test_rounds_skips_and_closures(spark):
    df = spark.createDataFrame([(1, "bad"), (2, "ok"), (None, "bad")], "id int, s string")
    assert generations.goes_on(df, F.col("s") == "bad", 0, 2) and not generations.goes_on(df, F.col("s") == "bad", 2, 2)
    assert generations.skip_for_lack({"seconds": 9.0}, "fail", 5.0) is None
    assert generations.skip_for_lack({"seconds": 1.0}, "fallback", 5.0)["status"] == "skipped"
    with pytest.raises(ValueError):
        generations.skip_for_lack({}, "fail", 5.0)
    nodes = [("a", lambda d: d.withColumn("s", F.lit("a"))), ("b", lambda d: d.withColumn("s", F.concat("s", F.lit("b"))))]
    got = {r.id: (r.s, r.ok) for r in stores.run_closure(nodes, ["b"], df, "id", [1], lambda d: d.withColumn("ok", F.lit(True))).collect()}
    assert got == {1: ("badb", True), 2: ("ok", None), None: ("bad", None)}
