import numpy as np
import pytest

import corpus_pipeline
from tests_llm_util import near_classes
from timeloom.llm import decontamination, language_id, line_dedup


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents after each stage, each read from a file."""
    docs, out = corpus_pipeline.table(spark, sf, "documents"), []
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, sf), f"test-{name}")
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(spark, sf, stages):
    want = corpus_pipeline.table(spark, sf, "documents").columns
    assert [s.columns for s in stages[:-1]] == [want] * 4


def test_language_stage_rejects_only_the_unknown(spark, sf, stages):
    docs, kept = by_id(corpus_pipeline.table(spark, sf, "documents")), by_id(stages[0])
    assert all(not language_id.LETTER.search(docs[i].text or "") or len(docs[i].text) < 40 for i in docs.keys() - kept.keys())


def test_lines_are_kept_once(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    seen = {}
    for i in sorted(after):
        for line in (after[i].text or "").split("\n"):
            if len(line) >= line_dedup.LEAST_CHARS:
                assert line not in seen
                seen[line] = i
    for i in before:
        for line in (before[i].text or "").split("\n"):
            assert len(line) < line_dedup.LEAST_CHARS or line in seen or any(abs(len(x) - len(line)) <= 1 for x in seen)


def test_one_of_each_group_stays(stages):
    before = sorted((i, r.text) for i, r in by_id(stages[1]).items())
    assert set(by_id(stages[2])) == {d for d, least in near_classes(before).items() if d == least}


def test_leaks_go(spark, sf, stages):
    items = [(r.item_id, decontamination.words_of(r.text)) for r in corpus_pipeline.table(spark, sf, "benchmark").collect()]
    before, after = by_id(stages[2]), by_id(stages[3])
    bad = set()
    for _, words in items:
        number = {}
        a = np.array([number.setdefault(w, len(number) + 1) for w in words])
        for i, r in before.items():
            b = np.array([number.get(w, 0) for w in decontamination.words_of(r.text)], np.int64)
            if decontamination.best_local(a, b)[0] >= 2 * len(a) * decontamination.LEAST_SCORE:
                bad.add(i)
    assert set(before) - set(after) == bad


def test_mix_keeps_all(stages):
    assert {r.doc_id for r in stages[4].collect()} == set(by_id(stages[3]))


def test_run_is_the_stages(spark, sf, stages):
    key = lambda df: sorted((r.doc_id, r.epoch, r.block, r.position) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(stages[4])


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (None, "one line of plain English words that nobody has written before"), (None, "one line of plain English words that nobody has written before"), (5, "the same id and another text about the weather in the north of the country"), (5, "the same id but this time a text about the harvest in the south of it"), (6, "tie " * 30_000)]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, sf, empty):
    """Null, empty and long texts, null and repeated ids, an empty table, more columns under names of helpers."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "if(doc_id > 3, 's', null) as source", "cast(length(text) as long) as n_chars", "'clash' as _row", "'clash' as _x", "'clash' as _s")
    docs = docs.limit(0) if empty else docs
    for name, function in corpus_pipeline.STAGES:
        made = corpus_pipeline.stage(function(spark, docs, sf), f"odd-{name}")
        assert set(docs.columns) <= set(made.columns)
        assert empty or {r._row for r in made.collect()} == {"clash"}
        docs = made if name == "mixing" else made.select(docs.columns)
    assert docs.count() == 0 if empty else {r.doc_id for r in docs.collect()} >= {5, None}
