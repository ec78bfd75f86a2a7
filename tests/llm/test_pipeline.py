import random

import pytest
from brute import groups, near_pairs, without_boilerplate, without_repeats
from oracle import connect, differences

import __spark_entry__ as entry
import corpus_pipeline
from eventtally.llm import line_dedup, pipeline
from eventtally.llm.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, connect(FOLDER), entry.queries()[name], ORACLES[name], FOLDER) == []


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def ran(name, df):
        out = stages[name](spark, df, FOLDER)
        if name != "packing":
            assert out.columns == COLUMNS
        return spark.createDataFrame(out.collect(), out.schema)

    known = ran("language_id", docs)
    assert known.count() >= 0.97 * len(texts)
    rows = sorted(known.collect())
    lines = ran("line_dedup", known)
    cleaned = without_boilerplate([(r.source, r.text) for r in rows], line_dedup.BOILERPLATE_RATIO, pipeline.LEAST_PAGES, distinct=True)
    assert [r.text for r in sorted(lines.collect())] == cleaned
    assert lines.where("n_chars <> length(text)").count() == 0
    single = ran("minhash", lines)
    left = {r.doc_id: r.text for r in lines.collect()}
    group = groups(near_pairs(left), left)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, g in group.items() if i == g)
    cut = ran("substring_dedup", single)
    before = sorted((r.doc_id, r.text) for r in single.collect())
    expected = {i: kept for (i, _), (_, removed, kept) in zip(before, without_repeats(before), strict=True) if kept or not removed}
    assert {r.doc_id: r.text.encode().split() for r in cut.collect()} == expected
    packed = ran("packing", cut)
    assert {r.doc_id for r in packed.collect()} == set(expected)


def test_stages_on_odd_rows(spark):
    text = " ".join(f"word{i} is here" for i in range(40))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, text, "en", "a", 5), (2, text, "en", "a", 5), (3, text, None, None, None), (4, "12 34", "en", "a", 5)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, of string, __n int")
    for empty in (False, True):
        out = df.limit(0) if empty else df
        for name, function in corpus_pipeline.STAGES:
            before, out = out, function(spark, out, FOLDER)
            out = spark.createDataFrame(out.collect(), out.schema)
            if name != "packing":
                assert out.columns == before.columns
        assert {r.doc_id for r in out.collect()} == (set() if empty else {2})


def test_unlearned_scripts_are_rejected_and_short_texts_kept(spark):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    strange = [
        (10_000 + i, " ".join("".join(chr(first + rng.randrange(24)) for _ in range(rng.randint(3, 9))) for _ in range(60)), None, "s", 0)
        for i in range(60) for first in [rng.choice([0x10D0, 0x0561, 0x05D0, 0x0E01, 0x0430])]
    ]
    short = [(20_000, "the", None, "s", 0), (20_001, "123 4", None, "s", 0), (20_002, "and the", None, "s", 0)]
    both = docs.select(COLUMNS).unionByName(spark.createDataFrame(strange + short, docs.select(COLUMNS).schema))
    left = {r.doc_id for r in pipeline.known_language(spark, both, FOLDER).collect()}
    assert not left & set(range(10_000, 20_000)) and {20_000, 20_002} <= left and 20_001 not in left
    assert len(left) >= 0.97 * docs.count()


def test_copies_do_not_clean_each_other(spark):
    rows = [(i, f"own {i} line\nfooter", "en", "a", 0) for i in range(30)] + [(100 + i, "copied text\nfooter", "en", "a", 0) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in pipeline.without_boilerplate(spark, df, FOLDER).collect()}
    assert out[0] == "own 0 line" and out[100] == out[119] == "copied text"
