"""Lexical search, secret scans and fill-in-middle against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventtally.llm import fill_in_middle, lexical_search, secret_scan
from eventtally.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, rank int, spans string, n string"


# --- lexical search ---------------------------------------------------------

def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_all, l_all = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1))) for t, n in df.items()}
    found = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 10 + 90 * c.total() * n_all // l_all
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        found += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=str)


def answered(spark, rows, items, k=10, **options):
    docs = spark.createDataFrame([(i, t, 7, "s", "x") for i, t in rows], DOCS)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = lexical_search.search(lexical_search.build(docs.repartition(3), **options), asked, k=k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def zipfian(rng, n, words=400):
    return " ".join(f"w{int(words ** rng.random())}" for _ in range(n))


@pytest.mark.parametrize("block_bytes", [2_000, 1 << 24])
def test_search_equals_scores_of_all(spark, block_bytes):
    rng = random.Random(5)
    rows = [(i, zipfian(rng, rng.choice([0, 1, 5, 40, 300]))) for i in range(700)]
    rows += [(i + 5_000, rows[i % 3 + 10][1]) for i in range(60)]  # copies tie
    items = [(i, zipfian(rng, rng.choice([1, 3, 30, 120]))) for i in range(25)]
    for k in (1, 10, 2_000):
        assert answered(spark, rows, items, k, block_bytes=block_bytes) == ranked(rows, items, k)


def test_search_small_windows_and_thresholds(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "WINDOW_DOCS", 3)
    rng = random.Random(8)
    for short in (0.0, 0.02, 0.3, 1.0):
        monkeypatch.setattr(lexical_search, "SHORT_PART", short)
        import numpy as np
        lists = {t: np.sort(rng.sample(range(200), rng.choice([1, 3, 60, 200]))) for t in range(12)}
        adds = {t: np.array([rng.randint(0, 50) * (t + 1) for _ in at], np.int64) for t, at in lists.items()}
        block = lexical_search.Postings.__new__(lexical_search.Postings)
        block.ids, block.places, block.adds = np.arange(200), lists, adds
        block.most = {t: int(a.max()) for t, a in adds.items()}
        for asked in ([0], [1, 2, 3], list(range(12)), [11, 40]):
            total = np.zeros(200, np.int64)
            for t in asked:
                if t in lists:
                    total[lists[t]] += adds[t]
            for k in (1, 4, 500):
                best = [i for i in np.lexsort((np.arange(200), -total)) if total[i] > 0][:k]
                places, scores = block.best(asked, k)
                assert places.tolist() == best and scores.tolist() == total[best].tolist()


def test_search_odd_rows(spark):
    rows = [
        (None, "Alpha beta"), (3, "ALPHA BETA"), (2, "alpha-beta"), (2, "alpha-beta"), (4, None), (5, ""), (6, "!?"),
        (7, "ÄÖ äö Ä" + " x" * 60_000), (8, "x" * 200_000), (9, "ß1٣ gamma"), (-4, "beta beta"),
    ]
    items = [(None, "alpha"), (1, "beta, ALPHA"), (1, "beta"), (2, None), (3, ""), (4, "unknown"), (5, "Ä x ß1٣"), (6, "x" * 200_000), (6, "äö")]
    assert answered(spark, rows, items) == ranked(rows, items, 10)
    assert answered(spark, [], items) == answered(spark, rows, []) == answered(spark, [(1, None)], items) == []


# --- secrets ----------------------------------------------------------------

BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    ("hex", r"[0-9a-f]+", 0, 0, 32),
)


def base_spans(text):
    found = []
    for place, (kind, pattern, flags, group, least) in enumerate(BASE):
        found += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return [text for _, _, text in sorted(found)]


def scanned(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 7, "s", "x") for i, t in rows], DOCS)
    found = secret_scan.scan(df, **options).select("id", secret_scan.listed(F.col("spans")).alias("spans")).collect()
    return sorted(((r["id"], r["spans"].split(",") if r["spans"] else []) for r in found), key=str)


def test_secret_rules(spark):
    h = hashlib.sha256(b"1").hexdigest()
    rows = [
        (1, f'é😀 Token = "{h}" and {h[:31]} {h[:32]}!'), (2, None), (3, ""), (None, "PASSWD:abcdefgh"), (4, "token=a.secret: abcdefghijk"),
        (4, "password=token=abc api_key='A1b2C3d4' apikey: 1234567"), (5, "AKIA" + "Q7" * 8 + "x AKIAAKIA AKIAAKIAAKIAAKIA1"),
        (6, "ſecret=abcdefgh1 toKen=abcdefgh2 toKen=abcdefgh3"), (7, f"0{h}{h}g{h}"), (8, f'SECRET" : "{h}.x=' + "secret\n=abcdefgh"),
        (9, "x" * 300_000 + f" api_key={h}"), (9, "token=" + "a" * 200_000), (1, f'é😀 Token = "{h}" and {h[:31]} {h[:32]}!'),
    ]
    found = scanned(spark, rows)
    assert [(i, [s for s in spans if not s.startswith("like")]) for i, spans in found] == sorted(((i, base_spans(t)) for i, t in rows), key=str)
    assert scanned(spark, []) == []
    assert scanned(spark, [(1, "nothing here"), (2, None)]) == [(1, []), (2, [])]


def test_formats_are_learned_from_labelled_values(spark):
    rng = random.Random(3)

    def made(signs, n):
        return "".join(rng.choice(signs) for _ in range(n))

    letters = "abcdefghijklmnopqrstuvwxyz"
    vowels = ["ba", "ne", "tion", "ver", "ing", "str", "omo", "li", "gra", "ment"]
    hex_, key = "0123456789abcdef", letters.upper() + "0123456789"
    rows = [(i, f"we say {''.join(rng.choice(vowels) for _ in range(9))} and token = {made(hex_, 40)} or AKIA{made(key, 16)}") for i in range(300)]
    short, badly = made(hex_, 24), "AKIA" + made(key, 9)
    odd = [
        (1_000, f"note {short} end"), (1_001, f"id {badly}-Q1 x"), (1_002, "internationalizationstrategement"),
        (1_003, f"token: {short}"), (1_004, "a" * 30),
    ]
    found = dict(scanned(spark, rows + odd))
    assert found[1_000] in (["like_hex:5:29"], ["like_assign:5:29"])
    assert found[1_003] == ["assign:0:31"] and found[1_002] == []
    assert not any(s.startswith("like") for i, spans in found.items() if i < 1_000 for s in spans)
    assert not any(s.startswith("access") for s in found[1_001])


def plain_score(automaton, value):
    state, total = 0, 0.0
    for sign in value:
        code = secret_scan.ALPHABET.index(sign)
        total += automaton.cost[state, code]
        state = automaton.to[state, code]
    return (total + automaton.cost[state, -1]) / (len(value) + 1)


def test_automaton_keeps_the_fixed_beginning_and_merges_the_rest():
    rng = random.Random(4)
    values = sorted({"AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(800)})
    automaton = secret_scan.Automaton.inferred(values)
    assert 5 <= len(automaton.to) < 60
    good, bad = automaton.scores([values[0], "QKIA" + values[0][4:]])
    assert good > bad + 0.2
    some = [*values[:20], "x", "AKIA", "zz9", ""]
    assert [round(s, 9) for s in automaton.scores(some)] == [round(plain_score(automaton, v), 9) for v in some]
    total = automaton.cost[0]
    assert math.isclose(sum(math.exp(x) for x in total), 1.0)


def test_merging_keeps_all_counts():
    values = ["ab", "abab", "ababab", "", "ab", "b"] * 40
    tree = secret_scan.PrefixTree(values)
    kept = tree.merged()
    assert sum(tree.ended[s] for s in kept) == len(values)
    for s in kept:
        assert tree.seen[s] == tree.ended[s] + sum(tree.edges[s].values())
        assert set(tree.next[s].values()) <= set(kept)


# --- fill in the middle -----------------------------------------------------

def cut(doc_id, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_slices(spark):
    rng = random.Random(2)
    signs = "ab \n\r \x00é漢😀$\\<PSM>{}%"
    rows = [(rng.choice([None, i, -i]), "".join(rng.choice(signs) for _ in range(rng.choice([1, 2, 5, 255, 256, 257, 600])))) for i in range(400)]
    rows += [(1, None), (2, ""), (3, "<P>"), (4, "a<S>b"), (5, "<M"), (5, "<M"), (None, None), (6, "😀" * 300_000), (7, "x" * 1_000_003)]
    df = spark.createDataFrame([(i, t, 7, "s", "clash") for i, t in rows], DOCS).repartition(4)
    found = fill_in_middle.fill_in_middle(df).withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form")))
    assert found.columns == ["doc_id", "text", "rank", "spans", "n", "form", "prefix_chars", "middle_chars", "output", "again"]
    got = found.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "again").collect()
    key = lambda row: (str(row[0]), row[1] or "", row[1] is None)
    for r, (i, t) in zip(sorted(got, key=key), sorted(rows, key=key), strict=True):
        assert tuple(r)[:2] == (i, t) and tuple(r)[2:7] == cut(i, t) and r["again"] == (t or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(df.limit(0)).count() == 0


def test_fill_in_middle_by_words_and_other_sentinels(spark):
    df = spark.createDataFrame([(i, "one  two\nthree four five ") for i in range(50)], "doc_id long, text string")
    marks = ("$1|", "\\2|", "%d|")
    found = fill_in_middle.fill_in_middle(df, unit=r"\S+\s*", sentinels=marks, plain_percent=0)
    rows = found.withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r["n"] for r in rows} == {5} and all(r["again"] == r["text"] for r in rows)
    assert all(r["output"].count("|") == 3 for r in rows)
    for bad in (("a", "a", "b"), ("", "x", "y"), ("<a", "a>", "x"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(df, sentinels=bad)


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    from oracle import connect, differences

    from eventtally.llm.oracles import ORACLES

    assert differences(spark, connect(SMALL), QUERIES[name], ORACLES[name], SMALL) == []


def test_secret_query_keeps_the_rules_spans(spark):
    found = {r["doc_id"]: r for r in QUERIES["op12_secret_scan"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc_id, text in docs:
        spans, r = base_spans(text), found[doc_id]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
        assert set(spans) <= set(r["spans"].split(","))
