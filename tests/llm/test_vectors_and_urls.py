import math
import random
import time

import numpy as np
import pytest
from brute import groups

from eventtally.llm import embedding_dedup, topk, url_filters
from eventtally.llm.components import components


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    df = spark.createDataFrame(pairs + [(7, 7), (None, 3)], "a long, b long")
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    expected = groups([p for p in pairs if p[0] != p[1]], nodes)
    assert {r.node: r.component for r in components(df).collect()} == expected
    assert components(df.limit(0)).count() == 0


def vectors(n, width=8, seed=0):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n // 4, width))
    rows = [points[i % len(points)] + rng.normal(size=width) * (0, 0.05, 0.2, 0.5)[i % 4] for i in range(n)]
    return [(i, [float(x) for x in row]) for i, row in enumerate(rows)]


ODD = [
    (900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [math.nan] + [1.0] * 7), (905, [math.inf] * 8),
    (906, [1.0] * 3), (907, [2.0] * 3), (908, [-0.0, 1.0, 0.0]), (909, [0.0, 1.0, 0.0]), (None, [1.0] * 8), (910, [1e-300] * 8), (911, [1e300] * 8),
]


def expected_links(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = [(i, (v / abs(v).max()) / np.linalg.norm(v / abs(v).max())) for i, v in good]
    pairs = [(a, b) for k, (a, x) in enumerate(unit) for b, y in unit[:k] if len(x) == len(y) and x @ y >= 0.9]
    return pairs


@pytest.mark.parametrize(("leaf", "side"), [(4096, embedding_dedup.SIDE_BYTES), (16, embedding_dedup.SIDE_BYTES), (16, 1)])
def test_embedding_dedup(spark, monkeypatch, leaf, side):
    """In one leaf, many leaves in few groups, and a leaf a group or so."""
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    monkeypatch.setattr(embedding_dedup, "SIDE_BYTES", side)
    monkeypatch.setattr(embedding_dedup, "BROADCAST_BYTES", side)
    rows = vectors(240) + [(300 + i, [1.0] * 8) for i in range(60)] + [(400 + i, [float(i + 1)] * 8) for i in range(50)] + ODD
    df = spark.createDataFrame([(i, v, "x", i) for i, v in rows], "vec_id long, embedding array<double>, label string, node long")
    found = embedding_dedup.near_duplicates(df.repartition(3)).collect()
    pairs = expected_links(rows)
    component = groups(pairs, [i for i, _ in rows if i is not None])
    assert len(found) == len(rows)
    for r in found:
        if r.id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id) == (sum(r.id in p for p in pairs), component[r.id]), r
            assert r.kept == (r.id == r.component_id)


def test_embedding_dedup_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(df).count() == 0


def test_traversal_counts_dense_groups_whole():
    rng = np.random.default_rng(2)
    raw = [np.concatenate([c + rng.normal(size=(150, 6)) * 0.01 for c in rng.normal(size=(3, 6))]) for _ in range(2)]
    raw[1][:150] = raw[0][:150] + rng.normal(size=(150, 6)) * 0.01
    found = embedding_dedup.Traversal(raw, [embedding_dedup.Tree(embedding_dedup._unit(r)) for r in raw], [np.ones(450, np.int64)] * 2, 0.9)
    found.run()
    linked = embedding_dedup._unit(raw[0]) @ embedding_dedup._unit(raw[1]).T >= 0.9
    assert found.counts[0].tolist() == linked.sum(axis=1).tolist() and found.counts[1].tolist() == linked.sum(axis=0).tolist()


def test_tree_radii_halve_and_cover():
    units = embedding_dedup._unit(np.array([v for _, v in vectors(200, 4)]))
    tree = embedding_dedup.Tree(units)
    assert sorted(tree.order.tolist()) == list(range(200))
    for node, (low, high) in enumerate(tree.children):
        members = tree.order[tree.begin[node] : tree.end[node]]
        gap = np.linalg.norm(units[members] - units[tree.center[node]], axis=1)
        assert gap.max() <= tree.radius[node] + 1e-9 and tree.center[node] in members
        assert all(tree.radius[c] <= tree.radius[node] / 2 + 1e-5 for c in range(low, high))


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "QUERIES_A_GROUP", 5)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rows = [(i, v) for i, v in vectors(300, 6) if i % 7] + [(1000, [0.0] * 6), (1020, [0.001] * 6), (1021, None), (1022, [math.nan] * 6), (None, [1.0] * 6), (1040, [1.0, 2.0])]
    rows += [(1060, rows[3][1]), (1061, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, weights string").repartition(3)
    weights = topk.weights(df, "vec_id", "embedding")
    found = topk.top_k(weights, weights.where("id % 20 = 0"), 5).collect()
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and not any(map(math.isnan, v))}
    expected = []
    for q in good:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)
            expected += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores[:5], 1)]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_top_k_few_rows_and_large_weights(spark):
    df = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 1.0]), (2, [-1e17, 1.0])], "vec_id long, embedding array<double>")
    weights = topk.weights(df, "vec_id", "embedding")
    found = topk.top_k(weights, weights.where("id = 0"), 20).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(found)] == [(1, 1, (1 << 63) - 1), (2, 2, -(1 << 63))]
    assert topk.top_k(weights.limit(0), weights.limit(0)).count() == 0


ENTRIES = [
    ("bad", "host", "a.example.org", "block", "add", 10), ("bad", "host", "a.example.org", "block", "remove", 20),
    ("bad", "host", "a.example.org", "block", "add", 20), ("bad", "host", "a.example.org", "block", "remove", 30),
    ("bad", "domain", "example.org", "block", "add", 50), ("good", "prefix", "b.example.org/x/", "allow", "add", 50),
    ("also", "domain", "example.org", "block", "add", 55), ("good", "host", "c.example.org", "allow", "add", 50),
    ("bad", "host", "c.example.org", "block", "add", 60), ("bad", "host", None, "block", "add", 1), ("bad", "host", "n.org", "block", "add", None),
    ("bad", "host", "n.org", None, "add", 1), ("bad", "host", "a.example.org", "block", "add", 10),
]


@pytest.mark.parametrize("url, at, verdict, list_, n", [
    ("http://a.example.org/q", 9, "none", None, 0), ("http://A.EXAMPLE.org:80/q", 10, "block", "bad", 1),
    ("http://me:pw@a.example.org/q", 25, "block", "bad", 1), ("http://a.example.org./q", 30, "none", None, 0),
    ("https://z.example.org", 52, "block", "bad", 1), ("https://z.example.org", 56, "block", "also", 2),
    ("https://b.example.org/x/y?z#f", 70, "allow", "good", 3), ("https://b.example.org/xy", 70, "block", "also", 2),
    ("https://c.example.org/", 55, "allow", "good", 3), ("https://c.example.org/", 60, "block", "bad", 4),
    ("https://badexample.org/", 70, "none", None, 0), (None, 70, "no_url", None, 0), ("", 70, "no_url", None, 0),
    ("not a url", 70, "no_url", None, 0), ("https://c.example.org/", None, "no_time", None, 0), ("http://n.org/", 70, "none", None, 0),
])
def test_url_filters(spark, url, at, verdict, list_, n):
    entries = spark.createDataFrame(ENTRIES, "list string, kind string, value string, verdict string, action string, at long")
    captures = spark.createDataFrame([(1, url, at, "clash"), (1, url, at, "other")], "id long, url string, fetched_at long, verdict string")
    (row,) = url_filters.evaluate(captures, url_filters.intervals(entries)).collect()
    assert (row.verdict, row.list, row.n_active) == (verdict, list_, n)


def test_url_filters_on_empty_tables(spark):
    entries = spark.createDataFrame([], "list string, kind string, value string, verdict string, action string, at long")
    captures = spark.createDataFrame([(1, "http://a.org/" + "x/" * 2000, 5)], "id long, url string, fetched_at long")
    assert [r.verdict for r in url_filters.evaluate(captures, url_filters.intervals(entries)).collect()] == ["none"]
    assert url_filters.evaluate(captures.limit(0), url_filters.intervals(entries)).count() == 0


def test_very_long_urls(spark):
    deep = "http://a.example/" + "/".join(f"s{i}" for i in range(40_000))
    wide = "http://" + ".".join("x" for _ in range(20_000)) + ".a.example/p"
    captures = spark.createDataFrame([(1, deep, 10), (2, wide, 10), (3, "http://b.a.example/s0/s1", 10)], "id long, url string, fetched_at long")
    entries = spark.createDataFrame(
        [("l", "prefix", "a.example/s0/s1", "allow", "add", 1), ("l", "domain", "a.example", "block", "add", 1), ("l", "prefix", "b.a.example/s0/s1/s2", "allow", "add", 1)],
        "list string, kind string, value string, verdict string, action string, at long",
    )
    began = time.time()
    found = {r.id: (r.verdict, r.value) for r in url_filters.evaluate(captures, url_filters.intervals(entries)).collect()}
    assert found == {1: ("allow", "a.example/s0/s1"), 2: ("block", "a.example"), 3: ("block", "a.example")}
    assert time.time() - began < 20
