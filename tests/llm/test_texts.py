import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from brute import groups, near_pairs, without_boilerplate, without_repeats
from pyspark.sql import functions as F

from eventtally.llm import arrays, language_id, line_dedup, minhash, pipeline, substring_dedup, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def invented(rng, n):
    return [f"{rng.choice('bdgklmnprst')}{rng.choice('aeiou')}{rng.randint(0, 400)}" for _ in range(n)]


def test_line_dedup(spark, docs):
    rows = [(r.source, r.text) for r in docs.collect()]
    odd = [("s", "a\n b \n\nx1"), ("s", "b\na\n"), ("s", "b"), ("s", "b\nb"), ("s", " b"), ("s", None), ("s", ""), (None, "b"), (None, "c")]
    for some, ratio, least in ((rows, 0.1, 2), (odd, 0.3, 3), (odd + odd, 0.3, 3), ([], 0.1, 1)):
        df = spark.createDataFrame([(i, h, t, "k") for i, (h, t) in enumerate(some)], "doc_id long, source string, text string, keys string")
        found = line_dedup.drop_boilerplate(df, ratio=ratio, least_pages=least, counts=("n", "gone")).orderBy("doc_id").collect()
        expected = without_boilerplate(some, ratio, least)
        assert [r.text for r in found] == expected
        for r, (_, text) in zip(found, some, strict=True):
            assert r.n == (0 if text is None else len(text.split("\n"))) and r["keys"] == "k"
            assert r.gone == (0 if text is None else r.n - len(r.text.split("\n")) + (r.text == "" and r.gone == r.n))


def test_language_id_on_rows_held_out(spark, docs):
    held_out = language_id.held_out("doc_id", 4, 2)
    model = language_id.learn(docs.where(~held_out))
    found = language_id.identify(docs.where(held_out).withColumn("score", F.lit("clash")), model)
    right = found.where("lang = lang_pred").count()
    assert right >= 0.95 * found.count()
    assert found.where("score < 0 or score > 1").count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "123 ... !"), (2, "é"), (3, "the " * 50000), (3, None)], "doc_id long, text string")
    rows = language_id.identify(odd, model).collect()
    assert [r.lang_pred == "und" for r in rows] == [True, True, True, False, False, True]
    assert rows[4].lang_pred == "en"
    empty = language_id.learn(docs.limit(0))
    assert {tuple(r) for r in language_id.identify(odd, empty).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_language_of_many_copies_is_learned_from_its_other_texts(spark):
    rng = random.Random(6)
    few = [(" ".join(invented(rng, 20)), "aa") for _ in range(60)]
    many = [(" ".join(invented(rng, 20)).translate(str.maketrans("bdgklmnprst", "βδγκλμνπρστ")), "bb") for _ in range(60)]
    df = spark.createDataFrame(few + many + [("αβγ αβγ", "bb")] * 4000, "text string, lang string")
    picked = {r["lang"]: r["count"] for r in language_id._picked(df, 30).groupBy("lang").count().collect()}
    assert 15 <= picked["aa"] <= 45 and 15 <= picked["bb"] <= 45
    assert language_id._picked(df, 61).count() == 121
    model = language_id.learn(df, fit_rows=30)
    assert model[0] == ["aa", "bb"]
    assert language_id.identify(df, model).where("lang <> lang_pred").count() == 0


def test_language_does_not_depend_on_the_other_columns(spark, docs):
    model = language_id.learn(docs)
    shuffled = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).alias("source"))
    first = language_id.identify(docs, model).select("text", "lang_pred", "score").distinct()
    assert first.exceptAll(language_id.identify(shuffled, model).select("text", "lang_pred", "score").distinct()).count() == 0


def near_texts():
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = invented(rng, 200)
        texts.append(" ".join(base))
        for changes in (1, 2, 4, 8, 15):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(200)] = "new" + str(rng.randint(0, 999))
            texts.append("\t ".join(copy))
    texts += [texts[0], texts[0] + " ", "same five words are here now", "same five words are here now", "short one", "short one", "short  one"]
    texts += ["", "", " \n", None, None, "w " * 3000, "w " * 2950, "w " * 1000, "x y " * 30000]
    return texts


def test_minhash_finds_the_groups_of_all_pairs(spark):
    texts = near_texts()
    rows = [(i, t, i, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(None, texts[0], 1, "c"), (5, texts[5], 1, "c")], "doc_id long, text string, bucket long, runs string")
    found = minhash.near_duplicates(df.repartition(5)).collect()
    expected = groups(near_pairs(dict(enumerate(texts))), range(len(texts)))
    assert len(found) == len(texts) + 2
    assert {r.id: r.group_id for r in found if r.id is not None} == expected
    assert all(r.kept == (r.id is None or r.id == r.group_id) for r in found)


def test_minhash_one_id_on_two_texts(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(invented(rng, 150)) for _ in range(3))
    rows = [(3, b), (5, a), (5, b), (6, a + " more"), (8, b + " more"), (9, c), (9, c + " more"), (9, c), (9, c + "  more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(df, text_hash="hash")
    texts = df.distinct().withColumn("hash", F.xxhash64("text"))
    got = {(r.id, r.text): (r.group_id, r.kept) for r in found.join(texts, (F.col("id") == F.col("doc_id")) & (texts["hash"] == found["hash"])).collect()}
    nines = {key: got.pop(key) for key in rows[5:] if key in got}
    assert got == {(3, b): (3, True), (5, a): (5, True), (5, b): (3, False), (6, a + " more"): (5, False), (8, b + " more"): (3, False)}
    assert len(nines) == 3 and {g for g, _ in nines.values()} == {9} and sum(kept for _, kept in nines.values()) == 1
    left = pipeline.one_of_each_group(spark, df, SMALL).collect()
    assert sorted(tuple(r) for r in left if r.doc_id < 9) == [(3, b), (5, a)]
    assert [r.doc_id for r in left].count(9) == 1


def test_minhash_in_blocks_and_on_tables(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    found = {r.id: r.group_id for r in minhash.near_duplicates(docs).collect()}
    assert found == groups(near_pairs({r.doc_id: r.text for r in docs.collect()}), found)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_closing_buckets_compares_across_components():
    """Over all bands together, each pair that meets is compared in one of them."""
    import numpy as np
    import pyarrow as pa

    texts = pa.array(near_texts()[:6])
    runs, at = minhash.runs(texts)
    lists = [np.sort(runs[a:b]).view(np.int64) for a, b in zip(at, at[1:])]
    signed = minhash.signatures(*minhash.multisets(texts), len(texts))
    short = arrays.mixed(np.ascontiguousarray(signed).view(np.uint64).ravel()).astype(np.uint16).reshape(6, -1)
    values = minhash.bands(signed)
    links = [(0, 1), (2, 3)]
    for band in range(minhash.BANDS):
        for value in set(values[:, band].tolist()):
            own = [i for i in range(6) if values[i, band] == value]
            group = pa.table({
                "id": pa.array(own, pa.int64()), "component": pa.array([[0, 0, 2, 2, 4, 5][i] for i in own], pa.int64()),
                "block": pa.array([0] * len(own), pa.int32()), "band": pa.array([band] * len(own), pa.int32()),
                "runs": pa.array([lists[i].tolist() for i in own], pa.list_(pa.int64())),
                "registers": pa.array([short[i].tobytes() for i in own]),
            })
            found = minhash._closed(group, 0.8)
            links += zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)
    assert groups(links, range(6)) == groups(list(near_pairs(dict(enumerate(texts.to_pylist())))) + [(0, 1), (2, 3)], range(6))


def test_a_band_that_agrees_in_16_bits_only_leaves_the_pair_to_the_next(spark):
    import numpy as np
    import pyarrow as pa

    text = " ".join(invented(random.Random(5), 200))
    rows = spark.createDataFrame([(1, text), (2, text + " end")], "id long, text string")
    sets = sorted(minhash._multisets_of(rows).collect(), key=lambda r: r.id)
    registers = [np.frombuffer(r.registers, np.uint16).copy() for r in sets]
    values = minhash.bands(minhash.signatures(*minhash.multisets(pa.array([text, text + " end"])), 2))
    assert [r.bands for r in sets] == [v.tobytes() for v in values]
    common = np.flatnonzero(values[0] == values[1])
    # The first common band differs in one register, whose 16 bits are equal by chance.
    values[1, common[0]] += np.uint64(1)
    found = []
    for band in common[1:3].tolist():
        group = pa.table({
            "id": pa.array([1, 2], pa.int64()), "component": pa.array([1, 2], pa.int64()), "block": pa.array([0, 0], pa.int32()),
            "band": pa.array([band] * 2, pa.int32()), "runs": pa.array([r.runs for r in sets], pa.list_(pa.int64())),
            "registers": pa.array([x.tobytes() for x in registers]), "bands": pa.array([v.tobytes() for v in values]),
        })
        found.append(minhash._closed(group, 0.8).num_rows)
    assert found == [1, 0]


def test_signatures_estimate_weighted_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 80).astype(np.uint64)
    text = np.repeat([0, 1], 80)
    weight = np.concatenate([rng.integers(1, 9, 80), rng.integers(1, 9, 80)])
    errors = []
    for seed in range(12):
        both = minhash.signatures(text, np.tile(hashes + np.uint64(seed), 2), weight, 2)
        agree = (both[0] == both[1]).mean()
        true = np.minimum(weight[:80], weight[80:]).sum() / np.maximum(weight[:80], weight[80:]).sum()
        errors.append(agree - true)
    assert abs(np.mean(errors)) < 0.04


def repeated_rows():
    rng = random.Random(9)
    passage, other = invented(rng, 120), invented(rng, 60)
    rows = [(i, " ".join(invented(rng, 40) + passage[: 30 + 10 * i] + invented(rng, 10))) for i in range(9)]
    rows += [(20 + i, "\n".join(other[i:] + invented(rng, 30) + passage[40:])) for i in range(6)]
    rows += [(30, " ".join(passage)), (30, " ".join(passage)), (31, " ".join(passage)), (29, " ".join(passage[:49])), (28, " ".join(passage[:50]))]
    rows += [(40, "a " * 500), (41, "a " * 49), (42, "b " + "a " * 60 + "c"), (43, None), (44, ""), (45, " \t"), (40, "a " * 300)]
    rows += [(50, " ".join(invented(rng, 60000)) + " " + " ".join(passage)), (50, "another text of the same id " + " ".join(other))]
    return rows


@pytest.mark.parametrize("seed", [None, 4])
def test_substring_dedup(spark, seed):
    rows = repeated_rows()
    if seed:
        random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(i, t, k, 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, path long, n_words int")
    found = substring_dedup.drop_repeated(df.repartition(4)).orderBy("path").collect()
    for r, (_, text), (n, removed, kept) in zip(found, rows, without_repeats(rows), strict=True):
        assert (r.n_words, r.n_removed) == (n, removed)
        assert (r.text or "").encode().split() == kept
        assert removed or r.text == text
    assert substring_dedup.drop_repeated(df.limit(0)).count() == 0


def test_substring_dedup_null_ids(spark):
    text = " ".join(invented(random.Random(2), 60))
    df = spark.createDataFrame([(None, text), (None, text), (5, text)], "doc_id long, text string")
    found = {(r.doc_id, r.n_removed) for r in substring_dedup.drop_repeated(df).collect()}
    assert found == {(None, 60), (5, 0)}


def toxic_rows(n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        sentences = [" ".join(invented(rng, 9)) + "." for _ in range(rng.randint(2, 12))]
        toxic = i % 5 == 0
        at = rng.randrange(len(sentences))
        if toxic:
            bad = rng.choice(["idiot", "zwrkel" + rng.choice(["ung", "en", "st", "är", "heit"])])
            sentences[at] = sentences[at][:-1] + f" you {bad}."
        rows.append((i, " ".join(sentences), int(toxic), sentences[at]))
    return rows


def test_toxicity_finds_documents_and_sentences(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame(
        [(i, y) for i, _, y, _ in rows if i % 3] + [(1, None), (None, 1), (5, 1), (5, 0), (9999, 1)], "doc_id long, toxic int"
    )
    model = toxicity.fit(docs, labels)
    scored = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    unseen = [(i, t, y, s) for i, t, y, s in rows if i % 3 == 0]
    assert sum((scored[i].score >= 0.5) == bool(y) for i, _, y, _ in unseen) >= 0.97 * len(unseen)
    for i, text, y, sentence in unseen:
        if y and scored[i].score >= 0.5:
            named = [text[o.start : o.start + o.length].strip() for o in scored[i].offending]
            assert named == [sentence]
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "..."), (2, "you IDIOT"), (3, "fine words. " * 20000)], "doc_id long, text string")
    got = toxicity.score(odd, model).collect()
    assert [r.score for r in got[:3]] == [0.0] * 3 and got[3].score > 0.5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 0)], [(1, 1)], [(None, None)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_whose_polynomial_hashes_agree_are_told_apart(spark):
    # Polynomials in any odd base agree on these two modulo 2^64.
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(49))
    df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{other} {rest}")], "doc_id long, text string")
    cut = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeated(df).collect()}
    assert cut == {1: 0, 2: 0}
    short = spark.createDataFrame([(1, f"a b c {one}"), (2, f"a b c {other}")], "doc_id long, text string")
    assert {r.kept for r in minhash.near_duplicates(short).collect()} == {True}
    # The same as words of a run.
    runs = [" ".join({"a": "x", "b": "y"}[c] for c in thue_morse(4096)), " ".join({"a": "y", "b": "x"}[c] for c in thue_morse(4096))]
    windows = spark.createDataFrame([(i, t) for i, t in enumerate(runs)], "doc_id long, text string")
    found = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.drop_repeated(windows).collect())
    assert found == [(i, n, gone) for i, (n, gone, _) in enumerate(without_repeats(list(enumerate(runs))))]


def test_hashes_of_words_and_runs():
    rng = random.Random(9)
    words = list({bytes(rng.choice([0, 1, 97, 255]) for _ in range(rng.randint(1, 40))) for _ in range(3000)})
    data = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    found = arrays.word_hashes(data, starts, starts + sizes)
    assert len(np.unique(found)) == len(words)
    twice = arrays.word_hashes(np.concatenate([data[5:6], data]), starts + 1, starts + sizes + 1)
    assert (twice == found).all()
    values = np.array([rng.randrange(3) for _ in range(400)], np.uint64)
    runs = arrays.Runs(values)
    of = {}
    for _ in range(6000):
        a = rng.randrange(390)
        b = rng.randint(a + 1, min(400, a + 70))
        of.setdefault(tuple(values[a:b].tolist()), set()).add((a, b))
    pairs = [(run, int(runs.hashes(np.array([a]), np.array([b]))[0])) for run, places in of.items() for a, b in places]
    assert len({h for _, h in pairs}) == len(of) and len(set(pairs)) == len(of)
    both = np.array([(a, b) for places in of.values() for a, b in places])
    assert runs.hashes(both[:, 0], both[:, 1]).tolist() == [h for _, h in pairs]
    digests = arrays.digests(data, starts, starts + sizes, np.array([0, 1, 0]), np.array([2, 2, 1]))
    wanted = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in (words[:2], words[1:2], words[:1])]
    assert [d.tobytes() for d in digests] == wanted


def test_line_dedup_by_ratio_alone_and_without_broadcast(spark):
    rows = [("s", f"own {i}\nshared") for i in range(12)] + [("one", "x\ny"), (None, "shared"), (None, "k")]
    df = spark.createDataFrame([(i, h, t, 7) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string, n_lines int")
    expected = without_boilerplate(rows, 0.1, 1)
    for most in (0, 1000):
        found = line_dedup.drop_boilerplate(df, counts=("n_lines", "n_dropped"), broadcast_lines=most)
        assert found.columns == ["doc_id", "source", "text", "n_lines", "n_dropped"]
        assert [r.text for r in found.orderBy("doc_id").collect()] == expected
    plan = line_dedup.drop_boilerplate(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_toxicity_of_rare_labels(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(invented(rng, 12))) for i in range(20_000)]
    toxic = set(range(0, 20_000, 700))
    rows = [(i, t + (". you utter scumbag fool" if i in toxic else "")) for i, t in rows] + [(50_000 + i, None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i in toxic)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, fit_rows=600)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(scored[i] for i in toxic) >= 0.5 and sum(s >= 0.5 for i, s in scored.items() if i not in toxic) <= 20


def plain_features(word: bytes):
    one = lambda w: int(arrays.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    yield one(word)
    for n in toxicity.STEMS:
        if len(word) >= n:
            yield one(word[:n]) ^ int(arrays.mixed(np.array([n], np.uint64))[0])


def test_noisy_or_equals_plain_loops(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fit(docs, labels)
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    assert weights
    for r in toxicity.score(docs, model).collect():
        clean, offending = 1.0, 0
        lowered = (r.text or "").encode()
        lowered = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in lowered)
        for sentence in re.split(rb"(?<=[.!?\n])", lowered):
            found = re.findall(rb"[a-z0-9\x80-\xff]+", sentence)
            if found:
                z = model.bias + sum(weights.get(f, 0.0) for w in found for f in plain_features(w))
                p = 1 / (1 + math.exp(-max(-500, min(500, z))))
                clean *= 1 - p
                offending += p >= toxicity.OFFENDING
        assert math.isclose(r.score, 1 - clean, rel_tol=1e-6, abs_tol=1e-9) and len(r.offending) == offending


def test_cosines_equal_plain_loops(spark, docs):
    names, prototypes = model = language_id.learn(docs)
    rows = [r for r in language_id.identify(docs, model, columns=("lang_pred", "score", "grams")).collect() if r.text and len(r.text) < 1500][:40]
    letter = {}
    for r in rows:
        points = re.sub(r" +", " ", "".join(c if unicodedata.category(c)[0] == "L" else " " for c in f" {r.text.lower()} "))
        total = np.zeros(language_id.WIDTH)
        grams = [points[i : i + 3] for i in range(len(points) - 2)]
        for gram in grams:
            a, b, c = (letter.setdefault(x, language_id._letter(ord(x)).astype(int)) for x in gram)
            total += np.roll(a, 2) * np.roll(b, 1) * c
        cosines = prototypes @ total / (np.linalg.norm(total) or 1)
        assert r.grams == len(set(grams)) and names[int(cosines.argmax())] == r.lang_pred
        assert math.isclose(max(0, cosines.max()), r.score, abs_tol=1e-4)
