import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventtally.llm import arrays, bpe, byte_bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

ODD = [
    None, "", " ", "\n\n", "it's  don't 'll x'll  \n\n y \t z", "''s 's's a''re", "don'the I'M", "a1b2 ½x", "日本語 テキスト",
    "!'s  'veu", "'", "'r", "é \U0001f600!!", "x" * 300, "ab" * 700, " " * 500 + "a", "<|endoftext|> plain", " a b\x1cc",
    "wörter und Wörter und wörter", "word " * 3000,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )


def odd_docs(spark):
    rows = [(i if i % 7 else None, t, "clash", b"clash") for i, t in enumerate(ODD)] + [(3, "same", "x", b""), (3, "same", "x", b"")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids binary")


def test_pretokens_are_the_matches_of_the_pattern():
    rng = random.Random(5)
    letters = "'  \n\tstmdrevlla1!é½ ' ’"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    data, offsets = arrays.text_bytes(pa.array(texts))
    starts = arrays.pretokens(data, offsets)
    words = bpe.as_words(data, starts).to_pylist()
    at = np.searchsorted(starts, offsets)
    pattern = regex.compile(public_tokenizers.PATTERN)
    for i, text in enumerate(texts):
        if "\x1c" not in text:  # white space to Python's regex, not to Unicode
            assert words[at[i] : at[i + 1]] == [m.encode() for m in pattern.findall(text)], text


def test_merges_equal_the_libraries(library):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = [t or "" for t in ODD]
    for merges, encode in (
        (bpe.merges_of_ranks(RANKS), library.encode_ordinary),
        (bpe.merges_of_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), lambda t: tokenizer.encode(t, add_special_tokens=False).ids),
    ):
        tokens, at = bpe.Encoder(merges).encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert tokens[at[i] : at[i + 1]].tolist() == encode(text), text


def test_fold_equals_the_library(spark, library):
    words = [" the", "anderwhedor", "thereandthere", "aaaaaaa", "é", " naïve", "\n\n", "1234567", "日本"]
    df = spark.createDataFrame([(w, w.encode()) for w in words], "word string, raw binary").repartition(2)
    ranks = byte_bpe.rank_map(bpe.read_ranks(RANKS))
    for row in df.select("word", byte_bpe.folded(F.col("raw"), ranks).alias("ids")).collect():
        assert row.ids == library.encode_ordinary(row.word)


def test_encode_and_decode(spark, library):
    docs = odd_docs(spark)
    coded = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    expected = []
    for row in docs.collect():
        ids = library.encode_ordinary(row.text or "")
        expected.append((row.doc_id, np.array(ids, "<u4").tobytes(), (row.text or "").encode()))
    both = byte_bpe.encode(docs, decoded="decoded").collect()
    for rows in (coded, both):
        assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows), key=repr) == sorted(expected, key=repr)


def test_dictionary_is_bounded_by_frequency(spark):
    texts = spark.createDataFrame([(" the" * 50 + " and" * 20 + " rare" * 2 + " once",)], "text string")
    assert set(byte_bpe.dictionary(texts, RANKS, words=2)) == {b" the", b" and"}
    assert byte_bpe.dictionary(texts.limit(0), RANKS) == {}


def test_packing_covers_every_token_once(spark):
    docs = odd_docs(spark).withColumn("row", F.monotonically_increasing_id())
    # The row number as id, to tell repeated rows apart.
    pieces = [r.asDict() for r in packing.pack(docs, "row").collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    for row in docs.collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [0]
        own = sorted((p for p in pieces if p["doc_id"] == row.row), key=lambda p: p["start"])
        assert [p["start"] for p in own] == np.cumsum([0] + [p["length"] for p in own[:-1]]).tolist()
        assert b"".join(bytes(p["ids"]) for p in own) == np.array(ids, "<u4").tobytes()
        assert {p["doc_tokens"] for p in own} == {len(ids)}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for placed in sequences.values():
        ends = 0
        for offset, length in sorted(placed):
            assert offset == ends and length > 0
            ends += length
        assert ends <= 1024


def test_packing_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, None), (1, "")], "doc_id long, text string")
    pieces = packing.pack(docs).collect()
    assert sorted((str(p.doc_id), p.length, p.doc_tokens, bytes(p.ids)) for p in pieces) == [
        ("1", 1, 1, b"\0" * 4), ("1", 1, 1, b"\0" * 4), ("None", 1, 1, b"\0" * 4)
    ]
    assert packing.pack(docs.limit(0)).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0))).count() == 0


def test_assignment_fills_and_balances():
    rng = random.Random(1)
    lengths = np.array([rng.randint(1, 3000) for _ in range(400)])
    cost = lambda n: n + n * n / 6144
    pieces = packing.assign(lengths, 1024, cost)
    used, spent = {}, {}
    for _, _, length, sequence, offset in pieces:
        assert offset == used.get(sequence, 0)
        used[sequence] = offset + length
        spent[sequence] = spent.get(sequence, 0) + cost(length)
    assert len(used) == -(-lengths.sum() // 1024)
    assert sum(1024 - n for n in used.values()) < 1024
    mixed = [spent[s] for s in spent if sum(p[3] == s for p in pieces) > 1]
    in_order = [0.0] * len(mixed)
    for at, (_, _, length, sequence, _) in enumerate(p for p in pieces if p[2] < 1024):
        in_order[at % len(mixed)] += cost(length)
    assert max(mixed) - min(mixed) < max(in_order) - min(in_order)


def test_digests_of_the_contract(spark, tmp_path):
    from eventtally.llm import queries

    docs = spark.createDataFrame([(1, "a small text, with words"), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op3_byte_bpe(spark, str(tmp_path)).collect()}
    assert rows[2].n_tokens == 0 and rows[2].ids_sha256 == hashlib.sha256(b"").hexdigest() == rows[2].decoded_sha256
    assert rows[1].decoded_sha256 == hashlib.sha256(b"a small text, with words").hexdigest()
    packed = queries.op5_packing(spark, str(tmp_path)).where("doc_id = 2").first()
    assert packed.ids_crc32 == zlib.crc32(b"\0" * 4) and packed.doc_tokens == 1


def test_very_long_words(library, monkeypatch):
    rng = random.Random(8)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = bpe.merges_of_ranks(RANKS), bpe.merges_of_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["".join(rng.choice(signs) for _ in range(n)) for n, signs in ((3_000, "abcdefghijklmnopqrstuvwxyz"), (4_000, "ab"), (2_500, "aaab"), (1_500, "日本é"), (5, "abc"))]
    texts = [words[0], words[4], words[1], words[2] + " " + words[4], words[3]]
    for merges, encode in ((own[0], library.encode_ordinary), (own[1], lambda t: tokenizer.encode(t, add_special_tokens=False).ids)):
        tokens, at = bpe.Encoder(merges).encode(pa.array(texts))
        assert [tokens[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [encode(t) for t in texts]
    monkeypatch.setattr(bpe, "LONG_BYTES", 0)
    tokens, at = bpe.Encoder(own[0]).encode(pa.array(ODD[1:]))
    assert [tokens[at[i] : at[i + 1]].tolist() for i in range(len(ODD) - 1)] == [library.encode_ordinary(t) for t in ODD[1:]]
    began = time.time()
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(600_000))
    tokens, _ = bpe.Encoder(own[0]).encode(pa.array([long]))
    ranks = {rank: piece for piece, rank in bpe.read_ranks(RANKS).items()}
    assert b"".join(ranks[t] for t in tokens.tolist()).decode() == long and time.time() - began < 20
