"""Byte-level BPE: texts to token ids and back, by a file of ranks.

Texts are cut by public_tokenizers.PATTERN.  The distinct words of the corpus are
counted, and the frequent ones, a dictionary of bounded size, are encoded by
Spark's higher-order functions: a fold over the bytes of a word joins, step by
step, the neighbours with the lowest rank, which a literal map of ranks gives.
The dictionary is broadcast.  Words outside it are merged by the same rule as
arrays, where they occur.  Decoding concatenates the pieces of the ids.

Defined results: a null text is an empty one; ids of null decode to nothing; an
id without a piece decodes to nothing.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventtally.llm import arrays, bpe
from eventtally.llm.tables import stage

RANKS = "byte_bpe_50k.tiktoken"
#: Words of the broadcast dictionary, at most, and the bytes of one.
WORDS, WORD_BYTES = 200_000, 64
#: Words outside the dictionary whose ids a task remembers.
REMEMBER = 50_000
#: Slots of the literal map of ranks.
SLOTS = 1 << 14
SLICE_BYTES = 1 << 20


def rank_map(ranks: dict[bytes, int]) -> Column:
    """All ranks as one literal: an array of small maps, each with the pieces whose checksum falls on its slot.

    A map alone would be searched from its beginning.  Pieces are strings with a
    character for each byte.
    """
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        slots[zlib.crc32(text.encode()) % SLOTS][text] = rank
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def folded(word: Column, ranks: Column) -> Column:
    """The ids of a word (binary), as an array of int."""

    def rank(piece: Column) -> Column:
        return F.element_at(F.element_at(ranks, (F.crc32(piece) % SLOTS + 1).cast("int")), piece)

    def pair_ranks(parts: Column) -> Column:
        return F.transform(
            F.slice(parts, 2, F.size(parts)), lambda second, i: rank(F.concat(F.element_at(parts, i + 1), second))
        )

    def joined(parts: Column, i: Column) -> Column:
        both = F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))
        return F.concat(F.slice(parts, 1, i - 1), F.array(both), F.slice(parts, i + 2, F.size(parts)))

    def step(parts: Column, _: Column) -> Column:
        merged = _let(pair_ranks(parts), lambda found: _let(F.array_min(found), lambda least: F.when(
            least.isNull(), parts
        ).otherwise(_let(F.array_position(found, least).cast("int"), lambda i: joined(parts, i)))))
        return F.when(F.size(parts) < 2, parts).otherwise(merged)

    parts = F.split(F.decode(word, "ISO-8859-1"), "")
    merges = F.sequence(F.lit(2), F.greatest(F.octet_length(word), F.lit(2)))
    return F.aggregate(merges, parts, step, lambda done: F.transform(done, rank))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts of the column `text`, for words of up to WORD_BYTES bytes."""

    def counted(batches):
        for piece in arrays.slices(batches, "text", SLICE_BYTES):
            data, offsets = arrays.text_bytes(piece.column("text"))
            starts = arrays.pretokens(data, offsets)
            if len(starts):
                words = bpe.as_words(data, starts).dictionary_encode()
                counts = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.binary()), pa.array(counts)], names=["word", "n"])

    found = texts.mapInArrow(counted, "word binary, n long").where(F.octet_length("word") <= WORD_BYTES)
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(texts: DataFrame, ranks_path: str, words: int = WORDS) -> dict[bytes, bytes]:
    """The ids of the most frequent words: as many as there are from some count on, up to `words`."""
    counts = stage(count_words(texts).where(F.col("n") > 1), "bpe-words")
    level = F.floor(F.log2("n") * 8)
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()
    kept, least = 0, math.inf
    for row in levels:
        kept += row["words"]
        if kept > words:
            break
        least = row["level"]
    if math.isinf(least):
        return {}
    ranks = rank_map(bpe.read_ranks(ranks_path))
    found = counts.where(level >= least).select("word", folded(F.col("word"), ranks).alias("ids")).toArrow().combine_chunks()
    ids = found.column("ids").combine_chunks()
    raw = ids.flatten().to_numpy().astype("<u4").tobytes()
    at = (4 * (np.asarray(ids.offsets, np.int64) - ids.offsets[0].as_py())).tolist()
    return {word: raw[begin:end] for word, begin, end in zip(found.column("word").to_pylist(), at, at[1:])}


def encode(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", ranks_path: str | None = None, decoded: str | None = None,
) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit numbers) of every text.

    `decoded` names a further column for what the ids decode to: a round trip
    in one pass, where `decode` after `encode` would take two.
    """
    ranks_path = ranks_path or public_tokenizers.path(RANKS)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = rows.sparkSession.sparkContext.broadcast(dictionary(rows.select("text"), ranks_path))

    def encoded(batches):
        encoder = bpe.Encoder(bpe.merges_of_ranks(ranks_path), known.value, REMEMBER)
        for piece in arrays.slices(batches, "text", SLICE_BYTES):
            ids, at = encoder.encode(piece.column("text"))
            columns = {"doc_id": piece.column("doc_id"), "ids": _binary(ids.astype("<u4"), 4 * at)}
            if decoded:
                columns[decoded] = concatenated(ids, at, _pieces(ranks_path))
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(encoded, "doc_id long, ids binary" + (f", `{decoded}` binary" if decoded else ""))


def _binary(data: np.ndarray | pa.Buffer, at: np.ndarray) -> pa.Array:
    """The bytes of `data` between each two places of `at`."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, buffers).cast(pa.binary())


def concatenated(ids: np.ndarray, at: np.ndarray, pieces: pa.Array) -> pa.Array:
    """The pieces of the ids put together, for the ids between each two places of `at`."""
    parts = pieces.take(pa.array(np.minimum(ids, len(pieces) - 1).astype(np.int64)))
    ends = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    return _binary(parts.buffers()[2] or b"", ends[at])


def decode(coded: DataFrame, ids: str = "ids", column: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """`coded` with the bytes that its ids stand for in a further column."""
    ranks_path = ranks_path or public_tokenizers.path(RANKS)

    def decoded(raw: pa.Array) -> pa.Array:
        done = []
        for piece in arrays.slices([pa.RecordBatch.from_arrays([raw], ["ids"])], "ids", SLICE_BYTES):
            data, offsets = arrays.text_bytes(piece.column("ids"))
            done.append(concatenated(np.frombuffer(data.tobytes(), "<u4"), offsets // 4, _pieces(ranks_path)))
        return pa.concat_arrays(done) if done else pa.array([], pa.binary())

    return coded.withColumn(column, F.arrow_udf(decoded, "binary", F.ArrowUDFType.SCALAR)(F.col(ids)))


def _pieces(ranks_path: str) -> pa.Array:
    """The piece of each id, and nothing after the last."""
    if ranks_path not in _read:
        ranks = bpe.read_ranks(ranks_path)
        pieces = [b""] * (max(ranks.values()) + 2)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        _read[ranks_path] = pa.array(pieces, pa.large_binary())
    return _read[ranks_path]


_read: dict[str, pa.Array] = {}
