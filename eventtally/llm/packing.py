"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs `LINEAR * n + QUADRATIC * n * n`: the layers' work a
token, and attention, which reaches over the piece only.  Documents are cut into
full sequences and a rest.  The rests, the longest first, each go to the
sequence that costs least so far among those with room; what has no room there
goes back in line as a shorter rest.  So all sequences of a block but one are full,
and their costs are near each other.

A block is the documents of one slice of a task's rows, so nothing is shuffled
and memory does not grow with the input; sequence ids hold the partition and a
count within it.

Defined results: a null text is an empty one; an empty document is its closing
token alone; a repeated row is a document of its own; null ids stay null.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventtally.llm import arrays, bpe

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE_TOKENS = 1024
#: Closes every document.
CLOSING_TOKEN = 0
#: Cost of a token, and of a pair of tokens: 12 d^2 against 2 d multiplications at a width d of 1024.
LINEAR = 1.0
QUADRATIC = 1 / 6144
#: Bytes of text that are packed together.
BLOCK_BYTES = 4 << 20
#: Sequences that a partition can number.
ROOM = 1 << 40


def assign(lengths: np.ndarray, size: int, cost: Callable[[int], float]) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences count from 0."""
    pieces, rests = [], []
    sequence = 0
    for document, length in enumerate(lengths.tolist()):
        whole = length // size
        for i in range(whole):
            pieces.append((document, i * size, size, sequence, 0))
            sequence += 1
        if length % size:
            rests.append((-(length % size), document, whole * size))
    heapq.heapify(rests)
    opened = -(-sum(-r[0] for r in rests) // size)
    open_sequences = [(0.0, sequence + i, 0) for i in range(opened)]
    while rests:
        negative, document, start = heapq.heappop(rests)
        spent, number, filled = heapq.heappop(open_sequences)
        part = min(-negative, size - filled)
        pieces.append((document, start, part, number, filled))
        if filled + part < size:
            heapq.heappush(open_sequences, (spent + cost(part), number, filled + part))
        if part < -negative:
            heapq.heappush(rests, (negative + part, document, start + part))
    return pieces


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None,
    size: int = SEQUENCE_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def pieces(batches):
        encoder = bpe.Encoder(bpe.merges_of_tokenizer(tokenizer))
        context = TaskContext.get()
        numbered = (context.partitionId() if context else 0) * ROOM
        for block in arrays.slices(batches, "text", BLOCK_BYTES):
            tokens, at = encoder.encode(block.column("text"))
            lengths = np.diff(at) + 1
            found = np.array(
                assign(lengths, size, lambda n: linear * n + quadratic * n * n), np.int64
            ).reshape(-1, 5)
            found = found[np.lexsort((found[:, 1], found[:, 0]))]
            document, start, length, sequence, offset = found.T
            # The pieces in the order of their documents tile all tokens.
            closed = np.insert(tokens, at[1:], CLOSING_TOKEN).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(4 * length)])
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(closed)])
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").take(pa.array(document)), pa.array(start), pa.array(length),
                    ids.cast(pa.binary()), pa.array(lengths[document]), pa.array(numbered + sequence), pa.array(offset),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            numbered += int(sequence.max()) + 1

    return rows.mapInArrow(
        pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
