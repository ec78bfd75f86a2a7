"""Ranked lexical search, term at a time over short lists and document at a time over long ones.

`build` writes an inverted index: documents are cut into blocks of some megabytes of text,
and each block has one row a term (the places of its documents, ascending, and how often
the term occurs) and one row of its documents (ids, lengths).

`search` keeps the lists of the terms that are asked for, sums document frequencies over
blocks, and lets every block meet every group of items.  For one item and one block:

1. The shortest lists, of at most SHORT_PART of the block's documents each, are scattered
   into accumulators, term at a time.  The touched accumulators then are one iterator
   with the largest of them as bound; the k-th largest is a first threshold.
2. That iterator and the long lists are walked document at a time.  Iterators whose bounds
   together stay below the threshold only answer look-ups; the others propose the next
   documents, a window of them at a time.  A window's documents look their scores up from
   the iterator with the largest bound down and are left as soon as what is missing cannot
   lift them to the threshold, which the best ones of each window raise.

All documents that might equal the threshold are scored in full, so the result is exact;
one window merges the blocks.

Scores are integers: a term weighs floor(1000 * ln((2N + 2) / (2 df + 1))), m is
10 + (90 n N) div L, and an occurrence count tf adds weight * ((10^9 tf) div (1000 tf + 8 m)).

Defined results: terms are runs of letters and digits of ASCII and of all characters beyond
it, with A-Z lower-cased; null and empty texts have none, and their rows do not count in N; rows
with the same id are documents of their own; documents with a null id take part and come last
among equals; every row of the items is answered, under a null id too, and one without a known
term has no result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventtally.llm import arrays
from eventtally.llm.tables import stage

#: A term, as the items' side of the search finds it; `_terms` does the same on bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text in a block, and items that are asked of it in one task.
BLOCK_BYTES = 16 << 20
ITEMS_A_GROUP = 2_048
#: A list is short if it has at most this part of its block's documents.
SHORT_PART = 1 / 16
#: Documents of a window that one iterator may propose.
WINDOW_DOCS = 1_024

_INDEX = "block long, term string, n_docs long, n_terms long, places binary, counts binary, ids binary, unknown binary"
_LAST = np.iinfo(np.int64).max


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms, in order, and how many each text has before it (and all)."""
    data, offsets = arrays.text_bytes(texts)
    upper = (data >= 0x41) & (data <= 0x5A)
    inside = (data >= 0x80) | upper | ((data >= 0x61) & (data <= 0x7A)) | ((data >= 0x30) & (data <= 0x39))
    starts, ends, at = arrays.spans(data, offsets, inside)
    kept = (data + (upper * np.uint8(32)))[inside]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kept)))
    return terms, at


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Pieces of the batches, together of about `limit` bytes of text."""
    held, size = [], 0
    for piece in arrays.slices(batches, "text", limit // 8):
        held.append(piece)
        size += int(pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(pieces: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms; of every (term, row) that occurs, sorted, the term, the row and the count; terms of each row."""
    chunks, rows, first = [], [], 0
    for piece in pieces:
        terms, at = _terms(piece.column("text"))
        chunks.append(terms)
        rows.append(np.repeat(np.arange(first, first + piece.num_rows), np.diff(at)))
        first += piece.num_rows
    coded = pa.concat_arrays(chunks).dictionary_encode()
    row = np.concatenate(rows)
    pairs, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * first + row, return_counts=True)
    return coded.dictionary, pairs // max(first, 1), pairs % max(first, 1), counts, np.bincount(row, minlength=first)


def _smallest(numbers: np.ndarray) -> bytes:
    """Their bytes as unsigned integers of the width that the largest needs, which comes first."""
    width = next(w for w in (1, 2, 4, 8) if int(numbers.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def build(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The inverted index, written once; a row a block and term, and one a block (with a null term)."""

    def invert(batches):
        task = TaskContext.get().partitionId()
        for number, pieces in enumerate(_blocks(batches, block_bytes)):
            block = task << 32 | number
            terms, term, row, counts, lengths = _counted(pieces)
            ids = pa.chunked_array([piece.column("id") for piece in pieces])
            unknown = ids.is_null().to_numpy()
            ids = pc.fill_null(ids, _LAST).to_numpy()
            has = np.flatnonzero(lengths)
            # Places follow ids, those without one last.
            has = has[np.lexsort((unknown[has], ids[has]))]
            if not len(has):
                continue
            place = np.zeros(len(lengths), np.int64)
            place[has] = np.arange(len(has))
            order = np.lexsort((place[row], term))
            at = place[row][order]
            begins = np.searchsorted(term, np.arange(len(terms) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([None], pa.string()), pa.array([len(has)]), pa.array([int(lengths.sum())]),
                 pa.array([None], pa.binary()), pa.array([_smallest(lengths[has])], pa.binary()),
                 pa.array([ids[has].tobytes()], pa.binary()), pa.array([unknown[has].tobytes()], pa.binary())],
                names=["block", "term", "n_docs", "n_terms", "places", "counts", "ids", "unknown"],
            )
            counts = counts[order]
            for low in range(0, len(terms), 8_192):
                high = min(low + 8_192, len(terms))
                cuts = list(itertools.pairwise(begins[low : high + 1].tolist()))
                none = pa.nulls(high - low, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(high - low, block)), terms.slice(low, high - low).cast(pa.string()),
                     pa.array(np.diff(begins[low : high + 1])), pa.array([int(counts[a:b].sum()) for a, b in cuts], pa.int64()),
                     pa.array([_smallest(at[a:b]) for a, b in cuts], pa.binary()),
                     pa.array([_smallest(counts[a:b]) for a, b in cuts], pa.binary()), none, none],
                    names=["block", "term", "n_docs", "n_terms", "places", "counts", "ids", "unknown"],
                )

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return stage(rows.mapInArrow(invert, _INDEX), "inverted-index")


class Postings:
    """The lists of a block that any of its items asks for, with what each posting adds to a score."""

    def __init__(self, lists: pa.Table, documents: dict, n_all: int, l_all: int):
        lengths = _numbers(documents["counts"])
        self.ids = np.frombuffer(documents["ids"], np.int64)
        self.unknown = np.frombuffer(documents["unknown"], bool)
        wide = np.int64 if 90 * int(lengths.max()) * n_all < 1 << 63 else object
        m = (10 + (90 * lengths.astype(wide) * n_all) // l_all).astype(np.int64)
        self.places, self.adds, self.most = {}, {}, {}
        for term, weight, places, counts in zip(*(lists.column(c).to_pylist() for c in ("tid", "weight", "places", "counts")), strict=True):
            at, tf = _numbers(places), _numbers(counts)
            self.places[term] = at
            self.adds[term] = weight * ((1_000_000_000 * tf) // (1_000 * tf + 8 * m[at]))
            self.most[term] = int(self.adds[term].max())

    def best(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents of the block, as far as their scores are above 0."""
        known = sorted((t for t in terms if t in self.places and self.most[t] > 0), key=lambda t: len(self.places[t]))
        short = [t for t in known if len(self.places[t]) <= len(self.ids) * SHORT_PART]
        iterators = [(self.places[t], self.adds[t], self.most[t]) for t in known[len(short):]]
        threshold = 1
        if short:
            sums = np.zeros(len(self.ids), np.int64)
            for t in short:
                sums[self.places[t]] += self.adds[t]
            touched = np.flatnonzero(sums)
            sums = sums[touched]
            iterators.append((touched, sums, int(sums.max())))
            threshold = max(threshold, _kth(sums, k))
        return _walk(iterators, threshold, len(self.ids), k)


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _walk(iterators: list[tuple[np.ndarray, np.ndarray, int]], threshold: int, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document at a time over (places, adds, bound) iterators; all that may reach the threshold are scored in full."""
    iterators = sorted(iterators, key=lambda it: it[2], reverse=True)
    # What the iterators from the i-th on may add together.
    rest = np.cumsum([0] + [bound for _, _, bound in iterators[::-1]])[::-1]
    found, scored = [], []
    pool = np.zeros(0, np.int64)
    at = -1
    while True:
        proposing = int((rest[: len(iterators)] >= threshold).sum())
        parts = []
        for places, _, _ in iterators[:proposing]:
            low = np.searchsorted(places, at, "right")
            parts.append(places[low : low + WINDOW_DOCS])
        upto = min((part[-1] for part in parts if len(part) == WINDOW_DOCS), default=n)
        docs = np.unique(np.concatenate([np.zeros(0, np.int64), *[part[part <= upto] for part in parts]]))
        if not len(docs):
            break
        at = int(docs[-1]) if upto == n else int(upto)
        scores = np.zeros(len(docs), np.int64)
        for i, (places, adds, _) in enumerate(iterators):
            where = np.searchsorted(places, docs)
            where[where == len(places)] = 0
            scores += np.where(places[where] == docs, adds[where], 0)
            stay = scores + rest[i + 1] >= threshold
            if not stay.all():
                docs, scores = docs[stay], scores[stay]
        if len(docs):
            found.append(docs)
            scored.append(scores)
            pool = np.concatenate([pool, scores])
            if len(pool) > k:
                pool = np.partition(pool, len(pool) - k)[len(pool) - k :]
            threshold = max(threshold, _kth(pool, k))
    if not found:
        return pool, pool
    docs, scores = np.concatenate(found), np.concatenate(scored)
    order = np.lexsort((docs, -scores))[:k]
    return docs[order], scores[order]


def _answers(lists: pa.Table, items: pa.Table, n_all: int, l_all: int, k: int) -> Iterator[pa.Table]:
    """The best documents that some blocks have for a group of items."""
    row, terms = items.column("row").to_pylist(), items.column("tids").to_pylist()
    blocks = lists.column("block")
    for block in pc.unique(blocks).to_pylist():
        own = lists.filter(pc.equal(blocks, block))
        is_list = pc.is_valid(own.column("tid"))
        documents = own.filter(pc.invert(is_list)).to_pylist()
        postings = Postings(own.filter(is_list), documents[0], n_all, l_all)
        best = [postings.best(asked, k) for asked in terms]
        at = np.concatenate([np.zeros(0, np.int64), *[places for places, _ in best]])
        yield pa.table({
            "row": pa.array(np.repeat(np.array(row, np.int64), [len(places) for places, _ in best])),
            "doc_id": pa.array(postings.ids[at], mask=postings.unknown[at]),
            "score": pa.array(np.concatenate([np.zeros(0, np.int64), *[scores for _, scores in best]])),
        })


def search(index: DataFrame, items: DataFrame, id_column: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of the index for every row of `items`."""
    folded = F.translate(F.col(f"`{text}`").cast("string"), _UPPER, _LOWER)
    asked = items.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").alias("item_id"),
        F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("terms"),
    )
    # Written once, so the numbers of rows and terms hold.
    asked = stage(asked, "items")
    each = asked.select("row", F.explode("terms").alias("term"))
    documents = index.where(F.col("term").isNull())
    sums = documents.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l"), F.count(F.lit(1)).alias("blocks")).first()
    n_all, l_all = sums["n"] or 0, sums["l"] or 0

    known = index.join(each.select(F.col("term").alias("asked")).distinct(), F.col("term") == F.col("asked"), "left_semi")
    weight = F.floor(1000 * F.log((2.0 * F.lit(n_all) + 2) / (2.0 * F.sum("n_docs") + 1))).cast("long")
    weights = known.groupBy("term").agg(weight.alias("weight"))
    weights = stage(weights.select(F.col("term").alias("of"), F.monotonically_increasing_id().alias("tid"), "weight"), "weights")
    lists = index.join(weights, F.col("term") == F.col("of")).select("block", "tid", "weight", "places", "counts", "ids", "unknown")
    none = F.lit(None).cast("long")
    lists = lists.unionByName(documents.select("block", none.alias("tid"), none.alias("weight"), "places", "counts", "ids", "unknown"))

    # Blocks are dealt to shards, items to groups; every shard meets every group.
    shards = max(sums["blocks"], 1)
    groups = -(-max(asked.count(), 1) // ITEMS_A_GROUP)
    blocks = lists.withColumns({
        "shard": F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"),
        "part": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))),
    })
    numbered = each.join(weights, F.col("term") == F.col("of")).groupBy("row").agg(F.collect_list("tid").alias("tids"))
    dealt = numbered.withColumns({
        "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "part": F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"),
    })
    kind = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def answer(lists: pa.Table, items: pa.Table) -> pa.Table:
        if not lists.num_rows or not items.num_rows:
            return kind.empty_table()
        return pa.concat_tables([kind.empty_table(), *_answers(lists, items, n_all, l_all, k)])

    found = blocks.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(answer, "row long, doc_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = asked.select(F.col("row").alias("of"), "item_id")
    return ranked.join(named, F.col("row") == F.col("of")).select("item_id", "rank", "doc_id", "score")
