"""Substring dedup by compaction of a de Bruijn graph of words.

The edges of the graph are windows of 50 words.  Windows are kept in paths from
the start: a window's minimizer is the run of ten words in it whose hash is
least, and consecutive windows with the same minimizer make one path (a super
k-mer), a row with its source coordinates instead of a row a window.  Equal
windows have equal minimizers, so only paths with the same minimizer can share any.

1. Minimizers found in one document only are dropped.
2. Equal paths compact: one row a distinct path, with the first document it is in.
3. A minimizer with one distinct path does not branch: the path's first document
   is that of all its windows.  Branching paths are cut open: their windows are
   read again at their source coordinates and checked against the path's digest,
   and those that another path has in an earlier document are noted.
4. Every occurrence of a path in a later document loses all of its words, one in
   the path's first document those that the noted windows cover.

Windows and paths are told apart by 128-bit BLAKE2b digests of their words, at their source coordinates too;
the hash that picks minimizers only decides which paths meet.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, compared as they are; a null text
has none and stays null; a null id counts as larger than any; rows of the same id
never remove from each other; what is between words goes with the word before
it, so a text that loses nothing stays as it is; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventtally.llm import arrays
from eventtally.llm.tables import stage

WINDOW = 50
#: Words of a minimizer.
ANCHOR = 10
_LAST = (1 << 63) - 1
#: Bits of a place among the words of a slice, at least; the rest of a hash decides which is least.
_PLACE_BITS = 24


class Words:
    """The words of a slice of texts, the hashes of their runs, and digests of those that have to be told apart."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = arrays.text_bytes(texts)
        self.starts, self.ends, self.at = arrays.words(self.data, self.offsets)
        self.runs = arrays.Runs(arrays.word_hashes(self.data, self.starts, self.ends))

    def digests(self, first: np.ndarray, count: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of the digests of `count` words from `first` on."""
        both = arrays.digests(self.data, self.starts, self.ends, first, first + count)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])

    def paths(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first window (a word), windows and minimizer (a word) of every path."""
        n = len(self.starts)
        counts = np.maximum(np.diff(self.at) - window + 1, 0)
        if not counts.sum():
            return (np.zeros(0, np.int64),) * 4
        text = np.repeat(np.arange(len(counts)), counts)
        windows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + self.at[:-1][text]
        run = self.runs.hashes(np.arange(n - anchor + 1), np.arange(anchor, n + 1))
        place = np.uint64((1 << max(_PLACE_BITS, n.bit_length())) - 1)
        least = (run & ~place) | np.arange(len(run), dtype=np.uint64)
        span, width = window - anchor + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        rest = span - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        chosen = (least[windows] & place).astype(np.int64)
        new = np.ones(len(windows), bool)
        new[1:] = (text[1:] != text[:-1]) | (chosen[1:] != chosen[:-1])
        begins = np.flatnonzero(new)
        return text[begins], windows[begins], np.diff(np.append(begins, len(windows))), chosen[begins]


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc, tid, text): the id that counts and a hash that tells rows of the same id apart."""
    return docs.select(*_keys(id_column, text), F.col(text).cast("string").alias("text"))


def _keys(id_column: str, text: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.col(text)).alias("tid")


def _paths(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(minimizer, path, path2, doc, tid, start, windows): a row a path; start counts the document's words."""

    def cut(batches):
        for piece in arrays.slices(batches, "text"):
            words = Words(piece.column("text"))
            text, first, count, chosen = words.paths(window, anchor)
            path, path2 = words.digests(first, count + window - 1)
            minimizer = words.runs.hashes(chosen, chosen + anchor).view(np.int64)
            columns = [
                pa.array(minimizer), pa.array(path), pa.array(path2), piece.column("doc").take(pa.array(text)),
                piece.column("tid").take(pa.array(text)), pa.array((first - words.at[text]).astype(np.int32)),
                pa.array(count.astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["minimizer", "path", "path2", "doc", "tid", "start", "windows"])

    return rows.mapInArrow(cut, "minimizer long, path long, path2 long, doc long, tid long, start int, windows int")


def _opened(paths: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """(path, path2, at, doc, window, window2): the windows of paths, read at their source coordinates."""
    asked = paths.groupBy("doc", "tid").agg(F.collect_list(F.struct("start", "windows", "path", "path2")).alias("asked"))
    texts = rows.dropDuplicates(["doc", "tid"]).select(F.col("doc").alias("of"), F.col("tid").alias("of2"), "text")
    joined = asked.join(texts, (F.col("doc") == F.col("of")) & (F.col("tid") == F.col("of2"))).select("doc", "text", "asked")

    def read(batches):
        for piece in arrays.slices(batches, "text"):
            words = Words(piece.column("text"))
            asked = piece.column("asked")
            fields = asked.flatten()
            row = np.repeat(np.arange(piece.num_rows), np.diff(np.asarray(asked.offsets)))
            start, count, path, path2 = (fields.field(i).to_numpy() for i in range(4))
            first = words.at[row] + start
            # The path found there must be the one asked for.
            there = words.digests(first, count + window - 1)
            if not (np.array_equal(there[0], path) and np.array_equal(there[1], path2)):
                raise ValueError("a path is not at its source coordinates")
            of = np.repeat(np.arange(len(row)), count)
            at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            one, two = words.digests(first[of] + at, window)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(path[of]), pa.array(path2[of]), pa.array(at.astype(np.int32)),
                    piece.column("doc").take(pa.array(row[of])), pa.array(one), pa.array(two),
                ],
                names=["path", "path2", "at", "doc", "window", "window2"],
            )

    return joined.mapInArrow(read, "path long, path2 long, at int, doc long, window long, window2 long")


def repeated(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, tid, spans): for documents of `rows` (doc, tid, text) the (start, length) in words of what earlier ones have.

    Spans may touch and overlap.
    """
    paths = _paths(rows, window, anchor)
    shared = stage(
        paths.groupBy("minimizer").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        .where(F.col("low") < F.col("high")).select(F.col("minimizer").alias("of")),
        "minimizers",
    )
    found = stage(paths.join(shared, F.col("minimizer") == F.col("of"), "left_semi"), "paths")
    compact = found.groupBy("path", "path2", "minimizer").agg(
        F.min(F.struct("doc", "tid", "start")).alias("source"), F.first("windows").alias("windows")
    )
    compact = stage(compact.select("minimizer", "path", "path2", "windows", "source.*"), "compact-paths")
    branching = compact.groupBy("minimizer").agg(F.count(F.lit(1)).alias("paths")).where(F.col("paths") > 1)
    marked = compact.join(branching.select(F.col("minimizer").alias("of")), F.col("minimizer") == F.col("of"), "left_semi")
    # A window's first document is its path's, unless another path with the window has an earlier one.
    opened = stage(_opened(marked, rows, window), "windows")
    several = opened.groupBy("window", "window2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(
        F.col("first") < F.col("last")
    ).select(F.col("window").alias("of"), F.col("window2").alias("of2"), "first")
    again = opened.join(several, (F.col("window") == F.col("of")) & (F.col("window2") == F.col("of2"))).where(F.col("first") < F.col("doc"))
    earlier = again.groupBy("path", "path2").agg(F.collect_list("at").alias("earlier"))
    firsts = compact.join(earlier, ["path", "path2"], "left").select(
        F.col("path").alias("of"), F.col("path2").alias("of2"), F.col("doc").alias("first"), "earlier"
    )
    told = found.join(stage(firsts, "firsts"), (F.col("path") == F.col("of")) & (F.col("path2") == F.col("of2")))
    # Documents after the path's first lose all of it, the first itself what others had before.
    whole = F.array(F.struct(F.col("start").alias("start"), (F.col("windows") + (window - 1)).alias("length")))
    each = F.transform("earlier", lambda at: F.struct((F.col("start") + at).alias("start"), F.lit(window).alias("length")))
    spans = told.select("doc", "tid", F.when(F.col("first") < F.col("doc"), whole).otherwise(each).alias("spans"))
    return spans.where(F.size("spans") > 0).groupBy("doc", "tid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _kept(texts: pa.Array, spans: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts without the words of their spans; words before, words removed."""
    data, offsets = arrays.text_bytes(texts)
    starts, _, at = arrays.words(data, offsets)
    lists = spans.flatten()
    row = np.repeat(np.arange(len(texts)), np.diff(np.asarray(spans.offsets)))
    first = at[row] + lists.field(0).to_numpy()
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + lists.field(1).to_numpy(), -1)
    gone = np.cumsum(change)[:-1] > 0
    # From a removed word to the next word, or to the end of its text.
    of = np.searchsorted(at, np.arange(len(starts)), "right") - 1
    until = np.minimum(np.append(starts[1:], len(data)), offsets[of + 1])
    cut = np.zeros(len(data) + 1, np.int64)
    np.add.at(cut, starts[gone], 1)
    np.add.at(cut, until[gone], -1)
    stays = np.cumsum(cut)[:-1] == 0
    sizes = np.concatenate([[0], np.cumsum(stays)])[offsets]
    kept = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(sizes)), pa.py_buffer(data[stays]))
    removed = np.bincount(of[gone], minlength=len(texts))
    return kept, np.diff(at), removed


def drop_repeated(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW,
    counts: tuple[str, str] = ("n_words", "n_removed"),
) -> DataFrame:
    """`docs` without the repeated words, and with two further columns: words before, words removed."""
    found = repeated(_keyed(docs, id_column, text), window)
    marks = found.select(F.col("doc").alias("__doc"), F.col("tid").alias("__tid"), F.col("spans").alias("__spans"))
    rows = docs.drop(*counts)
    doc, tid = _keys(id_column, text)
    joined = rows.join(marks, (doc == F.col("__doc")) & (tid == F.col("__tid")), "left")

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        done = []
        for piece in arrays.slices([pa.RecordBatch.from_arrays([texts, spans], ["text", "spans"])], "text"):
            kept, before, removed = _kept(piece.column("text"), piece.column("spans"))
            done.append(pa.StructArray.from_arrays(
                [kept.cast(pa.string()), pa.array(before), pa.array(removed)], ["text", "words", "removed"]
            ))
        kind = pa.struct([("text", pa.string()), ("words", pa.int64()), ("removed", pa.int64())])
        return pa.concat_arrays(done) if done else pa.array([], kind)

    spans = F.coalesce("__spans", F.expr("cast(array() as array<struct<start:int,length:int>>)"))
    # Called non-deterministic, so that a filter on its counts does not run it once more.
    kind = "struct<text:string,words:long,removed:long>"
    result = F.arrow_udf(cut, kind, F.ArrowUDFType.SCALAR).asNondeterministic()(F.col(text).cast("string"), spans)
    joined = joined.withColumn("__result", result)
    return joined.select(
        *[F.when(F.col(c).isNotNull(), F.col("__result.text")).alias(c) if c == text else F.col(f"`{c}`") for c in rows.columns],
        F.col("__result.words").alias(counts[0]), F.col("__result.removed").alias(counts[1]),
    )
