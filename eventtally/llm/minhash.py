"""Near-duplicate documents by BagMinHash.

A document is the multiset of its runs of five words.  Each run throws points of
a Poisson process over time and weight, the weight axis being cut into the
intervals [0,1), [1,2), [2,4), [4,8) ...; a point lands in one of the signature's
registers and counts if its weight lies below the run's multiplicity.  A
register keeps its earliest point.  Two signatures agree in a register with the
weighted Jaccard similarity as probability (Ertl, "BagMinHash").  Processes are
followed only as long as their next point may still come before a register's.

Signatures are cut into bands, documents that share a band's value meet in a
bucket, and the whole multisets of those that meet are compared, a run standing as a 64-bit hash
of its words (no polynomial, so no words cancel out):

1. Documents with equal multisets are one class of copies, with a number and one
   representative (their smallest id and text hash).
2. In each bucket every representative is compared with the bucket's smallest.
   The links found make components.
3. Buckets that still hold several components are closed: within tasks, and in
   blocks if large, members of different components are compared, and links
   found.  Pairs whose signatures agree too little for the threshold (by five
   standard errors) are passed over.  Pairs of the same component need no
   comparison, so a group of copies of any size emits a row a member, not a pair.

Defined results: words are parted by blanks and the characters 9 to 13 and kept
as they are; a document of fewer than five words is one run; a document
without words (null, empty) is in no group; a null id is in no group either and
kept; rows with the same id are documents of their own if their texts differ (a
64-bit hash beside the id tells), and of a group the one with the smallest hash is
kept; rows with the same id and text are kept or dropped together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventtally.llm import arrays
from eventtally.llm.components import Forest, components
from eventtally.llm.tables import stage

RUN_WORDS = 5
SIMILARITY = 0.8
#: Registers: 40 bands of 5 meet at a similarity of 0.8 with probability 1 - 1e-7.
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: Members of a bucket that are compared within one task; larger ones go in pairs of blocks.
BLOCK = 2_048

_GOLDEN = np.uint64(arrays.BASES[0])


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of words, text by text in order, and where each text's begin (and the end)."""
    data, offsets = arrays.text_bytes(texts)
    starts, ends, at = arrays.words(data, offsets)
    words = arrays.Runs(arrays.word_hashes(data, starts, ends))
    counts = np.diff(at)
    sizes = np.where(counts >= RUN_WORDS, counts - RUN_WORDS + 1, np.minimum(counts, 1))
    first = np.repeat(at[:-1], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = np.minimum(first + RUN_WORDS, np.repeat(at[1:], sizes))
    return words.hashes(first, last), np.concatenate([[0], np.cumsum(sizes)])


def multisets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and multiplicity of the distinct runs, in order of text and hash."""
    hashes, at = runs(texts)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])[: len(hashes)])
    return text[new], hashes[new], np.diff(np.append(new, len(hashes)))


def _step(i: int) -> np.uint64:
    return np.uint64(i * arrays.BASES[0] % (1 << 64))


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, hashes: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """The registers of each text; infinite for a text without runs."""
    registers = np.full(texts * REGISTERS, np.inf)
    # One process for each run and weight interval it reaches into.
    levels = np.where(weight <= 1, 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1)
    run = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(run)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    seed = arrays.mixed(hashes[run] + _GOLDEN * (level + 1).astype(np.uint64))
    own, most = text[run], weight[run].astype(np.float64)
    time, point = np.zeros(len(run)), 0
    while len(run):
        point += 1
        bits = arrays.mixed(seed + _step(2 * point))
        time = time - np.log(_uniform(bits)) / width
        latest = registers.reshape(texts, REGISTERS).max(axis=1)
        go = np.flatnonzero(time < latest[own])
        run, seed, own, most, low, width, time = (x[go] for x in (run, seed, own, most, low, width, time))
        place = arrays.mixed(seed + _step(2 * point + 1))
        register = (place % np.uint64(REGISTERS)).astype(np.int64)
        counts = low + np.floor(_uniform(place) * width) < most
        np.minimum.at(registers, (own * REGISTERS + register)[counts], time[counts])
    return registers.reshape(texts, REGISTERS)


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band."""
    parts = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), BANDS, ROWS)
    value = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        value = arrays.mixed(value ^ parts[:, :, i]) + _GOLDEN
    return value


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted lists of runs, repeats counting."""
    ka, na = np.unique(a, return_counts=True)
    kb, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    shared = int(np.minimum(na[ia], nb[ib]).sum())
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def _signed(docs: DataFrame) -> DataFrame:
    """(id, tid, key, bands) of the documents that have words; key stands for the whole multiset."""

    def sign(batches):
        for piece in arrays.slices(batches, "text"):
            text, hashes, weight = multisets(piece.column("text"))
            has = np.unique(text)
            if not len(has):
                continue
            text = np.searchsorted(has, text)
            value = bands(signatures(text, hashes, weight, len(has)))
            keys = []
            for base in arrays.BASES:
                sums = np.zeros(len(has), np.uint64)
                np.add.at(sums, text, arrays.mixed(hashes ^ np.uint64(base)) * weight.astype(np.uint64))
                keys.append(pa.array(arrays.mixed(sums).view(np.int64)))
            at = pa.array(np.arange(0, len(has) * BANDS + 1, BANDS, dtype=np.int32))
            listed = pa.ListArray.from_arrays(at, pa.array(value.ravel().view(np.int64)))
            own = [piece.column(c).take(pa.array(has)) for c in ("id", "tid")]
            yield pa.RecordBatch.from_arrays([*own, *keys, listed], names=["id", "tid", "key", "key2", "bands"])

    return docs.mapInArrow(sign, "id long, tid long, key long, key2 long, bands array<long>")


def _rows(numbers: np.ndarray, step: int) -> pa.Array:
    """The bytes of each row of `step` bytes."""
    raw = numbers.tobytes()
    return pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())


def _multisets_of(docs: DataFrame) -> DataFrame:
    """(id, runs, registers, bands) of (id, text) rows; sorted runs, 16 bits of each register, whole band values."""

    def listed(batches):
        for piece in arrays.slices(batches, "text"):
            texts = piece.column("text")
            hashes, at = runs(texts)
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            hashes = hashes[np.lexsort((hashes, text))]
            signed = signatures(*multisets(texts), len(texts))
            short = arrays.mixed(np.ascontiguousarray(signed).view(np.uint64).ravel()).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64))),
                    _rows(short, 2 * REGISTERS), _rows(bands(signed), 8 * BANDS),
                ],
                names=["id", "runs", "registers", "bands"],
            )

    return docs.mapInArrow(listed, "id long, runs array<long>, registers binary, bands binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose multisets overlap enough."""
    first = sets.select(F.col("id").alias("a_id"), F.col("runs").alias("a_runs"))
    second = sets.select(F.col("id").alias("b_id"), F.col("runs").alias("b_runs"))
    joined = pairs.join(first, F.col("a") == F.col("a_id")).join(second, F.col("b") == F.col("b_id"))

    def check(batches):
        for batch in batches:
            sides = [(batch.column(c), np.asarray(batch.column(c).offsets)) for c in ("a_runs", "b_runs")]
            (a, a_at), (b, b_at) = [(c.values.to_numpy(zero_copy_only=False), at) for c, at in sides]
            good = [
                i for i in range(batch.num_rows)
                if overlap(a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]) >= similarity
            ]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return joined.select("a", "b", "a_runs", "b_runs").mapInArrow(check, "a long, b long")


class _Members:
    """The multisets of a bucket's members, for comparing one with many."""

    def __init__(self, lists: pa.Array):
        runs = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.sizes = np.diff(np.asarray(lists.offsets))
        member = np.repeat(np.arange(len(self.sizes)), self.sizes)
        new = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (member[1:] != member[:-1])])[: len(runs)])
        self.runs, self.counts = runs[new], np.diff(np.append(new, len(runs)))
        self.at = np.searchsorted(member[new], np.arange(len(self.sizes) + 1))

    def overlaps(self, i: int, others: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of member i with each of the others."""
        own = slice(self.at[i], self.at[i + 1])
        lengths = self.at[others + 1] - self.at[others]
        ends = np.cumsum(lengths)
        which = np.repeat(self.at[others] - (ends - lengths), lengths) + np.arange(ends[-1])
        place = np.minimum(np.searchsorted(self.runs[own], self.runs[which]), own.stop - own.start - 1)
        both = np.where(self.runs[own][place] == self.runs[which], np.minimum(self.counts[own][place], self.counts[which]), 0)
        shared = np.add.reduceat(both, ends - lengths)
        return shared / (self.sizes[i] + self.sizes[others] - shared)


def _closed(group: pa.Table, similarity: float) -> pa.Table:
    """Links between members of different components of one bucket, or of two blocks of it; a forest of them.

    A pair that an earlier band brings together too is left to that band.  Whole
    band values tell, as the buckets do; 16 bits of the registers may agree by chance.
    """
    own = group.column("component").to_numpy()
    ids, block = group.column("id").to_numpy(), group.column("block").to_numpy()
    band = group.column("band")[0].as_py()
    members = _Members(group.column("runs").combine_chunks())
    registers = np.stack([np.frombuffer(r, np.uint16) for r in group.column("registers").to_pylist()])
    values = group.column("bands").to_pylist() if "bands" in group.column_names else None
    values = bands(registers.astype(np.float64)) if values is None else np.stack([np.frombuffer(v, np.uint64) for v in values])
    least = REGISTERS * similarity - 5 * np.sqrt(REGISTERS * similarity * (1 - similarity))
    _, component = np.unique(own, return_inverse=True)
    forest = Forest(len(ids) + int(component.max()) + 1)
    for i, c in enumerate(component.tolist()):
        forest.join(i, len(ids) + c)
    apart = block.min() != block.max()
    found = []
    # The largest component's members are asked about by the others only.
    largest = np.bincount(component).argmax()
    for i in np.flatnonzero(component != largest).tolist():
        others = (component != component[i]) & ((block != block[i]) if apart else True)
        others &= (component == largest) | (np.arange(len(ids)) > i)
        near = np.flatnonzero(others)
        near = near[(registers[near] == registers[i]).sum(axis=1) >= least]
        near = near[(values[near] == values[i]).argmax(axis=1) == band]
        if len(near):
            for j in near[members.overlaps(i, near) >= similarity].tolist():
                if forest.join(i, j):
                    found.append((int(ids[i]), int(ids[j])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _labelled(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their component and the bucket's size."""
    known = groups.select(F.col("node").alias("of"), "component")
    labelled = members.join(known, F.col("id") == F.col("of"), "left").select(
        "bucket", "band", "id", F.coalesce("component", "id").alias("component")
    )
    several = labelled.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")
    ).where(F.col("low") < F.col("high")).select(F.col("bucket").alias("in"), "size")
    return labelled.join(several, F.col("bucket") == F.col("in")).select("bucket", "band", "id", "component", "size")


def _texts(rows: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text) of the classes whose numbers are in `nodes`; the id is the number."""
    wanted = reps.select("node", F.col("rep.id").alias("of"), F.col("rep.tid").alias("of2")).join(
        nodes.select(F.col("id").alias("in")), F.col("node") == F.col("in"), "left_semi"
    )
    found = rows.join(wanted, (F.col("id") == F.col("of")) & (F.col("tid") == F.col("of2")))
    return found.dropDuplicates(["id", "tid"]).select(F.col("node").alias("id"), "text")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
    text_hash: str | None = None,
) -> DataFrame:
    """(id, group_id, kept) of every row: its group's smallest id, and whether the row is the one that stays.

    `text_hash` names a further column: the xxhash64 of the row's text, which tells rows with the same id apart.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("tid", F.xxhash64("text"))
    signed = stage(_signed(rows.where(F.col("id").isNotNull())), "signatures")
    copies = signed.groupBy("key", "key2").agg(F.min(F.struct("id", "tid")).alias("rep"), F.min_by("bands", "id").alias("bands"))
    # Written once, so the numbers hold.
    reps = stage(copies.withColumn("node", F.monotonically_increasing_id()), "representatives")
    buckets = reps.select("node", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "band", F.col("node").alias("id")
    )
    smallest = buckets.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where(
        F.col("least") < F.col("most")
    ).select(F.col("bucket").alias("in"), "least")
    members = stage(
        buckets.join(smallest, F.col("bucket") == F.col("in")).select("bucket", "band", "id", "least"), "buckets"
    )
    sets = stage(_multisets_of(_texts(rows, reps, members.select("id").distinct())), "multisets")
    stars = members.where(F.col("id") != F.col("least")).select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = stage(_verified(stars, sets, similarity), "links")
    groups = stage(components(links), "groups")

    open_members = stage(_labelled(members, groups), "open-buckets")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    parts = open_members.withColumn("block", block).withColumn(
        "other", F.explode(F.when(blocks <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    ).select(
        "bucket", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "component", "block"
    )
    with_sets = parts.join(sets.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).drop("of")
    closing = with_sets.groupBy("bucket", "low", "high").applyInArrow(lambda group: _closed(group, similarity), "a long, b long")
    groups = stage(components(links.unionByName(closing)), "groups")

    joined = reps.select("node", "rep").join(groups.withColumnRenamed("node", "of"), F.col("node") == F.col("of"))
    firsts = joined.groupBy("component").agg(F.min("rep").alias("first")).withColumnRenamed("component", "in")
    firsts = groups.join(firsts, F.col("component") == F.col("in")).select(F.col("node").alias("of"), "first")
    in_group = reps.join(firsts, F.col("node") == F.col("of"), "left").select(
        F.col("key").alias("of"), F.col("key2").alias("of2"), F.coalesce("first", "rep").alias("first")
    )
    found = signed.join(in_group, (F.col("key") == F.col("of")) & (F.col("key2") == F.col("of2"))).select("id", "tid", "first")
    first = found.groupBy("id", "tid").agg(F.min("first").alias("first")).withColumnsRenamed({"id": "of", "tid": "of2"})
    own = rows.select("id", "tid").join(first, (F.col("id") == F.col("of")) & (F.col("tid") == F.col("of2")), "left")
    group_id = F.coalesce("first.id", "id")
    kept = F.coalesce((F.col("first.id") == F.col("id")) & (F.col("first.tid") == F.col("tid")), F.lit(True))
    more = [F.col("tid").alias(text_hash)] if text_hash else []
    return own.select("id", group_id.alias("group_id"), kept.alias("kept"), *more)
