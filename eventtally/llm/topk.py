"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are cut into blocks.  A block inverts its rows into one posting list
for each dimension (the rows with a weight there, and the weights); the queries'
sparse rows then go through the lists dimension by dimension and scatter weight
times weight into a dense array of scores, a row a query.  A partition selection
keeps each query's best of the block; one window merges the blocks.

Defined results: vectors that are null, or hold null or non-finite components,
take no part, neither do rows with a null id; ids that repeat are separate
candidates, but none is a candidate of a query with the same id.  Vectors of
another length than a query's share the dimensions both have.  Ties go to the
smaller id.  Scores beyond a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates, and queries that are scored against it at once.
BLOCK_ROWS = 4_096
QUERY_ROWS = 256
#: Groups that the queries are dealt to: each group meets every block once.
QUERIES_A_GROUP = 4_096

SCALE = 64


def weights(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(id, weights): floor(scale * x) of each component, of the rows that take part."""
    vector = F.col(vector_column).cast("array<double>")
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return vectors.where(vector.isNotNull() & F.col(id_column).isNotNull() & whole).select(
        F.col(id_column).cast("long").alias("id"), scaled.alias("weights")
    )


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and weight of the components that are not zero."""
    offsets = np.asarray(column.offsets, np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    dimension = np.arange(len(values)) - offsets[row]
    used = np.flatnonzero(values)
    return row[used], dimension[used], values[used].astype(np.int64)


def _by_dimension(row: np.ndarray, dimension: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(dimension, kind="stable")
    cuts = np.flatnonzero(np.diff(dimension[order])) + 1
    return {int(dimension[part[0]]): (row[part], weight[part]) for part in np.split(order, cuts) if len(part)}


def _accumulate(queries: dict, n_queries: int, postings: dict, n_rows: int) -> np.ndarray:
    """The dense scores, a row a candidate and a column a query, term at a time."""
    terms = queries.keys() & postings.keys()
    largest = [(int(abs(queries[t][1].astype(object)).max()), int(abs(postings[t][1].astype(object)).max())) for t in terms]
    exact = np.int64 if sum(a * b for a, b in largest) < 1 << 63 else object
    scores = np.zeros((n_rows, n_queries), exact)
    for term in terms:
        (asked, asked_weight), (found, weight) = queries[term], postings[term]
        row = np.zeros(n_queries, exact)
        row[asked] = asked_weight
        scores[found] += weight.astype(exact)[:, None] * row
    if exact is object:
        scores = np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64)
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Rows of the k best scores, the smaller id first among equals; never the query's own."""
    allowed = np.flatnonzero(ids != own)
    if len(allowed) > k:
        cut = np.partition(scores[allowed], len(allowed) - k)[len(allowed) - k]
        allowed = allowed[scores[allowed] >= cut]
    return allowed[np.lexsort((ids[allowed], ~scores[allowed]))][:k]


def _block_scores(block: pa.Table, k: int) -> Iterator[pa.Table]:
    """One block's candidates and one group's queries: each query's best of the block."""
    is_query = block.column("is_query").combine_chunks()
    parts = [block.filter(pc.equal(is_query, flag)).combine_chunks() for flag in (False, True)]
    if not parts[0].num_rows or not parts[1].num_rows:
        return
    ids = parts[0].column("id").to_numpy()
    lists = parts[0].column("weights").chunk(0)
    postings = _by_dimension(*_rows(lists))
    for at in range(0, parts[1].num_rows, QUERY_ROWS):
        some = parts[1].slice(at, QUERY_ROWS).combine_chunks()
        asking = some.column("id").to_numpy()
        scores = _accumulate(_by_dimension(*_rows(some.column("weights").chunk(0))), len(asking), postings, len(ids))
        scores = np.ascontiguousarray(scores.T)
        best = [_best(scores[i], ids, own, k) for i, own in enumerate(asking)]
        sizes = [len(b) for b in best]
        yield pa.table({
            "query_id": np.repeat(asking, sizes),
            "vec_id": np.concatenate([ids[b] for b in best]).astype(np.int64),
            "score": np.concatenate([scores[i][b] for i, b in enumerate(best)]).astype(np.int64),
        })


def _sizes(vectors: DataFrame) -> tuple[int, int]:
    """How many there are, and the largest weight, signs aside."""
    # The least long has no positive counterpart; -(x + 1) has the same width as x.
    most = F.array_max(F.transform("weights", lambda x: F.when(x < 0, -(x + 1)).otherwise(x)))
    row = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(most).alias("most")).first()
    return row["n"], row["most"] or 0


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, both given by `weights`.

    Every block of candidates meets every group of queries, which is the
    exhaustive search; rows go out once a group or block of the other side.
    """
    (n_candidates, most), (n_queries, other) = _sizes(candidates), _sizes(queries)
    blocks = -(-max(n_candidates, 1) // BLOCK_ROWS)
    groups = -(-max(n_queries, 1) // QUERIES_A_GROUP)
    # What travels are the smallest integers that hold all weights.
    kind = next((name for name, size in (("tinyint", 7), ("smallint", 15), ("int", 31)) if max(most, other) < 1 << size), "bigint")
    candidates, queries = (df.withColumn("weights", F.col("weights").cast(f"array<{kind}>")) for df in (candidates, queries))
    rows = candidates.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "id", "weights", F.lit(False).alias("is_query"),
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("part"), "id", "weights", F.lit(True).alias("is_query"),
    )

    def score(group: pa.Table) -> pa.Table:
        found = list(_block_scores(group, k))
        return pa.concat_tables(found) if found else pa.schema(
            [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
        ).empty_table()

    found = (
        rows.unionByName(asked).groupBy("block", "part")
        .applyInArrow(score, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
