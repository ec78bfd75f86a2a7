"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  An
n-gram binds its letters: the vector of the first rotated twice, of the second
once, of the third not at all, multiplied component by component.  A document
bundles (adds up) its n-grams, a language the documents it is learned from, each
at unit length.  A document gets the language with the largest cosine.

Since bundling is a sum, a document's vector is its row of n-gram counts times
the vectors of the n-grams, which one matrix product a slice of rows gives.

Defined results: text is lowered, and everything that is not a letter counts as
one blank; a text that is null or has no letter gets `und` with score 0, as does
every text if nothing was learned; rows with a null language are not learned
from; ties go to the language that sorts first; a negative cosine scores 0.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventtally.llm import arrays

#: Components of a vector.
WIDTH = 1024
#: Distinct texts of a language, about, that its prototype is learned from (a hash of the text picks them).
FIT_ROWS = 2_000
#: Bytes of text whose documents are compared at once.
SLICE_BYTES = 128 << 10
UNKNOWN = "und"


@functools.cache
def _letter(point: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=point)).integers(0, 2, WIDTH, np.int8)
    return 2 * bits - 1


class _Bound:
    """The bound vectors of the n-grams met last, a row each; a full table starts anew."""

    def __init__(self, room: int = 1 << 14):
        self.room = room
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((1 << 10, WIDTH), np.int8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(codes) > self.room:
            self.rows.clear()
        at = [self.rows.get(code, -1) for code in codes.tolist()]
        for i in [i for i, row in enumerate(at) if row < 0]:
            code, at[i] = int(codes[i]), len(self.rows)
            if at[i] == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            first, second, third = (_letter(code >> shift & 0x1FFFFF) for shift in (42, 21, 0))
            self.vectors[at[i]] = np.roll(first, 2) * np.roll(second, 1) * third
            self.rows[code] = at[i]
        return self.vectors[at].astype(np.float32)


_bound = _Bound()


def _letters(text: str) -> np.ndarray:
    """Code points of the letters, with one blank before, after and for all between them; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(arrays.classes()[points] == arrays.LETTER, points, 0x20)
    points = np.concatenate([[0x20], points, [0x20]]).astype(np.int64)
    blank = points == 0x20
    points = points[~(blank & np.concatenate([[False], blank[:-1]]))]
    return points if len(points) > 1 else points[:0]


def document_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of unit length for each text with a letter, zeros for the others; how many distinct n-grams each has."""
    letters = [_letters(t) if t else np.zeros(0, np.int64) for t in texts]
    has = np.array([len(x) > 0 for x in letters], bool)
    codes = [x[:-2] << 42 | x[1:-1] << 21 | x[2:] for x in letters if len(x)]
    vectors, distinct = np.zeros((len(texts), WIDTH), np.float32), np.zeros(len(texts), np.int64)
    if codes:
        grams, place = np.unique(np.concatenate(codes), return_inverse=True)
        row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        counts = np.bincount(row * len(grams) + place, minlength=len(codes) * len(grams)).reshape(len(codes), len(grams))
        sums = np.zeros((len(codes), WIDTH), np.float32)
        for at in range(0, len(grams), 8_192):
            sums += counts[:, at : at + 8_192].astype(np.float32) @ _bound.of(grams[at : at + 8_192])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        vectors[has] = sums / np.where(length > 0, length, 1)
        distinct[has] = (counts > 0).sum(axis=1)
    return vectors, distinct


def _picked(rows: DataFrame, fit_rows: int) -> DataFrame | None:
    """Of the distinct (text, lang) rows about `fit_rows` a language, all if it has no more; None without a row.

    The rate is one of distinct texts, as copies share a hash and are picked or left together.
    """
    distinct = rows.select("lang", F.xxhash64("text").alias("hash")).distinct()
    counts = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return None
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, fit_rows / r["n"]))])
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(part < F.element_at(rates, F.col("lang"))).distinct()


def learn(docs: DataFrame, text: str = "text", language: str = "lang", fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """The languages in order and a prototype of unit length for each.

    Only counts and bundled vectors come to the driver: WIDTH numbers a language.
    Of equal texts one is learned from.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(language).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = _picked(rows, fit_rows)
    if picked is None:
        return [], np.zeros((0, WIDTH), np.float32)

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for piece in arrays.slices(batches, "text", SLICE_BYTES):
            vectors, _ = document_vectors(piece.column("text").to_pylist())
            names = np.array(piece.column("lang").to_pylist(), object)
            for name in set(names):
                sums[name] = sums.get(name, 0) + vectors[names == name].sum(axis=0, dtype=np.float64)
        for name, row in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * WIDTH), pa.array(np.arange(WIDTH, dtype=np.int32)), pa.array(np.round(row * 1e6).astype(np.int64))],
                names=["lang", "at", "value"],
            )

    bundled = (
        picked.mapInArrow(bundle, "lang string, at int, value long")
        .groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()
    )
    names = sorted({r["lang"] for r in bundled})
    place = {name: i for i, name in enumerate(names)}
    prototypes = np.zeros((len(names), WIDTH), np.float64)
    for r in bundled:
        prototypes[place[r["lang"]], r["at"]] = r["value"]
    length = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return names, (prototypes / np.where(length > 0, length, 1)).astype(np.float32)


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text",
    columns: tuple[str, ...] = ("lang_pred", "score"),
) -> DataFrame:
    """`docs` with the language and the cosine (0 to 1) of every text in two further columns, and the
    number of its distinct n-grams in a third if that has a name."""
    names, prototypes = model

    def predict(column: pa.Array) -> pa.Array:
        languages, scores, grams = [], [np.zeros(0)], [np.zeros(0, np.int64)]
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        for piece in arrays.slices([batch], "text", SLICE_BYTES):
            vectors, distinct = document_vectors(piece.column("text").to_pylist())
            cosines = vectors @ prototypes.T if names else np.zeros((len(distinct), 1), np.float32)
            known = (distinct > 0) & bool(names)
            best = cosines.argmax(axis=1).tolist()
            languages += [names[b] if k else UNKNOWN for b, k in zip(best, known.tolist(), strict=True)]
            scores.append(np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0).astype(np.float64))
            grams.append(distinct)
        return pa.StructArray.from_arrays(
            [pa.array(languages, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(grams))], ["lang", "score", "grams"]
        )

    found = F.arrow_udf(predict, "struct<lang:string,score:double,grams:long>", F.ArrowUDFType.SCALAR).asNondeterministic()  # a later filter must not run it once more
    rows = docs.drop(*columns)
    return rows.withColumn("__found", found(F.col(text).cast("string"))).select(
        *[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"__found.{f}").alias(c) for c, f in zip(columns, ("lang", "score", "grams"))]
    )


def held_out(id_column: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves `part`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % parts == part, F.lit(False))
