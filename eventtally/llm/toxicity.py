"""Toxicity by multiple-instance learning.

A document is a bag of sentences and its label says only whether any of them is
toxic.  A sentence scores sigmoid(bias + sum of its words' weights); the document
is toxic unless no sentence is (noisy-or): 1 - prod(1 - p).  The weights are
learned through the noisy-or from the documents' labels, so they find the
sentences that explain them; `score` names those.

A word counts with its whole and with its beginnings, since a stem may take many
endings.  The weights are fitted on a bounded sample of labelled documents on
the driver, over features that Spark selects from that sample; everything else
runs over all rows.

Defined results: a text that is null or has no word scores 0; without a labelled
document of each kind every text does; a document labelled more than once counts
with its largest label, null labels not at all; of equal texts one counts, with the largest label
of any; rows repeat as they are.  Sentences end at ASCII's stops and line ends only, and only A-Z are lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventtally.llm import arrays
from eventtally.llm.tables import stage

#: Labelled texts that the model is fitted on, at most, half of them for each label; a hash of the text picks them.
FIT_ROWS = 4_000
#: Longer texts, in characters, are not fitted on, so what the driver takes is bounded.
FIT_CHARS = 50_000
#: Features of the model, at most: those whose share of toxic documents stands out most.
FEATURES = 4_096
#: A feature is in so many sampled documents at least, and its share stands out by so many standard errors.
LEAST_DOCS, LEAST_Z = 5, 4.0
#: Bytes of a word's beginnings.
STEMS = (4, 5, 6)
#: Descent: steps, their size, and the pull of weights to zero.
STEPS, RATE, PULL = 200, 0.1, 1e-3
#: A sentence is named as offending from this score on.
OFFENDING = 0.5

#: The bytes that end a sentence.
SENTENCE_ENDS = list(b".!?\n")


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


class Bags:
    """The words of a slice of texts: their features, sentences and documents."""

    def __init__(self, texts: pa.Array):
        data, self.offsets = arrays.text_bytes(texts)
        self.data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
        inside = ((self.data >= 0x61) & (self.data <= 0x7A)) | ((data >= 0x30) & (data <= 0x39)) | (data >= 0x80)
        self.starts, self.ends, self.at = arrays.spans(self.data, self.offsets, inside)
        self.breaks = np.unique(np.concatenate([np.flatnonzero(np.isin(data, SENTENCE_ENDS)) + 1, self.offsets]))
        sentence = np.searchsorted(self.breaks, self.starts, "right") - 1
        # Sentences with a word, counted on: of each word, and the place in `breaks` of each.
        self.sentence_break, self.sentence = np.unique(sentence, return_inverse=True)
        self.document = np.searchsorted(self.offsets, self.breaks[self.sentence_break], "right") - 1

    def features(self):
        """(words, hashes) for whole words and for each length of beginnings."""
        every = np.arange(len(self.starts))
        yield every, arrays.word_hashes(self.data, self.starts, self.ends)
        for n in STEMS:
            long = every[self.ends - self.starts >= n]
            tag = arrays.mixed(np.array([n], np.uint64))
            yield long, arrays.word_hashes(self.data, self.starts[long], self.starts[long] + n) ^ tag

    def hits(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and place in `wanted` (sorted) of each feature found there."""
        maybe = np.zeros(1 << 16, bool)
        maybe[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
        words, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for word, hashes in self.features() if len(wanted) else ():
            some = np.flatnonzero(maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(wanted, hashes[some]), len(wanted) - 1)
            hit = wanted[place] == hashes[some]
            words.append(word[some[hit]])
            places.append(place[hit])
        return np.concatenate(words), np.concatenate(places)


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, fit_rows: int) -> tuple[DataFrame, list[float]]:
    """(text, toxic) of the documents the model is fitted on, and what one of them stands for, by label.

    Of the distinct labelled texts that are no longer than FIT_CHARS at most half of `fit_rows` for each label, the first by a hash; so rare
    toxic ones are drawn as long as there are any, and copies and ids without a text take no place.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("of")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    )
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    texts = texts.where(F.length("text") <= FIT_CHARS).withColumn("hash", F.xxhash64("text"))
    labelled = texts.select("id", "hash").join(known, F.col("id") == F.col("of")).groupBy("hash").agg(F.max("toxic").alias("toxic"), F.min("id").alias("of"))
    labelled = stage(labelled, "toxicity-labels")
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = max(1, fit_rows // 2)
    # The hash leaves some more than `half` of each label, so few rows meet in the task that takes the first.
    order = F.xxhash64("hash")
    rates = F.create_map(*[F.lit(x) for toxic in (0, 1) for x in (toxic, min(1.0, 1.5 * (half + 100) / max(1, counts.get(toxic, 0))))])
    likely = F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.element_at(rates, F.col("toxic"))
    in_order = Window.partitionBy("toxic").orderBy(order, "hash")
    picked = labelled.where(likely).withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= half)
    picked = picked.select(F.col("hash").alias("wanted"), "of", "toxic")
    found = texts.join(F.broadcast(picked), (F.col("hash") == F.col("wanted")) & (F.col("id") == F.col("of")))
    weights = [max(1.0, counts.get(toxic, 0) / half) for toxic in (0, 1)]
    return stage(found.select("text", "toxic", "hash").dropDuplicates(["hash"]).drop("hash"), "toxicity-sample"), weights


def _select(sample: DataFrame, features: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes (sorted) and first weights of the features that stand out; the share of toxic documents in the sample."""
    totals = sample.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    positive, n = float(totals["toxic"] or 0), float(totals["n"])
    if not 0 < positive < n:
        return np.zeros(0, np.uint64), np.zeros(0), 0.0

    def counted(batches):
        for piece in arrays.slices(batches, "text"):
            bags = Bags(piece.column("text"))
            toxic = piece.column("toxic").to_numpy()
            of = bags.document[bags.sentence]
            for word, hashes in bags.features():
                order = np.lexsort((of[word], hashes))
                hashes, document = hashes[order], of[word][order]
                new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1])])[: len(hashes)]
                found, place = np.unique(hashes[new], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.view(np.int64)), pa.array(np.bincount(place, minlength=len(found)).astype(np.int64)),
                        pa.array(np.bincount(place, toxic[document[new]], len(found)).astype(np.int64)),
                    ],
                    names=["feature", "found", "toxic"],
                )

    share = positive / n
    p, q = F.col("toxic") / F.lit(positive), (F.col("found") - F.col("toxic")) / F.lit(n - positive)
    both = F.col("found") / F.lit(n)
    error = F.sqrt(both * (1 - both) * F.lit(1 / positive + 1 / (n - positive)))
    chosen = (
        sample.mapInArrow(counted, "feature long, found long, toxic long")
        .groupBy("feature").agg(F.sum("found").alias("found"), F.sum("toxic").alias("toxic"))
        .where((F.col("found") >= LEAST_DOCS) & (F.col("found") < n))
        .withColumn("z", F.abs(p - q) / error).where(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "feature").limit(features).collect()
    )
    hashes = np.array([r["feature"] for r in chosen], np.int64).view(np.uint64)
    odds = np.array([
        np.log((r["toxic"] + 0.5) / (positive + 1)) - np.log((r["found"] - r["toxic"] + 0.5) / (n - positive + 1)) for r in chosen
    ])
    order = np.argsort(hashes)
    return hashes[order], odds[order], share


def _descend(toxic, sentences, hit_sentence, hit_feature, sentence_document, first, share, stands_for) -> tuple[np.ndarray, float]:
    """Weights and bias that make the labels likeliest, each document counting for as many as it stands for; Adam over
    the whole sample."""
    stands_for = stands_for / stands_for.mean()
    values = np.append(first, np.log(share / max(1.0, sentences.mean()) / 4))
    mean, square = np.zeros_like(values), np.zeros_like(values)
    hit_sentences = len(sentence_document)
    plain = sentences - np.bincount(sentence_document, minlength=len(toxic))
    for step in range(1, STEPS + 1):
        z = values[-1] + np.bincount(hit_sentence, values[:-1][hit_feature], hit_sentences)
        amount = np.bincount(sentence_document, np.logaddexp(0, z), len(toxic)) + plain * np.logaddexp(0, values[-1])
        slope = stands_for * np.where(toxic == 1, -1 / np.expm1(np.clip(amount, 1e-9, 500)), 1.0) / len(toxic)
        by_sentence = slope[sentence_document] / (1 + np.exp(-np.clip(z, -50, 50)))
        gradient = np.append(
            np.bincount(hit_feature, by_sentence[hit_sentence], len(first)) + PULL / len(toxic) * values[:-1],
            by_sentence.sum() + (slope * plain).sum() / (1 + np.exp(-values[-1])),
        )
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        values = values - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-10)
    return values[:-1], float(values[-1])


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
    fit_rows: int = FIT_ROWS, features: int = FEATURES,
) -> Model:
    """The model learned from `labels` of `docs`."""
    sample, stands_for = _sample(docs, labels, id_column, text, label, fit_rows)
    wanted, first, share = _select(sample, features)
    if not len(wanted):
        return Model(wanted, first, -np.inf)

    def bagged(batches):
        for piece in arrays.slices(batches, "text"):
            bags = Bags(piece.column("text"))
            word, place = bags.hits(wanted)
            sentence = bags.sentence[word]
            of = bags.document[sentence]
            order = np.lexsort((sentence, of))
            cuts = np.searchsorted(of[order], np.arange(piece.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[order].astype(np.int32))) for x in (sentence, place)]
            count = np.bincount(bags.document, minlength=piece.num_rows)
            yield pa.RecordBatch.from_arrays([piece.column("toxic"), pa.array(count), *lists], names=["toxic", "sentences", "at", "hits"])

    bags = sample.mapInArrow(bagged, "toxic int, sentences long, at array<int>, hits array<int>").toArrow().combine_chunks()
    toxic = bags.column("toxic").to_numpy()
    hits = bags.column("hits").combine_chunks()
    sizes = np.diff(np.asarray(hits.offsets)) if len(toxic) else np.zeros(0, np.int64)
    document = np.repeat(np.arange(len(toxic)), sizes)
    at = bags.column("at").combine_chunks().flatten().to_numpy().astype(np.int64)
    keys, hit_sentence = np.unique(document << 32 | at, return_inverse=True)
    weights, bias = _descend(
        toxic, bags.column("sentences").to_numpy(), hit_sentence, hits.flatten().to_numpy(), keys >> 32, first, share,
        np.array(stands_for)[toxic],
    )
    return Model(wanted, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", columns: tuple[str, str] = ("score", "offending")) -> DataFrame:
    """`docs` with two further columns: the document's score, and the sentences that offend.

    A sentence is (start, length, score), start and length counted in characters.
    """

    def judge(column: pa.Array) -> pa.Array:
        scores, sizes, found = [np.zeros(0)], [np.zeros(1, np.int64)], []
        for piece in arrays.slices([pa.RecordBatch.from_arrays([column], ["text"])], "text"):
            bags = Bags(piece.column("text"))
            word, place = bags.hits(model.features)
            z = model.bias + np.bincount(bags.sentence[word], model.weights[place], len(bags.document))
            amount = np.bincount(bags.document, np.logaddexp(0, z), piece.num_rows)
            scores.append(-np.expm1(-amount))
            own = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            named = np.flatnonzero(own >= OFFENDING)
            before = np.concatenate([[0], np.cumsum((bags.data & 0xC0) != 0x80)])
            begin, end = bags.breaks[bags.sentence_break[named]], bags.breaks[bags.sentence_break[named] + 1]
            first = bags.offsets[bags.document[named]]
            found.append(np.stack([before[begin] - before[first], before[end] - before[begin], own[named]]))
            sizes.append(np.bincount(bags.document[named], minlength=piece.num_rows))
        start, length, own = np.concatenate([np.zeros((3, 0)), *found], axis=1)
        sentences = pa.StructArray.from_arrays(
            [pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(own)], ["start", "length", "score"]
        )
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), sentences)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), listed], ["score", "offending"])

    kind = "struct<score:double,offending:array<struct<start:int,length:int,score:double>>>"
    found = F.arrow_udf(judge, kind, F.ArrowUDFType.SCALAR).asNondeterministic()  # a later filter must not run it once more
    rows = docs.drop(*columns)
    return rows.withColumn("__found", found(F.col(text).cast("string"))).select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.col("__found.score").alias(columns[0]), F.col("__found.offending").alias(columns[1]),
    )
