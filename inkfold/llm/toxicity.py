"""Toxicity by multiple-instance learning: labels are of documents, scores of sentences.

A sentence has the probability p = 1 / (1 + exp(-z)), z a bias and the sum of the weights
of its weighted features; a document is toxic if any sentence is (noisy-or): 1 - prod(1 - p).
The product runs over the sentences that have a weighted feature and one more that has none,
which stands for all the others: a text is judged by what it holds, not by its length.  The
weights are trained from document labels through that same formula, so that the sentences
that explain a label get high scores and can be named.

Features of a word (a run of letters, lower case) are the word and its beginnings of 4 to
8 bytes.  The candidates for a weight are found over the training texts, counted per
partition and added up by Spark.

Training takes at most `Training.documents` documents of each label, chosen by a hash of
the id, each of at most `Training.bytes` bytes; this bounds what the driver holds.
Scoring takes every text whole.

Defined cases: null and empty texts have the score of the bias alone (one empty sentence);
labels that are null or belong to no document teach nothing; without one of the two labels
no feature has a weight and all scores are the share of toxic labels; repeated rows are
scored alike; other columns stay unless they have the name of a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inkfold.llm.mapping import map_texts, text_chunks
from inkfold.llm.words import code_points, range_hashes
from inkfold.session import shared_dir

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n\0")] = True
BEGINNINGS = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Training:
    documents: int = 2500  # of each label at most
    bytes: int = 50_000  # of a document that is learned from at most
    features: int = 4096  # that may have a weight
    least: int = 3  # toxic documents with a feature
    rounds: int = 300
    decay: float = 2e-4


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float


@dataclass
class Sentences:
    """Features of the sentences of a chunk of texts."""

    start: np.ndarray  # of each sentence, in code points of its text
    end: np.ndarray
    text: np.ndarray
    feature: np.ndarray  # hashes
    sentence: np.ndarray  # of each feature


def sentences(texts: list[bytes]) -> Sentences:
    """A text ends its last sentence, so each text has one at least."""
    joined = b"".join(t.decode("utf-8", "replace").lower().replace("\0", " ").encode() + b"\0" for t in texts)
    buffer = np.frombuffer(joined, np.uint8)
    stop = np.flatnonzero(_STOP[buffer])
    last = np.flatnonzero(buffer[stop] == 0)
    first = np.concatenate((np.zeros(1, np.int64), last[:-1] + 1))
    text = np.repeat(np.arange(len(texts)), last - first + 1)
    points = code_points(buffer)
    start = np.concatenate((np.zeros(1, np.int64), stop[:-1] + 1))
    base = points[start[first]][text]
    end = np.minimum(stop + (buffer[stop] != 0), stop + 1)
    letter = np.concatenate(([False], _LETTER[buffer], [False]))
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    begin, close = edge[0::2], edge[1::2]
    owner = np.searchsorted(stop, begin)
    features = [range_hashes(buffer, begin, close)]
    owners = [owner]
    for size in BEGINNINGS:
        long = close - begin > size
        features.append(range_hashes(buffer, begin[long], begin[long] + size) ^ np.uint64(0x5851F42D4C957F2D))
        owners.append(owner[long])
    return Sentences(points[start] - base, points[end] - base, text, np.concatenate(features), np.concatenate(owners))


def _counted(df: DataFrame, least: int, most: int) -> np.ndarray:
    """The features that tell most of a toxic label, as sorted hashes: document counts by
    label over all training texts, added up by Spark; `most` of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for i, j, texts in text_chunks(batch.column(0)):
                s = sentences(texts)
                owner = s.text[s.sentence]
                order = np.lexsort((owner, s.feature))
                f, o = s.feature[order], owner[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
                f, label = f[new], toxic[i:j][o[new]]
                distinct, which = np.unique(f, return_inverse=True)
                bad = np.bincount(which, label, len(distinct)).astype(np.int64)
                total = np.bincount(which, minlength=len(distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(bad), pa.array(total)], ["feature", "bad", "total"])

    n = df.agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.count(F.lit(1)).alias("total")).first()
    bad_all, good_all = n["bad"] or 0, (n["total"] or 0) - (n["bad"] or 0)
    if not bad_all or not good_all:
        return np.empty(0, np.uint64)
    counts = (
        df.select(F.col("text").cast("binary"), "toxic").mapInArrow(run, "feature long, bad long, total long")
        .groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("total").alias("total"))
        .filter(F.col("bad") >= least)
    )
    ratio = F.log((F.col("bad") + 0.5) / (bad_all + 1.0)) - F.log((F.col("total") - F.col("bad") + 0.5) / (good_all + 1.0))
    telling = F.sqrt(F.col("bad").cast("double")) * ratio
    best = counts.withColumn("ratio", ratio).filter(F.col("ratio") > 1.0).orderBy(telling.desc(), "feature").limit(most)
    return np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64).view(np.uint64))


def _place(feature: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of each feature among the model's, or -1."""
    if not len(hashes):
        return np.full(len(feature), -1)
    seen = np.zeros(1 << 20, bool)
    seen[hashes >> np.uint64(44)] = True
    out = np.full(len(feature), -1)
    maybe = np.flatnonzero(seen[feature >> np.uint64(44)])
    at = np.minimum(np.searchsorted(hashes, feature[maybe]), len(hashes) - 1)
    out[maybe] = np.where(hashes[at] == feature[maybe], at, -1)
    return out


def _distinct(place: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once in a sentence."""
    found = place >= 0
    if not found.any():
        return place[found], sentence[found]
    pair = np.unique(sentence[found] << np.int64(20) | place[found])
    return pair & ((1 << 20) - 1), pair >> 20


def _document_rows(df: DataFrame, hashes: np.ndarray) -> list:
    """Of each training document its label, number of sentences, and chosen features by sentence."""

    def make():
        def call(texts: list[bytes]) -> dict:
            s = sentences(texts)
            place, sentence = _distinct(_place(s.feature, hashes), s.sentence)
            first = np.searchsorted(s.text, np.arange(len(texts) + 1))
            cut = np.searchsorted(sentence, first)
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            return {
                "n": np.diff(first),
                "place": [place[a:b].tolist() for a, b in spans],
                "sentence": [(sentence[a:b] - f).tolist() for (a, b), f in zip(spans, first[:-1], strict=True)],
            }

        return call

    rows = map_texts(df, make, "n int, place array<int>, sentence array<int>", keep=["toxic", "rank"])
    return sorted(rows.collect(), key=lambda r: r["rank"])


def _hazards(sentence: np.ndarray, weight: np.ndarray, bias: float, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each sentence z and log(1 + exp(z)), 0 for one without a weighted feature: the one
    rule of training and scoring.  A document adds the same of the bias once."""
    z = bias + np.bincount(sentence, weight, len(marked))
    return z, np.where(marked, np.logaddexp(0, z), 0.0)


def _fit(rows: list, n_features: int, how: Training) -> tuple[np.ndarray, float]:
    """Weights and bias that explain the labels through the noisy-or of :func:`_hazards`."""
    label = np.array([r["toxic"] for r in rows], float)
    counts = np.array([r["n"] for r in rows])
    base = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)[:-1]))
    document = np.repeat(np.arange(len(rows)), counts)
    place = np.concatenate([np.array(r["place"], np.int64) for r in rows])
    sentence = np.concatenate([np.array(r["sentence"], np.int64) + b for r, b in zip(rows, base, strict=True)])
    marked = np.bincount(sentence, minlength=len(document)) > 0
    weights, bias = np.zeros(n_features), -5.0
    moment, square = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, how.rounds + 1):
        z, each_hazard = _hazards(sentence, weights[place], bias, marked)
        hazard = np.bincount(document, each_hazard, len(rows)) + np.logaddexp(0, bias)
        push = (1 - label) - label / np.maximum(np.expm1(np.minimum(hazard, 50)), 1e-6)
        each = np.where(marked, push[document] / (1 + np.exp(-z)), 0.0) / len(rows)
        slope = np.append(np.bincount(place, each[sentence], n_features) + how.decay * weights, each.sum() + push.mean() / (1 + np.exp(-bias)))
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        move = 0.15 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def train(documents: DataFrame, labels: DataFrame, learn_from: Column, how: Training = Training()) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic) of which `learn_from`,
    a condition on doc_id, holds."""
    usable = labels.filter(learn_from & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        part = usable.filter(F.col("toxic") == label).withColumn("rank", rank).orderBy("rank", "doc_id").limit(how.documents)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.filter(F.octet_length("text") <= how.bytes).select("doc_id", "text")
    path = shared_dir(documents.sparkSession, "toxicity-sample")
    # At most twice `documents` ids: the broadcast has a fixed bound.
    texts.join(F.broadcast(chosen), "doc_id").select("toxic", "rank", "text").write.parquet(path)
    sample = documents.sparkSession.read.parquet(path)
    hashes = _counted(sample, how.least, how.features)
    rows = _document_rows(sample, hashes)
    share = sum(r["toxic"] for r in rows) / len(rows) if rows else 0.0
    if not len(hashes):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(hashes, np.zeros(0), float(np.log(share / (1 - share))))
    weights, bias = _fit(rows, len(hashes), how)
    return Model(hashes, weights, bias)


SCORED = "score double, predicted int, toxic_sentences array<struct<start:int,end:int,score:double>>"


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Columns `keep` (default all), the document's score, whether it reaches the threshold,
    and its sentences with a score of the threshold or more (code points, end exclusive)."""

    def make():
        def call(texts: list[bytes]) -> dict:
            s = sentences(texts)
            place, sentence = _distinct(_place(s.feature, model.hashes), s.sentence)
            marked = np.bincount(sentence, minlength=len(s.text)) > 0
            _, hazard = _hazards(sentence, model.weights[place], model.bias, marked)
            total = np.bincount(s.text, hazard, len(texts)) + np.logaddexp(0, model.bias)
            value = -np.expm1(-total)
            each = -np.expm1(-hazard)
            found: list[list] = [[] for _ in texts]
            for i in np.flatnonzero(each >= threshold):
                found[s.text[i]].append({"start": int(s.start[i]), "end": int(s.end[i]), "score": float(each[i])})
            return {"score": value, "predicted": (value >= threshold).astype(np.int32), "toxic_sentences": found}

        return call

    return map_texts(df, make, SCORED, text, keep)
