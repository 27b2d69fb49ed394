"""Language identification in two steps: the family, then the language inside it.

Both steps use linear support vector machines on frequencies of hashed letter trigrams.
Families are told apart one against the rest; the languages of the family found are told
apart one versus one, every pair voting, the sum of margins deciding between equals.

A machine's value for a text is a mean of weights over its trigrams, so scoring needs no
vectors: it looks up a weight for each place and adds them up by text.

Training takes at most `Training.documents` documents of each language, chosen by a hash
of the id, each of at most `Training.bytes` bytes.  Scoring takes every text whole.

Defined cases: a text that is null or has no letter is `und` with score 0; a language
outside `FAMILIES` is a family of its own; with one language learned every other text is
that language with score 1, with none every text is `und`; repeated rows get the same
answer; other columns stay unless they have the name of a result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkfold.llm.mapping import map_texts

# Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "gd", "cy", "br"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "indic": ["hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"],
}
UNKNOWN = "und"
BUCKETS = 1 << 13


@dataclass(frozen=True)
class Training:
    documents: int = 400  # of each language at most
    bytes: int = 50_000  # of a document that is learned from at most
    rounds: int = 150
    penalty: float = 1e-3


@dataclass(frozen=True)
class Machine:
    """Positive for `yes`, negative for `no` (None: the rest)."""

    yes: str
    no: str | None
    bias: float


@dataclass
class Model:
    languages: list[str]
    family: dict[str, str]
    machines: list[Machine] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, 0), np.float32))


_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_LETTER = regex.compile(r"\p{L}")


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram at each place (BUCKETS: none), and where each text starts."""
    folded = [t.decode("utf-8", "replace").lower().encode() for t in texts]
    raw = _FOLD[np.frombuffer(b" ".join([b"", *folded, b"  "]), np.uint8)]
    start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in folded], out=start[1:])
    a, b, c = (raw[k : len(raw) - 2 + k].astype(np.uint32) for k in range(3))
    bucket = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)) >> np.uint32(19)).astype(np.int32)
    blank = (a == 0x20).astype(np.int8) + (b == 0x20) + (c == 0x20)
    bucket[(blank > 1) | (b == 0x20)] = BUCKETS
    return bucket[: start[-1]], start


def _sample(documents: DataFrame, learn_from: Column, how: Training) -> DataFrame:
    """At most `documents` rows of each language: thinned out by a hash of the id to about
    twice that, then ranked, so that no window holds a whole language."""
    usable = documents.filter(learn_from & F.col("lang").isNotNull() & (F.octet_length("text") <= how.bytes))
    sizes = usable.groupBy("lang").count()
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = usable.select("doc_id", "lang", "text", hashed.alias("hash")).join(F.broadcast(sizes), "lang")
    near = near.filter(F.col("hash").cast("double") * F.col("count") <= 2.0 * how.documents * (1 << 30) + 1)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id")))
    return ranked.filter(F.col("rank") <= how.documents).select("lang", "rank", "text")


def _vectors(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and trigram frequencies of the sample; its size is bounded by `Training`."""

    def make():
        def call(texts: list[bytes]) -> dict:
            bucket, start = trigrams(texts)
            out: dict[str, list] = {"at": [], "n": []}
            for a, b in zip(start[:-1], start[1:], strict=True):
                at, n = np.unique(bucket[a:b], return_counts=True)
                out["at"].append(at[at < BUCKETS].tolist())
                out["n"].append(n[at < BUCKETS].tolist())
            return out

        return call

    rows = map_texts(sample, make, "at array<int>, n array<int>", keep=["lang", "rank"]).collect()
    rows = sorted((r for r in rows if r["at"]), key=lambda r: (r["lang"], r["rank"]))
    matrix = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        n = np.array(r["n"], np.float32)
        matrix[i, r["at"]] = n / n.sum()
    return [r["lang"] for r in rows], matrix


def _machine(x: np.ndarray, y: np.ndarray, how: Training) -> tuple[np.ndarray, float]:
    """Weights and bias of least squared hinge, both classes weighing the same."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    moment, square = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, how.rounds + 1):
        lack = np.maximum(0, 1 - y * (x @ w + bias))
        push = (-2 * share * lack * y).astype(np.float32)
        slope = np.append(push @ x + how.penalty * w, push.sum())
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, bias = (w - move[:-1]).astype(np.float32), bias - move[-1]
    return w, float(bias)


def train(documents: DataFrame, learn_from: Column, how: Training = Training()) -> Model:
    """A model from the text and lang of the documents for which `learn_from` holds."""
    found, x = _vectors(_sample(documents, learn_from, how))
    languages = sorted(set(found))
    of = {code: name for name, codes in FAMILIES.items() for code in codes}
    family = {code: of.get(code, code) for code in languages}
    model = Model(languages, family)
    if len(languages) < 2:
        return model
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-6)
    x = x * scale
    label = np.array(found)
    kin = np.array([family[c] for c in found])
    families = sorted(set(family.values()))
    tasks: list[tuple[str, str | None, np.ndarray, np.ndarray]] = []
    if len(families) > 1:
        # Of two families one machine says all.
        for name in families[: 1 if len(families) == 2 else None]:
            tasks.append((name, None, np.ones(len(x), bool), kin == name))
    for i, one in enumerate(languages):
        for other in languages[i + 1 :]:
            if family[one] == family[other]:
                tasks.append((one, other, (label == one) | (label == other), label == one))
    columns = []
    for yes, no, rows, positive in tasks:
        w, bias = _machine(x[rows], np.where(positive[rows], 1.0, -1.0).astype(np.float32), how)
        columns.append(np.append(w * scale, 0).astype(np.float32))
        model.machines.append(Machine(yes, no, bias))
    model.weights = np.stack(columns, axis=1)
    return model


def _decide(model: Model, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each row of margins: family first, then votes inside it."""
    n = len(margins)
    rows = np.arange(n)
    families = sorted(set(model.family.values()))
    sure = np.ones(n)
    chosen = np.zeros(n, np.int64)
    one_rest = [i for i, m in enumerate(model.machines) if m.no is None]
    if one_rest:
        value = margins[:, one_rest]
        if len(families) == 2:
            value = np.concatenate((value, -value), axis=1)
        chosen = value.argmax(axis=1)
        sure = 1 / (1 + np.exp(-2 * value[rows, chosen]))
    language = np.zeros(n, object)
    for k, name in enumerate(families):
        members = [c for c in model.languages if model.family[c] == name]
        votes, total = np.zeros((n, len(members))), np.zeros((n, len(members)))
        for i, m in enumerate(model.machines):
            if m.no is not None and m.yes in members:
                a, b = members.index(m.yes), members.index(m.no)
                votes[:, a] += margins[:, i] >= 0
                votes[:, b] += margins[:, i] < 0
                total[:, a] += margins[:, i]
                total[:, b] -= margins[:, i]
        best = (votes + np.tanh(total / 4) * 0.49).argmax(axis=1)
        here = chosen == k
        language[here] = np.array(members, object)[best[here]]
        if len(members) > 1:
            sure[here] *= 1 / (1 + np.exp(-2 * total[here, best[here]] / (len(members) - 1)))
    return language.tolist(), sure


PREDICTED = "lang_pred string, score double"


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default all), the language of each text and a score from 0 to 1."""

    def make():
        def call(texts: list[bytes]) -> dict:
            lettered = np.array([bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts])
            if not model.languages:
                return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)}
            bucket, start = trigrams(texts)
            counted = np.concatenate((np.zeros(1, np.int64), np.cumsum(bucket < BUCKETS)))[start]
            margins = np.empty((len(texts), len(model.machines)))
            for i, machine in enumerate(model.machines):
                upto = np.concatenate((np.zeros(1), np.cumsum(model.weights[:, i][bucket], dtype=np.float64)))[start]
                margins[:, i] = np.diff(upto) / np.maximum(1, np.diff(counted)) + machine.bias
            language, sure = _decide(model, margins)
            return {
                "lang_pred": [c if ok else UNKNOWN for c, ok in zip(language, lettered, strict=True)],
                "score": np.where(lettered, sure, 0.0),
            }

        return call

    return map_texts(df, make, PREDICTED, text, keep)
