"""Personal data by weak supervision, on DataFrame functions only.

Candidate spans come from patterns, from a gazetteer (given names with a surname) and from
context (capitalised words and numbers after a word that announces them).  Labelers look at
each candidate: its form and check digits, gazetteers (issuers, top-level domains, key
prefixes, reserved networks, given names, words that are no names), the words before it,
its edges, and its variety; each votes for, against or abstains.  Candidates that fail the
checks of their kind (check digits, ranges, lengths, words of no name) are voted against by their form: they
count, but are never spans.  Votes are counted by pattern of votes over all texts,
expectation-maximisation on these counts estimates how reliable each labeler is and how
likely each pattern is personal data, and a logistic classifier of spans is trained on these
likelihoods.  A span stays if the classifier says so; spans of the base patterns that pass
their checks always do.

The counts are a bounded table (kinds times vote patterns), so the driver holds nothing that
grows with the texts.  Candidates stay inside their row; no text enters a shuffle.

Places are code points, end exclusive.  Base kinds: email, ip, card, phone; found only by
the method: secret, name, iban, phone numbers without a country, and card or phone inside a
longer run of digits.

Defined cases: null and empty texts have no spans; spans of different kinds may overlap;
repeated rows get the same spans; without any candidate the classifier is not needed; an
empty table gives an empty table; other columns stay unless they have the name of a result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from inkfold.functions.once import compute_once
from inkfold.llm.landing import Landing

# The patterns.  Possessive runs and what may stand before a match only keep
# the search linear; they match what the plain patterns do.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
CARD_INSIDE = r"(?<=[0-9][ -])[0-9]{15,16}(?![0-9])|(?<![0-9])[0-9]{15,16}(?=[ -][0-9])"
PHONE_INSIDE = r"\+[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?=[ ().-]+[0-9])"
SECRET = (
    r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b"
    r"|\b(?i:password|passwd|token|secret|api[_-]?key)(?-i) ?[:=] ?\"?[A-Za-z0-9+/_-]{12,}\"?"
)
# Gazetteers and cue words.
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
DOMAINS = r"\.(?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|ch|at|be|nl)$"
RESERVED = r"^(?:0|10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
KEYS = r"^(?:AKIA|gh[pousr]_)"
COUNTRIES = r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE|SK)"
GIVEN = (
    r"\b(?:Anna|Carlos|Carmen|Charles|David|Elena|Elizabeth|Emma|Hans|Isabelle|James|Jean|Jennifer|John|José|Juan|Klaus|Laura"
    r"|Linda|Lucía|Luis|Maria|María|Marie|Martin|Mary|Michael|Michel|Patricia|Paul|Peter|Pierre|Robert|Sarah|Sophie|Susan"
    r"|Thomas|Ursula|William|Wolfgang)\b"
)
NO_NAMES = (
    r"\b(?:Sir|Madam|Customer|Service|Support|Team|Street|Road|Avenue|University|School|Company|Bank|Hotel|Hospital"
    r"|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|June|July|August|September"
    r"|October|November|December|The|This|That|All|Our|Your|New|North|South|East|West)\b"
)
TITLE = r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}"
CUES = {
    "email": r"(?i)mail|contact|correo|courriel|write to",
    "ip": r"(?i)\bip\b|address|adresse|host|server|login",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta|amex",
    "phone": r"(?i)tel|phone|call|fax|mobil|handy|teléfono",
    "secret": r"(?i)key|secret|login|user|credential",
    "name": r"(?i)dear|name|contact|signed|from|friend",
    "iban": r"(?i)iban|account|konto|compte|cuenta|transfer",
}
AGAINST = r"(?i)(?:version|release|licen[sc]e|isbn|order no|invoice|section|build)\W*$"
CONTEXT = 40
# Patterns that gazetteers and cue words propose.  The first look is at the
# letter or digit a match starts with, so that what stands before is seldom looked at.
_CAPITALS = r"\p{Lu}\p{L}++"
NAME = (
    TITLE + r"\p{L}++(?: " + _CAPITALS + r")?"
    + r"|(?=\p{Lu})" + GIVEN + r"(?: \p{Lu}\.)? " + _CAPITALS
    + r"|(?=\p{Lu})(?<=\b(?i:dear|friend|name is|signed by|signed,|regards,)\s)" + _CAPITALS + " " + _CAPITALS
)
PHONE_LOCAL = (
    r"(?=[0-9(])(?<![0-9A-Za-z+.])(?<![0-9][ ().-]{1,2})(?:"
    r"\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}"
    r"|\(?0[1-9][0-9]{1,3}\)?[ /-][0-9]{3,4}[ -]?[0-9]{3,5}"
    r"|(?<=\b(?i:call|phone|tel|tel\.|fax|mobile|handy|teléfono)[ :]{1,2})[0-9(][0-9 ()/-]{5,14}[0-9]"
    r")(?![ .-]?[0-9])"
)
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Source:
    kind: str
    pattern: str
    holds: Callable[[Column], Column]  # a cheap test that texts without a match fail
    base: bool


SOURCES = (
    Source("email", EMAIL, lambda t: F.contains(t, F.lit("@")), True),
    Source("ip", IP, lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")), True),
    Source("card", CARD, lambda t: F.rlike(t, F.lit(r"[0-9][0-9 -]{12}")), True),
    Source("phone", PHONE, lambda t: F.contains(t, F.lit("+")), True),
    Source("card", CARD_INSIDE, lambda t: F.rlike(t, F.lit(r"[0-9]{15}")), False),
    Source("phone", PHONE_INSIDE, lambda t: F.contains(t, F.lit("+")), False),
    Source("secret", SECRET, lambda t: F.rlike(t, F.lit(r"AKIA|gh[pousr]_|[:=] ?\"?[A-Za-z0-9+/_-]{12}")), False),
    Source("name", NAME, lambda t: F.rlike(t, F.lit(r"\p{Lu}\p{L}*+[. ]{1,2}\p{Lu}")), False),
    Source("phone", PHONE_LOCAL, lambda t: F.rlike(t, F.lit(r"[0-9][0-9 ()./-]{5}")), False),
    Source("iban", IBAN, lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")), False),
)
KINDS = ("email", "ip", "card", "phone", "secret", "name", "iban")
LABELERS = ("form", "gazetteer", "context", "edges", "variety")
VOTES = 3 ** len(LABELERS)

_CANDIDATE = "struct<start:int,kind:int,end:int,base:boolean,passes:boolean,votes:int>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _upto(n: Column) -> Column:
    """0, .., n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, double).otherwise(d)

    return F.aggregate(_upto(n), F.lit(0), add) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("[^0-9]"), F.lit(""))


def _mod_97(iban: Column) -> Column:
    """The remainder that check digits make 1: letters are 10 to 35, the first four come last."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.left(iban, F.lit(4)))

    def add(total: Column, letter: Column) -> Column:
        value = F.ascii(letter) - F.when(letter >= "A", 55).otherwise(48)
        return (total * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _passes(kind: str, found: Column, base: bool) -> Column:
    """The checks of a match of the kind."""
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.rlike(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return _let(_digits(found), lambda d: F.length(d).between(14, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(found)).between(10 if base else 7, 15)
    if kind == "iban":
        return _let(F.replace(found, F.lit(" "), F.lit("")), lambda i: F.length(i).between(15, 34) & (_mod_97(i) == 1))
    if kind == "name":
        return F.rlike(found, F.lit(TITLE)) | ~F.rlike(found, F.lit(NO_NAMES))
    return F.lit(True)


def _vote(yes: Column, no: Column | bool = False) -> Column:
    """2 for, 0 against, 1 abstains."""
    return F.when(F.coalesce(yes, F.lit(False)), 2).when(F.lit(no) if isinstance(no, bool) else F.coalesce(no, F.lit(False)), 0).otherwise(1)


def _votes(kind: str, found: Column, before: Column, after: Column, passes: Column) -> Column:
    """One number for the votes of all labelers."""
    like = lambda c, p: F.rlike(c, F.lit(p))
    gazetteer = {
        "email": lambda: _vote(like(found, DOMAINS)),
        "ip": lambda: _vote(~like(found, RESERVED), like(found, RESERVED)),
        "card": lambda: _vote(like(found, ISSUERS), ~like(found, ISSUERS)),
        "phone": lambda: _vote(like(found, r"^\+(?:1|[2-9][0-9])"), like(found, r"^\+0")),
        "secret": lambda: _vote(like(found, KEYS)),
        "name": lambda: _vote(like(found, GIVEN), like(found, NO_NAMES)),
        "iban": lambda: _vote(like(found, COUNTRIES), ~like(found, COUNTRIES)),
    }[kind]()
    # What the form alone shows: names without a title and numbers without a country abstain.
    shown = {"secret": r"^(?:AKIA|gh)|[0-9]", "name": TITLE, "phone": r"^\+"}.get(kind, "")
    against = ~passes | (~like(found, shown) if kind == "secret" else F.lit(False))
    form = _vote(passes & like(found, shown), against)
    context = _vote(like(before, CUES[kind]), like(before, AGAINST))
    clean = ~like(before, r"[A-Za-z0-9_]$") & ~like(after, r"^[A-Za-z0-9_]")
    edges = _vote(clean, ~clean)
    body = F.regexp_replace(found, F.lit("[^A-Za-z0-9]"), F.lit(""))
    variety = F.size(F.array_distinct(F.split(body, "")))
    varied = _vote(variety >= 5, variety <= 2)
    total = F.lit(0)
    for i, vote in enumerate((form, gazetteer, context, edges, varied)):
        total = total + vote * 3**i
    return total.cast("int")


_BLOCK = 64


def _starts(sizes: Column) -> Column:
    """Sums of all sizes before each place, by blocks: work stays near linear."""
    n = F.size(sizes)
    blocks = F.transform(_upto(F.ceil(n / _BLOCK).cast("int")), lambda b: _sum(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))))

    def places(sums: Column) -> Column:
        before = F.transform(_upto(F.size(sums)), lambda b: _sum(F.slice(sums, F.lit(1), b)))
        return _let(before, lambda base: F.transform(_upto(n), lambda i: F.get(base, (i / _BLOCK).cast("int")) + _sum(
            F.slice(sizes, (i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))

    return _let(blocks, places)


def _cut(text: Column, source: Source) -> Column:
    """Matches of a pattern and the gaps around them (one more)."""
    return F.struct(
        F.regexp_extract_all(text, F.lit(source.pattern), F.lit(0)).alias("m"),
        F.split(text, source.pattern, -1).alias("g"),
    )


def _judged(source: Source, found: Column, before: Column, after: Column) -> Column:
    """Whether it passes its kind's checks, is a base span, and the votes."""
    passes = _passes(source.kind, found, source.base)
    return F.struct(
        passes.alias("passes"), (passes & F.lit(source.base)).alias("base"),
        _votes(source.kind, found, before, after, passes).alias("votes"))


def _candidates(text: Column, source: Source) -> Column:
    kind = F.lit(KINDS.index(source.kind))

    def one(cut: Column, starts: Column, i: Column) -> Column:
        found, gap = F.get(cut["m"], i), F.get(cut["g"], i)
        start = F.get(starts, i) + F.length(gap)
        judged = _judged(source, found, F.right(gap, F.lit(CONTEXT)), F.left(F.get(cut["g"], i + 1), F.lit(2)))
        return _let(judged, lambda j: F.struct(
            start.cast("int").alias("start"), kind.alias("kind"), (start + F.length(found)).cast("int").alias("end"),
            j["base"].alias("base"), j["passes"].alias("passes"), j["votes"].alias("votes")))

    def all_of(cut: Column) -> Column:
        sizes = F.zip_with(cut["m"], F.slice(cut["g"], F.lit(1), F.size(cut["m"])), lambda m, g: F.length(m) + F.length(g))
        return _let(_let(sizes, _starts), lambda starts: F.transform(_upto(F.size(cut["m"])), lambda i: one(cut, starts, i)))

    none = F.array().cast(f"array<{_CANDIDATE}>")
    return F.when(source.holds(text), _let(_cut(text, source), all_of).cast(f"array<{_CANDIDATE}>")).otherwise(none)


def candidates(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` and `candidates`: what all sources propose, with its votes and whether it
    passes its checks, in order of start, then kind."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = F.array_sort(F.concat(*[_candidates(body, s) for s in SOURCES]))
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != "candidates"]
    return compute_once(df.select(*kept, found.alias("candidates")), "candidates")


@dataclass(frozen=True)
class Model:
    """A logistic classifier of spans: bias by kind, weights for and against by labeler."""

    bias: tuple[float, ...]
    weight_for: tuple[float, ...]
    weight_against: tuple[float, ...]
    reliability: tuple[float, ...]

    def accepts(self, kind: Column, votes: Column) -> Column:
        z = F.element_at(F.array(*map(F.lit, self.bias)), kind + 1)
        for i, (up, down) in enumerate(zip(self.weight_for, self.weight_against, strict=True)):
            vote = F.floor(votes / 3**i).cast("int") % 3
            z = z + F.when(vote == 2, up).when(vote == 0, down).otherwise(0.0)
        return z >= 0.0


def _aggregate(likelihood: np.ndarray, votes: np.ndarray, kind: np.ndarray, count: np.ndarray, rounds: int = 100):
    """Expectation-maximisation: how often each labeler that votes is right, and how likely
    each row is personal data."""
    right, share = np.full(votes.shape[1], 0.8), np.full(len(KINDS), 0.6)
    for _ in range(rounds):
        sure = np.log(right / (1 - right))
        z = np.log(share / (1 - share))[kind] + (votes * sure).sum(axis=1)
        likelihood = 1 / (1 + np.exp(-z))
        for k in range(votes.shape[1]):
            up, down = count * (votes[:, k] > 0), count * (votes[:, k] < 0)
            good = (up * likelihood + down * (1 - likelihood)).sum() + 8.0
            right[k] = np.clip(good / (up.sum() + down.sum() + 10.0), 0.55, 0.99)
        for k in range(len(KINDS)):
            here = count * (kind == k)
            share[k] = np.clip(((here * likelihood).sum() + 3.0) / (here.sum() + 5.0), 0.05, 0.95)
    return likelihood, right


def fit(counts: list[tuple[int, int, int]]) -> Model:
    """A model from (kind, votes, number of candidates); at most kinds times vote patterns rows."""
    rows = sorted(counts)
    kind = np.array([r[0] for r in rows], np.int64)
    code = np.array([r[1] for r in rows], np.int64)
    count = np.array([r[2] for r in rows], float)
    votes = np.stack([(code // 3**i) % 3 - 1 for i in range(len(LABELERS))], axis=1) if rows else np.zeros((0, len(LABELERS)))
    likelihood, right = _aggregate(np.zeros(len(rows)), votes, kind, count)
    x = np.concatenate((np.eye(len(KINDS))[kind], votes > 0, votes < 0), axis=1).astype(float)
    weight = np.log1p(count)  # so that rare patterns are heard
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (weight * (p - likelihood)) + 0.05 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(curve, slope), -2, 2)
    k, n = len(KINDS), len(LABELERS)
    as_floats = lambda v: tuple(float(c) if math.isfinite(c) else 0.0 for c in v)
    return Model(as_floats(w[:k]), as_floats(w[k : k + n]), as_floats(w[k + n :]), as_floats(right))


def train(candidate_rows: DataFrame) -> Model:
    """A model from a table of candidates, counted by pattern of votes."""
    spans = candidate_rows.select(F.explode("candidates").alias("c"))
    counts = spans.groupBy("c.kind", "c.votes").agg(F.count(F.lit(1)).alias("n"))
    return fit([(r["kind"], r["votes"], r["n"]) for r in counts.collect()])


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def accepted(df: DataFrame, model: Model) -> DataFrame:
    """`candidates` cut down to base spans and those that pass and the classifier accepts."""
    stays = F.filter("candidates", lambda s: s["base"] | (s["passes"] & model.accepts(s["kind"], s["votes"])))
    return df.withColumn("candidates", stays)


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep`, the number of base spans of each kind, `base` and `spans`: base spans and
    all spans as `kind:start:end`, by start, then kind, joined by commas."""
    landing = Landing(df.sparkSession, "private-data")
    rows = landing.land(candidates(df, text, keep))
    found = accepted(rows, train(rows))
    base = F.filter("candidates", lambda s: s["base"])

    def of_kind(k: int) -> Column:
        return F.size(F.filter("candidates", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")

    others = [c for c in rows.columns if c != "candidates"]
    return found.select(*others, *map(of_kind, range(4)), _listed(base).alias("base"), _listed(F.col("candidates")).alias("spans"))


def _tops(values: Column) -> Column:
    """The largest value before each place (0 for the first), by blocks like the sums."""
    n = F.size(values)
    largest = lambda part: F.coalesce(F.array_max(part), F.lit(0))
    blocks = F.transform(_upto(F.ceil(n / _BLOCK).cast("int")), lambda b: largest(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))))

    def places(tops: Column) -> Column:
        before = F.transform(_upto(F.size(tops)), lambda b: largest(F.slice(tops, F.lit(1), b)))
        return _let(before, lambda base: F.transform(_upto(n), lambda i: F.greatest(F.get(base, (i / _BLOCK).cast("int")), largest(
            F.slice(values, (i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)))))

    return _let(blocks, places)


def _merged(spans: Column) -> Column:
    """Spans in order of start, those that overlap as one, with the kind of the longest."""
    n = F.size(spans)

    def group(tops: Column, heads: Column, k: Column) -> Column:
        head, after = F.get(heads, k), F.coalesce(F.get(heads, k + 1), n)
        own = F.slice(spans, head + 1, after - head)
        longest = F.array_max(F.transform(own, lambda s: F.struct((s["end"] - s["start"]).alias("size"), (-s["kind"]).alias("kind"))))
        # All groups before end at or before this one's start.
        end = F.coalesce(F.get(tops, after), F.array_max(F.transform(spans, lambda s: s["end"])))
        return F.struct(F.get(spans, head)["start"].alias("start"), end.alias("end"), (-longest["kind"]).alias("kind"))

    def all_of(tops: Column) -> Column:
        heads = F.filter(_upto(n), lambda i: F.get(spans, i)["start"] >= F.get(tops, i))
        return _let(heads, lambda h: F.transform(_upto(F.size(h)), lambda k: group(tops, h, k)))

    return _let(_let(F.transform(spans, lambda s: s["end"]), _tops), all_of)


_CHUNK = 1024


def _replaced(text: Column, spans: Column) -> Column:
    """The text with a mark for each of the spans, which are apart and in order."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def between(chunks: Column, start: Column, end: Column) -> Column:
        # Places in a string are counted from its start: only the chunks in question are joined.
        first = (start / _CHUNK).cast("int")
        part = F.array_join(F.slice(chunks, first + 1, (end / _CHUNK).cast("int") - first + 1), "")
        return F.substring(part, start % _CHUNK + 1, end - start)

    def cut(chunks: Column, merged: Column) -> Column:
        def piece(k: Column) -> Column:
            here = F.get(merged, k)
            since = F.when(k > 0, F.get(merged, k - 1)["end"]).otherwise(0)
            return F.concat(between(chunks, since, here["start"]), F.element_at(marks, here["kind"] + 1))

        last = F.element_at(merged, -1)["end"]
        rest = F.array(between(chunks, last, F.greatest(last, F.size(chunks) * _CHUNK)))
        return F.array_join(F.concat(F.transform(_upto(F.size(merged)), piece), rest), "")

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(_merged(spans), lambda m: _let(chunks, lambda c: cut(c, m)))).otherwise(text)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with the spans that `find` gives replaced by their kind in brackets; spans
    that overlap are replaced as one, by the kind of the longest."""
    others = [c for c in df.columns if c.lower() != text.lower()]
    row = F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in others])  # never without a field
    # Found once: the model is counted from what is cut later.
    landing = Landing(df.sparkSession, "private-data")
    rows = landing.land(candidates(df.select(row.alias("row"), F.col(f"`{text}`").alias("body")), "body"))
    found = compute_once(accepted(rows, train(rows)), "candidates")
    out = compute_once(found.withColumn("body", _replaced(F.col("body"), F.col("candidates"))), "body")
    return out.select(*[F.col("body").alias(c) if c.lower() == text.lower() else F.col(f"row.`{c}`") for c in df.columns])
