"""Secrets in texts: fixed patterns, and a battery of randomness tests.

Base patterns find credentials by their form.  The battery looks at every other
token that could be key material: its encoding is inferred (hexadecimal, base32,
base58, base64 or base64url; two kinds of characters at least), its symbols are
mapped to 0..A-1, and three tests ask whether they look uniform and independent:

* chi-squared of the symbol counts against a uniform alphabet,
* runs above and below the middle of the alphabet,
* serial correlation of neighbouring symbols.

A token that one of them refutes clearly is no key.  Most short tokens pass, so
what has to be controlled are false discoveries of ordinary text.  A token's
p-value is the chance that ordinary text of its length looks as random: as
little repetition (a noncentral chi-squared, as symbols of words repeat) and as
many runs of one kind of character (binomial, as words, names and numbers hold
together), both combined after Fisher.  Benjamini-
Hochberg control of the false discovery rate is applied to all candidates of the
corpus, separately for each class of lengths: the p-values are binned, the
bounded histogram is aggregated, and each class gets its threshold from it.

Offsets are code points, ends exclusive.  Null and empty texts have no spans;
texts are scanned whole.  Repeated rows are scanned alike and each counts as a
test.  Other columns play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, exp, lgamma, log, log1p, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash, texts, unused

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

#: Symbols in the order of their values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
VALUES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
#: Chance that two symbols of ordinary tokens are equal, at least: less than in prose, as tokens mix kinds of characters; twice that of a uniform draw in small alphabets.
TEXT_REPEATS = 0.05
#: Chance that the kind of character changes from one symbol of ordinary tokens to the next, with both cases and with one.
TEXT_CHANGES, ONE_CASE_CHANGES = 0.2, 0.1
ONE_CASE = ("hex", "HEX", "base32")


@dataclass(frozen=True)
class SecretParams:
    rate: float = 0.01
    #: p-value under randomness at which one test of the battery refutes a token.
    refuted: float = 0.001
    #: Lower ends of the classes of lengths.
    lengths: tuple[int, ...] = (0, 24, 32, 40, 48, 64, 96, 128)
    #: Bins of -log10(p), of a tenth each.
    bins: int = 400


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns' matches, by start and kind."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def infer(token: str) -> str | None:
    """The smallest encoding that holds a token, if the token mixes kinds of characters."""
    kinds = bool(re.search("[a-z]", token)) + bool(re.search("[A-Z]", token)) + bool(re.search("[0-9]", token))
    if kinds < 2:
        return None
    return next((name for name, values in VALUES.items() if all(c in values for c in token)), None)


def _normal_tail(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


#: Least p-value that is told from 0.
TINY = 1e-300


def uniform_p(x: float, df: int) -> float:
    """Upper tail of a chi-squared (cube root approximation after Wilson and Hilferty)."""
    return max(TINY, _normal_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df))))


def text_tail(x: float, n: int, a: int) -> float:
    """P that the chi-squared of ordinary text is at most x: lower tail of a noncentral one (normal by a power, after Sankaran)."""
    df, shift = a - 1, n * (max(a * TEXT_REPEATS, 2) - 1)
    mean = df + shift
    h = 1 - 2 * mean * (df + 3 * shift) / (3 * (df + 2 * shift) ** 2)
    p = (df + 2 * shift) / mean**2
    m = (h - 1) * (1 - 3 * h)
    z = ((max(x, 1e-9) / mean) ** h - (1 + h * p * (h - 1 - (2 - h) * m * p / 2))) / (h * sqrt(2 * p) * (1 + m * p / 2))
    return _normal_tail(-z)


def chi_squared(values: np.ndarray, a: int) -> float:
    """Distance of a token's symbol counts from uniform ones."""
    counts = np.bincount(values, minlength=a)
    return float((counts * counts).sum()) * a / len(values) - len(values)


def battery(values: np.ndarray, a: int) -> tuple[float, float, float]:
    """p-values of a token's symbols under randomness: chi-squared, runs and serial correlation."""
    n = len(values)
    p_chi = uniform_p(chi_squared(values, a), a - 1)
    high = values >= a / 2
    n1, n2 = int(high.sum()), n - int(high.sum())
    if not n1 or not n2:
        return p_chi, TINY, TINY
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * n1 * n2 / n
    spread = sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    p_runs = 2 * _normal_tail(abs(runs - mean) / spread)
    d = values - values.mean()
    r = float((d[1:] * d[:-1]).sum() / max((d * d).sum(), 1e-9))
    return p_chi, max(TINY, p_runs), max(TINY, 2 * _normal_tail(abs(r + 1 / n) * sqrt(n)))


KIND = {c: k for k, run in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")) for c in run}


def changes(token: str) -> int:
    """How often the kind of character changes; a capital and its word are one kind, and other signs are of the kind before them."""
    kinds = [KIND[c] for c in token if c in KIND]
    return sum(x != y and (x, y) != (0, 1) for x, y in zip(kinds, kinds[1:]))


def at_least(x: int, n: int, q: float) -> float:
    """P that a binomial of n draws is at least x."""
    if x <= 0:
        return 1.0
    j = np.arange(x, n)
    first = lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * log(q) + (n - x) * log1p(-q)
    steps = np.concatenate(([0.0], np.cumsum(np.log((n - j) / (j + 1) * q / (1 - q)))))
    return min(1.0, float(np.exp(first + steps).sum()))


def combined(p: float, q: float) -> float:
    """Fisher's combination of two p-values."""
    product = max(TINY, p) * max(TINY, q) or TINY
    return min(1.0, product * (1 - log(product)))


def text_p(x: float, n_changes: int, n: int, name: str) -> float:
    """P that ordinary text of n symbols in an encoding has a chi-squared of at most x and as many changes of kind."""
    q = ONE_CASE_CHANGES if name in ONE_CASE else TEXT_CHANGES
    return combined(text_tail(x, n, len(ALPHABETS[name])), at_least(n_changes, n - 1, q))


def judge(token: str, refuted: float = SecretParams.refuted) -> float | None:
    """The p-value of a token under ordinary text, 1 if a test refutes it; None if it is no candidate."""
    token = token.rstrip("=")
    name = infer(token)
    if name is None:
        return None
    values, a = np.array([VALUES[name][c] for c in token]), len(ALPHABETS[name])
    if min(battery(values, a)) < refuted:
        return 1.0
    return text_p(chi_squared(values, a), changes(token), len(values), name)


def random_spans(text: str, base: list[tuple[int, int, int]], params: SecretParams) -> list[tuple[int, int, int, int]]:
    """(start, end, class of length, bin of the p-value) of candidates that no base span touches; ``base`` is sorted by start."""
    starts, reach = [s for _, s, _ in base], []
    for _, _, e in base:  # how far the spans up to each one reach
        reach.append(max(e, reach[-1]) if reach else e)
    found = []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        before = bisect_right(starts, end - 1)
        if before and reach[before - 1] > start:
            continue
        p = judge(m.group(), params.refuted)
        if p is not None:
            of_length = sum(end - start >= low for low in params.lengths) - 1
            found.append((start, end, of_length, min(params.bins - 1, int(-10 * np.log10(max(p, TINY))))))
    return found


SCANNED = "doc_id bigint, th bigint, base array<struct<kind:int,start:int,end:int>>, candidates array<struct<start:int,end:int,len:int,bin:int>>"
_INT = pa.int32()
_BASE = pa.list_(pa.struct([("kind", _INT), ("start", _INT), ("end", _INT)]))
_CANDIDATES = pa.list_(pa.struct([("start", _INT), ("end", _INT), ("len", _INT), ("bin", _INT)]))


def scan(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """Base spans and candidates of every text: one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, more = [], []
            for text in b.column("text").to_pylist():
                spans = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
                more.append([dict(zip(("start", "end", "len", "bin"), s)) for s in random_spans(text, spans, params)])
            arrays = [b.column("doc_id"), b.column("th"), pa.array(base, _BASE), pa.array(more, _CANDIDATES)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "base", "candidates"])

    return texts(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, SCANNED)


def thresholds(histogram: dict[tuple[int, int], int], params: SecretParams) -> list[int]:
    """For each class of lengths the least bin that Benjamini-Hochberg rejects; ``bins`` if none.

    A bin counts with the largest p-value that it may hold.
    """
    found = []
    for k in range(len(params.lengths)):
        tests, passed, least = sum(n for (c, _), n in histogram.items() if c == k), 0, params.bins
        for b in range(params.bins - 1, -1, -1):
            passed += histogram.get((k, b), 0)
            if passed and 10 ** (-b / 10) <= params.rate * passed / tests:
                least = b
        found.append(least)
    return found


def find_secrets(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, th (hash of the text) and spans (array of kind, start, end by start and kind) of every text; base spans first judged, random ones added."""
    scanned = stash(scan(docs, params))
    each = scanned.select(F.explode("candidates").alias("c")).groupBy("c.len", "c.bin").agg(F.count("*").alias("n"))
    least = thresholds({(x["len"], x["bin"]): x["n"] for x in each.collect()}, params)
    passes = lambda c: c["bin"] >= F.element_at(F.array(*map(F.lit, least)), c["len"] + 1)
    added = F.transform(F.filter("candidates", passes), lambda c: F.struct(F.lit(3).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    ordered = F.array_sort(F.transform(F.concat("base", added), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return scanned.select("doc_id", "th", ordered.alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])))


def digest_secrets(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """Counts and digests of the spans of every text."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return find_secrets(docs, params).select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


SPANS = "array<struct<start:int,end:int,len:int,bin:int>>"
_SPANS = pa.list_(pa.struct([("start", _INT), ("end", _INT), ("len", _INT), ("bin", _INT)]))


def mask_secrets(docs: DataFrame, params: SecretParams = SecretParams(), mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by a mark and n_chars (if there is such a column) brought up to date.

    Each text is scanned once; the documents are written beside their spans and
    reread when the thresholds of the battery are known, so no text is shuffled.
    """
    names, (held,) = docs.columns, unused(docs, "spans")
    schema = T.StructType([*docs.schema.fields, T.StructField(held, T._parse_datatype_string(SPANS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                # Base spans have no class of length, so they always count.
                spans = [(s, e, -1, 0) for _, s, e in base] + random_spans(text or "", base, params)
                rows.append([dict(zip(("start", "end", "len", "bin"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(rows, _SPANS)], [*names, held])

    scanned = stash(docs.mapInArrow(run, schema))
    each = scanned.select(F.explode(held).alias("c")).where("c.len >= 0").groupBy("c.len", "c.bin").agg(F.count("*").alias("n"))
    least = thresholds({(x["len"], x["bin"]): x["n"] for x in each.collect()}, params)

    @F.pandas_udf("string")
    def masked(given: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(x) else replace(t, x, least, mark) for t, x in zip(given, spans)], dtype=object)

    out = scanned.withColumn("text", masked(F.col("text"), F.col(held))).drop(held)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def replace(text: str, spans: list[dict], least: list[int], mark: str) -> str:
    """A text with the spans that count, joined where they overlap, replaced by a mark."""
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans if s["len"] < 0 or s["bin"] >= least[s["len"]]):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])
