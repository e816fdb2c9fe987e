"""Secret scans: fixed patterns, and Markov models of random and of ordinary strings.

Two first-order Markov models over ASCII give the likelihood of a token as a random string and
as an ordinary identifier; the mean log-likelihood ratio per character pair decides. Both are
trained from samples labelled by the fixed patterns.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.frames import sampled

# Names, patterns and least lengths of the base kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: Words of which an assignment needs one, to skip texts without any.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Strings that may be secrets. A hex run of 32 lies inside such a token.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.S)
METHOD = "markov"
#: Pairs of letters in the table of pairs.
LETTERS = np.array([chr(c).isalpha() for c in range(128)])
LETTER_PAIRS = np.outer(LETTERS, LETTERS).reshape(-1)
#: Added to the threshold for tokens without a digit, so that joined words don't count.
WITHOUT_DIGIT = 1.3
#: Added to each count of a character pair before it becomes a likelihood.
ORDINARY_SMOOTHING, RANDOM_SMOOTHING = 0.5, 8.0

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_COUNTS = "array<struct<label:int,pair:int,n:bigint>>"


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, place of the kind, end, start of the value, end of the value), sorted."""
    found = []
    lowered = text.lower()
    if any(name in lowered for name in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                found.append((m.start(), 1, m.end(), m.start(), m.end()))
    for token in TOKEN.finditer(text):
        if token.end() - token.start() >= LEAST_HEX:
            for m in HEX.finditer(text, token.start(), token.end()):
                if m.end() - m.start() >= LEAST_HEX:
                    found.append((m.start(), 2, m.end(), m.start(), m.end()))
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens that are no ordinary text in training: long, with a digit and a letter."""
    return [m.span() for m in TOKEN.finditer(text) if MIXED.match(m.group())]


def pairs(token: str) -> np.ndarray:
    """Places of a token's character pairs in a 128 x 128 table."""
    codes = np.frombuffer(token.encode("ascii"), np.uint8).astype(np.int64)
    return codes[:-1] * 128 + codes[1:]


def is_random(token: str, ratios: np.ndarray, threshold: float) -> bool:
    """Whether a token's mean log-likelihood ratio is above the threshold.

    Without a digit only pairs of letters count, as the signs between joined words are rare in
    ordinary text, and the threshold is stricter; signs alone are never random.
    """
    places = pairs(token)
    if not any(c.isdigit() for c in token):
        places, threshold = places[LETTER_PAIRS[places]], threshold + WITHOUT_DIGIT
    return len(places) > 0 and bool(ratios[places].mean() > threshold)


def _pair_counts(codes: np.ndarray) -> np.ndarray:
    if len(codes) < 2:
        return np.zeros(128 * 128, np.int64)
    return np.bincount(codes[:-1] * 128 + codes[1:], minlength=128 * 128)


def labelled_counts(texts: list[str | None]) -> np.ndarray:
    """Character pairs of ordinary text (row 0) and of the values of base spans (row 1).

    Long tokens with a digit and a letter that are in no base span have no label and count in
    neither; those of letters only or digits only count as ordinary.
    """
    counts = np.zeros((2, 128 * 128), np.int64)
    for text in texts:
        if not text:
            continue
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        codes[codes > 127] = 0
        inside, other = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        for _, _, _, start, end in base_spans(text):
            inside[start:end] = True
        for start, end in candidates(text):
            other[start:end] = True
        counts[0] += _pair_counts(np.where(inside | other, 0, codes))
        if inside.any():
            counts[1] += _pair_counts(np.where(inside, codes, 0))
    return counts


def _labelled_pairs(text: Column) -> Column:
    @F.arrow_udf(_COUNTS)
    def counted(texts: pa.Array) -> pa.Array:
        counts = labelled_counts(texts.to_pylist())
        # all counts of a batch stand in its first row
        rows = [{"label": label, "pair": int(p), "n": int(counts[label, p])}
                for label in (0, 1) for p in np.flatnonzero(counts[label])]
        kind = pa.list_(pa.struct([("label", pa.int32()), ("pair", pa.int32()), ("n", pa.int64())]))
        return pa.array([rows, *[[]] * (len(texts) - 1)], kind)

    return counted(text)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 20_000) -> np.ndarray:
    """Log-likelihood ratio of random against ordinary for each character pair.

    Fitted on whole texts of about ``sample`` documents, chosen by a hash of the key: values
    inside base spans are labelled random, the text around them ordinary. Transitions of the
    random model are smoothed towards all token characters being equally likely, so with few
    labelled secrets, or none, a random string is an evenly mixed one; those of the ordinary
    model towards the frequencies of its characters.
    """
    chosen = docs.where(F.col(text).isNotNull())
    chosen = chosen.where(sampled(F.col(key), sample, docs.count())).select(
        F.explode(_labelled_pairs(F.col(text))).alias("c"))
    counts = np.zeros((2, 128, 128))
    for row in chosen.groupBy("c.label", "c.pair").agg(F.sum("c.n").alias("n")).collect():
        counts[row["label"], row["pair"] // 128, row["pair"] % 128] = row["n"]
    used = np.array([bool(TOKEN.fullmatch(chr(c) * 16)) for c in range(128)])
    letters = counts[0].sum(axis=0) * used + ORDINARY_SMOOTHING * used
    smooth = np.stack([np.outer(used, letters / letters.sum()) * ORDINARY_SMOOTHING * used.sum(),
                       np.outer(used, used) * RANDOM_SMOOTHING])
    chance = counts * used + smooth
    with np.errstate(divide="ignore", invalid="ignore"):
        chance = chance / chance.sum(axis=2, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log(chance[1] / chance[0])
    return np.nan_to_num(ratio, nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32).reshape(-1)


def find_secrets(text: Column, ratios: np.ndarray, threshold: float = 0.7) -> Column:
    """Spans of secrets in a text column as an array of (kind, start, end), by start and kind.

    Offsets count code points, ``end`` is exclusive. Base kinds come from the fixed patterns,
    left to right without overlap per kind, matches that are too short dropped. ``markov``
    spans are tokens of 16 or more characters that touch no base span and have a mean
    log-likelihood ratio above ``threshold``; without a digit, over the pairs of letters and
    above ``threshold + WITHOUT_DIGIT``. Null and empty texts have no spans. The ratios are 16,384 numbers, whatever the corpus.
    """

    def spans(value: str | None) -> list[dict]:
        if not value:
            return []
        base = base_spans(value)
        found = [(s, k, e) for s, k, e, _, _ in base]
        for start, end in (m.span() for m in TOKEN.finditer(value)):
            apart = all(end <= s or e <= start for s, _, e, _, _ in base)
            if apart and is_random(value[start:end], ratios, threshold):
                found.append((start, len(KINDS), end))
        return [{"kind": (*KINDS, METHOD)[k], "start": s, "end": e} for s, k, e in sorted(found)]

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([spans(t) for t in texts.to_pylist()], _SPANS)

    return scan(text)


def scan_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "secrets", threshold: float = 0.7,
) -> DataFrame:
    """``docs`` with the spans of every whole text in ``out``; a column of that name is replaced."""
    ratios = train(docs, key, text)
    return docs.withColumn(out, find_secrets(F.col(text), ratios, threshold))
