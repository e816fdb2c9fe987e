"""Language identification by error-correcting output codes.

Each language has a codeword. One binary n-gram classifier per bit predicts on which side of
the bit a text's language is; the language whose codeword costs least, every bit weighted by
how well it separates the training texts, is chosen. Close runners-up are flagged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.frames import sampled

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Buckets of hashed n-grams of 1 to 3 characters.
BUCKETS = 1 << 14
_MARKS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_COUNTS = "array<struct<lang:int,bucket:int,n:double>>"
_PREDICTED = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


_IS_LETTER = _letters()


def gram_buckets(text: str) -> np.ndarray:
    """Buckets of a text's n-grams, lower-cased, every run of other characters one space."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    codes = np.where(_IS_LETTER[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF), codes, 32).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    one = codes * _MARKS[0]
    two = one[:-1] * np.uint32(31) + codes[1:] * _MARKS[1]
    three = two[:-1] * np.uint32(31) + codes[2:] * _MARKS[2]
    grams = np.concatenate([one, two, three])
    return ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64)


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 for each language, of well separated rows and no useless columns.

    Of many random codes, the one whose closest pair of rows differs most.
    """
    if languages < 2:
        return np.ones((languages, 1))
    rng, bits, best, apart = np.random.default_rng(seed), 7 + 4 * int(np.ceil(np.log2(languages))), None, -1
    for _ in range(400):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        if (np.abs(code.sum(axis=0)) == languages).any():
            continue
        differ = (bits - code @ code.T) / 2
        closest = differ[~np.eye(languages, dtype=bool)].min()
        if closest > apart:
            best, apart = code, closest
    if best is None:
        ids = np.arange(languages)
        best = np.where((ids[:, None] >> np.arange(int(languages - 1).bit_length())) & 1, 1.0, -1.0)
    return best


@dataclass(frozen=True)
class LanguageModel:
    """Codewords and bit classifiers; its size depends on the number of languages only."""

    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, log-odds of an n-gram
    bias: np.ndarray  # bits
    scale: np.ndarray  # bits
    trust: np.ndarray  # bits

    def margins(self, text: str) -> np.ndarray:
        """Signed confidence of each bit classifier."""
        buckets, counts = np.unique(gram_buckets(text), return_counts=True)
        return (counts @ self.weights[buckets] / counts.sum() - self.bias) * self.scale

    def predict(self, text: str | None, ambiguous_below: float) -> tuple[str, float, bool]:
        """Language, share of the belief it holds, whether another is about as near."""
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        losses = np.logaddexp(0.0, -self.code * self.margins(text)) @ self.trust
        order = np.argsort(losses, kind="stable")
        belief = np.exp(losses[order[0]] - losses)
        gap = losses[order[1]] - losses[order[0]]
        return self.languages[order[0]], float(belief[order[0]] / belief.sum()), bool(gap < ambiguous_below)


def train(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 3_000,
) -> LanguageModel:
    """Bit classifiers from rows with text and language.

    Fitted on whole texts of about ``per_language`` rows of each language, chosen by a hash of
    the key. Tasks count n-grams, every text weighing the same; the counts of each language,
    at most ``BUCKETS`` numbers, give the naive Bayes log-odds of all bits. Rows with null
    text or language are left out. Without rows the model knows no language.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    totals = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).alias("lang")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(totals)
    code = codewords(len(languages))
    if not languages:
        return LanguageModel([], code, *[np.empty(0)] * 4)
    chosen = F.lit(False)
    for name in languages:
        chosen = chosen | ((F.col(lang) == name) & sampled(F.col(key), per_language, totals[name]))
    ids = {name: i for i, name in enumerate(languages)}
    sample = rows.where(chosen).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    @F.arrow_udf(_COUNTS)
    def grams(texts: pa.Array, langs: pa.Array) -> pa.Array:
        counts = np.zeros((len(languages), BUCKETS))
        for value, name in zip(texts.to_pylist(), langs.to_pylist()):
            if LETTER.search(value):
                found = np.bincount(gram_buckets(value), minlength=BUCKETS)
                counts[ids[name]] += found / np.sqrt(found.sum())
        # all counts of a batch stand in its first row
        out = [{"lang": k, "bucket": int(b), "n": float(counts[k, b])}
               for k in range(len(languages)) for b in np.flatnonzero(counts[k])]
        kind = pa.list_(pa.struct([("lang", pa.int32()), ("bucket", pa.int32()), ("n", pa.float64())]))
        return pa.array([out, *[[]] * (len(texts) - 1)], kind)

    counts = np.zeros((len(languages), BUCKETS))
    summed = sample.select(F.explode(grams("text", "lang")).alias("c")).groupBy("c.lang", "c.bucket").agg(
        F.sum("c.n").alias("n"))
    for part in summed.toLocalIterator():
        counts[part["lang"], part["bucket"]] = part["n"]
    return fit(languages, code, counts)


def fit(languages: list[str], code: np.ndarray, counts: np.ndarray) -> LanguageModel:
    """Naive Bayes log-odds per bit, centred between the languages on either side.

    A bit's scale makes the mean distance of the languages from its centre 4, and its trust is
    the least such distance in these units: a bit that hardly separates some language from the
    other side hardly counts.
    """
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-9)
    smooth = 0.1 / BUCKETS
    weights, bias, scale, trust = [], [], [], []
    for bit in code.T:
        ahead, behind = share[bit > 0].mean(axis=0), share[bit < 0].mean(axis=0) if (bit < 0).any() else 0 * share[0]
        odds = np.log((ahead + smooth) / (behind + smooth))
        means = share @ odds
        lowest, highest = means[bit > 0].min(), means[bit < 0].max() if (bit < 0).any() else 0.0
        middle = (lowest + highest) / 2
        away = np.maximum(np.abs(means - middle).mean(), 1e-9)
        weights.append(odds)
        bias.append(middle)
        scale.append(4.0 / away)
        trust.append(min(1.0, max((lowest - highest) / 2 / away, 0.05)))
    return LanguageModel(languages, code, np.array(weights, np.float32).T.copy(), np.array(bias),
                         np.array(scale), np.array(trust))


def predict_language(text: Column, model: LanguageModel, ambiguous_below: float = 1.0) -> Column:
    """(lang, score, ambiguous) of a text column; a null text or one without letters is ``und``."""

    @F.arrow_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def predicted(texts: pa.Array) -> pa.Array:
        found = [model.predict(t, ambiguous_below) for t in texts.to_pylist()]
        return pa.array([{"lang": a, "score": b, "ambiguous": c} for a, b, c in found], _PREDICTED)

    return predicted(text)


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    """True for the rows kept out of training: the key's checksum leaves ``part``."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                       out: str = "language") -> DataFrame:
    """``docs`` with (lang, score, ambiguous) of every whole text in ``out``.

    Learns from rows that are not held out and have text and language; predictions read the
    text only. A column called ``out`` is replaced; a null key is not held out.
    """
    model = train(docs.where(~held_out(F.col(key))), key, text, lang)
    return docs.withColumn(out, predict_language(F.col(text), model))
