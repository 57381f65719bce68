"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Whole lower-cased texts are counted as hashed n-grams of 1 to 3 characters.  Document frequencies
come from all labelled documents.  The weights are learned by follow-the-regularised-leader with
an elastic net from a bounded sample, ``per_class`` documents of each language with the smallest
hashes of their ids; a fifth of the sample sets the temperature of the probabilities.

Defined cases: a null text or one without a letter is ``und`` with score 0; if nothing is
labelled every text is; documents with a null id or language are not learned from; with one
language every text with a letter is in it with score 1; equal scores go to the first language
by name; repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlake.llm.arrow import parts

BITS = 14
DIMENSION = 1 << BITS
#: The bound of the training sample: documents of each language.
PER_CLASS = 500
#: Texts counted together: at most this many documents, and characters (one text may be longer).
ROWS_AT_ONCE, CHARS_AT_ONCE = 48, 1 << 18
#: Characters of a long text counted at once; n-grams over the seams are counted too.
SEGMENT = 1 << 20
_A, _B, _C = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def _grams(code: np.ndarray) -> Iterator[np.ndarray]:
    """Feature of the n-gram that starts at each character, for n = 1, 2, 3."""
    shift = np.uint32(32 - BITS)
    one = code * _A
    yield (one ^ (one >> np.uint32(15))) * _B >> shift
    two = (one[:-1] ^ (one[:-1] >> np.uint32(13))) + code[1:] * _B
    yield (two ^ (two >> np.uint32(15))) * _C >> shift
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _B + code[2:] * _C
    yield (three ^ (three >> np.uint32(15))) * _A >> shift


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts, one row for each text."""
    out = np.zeros((len(texts), DIMENSION), np.float32)
    codes, rows = [], []
    for row, text in enumerate(texts):
        # a space before and after marks the ends of the text
        text = f" {text.lower()} "
        for at in range(0, max(1, len(text) - 2), SEGMENT):
            codes.append(np.frombuffer(text[at : at + SEGMENT + 2].encode("utf-32-le", "surrogatepass"), np.uint32))
            rows.append((row, at + SEGMENT + 2 < len(text)))
    group: list[int] = []

    def add() -> None:
        code = np.concatenate([codes[i] for i in group])
        row = np.repeat([rows[i][0] for i in group], [len(codes[i]) for i in group])
        end = np.cumsum([len(codes[i]) for i in group])
        # what a segment shares with the next one is counted there
        seam = np.concatenate([np.zeros(0, np.int64)] + [[e - 2, e - 1] for i, e in zip(group, end, strict=True) if rows[i][1]]).astype(np.int64)
        total = np.zeros(len(texts) * DIMENSION)
        for n, feature in enumerate(_grams(code), 1):
            at = row[: len(feature)] * DIMENSION + feature
            ok = np.ones(len(feature), bool)
            for back in range(1, n):
                ok[(end - back)[end - back < len(feature)]] = False
            ok[seam[seam < len(feature)]] = False
            total += np.bincount(at[ok], minlength=len(total))
        out[:] += total.reshape(out.shape)

    size = 0
    for i, code in enumerate(codes):
        if group and size + len(code) > 4 * CHARS_AT_ONCE:
            add()
            group, size = [], 0
        group.append(i)
        size += len(code)
    if group:
        add()
    return out


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows whose texts are counted together."""
    for batch in parts(batches, ROWS_AT_ONCE):
        sizes = np.cumsum([len(t) for t in batch.column(column).to_pylist()])
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, base + CHARS_AT_ONCE, "right")))
            yield batch.slice(at, upto - at)
            at = upto


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (features, languages)
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, counted: np.ndarray) -> np.ndarray:
        x = counted * self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        return (x @ self.weights) / np.maximum(norm, 1e-12)[:, None] + self.bias

    def probabilities(self, counted: np.ndarray) -> np.ndarray:
        return softmax(self.logits(counted).astype(np.float64) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias; ``rows`` are (features, values) with values of length 1."""
    z, n = np.zeros((DIMENSION + 1, classes)), np.zeros((DIMENSION + 1, classes))

    def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], DIMENSION), np.append(rows[i][1], 1.0)
            zi, ni = z[at], n[at]
            w = solved(zi, ni)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
    w = solved(z, n)
    return w[:DIMENSION].astype(np.float32), w[DIMENSION].astype(np.float32)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, on a grid of powers."""
    grid = 2.0 ** np.arange(-5, 5.01, 0.125)
    # half a mistake more than seen, so that a sample without mistakes doesn't give certainty
    smooth = 0.5 / (len(labels) + 1)

    def loss(t: float) -> float:
        p = softmax(logits / t)
        return float(-np.mean((1 - smooth) * np.log(p[np.arange(len(labels)), labels] + 1e-300) + smooth * np.log(p + 1e-300).mean(1)))

    return float(min(grid, key=loss))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_class: int = PER_CLASS) -> Model | None:
    """A model of the labelled documents, None if there are none."""
    rows = labelled.where(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMENSION, np.int64)
        for batch in _texts(batches, 0):
            seen += (counts(batch.column(0).to_pylist()) > 0).sum(0)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["feature", "df"])

    # as many rows as there are features at most
    df = np.zeros(DIMENSION)
    for r in rows.select(text).mapInArrow(frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"]] = r["df"]
    idf = (np.log((1 + sum(sizes.values())) / (1 + df)) + 1).astype(np.float32)

    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), doc_id), 11) / F.lit(float(1 << 53))
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == F.lit(name), F.lit(min(1.0, (per_class + 4 * math.sqrt(per_class)) / n))).otherwise(share)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches, 2):
            counted = counts(batch.column(2).to_pylist())
            at = [np.flatnonzero(c) for c in counted]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([c[a] for c, a in zip(counted, at, strict=True)], pa.list_(pa.float32()))], names=["place", "lang", "at", "n"]
            )

    schema = "place double, lang string, at array<int>, n array<float>"
    sample = sorted(rows.where(place < share).select(place.alias("place"), F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(sparse, schema).collect(), key=lambda r: (r["place"], r["lang"], r["n"]))
    taken = dict.fromkeys(languages, 0)
    features, labels = [], []
    for r in sample:
        if taken[r["lang"]] >= per_class:
            continue
        taken[r["lang"]] += 1
        at = np.array(r["at"], np.int64)
        x = np.array(r["n"]) * idf[at]
        features.append((at, x / np.sqrt(x @ x)))
        labels.append(languages.index(r["lang"]))
    learn = [i for i in range(len(labels)) if i % 5 or len(labels) < 10]
    check = [i for i in range(len(labels)) if i % 5 == 0 or len(labels) < 10]
    weights, bias = train_ftrl([features[i] for i in learn], [labels[i] for i in learn], len(languages))
    model = Model(languages, idf, weights, bias)
    logits = np.array([features[i][1] @ weights[features[i][0]] + bias for i in check], np.float64)
    model.temperature = fit_temperature(logits, np.array([labels[i] for i in check]))
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches, len(kept)):
            texts = batch.column(len(kept)).to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if model is not None:
                p = model.probabilities(counts(texts))
                best = p.argmax(1)
                for i, t in enumerate(texts):
                    if t:
                        names[i], scores[i] = model.languages[best[i]], float(min(1.0, p[i, best[i]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    with_letters = F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).otherwise(F.lit(""))
    return docs.select(*[F.col(f"`{c}`") for c in kept], with_letters.alias("__text")).mapInArrow(run, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; learned from the documents not held out."""
    model = fit(docs.where(~held_out(doc_id)), doc_id, text, lang, per_class)
    return predict(docs.withColumn("held_out", held_out(doc_id)), model, text)
