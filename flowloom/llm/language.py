"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams (lengths 1 to 3, presence only) that both have, over the geometric
mean of their own numbers: a blended-spectrum presence kernel. N-grams are letters in lower case with every stretch of
anything else as one space; they are folded into ``BUCKETS`` presence bits by a fixed hash. A Nyström map through
landmark texts and one-versus-rest ridge regression give a score per language, so a batch of documents is scored by
two matrix products: presence with landmarks, and kernel values with coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

BUCKETS = 1 << 14
LENGTHS = (1, 2, 3)
#: Training uses at most this many labelled documents of each language, and this many of them in all as landmarks.
PER_LANGUAGE = 400
LANDMARKS = 128
RIDGE = 1e-3
PIECE = 1 << 20
DOCUMENTS = 256
UNDETERMINED = "und"
_SPACE = 32
_PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


@cache
def _letters() -> np.ndarray:
    """For each code of the basic plane, its lower-case letter, or a space if it is no letter."""
    out = np.full(1 << 16, _SPACE, dtype=np.uint64)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low[0]) if len(low) else code
    return out


def letter_codes(text: str) -> np.ndarray:
    """Lower-case letters of ``text`` as numbers, with one space for each stretch of other characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    high = codes >= 1 << 16
    out = _letters()[np.where(high, _SPACE, codes)]
    if high.any():
        for code in np.unique(codes[high]).tolist():
            if chr(code).isalpha():
                out[codes == code] = ord(chr(code).lower()[0])
    space = out == _SPACE
    return out[np.append(True, ~(space[1:] & space[:-1]))]


def presence(text: str | None) -> np.ndarray | None:
    """Which n-gram buckets a text has; None if it is NULL or has no letter. A long text is read piece by piece."""
    found, any_letter, tail = np.zeros(BUCKETS, dtype=bool), False, np.zeros(0, dtype=np.uint64)
    for start in range(0, len(text or ""), PIECE):
        fresh = letter_codes(text[start:start + PIECE])
        any_letter = any_letter or bool((fresh != _SPACE).any())
        if tail.size and tail[-1] == _SPACE and fresh[0] == _SPACE:
            fresh = fresh[1:]
        codes = np.concatenate([tail if start else np.array([_SPACE], dtype=np.uint64), fresh])
        if start + PIECE >= len(text):
            codes = np.append(codes, np.uint64(_SPACE))
        mixed = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            if len(codes) < n:
                break
            mixed = mixed[:len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1:]
            if n in LENGTHS:
                bucket = ((mixed + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
                found[bucket.astype(np.int64)] = True
        tail = codes[-(max(LENGTHS) - 1):]
    return found if any_letter else None


@dataclass
class Model:
    """Landmarks as packed presence bits, and the coefficients of their kernel values for each language."""

    languages: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray
    bias: np.ndarray

    def scores(self, found: np.ndarray) -> np.ndarray:
        """One-versus-rest scores of presence rows: (documents x buckets) (buckets x landmarks) (landmarks x languages)."""
        marks = getattr(self, "_marks", None)
        if marks is None:
            marks = np.unpackbits(self.landmarks, axis=1)[:, :BUCKETS].astype(np.float32)
            self._marks = marks = marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
        kernel = (found.astype(np.float32) @ marks.T) / np.sqrt(np.maximum(found.sum(1, keepdims=True), 1))
        return kernel @ self.coefficients + self.bias

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_marks"}


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None]
    return (a.astype(np.float32) @ b.astype(np.float32).T).astype(float) / size


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from ``labelled`` (key, text, lang); rows with NULL lang or no letter teach nothing.

    At most ``per_language`` documents of each language are used, chosen by a hash of ``key``; only their presence bits
    reach the driver. Without labelled rows the model has no language.
    """
    rows = labelled.where("lang is not null and key is not null")
    order = F.xxhash64("key", F.lit("language"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((0, BUCKETS // 8), np.uint8), np.zeros((0, 0)), np.zeros(0))
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (
        lang, min(1.0, 4 * per_language / n))]), F.col("lang"))
    thinned = rows.withColumn("order", order).where(F.pmod("order", F.lit(1_000_000)) < rate * 1_000_000)

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        found = (presence(t) for t in text)
        return pd.Series([None if p is None else np.packbits(p).tobytes() for p in found])

    packed = packed.asNondeterministic()  # else the filter would compute it a second time
    first = Window.partitionBy("lang").orderBy("order", "key")
    sample = thinned.select("lang", "order", "key", packed("text").alias("bits")).where("bits is not null").withColumn(
        "place", F.row_number().over(first)).where(F.col("place") <= per_language).select("lang", "place", "bits").collect()
    if not sample:
        return Model([], np.zeros((0, BUCKETS // 8), np.uint8), np.zeros((0, 0)), np.zeros(0))
    sample.sort(key=lambda r: (r["place"], r["lang"]))
    languages = sorted({r["lang"] for r in sample})
    bits = np.array([np.frombuffer(r["bits"], np.uint8) for r in sample])
    found = np.unpackbits(bits, axis=1)[:, :BUCKETS].astype(bool)
    wanted = np.array([[1.0 if r["lang"] == lang else -1.0 for lang in languages] for r in sample])
    marks = found[:landmarks]
    values, vectors = np.linalg.eigh(_kernel(marks, marks))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    mapped = _kernel(found, marks) @ root
    centre, level = mapped.mean(0), wanted.mean(0)
    inner = (mapped - centre).T @ (mapped - centre) + ridge * len(mapped) * np.eye(mapped.shape[1])
    weights = np.linalg.solve(inner, (mapped - centre).T @ (wanted - level))
    return Model(languages, bits[:landmarks], root @ weights, level - centre @ weights)


def predict(model: Model):
    """A column function: text to (lang_pred, score). The score is the best one-versus-rest value, brought to 0..1."""

    @F.pandas_udf(_PREDICTION)
    def classify(text: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        values = text.tolist()
        for start in range(0, len(values), DOCUMENTS):
            found = [presence(t) for t in values[start:start + DOCUMENTS]]
            place = [i for i, p in enumerate(found) if p is not None]
            label, score = [UNDETERMINED] * len(found), [0.0] * len(found)
            if place and model.languages:
                f = model.scores(np.array([found[i] for i in place]))
                best = f.argmax(1)
                for i, b, row in zip(place, best, f, strict=True):
                    label[i], score[i] = model.languages[b], float(min(1.0, max(0.0, (row[b] + 1) / 2)))
            names += label
            scores += score
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return classify.asNondeterministic()  # else a filter on the prediction would compute it a second time


def held_out(doc_id: str = "doc_id"):
    """Documents whose crc32 of the id as text leaves 2 when divided by 4; NULL ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """Learn from ``documents`` (doc_id, text, lang) that aren't held out and predict all: doc_id, held_out, lang_pred, score.

    A text that is NULL or has no letter is ``und`` with score 0, as is every text if no label can be learned. Repeated
    rows get equal predictions; an empty table gives no rows.
    """
    known = documents.where(~held_out() & F.col("doc_id").isNotNull())
    model = fit(known.select(F.col("doc_id").alias("key"), "text", "lang"))
    found = documents.select("doc_id", held_out().alias("held_out"), predict(model)("text").alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
