"""Quality scores from a factorisation machine.

A text becomes a sparse vector: its words hashed to buckets, the shapes of its words, binned statistics of its structure
and its length from the metadata. Next to a weight each feature has a short vector, and the products of the features'
vectors are its pairwise weights: rank ``FACTORS`` for all pairs. Their sum takes one pass over a text's features, as it
is half of the squared sum less the sum of squares in each factor. The model is fitted to a bounded sample of labelled
texts by logistic loss, so that its score is a probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from flowloom.llm.common import word_blocks

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 14, 1 << 10
FACTORS = 8
#: Training uses at most so many labelled documents of each label, chosen by a hash of the document's id.
PER_LABEL = 3000
EPOCHS, BATCH, RATE = 40, 64, 0.05
DECAY, FACTOR_DECAY = 1e-5, 1e-4
#: A document is predicted to be good from this score on.
THRESHOLD = 0.3
_KNOWN = 300_000
_EDGES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64])
_STATISTICS = ("capitals", "digits", "marks", "symbols", "other", "lines", "words", "repeated", "loud", "odd", "bare")
_BINS = len(_EDGES) + 1
_LENGTHS = 40
_FIRST_STATISTIC = WORD_BUCKETS + SHAPE_BUCKETS
_FIRST_LENGTH = _FIRST_STATISTIC + len(_STATISTICS) * _BINS
FEATURES = _FIRST_LENGTH + 2 * _LENGTHS
_SPARSE = StructType([StructField("at", ArrayType(IntegerType())), StructField("x", ArrayType(FloatType()))])
_KIND = np.full(256, 4)  # of a byte: 0 capital, 1 digit, 2 mark, 3 symbol, 4 other, 5 small letter, 6 space
_KIND[ord("A"):ord("Z") + 1], _KIND[ord("0"):ord("9") + 1], _KIND[ord("a"):ord("z") + 1] = 0, 1, 5
_KIND[list(b".,;:!?'\"()-")], _KIND[list(b" \t\n\r\x0b\x0c")] = 2, 6
_KIND[[b for b in range(33, 127) if _KIND[b] == 4]] = 3
_SHAPE = bytes(b"Aa0"[{0: 0, 5: 1, 1: 2}[k]] if k in (0, 1, 5) else (b if k != 4 else ord("x")) for b, k in enumerate(_KIND))
_LETTERS = frozenset(b"Aa0x")


class _Words(dict):
    """What a word contributes: its bucket, its shape's bucket, whether it is all capitals, ends oddly, has no letter."""

    def __missing__(self, word: bytes) -> tuple[int, int, bool, bool, bool]:
        long = word.translate(_SHAPE)
        shape = bytes(b for i, b in enumerate(long[:64]) if i == 0 or b != long[i - 1])
        bare = word.rstrip(b".,;:!?'\")")
        made = (zlib.crc32(word.lower()) % WORD_BUCKETS, WORD_BUCKETS + zlib.crc32(shape) % SHAPE_BUCKETS,
                len(word) > 1 and word.isupper(), bool(bare) and bare.translate(_SHAPE)[-1] not in _LETTERS,
                _LETTERS.isdisjoint(long))
        if len(self) >= _KNOWN:
            self.clear()
        if len(word) <= 64:
            self[word] = made
        return made


def features(text: str | None, n_chars: int | None, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a document's features, by rising place. Words' and shapes' squares each sum to one."""
    data = (text or "").encode()
    found: Counter = Counter()
    for block in word_blocks(data):
        found.update(block)
    kinds = np.zeros(7)
    for start in range(0, len(data), 1 << 20):
        kinds += np.bincount(_KIND[np.frombuffer(data, np.uint8, min(1 << 20, len(data) - start), start)], minlength=7)
    total, size = max(1, found.total()), max(1, len(data))
    held: dict[int, int] = {}
    loud = odd = bare = 0
    for word, n in found.items():
        bucket, shape, capitals, strange, plain = words[word]
        held[bucket] = held.get(bucket, 0) + n
        held[shape] = held.get(shape, 0) + n
        loud += n * capitals
        odd += n * strange
        bare += n * plain
    shares = [kinds[0] / size, kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size,
              data.count(b"\n") / size * 10, len(data) / total / 40, 1 - len(found) / total if found else 0,
              loud / total, odd / total, bare / total]
    bins = np.searchsorted(_EDGES, shares)
    chars = 0 if n_chars is None or n_chars < 0 else min(int(n_chars).bit_length(), _LENGTHS - 2) + 1
    at = sorted(held)
    places = np.array(at + (_FIRST_STATISTIC + np.arange(len(shares)) * _BINS + bins).tolist() + [
        _FIRST_LENGTH + chars, _FIRST_LENGTH + _LENGTHS + min(len(data).bit_length(), _LENGTHS - 1)], dtype=np.int32)
    values = np.sqrt(np.array([held[i] for i in at], dtype=np.float32) / np.float32(total))
    return places, np.concatenate([values, np.full(len(places) - len(at), 0.5, np.float32)])


@dataclass
class Model:
    """Base value, a weight and a vector for each feature. Without labels, everything scores ``base``."""

    base: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        """Base, weights and all pairwise products, in time linear in the number of features."""
        part = self.factors[at] * x[:, None]
        together = part.sum(0)
        return float(self.base + self.weights[at] @ x + 0.5 * (together @ together - (part * part).sum()))


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def learn(rows: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Minimise the logistic loss by steps over small batches, each scaled by the gradients so far (AdaGrad)."""
    rate = min(max(float(wanted.mean()), 1e-3), 1 - 1e-3)
    rng = np.random.default_rng(7)
    used = np.unique(np.concatenate([at for at, _ in rows]))
    v = np.zeros((FEATURES, FACTORS), np.float32)
    v[used] = rng.normal(0, 0.05, (len(used), FACTORS))
    base, w = float(np.log(rate / (1 - rate))), np.zeros(FEATURES, np.float32)
    seen_b, seen_w, seen_v = 1e-2, np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, FACTORS), 1e-2, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            batch = order[start:start + BATCH]
            here = np.unique(np.concatenate([rows[i][0] for i in batch]))
            x = np.zeros((len(batch), len(here)), np.float32)
            for k, i in enumerate(batch):
                x[k, np.searchsorted(here, rows[i][0])] = rows[i][1]
            vh, square = v[here], x * x
            s = x @ vh
            margin = base + x @ w[here] + 0.5 * ((s * s).sum(1) - square @ (vh * vh).sum(1))
            g = ((_logistic(margin) - wanted[batch]) / len(batch)).astype(np.float32)
            dw = x.T @ g + DECAY * w[here]
            dv = x.T @ (g[:, None] * s) - (square.T @ g)[:, None] * vh + FACTOR_DECAY * vh
            db = float(g.sum())
            seen_b += db * db
            seen_w[here] += dw * dw
            seen_v[here] += dv * dv
            base -= RATE * db / seen_b ** 0.5
            w[here] -= RATE * dw / np.sqrt(seen_w[here])
            v[here] -= RATE * dv / np.sqrt(seen_v[here])
    return Model(base, w, v)


def fit(labelled: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from ``labelled`` (key, text, n_chars, label of 0 or 1); rows with a NULL key or another label teach nothing.

    At most ``per_label`` documents of each label are used, the first by a hash of the key; only their features reach the
    driver. A thinned sample keeps the share of each label, so scores stay probabilities.
    """
    rows = labelled.where("key is not null and label in (0, 1)")
    counts = {int(r[0]): r[1] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return Model(0.0, np.zeros(FEATURES, np.float32), np.zeros((FEATURES, FACTORS), np.float32))
    most = min(1.0, per_label / max(counts.values()))

    @F.pandas_udf(_SPARSE)
    def sparse(text: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        words = _Words()
        made = [features(t, None if pd.isna(n) else int(n), words) for t, n in zip(text, n_chars, strict=True)]
        return pd.DataFrame({"at": pd.Series([a for a, _ in made], dtype=object),
                             "x": pd.Series([x for _, x in made], dtype=object)})

    order = F.xxhash64("key", F.lit("quality"))
    thinned = rows.where(F.pmod(order, F.lit(1 << 30)) < int(min(1.0, 1.5 * most) * (1 << 30))).withColumn("order", order)
    share = F.ceil(F.lit(most) * F.element_at(F.create_map(*[F.lit(x) for n in counts.items() for x in n]), F.col("label")))
    first = Window.partitionBy("label").orderBy("order", "key")
    sample = thinned.withColumn("place", F.row_number().over(first)).where(F.col("place") <= share).select(
        "label", "place", sparse("text", "n_chars").alias("f")).select("label", "place", "f.at", "f.x").toPandas()
    sample = sample.sort_values(["place", "label"])
    return learn([(np.asarray(a, np.int32), np.asarray(x, np.float32)) for a, x in zip(sample["at"], sample["x"], strict=True)],
                 sample["label"].to_numpy(np.float32))


def score(model: Model, spark) -> Column:
    """A column function: (text, n_chars) to the probability that the document is good."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        words, model = _Words(), held.value
        margins = [model.margin(*features(t, None if pd.isna(n) else int(n), words)) for t, n in zip(text, n_chars, strict=True)]
        return pd.Series(_logistic(np.array(margins, dtype=float)))

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose crc32 of the id as text is divisible by 5; NULL ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all of ``documents`` (doc_id, text, n_chars) after ``labels`` (doc_id, quality): doc_id, held_out, score, predicted.

    Labels of documents that are held out are not read. NULL text counts as empty, and an empty text is scored by its
    structure and length alone. Several labels of one document, or several rows under one doc_id, each teach; repeated
    rows get equal scores; without labels every score is 0.5; an empty table gives no rows.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    rows = documents.where("doc_id is not null").select(F.col("doc_id").alias("key"), "text", "n_chars")
    model = fit(rows.join(known, "key"))
    found = documents.select("doc_id", held_out().alias("held_out"),
                             score(model, documents.sparkSession)("text", "n_chars").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
