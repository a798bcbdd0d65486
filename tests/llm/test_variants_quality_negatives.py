"""Spelling variants, quality scores and hard negatives: nulls, ties, repeated and clashing rows, brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from flowloom.llm import negatives, quality, spelling
from flowloom.llm.common import prepare
from test_text_operators import docs, empty, key  # noqa: F401

# --- 11


def plain_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[at + 1:] == long[at + 1:] if len(a) == len(b) else short[at:] == long[at + 1:]


def plain_variants(rows):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{word}".encode())
            if h % 31 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in counts if plain_near(v, w)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return out


def test_variants_against_brute_force(spark):
    prepare(spark)
    texts = ["separate seperate " + "separate " * 12, "SEPARATE Seperate, separately seperately", "separatee separatee x",
             "éclairée éclairée eclairée eclairée", "hello helllo bookkeeper bookeeper bookkeeper bookeeper",
             None, "", "123 456", "accommodate " * 300, "acommodate " * 25, "acomodate " * 2, "aaaaaaa aaaaaaaa " * 2]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "separate separatf separatf")],
                                 "doc_id long, text string")
    for group in (1, 32):
        found = spelling.variants(rows, group=group, broadcast_chunks=0 if group == 1 else 100)
        assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert key(map(tuple, found.collect())) == key(plain_variants(rows.collect()))
    chain = {r["word"]: r["root"] for r in found.collect()}
    assert chain["acomodate"] == chain["acommodate"] == "accommodate"


def test_words_that_share_a_chunk_lose_no_pair(spark):
    prepare(spark)
    rng, letters = np.random.default_rng(3), list("abé")
    words = {"common" + "".join(rng.choice(letters, rng.integers(1, 7))) for _ in range(400)}
    words |= {"".join(rng.choice(letters, rng.integers(1, 7))) + "common" for _ in range(200)}
    made = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    expected = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in words for b in words if plain_near(a, b)}
    found = [(r["a"], r["b"]) for r in spelling.near_words(made, group=4).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_variants_of_all_rows(docs, empty):  # noqa: F811
    assert key(map(tuple, spelling.variants(docs).collect())) == key(plain_variants(docs.collect()))
    assert spelling.variants(empty).collect() == []


def test_words_of_a_long_text_are_whole(monkeypatch):
    text = " ".join(f"wörter{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}" for i in range(3000)) + " " + "x" * 500
    whole = spelling.document_words(7, text)
    monkeypatch.setattr(spelling, "_BLOCK", 100)
    assert spelling.document_words(7, text) == whole


# --- 12


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    model = quality.Model(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, quality.FACTORS)))
    at, x = np.array([3, 50, 900, 16_390, 17_500]), rng.normal(size=5)
    pairs = sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(5) for j in range(i))
    assert model.margin(at, x) == pytest.approx(0.3 + model.weights[at] @ x + pairs)


def test_quality_of_held_out_documents(spark):
    prepare(spark)
    documents, labels = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{SF[:-5]}0.01/labels.parquet")
    rows = quality.judge(documents, labels).collect()
    assert len(rows) == documents.count()
    wanted = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    judged = [(wanted[r["doc_id"]], r) for r in rows if r["held_out"] and r["doc_id"] in wanted]
    good, bad = ([r["score"] for w, r in judged if w == label] for label in (1, 0))
    assert np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good]) > 0.97
    assert np.mean([r["predicted"] == w for w, r in judged]) > 0.9
    # labels of held-out documents are not read
    other = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - labels["quality"]).otherwise(labels["quality"]))
    assert {r["doc_id"]: r["score"] for r in quality.judge(documents, other).collect()} == {r["doc_id"]: r["score"] for r in rows}


def test_quality_of_all_rows(spark, docs, empty):  # noqa: F811
    labels = spark.createDataFrame([(0, 1, "x"), (1, 0, "x"), (4, 0, "x"), (5, 1, "x"), (5, None, "x"), (None, 1, "x"), (6, 7, "x"),
                                    (10, 1, "x")], "doc_id long, quality int, score string")
    found = quality.judge(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r, d in zip(rows, docs.collect(), strict=True):
        assert r["doc_id"] == d["doc_id"]
        by_text.setdefault((d["text"], d["n_chars"]), set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert quality.judge(empty, labels).collect() == []
    assert {r["score"] for r in quality.judge(docs, labels.where("false")).collect()} == {0.5}


# --- 13


def test_sums_come_in_order():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 12).astype(float), rng.normal(size=7)
    found = list(negatives.multi_sequence(a, b))
    assert {(i, j) for _, i, j in found} == {(i, j) for i in range(12) for j in range(7)}
    assert [s for s, _, _ in found] == sorted((x + y for x in a for y in b), reverse=True)
    assert list(negatives.multi_sequence(a, b[:0])) == []


def plain_negatives(rows):
    out = []
    for anchor in {r[0]: r for r in sorted(rows, reverse=True) if r[0] % 100 == 0}.values():
        scored = sorted((-int(np.dot(anchor[2], r[2])), r[0], r[1]) for r in rows if r[0] != anchor[0])
        for score, positive, _ in [s for s in scored if s[2] == anchor[1]][:5]:
            inside = [s for s in scored if s[2] != anchor[1] and 80 * -score <= 100 * -s[0] <= 100 * -score]
            out += [(anchor[0], positive, rank, s[1], -score, -s[0]) for rank, s in enumerate(inside[:5], 1)]
    return out


def clustered(n, seed=8):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (12, 8))
    return [(i, int(rng.integers(0, 4)), (centres[rng.integers(0, 12)] + rng.integers(-30, 30, 8)).astype(float).tolist())
            for i in range(n)]


def test_negatives_against_brute_force(spark, monkeypatch):
    prepare(spark)
    rows = clustered(1500) + [(2000 + i, i % 3, [50.0] * 8) for i in range(300)]  # a third of some cell are copies
    rows += [(100, 1, [3.0] * 8), (7, 2, rows[7][2])]
    made = spark.createDataFrame(rows, "vec_id long, label long, vector array<double>")
    anchors = made.where("vec_id % 100 = 0")
    for shard, slice_rows, sample in ((16_384, 1024, 8192), (100, 4, 64)):
        monkeypatch.setattr(negatives, "SHARD_ROWS", shard)
        monkeypatch.setattr(negatives, "SLICE_ROWS", slice_rows)
        monkeypatch.setattr(negatives, "SAMPLE", sample)
        assert key(map(tuple, negatives.mine(made, anchors).collect())) == key(plain_negatives(rows))


def test_bounds_spare_anchors_most_shards(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(negatives, "SHARD_ROWS", 64)
    made = spark.createDataFrame(clustered(4000), "vec_id long, label long, vector array<double>")
    index, rows, cells = negatives.fit(made)
    asked = made.where("vec_id % 100 = 0").withColumn("positives", negatives.F.array().cast("array<long>"))
    routed = negatives._route(asked, index, cells, negatives._reach_positives).count()
    assert routed < 0.5 * asked.count() * rows.select("shard").distinct().count()


def test_negatives_of_odd_rows(spark):
    prepare(spark)
    nan, inf = float("nan"), float("inf")
    given = [(0, [1.0, 0.5], 1, "x"), (1, [1.0, 0.25], 1, "x"), (2, [0.9, 0.5], 2, "x"), (3, [nan, 1.0], 2, "x"), (4, None, 2, "x"),
             (5, [inf, 1.0], 1, "x"), (6, [None, 1.0], 1, "x"), (8, [1.0, 0.5], None, "x"), (None, [1.0, 1.0], 1, "x"),
             (9, [1.0, 0.25], 1, "x"), (10, [0.9, 0.5], 3, "x"), (11, [1.0], 3, "x"), (100, [-1.0, 0.0], 5, "x"), (12, [1.0, 0.0], 5, "x"),
             (14, [0.9, 0.5], 9, "x")]
    made = negatives.labelled(spark.createDataFrame(given, "vec_id long, embedding array<float>, label int, score string"))
    rows = [(r["vec_id"], r["label"], r["vector"]) for r in made.collect()]
    assert {r[0] for r in rows} == {0, 1, 2, 9, 10, 100, 12, 14} and {r[0]: r[1] for r in rows}[14] == 0
    assert {r[0]: r[1] for r in rows}[0] == 2  # 7 divides 0
    found = negatives.mine(made, made.where("vec_id % 100 = 0")).collect()
    assert key(map(tuple, found)) == key(plain_negatives(rows)) and found
    nothing = made.where("false")
    assert negatives.mine(nothing, nothing).collect() == []
    assert negatives.mine(made, nothing).collect() == []
