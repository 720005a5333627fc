import itertools
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import quality, toxicity
from tests.conftest import SMALL
from tests.llm.helpers import documents, save


def test_marginals_equal_enumeration():
    r = np.random.default_rng(2)
    before = np.array([0, 1, 4, 4 + 5])
    unary, trans = r.normal(size=9), r.normal(size=(2, 2))
    good, pair, z = quality.marginals(unary, trans, before)
    want_good, want_pair = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(before, before[1:]):
        weight = {}
        for y in itertools.product((0, 1), repeat=b - a):
            s = sum(unary[a + i] for i, v in enumerate(y) if v) + sum(trans[u, v] for u, v in zip(y, y[1:]))
            weight[y] = np.exp(s)
        total = sum(weight.values())
        assert np.allclose(z[a:b], np.log(total))
        for y, w in weight.items():
            want_good[a:b] += np.array(y) * w / total
            for u, v in zip(y, y[1:]):
                want_pair[u, v] += w / total
    assert np.allclose(good, want_good) and np.allclose(pair, want_pair)


def test_line_features_follow_lines():
    texts = pa.array(["a\nBB CC!\n", "", None, "x"])
    x, length, before = quality.line_features(texts)
    assert before.tolist() == [0, 3, 4, 5, 6] and length.tolist() == [1, 6, 0, 0, 0, 1]
    again, _, _ = quality.line_features(pa.array(["a\nBB CC!\n"]))
    assert np.allclose(x[:3], again)


def test_isotonic_is_monotone_and_least_squares():
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=300), 1)
    y = (r.random(300) < 1 / (1 + np.exp(-x))).astype(float)
    knots, values = toxicity.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    fit = np.interp(x, knots, values)
    assert abs(fit.mean() - y.mean()) < 1e-9
    assert ((fit - y) ** 2).sum() <= ((y.mean() - y) ** 2).sum()


def brute_trees(x, edges, y, trees, depth):
    """The same boosting, each split found by trying every feature and every bin bound on whole rows."""
    bins = np.array([[sum(v >= e for e in edges[k]) for k, v in enumerate(row)] for row in x])
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)

        def grow(rows, level):
            if level == depth:
                return [(rows, toxicity.RATE * np.clip(g[rows].sum() / (h[rows].sum() + 1), -4, 4))]
            best, cut = 1e-3, None
            if len(rows) > 20:
                for k in range(x.shape[1]):
                    for at in range(toxicity.BINS + 1):
                        left = rows[bins[rows, k] <= at]
                        right = rows[bins[rows, k] > at]
                        if len(left) < 8 or len(right) < 8:
                            continue
                        gain = sum(g[z].sum() ** 2 / (h[z].sum() + 1) for z in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                        if gain > best + 1e-12:
                            best, cut = gain, (k, at)
            if cut is None:
                return grow(rows, level + 1)
            inside = bins[rows, cut[0]] <= cut[1]
            return grow(rows[inside], level + 1) + grow(rows[~inside], level + 1)

        for rows, value in grow(np.arange(len(y)), 0):
            f[rows] += value
    return f


def test_trees_equal_exhaustive_split_search(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 4)
    r = np.random.default_rng(6)
    x = r.normal(size=(160, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0) | (x[:, 1] > 1.5)).astype(float)
    trees = toxicity.Trees().fit(x, y)
    assert np.allclose(trees.raw(x), brute_trees(x, trees.edges, y, 4, toxicity.DEPTH))


def test_line_counts_across_slabs(monkeypatch):
    text = "Ab1|!~. é\n" * 50 + "\n\nz" * 9
    whole = quality.line_features(pa.array([text, "", text]))[0]
    monkeypatch.setattr(quality, "SLAB", 7)
    assert np.allclose(quality.line_features(pa.array([text, "", text]))[0], whole)
    kind = quality._KIND[np.frombuffer(text.encode(), np.uint8)]
    start = np.array([0, *(np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 10) + 1)])
    count = quality._kinds_of_lines(kind, start)
    lines = text.encode().split(b"\n")
    for i, line in enumerate(lines):
        assert count[i, 1:].tolist() == [sum(quality._KIND[c] == k for c in line) for k in range(1, quality.KINDS)]


def test_sample_takes_whole_texts_within_its_bytes(spark):
    docs = documents(spark, [(i, "x" * (100 * (i % 7 + 1))) for i in range(60)] + [(1, "y")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 1 - 7 % 2), (8, None)], "doc_id long, quality int")
    rows = quality.labelled_sample(docs, labels, "quality", 3, 1, 40, 4000).collect()
    assert 0 < sum(len(r.text) for r in rows) <= 4000 and len({r.doc_id for r in rows}) == len(rows) <= 40
    assert all(len(r.text) == 100 * (r.doc_id % 7 + 1) for r in rows) and 7 not in {r.doc_id for r in rows}
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.label == r.doc_id % 2 for r in rows)


@pytest.mark.parametrize("line", ["some words of a line, 12 of them and more!\n", "one line without end "])
def test_text_of_20_mb_in_bounded_memory(line):
    program = f"""
import resource, pyarrow as pa
from quernstone.llm import quality
x, length, before = quality.line_features(pa.array([{line!r} * (20_000_000 // len({line!r}))]))
assert before[-1] == len(x)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, check=True).stdout) < 1300


def auc(score, label):
    pairs = [(a > b) + 0.5 * (a == b) for a, y in zip(score, label) if y for b, z in zip(score, label) if not z]
    return sum(pairs) / len(pairs)


@pytest.mark.parametrize(("query", "label", "fold", "left_out", "least"), [(quality.op1_line_crf_quality, "quality", 3, 1, 0.95), (toxicity.op2_boosted_toxicity, "toxic", 4, 2, 0.75)])
def test_held_out_ranking(spark, query, label, fold, left_out, least):
    rows = query(spark, SMALL).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    cut = 0.5 if label == "quality" else 0.3
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == left_out)
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(*zip(*held)) >= least


def odd_tables(spark, folder, docs, labels):
    save(documents(spark, docs), folder, "documents")
    return save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text", "1 as label"), folder, "labels")


@pytest.mark.parametrize("query", [quality.op1_line_crf_quality, toxicity.op2_boosted_toxicity])
def test_odd_rows_and_labels(spark, tmp_path, query):
    r = random.Random(1)
    docs = [(i, "\n".join("word " * r.randint(0, 9) for _ in range(r.randint(0, 5)))) for i in range(80)]
    docs += [(100, None), (101, ""), (None, "x"), (5, docs[5][1]), (102, "long line " * 40_000), (103, "\n" * 50_000), (104, "\x00 ﻿ 😀")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(80)] + [(5, 1, None), (None, 1, 1), (100, None, 1), (999, 1, 1), (101, 7, 7)]
    folder = odd_tables(spark, tmp_path / "odd", docs, [(a, b, None if c is None else int(c)) for a, b, c in labels])
    rows = query(spark, folder).collect()
    assert len(rows) == len(docs) and all(0 <= x.score <= 1 and x.held_out is not None for x in rows)
    again = query(spark, folder).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    none = query(spark, odd_tables(spark, tmp_path / "none", docs, [])).collect()
    assert len({x.score for x in none}) == 1
    assert query(spark, odd_tables(spark, tmp_path / "empty", [], [])).count() == 0


def test_good_documents_keeps_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = quality.good_documents(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
