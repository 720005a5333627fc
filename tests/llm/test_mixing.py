import random

import numpy as np

from quernstone.llm import mixing
from tests.llm.helpers import WORD, documents


def plain_targets(sizes, weights, share, most):
    """Shares by weight; who is above the bound stops there, what is left is shared again."""
    out, open_ = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n}
    while open_:
        rest = share * sum(sizes) - sum(out)
        unit = rest / sum(weights[i] for i in open_)
        above = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        for i in above or open_:
            out[i] = most * sizes[i] if above else unit * weights[i]
        open_ = open_ - above if above else set()
    return out


def corpus(seed, n=4000):
    r = random.Random(seed)
    source = lambda: r.choices(["a", "b", "É", "c", "Z", "", None], [30, 5, 5, 5, 5, 1, 1])[0]
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), source()) for i in range(n)]
    return [*rows, (n, None, "a"), (n + 1, "", "only empty"), (None, "x y z", "a"), (5, "a b c", "b"), (n + 2, "w " * 50_000, "b")]


def test_sizes_targets_and_bounds(spark):
    rows = corpus(1)
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    goal = dict(zip(names, plain_targets([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5, 2.0)))
    longest = {s: max(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in names}
    taken = dict.fromkeys(names, 0)
    for x in got:
        assert 0 <= x.taken <= 2 * x.size and x.taken == x.copies * x.size
        assert x.source_size == size[x.source] and abs(x.target - goal[x.source]) < 1e-6 * max(1, x.target)
        taken[x.source] += x.taken
    for s in names:
        assert abs(taken[s] - goal[s]) <= 2 * longest[s] + 1, s


def test_targets(spark):
    assert plain_targets([100, 100, 100], [5, 2, 1], 1.5, 2.0) == [200.0, 500 / 3, 250 / 3]
    r = random.Random(1)
    for trial in range(8):
        sizes = [r.choice([0, 1, r.randint(0, 1000), r.randint(0, 100_000)]) for _ in range(r.choice([0, 1, 2, 9, 40]))]
        names = sorted((f"é{k}" if k % 3 else f"s{k}" for k in range(len(sizes))), key=lambda x: x.encode("utf-32-be"))
        if sizes and trial % 2:
            names[-1] = None
        rows = spark.createDataFrame([(s, n, 1) for s, n in zip(names, sizes)], "source string, source_size long, rows long").repartition(5)
        got = {x.source: x.target for x in mixing.targets(rows, mixing.WEIGHTS, 1.5, 2.0).collect()}
        want = dict(zip(names, plain_targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], 1.5, 2.0)))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want), sizes


def test_reruns_agree_whatever_the_partitions(spark):
    docs = documents(spark, corpus(2, 800))
    runs = [sorted(map(str, mixing.mix(docs.repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_pivot_keeps_words_and_expectations():
    r = np.random.default_rng(5)
    size = r.integers(1, 50, 40).astype(float)
    share = r.random(40)
    total = np.zeros(40)
    for _ in range(3000):
        out = mixing.pivot(size, share, r.random(40))
        odd = (out != 0) & (out != 1)
        assert odd.sum() <= 1 and abs((size * out).sum() - (size * share).sum()) < 1e-6
        total += out
    assert np.abs(total / 3000 - share).max() < 0.05


def test_tree_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, "w " * (1 + i % 7), "s" if i % 3 else "t") for i in range(900)]
    got = mixing.mix(documents(spark, rows)).collect()
    for s in ("s", "t"):
        own = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 14


def test_mixed_documents_and_empty_table(spark):
    docs = documents(spark, corpus(3, 300)).select("doc_id", "text", "lang", "source", "n_chars")
    copies = {x.doc_id: x.copies for x in mixing.mix(docs.where("doc_id != 5")).collect()}
    out = mixing.mixed_documents(docs.where("doc_id != 5")).groupBy("doc_id").count().collect()
    assert {x.doc_id: x["count"] for x in out} == {d: c for d, c in copies.items() if c and d is not None}
    assert mixing.mix(documents(spark, [])).count() == 0


def test_large_ids_beside_a_null_one(spark):
    """Ids are whole numbers throughout: 2**53 + 1 has no double."""
    ids = [None, 2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63), 7]
    got = mixing.mix(documents(spark, [(i, "a b c", "s") for i in ids])).collect()
    assert sorted((x.doc_id for x in got), key=str) == sorted(ids, key=str)
