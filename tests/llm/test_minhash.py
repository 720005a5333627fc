import random

import pytest

from quernstone.llm import graph, minhash
from tests.llm.helpers import WORD, documents, lower


def brute(rows, words, percent=80):
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                up[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids) if ids and sets[i] else d
        out.append((d, len(sets[i]), component, d == component))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(None, "a b c d e"), (9000, ""), (9001, None), (9002, "one"), (9003, "ONE"), (9004, "one two"), (9005, " \t\n")]
    for k in range(n):
        base = [r.choice(vocabulary) for _ in range(r.randint(5, 120))]
        rows.append((k * 20, " ".join(base)))
        for c in range(r.randint(0, 6)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((k * 20 + c + 1, "  ".join(w).upper() if c % 2 else "\n".join(w)))
    return [*rows, rows[20], (5000, rows[20][1]), (None, rows[20][1])]


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "words"), [(1, 4), (2, 5)])
def test_classes_equal_brute_force(spark, seed, words):
    rows = corpus(seed)
    assert result(minhash.near_duplicates(documents(spark, rows), words)) == brute(rows, words)


def test_blocks_of_long_lists_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_ROWS", 3)
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 400)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    r = random.Random(7)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for k in range(60):  # one large group of near copies
        w = list(base)
        w[r.randrange(150)] = f"own{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(f"z{k}_{i}" for i in range(20))) for k in range(10)]
    assert result(minhash.near_duplicates(documents(spark, rows), 4)) == brute(rows, 4)


def test_one_of_each(spark):
    rows = corpus(3, 15)
    near = brute(rows, 5)
    left = minhash.one_of_each(documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")).collect()
    keep = {d for d, _, _, k in near if d is not None and k}
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted(keep)
    assert sum(r.doc_id is None for r in left) == 2


def test_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, []), 4).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{i % 5003}" for i in range(200_000))
    got = result(minhash.near_duplicates(documents(spark, [(1, text), (2, text + " end"), (3, "a b c d")]), 4))
    assert [(d, c) for d, _, c, _ in got] == [(1, 1), (2, 1), (3, 3)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (2001, 2000)], "u long, v long").repartition(7)
    got = {r.node: r.root for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {2000: 2000, 2001: 2000}


def test_rows_that_share_an_id_keep_their_own_links(spark):
    """Ids 2 and 4 stand for two texts each, which link with others but not with each other."""
    base = [f"w{k}" for k in range(60)]
    edited = lambda *at: " ".join(f"q{k}" if k in at else w for k, w in enumerate(base))
    rows = [(2, edited()), (2, edited(20, 40)), (1, edited(57)), (4, edited(20, 40, 3)), (4, edited(20, 40, 3).upper()), (4, edited(10, 30)), (3, edited(10, 30, 50))]
    got = result(minhash.near_duplicates(documents(spark, rows), 4))
    assert got == brute(rows, 4)
    assert len({r[2] for r in got}) > 1
