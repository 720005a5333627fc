import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quernstone.llm import suffixes
from tests.llm.helpers import documents, rows_made, save


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        edges = np.diff(np.concatenate(([0], gone.view(np.int8))))
        out.append((d, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, width):
    r = random.Random(seed)
    make = lambda n: "".join(r.choice("abcdefgh é漢\n") for _ in range(n))
    passages = [make(n) for n in (width - 30, width, width + 50, 3 * width)] + ["ab" * width, "x" * (2 * width)]
    rows = [(1000, None), (1001, ""), (1002, "short"), (1003, "x" * (width - 1)), (1004, "y" * width), (1005, "z" * (width + 1))]
    for k in range(60):
        text = make(r.randint(0, 2 * width))
        for _ in range(r.randint(0, 2)):
            text += r.choice(passages) + make(r.choice([0, 3, 200]))
        rows.append((k, text))
    rows += [(500, rows[10][1]), (501, rows[10][1]), rows[11], (None, rows[12][1]), (None, make(500))]
    return rows


def result(df):
    spans = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()]
    return sorted(spans, key=str)


@pytest.mark.parametrize(("seed", "width", "sorted_"), [(1, 400, 1 << 20), (2, 220, 1 << 20), (3, 400, 600)])
def test_equals_brute_force(spark, monkeypatch, seed, width, sorted_):
    monkeypatch.setattr(suffixes, "SORTED", sorted_)  # small: groups are spread over tasks
    rows = corpus(seed, width)
    assert result(suffixes.removed(documents(spark, rows), width)) == brute(rows, width)


def test_colliding_gram_hashes(spark, monkeypatch):
    """Hashes decide nothing: with 8 bits of them groups hold all kinds of strings."""
    monkeypatch.setattr(suffixes, "SORTED", 500)
    rows = corpus(7, 220)[:40]
    assert result(suffixes.removed(documents(spark, rows), 220, bits=8)) == brute(rows, 220)


def test_query(spark, tmp_path):
    rows = corpus(5, 400)
    folder = save(documents(spark, rows), tmp_path, "documents")
    got = sorted((tuple(r) for r in suffixes.op7_suffix_array_dedup(spark, folder).collect()), key=str)
    assert got == brute(rows, 400)


def test_refinement_numbers_equal_strings():
    r = np.random.default_rng(4)
    data = r.integers(97, 99, 600).astype(np.uint8)
    stop = np.repeat([250, 600], [250, 350])
    for depth in (1, 5, 8, 13, 40):
        b = suffixes.refine(data, stop, depth)
        own = {i: data[i : i + depth].tobytes() for i in range(600) if i + depth <= stop[i]}
        assert {i for i in range(600) if b[i] >= 0} == set(own)
        order = sorted(own, key=lambda i: own[i])
        assert all((b[i] < b[j]) == (own[i] < own[j]) and (b[i] == b[j]) == (own[i] == own[j]) for i, j in zip(order, order[1:]))


def test_cut_texts(spark):
    rows = corpus(6, 400)
    got = suffixes.without_repeats(documents(spark, rows)).collect()
    want = {(r[0], r[1]) for r in brute(rows, 400)}
    assert len(got) == len(rows) == len(want) + 1
    assert all(len(r.text) == r.n_chars for r in got)
    assert {r.text for r in got if r.doc_id in (500, 501)} <= {"", rows[10 + 6 - 6][1]}


def test_empty_table_and_long_text(spark):
    assert suffixes.removed(documents(spark, [])).count() == 0
    r = random.Random(9)
    text = "".join(r.choice("abcdefghijklmnop ") for _ in range(1_500_000))
    rows = [(1, text), (2, text[700_000:700_500] + "end"), (3, "q" * 3_000)]
    got = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in suffixes.removed(documents(spark, rows)).collect()}
    assert got == {1: [(700_000, 700_500)], 2: [(0, 500)], 3: [(0, 3000)]}


def test_occurrences_of_a_common_passage_are_joined_once(spark):
    """Where segments lie is known from the first join; the last one has a row for each different segment at most."""
    r = random.Random(12)
    make = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = make(3_000)
    rows = [(k, make(250) + passage + make(250)) for k in range(80)] + [(100 + k, make(20) + passage[150 * k : 150 * k + 333] + make(20)) for k in range(18)]
    _, ranges = suffixes.repeated_ranges(documents(spark, rows), 220)
    found = ranges.collect()
    assert len(found) == 98 and 0 < rows_made(ranges, "Join", "numOutputRows") < 500  # of some 3,000 segments of the passage
    assert result(suffixes.removed(documents(spark, rows), 220)) == brute(rows, 220)
