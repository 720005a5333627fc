import math
import random
from collections import Counter

import pytest

from quernstone.llm import lm
from tests.llm.helpers import WORD, documents, lower, rows_made


def brute(rows, order=2, alpha=0.4):
    texts = [(d, WORD.findall(lower(t or ""))) for d, t in rows]
    grams = lambda t: Counter(tuple(t[i : i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
    every, total, out = Counter(), sum(len(t) for _, t in texts), {}
    for _, t in texts:
        every.update(grams(t))
    for d, t in texts:
        own, s = grams(t), 0.0
        for i in range(len(t)):
            factor = 1.0
            for k in range(min(i + 1, order), 0, -1):
                g = tuple(t[i - k + 1 : i + 1])
                if k == 1:
                    s += math.log(factor * every[g] / total)
                elif every[g] > own[g]:
                    s += math.log(factor * (every[g] - own[g]) / (every[g[:-1]] - own[g[:-1]]))
                    break
                factor *= alpha
        words, score = out.get(d, (0, 0.0))
        out[d] = (words + len(t), score + s)
    return out


@pytest.mark.parametrize(("order", "passes", "head"), [(2, 2, 3), (3, 1, 100_000)])
def test_equals_brute_force(spark, order, passes, head):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["a", "B", "c", "dd", "é", "f", "g"]) for _ in range(r.randint(0, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "a b c"), (3, "a b"), (102, "unseen words here"), (103, "a b " * 3_000), rows[4], (104, "only once said but twice stored"), (105, "only once said but twice stored")]
    got = {x.doc_id: (x.n_words, x.log_score) for x in lm.score(documents(spark, rows), order, passes=passes, head=head).collect()}
    want = brute(rows, order)
    assert got.keys() == want.keys()
    for d, (n, s) in want.items():
        assert got[d][0] == n and abs(got[d][1] - s) < 1e-6 * max(1, abs(s)), d


def test_empty_table_and_no_words(spark):
    assert lm.score(documents(spark, [])).count() == 0
    assert [tuple(x) for x in lm.score(documents(spark, [(1, None)])).collect()] == [(1, 0, 0.0)]


def test_parts_answer_by_batch(spark, monkeypatch):
    """The join by part makes a row for each batch and part, however many texts a batch has."""
    r = random.Random(5)
    rows = [(i, " ".join(str(r.randint(0, 50)) for _ in range(60))) for i in range(300)]
    made, cut = [], lm._run.cut

    def counted(df, name):
        if name == "scores":
            df.collect()
            made.append(rows_made(df, "CoGroups", "pythonNumRowsReceived"))
        return cut(df, name)

    monkeypatch.setattr(lm._run, "cut", counted)
    got = {x.doc_id: x.log_score for x in lm.score(documents(spark, rows), passes=2, head=1).collect()}
    assert len(made) == 3 and 0 < min(made) and max(made) <= 3 * 4  # batches and parts
    assert all(abs(got[d] - s) < 1e-6 * abs(s) for d, (_, s) in brute(rows).items())
