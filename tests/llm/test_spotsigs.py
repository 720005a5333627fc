import hashlib
import random
import re

from pyspark.sql import functions as F

from quernstone.llm import spotsigs
from tests.llm.helpers import documents, lower, save


def signatures(text):
    ws = [w for w in re.split(spotsigs.BREAKS, lower(text)) if w]
    content = [(w, ws[i - 1] if i and ws[i - 1] in spotsigs.ANCHORS else None) for i, w in enumerate(ws) if w not in spotsigs.ANCHORS]
    found = {f"{a} {w} {content[i + 1][0]}" for i, (w, a) in enumerate(content) if a and i + 1 < len(content)}
    return found or {"=" + hashlib.sha256(text.encode()).hexdigest()}


def digest(s):
    return hashlib.sha256("\n".join(sorted(s, key=lambda x: x.encode())).encode()).hexdigest()


def likeness(a, b):
    return len(a & b) / len(a | b)


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda x: -x[0])
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        a, b, c = signatures(t), signatures(edited), signatures(after)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(a), digest(b), round(likeness(a, b), 12), round(likeness(a, c), 12)))
    return sorted(out)


def corpus(seed, n=80):
    r = random.Random(seed)
    words = [*r.sample(spotsigs.ANCHORS, 20), *(f"c{i}" for i in range(40)), "É", "😀", "The", "x1"]
    rows = [(i * 3, r.choice([" ", "\n", ", "]).join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(n)]
    return [*rows, (1000, None), (1001, ""), (-5, "the the the"), (1002, rows[3][1]), (1003, "the cat sat " * 20_000)]


def result(df):
    return sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in df.collect())


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    rows = corpus(1)
    folder = save(documents(spark, rows), tmp_path, "documents")
    assert result(spotsigs.op3_spotsigs(spark, folder)) == brute(rows)
    monkeypatch.setattr(spotsigs, "NEIGHBOURS", 7)  # many windows
    assert result(spotsigs.op3_spotsigs(spark, folder)) == brute(rows)


def test_few_rows(spark, tmp_path):
    for k, rows in enumerate([[], [(1, "the cat sat")], [(1, None), (2, "the cat sat on")]]):
        folder = save(documents(spark, rows), tmp_path / str(k), "documents")
        assert result(spotsigs.op3_spotsigs(spark, folder)) == (brute(rows) if rows else [])


def test_null_and_repeated_ids_do_not_crash(spark, tmp_path):
    rows = [(None, "the cat sat on"), (None, None), (4, "a dog ran off"), (4, "a dog ran off"), (5, "the cat sat on")]
    folder = save(documents(spark, rows), tmp_path, "documents")
    assert spotsigs.op3_spotsigs(spark, folder).count() == len(rows)


def test_native(spark, tmp_path):
    folder = save(documents(spark, corpus(2, 5)), tmp_path, "documents")
    plan = spotsigs.op3_spotsigs(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)


def test_pairs_equal_brute_force(spark):
    r = random.Random(5)
    base = [f"the w{i} v{i}" for i in range(30)]
    rows = []
    for k in range(60):
        s = [x for x in base if r.random() > 0.1] + [f"a q{k} z{j}" for j in range(r.randint(0, 2))]
        rows.append((k, " . ".join(s)))
    prints = spotsigs.fingerprints(documents(spark, rows))
    sets = {digest(signatures(t)): signatures(t) for _, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and likeness(sets[a], sets[b]) >= 0.8}
    assert {(x.a, x.b) for x in spotsigs.near_pairs(prints, 0.8).collect()} == want


def test_rows_without_id_come_after_a_least_id_that_fills_windows(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "NEIGHBOURS", 20)
    rows = [(5, f"five {k:03}") for k in range(60)] + [(6 + k, f"other {k}") for k in range(30)] + [(None, f"none {k}") for k in range(7)]
    got = spotsigs.with_next(documents(spark, rows), F.lit(1)).collect()
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]
    assert {r.text: r.next_text for r in got} == dict(zip(order, order[1:] + order[:1]))
