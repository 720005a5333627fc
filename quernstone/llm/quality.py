"""Document quality from a linear-chain conditional random field over lines.

Each line gets label bad or good.  Its features are densities of character and
word kinds, the same of the line before and after, and how it compares with
them; labels of neighbouring lines attract each other by trained transition
weights.  Forward-backward gives each line's marginal probability of good, and
the mean of the marginals, weighted by line length, is calibrated to the
document's score.

Labels are of documents, so a training line carries its document's label.  The
field is fitted on a bounded sample: whole labelled documents in the order of a
hash, up to ``SAMPLE`` of them and ``SAMPLE_BYTES`` together.  All their lines
teach; for fitting, chains are cut every ``CHAIN`` lines, which costs the cut
transitions alone.  Scoring sees every line of every text, and nothing but the
text.

Defined results: null and empty texts are one empty line and get the score of
that; repeated rows get repeated scores; labels that are null, or of both
kinds, or missing, teach nothing; of rows that share an id the least text teaches; without labels of both kinds every score is
the share of label 1 (0.5 without any); further columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import _run, _text

#: Most labelled documents that the field is fitted on, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 2500, 8 << 20
#: Lines of a chain in fitting; bytes that are counted at once.
CHAIN, SLAB = 64, 1 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(97, 123)]] = 1
_KIND[[*range(65, 91)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[[ord(c) for c in "|"]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in "$%&*#@~^=+_<>{}[]\\/"]] = 6
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 7
_KIND[[0x20, 0x09]] = 8
_KIND[128:] = 9
KINDS = 10


def _kinds_of_lines(kind: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many bytes of each kind each line has, slab by slab."""
    count = np.zeros((len(start), KINDS))
    for at in range(0, len(kind), SLAB):
        part = kind[at : at + SLAB]
        i, j = np.searchsorted(start, [at, at + len(part) - 1], "right") - 1
        edge = np.clip(np.append(start[i : j + 1], at + len(part)) - at, 0, len(part))
        line = np.repeat(np.arange(j + 1 - i), np.diff(edge))
        count[i : j + 1] += np.bincount(line * KINDS + part, minlength=(j + 1 - i) * KINDS).reshape(-1, KINDS)
    return count


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, byte lengths of the lines, and lines before each document."""
    data, off = _text.flat(column)
    n = len(off) - 1
    feed = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((off[:-1], feed + 1)))  # a text has a line more than line feeds
    per = np.searchsorted(feed, off)
    before = per + np.arange(n + 1)
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    end[before[1:] - 1] = off[1:]
    length = np.maximum(end - start, 0)
    kind = _KIND[data]
    count = _kinds_of_lines(kind, start)
    s, e, words = _text.word_spans(data, off)
    w0, w1 = np.searchsorted(s, start), np.searchsorted(s, end)
    h = _text.span_hashes(data, s, e)
    lower = _text.span_hashes(_text.LOWER[data], s, e)
    again = np.zeros(len(s) + 1, np.int64)
    again[2:] = np.cumsum(h[1:] == h[:-1])
    odd_end = np.zeros(len(s) + 1, np.int64)
    if len(s):
        tail = kind[e - 1]
        odd_end[1:] = np.cumsum((tail == 6) | (tail == 5) | (tail == 4))
    n_words = (w1 - w0).astype(float)
    some = np.maximum(n_words, 1)
    size = np.maximum(length, 1)
    letters = np.maximum(count[:, 1] + count[:, 2] + count[:, 9], 1)
    # distinct words of a line, by sorting words within lines
    line = np.repeat(np.arange(len(start)), w1 - w0)
    order = np.lexsort((lower, line))
    fresh = np.ones(len(order), bool)
    if len(order):
        a, b = line[order], lower[order]
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    distinct = np.bincount(line[order][fresh], minlength=len(start)) / some
    inner = np.maximum(w1 - 1 - w0, 0)
    repeated = np.where(inner > 0, again[np.minimum(np.maximum(w1, w0 + 1), len(s))] - again[np.minimum(w0 + 1, len(s))], 0) / np.maximum(inner, 1)
    mean_word = np.where(n_words > 0, (length - count[:, 8]) / some, 0) / 10
    own = np.stack([
        count[:, 2] / letters,
        (count[:, 2] / letters) > 0.5,
        count[:, 3] / size * 5,
        np.minimum(count[:, 4] / some, 1) * 2,
        np.minimum(count[:, 5] / some, 2),
        np.minimum(count[:, 6] / some, 3),
        np.minimum(count[:, 7] / some, 3) / 3,
        (odd_end[w1] - odd_end[w0]) / some * 2,
        repeated * 2,
        1 - distinct,
        (1 - distinct) * (n_words > 8),
        np.minimum(mean_word, 3),
        np.log1p(n_words) / 5,
        length == 0,
    ], 1)
    first, last = np.zeros(len(start), bool), np.zeros(len(start), bool)
    first[before[:-1]] = True
    last[before[1:] - 1] = True
    up, down = np.roll(own, 1, 0), np.roll(own, -1, 0)
    up[first], down[last] = 0, 0
    ones = np.ones((len(start), 1))
    return np.concatenate((own, 0.5 * up, 0.5 * down, first[:, None], last[:, None], ones), 1), length, before


def _logsum(a, b):
    return np.logaddexp(a, b)


def marginals(unary: np.ndarray, trans: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: (line marginals, transition counts, log partition).

    ``unary`` has each line's score of good over bad.  Chains are walked in step,
    longest first, so each step is one numpy operation for all that go on.
    """
    n = np.diff(before)
    order = np.argsort(-n, kind="stable")
    start, size = before[:-1][order], n[order]
    lines = len(unary)
    fw, bw = np.zeros((lines, 2)), np.zeros((lines, 2))
    score = np.stack((np.zeros(lines), unary), 1)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    for t in range(longest):
        i = start[: active[t]] + t
        if t == 0:
            fw[i] = score[i]
        else:
            a = fw[i - 1]
            fw[i] = np.stack([_logsum(a[:, 0] + trans[0, y], a[:, 1] + trans[1, y]) for y in (0, 1)], 1) + score[i]
    for t in range(longest - 2, -1, -1):
        i = start[: active[t + 1]] + t
        b = bw[i + 1] + score[i + 1]
        bw[i] = np.stack([_logsum(b[:, 0] + trans[x, 0], b[:, 1] + trans[x, 1]) for x in (0, 1)], 1)
    z = _logsum(*(fw + bw).T)
    good = np.exp(fw[:, 1] + bw[:, 1] - z)
    inner = np.ones(lines, bool)
    inner[before[:-1]] = False
    j = np.flatnonzero(inner)
    pair = np.zeros((2, 2))
    for x in (0, 1):
        for y in (0, 1):
            pair[x, y] = np.exp(fw[j - 1, x] + trans[x, y] + score[j, y] + bw[j, y] - z[j]).sum()
    return good, pair, z


class LineField:
    """Weights of a fitted field and the calibration of document scores."""

    def __init__(self, mean, scale, weights, trans, calibration, constant: float | None = None) -> None:
        self.mean, self.scale, self.weights, self.trans = mean, scale, weights, trans
        self.calibration, self.constant = calibration, constant

    def lines(self, features: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Each line's marginal probability of good."""
        return marginals((features - self.mean) / self.scale @ self.weights, self.trans, before)[0]

    def raw(self, features, length, before) -> np.ndarray:
        good = self.lines(features, before)
        weight = length + 1.0
        return np.add.reduceat(good * weight, before[:-1]) / np.add.reduceat(weight, before[:-1])

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        a, b = self.calibration
        return 1 / (1 + np.exp(-(a * self.raw(*line_features(column)) + b)))


def fit(features: np.ndarray, length: np.ndarray, before: np.ndarray, label: np.ndarray, rounds: int = 150) -> LineField:
    """Maximum likelihood of line labels with an L2 penalty, by Adam on the whole sample."""
    if len(label) == 0 or label.min() == label.max():
        return LineField(None, None, None, None, None, float(label.mean()) if len(label) else 0.5)
    mean, scale = features.mean(0), features.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = (features - mean) / scale
    line = np.repeat(label, np.diff(before)).astype(float)
    share = np.repeat(1 / np.maximum(np.diff(before), 1), np.diff(before))  # a long document counts no more than a short one
    weight = np.where(line > 0, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9)) ** 0.5 * share
    chains = np.unique(np.concatenate([np.append(np.arange(a, z, CHAIN), z) for a, z in zip(before[:-1].tolist(), before[1:].tolist())]))
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    inner = np.ones(len(line), bool)
    inner[chains[:-1]] = False
    j = np.flatnonzero(inner)
    seen = np.array([[((line[j - 1] == a) & (line[j] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    total = weight.sum()
    for step in range(1, rounds + 1):
        good, pair, _ = marginals(x @ w, trans, chains)
        grad = np.concatenate((x.T @ (weight * (line - good)) / total - 1e-4 * w, ((seen - pair) / max(len(line), 1)).ravel() - 1e-2 * trans.ravel()))
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w += move[: len(w)]
        trans += move[len(w) :].reshape(2, 2)
    field = LineField(mean, scale, w, trans, (1.0, 0.0))
    raw = field.raw(features, length, before)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit, lightly penalised
        p = 1 / (1 + np.exp(-(a * raw + b)))
        r, h = label - p, p * (1 - p) + 1e-9
        g = np.array([(r * raw).sum() - 0.1 * a, r.sum() - 0.1 * b])
        hess = np.array([[(h * raw * raw).sum() + 0.1, (h * raw).sum()], [(h * raw).sum(), h.sum() + 0.1]])
        da, db = np.linalg.solve(hess, g)
        a, b = a + da, b + db
    field.calibration = (a, b)
    return field


def held_out(fold: int, left_out: int):
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == left_out, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, left_out: int, rows: int, most_bytes: int) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the held-out fold: whole texts in the order of a hash.

    At most ``rows`` documents are looked at; those are taken that fit into what
    is left of ``most_bytes``.  One row for each id, that of the least text.
    """
    spark = docs.sparkSession
    known = labels.where(f"doc_id is not null and `{label}` in (0, 1)").groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    known = known.where(~held_out(fold, left_out)).select("doc_id", F.col("label").cast("int").alias("label"))
    least = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(least), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = _run.cut(found.select("doc_id", "text", "label"), "labelled")
    sizes = found.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()  # at most ``rows`` numbers
    taken, left = [], most_bytes
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if r.n <= left:
            taken.append((r.doc_id,))
            left -= r.n
    return found.join(F.broadcast(_run.local_rows(spark, taken, "doc_id long")), "doc_id")


def train(docs: DataFrame, labels: DataFrame, fold: int = 3, left_out: int = 1, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> LineField:
    """Fit the field on a bounded sample of labelled rows outside the held-out fold."""
    with _run.tables() as made:
        got = sorted((r.doc_id, r.text, r.label) for r in labelled_sample(docs, labels, "quality", fold, left_out, sample, most_bytes).collect())
    _run.drop_cut(docs.sparkSession, *made)
    x, length, before = line_features(pa.array([r[1] for r in got], pa.string()))
    return fit(x, length.astype(float), before, np.array([r[2] for r in got], float))


def score(docs: DataFrame, field: LineField, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of (text, ...) and the score of each row's text."""

    def run(it):
        for b in _text.batches(it, 1 << 20):
            s = np.clip(field.scores(b.column(b.num_columns - 1)), 0, 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], [*keep, "score"])

    _run.small_batches(docs.sparkSession)
    df = docs.select(*keep, "text")
    kind = df.select(*keep).schema.add("score", "double")
    return df.mapInArrow(_run.tidy(run), kind)


def good_documents(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """The documents (all columns) whose score is at least ``at_least``."""
    field = train(docs, labels)
    kind = docs.schema
    at = docs.columns.index("text")

    def run(it):
        for b in _text.batches(it, 1 << 20):
            yield b.filter(pa.array(field.scores(b.column(at)) >= at_least))

    _run.small_batches(docs.sparkSession)
    return docs.mapInArrow(_run.tidy(run), kind)


def op1_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``; a third of the labels is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, field, ["doc_id"])
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
