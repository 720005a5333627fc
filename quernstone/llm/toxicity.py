"""Toxicity from gradient-boosted trees over dense features, isotonically calibrated.

Features of a text: densities of an abuse lexicon and of words that share a
stem with it, how near lexicon words stand to second-person words, rates of
capitals, of punctuation and of obfuscated words (digits or signs inside a
word), length, and, in texts that have lexicon words, elongated letters.

The lexicon is a short built-in list and what the labelled sample teaches:
words, and four-letter word beginnings, much more frequent in toxic documents
than in others.  A spelling with signs in place of letters counts after they
have been put back.

The model is fitted on a bounded sample: whole labelled documents outside the
held-out fold in the order of a hash, up to ``SAMPLE`` of them and
``SAMPLE_BYTES`` together; of rows that share an id the least text teaches.
Scoring sees the whole of every text,
and nothing but the text.

Defined results: null and empty texts have zero features and get the score of
those; repeated rows get repeated scores; labels that are null, or of both
kinds, or missing, teach nothing; without labels of both kinds every score is
the share of label 1 (0 without any); further columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import _run, _text
from quernstone.llm.quality import held_out, labelled_sample

#: Most labelled documents that the model is fitted on, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 4000, 16 << 20
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32

LEXICON = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic scum worthless trash disgusting clown fool ugly garbage vermin idiota imbécil estúpido basura dummkopf abschaum blödmann trottel connard crétin imbécile ordure".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre ti tú usted tus vosotros".split())
_SIGNS = str.maketrans("0134578@$!|", "oieastbasil")
_WORD = re.compile(r"[^\s.,;:!?\"()]+(?:[!|][^\s.,;:!?\"()]+)*")
_LONG = re.compile(r"([^\W\d_])\1\1")


class Lexicon:
    """Abusive words and word beginnings, with weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.words, self.stems = words, stems

    @classmethod
    def learn(cls, texts: list[str], labels: list[int]) -> Lexicon:
        """Log odds of words and word beginnings in toxic against other documents."""
        word, stem = (Counter(), Counter()), (Counter(), Counter())
        total = [1, 1]
        for text, y in zip(texts, labels):
            own = set(_WORD.findall(text.lower()))
            word[y].update(own)
            stem[y].update({w[:4] for w in own if len(w) > 4})
            total[y] += 1

        def strong(found, least):
            out = {}
            for w, c in found[1].items():
                odds = math.log((c + 0.1) / total[1]) - math.log((found[0][w] + 0.1) / total[0])
                if c >= least and odds > 2.5:
                    out[w] = min(odds, 6.0)
            return out

        return cls(strong(word, 4) | {w: 4.0 for w in LEXICON}, strong(stem, 6))

    def features(self, text: str) -> list[float]:
        if not text:
            return [0.0] * N_FEATURES
        lower = text.lower()
        words = lower.split()
        n = len(words) or 1
        known, stems = self.words, self.stems
        hits: list[tuple[int, float]] = []
        stem_hits = second = 0
        stem_best = 0.0
        odd = 0
        you: list[int] = []
        seen: dict[str, tuple[float, float, bool, bool]] = {}
        for i, raw in enumerate(words):
            found = seen.get(raw)
            if found is None:
                w = raw.strip(".,;:!?\"'()*_-")
                mixed = not w.isalpha() and any(c.isalpha() for c in w) and not w.replace("'", "").replace("-", "").isalpha()
                weight = known.get(w, 0.0)
                if mixed and not weight:
                    plain = w.translate(_SIGNS)
                    weight = known.get(plain, 0.0) or known.get(re.sub(r"[^\w]|_", "", plain), 0.0)
                found = seen[raw] = (weight, stems.get(w[:4], 0.0) if len(w) > 4 else 0.0, mixed, w in SECOND)
            weight, stem, mixed, is_you = found
            if weight:
                hits.append((i, weight))
            if stem:
                stem_hits += 1
                stem_best = max(stem_best, stem)
            odd += mixed
            if is_you:
                you.append(i)
        second = len(you)
        near = 0.0
        if hits and you:
            at = np.array(you)
            where, weights = np.array(hits).T
            after = np.searchsorted(at, where)
            gap = np.minimum(np.abs(at[np.minimum(after, len(at) - 1)] - where), np.abs(at[np.maximum(after - 1, 0)] - where))
            near = float((weights / (1 + gap)).sum())
        capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        size = len(text)
        marks = sum(map(text.count, "!?"))
        total = sum(w for _, w in hits)
        return [
            len(hits) / n * 100, min(len(hits), 50), total / n * 100, max((w for _, w in hits), default=0.0),
            stem_hits / n * 100, min(stem_hits, 50), stem_best,
            second / n * 100, near / n * 100, min(near, 50.0),
            capitals / size, marks / size * 100, sum(map(text.count, ".,;:")) / size * 100,
            odd / n * 100, len(_LONG.findall(lower)) / n * 100 if hits else 0.0, math.log1p(n),
        ]


N_FEATURES = 16


class Trees:
    """Boosted regression trees on binned features, log loss, Newton leaves."""

    def __init__(self) -> None:
        self.base, self.edges, self.trees = 0.0, [], []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.concatenate((np.quantile(x[:, k], np.linspace(0, 1, BINS // 2)[1:-1]), np.linspace(x[:, k].min(), x[:, k].max(), BINS // 2)[1:-1]))) for k in range(x.shape[1])]
        b = self.bins(x)
        p = y.mean()
        self.base = math.log(p / (1 - p))
        f = np.full(len(y), self.base)
        width = BINS + 1
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            tree: list[list] = []
            for _depth in range(DEPTH):
                split = []
                for leaf in range(1 << _depth):
                    rows = np.flatnonzero(node == leaf)
                    best = (1e-3, 0, width)
                    for k in range(x.shape[1]) if len(rows) > 20 else ():
                        gs = np.cumsum(np.bincount(b[rows, k], g[rows], width))
                        hs = np.cumsum(np.bincount(b[rows, k], h[rows], width))
                        cs = np.cumsum(np.bincount(b[rows, k], minlength=width))
                        gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                        gain[(cs < 8) | (cs > cs[-1] - 8)] = 0
                        at = int(gain.argmax())
                        if gain[at] > best[0]:
                            best = (gain[at], k, at)
                    split.append((best[1], best[2]))
                k, cut = np.array(split).T
                node = 2 * node + (b[np.arange(len(y)), k[node]] > cut[node])
                tree.append([k, cut])
            leaf_g, leaf_h = np.bincount(node, g, 1 << DEPTH), np.bincount(node, h, 1 << DEPTH)
            value = RATE * np.clip(leaf_g / (leaf_h + 1), -4, 4)
            f += value[node]
            self.trees.append((tree, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, f = self.bins(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for k, cut in tree:
                node = 2 * node + (b[rows, k[node]] > cut[node])
            f += value[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the non-decreasing least-squares fit."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, least x, greatest x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        if blocks and blocks[-1][3] == a:
            m, w, lo, _ = blocks.pop()
            blocks.append([(m * w + b) / (w + 1), w + 1, lo, a])
        else:
            blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, hi = blocks.pop()
            n, v, lo, _ = blocks.pop()
            blocks.append([(m * w + n * v) / (w + v), w + v, lo, hi])
    return np.array([x for m in blocks for x in (m[2], m[3])]), np.array([m[0] for m in blocks for _ in (0, 1)])


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees | None, knots, constant: float) -> None:
        self.lexicon, self.trees, self.knots, self.constant = lexicon, trees, knots, constant

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        f = self.trees.raw(np.array([self.lexicon.features(t or "") for t in texts]).reshape(-1, N_FEATURES))
        # the steps of the fit have no order within them: a little of the raw score keeps it
        return np.clip(0.98 * np.interp(f, *self.knots) + 0.02 / (1 + np.exp(-f)), 0, 1)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Lexicon from one half, trees on all, calibration on out-of-fold raw scores."""
    y = np.array(labels, float)
    if len(y) < 20 or y.min() == y.max():
        return Model(Lexicon({}, {}), None, None, float(y.mean()) if len(y) else 0.0)
    fold = np.arange(len(y)) % 3
    out = np.zeros(len(y))
    for k in range(3):
        # a lexicon learned on the other folds: words seen only in one document teach no false trust
        rest = np.flatnonzero(fold != k)
        own = Lexicon.learn([texts[i] for i in rest], [labels[i] for i in rest])
        x = np.array([own.features(t) for t in texts])
        inner = np.flatnonzero(fold == k)
        if y[rest].min() == y[rest].max():
            continue
        out[inner] = Trees().fit(x[rest], y[rest]).raw(x[inner])
    lexicon = Lexicon.learn(texts, labels)
    x = np.array([lexicon.features(t) for t in texts])
    return Model(lexicon, Trees().fit(x, y), isotonic(out, y), 0.0)


def train(docs: DataFrame, labels: DataFrame, fold: int = 4, left_out: int = 2, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of whole labelled rows."""
    with _run.tables() as made:
        got = sorted((r.doc_id, r.text, r.label) for r in labelled_sample(docs, labels, "toxic", fold, left_out, sample, most_bytes).collect())
    _run.drop_cut(docs.sparkSession, *made)
    return fit([r[1] for r in got], [r[2] for r in got])


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of (text, ...) and the score of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred words and 60 small trees

    def run(it):
        model = shared.value
        for b in _text.batches(it, 1 << 20):
            s = model.scores(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], [*keep, "score"])

    _run.small_batches(docs.sparkSession)
    df = docs.select(*keep, "text")
    return df.mapInArrow(_run.tidy(run), df.select(*keep).schema.add("score", "double"))


def op2_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``; a quarter of the labels is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
