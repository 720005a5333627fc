"""Language-model scores by stupid backoff, computed with joins.

The model is the corpus itself, and for each document the rest of it: with
``n(g)`` the count of an n-gram in all texts less that in the document, a word
w after a history h scores ``n(hw) / n(h)`` at the longest history, of up to
``order - 1`` words, with which it has been seen elsewhere, times ``ALPHA`` for
every word that the history was cut by.  Without any history it scores
``c(w) / N``, the document's own words counted too, so that no word scores
zero.  A document's score is the sum of the logarithms.

A word seen at one order is seen at all lower ones, so the score is a sum over
orders: what every word scores alone, and for each order k the difference

    log n(hw) - log n(h) - log ALPHA - (score of w one order lower)

of the n-grams seen elsewhere, which four counts make: those of the n-gram, of
all but its last word, all but its first, and all but both.  Each order is one
join of n-grams exploded from the texts to their count table:

1. n-grams are counted by batch, dealt out by hash into parts, and summed; of
   orders above one only those that several texts have are kept.  Three joins
   to the lower orders' tables add the other counts.
2. The n-grams of each text are exploded, one row for each different one, and
   joined to the counts by part; the differences go back to the batch, a row for
   each batch and part, and are summed there by text.
   The ``HEAD`` most common n-grams, a bounded table, are looked up before the
   shuffle, so no part holds the rows of a very common one.

Rows of one batch and part travel together as arrays in one binary value.
Orders above one are done in ``PASSES`` parts of the hash range, which bounds
the disk that shuffles take.  N-grams are told apart by 64-bit hashes.

Defined results: null and empty texts score 0 with 0 words, and their mean is
0; rows of one doc_id are texts of one document, each with own counts of its
own; a null doc_id is a document too; ties don't arise; further columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import _run, _text

ALPHA = 0.4
ORDER = 2
PASSES = 2
#: N-grams of an order that are looked up before the shuffle.
HEAD = 100_000
_THREE, _DOC = np.uint64(3), np.uint64(0xD1342543DE82EF95)


class Batch:
    """Hashes of the n-grams that end at each word of some texts, and how often each is in its text."""

    def __init__(self, column: pa.Array, order: int) -> None:
        data, off = _text.flat(column)
        data = _text.LOWER[data]
        s, e, counts = _text.word_spans(data, off)
        self.counts = counts
        self.doc = np.repeat(np.arange(len(counts) - 1, dtype=np.int32), np.diff(counts))
        self.place = np.arange(len(s)) - counts[:-1][self.doc]
        self.hashes = [_text.span_hashes(data, s, e)]
        for _ in range(1, order):
            h = self.hashes[-1]
            longer = np.zeros_like(h)
            longer[1:] = _text.mix(h[:-1] * _THREE + h[1:])
            self.hashes.append(longer)

    def ends(self, k: int, part: int, parts: int) -> np.ndarray:
        """Where n-grams of order k and of one part of the hash range end."""
        i = np.flatnonzero(self.place >= k - 1)
        return i if parts == 1 else i[self.hashes[k - 1][i] % np.uint64(parts) == np.uint64(part)]

    def runs(self, k: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the places ``i`` by text and n-gram of order k, where runs of equal ones start in it, and their lengths."""
        return _runs_of(_text.mix(self.hashes[k - 1][i] + self.doc[i].astype(np.uint64) * _DOC))

    def own(self, k: int) -> np.ndarray:
        """How often the text has the n-gram of order k that ends at each word."""
        out = np.zeros(len(self.doc), np.int32)
        i = np.flatnonzero(self.place >= k - 1) if k > 1 else np.arange(len(self.doc))
        order, at, many = self.runs(k, i)
        out[i[order]] = np.repeat(many.astype(np.int32), many)
        return out


def _runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by the key; where runs of equal keys start in it; and their lengths."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(order), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    at = np.flatnonzero(new)
    return order, at, np.diff(np.append(at, len(order)))


def _parts_of(spark: SparkSession) -> int:
    """Parts that n-grams are dealt out into: one for each shuffle partition."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _dealt(gram: np.ndarray, passes: int, parts: int):
    """(part, indexes) of n-grams dealt out by hash."""
    part = (gram // np.uint64(passes) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    dealt = part[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(dealt)), bool), dealt[1:] != dealt[:-1])))
    return dealt[at].astype(np.int64), np.split(order, at[1:]) if len(at) else []


def _packed(arrays: list[np.ndarray], rows: list[np.ndarray]) -> pa.Array:
    return pa.array([b"".join(a[i].tobytes() for a in arrays) for i in rows], pa.binary())


def _unpacked(blocks: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    """The arrays of several blocks, each put together."""
    size = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in blocks:
        n, at = len(b) // size, 0
        for k, held in zip(kinds, out):
            held.append(np.frombuffer(b, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) for x in out]


def gram_counts(docs: DataFrame, k: int, part: int, passes: int) -> DataFrame:
    """``(part, gram, prefix, suffix, mid, c, texts)`` of order k, for one part of the hash range.

    Of orders above one only n-grams that several texts have.  ``prefix`` lacks
    the last word, ``suffix`` the first, ``mid`` both; they are null below order 2, ``mid`` below 3.
    """
    parts = _parts_of(docs.sparkSession)
    kinds = [np.uint64] * (min(k, 3) if k > 1 else 1) + [np.int32, np.int32]

    def blocks(it):
        for b in _text.batches(it, 4 << 20):
            x = Batch(b.column(0), k)
            i = x.ends(k, part, passes)
            order, at, own = x.runs(k, i)
            if not len(at):
                continue
            i = i[order[at]]  # one place for each text and n-gram
            order, first, texts = _runs_of(x.hashes[k - 1][i])
            n, texts, end = np.add.reduceat(own[order], first).astype(np.int32), texts.astype(np.int32), i[order[first]]
            each = x.hashes[k - 1][end]
            keys = [each] if k == 1 else [x.hashes[k - 2][end - 1], x.hashes[k - 2][end]] + ([x.hashes[k - 3][end - 1]] if k > 2 else [])
            p, rows = _dealt(each, passes, parts)
            yield pa.RecordBatch.from_arrays([pa.array(p), _packed([*keys, n, texts], rows)], ["part", "block"])

    def summed(it):
        for t, at in _text.runs(it, "part"):
            for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
                *keys, n, texts = _unpacked(t.column("block").slice(a, z - a).to_pylist(), kinds)
                gram = keys[0] if k == 1 else _text.mix(keys[0] * _THREE + keys[1])
                order, first, _ = _runs_of(gram)
                c, t2 = np.add.reduceat(n[order].astype(np.int64), first), np.add.reduceat(texts[order].astype(np.int64), first)
                keep = np.flatnonzero(t2 > 1) if k > 1 else np.arange(len(first))
                row = order[first[keep]]
                columns = [pa.array(x[row].view(np.int64)) for x in ([gram] if k == 1 else [gram, *keys])]
                columns += [pa.nulls(len(row), pa.int64())] * (4 - len(columns))
                own_part = pa.array(np.full(len(row), t.column("part")[a].as_py()))
                yield pa.RecordBatch.from_arrays([own_part, *columns, pa.array(c[keep]), pa.array(t2[keep])], ["part", "gram", "prefix", "suffix", "mid", "c", "texts"])

    rows = docs.select("text").mapInArrow(_run.tidy(blocks), "part long, block binary")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(_run.tidy(summed), "part long, gram long, prefix long, suffix long, mid long, c long, texts long")


def _gain(k: int, own: list[np.ndarray], c: np.ndarray, prefix: np.ndarray, suffix: np.ndarray, mid: np.ndarray, alpha: float, total: int) -> np.ndarray:
    """What a text's n-grams of order k add to its score; ``own`` has the text's counts of n-gram, prefix, suffix and mid."""
    if k == 1:
        return own[0] * (np.log(c.astype(float)) - math.log(total))
    n = c - own[0]
    hit = np.flatnonzero(n > 0)
    out = np.zeros(len(c))
    lower = np.log(suffix[hit].astype(float)) - math.log(total) if k == 2 else np.log((suffix[hit] - own[2][hit]).astype(float)) - np.log((mid[hit] - own[3][hit]).astype(float))
    out[hit] = own[0][hit] * (np.log(n[hit].astype(float)) - np.log((prefix[hit] - own[1][hit]).astype(float)) - math.log(alpha) - lower)
    return out


def _steps(words: np.ndarray, order: int) -> np.ndarray:
    """How many words histories are cut by in all if every word of a text of so many words is scored alone."""
    full = np.maximum(words - order + 1, 0)
    short = np.minimum(words, order - 1)
    return full * (order - 1) + short * (short - 1) // 2


def gains(docs: DataFrame, table: DataFrame, k: int, part: int, passes: int, alpha: float, total: int, head: int = HEAD, order: int = ORDER) -> DataFrame:
    """``(doc_id, n_words, s)``: what n-grams of order k and of one part of the hash range add, in a row a text at most.

    ``table`` has (part, gram, c, prefix_c, suffix_c, mid_c, texts).  With order 1 come
    the numbers of words, and the factors of a text's words all backed off.
    """
    spark, top_order = docs.sparkSession, order
    parts = _parts_of(spark)
    counted = ["c", "prefix_c", "suffix_c", "mid_c"]
    top = table.orderBy(F.desc("texts"), "gram").limit(max(1, head // passes)).select("gram", *counted).toArrow()  # bounded
    top = top.take(np.argsort(top.column("gram").to_numpy().view(np.uint64), kind="stable"))
    common = spark.sparkContext.broadcast([top.column("gram").to_numpy().view(np.uint64), *[top.column(c).to_numpy() for c in counted]])
    kinds = [np.uint64, np.int32] + [np.int32] * (1 if k == 1 else 2 if k == 2 else 4)
    made_of = ["batch", "part", "block", "docs", "words", "s"]

    def blocks(it):
        known, *values = common.value
        first = TaskContext.get().partitionId() << 32
        for batch, b in enumerate(_text.batches(it, 2 << 20), first):
            x = Batch(b.column(1), k)
            i = x.ends(k, part, passes)
            order, at, many = x.runs(k, i)
            end = i[order[at]]
            gram, doc, own = x.hashes[k - 1][end], x.doc[end], [many.astype(np.int32)]
            if k > 1:
                own.append(x.own(k - 1)[end - 1])
            if k > 2:
                own += [x.own(k - 1)[end], x.own(k - 2)[end - 1]]
            s = np.zeros(b.num_rows)
            inside = np.zeros(len(gram), bool)
            if len(known) and len(gram):
                where = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                inside = known[where] == gram
                h, w = np.flatnonzero(inside), where[inside]
                s += np.bincount(doc[h], _gain(k, [o[h] for o in own], *[v[w] for v in values], alpha, total), b.num_rows)
            words = np.diff(x.counts)
            if k == 1:
                s += _steps(words, top_order) * math.log(alpha)
            whole = pa.array([0, b.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, x) for x in (b.column(0), pa.array(words if k == 1 else np.zeros(b.num_rows, np.int64)), pa.array(s))]
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *lists], made_of)
            rest = np.flatnonzero(~inside)
            if not len(rest):
                continue
            p, some = _dealt(gram[rest], passes, parts)
            none = [pa.nulls(len(p), pa.list_(t)) for t in (pa.int64(), pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), batch)), pa.array(p), _packed([gram, doc, *own], [rest[j] for j in some]), *none], made_of)

    def joined(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """What each block adds to the texts of its batch, as one row."""
        batch, sums = left.column("batch").to_numpy(), []
        at = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            held = left.column("block").to_pylist()
            gram, doc, *own = _unpacked(held, kinds)
            size = [len(z) // sum(np.dtype(q).itemsize for q in kinds) for z in held]
            known = right.column("gram").to_numpy().view(np.uint64)
            order = np.argsort(known)
            known = known[order]
            where = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            h = np.flatnonzero(known[where] == gram)
            w = order[where[h]]
            gain = _gain(k, [o[h] for o in own], *[right.column(c).to_numpy()[w] for c in counted], alpha, total)
            place = (np.repeat(np.arange(len(size)), size)[h] << 32) + doc[h]  # block and text
            order, first, _ = _runs_of(place)
            if len(first):
                gain, place = np.add.reduceat(gain[order], first), place[order[first]]
                cuts = np.flatnonzero(np.diff(place >> 32)) + 1
                at = place[np.concatenate(([0], cuts))] >> 32
                sums = _packed([(place & 0xFFFFFFFF).astype(np.int32), gain], np.split(np.arange(len(place)), cuts))
        return pa.table({"batch": batch[at], "sums": pa.array(sums, pa.binary())})

    def summed(it):
        for t, at in _text.runs(it, "batch"):
            for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
                rows = t.slice(a, z - a)
                i = int(np.flatnonzero(rows.column("docs").is_valid().to_numpy())[0])
                ids, words, s = (rows.column(c).slice(i, 1).combine_chunks().flatten() for c in ("docs", "words", "s"))
                s, words = s.to_numpy(), words.to_numpy()
                if len(rows) > 1:
                    doc, gain = _unpacked([x for x in rows.column("sums").to_pylist() if x is not None], [np.int32, np.float64])
                    s = s + np.bincount(doc, gain, len(s))
                some = np.arange(len(s)) if k == 1 else np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(words[some]), pa.array(s[some])], ["doc_id", "n_words", "s"])

    schema = "batch long, part long, block binary, docs array<long>, words array<long>, s array<double>"
    made = _run.cut(docs.select("doc_id", "text").mapInArrow(_run.tidy(blocks), schema), "grams")
    met = made.where("part is not null").select("part", "batch", "block").groupBy("part").cogroup(table.select("part", "gram", *counted).groupBy("part")).applyInArrow(joined, "batch long, sums binary")
    rows = made.where("part is null").select("batch", "docs", "words", "s").unionByName(met, allowMissingColumns=True)
    out = rows.repartition("batch").sortWithinPartitions("batch").mapInArrow(_run.tidy(summed), "doc_id long, n_words long, s double")
    out = _run.cut(out, "scores")
    _run.drop_cut(spark, made)
    return out


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, passes: int = PASSES, head: int = HEAD) -> DataFrame:
    """``(doc_id, n_words, log_score)`` for each doc_id, by n-grams of up to ``order`` words."""
    spark = docs.sparkSession
    _run.small_batches(spark, 500)
    none = F.lit(None).cast("long")
    words = _run.cut(gram_counts(docs, 1, 0, 1), "words")
    total = words.agg(F.sum("c")).first()[0] or 1
    tables = [words.select("gram", "c")]
    table = words.select("part", "gram", "c", *[F.lit(0).cast("long").alias(x) for x in ("prefix_c", "suffix_c", "mid_c")], "texts")
    out = gains(docs, table, 1, 0, 1, alpha, total, head, order)
    for k in range(2, order + 1):
        own = []
        for p in range(passes):
            found = gram_counts(docs, k, p, passes)
            lower = tables[k - 2]
            found = found.join(lower.toDF("prefix", "prefix_c"), "prefix").join(lower.toDF("suffix", "suffix_c"), "suffix")
            found = found.join(tables[k - 3].toDF("mid", "mid_c"), "mid") if k > 2 else found.withColumn("mid_c", none)
            found = _run.cut(found.select("part", "gram", "c", "prefix_c", "suffix_c", F.coalesce("mid_c", F.lit(0).cast("long")).alias("mid_c"), "texts"), "counts")
            out = out.unionByName(gains(docs, found, k, p, passes, alpha, total, head))
            own.append(found)
        every = own[0].select("gram", "c")
        for x in own[1:]:
            every = every.unionByName(x.select("gram", "c"))
        tables.append(every)
    return out.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("s").alias("log_score"))


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all ``documents`` against the rest of the corpus, in all and a word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    mean = F.coalesce(F.col("log_score") / F.nullif("n_words", F.lit(0)), F.lit(0.0))
    return score(docs).select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), g AS (SELECT doc_id, r, unnest(list_transform(range(1, len(ws) + 1), lambda i: {'u': CASE WHEN i > 1 THEN ws[i - 1] END, 'v': ws[i]})) AS x FROM d
), b AS (SELECT doc_id, r, x.u AS u, x.v AS v, count(*) AS own FROM g GROUP BY ALL
), w AS (SELECT r, v, sum(own) AS own FROM b GROUP BY r, v
), c1 AS (SELECT v, sum(own) AS c FROM w GROUP BY v
), c2 AS (SELECT u, v, sum(own) AS c FROM b WHERE u IS NOT NULL GROUP BY u, v
), t AS (SELECT sum(c) AS n FROM c1
), s AS (
  SELECT b.doc_id, CASE
      WHEN b.u IS NULL THEN b.own * ln(cv.c::DOUBLE / n)
      WHEN c2.c > b.own THEN b.own * ln((c2.c - b.own)::DOUBLE / (cu.c - wu.own))
      ELSE b.own * ln(0.4 * cv.c::DOUBLE / n) END AS s
  FROM b CROSS JOIN t JOIN c1 cv ON cv.v = b.v LEFT JOIN c1 cu ON cu.v = b.u LEFT JOIN w wu ON wu.v = b.u AND wu.r = b.r LEFT JOIN c2 ON c2.u = b.u AND c2.v = b.v
), z AS (SELECT doc_id, sum(s) AS s FROM s GROUP BY doc_id)
SELECT d.doc_id, sum(len(ws))::BIGINT AS n_words, round(coalesce(any_value(z.s), 0), 4) AS log_score, round(coalesce(coalesce(any_value(z.s), 0) / nullif(sum(len(ws)), 0), 0), 6) AS mean_log_score
FROM d LEFT JOIN z ON z.doc_id IS NOT DISTINCT FROM d.doc_id GROUP BY d.doc_id
"""
