"""Removal of repeated passages by suffix sorting with bucket-pointer refinement.

A byte goes if a string of ``width`` bytes covers it that starts at another
place too, in the same document or another.

Not every suffix has to be sorted.  Each start picks an anchor: the least
hash among the grams, two fifths of a string long, inside its string, the rightmost on ties.
Equal strings pick equal grams at equal offsets, so strings can only be equal
within the group of one gram.  Neighbouring starts with one anchor form a
segment.  Groups of one gram that occurs once have no repeats; groups whose
segments are all the same are repeats throughout; the segments of the other
groups, each different one once, are suffix-sorted: buckets of 8-byte grams
are refined by sorting on the bucket identifiers at the offset reached so far,
and the refined identifiers serve the next, twice as deep, refinement.

A group with more bytes than one task should sort is refined across tasks
first, by what its strings have in common besides the gram: strings that start
equally far before the anchor, within ``SLICES`` positions, share a core, and
only those with equal cores stay together.  Bytes are compared by sorting, or
by 128 bits of a cryptographic digest: of whole texts, segments and cores.
Hashes of grams only bring together what is compared then.

A document whose text another row repeats is all repeats if it has ``width``
bytes, so equal texts take part once.

Defined results: null text is an empty text; texts shorter than ``width``
bytes lose nothing and cause nothing; repeated rows are copies of each other;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import _run, _text

SLAB = 1 << 17
#: Bytes of a group that one suffix sort takes; a group beyond it is refined by cores first.
SORTED = 1 << 20
#: Offsets from the anchor that share a core, in each refinement; with one, the core is the string.
SLICES = (32, 1)


def gram_size(width: int) -> int:
    return max(1, width * 2 // 5)


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any stretch follows."""
    q = np.zeros(len(data) + 1, np.uint64)
    codes = data.astype(np.uint64)
    codes += np.uint64(1)
    codes *= _text.powers(len(data))
    np.cumsum(codes, out=q[1:])
    return q


def _window_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by running minima within blocks from both ends."""
    n = len(a)
    full = -(-n // w) * w
    b = np.full(full, np.uint64(2**64 - 1))
    b[:n] = a
    b = b.reshape(-1, w)
    head = np.minimum.accumulate(b, axis=1).ravel()
    tail = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def segments(data: np.ndarray, off: np.ndarray, width: int, gram: int | None = None, bits: int = 64):
    """Segments of a batch of texts: document, start, starts, gram hash, digest (16 bytes each), anchor behind the start."""
    gram = gram or gram_size(width)
    w = width - gram + 1
    mask = np.uint64((1 << 21) - 1)
    parts = []
    last = np.maximum(off[1:] - width, -1)  # last start of each document, if any
    for at in range(0, max(0, len(data) - width + 1), SLAB):
        stop = min(at + SLAB, len(data) - width + 1)  # starts at .. stop-1
        text = data[at : stop + width - 1 + w]
        n = stop - at
        q = _sums(text)
        g = (q[gram : n + w - 1 + gram] - q[: n + w - 1]) * _text.inverse_powers(n + w - 1)
        g = _text.mix(g) & np.uint64(2**64 - 2 ** (64 - bits))
        key = g & ~mask | (mask - np.arange(len(g), dtype=np.uint64))
        d0, d1 = np.searchsorted(off, [at, stop - 1], "right") - 1
        ok = np.zeros(n, bool)
        for d in range(d0, d1 + 1):
            a, b = max(off[d], at), min(last[d] + 1, stop)
            if b > a and last[d] >= off[d]:
                ok[a - at : b - at] = True
        s = np.flatnonzero(ok)
        if not len(s):
            continue
        p = (mask - (_window_min(key, w)[s] & mask)).astype(np.int64)
        doc = np.searchsorted(off, s + at, "right") - 1
        cut = np.ones(len(s), bool)
        cut[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1) | (doc[1:] != doc[:-1])
        i = np.flatnonzero(cut)
        runs = np.diff(np.append(i, len(s)))
        s0 = s[i]
        held = text.tobytes()
        own = np.array([digest(held[a:b]) for a, b in zip(s0.tolist(), (s0 + runs + width - 1).tolist())], "V16")
        parts.append((doc[i], s0 + at - off[doc[i]], runs, g[p[i]], own, p[i] - s0))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), np.zeros(0, "V16"), z
    return tuple(np.concatenate(x) for x in zip(*parts))


def refine(data: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """Bucket pointers of depth ``depth`` by bucket-pointer refinement.

    ``stop`` has the end of the segment that each position is in.  Positions
    with ``depth`` bytes before it get equal numbers exactly if those bytes are
    equal, and numbers in the order of the bytes; others get -1.
    """
    n = len(data)
    room = stop - np.arange(n)
    out = np.full(n, -1, np.int64)
    first = 8 if depth >= 8 else 1
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    grams = np.ndarray(n, ">u8", padded.tobytes(), 0, (1,)).astype(np.uint64) if first == 8 else data.astype(np.uint64)
    pos = np.flatnonzero(room >= first)
    if not len(pos):
        return out
    b = np.full(n, -1, np.int64)

    def number(pos: np.ndarray, high: np.ndarray, low: np.ndarray, base: np.ndarray | None) -> np.ndarray:
        """Give sub-buckets their pointers; the positions that still share one."""
        order = np.lexsort((low, high))
        pos, high, low = pos[order], high[order], low[order]
        new_high = np.ones(len(pos), bool)
        new_high[1:] = high[1:] != high[:-1]
        new = new_high.copy()
        new[1:] |= low[1:] != low[:-1]
        idx = np.flatnonzero(new)
        size = np.diff(np.append(idx, len(pos)))
        rank = np.repeat(idx, size)
        if base is not None:
            top = np.flatnonzero(new_high)
            rank = high + rank - np.repeat(top, np.diff(np.append(top, len(pos))))
        b[pos] = rank
        return pos[np.repeat(size > 1, size)]

    shared = number(pos, grams[pos], np.zeros(len(pos), np.int64), None)
    reach = first
    while reach < depth:
        step = min(reach, depth - reach)
        act = shared[room[shared] >= reach + step]
        if step < reach:
            later = b.copy()
        else:
            later = b
        shared = number(act, b[act], later[act + step], b) if len(act) else act
        reach += step
    whole = room >= depth
    out[whole] = b[whole]
    return out


def _sort_groups(gram: np.ndarray, texts: list[bytes], starts: np.ndarray, weight: np.ndarray, width: int):
    """For each segment, whether each of its starts has its string elsewhere too."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = starts + width - 1
    end = np.cumsum(size)
    b = refine(data, np.repeat(end, size), width)
    at = np.repeat(end - size - (np.cumsum(starts) - starts), starts) + np.arange(int(starts.sum()))
    _, inv = np.unique(b[at], return_inverse=True)
    count = np.bincount(inv, np.repeat(weight, starts))
    return np.split(count[inv] > 1, np.cumsum(starts)[:-1])


def _ranges(flags: np.ndarray) -> bytes:
    """Runs of true flags as int32 pairs (first, past the last)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge.astype(np.int32).tobytes()


def _repeats_in_groups(width: int):
    def emit(t, flags):
        first = t.column("skip").to_numpy()
        found = [np.frombuffer(_ranges(f), np.int32) + k for f, k in zip(flags, first.tolist())]
        return pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("gram", "own")] + [_text.binaries(found)], ["gram", "own", "ranges"])

    def run(it):
        for t, at in _text.runs(it, "task"):
            n = t.column("starts").to_numpy().astype(np.int64)
            size = np.cumsum(n + width - 1)
            weight = t.column("n").to_numpy()
            i = 0
            while i < len(at) - 1:  # small groups share a sort: strings of different ones differ
                a, done = int(at[i]), size[at[i] - 1] if at[i] else 0
                j = max(i + 1, int(np.searchsorted(size[at[1:] - 1], done + SORTED, "right")))
                b = int(at[j])
                part = t.slice(a, b - a)
                yield emit(part, _sort_groups(part.column("gram").to_numpy(), part.column("segment").to_pylist(), n[a:b], weight[a:b], width))
                i = j

    return run


def _sorted_repeats(pieces: DataFrame, width: int) -> DataFrame:
    """``(gram, own, ranges)`` of pieces in groups (gram, core) that one task can sort."""
    rows = pieces.select("gram", "own", "n", "starts", "skip", "segment", F.xxhash64("gram", "core").alias("task"))
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(_run.tidy(_repeats_in_groups(width)), "gram long, own binary, ranges binary")


_PIECE = "gram long, own binary, n long, starts int, anchor int, skip int, core binary, segment binary"


def _by_cores(pieces: DataFrame, slice_: int, width: int) -> DataFrame:
    """Cut pieces where the distance of their strings to the anchor passes a multiple of ``slice_``; ``core`` is of what the strings of each share."""

    def run(it):
        for b in it:
            out = []
            for gram, own, n, starts, anchor, skip, core, segment in zip(*(c.to_pylist() for c in b.columns)):
                at = 0
                while at < starts:
                    step = (anchor - at) // slice_
                    stop = min(starts, anchor - step * slice_ + 1)  # the strings that start at .. stop-1 are in one slice
                    low = anchor - (step + 1) * slice_ + 1
                    common = segment[anchor - step * slice_ : low + width]
                    out.append((gram, own, n, stop - at, anchor - at, skip + at, digest(core + step.to_bytes(8, "big") + common), segment[at : stop + width - 1] if slice_ > 1 else b""))
                    at = stop
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], _run.names(_PIECE))

    return pieces.mapInArrow(_run.tidy(run), _PIECE)


def _repeats_in_wide_groups(pieces: DataFrame, width: int) -> DataFrame:
    """The same of groups that no single task should sort: refined by cores until they are small or all equal."""
    spark, done = pieces.sparkSession, None
    for slice_ in SLICES:
        pieces = _run.cut(_by_cores(pieces, slice_, width), "cores")
        sizes = pieces.groupBy("gram", "core").agg(F.sum(F.length("segment")).alias("size"), F.sum("n").alias("members"))
        sizes = _run.cut(sizes.where("members > 1"), "sizes")  # as a table, so that a join on a hot group can be split
        met = pieces.join(sizes.hint("merge"), ["gram", "core"])
        if slice_ == 1:  # the core is the string: all of a group are equal
            found = met.select("gram", "own", _pairs("skip", "skip + starts").alias("ranges"))
        else:
            found = _sorted_repeats(met.where(F.col("size") <= SORTED), width)
        done = found if done is None else done.unionByName(found)
        pieces = met.where(F.col("size") > SORTED).drop("size", "members")
        if slice_ == 1 or not sizes.where(F.col("size") > SORTED).limit(1).count():
            break
        pieces = pieces.select(*_run.names(_PIECE))
    return done


def _pairs(first: str, past: str):
    """One range as int32 pair, in the byte order of numpy arrays."""
    def little(x):
        return F.reverse(F.expr(f"to_binary(lpad(hex(cast({x} as int)), 8, '0'), 'hex')"))

    return F.concat(little(first), little(past))


def text_key():
    """What a text is known by: 128 bits of its SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)


def repeated_ranges(docs: DataFrame, width: int = 400, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Keys of texts that several rows have, and for each text key the starts of repeated strings.

    The first table has (key, copies), the second (key, found): where segments
    start, and ranges of starts in them.  With fewer ``bits`` of the gram hashes more comes together
    that has to be told apart; the result is the same.
    """
    spark = docs.sparkSession

    def scan(it):
        for b in _text.batches(it, 2 << 20):
            data, off = _text.flat(b.column(2))
            doc, s0, n, gram, own, anchor = segments(data, off, width, bits=bits)
            bounds = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            digests = pa.Array.from_buffers(pa.binary(16), len(own), [None, pa.py_buffer(own.tobytes())]).cast(pa.binary())
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(s0.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(gram.view(np.int64)), digests, pa.array(anchor.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["doc_id", "key", "s0", "starts", "gram", "own", "anchor"])

    _run.small_batches(spark, 500)
    keyed = docs.select("doc_id", text_key().alias("key"), "text")
    scanned = keyed.mapInArrow(_run.tidy(scan), "doc_id long, key binary, s0 array<int>, starts array<int>, gram array<long>, own array<binary>, anchor array<int>")
    scanned = _run.cut(scanned, "segments")
    rows = scanned.select("doc_id", "key")
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("from")).where("copies > 1")
    copies = _run.cut(copies, "copies")  # as a table, so that a join on a hot text can be split
    each = scanned.where("size(gram) > 0").join(copies.withColumnRenamed("key", "k").hint("merge"), F.col("key") == F.col("k"), "left")
    each = each.where("copies is null or doc_id <=> `from`")
    seg = each.select("key", "doc_id", F.explode(F.arrays_zip("s0", "starts", "gram", "own", "anchor")).alias("x")).select("key", "doc_id", "x.*")
    owns = _run.cut(seg.groupBy("gram", "own").agg(F.count("*").alias("c")), "owns")
    grams = owns.groupBy("gram").agg(F.sum("c").alias("members"), F.count("*").alias("kinds")).where("members > 1")
    grams = _run.cut(grams.select("gram", F.expr("kinds > 1").alias("mixed")), "grams")  # as a table, so that a join on a hot gram can be split
    shared = _run.cut(owns.join(grams.hint("merge"), "gram"), "shared")  # as a table, so that a join on a hot segment can be split
    _run.drop_cut(spark, owns)
    seg = _run.cut(seg.join(shared.hint("merge"), ["gram", "own"]), "met")
    different = seg.where("mixed").groupBy("gram", "own").agg(F.count("*").alias("n"), F.min(F.struct("key", "s0", "doc_id", "starts", "anchor")).alias("x"))
    different = _run.cut(different.select("gram", "own", F.least("n", F.lit(2)).alias("n"), "x.*"), "different")

    def cut_out(it):
        for b in it:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            s0, n = b.column(4).to_numpy(), b.column(5).to_numpy()
            seg = pa.array([x[s : s + k + width - 1] for x, s, k in zip(texts, s0.tolist(), n.tolist())], pa.binary())
            skip, core = pa.array(np.zeros(b.num_rows, np.int32)), pa.array([b""] * b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:4], *b.columns[5:7], skip, core, seg, b.column(7)], [*_run.names(_PIECE), "wide"])

    wide = different.groupBy("gram").agg(F.sum(F.col("starts") + width - 1).alias("size")).where(F.col("size") > SORTED).select("gram", F.lit(True).alias("wide"))
    wide = _run.cut(wide, "wide")
    mixed = different.join(wide.hint("merge"), "gram", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    wanted = mixed.groupBy("key", "doc_id").agg(F.collect_list(F.struct("gram", "own", "n", "s0", "starts", "anchor", "wide")).alias("want"))
    same = (keyed["key"] == wanted["key"]) & keyed["doc_id"].eqNullSafe(wanted["doc_id"])
    texts = keyed.join(wanted.hint("merge"), same).select("text", F.explode("want").alias("x")).select("text", "x.*")
    texts = texts.mapInArrow(_run.tidy(cut_out), _PIECE + ", wide boolean")
    found = _sorted_repeats(texts.where("not wide"), width)
    if wide.limit(1).count():
        found = found.unionByName(_repeats_in_wide_groups(texts.where("wide").drop("wide"), width))
    found = _run.cut(found.dropDuplicates(["gram", "own", "ranges"]), "found")  # as a table, so that a join on a hot segment can be split

    some = different.where("n = 1").select("gram", "own", "key", "s0").join(found.hint("merge"), ["gram", "own"]).where("length(ranges) > 0").select("key", "s0", "ranges")
    every = seg.where("not mixed or c > 1").select("key", "s0", _pairs("0", "starts").alias("ranges"))  # a segment that occurs again repeats throughout
    ranges = every.unionByName(some).groupBy("key").agg(F.collect_list(F.struct("s0", "ranges")).alias("found"))
    return copies.select("key", "copies"), ranges


def _starts(found: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """First and past of all ranges of starts of one text."""
    parts = [np.frombuffer(x["ranges"], np.int32).reshape(-1, 2) + x["s0"] for x in found.as_py() or ()]
    both = np.concatenate(parts) if parts else np.zeros((0, 2), np.int32)
    return both[:, 0], both[:, 1]


def spans_of(n_bytes: int, copied: bool, first, past, width: int) -> np.ndarray:
    """Maximal removed runs (start, end) of one text."""
    if copied and n_bytes >= width:
        return np.array([[0, n_bytes]])
    if not len(first):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(first, kind="stable")
    a, b = first[order].astype(np.int64), past[order].astype(np.int64) + width - 1
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    i = np.flatnonzero(new)
    return np.stack((a[i], reach[np.append(i[1:] - 1, len(a) - 1)]), 1)


def with_spans(docs: DataFrame, width: int, keep: list[str], finish, schema: str, bits: int = 64) -> DataFrame:
    """Apply ``finish(batch, texts, spans)`` to all rows with the spans to remove of each text."""
    with _run.tables() as made:
        copied, ranges = repeated_ranges(docs, width, bits)
        marks = ranges.join(copied.hint("merge"), "key", "full")
    marks = _run.cut(marks, "marks")  # as a table, so that a join on a hot text can be split
    _run.drop_cut(docs.sparkSession, *made)
    keyed = docs.select(*keep, "text", text_key().alias("key"))

    def run(it):
        for b in _text.batches(it, 4 << 20):
            col = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            texts = [x or b"" for x in col["text"].cast(pa.large_binary()).to_pylist()]
            spans = []
            for x, f, c in zip(texts, col["found"], col["copies"].to_pylist()):
                spans.append(spans_of(len(x), c is not None, *_starts(f), width))
            yield finish(b, texts, spans)

    marked = keyed.join(marks.hint("merge"), "key", "left").select(*keep, "text", "found", "copies")
    return marked.mapInArrow(_run.tidy(run), schema)


def _left(text: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return text
    edge = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[i:j] for i, j in zip(edge[::2], edge[1::2]))


def removed(docs: DataFrame, width: int = 400, bits: int = 64) -> DataFrame:
    """``(doc_id, n_bytes, spans array<struct<start,end>>, kept binary)`` of each row."""

    def finish(b, texts, spans):
        lists = [[{"start": a, "end": z} for a, z in s.tolist()] for s in spans]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(lists, kind), pa.array([_left(x, s) for x, s in zip(texts, spans)], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return with_spans(docs, width, ["doc_id"], finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary", bits)


def without_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """The documents (doc_id, text, lang, source, n_chars) without their repeated passages.

    A character that is cut in part goes whole.  ``n_chars`` follows the text.
    """

    def finish(b, texts, spans):
        out = [_left(x, s).decode("utf-8", "ignore") for x, s in zip(texts, spans)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(1), b.column(2), pa.array([len(x) for x in out], pa.int64())], ["doc_id", "text", "lang", "source", "n_chars"])

    return with_spans(docs, width, ["doc_id", "lang", "source"], finish, "doc_id long, text string, lang string, source string, n_chars long")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every whole text of ``documents`` without repeats of 400 bytes."""

    def finish(b, texts, spans):
        gone = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
        digest = [hashlib.sha256(_left(x, s)).hexdigest() for x, s in zip(texts, spans)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_spans(docs, 400, ["doc_id"], finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
