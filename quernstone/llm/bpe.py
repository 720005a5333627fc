"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merges that may be done wait in one bucket per merge rank; a bitmap tree over
the ranks gives the lowest non-empty bucket by find-first-set.  A bucket holds
linked-list positions.  A position whose pair has changed since is stale and is
skipped when its bucket comes up.  Pieces never merge with each other, so all
pieces that a batch needs share one queue, and a piece of a million bytes takes
time in proportion to its length.

A large bucket is worked off in a few array operations.  That is right as long
as no merge in it makes a pair of a lower rank, which is looked up first;
otherwise its positions are worked off one by one, from the left, and wait
whenever a lower rank has come up.

Defined results: null text is an empty text; an empty text has no tokens and
decodes to no bytes; repeated rows give repeated results; further columns are
ignored; an empty table gives an empty table.  Texts of any length are worked
off in groups of chunks, so memory follows the longest single piece (about 60
bytes for each of its bytes), not the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import _run, _text

#: Bytes of chunks and their ids that a worker remembers; when full, it keeps them until as many new ones have come.
REMEMBERED = 64 << 20
#: Chunks that are looked up together; characters of a text cut, and positions of a bucket worked off, together.
GROUP, SLAB = 400_000, 1 << 20
#: Positions from which on a bucket is worked off in array operations.
WIDE = 24
#: What an entry takes besides its characters.
_ENTRY = 200
#: Blanks (and the character that marks cuts) besides space and line feed.
_OTHER_BLANKS = re.compile(r"[\x00\x0b-\x0d\x09\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]").search
# Letters and numbers since Unicode 17 (hexadecimal), which the tiktoken library doesn't know as such.
_SINCE_17 = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF
10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F
12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2
18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF
1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_NEWER = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in _SINCE_17.split()) + "]")


class RankQueue:
    """Positions by rank, with a tree of 64-bit words over the ranks in use."""

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int] | np.ndarray | None] = [None] * ranks
        self.levels: list[list[int]] = []
        while True:
            ranks = (ranks + 63) >> 6
            self.levels.append([0] * ranks)
            if ranks == 1:
                break

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.fill(rank, [position])
        elif type(bucket) is list:
            heappush(bucket, position)
        else:
            self.buckets[rank] = bucket = bucket.tolist()
            heappush(bucket, position)

    def fill(self, rank: int, positions: list[int] | np.ndarray) -> None:
        """Give a rank that isn't in use its bucket, in ascending order."""
        self.buckets[rank] = positions
        for words in self.levels:
            at = rank >> 6
            had = words[at]
            words[at] = had | 1 << (rank & 63)
            if had:
                return
            rank = at

    def extend(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Push many at once."""
        order = np.lexsort((positions, ranks))
        ranks = ranks[order]
        cut = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        positions = positions[order]
        if len(positions) < 1 << 16:
            positions = positions.tolist()
        for rank, i, j in zip(ranks[cut].tolist(), cut, [*cut[1:], len(positions)]):
            bucket = self.buckets[rank]
            if bucket is None:
                self.fill(rank, positions[i:j])
            elif type(bucket) is list and j - i == 1:
                heappush(bucket, int(positions[i]))
            elif len(bucket) + j - i < 1 << 12:
                bucket = [*map(int, bucket), *map(int, positions[i:j])]
                heapify(bucket)
                self.buckets[rank] = bucket
            else:
                self.buckets[rank] = np.sort(np.concatenate((np.asarray(bucket, np.int32), np.asarray(positions[i:j], np.int32))))

    def first(self) -> int:
        """The lowest rank in use, or -1."""
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                return -1
            at = at << 6 | (word & -word).bit_length() - 1
        return at

    def drop(self, rank: int) -> None:
        """The rank is no longer in use."""
        self.buckets[rank] = None
        for words in self.levels:
            at = rank >> 6
            words[at] &= ~(1 << (rank & 63))
            if words[at]:
                break
            rank = at


class _Partners:
    """For each token the tokens that make a token with it on one side, and which."""

    def __init__(self, own: np.ndarray, other: np.ndarray, rank: np.ndarray, n: int) -> None:
        order = np.lexsort((other, own))
        self.start = np.searchsorted(own[order], np.arange(n + 1)).tolist()
        self.other, self.rank = other[order], rank[order]

    def of(self, token: int, others: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of one token with each of the others, -1 without one."""
        a, z = self.start[token], self.start[token + 1]
        if a == z:
            return np.full(len(others), -1, np.int32)
        known = self.other[a:z]
        at = np.minimum(np.searchsorted(known, others), z - a - 1)
        return np.where(known[at] == others, self.rank[a:z][at], np.int32(-1))


class BytePairCoder:
    """Encodes and decodes by merge ranks (bytes of a token -> its id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        compiled = regex.compile(pattern)
        self.found, self.matches = compiled.findall, compiled.finditer
        #: Whether a text may be cut around single blanks before the pattern runs.
        self.blanks = pattern.endswith(r" ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        n = max(ranks.values()) + 1
        self.text = [str(i) for i in range(n)]
        #: The bytes of each id, by its decimal digits.
        self.token = {self.text[rank]: piece for piece, rank in ranks.items()}
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        #: The rank of each pair of bytes, -1 without one.
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int32)
        found = [(ranks[left], ranks[right], rank) for piece, rank in ranks.items() for k in range(1, len(piece)) if (left := piece[:k]) in ranks and (right := piece[k:]) in ranks]
        left, right, rank = np.array(found, np.int32).reshape(-1, 3).T
        self.after, self.before = _Partners(left, right, rank, n), _Partners(right, left, rank, n)
        #: Every pair of tokens that makes a token: left << 32 | right -> rank.
        self.pairs = {a << 32 | b: r for a, b, r in found}
        self.queue = RankQueue(n)
        self.room = REMEMBERED
        self.known: dict[str, str] = {}
        self.earlier: dict[str, str] = {}
        self.size = 0

    def merge(self, pieces: list[bytes]) -> list[str]:
        """The ids of each non-empty piece, in digits with a blank between."""
        get = self.ranks.get
        out = ["" if (r := get(p)) is None else self.text[r] for p in pieces]
        rest = [k for k, ids in enumerate(out) if not ids]
        if not rest:
            return out
        data = np.frombuffer(b"".join([pieces[k] for k in rest]), np.uint8)
        end = np.cumsum([len(pieces[k]) for k in rest])
        n = len(data)
        # each position is a list node: its token, the rank of its pair with the next one, its neighbours
        tok, cur = self.byte[data], np.full(n, -1, np.int32)
        cur[:-1] = self.byte_pairs[data[:-1], data[1:]]
        cur[end - 1] = -1
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[end - 1], prv[end[:-1]] = -1, -1
        at = np.flatnonzero(cur >= 0).astype(np.int32)
        if len(at) and (cur[at[0]] != cur[at]).any():
            at = at[np.argsort(cur[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(cur[at], prepend=-1)).tolist()
        queue = self.queue
        for r, i, j in zip(cur[at[cuts]].tolist(), cuts, [*cuts[1:], len(at)]):
            queue.fill(r, at[i:j] if j - i >= WIDE else at[i:j].tolist())
        singly: set[int] = set()  # ranks whose merges make pairs of lower ranks
        views = [memoryview(x) for x in (tok, cur, nxt, prv)]
        while (rank := queue.first()) >= 0:
            bucket = queue.buckets[rank]
            if len(bucket) < WIDE or rank in singly or not self._all_at_once(rank, bucket, tok, cur, nxt, prv):
                if type(bucket) is not list:
                    queue.buckets[rank] = bucket = bucket.tolist()
                if self._one_by_one(rank, bucket, *views):
                    singly.add(rank)
        alive = tok >= 0
        many = np.add.reduceat(alive, end - np.diff(end, prepend=0)).tolist()
        ids = iter(map(self.text.__getitem__, tok[alive].tolist()))
        for k, m in zip(rest, many):
            out[k] = " ".join(islice(ids, m))
        return out

    def _all_at_once(self, rank: int, bucket, tok: np.ndarray, cur: np.ndarray, nxt: np.ndarray, prv: np.ndarray) -> bool:
        """Work off a bucket in array operations; false, with nothing done, if a pair of a lower rank would come up."""
        a = np.array(sorted(bucket), np.int32) if type(bucket) is list else bucket
        a, later = a[:SLAB], a[SLAB:]
        a = a[cur[a] == rank]
        if len(a):
            fresh = np.ones(len(a), bool)
            fresh[1:] = a[1:] != a[:-1]
            a = a[fresh]
        if not len(a):
            self._leave(rank, later)
            return True
        j = nxt[a]
        linked = np.zeros(len(a), bool)
        linked[1:] = a[1:] == j[:-1]
        if linked.any():  # of pairs in a row, the first, third, ... merge
            i = np.arange(len(a), dtype=np.int32)
            odd = (i - np.maximum.accumulate(np.where(linked, np.int32(0), i))) & 1 == 0
            a, j = a[odd], j[odd]
        k = nxt[j]
        p = prv[a]
        both = np.zeros(len(a), bool)  # the node that follows merges too
        both[:-1] = k[:-1] == a[1:]
        right = np.where(k >= 0, self.after.of(rank, tok[k]), np.int32(-1))
        left = np.where(p >= 0, self.before.of(rank, tok[p]), np.int32(-1))
        left[1:][both[:-1]] = -1
        twice = self.pairs.get(rank << 32 | rank, -1)
        if ((right >= 0) & (right < rank)).any() or ((left >= 0) & (left < rank)).any() or 0 <= twice < rank:
            return False
        right[both] = twice
        tok[a], tok[j] = rank, -1
        nxt[a], cur[j] = k, -1
        inner = k >= 0
        prv[k[inner]] = a[inner]
        cur[a] = right
        open_ = p >= 0
        open_[1:] &= ~both[:-1]
        cur[p[open_]] = left[open_]
        self._leave(rank, later)
        r, at = np.concatenate((right, left)), np.concatenate((a, p))
        ok = r >= 0
        self.queue.extend(r[ok], at[ok])
        return True

    def _leave(self, rank: int, later: np.ndarray) -> None:
        if len(later):
            self.queue.buckets[rank] = later
        else:
            self.queue.drop(rank)

    def _one_by_one(self, rank: int, bucket: list[int], tok, cur, nxt, prv) -> bool:
        """Work off a bucket, a heap, from the left until a pair of a lower rank comes up; whether one has."""
        pair, push = self.pairs.get, self.queue.push
        while bucket:
            i = heappop(bucket)
            if cur[i] != rank:
                continue  # stale
            j = nxt[i]
            k = nxt[i] = nxt[j]
            tok[i] = rank
            cur[j] = tok[j] = -1
            lower = False
            r = -1
            if k >= 0:
                prv[k] = i
                r = pair(rank << 32 | tok[k], -1)
                if r >= 0:
                    push(r, i)
                    lower = r < rank
            cur[i] = r
            p = prv[i]
            if p >= 0:
                r = pair(tok[p] << 32 | rank, -1)
                cur[p] = r
                if r >= 0:
                    push(r, p)
                    lower |= r < rank
            if lower and bucket:
                return True
        self.queue.drop(rank)
        return False

    def split(self, text: str) -> list[str]:
        """What the pattern matches, with the classes of characters of Unicode 16."""
        if text.isascii() or not _NEWER.search(text):
            return self.found(text)
        return [text[m.start() : m.end()] for m in self.matches(_NEWER.sub("\u0378", text))]

    def chunks(self, text: str) -> Iterator[list[str]]:
        """Cut where the pattern always ends a match, so that few chunks differ.

        A blank between two other characters starts a match whatever stands
        before it; texts with longer runs of blanks, or other blanks than space and line
        feed, go to the pattern whole.
        """
        if not self.blanks or _OTHER_BLANKS(text) or any(x in text for x in ("  ", "\n\n", " \n", "\n ")):
            if len(text) <= SLAB:
                yield self.split(text)
                return
            found = (text[m.start() : m.end()] for m in self.matches(text if text.isascii() else _NEWER.sub("\u0378", text)))
            while part := list(islice(found, GROUP)):
                yield part
            return
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > SLAB:
                stop = text.find(" ", at + SLAB)
                stop = len(text) if stop < 0 else stop
            part = text if stop - at == len(text) else text[at:stop]
            yield [c for c in part.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00") if c]
            at = stop

    def groups(self, texts: Iterable[str]) -> Iterator[tuple[list[tuple[int, list[str]]], dict[str, str]]]:
        """Chunks of the texts, (text, chunks) in order, with a dictionary that has at least their ids."""
        held: list[tuple[int, list[str]]] = []
        many = 0
        for row, text in enumerate(texts):
            for part in self.chunks(text):
                held.append((row, part))
                many += len(part)
                if many >= GROUP:
                    yield held, self._learn(set().union(*(c for _, c in held)))
                    held, many = [], 0
        if held:
            yield held, self._learn(set().union(*(c for _, c in held)))

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, special tokens unknown."""
        at, own = 0, []
        texts = list(texts)
        for held, known in self.groups(texts):
            for row, part in held:
                while at < row:
                    yield self._ids(own)
                    at, own = at + 1, []
                own.append(" ".join(map(known.__getitem__, part)))
        while at < len(texts):
            yield self._ids(own)
            at, own = at + 1, []

    @staticmethod
    def _ids(parts: list[str]) -> np.ndarray:
        return np.array(" ".join(x for x in parts if x).split(), np.int32)

    def _learn(self, wanted: set[str]) -> dict[str, str]:
        """The ids of at least these chunks."""
        if self.size > self.room:
            self.known, self.earlier, self.size = {}, self.known, 0
        known, earlier = self.known, self.earlier
        fresh = []
        for c in wanted.difference(known):
            ids = earlier.get(c)
            if ids is None:
                fresh.append(c)
            else:
                known[c] = ids
                self.size += _ENTRY + len(c) + len(ids)
        split = [[c] if (c[1:] if c[:1] == " " else c).isalpha() else self.split(c) for c in fresh]
        pieces = [p for p in set(chain.from_iterable(split)) if p not in known]
        ids = dict(zip(pieces, self.merge([p.encode() for p in pieces])))
        for c, s in zip(fresh, split):
            known[c] = found = " ".join([ids.get(p) or known[p] for p in s])
            self.size += _ENTRY + len(c) + len(found)
        return known

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.token[self.text[i]] for i in ids])

    def decoded(self, digits: str) -> bytes:
        """The bytes of ids in digits with a blank between."""
        return b"".join(map(self.token.__getitem__, digits.split(" "))) if digits else b""


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Read a rank file: base64 of the token, a blank and the rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_CODERS: dict[tuple[int, str], BytePairCoder] = {}
_run.FORGET.append(_CODERS.clear)


def coder_of(data: bytes, pattern: str) -> BytePairCoder:
    """One coder per worker and vocabulary."""
    key = (hash(data), pattern)
    if key not in _CODERS:
        _CODERS[key] = BytePairCoder(load_ranks(data), pattern)
    return _CODERS[key]


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:  # a driver-side vocabulary file of fixed size
        return spark.sparkContext.broadcast(f.read()), pattern


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: ``(id, ids array<int>)``."""
    data, pattern = _vocabulary(docs.sparkSession, path, pattern)

    def run(it):
        coder = coder_of(data.value, pattern)
        for b in _text.batches(it, 1 << 20):
            ids = list(coder.encode(t or "" for t in b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    _run.small_batches(docs.sparkSession)
    df = docs.selectExpr(f"`{id_col}`", f"`{text_col}` as text")
    return df.mapInArrow(_run.tidy(run, remember=True), f"`{id_col}` {df.schema[0].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every list of ids: ``(id, data binary)``; null ids decode to no bytes."""
    data, pattern = _vocabulary(tokens.sparkSession, path, None)

    def run(it):
        coder = coder_of(data.value, pattern)
        for b in it:
            out = [coder.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [id_col, "data"])

    df = tokens.selectExpr(f"`{id_col}`", f"`{ids_col}` as ids")
    return df.mapInArrow(_run.tidy(run, remember=True), f"`{id_col}` {df.schema[0].dataType.simpleString()}, data binary")


def digests(coder: BytePairCoder, texts: list[str]) -> list[tuple[int, str, str]]:
    """Of each text: number of ids, digests of the ids in digits and of the bytes that they decode to."""
    n, said, back = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
    for held, known in coder.groups(texts):
        for row, part in held:
            digits = " ".join(map(known.__getitem__, part))
            if digits:
                said[row].update((" " + digits if n[row] else digits).encode())
                n[row] += digits.count(" ") + 1
                back[row].update(coder.decoded(digits))
    return [(k, a.hexdigest(), b.hexdigest()) for k, a, b in zip(n, said, back)]


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Encode and decode every text: token count and digests of ids and of decoded bytes.

    ``remembered`` trades a worker's memory, twice as many bytes, for time.
    """
    data, pattern = _vocabulary(docs.sparkSession, path, pattern)

    def run(it):
        coder = coder_of(data.value, pattern)
        coder.room = remembered
        for b in _text.batches(it, 2 << 20):
            n, ids_hex, back_hex = zip(*digests(coder, [t or "" for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(back_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    _run.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_run.tidy(run, remember=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every whole text of ``documents``."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
