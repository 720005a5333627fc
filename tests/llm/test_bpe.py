import hashlib
import random
import subprocess
import sys

import public_tokenizers
import pytest
import tiktoken

from quernstone.llm import bpe
from tests.llm.helpers import documents

DATA = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(DATA)
    return bpe.BytePairCoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = [" ", "\n", "\t", "a", "b", "the", "'s", "'", "1", "é", "　", "\xa0", "\x85", "\x1c", "​", "ß", "漢", "!", "\x00", "😀", "٣", "\r", "  ", "\n\n", "x", " ", "<|endoftext|>", "lowercase", "ing"]


def test_same_ids_as_the_library(both):
    coder, library = both
    r = random.Random(4)
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 16))) for _ in range(8000)]
    for i in range(0, len(texts), 97):
        for text, ids in zip(texts[i : i + 97], coder.encode(texts[i : i + 97])):
            assert ids.tolist() == library.encode_ordinary(text), text
            assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 300_000, "ab" * 100_000, "ñ" * 50_000, " " * 5000 + "x", "x" + "\n" * 3000 + "y", "0" * 9999, "abcdefg" * 20_000 + "!" * 20_000])
def test_very_long_pieces(both, text):
    coder, library = both
    (ids,) = coder.encode([text])
    assert coder.decode(ids) == text.encode()
    if len(text) <= 20_000:  # the library is quadratic in a piece's length
        assert ids.tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("wide", [1, 2, 10**9])
def test_buckets_at_once_and_one_by_one(both, wide, monkeypatch):
    coder, library = both
    monkeypatch.setattr(bpe, "WIDE", wide)
    r = random.Random(wide)
    pieces = ["".join(r.choices(r.choice(["ab", "aeiounrst", "0123456789", "éü日本語a", "the in on er "]), k=r.choice([2, 3, 30, 400]))) for _ in range(1500)]
    got = coder.merge([p.encode() for p in pieces])
    singly = [" ".join(map(str, library._encode_single_piece(p.encode()))) for p in pieces]
    assert got == singly


def test_every_code_point(both):
    coder, library = both
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["x".join(points[i : i + 512]) for i in range(0, len(points), 512)] + [" ".join(points[i : i + 512]) for i in range(0, len(points), 512)]
    for i in range(0, len(texts), 64):
        for text, ids in zip(texts[i : i + 64], coder.encode(texts[i : i + 64])):
            assert ids.tolist() == library.encode_ordinary(text), hex(ord(text[0]))


@pytest.mark.parametrize("text", ["'a' * 20_000_000", "'some words and others, ' * 900_000"])
def test_texts_of_20_mb_in_bounded_memory(text):
    program = f'''
import resource, public_tokenizers
from quernstone.llm import bpe
coder = bpe.BytePairCoder(bpe.load_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()), public_tokenizers.PATTERN)
text = {text}
((n, _, back),) = bpe.digests(coder, [text])
import hashlib
assert back == hashlib.sha256(text.encode()).hexdigest() and n
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
'''
    most = int(subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, check=True).stdout)
    assert most < (1300 if text.startswith("'a'") else 600)  # one piece of 20 MB, or a text of many


def test_queue_gives_lowest_rank_first():
    q, r = bpe.RankQueue(70_000), random.Random(2)
    held = [(r.randrange(70_000), i) for i in range(500)]
    for rank, i in held:
        q.push(rank, i)
    out = []
    while (rank := q.first()) >= 0:
        out += [(rank, i) for i in sorted(q.buckets[rank])]
        q.drop(rank)
    assert out == sorted(held)


def test_query_columns(spark, both):
    coder, library = both
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x\n\n y\t z"), (1, "a b"), (4, "long " * 50_000)]
    got = sorted((tuple(r) for r in bpe.round_trip(documents(spark, rows)).collect()), key=str)
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(documents(spark, rows)))
    assert sorted((bytes(r.data) for r in back.collect())) == sorted((t or "").encode() for _, t in rows)
    assert bpe.round_trip(documents(spark, [])).count() == 0
