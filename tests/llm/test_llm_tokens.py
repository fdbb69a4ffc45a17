"""Token files and byte-level BPE against the public libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pinprice.llm import arrow_tokens as A
from pinprice.llm import bpe_queue as B
from pinprice.session import shared_dir

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "The", "ing", " ", "  ", "\n", "\t", "\r\n", "é", "É", "ΑΣ", "日本", "'s", "'LL", "1", "22", "!", "###", "...", "\x1c",
         "\xa0", "​", " ", "é", "x" * 50, "ab" * 40, "=", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "😀", "ﬁ"]


def texts(n, seed=4):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_runs_between_spaces_give_the_ids_of_whole_texts():
    library, own = Tokenizer.from_file(WORDS), A.ChunkEncoder(WORDS)
    some = [*texts(600), None, "", " ", "word " * 3000]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in some]
    assert [x.tolist() for x in own.encode(some)] == want


def test_a_full_cache_starts_again(monkeypatch):
    monkeypatch.setattr(A, "CACHE", 10)
    own, some = A.ChunkEncoder(WORDS), texts(40)
    fresh = A.ChunkEncoder(WORDS)
    assert [own.encode([t])[0].tolist() for t in some] == [fresh.encode([t])[0].tolist() for t in some]


@pytest.mark.parametrize("seq,seqs,batch", [(8, 4, 2), (2048, 512, 64)])
def test_files_hold_the_stream(spark, seq, seqs, batch):
    library = Tokenizer.from_file(WORDS)
    docs = [(i * 3, t) for i, t in enumerate(texts(60))] + [(400, None), (401, ""), (402, "long " * 800), (30, "twice"), (30, "also"),
                                                           (30, "twice"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    folder = shared_dir(spark, "test-tokens")
    files = A.write_tokens(df, folder, WORDS, 2, seq=seq, seqs=seqs, batch=batch)
    got = sorted(map(tuple, A.read_checksums(files, folder, seq, seqs, batch).collect()), key=lambda r: r[1])
    key = lambda d: (d[0] is not None, d[0] or 0, np.array(ids(d[1]), "<u2").tobytes())
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    at, want = 0, []
    for i, t in sorted(docs, key=key):
        x = ids(t)
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert got == want
    reader = A.Reader(folder, files.orderBy("part").first()["part"], seq, seqs, batch)
    first, mask = reader.sequence(0)
    assert len(first) == seq and not first.flags.owndata and isinstance(mask, pa.BooleanArray)
    assert A.read_checksums(A.write_tokens(df.limit(0), shared_dir(spark, "test-tokens"), WORDS, 2), folder).count() == 0


# -- byte-level BPE


@pytest.fixture(scope="module")
def codec():
    return B.Codec(RANKS, P.PATTERN)


def plain(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_ids_equal_the_library_and_decode(codec):
    library = plain(codec.vocabulary)
    some = [*texts(800, 9), "", None, "a  b", " a", "a ", "x\n y", "lone space \n", "abcab" * 4000, "=" * 3000, "Aa " * 5000]
    for t, ids in zip(some, codec.encode(some), strict=True):
        assert ids == np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert codec.decode(ids) == (t or "").encode()


def test_one_queue_for_many_equals_one_by_one(codec):
    rnd = random.Random(8)
    some = ["".join(rnd.choice("abcdefghinorst=- é0") for _ in range(rnd.randint(1, 70))).encode() for _ in range(1500)]
    assert [x.tolist() for x in codec.vocabulary.encode_many(some)] == [codec.vocabulary.encode_one(x) for x in some]


def test_merges_that_open_a_lower_rank():
    """Ranks no training gives: order inside a bucket matters, and both ways still agree with the library."""
    rnd = random.Random(3)
    for _ in range(60):
        tokens = {bytes([i]): i for i in range(256)}
        words = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5))) for _ in range(40)})
        rnd.shuffle(words)
        tokens |= {w: 256 + i for i, w in enumerate(words)}
        v = B.Vocabulary(tokens)
        library = plain(v)
        some = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 40))) for _ in range(40)]
        some = [s for s in some if s not in tokens]
        want = [library.encode_ordinary(s.decode()) for s in some]
        assert [v.encode_one(s) for s in some] == want
        assert [x.tolist() for x in v.encode_many(some)] == want


def test_rank_queue_finds_the_least():
    q, held, rnd = B.RankQueue(300_000), set(), random.Random(1)
    assert q.first() == -1
    for _ in range(3000):
        r = rnd.randrange(300_000)
        if r in held or (held and rnd.random() < 0.4):
            r = min(held)
            q.discard(r)
            held.discard(r)
        else:
            q.add(r)
            held.add(r)
        assert q.first() == min(held, default=-1)


def test_frames_round_trip(spark, codec):
    rows = [(1, "some text\n", "x"), (1, "some text\n", "x"), (None, None, None), (2, "", "y"), (3, "z" * 40_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = B.encode(df, RANKS, P.PATTERN, digests=True)
    back = B.decode(out, RANKS, P.PATTERN)
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in back.collect()) == sorted(
        (i or 0, t or "") for i, t, _ in rows)
    assert all(r["n_tokens"] == len(r["ids"]) for r in out.collect())
    assert B.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_rank_file_has_every_byte():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    assert all(bytes([i]) in ranks for i in range(256))
