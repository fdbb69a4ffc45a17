"""Byte-level BPE with a hierarchical-bitmap rank queue.

Pairs that can merge wait in one bucket per merge rank, which holds positions
of a linked list of symbols. A bitmap of several levels marks the buckets in
use, so that find-first-set at each level gives the least rank. An entry whose
pair has changed since is stale and skipped. The cost of a merge doesn't depend
on the length of the pre-token, so a very long one costs no more per byte.

Many pre-tokens share one queue: pairs never reach across a pre-token's bound,
so merging a whole bucket at once (overlapping pairs from the left) does in
each of them what its own queue would do. Where a merge opens a pair of lower
rank than the one at hand, order inside a bucket matters; such pre-tokens are
encoded again one merge at a time.

Defined results: a null or empty text has no ids; special strings are ordinary
text; repeated rows and equal texts give equal ids; an empty table gives no
rows; every text is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinprice.llm.common import ship_package, slices

CACHE = 500_000
FLUSH = 1 << 22  # bytes of new pre-tokens that share one queue


class RankQueue:
    """The set of ranks in use, as a bitmap of 64-bit words with summary levels above."""

    def __init__(self, n: int):
        self.levels: list[list[int]] = []
        while True:
            n = -(-n // 64)
            self.levels.append([0] * n)
            if n == 1:
                break

    def add(self, rank: int) -> None:
        for level in self.levels:
            word, bit = divmod(rank, 64)
            old = level[word]
            level[word] = old | (1 << bit)
            if old:
                return
            rank = word

    def discard(self, rank: int) -> None:
        for level in self.levels:
            word, bit = divmod(rank, 64)
            level[word] &= ~(1 << bit)
            if level[word]:
                return
            rank = word

    def first(self) -> int:
        """The least rank in use, -1 if there is none."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = 64 * at + (word & -word).bit_length() - 1
        return at


class Vocabulary:
    """Ranks of a rank file and, for every pair of tokens, the token they merge to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it doesn't merge."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def encode_one(self, token: bytes) -> list[int]:
        """Ids of one pre-token, one merge at a time, leftmost first within a rank."""
        sym = [int(self.byte[b]) for b in token]
        n = len(sym)
        after, before, rank_at = [*range(1, n), -1], [-1, *range(n - 1)], [-1] * n
        known = dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True)) if n > 1 << 16 else None
        queue, buckets = RankQueue(self.size), {}

        def look(p: int) -> None:
            q = after[p]
            rank = -1
            if q >= 0:
                if known is not None:
                    rank = known.get(sym[p] * self.size + sym[q], -1)
                else:
                    rank = self.ranks.get(self.bytes[sym[p]] + self.bytes[sym[q]], -1)
            rank_at[p] = rank
            if rank >= 0:
                if rank not in buckets:
                    buckets[rank] = []
                    queue.add(rank)
                heapq.heappush(buckets[rank], p)

        for p in range(n):
            look(p)
        while (rank := queue.first()) >= 0:
            p = heapq.heappop(buckets[rank])
            if not buckets[rank]:
                del buckets[rank]
                queue.discard(rank)
            if rank_at[p] != rank:
                continue
            q = after[p]
            sym[p], sym[q], rank_at[q] = rank, -1, -1
            after[p] = after[q]
            if after[p] >= 0:
                before[after[p]] = p
            look(p)
            if before[p] >= 0:
                look(before[p])
        return [s for s in sym if s >= 0]

    def encode_many(self, tokens: list[bytes]) -> list[np.ndarray]:
        """Ids of every pre-token, from one queue for all of them."""
        if not tokens:
            return []
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        first = np.concatenate([[0], np.cumsum(sizes)])
        sym = self.byte[np.frombuffer(b"".join(tokens), np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[first[1:][sizes > 0] - 1] = -1
        before[first[:-1][sizes > 0]] = -1
        rank_at = np.full(n, -1, np.int64)
        inner = np.flatnonzero(after >= 0)
        rank_at[inner] = self.merge(sym[inner], sym[after[inner]])
        queue, buckets = RankQueue(self.size), {}
        odd: list[np.ndarray] = []  # positions whose pre-token needs its own order

        def push(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for rank, i, j in zip(ranks[bounds[:-1]].tolist(), bounds[:-1], bounds[1:], strict=True):
                if rank in buckets:
                    buckets[rank].append(places[i:j])
                else:
                    buckets[rank] = [places[i:j]]
                    queue.add(rank)

        live = np.flatnonzero(rank_at >= 0)
        if len(live):
            push(live, rank_at[live])
        while (rank := queue.first()) >= 0:
            held = buckets.pop(rank)
            queue.discard(rank)
            p = held[0] if len(held) == 1 else np.concatenate(held)
            p = p[rank_at[p] == rank]
            if not len(p):
                continue
            if len(p) > 1:
                if len(held) > 1:
                    p = np.unique(p)
                # of pairs that overlap in a row, take every other one from the left
                joined = after[p[:-1]] == p[1:]
                if joined.any():
                    opens = np.concatenate([[True], ~joined])
                    at = np.arange(len(p))
                    p = p[(at - np.maximum.accumulate(np.where(opens, at, 0))) % 2 == 0]
            q = after[p]
            s = after[q]
            # where the next symbol opens a merge of this bucket too, the pair in between might have come first
            if len(p) > 1 and (near := np.flatnonzero(s[:-1] == p[1:])).size:
                between = self.merge(np.full(len(near), rank), sym[s[near]])
                if (low := (between >= 0) & (between < rank)).any():
                    odd.append(p[near[low]])
            sym[p], sym[q], rank_at[q], after[p] = rank, -1, -1, s
            has = s >= 0
            before[s[has]] = p[has]
            left = before[p]
            left = left[left >= 0]
            places = np.concatenate([p, left]) if len(left) else p
            right = after[places]
            fresh = np.full(len(places), -1, np.int64)
            ok = np.flatnonzero(right >= 0)
            if len(ok):
                fresh[ok] = self.merge(sym[places[ok]], sym[right[ok]])
            rank_at[places] = fresh
            good = fresh >= 0
            if good.any():
                places, fresh = places[good], fresh[good]
                if (low := fresh < rank).any():
                    odd.append(places[low])
                push(places, fresh)
        keep = np.flatnonzero(sym >= 0)
        ids, at = sym[keep], np.searchsorted(keep, first)
        out = [ids[at[i]:at[i + 1]] for i in range(len(tokens))]
        if odd:
            for i in np.unique(np.searchsorted(first, np.concatenate(odd), side="right") - 1).tolist():
                out[i] = np.array(self.encode_one(tokens[i]), np.int64)
        return out


class Codec:
    """Texts to ids and back; runs between single spaces are encoded once and remembered."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        import regex

        self.vocabulary = Vocabulary.load(path)
        self.find = regex.compile(pattern).findall
        # a single space between other characters always opens a pre-token; elsewhere the whole text is split
        self.uneven = regex.compile(r"\s(?= )| (?=\s|$)").search
        self.known: dict[str, bytes] = {}
        self.cache = cache

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        out: list[bytes] = []
        runs: list[list[str]] = []
        size = 0
        for t in texts:
            t = t or ""
            if self.uneven(t):
                runs.append(self.find(t))
            else:
                head, *rest = t.split(" ")
                runs.append([head, *[" " + r for r in rest]] if head else [" " + r for r in rest])
            size += len(t)
            if size > FLUSH:
                out += self._ids(runs)
                runs, size = [], 0
        return out + self._ids(runs)

    def _ids(self, runs: list[list[str]]) -> list[bytes]:
        new = set().union(*runs).difference(self.known)
        if len(self.known) + len(new) > self.cache:
            self.known.clear()
            new = set().union(*runs)
        ranks = self.vocabulary.ranks
        split = {r: [p.encode("utf-8", "surrogatepass") for p in self.find(r)] for r in new}
        parts = list({p for x in split.values() for p in x if p not in ranks})
        code = {p: i.astype("<u4").tobytes() for p, i in zip(parts, self.vocabulary.encode_many(parts), strict=True)}
        for r, x in split.items():
            self.known[r] = b"".join(code[p] if p in code else ranks[p].to_bytes(4, "little") for p in x)
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in runs]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a rank file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


_DIGESTS = ("n_tokens long", "ids_sha256 string", "decoded_sha256 string")


def _coded(path: str, pattern: str, ids: bool, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in slices(batches, 4096):  # the more pre-tokens share a queue, the less each costs
            kept = [b.column(i) for i in range(b.num_columns - 1)]
            code = own.encode(b.column(b.num_columns - 1).to_pylist())
            more, names = [], []
            if ids:
                values = pa.array(np.frombuffer(b"".join(code), "<u4").astype(np.int32))
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in code])]).astype(np.int32)
                more.append(pa.ListArray.from_arrays(pa.array(bounds), values))
                names.append("ids")
            if digests:
                more += [pa.array([len(x) // 4 for x in code], pa.int64()),
                         pa.array([hashlib.sha256(x).hexdigest() for x in code], pa.string()),
                         pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in code], pa.string())]
                names += [d.split()[0] for d in _DIGESTS]
            yield pa.RecordBatch.from_arrays([*kept, *more], names=b.schema.names[:-1] + names)
    return run


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
           ids: bool = True, digests: bool = False) -> DataFrame:
    """The kept columns with ``ids`` (array of int) and, if wanted, their count, their digest and the decoded bytes' one."""
    ship_package(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    ddl += ["ids array<int>"] * ids + list(_DIGESTS) * digests
    return kept.mapInArrow(_coded(path, pattern, ids, digests), ", ".join(ddl))


def _decoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.binary())], names=batch.schema.names[:-1] + ["decoded"])
    return run


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ``decoded`` (binary): the bytes of the ids."""
    ship_package(rows.sparkSession)
    kept = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids_col}`").alias("__ids"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", decoded binary"
    return kept.mapInArrow(_decoded(path, pattern), ddl)


__all__ = ["Codec", "RankQueue", "Vocabulary", "decode", "encode"]
