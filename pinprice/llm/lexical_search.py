"""Ranked lexical search by NRA over impact-sorted lists.

Terms are the maximal runs of ASCII letters, digits and all characters beyond
ASCII; only A-Z are lower-cased. A document's score for an item sums, over the
item's distinct terms, ``w * ((1e9 * tf) div (1000 * tf + 8 * m))`` with the
term's weight ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and the document's
length norm ``m = 10 + (90 * n * N) div L``; all but ``w`` is 64-bit integer.

Three steps, none of which moves a text:

1. one scan of the texts keeps, per document, its number of terms and how often
   it holds each term that any item asks for (a stored table);
2. grouped sums of that table give N, L and every term's df;
3. each task reads its own documents in blocks, sorts every asked term's
   postings of a block by falling impact, and answers each item by NRA: lists
   are read in turn, a document's lower bound is the sum of the impacts read,
   its upper bound adds the next impact of each list it wasn't met in. Reading
   goes on until no other document can reach the k-th lower bound (equal ones
   included, as ties go to the smaller id) and the bounds of the first k meet,
   so the scores are exact. An item's k-th score is carried from block to
   block of a task, so later blocks stop early.

A task returns k rows an item; a window keeps the first k of them. Items are
taken in groups of at most ``group_terms`` term entries, which bounds what a
task holds of them; every group is answered over all documents.

Defined results: a null or termless text isn't counted in N and never found; a
null doc_id is a document as any other, returned as null and after all others
on ties; rows of equal doc_id are separate documents; items of equal item_id
are one item that asks for all their terms; a null item_id, an item without
terms or without any matching document gives no row; empty tables give no
rows; texts of any length are read whole, and further columns are ignored.
Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinprice.llm.common import ship_package, slices, store
from pinprice.llm.hashing import batches_of, words_of

# fixed value: the characters that separate terms (\x00-\x2F \x3A-\x40 \x5B-\x60 \x7B-\x7F)
GAP = np.zeros(256, bool)
GAP[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

#: Documents whose postings a task holds at a time.
BLOCK_DOCS = 8192
#: Postings read from a list per turn of NRA, at first; it doubles with every turn.
TURN = 64

_HITS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int64())),
                   ("tf", pa.list_(pa.int64()))])
_TERMS = pa.schema([("item", pa.int64()), ("term", pa.int64())])
_FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms per text; and, in order of text: text number, term hash, occurrences)."""
    w = words_of(texts, GAP)
    n = np.diff(w.first)
    doc = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((w.hash, doc))
    d, h = doc[order], w.hash[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return n, d[at], h[at].view(np.int64), np.diff(np.append(at, len(d)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 256):
        ids = b.column(0).to_numpy(zero_copy_only=False)
        texts = b.column(1).to_pylist()
        for lo, hi in batches_of(texts):
            _, d, h, _ = _counts(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][d], pa.int64()), pa.array(h)], schema=_TERMS)


def _hits(asked: np.ndarray):
    """mapInArrow: (doc_id, text) to the document's term count and its asked terms (``asked`` is sorted)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            texts = b.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                n, d, h, tf = _counts(texts[lo:hi])
                at = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
                ok = asked[at] == h
                first = np.searchsorted(d[ok], np.arange(hi - lo + 1)).astype(np.int32)
                full = pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(first, pa.array(h[ok])),
                    pa.ListArray.from_arrays(first, pa.array(tf[ok], pa.int64()))], schema=_HITS)
                yield full.filter(pa.array(n > 0))

    return scan


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int = 0, turn: int = TURN,
        rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, exact scores) that hold the k best of these lists; a document may be missing only if its
    score is below ``floor``.

    A list is (documents, falling impacts). Only sequential reads: ``low`` sums what was read of a document,
    ``high`` adds the next impact of every list where it wasn't met. ``rank`` orders documents of equal score
    (by their number, if not given).
    """
    lists = [x for x in lists if len(x[0])]
    low = np.zeros(n_docs, np.int64)
    met = np.zeros((len(lists), n_docs), bool)
    at = np.zeros(len(lists), np.int64)
    head = np.array([int(x[1][0]) for x in lists], np.int64)
    live = np.zeros(n_docs, bool)
    open_to_new = True  # an unmet document may still be one of the k best
    order = np.arange(n_docs) if rank is None else rank
    while True:
        if open_to_new and int(head.sum()) < max(floor, 1):
            open_to_new = False
        docs = np.flatnonzero(live)
        missing = ~met[:, docs]
        high = low[docs] + head @ missing
        kth = max(floor, 1)
        if len(docs) > k:
            kth = max(kth, int(np.partition(low[docs], len(docs) - k)[len(docs) - k]))
        elif len(docs) == k:
            kth = max(kth, int(low[docs].min()))
        stay = high >= kth
        if (~stay).any():
            live[docs[~stay]] = False
            docs, missing, high = docs[stay], missing[:, stay], high[stay]
        if open_to_new and int(head.sum()) < kth:
            open_to_new = False
        needed = (head > 0) if open_to_new else missing.any(axis=1) & (head > 0)
        if not needed.any():
            best = np.lexsort((order[docs], -low[docs]))[:k]
            return docs[best], low[docs][best]
        for j in np.flatnonzero(needed):
            d, x = lists[j]
            lo, hi = int(at[j]), min(int(at[j]) + turn, len(d))
            low[d[lo:hi]] += x[lo:hi]
            met[j, d[lo:hi]] = True
            if open_to_new:
                live[d[lo:hi]] = True
            at[j], head[j] = hi, int(x[hi]) if hi < len(d) else 0
        turn *= 2


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        while n >= rows:
            t = pa.Table.from_batches(held)
            yield t.slice(0, rows)
            rest = t.slice(rows)
            held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _impacts(block: pa.Table, terms: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
    """Postings of a block by term, in order of falling impact: term at -> (documents, impacts)."""
    n = np.asarray(block["n"].to_numpy(), np.int64)
    lists = block["term"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    tfs = block["tf"].combine_chunks()
    tfs = tfs.chunk(0) if isinstance(tfs, pa.ChunkedArray) else tfs
    h = lists.flatten().to_numpy(zero_copy_only=False)
    tf = tfs.flatten().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy(zero_copy_only=False))
    t = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    ok = (terms[t] == h) & (weight[t] > 0)
    t, tf, doc = t[ok], tf[ok], doc[ok]
    m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
    impact = weight[t] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    order = np.lexsort((doc, -impact, t))
    t, doc, impact = t[order], doc[order], impact[order]
    return np.searchsorted(t, np.arange(len(terms) + 1)), doc, impact


def _search(items: list[tuple[int, np.ndarray]], terms: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int,
            k: int, rows: int):
    """mapInArrow: hits to each item's k best of this task's documents; an item holds positions in ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [
            (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)) for _ in items]
        for block in _blocks(batches, rows):
            at, docs, impact = _impacts(block, terms, weight, n_docs, n_terms)
            none = block["doc_id"].is_null().to_numpy()
            ids = block["doc_id"].fill_null(0).to_numpy()
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((ids, none))] = np.arange(len(ids))
            for i, (_, its) in enumerate(items):
                have, gone, score = best[i]
                floor = int(score[-1]) if len(score) == k else 0
                d, s = nra([(docs[at[j]:at[j + 1]], impact[at[j]:at[j + 1]]) for j in its], len(ids), k, floor, rank=rank)
                if len(d):
                    have, gone, score = (np.concatenate(x) for x in ((have, ids[d]), (gone, none[d]), (score, s)))
                    order = np.lexsort((have, gone, -score))[:k]
                    best[i] = have[order], gone[order], score[order]
        out = [(items[i][0], b) for i, b in enumerate(best) if len(b[0])]
        if out:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.full(len(b[0]), i) for i, b in out]), pa.int64()),
                pa.array(np.concatenate([b[0] for _, b in out]), pa.int64(), mask=np.concatenate([b[1] for _, b in out])),
                pa.array(np.concatenate([b[2] for _, b in out]), pa.int64())], schema=_FOUND)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_docs: int = BLOCK_DOCS,
           group_terms: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents. Columns read: docs (doc_id, text), items
    (item_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    asked = store(items.where("item_id is not null").select(F.col("item_id").cast("long"), "text")
                  .mapInArrow(_item_terms, "item long, term long").distinct(), "search-items")
    groups = max(1, -(-asked.count() // group_terms))
    found = None
    for g in range(groups):  # one group, unless the items ask for over group_terms terms
        # bounded: group_terms entries of 16 bytes on the average of a group
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).orderBy("item", "term").toArrow()
        part = _search_group(docs, rows, k, block_docs)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_group(docs: DataFrame, rows: pa.Table, k: int, block_docs: int) -> DataFrame | None:
    if not rows.num_rows:
        return None
    item, term = rows["item"].to_numpy(), rows["term"].to_numpy()
    terms = np.unique(term)
    hits = store(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _hits(terms), "doc_id long, n long, term array<long>, tf array<long>"), "search-hits")
    total = hits.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 0
    if not n_docs:
        return None
    df = hits.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    got = df.select("term", w.cast("long").alias("w")).toArrow()  # at most one row per asked term
    weight = np.zeros(len(terms), np.int64)
    weight[np.searchsorted(terms, got["term"].to_numpy())] = got["w"].to_numpy()
    at = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    each = [(int(item[a]), np.searchsorted(terms, term[a:b])) for a, b in zip(at, [*at[1:], len(item)], strict=True)]
    return hits.mapInArrow(_search(each, terms, weight, n_docs, n_terms, k, block_docs),
                           "item_id long, doc_id long, score long")


__all__ = ["nra", "search"]
