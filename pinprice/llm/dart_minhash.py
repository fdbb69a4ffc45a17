"""Near-duplicate documents by DartMinHash signatures and a banded join.

A document is a weighted set: its five-word shingles, in lower case, with their
counts. Darts are thrown by hash into the regions (element, weight, rank): every
unit of an element's weight has, per unit of rank, a Poisson(1) number of darts
with a weight, a rank and a coordinate of the signature each. A document sees the
darts below its weights, and each coordinate keeps its earliest one; two
documents keep the same dart with probability equal to their weighted Jaccard
similarity. Rank is opened until every coordinate has a dart, so the work is
in proportion to the words plus k log k.

Documents of equal words form one class and are represented by one of them.
Representatives that agree in a whole band share a bucket. In a few rounds
every member meets one drawn member of its bucket, and the exact similarity
(0.8 or more) decides. Where a bucket still holds several components then, the
members outside its largest one are compared with the whole bucket in cells of
bounded size, which return only links that join components: no link between
different texts is lost, and no group emits all its pairs. Classes are the
connected components, found by alternating star steps with stored tables in
between.

Every distinct text (by its words) is a member with a number of its own, given
when the texts' table is written; ids only rank. So rows of a null id, of an id
that is repeated and of one id with unlike texts are all rows of their own.

Defined results: one row per input row; texts without words are in no class but
their own; a text of fewer than five words is one shingle; rows of equal words
are of one class whatever their ids; ties go to the least id, null ids last, and
then to the texts' hashes; a class of null ids only has a null id; texts of any
length are read whole; an empty table gives no rows; other columns, of any
name, pass through ``keep_one`` and are no part of ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinprice.llm.common import WORD_PATTERN, ship_package, slices, store
from pinprice.llm.hashing import Words, batches_of, mix, spans_digest, words_of

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
STARS = 3  # rounds in which a bucket's members meet a drawn one
CHUNK, WIDE = 256, 1024  # members per side of a comparison cell

_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1, 20)])))
_CUTS = (_POISSON * 2.0**64).clip(max=2.0**64 - 2049).astype(np.uint64)
_UNIT = 2.0**-64


def shingles(w: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle, in order; a shorter text is one shingle."""
    first, n = w.first[:-1], np.diff(w.first)
    size = np.minimum(n, width)
    count = np.where(n > 0, n - size + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    a = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    h, _ = spans_digest(w.hash, a, a + size[text], 11)
    return text, h


def weighted(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order, with counts."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """Dart ids (n_texts x k) of weighted sets; sets without weight have zeros.

    ``weight`` may be any positive number; its last, partial unit sees the
    darts below its fraction.
    """
    sig = np.zeros(n_texts * k, np.uint64)
    best = np.full(n_texts * k, np.inf)
    units = np.ceil(weight).astype(np.int64)
    unit_text, unit_of = np.repeat(text, units), np.repeat(np.arange(len(text)), units)
    layer = np.arange(len(unit_of)) - np.repeat(np.cumsum(units) - units, units)
    seen = np.minimum(weight[unit_of] - layer, 1.0)
    base = mix(element[unit_of] ^ mix(layer.astype(np.uint64), 3), 5)
    total = np.bincount(text, weight, minlength=n_texts)
    opened = np.zeros(n_texts, np.int64)
    wanted = np.ceil(k * (np.log(k) + 3) / np.maximum(total, 1e-9)).astype(np.int64)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        # open rank [opened, wanted) of the texts that still lack a coordinate
        lo, hi = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
        lo[todo], hi[todo] = opened[todo], wanted[todo]
        cells = (hi - lo)[unit_text]
        for s in range(0, len(unit_text), step := 1 << 18):
            part = slice(s, s + step)
            n_cells = cells[part]
            if not n_cells.any():
                continue
            unit = np.repeat(np.arange(len(unit_text))[part], n_cells)
            rank = np.arange(len(unit)) - np.repeat(np.cumsum(n_cells) - n_cells, n_cells) + lo[unit_text[unit]]
            for c in range(0, len(unit), 1 << 20):
                _throw(unit[c:c + (1 << 20)], rank[c:c + (1 << 20)], base, seen, unit_text, k, sig, best)
        opened[todo] = wanted[todo]
        empty = np.isinf(best.reshape(n_texts, k)).any(1)
        todo = todo[empty[todo]]
        wanted[todo] = 2 * opened[todo]
    return sig.reshape(n_texts, k)


def _throw(unit, rank, base, seen, unit_text, k, sig, best) -> None:
    cell = mix(base[unit] ^ mix(rank.astype(np.uint64), 17), 19)
    darts = np.searchsorted(_CUTS, cell, side="right")
    at = np.repeat(np.arange(len(unit)), darts)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(cell[at] ^ mix(nth.astype(np.uint64), 23), 29)
    below = mix(dart, 31).astype(np.float64) * _UNIT < seen[unit[at]]
    at, dart = at[below], dart[below]
    place = rank[at] + mix(dart, 37).astype(np.float64) * _UNIT
    slot = unit_text[unit[at]] * k + (mix(dart, 41) % np.uint64(k)).astype(np.int64)
    order = np.argsort(-place, kind="stable")  # the earliest dart is written last
    slot, place, dart = slot[order], place[order], dart[order]
    old = best[slot]
    win = place < old
    best[slot[win]] = place[win]
    sig[slot[win]] = dart[win]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, h1, h2) to (doc, h1, h2, d1, d2, words, bands)."""
    for batch in slices(batches):
        texts = batch.column(1).to_pylist()
        for lo, hi in batches_of(texts):
            w = words_of([t.lower() for t in texts[lo:hi]])
            d1, d2 = spans_digest(w.hash, w.first[:-1], w.first[1:], 13)
            text, h, c = weighted(*shingles(w))
            sig = signatures(text, h, c.astype(np.float64), hi - lo, BANDS * ROWS)
            rows = sig.reshape(hi - lo, BANDS, ROWS)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (hi - lo, BANDS))
            for r in range(ROWS):
                key = mix(key ^ rows[:, :, r], 43)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(key.view(np.int64).ravel()), BANDS)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(lo, hi - lo) for c in (0, 2, 3)), pa.array(d1.view(np.int64)),
                 pa.array(d2.view(np.int64)), pa.array(np.diff(w.first)), bands.cast(pa.list_(pa.int64()))],
                names=["doc", "h1", "h2", "d1", "d2", "words", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to (doc, shingle hashes, counts), packed."""
    for batch in slices(batches):
        docs, texts = batch.column(0), batch.column(1).to_pylist()
        sets: list[bytes] = []
        counts: list[bytes] = []
        for lo, hi in batches_of(texts):
            text, h, c = weighted(*shingles(words_of([t.lower() for t in texts[lo:hi]])))
            at = np.searchsorted(text, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                sets.append(h[at[i]:at[i + 1]].tobytes())
                own = c[at[i]:at[i + 1]]
                counts.append(b"" if (own == 1).all() else own.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([docs, pa.array(sets, pa.binary()), pa.array(counts, pa.binary())],
                                         names=["doc", "hs", "cs"])


def unpack(hs: bytes, cs: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(hs, np.uint64)
    return h, np.frombuffer(cs, np.int32).astype(np.int64) if cs else np.ones(len(h), np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two packed sets (sorted hashes, counts)."""
    (ha, ca), (hb, cb) = a, b
    total = int(ca.sum() + cb.sum())
    if not total:
        return 0.0
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum()) if len(both) else 0
    return common / (total - common)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, hs, cs, hs2, cs2) to the links (a, b) that are similar enough."""
    for batch in batches:
        a, b, ha, ca, hb, cb = (c.to_pylist() for c in batch.columns)
        ok = np.array([similarity(unpack(w, x), unpack(y, z)) >= THRESHOLD
                       for w, x, y, z in zip(ha, ca, hb, cb, strict=True)], bool)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(pa.array(ok)),
                                          pa.array(b, pa.int64()).filter(pa.array(ok))], names=["a", "b"])


def _cell(table: pa.Table) -> pa.Table:
    """A cell's small side against its other side, to links that join their components."""
    rows = table.select(["doc", "comp", "small", "hs", "cs"]).to_pylist()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    others = sorted({(r["doc"], r["comp"]) for r in rows if not r["small"]})
    sets = {r["doc"]: unpack(r["hs"], r["cs"]) for r in rows}
    # the other side as one list of (hash, member, count) in order of the hashes
    size = np.array([int(sets[d][1].sum()) for d, _ in others])
    h = np.concatenate([sets[d][0] for d, _ in others] or [np.empty(0, np.uint64)])
    c = np.concatenate([sets[d][1] for d, _ in others] or [np.empty(0, np.int64)])
    owner = np.repeat(np.arange(len(others)), [len(sets[d][0]) for d, _ in others])
    order = np.argsort(h, kind="stable")
    h, c, owner = h[order], c[order], owner[order]
    links = []
    for x, comp in sorted({(r["doc"], r["comp"]) for r in rows if r["small"]}):
        hx, cx = sets[x]
        lo = np.searchsorted(h, hx)
        n = np.searchsorted(h, hx, side="right") - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        common = np.bincount(owner[at], np.minimum(c[at], np.repeat(cx, n)), minlength=len(others))
        total = size + int(cx.sum()) - common
        for k in np.flatnonzero((common >= THRESHOLD * total) & (total > 0)).tolist():
            y, other = others[k]
            if root(comp) != root(other):
                parent[root(comp)] = root(other)
                links.append((min(x, y), max(x, y)))
    return pa.table({"a": pa.array([p[0] for p in links], pa.int64()), "b": pa.array([p[1] for p in links], pa.int64())})


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(doc, comp) of every vertex of the links (a, b): comp is the least id it is linked with.

    Alternating star steps: each vertex hangs its greater neighbours on its
    least one, then its smaller ones too, until the links no longer change.
    Every step is a minimum per vertex, aggregated before the shuffle, and a
    join; each round is stored, so a lost executor repeats one round at most.
    """
    now = store(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(),
                f"{name}-links")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.distinct()
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u")
        small = small.select(F.col("m").alias("a"), F.explode(F.array_distinct(F.array("u", "v"))).alias("b")).where("a < b")
        now = store(small.distinct(), f"{name}-links")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("comp")).union(
        now.select("a", F.col("a").alias("comp")).distinct())


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _buckets(members: DataFrame) -> DataFrame:
    """Band buckets of two members or more: key, doc."""
    rows = members.select(F.explode("bands").alias("key"), "doc")
    shared = rows.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
    return rows.join(shared.select("key"), "key")


def _marked(buckets: DataFrame, comps: DataFrame | None) -> DataFrame:
    """key, doc, comp: members with the component known so far."""
    if comps is None:
        return buckets.withColumn("comp", F.col("doc"))
    return buckets.join(comps, "doc", "left").select("key", "doc", F.coalesce("comp", "doc").alias("comp"))


def _star_pairs(marked: DataFrame, turn: int) -> DataFrame:
    """Every member with one drawn member of its bucket, where their components differ."""
    draw = F.xxhash64("doc", "key", F.lit(turn))
    drawn = marked.groupBy("key").agg(F.min_by("doc", draw).alias("center"), F.min_by("comp", draw).alias("at"),
                                      F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1")
    rows = marked.join(drawn.select("key", "center", "at"), "key").where("comp <> at")
    return rows.select(F.least("doc", "center").alias("a"), F.greatest("doc", "center").alias("b")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    right = pairs.join(sets.select(F.col("doc").alias("b"), F.col("hs").alias("hs2"), F.col("cs").alias("cs2")), "b")
    both = right.join(sets.withColumnRenamed("doc", "a"), "a").select("a", "b", "hs", "cs", "hs2", "cs2")
    return both.mapInArrow(_verified, "a long, b long")


def _keys(text: Column) -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


#: Rows by id and text; an id may be null.
_ROW = ("doc", "h1", "h2")


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc"].eqNullSafe(b["doc"]) & (a["h1"] == b["h1"]) & (a["h2"] == b["h2"])


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, h1, h2, node (null without words), class (a node), class_id, rep for every row."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    body = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text.alias("t"), *_keys(text))
    sketch = store(body.mapInArrow(_sketch, "doc long, h1 long, h2 long, d1 long, d2 long, words long, bands array<long>"),
                   "near-sketch")
    # members: the distinct texts, numbered when their table is written; a row of least id stands for each
    row = F.struct(F.col("doc").isNull().alias("none"), *_ROW)
    nodes = sketch.where("words > 0").groupBy("d1", "d2").agg(F.min(row).alias("r"), F.first("bands").alias("bands"))
    nodes = store(nodes.select("d1", "d2", "r.doc", "r.h1", "r.h2", "bands", F.monotonically_increasing_id().alias("node")),
                  "near-nodes")
    buckets = store(_buckets(nodes.select(F.col("node").alias("doc"), "bands")), "near-buckets")
    ask = nodes.select(*_ROW, "node").join(buckets.select(F.col("doc").alias("node")).distinct(), "node", "left_semi")
    texts = body.join(ask, _same_row(body, ask)).groupBy("node").agg(F.min("t").alias("t"))
    sets = store(texts.mapInArrow(_sets, "doc long, hs binary, cs binary"), "near-sets")
    comps = None
    for turn in range(STARS):
        links = store(_similar(_star_pairs(_marked(buckets, comps), turn), sets), "near-links")
        comps = _joined(comps, links)
    comps = _joined(comps, _unresolved(_marked(buckets, comps), sets))
    of = nodes.select("d1", "d2", "node", F.col("doc").alias("rep")).join(
        comps.select(F.col("doc").alias("node"), "comp"), "node", "left").withColumn("class", F.coalesce("comp", "node"))
    least = of.groupBy("class").agg(F.min("rep").alias("class_id"))
    of = store(of.join(least, "class").select("d1", "d2", "node", "class", "class_id", "rep"), "near-classes")
    rows = sketch.select(*_ROW, F.when(F.col("words") > 0, F.col("d1")).alias("d1"), "d2").join(of, ["d1", "d2"], "left")
    alone = F.col("node").isNull()
    return rows.select(*_ROW, "node", "class", F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
                       F.when(alone, F.col("doc")).otherwise(F.col("rep")).alias("rep"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, class_id, rep for every row: the least id of its class, and of the rows with its very words."""
    return _classes(docs, id_col, text_col).select("doc", "class_id", "rep")


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: those of the links between the components so far."""
    if comps is None:
        return store(components(links), "near-components")
    if links.isEmpty():
        return comps
    of = lambda side: comps.select(F.col("doc").alias(side), F.col("comp").alias(f"{side}_comp"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    new = store(components(between), "near-merged")
    moved = comps.join(new.select(F.col("doc").alias("comp"), F.col("comp").alias("to")), "comp", "left").select(
        "doc", F.coalesce("to", "comp").alias("comp"))
    # ends of links that had no component yet
    fresh = new.join(comps, "doc", "left_anti")
    return store(moved.unionByName(fresh), "near-components")


def _unresolved(marked: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components of one bucket, from all pairs that can join them.

    Members of a bucket's largest component are one already, so only the
    others are compared with the whole bucket, in cells of ``CHUNK`` such
    members and ``WIDE`` members at most. A bucket of two had its pair tested.
    """
    each = marked.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("s"))
    state = each.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("m"), F.max_by("comp", F.struct("n", "comp")).alias("big"),
                                    F.sum("s").alias("s"))
    # buckets of equal members in several bands are compared once
    state = state.where("n > 2 and m < n").groupBy("n", "m", "big", "s").agg(F.min("key").alias("key"))
    state = state.select("key", "big", F.ceil((F.col("n") - F.col("m")) / CHUNK).cast("int").alias("rows"),
                         F.ceil(F.col("n") / WIDE).cast("int").alias("cols"))
    members = marked.join(state, "key")
    place = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    small = members.where("comp <> big").select("key", place("rows").alias("i"), copies("cols").alias("j"), "doc", "comp",
                                                F.lit(True).alias("small"))
    every = members.select("key", copies("rows").alias("i"), place("cols").alias("j"), "doc", "comp",
                           F.lit(False).alias("small"))
    cells = small.unionByName(every).select(F.struct("key", "i", "j").alias("cell"), "doc", "comp", "small")
    found = cells.join(sets, "doc").groupBy("cell").applyInArrow(_cell, "a long, b long")
    return store(found.distinct(), "near-more")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one of least id. Rows without words stay."""
    classes = _classes(docs, id_col, text_col).where("class is not null")
    row = F.struct(F.col("doc").isNull().alias("none"), *_ROW)
    kept = classes.groupBy("class").agg(F.min(row).alias("r")).select("r.doc", "r.h1", "r.h2")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{id_col}`").cast("long").alias("doc"), *_keys(text), text.rlike(WORD_PATTERN).alias("words"))
    one = rows.where("words").join(kept, _same_row(rows, kept), "left_semi").dropDuplicates([*_ROW])
    return one.unionByName(rows.where("not words")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


__all__ = ["BANDS", "ROWS", "THRESHOLD", "WIDTH", "components", "keep_one", "near_duplicates", "shingles", "signatures",
           "similarity", "weighted"]
