"""Hard negatives by best-first search in cover trees over norm-augmented vectors.

Every vector x becomes x' = (x, sqrt(M^2 - |x|^2)), M the greatest norm of its
block, so all x' lie on one sphere and the inner product with an anchor q is
M |q| cos(angle). A block of rows holds a cover tree: level i is a net of
centres more than R / 2^i apart that covers every row within R / 2^i; a centre's
parent is the nearest centre of the level above. A node keeps the exact
covering radius of its rows. The radius is an angle on the sphere, so the
inner products of a node lie between those at (angle to the centre + radius)
and (angle to the centre - radius).

A search is best-first over the trees of its blocks: the node of greatest upper
bound is opened next, nodes that lie outside every window still open (or below
its last place) or hold no row of a wanted label are skipped, and the rows of a
leaf are scored exactly in integers. Two searches are made: the positives of
each anchor (first rows of its label), then for the score window that each
positive opens, the first rows of other labels within it.

Rows are laid out by their nearest pivot and distance to it (range partitions,
so a dense region is split), and cut into blocks of bounded size with their
trees; blocks and trees are written once and read by both searches. Each anchor
group meets each block group in one cell of bounded memory: the stated query
set against all rows, in blocks. A cell returns a few rows per anchor; windows
keep the first ones.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; shorter vectors count as padded with zeros;
rows of the anchor's own id are not its candidates, and a repeated anchor id
asks once, with its least (label, vector); other rows of equal id are separate
candidates; ties go to the smaller id; a negative positive score opens no
window; an empty table gives no rows; further columns are ignored. Scores
beyond 64 bits are given as the greatest (least) 64-bit number.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinprice.llm.common import ship_package, store
from pinprice.llm.topk_search import exact_dtype, scaled

#: Rows of a block, rows of a leaf on average, and pivots of the layout.
BLOCK_ROWS, LEAF_ROWS, PIVOTS = 4096, 256, 64
#: Relative slack of the floating-point bounds (the scores themselves are exact).
SLACK = 1e-6
#: Partitions that the cells are dealt to, at most.
MOST_PARTITIONS = 20_000
_LONG = 2**63 - 1

BLOCK = ("block long, n int, dim int, top double, ids binary, labels binary, mat binary, centre binary, radius binary, "
         "lo binary, hi binary, first binary, kids binary, lmin binary, lmax binary")
_BLOCK = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("top", pa.float64())] + [
    (c, pa.binary()) for c in ("ids", "labels", "mat", "centre", "radius", "lo", "hi", "first", "kids", "lmin", "lmax")])


def matrix(vecs: list) -> np.ndarray:
    """Integer vectors as rows, shorter ones padded with zeros."""
    m = np.zeros((len(vecs), max((len(v) for v in vecs), default=0)), np.int64)
    for r, v in enumerate(vecs):
        m[r, :len(v)] = v
    return m


def augment(m: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vectors (x, sqrt(M^2 - |x|^2)) / M of the rows, and M."""
    x = m.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    top = float(norm.max(initial=0.0))
    if top == 0:
        return np.hstack([np.zeros_like(x), np.ones((len(x), 1))]), 0.0
    return np.hstack([x / top, np.sqrt(np.maximum(1 - (norm / top) ** 2, 0))[:, None]]), top


def nets(u: np.ndarray, leaf_rows: int) -> tuple[list[int], list[int], list[int], np.ndarray]:
    """Nested nets by farthest-first insertion: (centres, their levels, their parents' positions, and per row
    the position of its nearest centre).

    When the farthest row is within r / 2^i of the centres, level i is complete; a later centre's parent is its
    nearest centre of the last complete level.
    """
    n = len(u)
    centres, levels, parents = [0], [0], [-1]
    far = np.sqrt(np.maximum(2 - 2 * (u @ u[0]), 0))
    near = np.zeros(n, np.int64)      # nearest centre so far
    above, level = near.copy(), 0     # nearest centre of the last complete level
    reach = float(far.max(initial=0.0)) / 2
    while len(centres) * leaf_rows < n:
        x = int(far.argmax())
        if far[x] <= 1e-6:
            break
        if level == 0 or far[x] <= reach:
            while level and far[x] <= reach:
                reach /= 2
            level, above = level + 1, near.copy()
        centres.append(x)
        levels.append(level)
        parents.append(int(above[x]))
        d = np.sqrt(np.maximum(2 - 2 * (u @ u[x]), 0))
        closer = d < far
        far[closer] = d[closer]
        near[closer] = len(centres) - 1
        far[x], near[x] = 0.0, len(centres) - 1
    return centres, levels, parents, near


def cover_tree(m: np.ndarray, labels: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict:
    """The tree of a block: its rows in tree order and, per node in breadth-first order, the centre's row, the
    covering angle, the range of rows, the children's range and the extremes of the labels."""
    u, top = augment(m)
    centres, levels, parents, near = nets(u, leaf_rows)
    kids: list[list[int]] = [[] for _ in centres]
    for c in range(1, len(centres)):
        kids[parents[c]].append(c)
    # (centre, level) covers the centre's own rows and the subtrees of its children of deeper levels
    own = [np.flatnonzero(near == c) for c in range(len(centres))]
    below: list[np.ndarray] = [None] * len(centres)
    for c in reversed(range(len(centres))):
        below[c] = np.concatenate([own[c], *[below[k] for k in kids[c]]])
    order, nodes, queue = [], [], [(0, 0)]
    while queue:  # breadth first; a node's children stand together
        c, at = queue.pop(0)
        rest = kids[c][at:]
        rows = np.concatenate([own[c], *[below[k] for k in rest]])
        angle = float(np.arccos(np.clip(u[rows] @ u[centres[c]], -1, 1)).max(initial=0.0))
        node = {"centre": centres[c], "radius": angle, "rows": rows, "first": -1, "kids": 0,
                "lmin": int(labels[rows].min()), "lmax": int(labels[rows].max())}
        nodes.append(node)
        if rest:
            j = levels[rest[0]]
            n_new = sum(levels[k] == j for k in rest)
            node["first"], node["kids"] = len(nodes) + len(queue), 1 + n_new
            queue += [(c, at + n_new)] + [(k, 0) for k in rest[:n_new]]
    # rows in depth-first order of the leaves, so that every node holds one range of them
    lo, hi = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)

    stack, n = [(0, False)], 0
    while stack:
        i, done = stack.pop()
        node = nodes[i]
        if done:
            hi[i] = n
            continue
        lo[i] = n
        stack.append((i, True))
        if node["kids"]:
            stack += [(k, False) for k in range(node["first"] + node["kids"] - 1, node["first"] - 1, -1)]
        else:
            order.append(node["rows"])
            n += len(node["rows"])
    order = np.concatenate(order)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    column = lambda name, kind: np.array([x[name] for x in nodes], kind)
    return {"order": order, "top": top, "centre": place[column("centre", np.int64)].astype(np.int32),
            "radius": column("radius", np.float64), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32),
            "first": column("first", np.int32), "kids": column("kids", np.int32),
            "lmin": column("lmin", np.int64), "lmax": column("lmax", np.int64)}


def _cut(rows: int, leaf_rows: int):
    """mapInArrow: (id, label, q) in layout order to blocks with their trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(b: pa.Table) -> pa.RecordBatch:
            ids, labels = b["id"].to_numpy(), b["label"].to_numpy()
            m = matrix(b["q"].to_numpy())
            tree = cover_tree(m, labels, leaf_rows)
            order = tree.pop("order")
            top = tree.pop("top")
            return pa.RecordBatch.from_pylist([{
                "block": (part << 32) + n, "n": len(ids), "dim": m.shape[1], "top": top, "ids": ids[order].tobytes(),
                "labels": labels[order].tobytes(), "mat": m[order].tobytes(),
                **{k: v.tobytes() for k, v in tree.items()}}], schema=_BLOCK)

        for b in batches:
            held.append(b)
            size += b.num_rows
            while size >= rows:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, rows))
                n, held, size = n + 1, t.slice(rows).to_batches(), size - rows
        if size:
            yield block(pa.Table.from_batches(held))

    return run


def _layout(pivots: list):
    """mapInArrow: adds the nearest pivot and the distance to it."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("q", pa.list_(pa.int64())), ("cell", pa.int32()),
                        ("far", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = matrix(pivots).astype(np.float64)
        for b in batches:
            if not b.num_rows:
                continue
            m = matrix(b.column(2).to_numpy(zero_copy_only=False)).astype(np.float64)
            dim = max(p.shape[1], m.shape[1])
            q, m = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (p, m))
            d = (m * m).sum(1)[:, None] - 2 * (m @ q.T) + (q * q).sum(1)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([
                *b.columns[:3], pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell], pa.float64())],
                schema=schema)

    return run


class Forest:
    """The trees of some blocks, and searches over all of them."""

    def __init__(self, blocks: list[dict], dim: int, biggest: int):
        def packed(name, kind):
            return [np.frombuffer(b[name], kind) for b in blocks]

        self.dim = max([dim, *[b["dim"] for b in blocks]])
        mats = [np.frombuffer(b["mat"], np.int64).reshape(b["n"], b["dim"]) for b in blocks]
        dtype = exact_dtype(self.dim, biggest, max(int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
                                                   for x in mats))
        mats = [np.pad(x, ((0, 0), (0, self.dim - x.shape[1]))) for x in mats]
        rows = np.cumsum([0, *[b["n"] for b in blocks]])
        nodes = np.cumsum([0, *[len(x) for x in packed("centre", np.int32)]])
        self.mat = np.vstack(mats).astype(dtype)
        self.ids, self.labels = np.concatenate(packed("ids", np.int64)), np.concatenate(packed("labels", np.int64))
        put = lambda name, kind, at: np.concatenate([
            x.astype(np.int64) + o for x, o in zip(packed(name, kind), at, strict=False)])
        self.centre, self.lo, self.hi = (put(c, np.int32, rows) for c in ("centre", "lo", "hi"))
        self.first = put("first", np.int32, nodes)
        self.kids = np.concatenate(packed("kids", np.int32))
        self.radius = np.concatenate(packed("radius", np.float64))
        self.lmin, self.lmax = np.concatenate(packed("lmin", np.int64)), np.concatenate(packed("lmax", np.int64))
        self.top = np.repeat([b["top"] for b in blocks], np.diff(nodes))
        self.roots = nodes[:-1]
        # nodes share centres with their own first child: one score serves both
        self.seeds, self.seed_of = np.unique(self.centre, return_inverse=True)
        self.seed_mat = self.mat[self.seeds].astype(np.float64)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that each node may hold."""
        q = q.astype(np.float64)
        size = float(np.sqrt((q * q).sum())) * self.top
        s = (self.seed_mat @ q)[self.seed_of]
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip(np.where(size > 0, s / size, 0.0), -1, 1))
        slack = SLACK * size + 1
        up = size * np.cos(np.maximum(angle - self.radius, 0)) + slack
        down = size * np.cos(np.minimum(angle + self.radius, math.pi)) - slack
        return down, up

    def search(self, q: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int | None]], k: int):
        """For each (least, greatest) score window: the first k (score, id) of rows with (without) the label."""
        v = np.zeros(self.dim, self.mat.dtype)
        v[:len(q)] = q
        down, up = self.bounds(np.asarray(v))
        skip = (self.lmin > label) | (self.lmax < label) if same else (self.lmin == label) & (self.lmax == label)
        up, down, skip = up.tolist(), down.tolist(), skip.tolist()
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        top = None if any(hi is None for _, hi in windows) else max((hi for _, hi in windows), default=-_LONG)
        least = [lo for lo, _ in windows]  # a row must reach it: the window's end, then the k-th score found

        def wanted(i: int) -> bool:
            return not skip[i] and any((lo is None or up[i] >= lo) and (hi is None or down[i] <= hi)
                                       for lo, (_, hi) in zip(least, windows, strict=True))

        heap = [(-up[i], int(i)) for i in self.roots if wanted(i)]
        heapq.heapify(heap)
        opened = 0
        while heap:
            _, i = heapq.heappop(heap)
            if not wanted(i):  # the places may have risen since it was found
                continue
            if self.kids[i]:
                a = int(self.first[i])
                for c in range(a, a + int(self.kids[i])):
                    if wanted(c):
                        heapq.heappush(heap, (-up[c], c))
                continue
            opened += 1
            a, b = int(self.lo[i]), int(self.hi[i])
            ids, scores = self.ids[a:b], self.mat[a:b] @ v
            ok = ((self.labels[a:b] == label) == same) & (ids != own)
            # rows inside the span of all windows still open, then window by window
            if None not in least:
                ok &= scores >= min(least)
            if top is not None:
                ok &= scores <= top
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            found = [(int(s), int(j)) for s, j in zip(scores[at], ids[at], strict=True)]
            for w, (_, hi) in enumerate(windows):
                take = [x for x in found if (least[w] is None or x[0] >= least[w]) and (hi is None or x[0] <= hi)]
                if take:
                    best[w] = sorted(best[w] + take, key=lambda x: (-x[0], x[1]))[:k]
                    if len(best[w]) == k:
                        least[w] = best[w][-1][0]
        return best, opened


def window_of(score: int) -> tuple[int, int]:
    """Scores s with 50 * score <= 100 * s <= 95 * score."""
    return -(-score // 2), 95 * score // 100


def _pairs(left: DataFrame, blocks: DataFrame, n_groups: int, q_groups: int, work, schema: str) -> DataFrame:
    """Each anchor group with each block group, in one cell."""
    lt = left.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(q_groups))).withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    rt = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(n_groups)).cast("int")).withColumn(
        "h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_groups - 1).cast("long"))))
    # a partition count of its own: cells are few and long, and must not be merged by their size
    n = min(n_groups * q_groups, MOST_PARTITIONS)
    lt, rt = lt.repartition(n, "h", "g"), rt.repartition(n, "h", "g")
    return lt.groupBy("h", "g").cogroup(rt.groupBy("h", "g")).applyInArrow(work, schema)


def _forest(rt: pa.Table, queries: list) -> Forest:
    top = max(max(abs(int(x)) for x in q) if len(q) else 0 for q in queries)
    return Forest(rt.to_pylist(), max(len(q) for q in queries), top)


def _short(score: int) -> int:
    return max(-_LONG - 1, min(_LONG, score))


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         positives: int = 5, negatives: int = 3, scale: int = 256, block_rows: int = BLOCK_ROWS,
         leaf_rows: int = LEAF_ROWS, block_group: int = 8, query_group: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for every row that ``anchors``
    (over the column ``id``) selects."""
    spark = rows.sparkSession
    ship_package(spark)
    ok = (rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                      scaled(vec_col, scale).alias("q")).where("id is not null and label is not null and q is not null"))
    # the pivots only shape the layout: PIVOTS rows of least hash, a bounded number
    pivots = [r["q"] for r in ok.orderBy(F.xxhash64("id"), "id", "label", "q").limit(PIVOTS).collect()]
    if not pivots:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    order = ("cell", "far", "id")
    laid = ok.mapInArrow(_layout(pivots), "id long, label long, q array<long>, cell int, far double")
    blocks = store(laid.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "label", "q")
                   .mapInArrow(_cut(block_rows, leaf_rows), BLOCK), "cover-trees")
    asked = store(ok.where(anchors).groupBy("id").agg(F.min(F.struct("label", "q")).alias("a"))
                  .select("id", "a.label", "a.q"), "anchors")
    n_groups = max(1, math.ceil(blocks.count() / block_group))
    q_groups = max(1, math.ceil(asked.count() / query_group))

    def near(lt: pa.Table, rt: pa.Table) -> pa.Table:
        out = []
        if lt.num_rows and rt.num_rows:
            qs = lt["q"].to_pylist()
            forest = _forest(rt, qs)
            for a, label, q in zip(lt["id"].to_pylist(), lt["label"].to_pylist(), qs, strict=True):
                (best,), _ = forest.search(q, a, label, True, [(None, None)], positives)
                out += [(a, j, _short(s)) for s, j in best]
        return pa.table({"id": pa.array([x[0] for x in out], pa.int64()), "positive": pa.array([x[1] for x in out], pa.int64()),
                         "score": pa.array([x[2] for x in out], pa.int64())})

    best = W.partitionBy("id").orderBy(F.col("score").desc(), "positive")
    found = _pairs(asked, blocks, n_groups, q_groups, near, "id long, positive long, score long")
    found = (found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
             .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "positive", "score"))).alias("pos")))
    opened = store(asked.join(found, "id"), "anchor-positives")  # at most ``positives`` entries each

    def hard(lt: pa.Table, rt: pa.Table) -> pa.Table:
        out = []
        if lt.num_rows and rt.num_rows:
            qs = lt["q"].to_pylist()
            forest = _forest(rt, qs)
            for a, label, q, pos in zip(lt["id"].to_pylist(), lt["label"].to_pylist(), qs, lt["pos"].to_pylist(),
                                        strict=True):
                each, _ = forest.search(q, a, label, False, [window_of(p["score"]) for p in pos], negatives)
                out += [(a, p["place"], p["positive"], p["score"], j, _short(s))
                        for p, hits in zip(pos, each, strict=True) for s, j in hits]
        names = ("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(zip(names, kinds, strict=True))})

    hits = _pairs(opened, blocks, n_groups, q_groups, hard,
                  "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    first = W.partitionBy("anchor_id", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    return (hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


__all__ = ["Forest", "augment", "cover_tree", "mine", "nets", "window_of"]
