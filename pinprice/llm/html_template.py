"""Main text of raw HTML pages by equivalence classes of tokens of same-host pages.

A page is a sequence of tokens (``html_parse``): structural tags, told apart by
their path, and blocks of text. Per host, tokens of equal occurrence vector
(how often each page holds them) form an equivalence class; large and frequent
classes whose tokens stand in one order in every page, and nest inside a gap of
the host's largest class, are the template. Classes that occur once a page cut
the page into slots; repeated ones (list items, paragraphs) are sets inside a
slot. The slots' variable text, without menus, footers, forms and the like,
weighs the elements that hold the slots, and the lightest element that still
holds the bulk of it is the host's region (text of article and main elements counts also where it is the same). A page's text is the blocks of its
region in page order.

The vectors never exist as such: a token's vector is known by its number of
pages and two sums, over pages, of hashes of (page, occurrences), which Spark
adds up after a first sum per batch. What a host keeps is bounded by its pages'
length: only tokens in at least one of ``RARE`` pages can be in a class, so
there are at most ``RARE`` times a mean page's tokens. Hosts of fewer than
``MIN_PAGES`` pages are too few to compare and share one pool, which is a host
of its own. Pages are parsed once, into a stored table; the later steps read
its columns and send a host's template to its pages by a join (broadcast only
if its measured size allows).

Text that all pages of a host repeat outside an ``article`` or ``main`` element
(a notice without a telling name, say) is template text and left out; inside
them nothing is. A page without its host's region gives the blocks of its own
article or main element, or of its body, less menus and the like.

Defined results: every row gives one row; null and empty html give an empty
text; a null url has the empty host; repeated rows and ids are pages of their
own; pages of any length are read whole; unclosed elements end with their
parents, an unfinished tag at the end is dropped, an unfinished comment hides
the rest; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinprice.llm.common import ship_package, slices, store
from pinprice.llm.hashing import mix
from pinprice.llm.html_parse import MAIN, host_of, parse, role_of

#: A host of fewer pages shares the pool; a class must be in one of RARE pages, and hold MIN_SIZE tokens.
MIN_PAGES, RARE, MIN_SIZE = 4, 4, 2
#: An element that holds this share of its parent's variable text is entered, in search of the region.
BULK = 0.75
#: Bytes of templates that may be broadcast.
MAX_BROADCAST = 64 << 20

PARSED = ("page_id long, url string, host string, key long, roles array<long>, depths array<int>, blocks array<string>, "
          "paths array<string>, at array<int>, junk array<boolean>, main boolean")
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("key", pa.int64()),
                     ("roles", pa.list_(pa.int64())), ("depths", pa.list_(pa.int32())), ("blocks", pa.list_(pa.string())),
                     ("paths", pa.list_(pa.string())), ("at", pa.list_(pa.int32())), ("junk", pa.list_(pa.bool_())), ("main", pa.bool_())])
#: Elements that can hold an article; others (paragraphs, lists) are parts of one.
HOLDERS = frozenset("article body center div html main section td".split())


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 128):
        rows = []
        for i, url, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
            source = source or ""
            p = parse(source)
            h = xxhash.xxh3_64_intdigest(f"{i}\n{url}\n{source}".encode("utf-8", "surrogatepass"))
            rows.append({"page_id": i, "url": url, "host": host_of(url), "key": h - (1 << 64) if h >> 63 else h,
                         "roles": p.roles, "depths": p.depths, "blocks": p.blocks, "paths": p.paths, "at": p.at,
                         "junk": p.junk, "main": p.main})
        yield pa.RecordBatch.from_pylist(rows, schema=_PARSED)


_SUMS = pa.schema([("host", pa.string()), ("role", pa.int64()), ("pages", pa.int64()), ("f1", pa.int64()),
                   ("f2", pa.int64())])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, roles) to sums per (host, token) of this batch; token 0 counts the pages."""
    for b in batches:
        if not b.num_rows:
            continue
        hosts, host = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True)
        key = b.column(1).to_numpy().view(np.uint64)
        lists = b.column(2)
        role = lists.flatten().to_numpy(zero_copy_only=False)
        page = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        role = np.concatenate([role, np.zeros(b.num_rows, np.int64)])
        page = np.concatenate([page, np.arange(b.num_rows)])
        order = np.lexsort((role, page))
        page, role = page[order], role[order]
        at = np.flatnonzero(np.append(True, (page[1:] != page[:-1]) | (role[1:] != role[:-1])))
        times = np.diff(np.append(at, len(page))).astype(np.uint64)
        page, role = page[at], role[at]
        with np.errstate(over="ignore"):
            f = mix(key[page] + times * np.uint64(0x9E3779B97F4A7C15))
        f1, f2 = (f >> np.uint64(32)).astype(np.int64), (f & np.uint64(0xFFFFFFFF)).astype(np.int64)
        h = host[page]
        order = np.lexsort((role, h))
        h, role, f1, f2 = h[order], role[order], f1[order], f2[order]
        at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (role[1:] != role[:-1])))
        yield pa.RecordBatch.from_arrays([
            pa.array(hosts[h[at]], pa.string()), pa.array(role[at]), pa.array(np.diff(np.append(at, len(h)))),
            pa.array(np.add.reduceat(f1, at)), pa.array(np.add.reduceat(f2, at))], schema=_SUMS)


def candidate_classes(parsed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """site, root, tokens, classes: per site the tokens of large and frequent equivalence classes."""
    sums = (parsed.select("host", "key", "roles").mapInArrow(_vectors, "host string, role long, pages long, f1 long, f2 long")
            .groupBy("host", "role").agg(*[F.sum(c).alias(c) for c in ("pages", "f1", "f2")]))
    sums = store(sums, "html-vectors")
    # f1 and f2 add 32-bit numbers, so that 2^31 pages stay within a long
    own = sums.where((F.col("role") == 0) & (F.col("pages") >= min_pages)).select(
        F.col("host").alias("_h"), F.col("pages").alias("_n"))
    j = sums.join(own, sums["host"] == own["_h"], "left")
    big = j.where(F.col("_h").isNotNull() & (F.col("host") != "")).select(F.col("host").alias("site"), "role", "pages",
                                                                           "f1", "f2")
    pool = j.where(F.col("_h").isNull() | (F.col("host") == "")).groupBy("role").agg(
        *[F.sum(c).alias(c) for c in ("pages", "f1", "f2")]).select(F.lit("").alias("site"), "role", "pages", "f1", "f2")
    every = big.where(f"pages >= {min_pages} or role = 0").unionByName(pool.where(f"pages >= {min_pages} or role = 0"))
    total = every.where("role = 0").select(F.col("site").alias("_s"), F.col("pages").alias("_total"))
    often = every.where("role <> 0").join(total, F.col("site") == F.col("_s")).where(F.col("pages") * RARE >= F.col("_total"))
    # a class holds at most the tokens of one page
    same = W.partitionBy("site", "pages", "f1", "f2")
    often = often.withColumn("size", F.count(F.lit(1)).over(same)).where(F.col("size") >= MIN_SIZE)
    often = often.withColumn("class", F.xxhash64("pages", "f1", "f2"))
    token = F.struct(F.col("role"), F.col("class"))
    return often.groupBy("site").agg(
        F.max(F.struct("pages", "size", "class"))["class"].alias("root"),
        F.array_sort(F.collect_list(token)).alias("t")).select(
        "site", "root", F.col("t.role").alias("tokens"), F.col("t.class").alias("classes"))


def _attach(parsed: DataFrame, table: DataFrame, arrays: list[str], scalars: list[str]):
    """(pages with their host's row of ``table``, the pool's row); null where the host has none of its own."""
    size = F.lit(64)
    for c in arrays:
        size = size + F.size(c) * 8
    for c in scalars:
        size = size + F.length(F.col(c).cast("string"))
    total = table.agg(F.sum(size).alias("n")).first()["n"] or 0
    pool = table.where("site = ''").first()  # one row, bounded by RARE pages
    own = table.where("site <> ''").withColumnRenamed("site", "host")
    own = F.broadcast(own) if total <= MAX_BROADCAST else own
    return parsed.join(own, "host", "left"), pool


def _columns(b: pa.RecordBatch, *names: str) -> list[list]:
    return [b.column(b.schema.get_field_index(c)).to_pylist() for c in names]


def _arrays(b: pa.RecordBatch, name: str) -> list:
    return list(b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False))


_CHECKED = pa.schema([("site", pa.string()), ("class", pa.int64()), ("least", pa.int64()), ("most", pa.int64()),
                      ("fine", pa.bool_()), ("times", pa.int64())])


def page_classes(roles: np.ndarray, tokens: np.ndarray, classes: np.ndarray, root: int) -> dict[int, tuple[int, bool, int]]:
    """Per class of a page: a hash of the order of its tokens, whether every occurrence has that order and lies in one
    gap of the root class, and the number of occurrences."""
    at = np.minimum(np.searchsorted(tokens, roles), len(tokens) - 1)
    here = np.flatnonzero(tokens[at] == roles)
    cls, tok = classes[at[here]], roles[here]
    gap = np.searchsorted(here[cls == root], here)
    sizes = dict(zip(*(x.tolist() for x in np.unique(classes, return_counts=True)), strict=True))
    order = np.argsort(cls, kind="stable")
    out = {}
    edges = np.flatnonzero(np.append(True, np.diff(cls[order]) != 0)).tolist() if len(order) else []
    for a, b in zip(edges, [*edges[1:], len(order)], strict=False):
        rows = order[a:b]
        c = int(cls[rows[0]])
        m = sizes[c]
        fine = len(rows) % m == 0
        if fine:
            turns = tok[rows].reshape(-1, m)
            fine = bool((turns == turns[0]).all())
            if fine and c != root:
                g = gap[rows].reshape(-1, m)
                fine = bool((g == g[:, :1]).all())
        seq = xxhash.xxh3_64_intdigest(tok[rows[:m]].tobytes()) >> 1
        out[c] = (seq, fine, len(rows) // m)
    return out


def _check(pool):
    """mapInArrow: order, nesting and repetition of each candidate class, per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, int], list] = {}
            hosts, = _columns(b, "host")
            for host, roles, root, tokens, classes in zip(
                    hosts, _arrays(b, "roles"), *_columns(b, "root"), _arrays(b, "tokens"), _arrays(b, "classes"),
                    strict=True):
                site = host
                if root is None:
                    if pool is None:
                        continue
                    site, root, tokens, classes = "", *pool
                for c, (seq, fine, times) in page_classes(roles, np.asarray(tokens), np.asarray(classes), root).items():
                    s = seen.setdefault((site, c), [seq, seq, True, 0])
                    s[0], s[1], s[2], s[3] = min(s[0], seq), max(s[1], seq), s[2] and fine, max(s[3], times)
            if seen:
                yield pa.RecordBatch.from_pylist([
                    {"site": k[0], "class": k[1], "least": v[0], "most": v[1], "fine": v[2], "times": v[3]}
                    for k, v in seen.items()], schema=_CHECKED)

    return run


def template(parsed: DataFrame, candidates: DataFrame) -> DataFrame:
    """site, tokens, texts: tokens of valid classes that occur once a page, and all tokens of valid classes."""
    pages, pool = _attach(parsed.select("host", "roles"), candidates, ["tokens", "classes"], ["root"])
    pool = pool and (pool["root"], np.array(pool["tokens"]), np.array(pool["classes"]))
    checked = pages.mapInArrow(_check(pool), "site string, class long, least long, most long, fine boolean, times long")
    valid = (checked.groupBy("site", "class").agg(F.min("least").alias("least"), F.max("most").alias("most"),
                                                  F.min("fine").alias("fine"), F.max("times").alias("times"))
             .where("fine and least = most"))
    each = candidates.select("site", F.explode(F.arrays_zip("tokens", "classes")).alias("t")).select(
        "site", F.col("t.tokens").alias("token"), F.col("t.classes").alias("class"))
    once = F.when(F.col("times") == 1, F.col("token"))
    return each.join(valid, ["site", "class"]).groupBy("site").agg(
        F.array_sort(F.collect_list(once)).alias("once"), F.array_sort(F.collect_list("token")).alias("known"))


_SLOTS = pa.schema([("site", pa.string()), ("path", pa.string()), ("chars", pa.int64())])


def slot_holders(roles: np.ndarray, depths: np.ndarray, at: np.ndarray, paths: list[str], once: np.ndarray) -> list[str]:
    """Per block, the path of the element that holds its slot: the one open after the last template token before it."""
    cut = np.flatnonzero(np.isin(roles, once))
    left = np.searchsorted(cut, at) - 1
    return [">".join(p.split(">")[:depths[cut[i]]]) if i >= 0 else "" for p, i in zip(paths, left.tolist(), strict=True)]


def _weigh(pool):
    """mapInArrow: variable characters per slot-holding element, per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars: dict[tuple[str, str], int] = {}
            hosts, paths, junk, sizes = _columns(b, "host", "paths", "junk", "sizes")
            for host, p, j, n, roles, depths, at, once, known in zip(
                    hosts, paths, junk, sizes, *(_arrays(b, c) for c in ("roles", "depths", "at", "once", "known")),
                    strict=True):
                site = host
                if once is None:
                    site, once, known = "", *(pool or (np.empty(0, np.int64), np.empty(0, np.int64)))
                if not p:
                    continue
                known = np.isin(roles[at], known)
                for holder, path, bad, fixed, size in zip(slot_holders(roles, depths, at, p, once), p, j, known.tolist(),
                                                          n, strict=True):
                    if not bad and (not fixed or names_of(path) & MAIN):
                        chars[site, holder] = chars.get((site, holder), 0) + size
            if chars:
                yield pa.RecordBatch.from_pylist([{"site": k[0], "path": k[1], "chars": v} for k, v in chars.items()],
                                                 schema=_SLOTS)

    return run


def region_of(weights: dict[str, int], bulk: float = BULK) -> str:
    """The deepest element that can hold an article and still holds the bulk of its parent's text, from the root on."""
    def lifted(path: str) -> str:
        parts = path.split(">") if path else []
        while parts and parts[-1].split(".")[0] not in HOLDERS:
            parts.pop()
        return ">".join(parts)

    held: dict[str, int] = {}
    for path, n in weights.items():
        parts = [x for x in lifted(path).split(">") if x]
        for i in range(len(parts) + 1):
            at = ">".join(parts[:i])
            held[at] = held.get(at, 0) + n
    now = ""
    while True:
        deeper = [p for p in held if p != now and p.startswith(now + ">" if now else "") and
                  p.count(">") == (now.count(">") + 1 if now else 0)]
        best = max(deeper, key=lambda p: (held[p], p), default=None)
        if best is None or held[best] < bulk * held[now] or (now and now.rsplit(">", 1)[-1].split(".")[0] in MAIN):
            return lifted(now)
        now = best


_REGIONS = pa.schema([("site", pa.string()), ("region", pa.string())])


def _regions(t: pa.Table) -> pa.Table:
    if not t.num_rows:
        return _REGIONS.empty_table()
    weights = dict(zip(t["path"].to_pylist(), t["chars"].to_pylist(), strict=True))
    return pa.table({"site": [t["site"][0].as_py()], "region": [region_of(weights)]}, schema=_REGIONS)


def names_of(path: str) -> set[str]:
    """Names of the elements of a path."""
    return {x.split(".")[0] for x in path.split(">")}


def in_path(path: str, region: str) -> bool:
    return not region or path == region or path.startswith(region + ">")


def main_blocks(roles, blocks: list[str], paths: list[str], junk: list[bool], at, main: bool, region: str | None,
                known) -> list[str]:
    """The page's blocks inside its region."""
    kept = [i for i, j in enumerate(junk) if not j]
    names = [names_of(p) for p in paths]
    if region is not None and role_of("<", region) in roles:
        kept = [i for i in kept if in_path(paths[i], region)]
    elif main:  # not one of the template: its own article
        kept = [i for i in kept if names[i] & MAIN]
    fixed = set(known)
    return [blocks[i] for i in kept if names[i] & MAIN or roles[at[i]] not in fixed]


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("region", pa.string())])


def _extract(pool):
    """mapInArrow: pages to their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts, where = [], []
            ids, urls, blocks, paths, junk, regions, roles, at, main, known = _columns(
                b, "page_id", "url", "blocks", "paths", "junk", "region", "roles", "at", "main", "known")
            for bl, p, j, region, r, a, m, k in zip(blocks, paths, junk, regions, roles, at, main, known, strict=True):
                if region is None and pool is not None:
                    region, k = pool
                got = main_blocks(r, bl, p, j, a, m, region, k or ())
                texts.append("\n".join(got))
                where.append(region)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()),
                                              pa.array(texts, pa.string()), pa.array(where, pa.string())], schema=_OUT)

    return run


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, region: the main text of every page. Columns read: page_id, url, html."""
    ship_package(pages.sparkSession)
    parsed = store(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_parse, PARSED), "html-parsed")
    candidates = store(candidate_classes(parsed, min_pages), "html-classes")
    tokens = store(template(parsed, candidates), "html-template")
    sized = parsed.select("host", "roles", "depths", "at", "paths", "junk",
                          F.transform("blocks", F.length).alias("sizes"))
    joined, pool = _attach(sized, tokens, ["once", "known"], [])
    pool = pool and (np.array(pool["once"], np.int64), np.array(pool["known"], np.int64))
    weights = (joined.mapInArrow(_weigh(pool), "site string, path string, chars long")
               .groupBy("site", "path").agg(F.sum("chars").alias("chars")))
    # a site's paths are those of its template's tokens, so a group is bounded as they are
    regions = weights.groupBy("site").applyInArrow(_regions, "site string, region string")
    regions = store(regions.join(tokens.select("site", "known"), "site", "left"), "html-regions")
    joined, pool = _attach(parsed.drop("key", "depths"), regions, ["known"], ["region"])
    pool = pool and (pool["region"], pool["known"])
    out = joined.mapInArrow(_extract(pool), "page_id long, url string, text string, region string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "region")


__all__ = ["candidate_classes", "extract", "main_blocks", "page_classes", "region_of", "slot_holders", "template"]
