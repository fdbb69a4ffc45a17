"""Removal of lines and passages that occur before (global unit hashing).

Units of a text are its lines, and pieces whose bounds its own words set: a
word opens a piece where its hash is the least among its neighbours, so a
passage has the same pieces wherever it is pasted, also inside a line. A piece
unit is two neighbouring pieces. Pieces find repeats of few words but leave their
ends; every run of ``WINDOW`` words is a unit as well, so a repeated passage of
so many words or more goes whole. Units are normalised (ASCII case, white space)
and digested to 128 bits; digests are grouped over all documents, the earliest
ranked occurrence (least id, then least offset) stays, and the others go: a
line of ``min_line_words`` words or more, and a run of repeated piece units of
``min_run_words`` words or more. Removed parts are reported with their offsets
(code points) in the original text.

A text that an earlier document holds as a whole goes as a whole; such copies are
found by 128 bits of the text and take no part in the grouping of units, as the
first of them holds all of theirs. The grouping goes in two steps. The first one exchanges 64 bits of each unit's
digest, once per some texts, with the least and greatest id that hold it; of
windows it takes their seeds (the least hash of ``SEED`` words within a window
depends on the window's words alone, so only windows whose seed repeats can
repeat). The digests that several documents hold go into a bit filter of bounded
size that every task gets. In the second step only units that the filter lets
through are exchanged, with both digests: all that repeat and few others (all
others, once there are far more repeats than bits), and grouped exactly. Both
groupings need one least and one greatest id per digest, aggregated before the
shuffle, so a line held by a third of all documents costs a row per task; the
digests that repeat are then joined back (a skewed join, which adaptive
execution splits), and each document's own list meets its text.

Of a removed part ``first_doc`` is the earliest document that holds the unit, of a
whole copy the first document of that text.

Defined results: a null text stays null and an empty one empty; rows of equal
id have equal rank, so that none removes another's units; a null id ranks last;
an empty table gives no rows; every text is cut whole, whatever its length;
other columns pass through (``removed`` is replaced if there is one).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinprice.llm.common import ship_package, slices, store
from pinprice.llm.hashing import Words, batches_of, mix, spans_digest, words_of
from pinprice.operators.joins import join_small

MIN_LINE_WORDS = 1  # every line that holds a word
MIN_RUN_WORDS = 20
REACH = 4  # a piece begins at a hash that is least among so many words on either side
WINDOW, SEED = 50, 20
LAST = 2**63 - 1  # rank of a null id
SPAN = "array<struct<start:bigint,end:bigint,first_doc:bigint>>"


def piece_starts(w: Words) -> np.ndarray:
    """Word numbers at which pieces begin; each text's first word and end are bounds too."""
    n = len(w.hash)
    with np.errstate(over="ignore"):
        v = mix(w.hash * np.uint64(3) + np.concatenate([[np.uint64(0)], w.hash[:-1]]), 7)
    bounds = np.unique(w.first)
    v[bounds[bounds < n]] = np.uint64(2**64 - 1)  # their left neighbour is another text's
    # texts are kept apart by as many empty places as a window reaches
    text = np.searchsorted(w.first, np.arange(n), side="right") - 1
    at = np.arange(n) + REACH * (text + 1)
    wide = np.full((at[-1] + 1 if n else 0) + REACH, np.uint64(2**64 - 1))
    wide[at] = v
    least = np.ones(n, bool)
    for k in range(1, REACH + 1):
        least &= (v < wide[at - k]) & (v <= wide[at + k])
    return np.union1d(np.flatnonzero(least), bounds)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    size = 1
    while 2 * size <= n:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    rest = n - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def windows(w: Words) -> np.ndarray:
    """Where runs of WINDOW words begin that lie in one text."""
    n = len(w.hash)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    text = np.searchsorted(w.first, np.arange(n), side="right") - 1
    return np.flatnonzero(text[:n - WINDOW + 1] == text[WINDOW - 1:])


def seeds(w: Words, a: np.ndarray) -> np.ndarray:
    """The least hash of SEED neighbouring words within each window."""
    if not len(a):
        return np.zeros(0, np.int64)
    at = np.arange(len(w.hash) - SEED + 1)
    return _least(spans_digest(w.hash, at, at + SEED, 4)[0], WINDOW - SEED + 1)[a].view(np.int64)


def units_of(w: Words, min_line_words: int = MIN_LINE_WORDS):
    """Word runs (a, b) of all units, their digests, and whether each is a line."""
    breaks = np.flatnonzero(w.buf == 0x0A)
    line = np.searchsorted(w.start, np.concatenate([[0], breaks + 1]))
    la, lb = line[:-1], line[1:]
    long = lb - la >= min_line_words
    la, lb = la[long], lb[long]
    cut = piece_starts(w)
    pa_, pb = cut[:-2], cut[2:]
    # both pieces lie in one text; a text of one piece alone makes a unit of that piece
    ends = np.isin(cut, w.first)
    inner = ~ends[1:-1] if len(cut) > 2 else np.zeros(0, bool)
    pa_, pb = pa_[inner], pb[inner]
    whole = ends[:-1] & ends[1:] if len(cut) > 1 else np.zeros(0, bool)
    wa, wb = cut[:-1][whole], cut[1:][whole]
    over = windows(w)
    a, b = np.concatenate([la, pa_, wa, over]), np.concatenate([lb, pb, wb, over + WINDOW])
    is_line = np.zeros(len(a), bool)
    is_line[:len(la)] = True
    # units of one kind only are compared: a text of one line may be one piece as well
    kinds = np.cumsum([0, len(la), len(pa_) + len(wa), len(over)])
    d1, d2 = (np.concatenate(x) for x in zip(*(
        spans_digest(w.hash, a[lo:hi], b[lo:hi], salt) for lo, hi, salt in zip(kinds[:-1], kinds[1:], (1, 3, 2), strict=True))))
    return a, b, d1.view(np.int64), d2.view(np.int64), is_line


def _distinct(doc: np.ndarray, d1: np.ndarray, d2: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """The distinct digests of each text of a batch, with its id."""
    order = np.lexsort((d1, doc))
    doc, d1, d2 = doc[order], d1[order], d2[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
    return pa.RecordBatch.from_arrays(
        [pa.array(d1[new]), pa.array(d2[new]), pa.array(ids[doc[new]].astype(np.int64))], names=["d1", "d2", "doc"])


#: Bits of the filter per repeated digest, and the most bits there are (32 MB).
BITS_EACH, MOST_BITS = 32, 1 << 28


def _places(d: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bits that a digest sets in a filter of ``bits`` bits (a power of 2)."""
    return [(mix(d.view(np.uint64), salt) & np.uint64(bits - 1)).astype(np.int64) for salt in (51, 53)]


#: Digests that a task holds before it emits the distinct ones.
HELD = 1 << 16


def _emit_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to digests (of windows, the seeds), distinct over some texts, with the least and greatest document."""

    def distinct(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        d, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((doc, d))
        d, doc = d[order], doc[order]
        at = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.empty(0, np.int64)
        last = np.append(at[1:], len(d)) - 1 if len(d) else at
        return pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(doc[at]), pa.array(doc[last])], names=["d", "lo", "hi"])

    found, held = [], 0
    for batch in slices(batches):
        docs, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for lo, hi in batches_of(texts):
            w = words_of(texts[lo:hi])
            a, _, d1, _, _ = units_of(w)
            over = windows(w)
            n = len(a) - len(over)
            text = np.searchsorted(w.first, np.concatenate([a[:n], over]), side="right") - 1
            found.append((np.concatenate([d1[:n], seeds(w, over)]), docs[lo:hi][text].astype(np.int64)))
            held += len(a)
            if held >= HELD:
                yield distinct(found)
                found, held = [], 0
    if found:
        yield distinct(found)


def _bit_words(bits: int):
    """mapInArrow: digests to the words and bits of the filter that they set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_places(b.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(
                (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    return run


def _filter_of(again: DataFrame) -> np.ndarray:
    """The bit filter of the repeated digests (column d), as 64-bit words: at most MOST_BITS / 64 of them."""
    bits = 1 << 10
    while bits < min(MOST_BITS, BITS_EACH * again.count()):
        bits *= 2
    words = again.mapInArrow(_bit_words(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = words.toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def passes(words: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether the filter lets a digest through: always if it is one of its own, rarely otherwise."""
    ok = np.ones(len(d), bool)
    for at in _places(d, len(words) << 6):
        ok &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
    return ok


def _emit_repeats(filter_words):
    """mapInArrow: (doc, text) to the distinct digests of each document that the filter (a broadcast) lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            docs, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for lo, hi in batches_of(texts):
                w = words_of(texts[lo:hi])
                a, _, d1, d2, _ = units_of(w)
                over = windows(w)
                n = len(a) - len(over)
                keep = passes(filter_words.value, np.concatenate([d1[:n], seeds(w, over)]))
                text = np.searchsorted(w.first, a[keep], side="right") - 1
                yield _distinct(text, d1[keep], d2[keep], docs[lo:hi])

    return run


@dataclass(frozen=True)
class Known:
    """Digests that an earlier document than a text of the batch holds: text number, digest, that document."""

    text: np.ndarray
    d1: np.ndarray
    d2: np.ndarray
    first: np.ndarray

    def find(self, text: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Index of each unit's entry, -1 where there is none."""
        if not len(self.d1):
            return np.full(len(d1), -1)
        values = np.unique(self.d1)
        own = self.text * len(values) + np.searchsorted(values, self.d1)
        order = np.argsort(own, kind="stable")
        at = np.searchsorted(values, d1)
        at[at == len(values)] = 0
        place = np.searchsorted(own[order], text * len(values) + at)
        place[place == len(order)] = 0
        entry = order[place]
        hit = (self.text[entry] == text) & (self.d1[entry] == d1) & (self.d2[entry] == d2)
        return np.where(hit, entry, -1)


def repeated(w: Words, known: Known, ids: np.ndarray, min_line_words: int = MIN_LINE_WORDS,
             min_run_words: int = MIN_RUN_WORDS, whole: list[int | None] | None = None) -> list[list[tuple]]:
    """Per text, the byte spans (start, end, first_doc) to remove, in the batch's buffer.

    ``whole`` names, for a copy of an earlier text, the first document of it: all its units are known.
    """
    a, b, d1, d2, is_line = units_of(w, min_line_words)
    doc = np.searchsorted(w.first, a, side="right") - 1
    out: list[list[tuple]] = [[] for _ in range(len(w.first) - 1)]
    entry = known.find(doc, d1, d2)
    copies = np.array([x is not None for x in whole] if whole else np.zeros(len(out)), bool)
    # only units that may go are looked at one by one: known ones and those twice in a text
    may = (entry >= 0) | copies[doc]
    by = np.lexsort((d1, doc))
    same = np.flatnonzero((d1[by][1:] == d1[by][:-1]) & (doc[by][1:] == doc[by][:-1]))
    may[by[same]] = may[by[same + 1]] = True
    order = np.lexsort((~is_line, a, doc))
    order = order[may[order]]
    seen: dict[tuple[int, int], int] = {}
    now, runs = -1, []

    def close(i: int) -> None:
        spans, last = out[i], None
        for s, e, first in [*runs, (None, None, None)]:
            if last and s is not None and s <= last[1]:
                last[1] = max(last[1], e)
                continue
            if last and last[1] - last[0] >= min_run_words:
                spans.append((int(w.start[last[0]]), int(w.end[last[1] - 1]), last[2]))
            last = [s, e, first]

    for j in order.tolist():
        i = int(doc[j])
        if i != now:
            if now >= 0:
                close(now)
            now, runs, seen = i, [], {}
        if entry[j] >= 0:
            first = int(known.first[entry[j]])
        elif copies[i]:
            first = whole[i]
        else:
            key = (int(d1[j]), int(d2[j]))
            if key not in seen:
                seen[key] = int(b[j])
                continue
            if b[j] - a[j] == WINDOW and not is_line[j] and a[j] < seen[key]:
                continue  # it shares words with the occurrence that stays
            first = int(ids[i])
        if is_line[j]:
            out[i].append((int(w.start[a[j]]), int(w.end[b[j] - 1]), first))
        else:
            runs.append((int(a[j]), int(b[j]), first))
    if now >= 0:
        close(now)
    return out


def _hits(column: pa.Array) -> Known:
    """A column of hit lists as arrays, without an object per hit."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten()
    return Known(np.repeat(np.arange(len(column)), sizes), *(flat.field(n).to_numpy() for n in ("d1", "d2", "first")))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, hits and carried columns) to the carried ones, the text that stays and what went."""
    for batch in slices(batches):
        names = batch.schema.names
        ids = batch.column(names.index("__doc")).to_numpy()
        texts = batch.column(names.index("__text")).to_pylist()
        hits, whole = batch.column(names.index("__hits")), batch.column(names.index("__whole")).to_pylist()
        clean: list[str | None] = []
        gone: list[list[dict]] = []
        for lo, hi in batches_of(texts):
            part = texts[lo:hi]
            w = words_of(part)
            for k, spans in enumerate(repeated(w, _hits(hits.slice(lo, hi - lo)), ids[lo:hi], whole=whole[lo:hi])):
                text, removed = cut(part[k], [(s - int(w.text_at[k]), e - int(w.text_at[k]), f) for s, e, f in spans])
                clean.append(text)
                gone.append(removed)
        kept = [i for i, n in enumerate(names) if n not in ("__doc", "__text", "__hits", "__whole")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), pa.array(clean, pa.string()), pa.array(gone, pa.list_(pa.struct(
                [("start", pa.int64()), ("end", pa.int64()), ("first_doc", pa.int64())])))],
            names=[*(names[i] for i in kept), "__clean", "__removed"])


def cut(text: str | None, spans: list[tuple[int, int, int]]) -> tuple[str | None, list[dict]]:
    """Remove byte spans and the white space after each; offsets are reported in code points."""
    if not spans:
        return text, []
    raw = text.encode("utf-8", "surrogatepass")
    left, removed, at = [], [], 0
    merged: list[list] = []
    for s, e, first in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, first])
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    for s, e, first in merged:
        left.append(raw[at:s])
        at = e
        while at < len(raw) and raw[at:at + 1].isspace():
            at += 1
            if raw[at - 1:at] == b"\n":
                break
        removed.append({"start": int(chars[s]), "end": int(chars[e]),
                        "first_doc": None if first == LAST else first})
    left.append(raw[at:])
    return b"".join(left).decode("utf-8", "surrogatepass"), removed


def _ranked(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """__doc (rank), __text, further columns, and 128 bits of the text."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("__doc"), text.alias("__text"),
                       *more, F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(1), text).alias("__h2"))


def _with_copies(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Adds __whole: for a copy of an earlier document's text, the first document that holds it."""
    j = join_small(rows, firsts, ["__h1", "__h2"], "left")
    return j.withColumn("__whole", F.when(F.col("__doc") > F.col("__first"), F.col("__first"))).drop("__h1", "__h2", "__first")


def repeated_texts(rows: DataFrame) -> DataFrame:
    """__h1, __h2, __first of texts that several documents hold; a row per such text."""
    each = rows.where("__text is not null and __text != ''").groupBy("__h1", "__h2")
    return each.agg(F.min("__doc").alias("__first"), F.max("__doc").alias("__last")).where("__last > __first").drop("__last")


def repeated_units(rows: DataFrame) -> DataFrame:
    """__doc, __hits: per document the digests that a lower-ranked document holds, with that document.

    ``rows``: __doc, __text, without copies of whole texts.
    """
    body = rows.where("__text is not null").select("__doc", "__text")
    each = body.mapInArrow(_emit_digests, "d long, lo long, hi long").groupBy("d")
    again = store(each.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("d"), "repeated-digests")
    words = rows.sparkSession.sparkContext.broadcast(_filter_of(again))
    # hashed twice rather than stored: the digests would take more room than the texts
    units = body.mapInArrow(_emit_repeats(words), "d1 long, d2 long, doc long")
    first = units.groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("last > first")
    hits = units.join(first.select("d1", "d2", "first"), ["d1", "d2"]).where("doc > first")
    return hits.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("d1", "d2", "first")).alias("__hits"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated units cut out of the text, and ``removed``: array of (start, end, first_doc)."""
    ship_package(docs.sparkSession)
    firsts = store(repeated_texts(_ranked(docs, id_col, text_col)), "repeated-texts")
    hits = repeated_units(_with_copies(_ranked(docs, id_col, text_col), firsts).where("__whole is null"))
    carried = [c for c in docs.columns if c not in (text_col, "removed")]
    body = _with_copies(_ranked(docs, id_col, text_col, *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carried)]),
                        firsts)
    kinds = dict(docs.dtypes)
    ddl = ", ".join([f"__c{i} {kinds[c]}" for i, c in enumerate(carried)] + ["__clean string", f"__removed {SPAN}"])
    out = body.join(hits, "__doc", "left").mapInArrow(_cleaned, ddl)
    source = {c: f"__c{i}" for i, c in enumerate(carried)} | {text_col: "__clean"}
    names = [c for c in docs.columns if c != "removed"]
    return out.select(*[F.col(source[c]).alias(c) for c in names], F.col("__removed").alias("removed"))


__all__ = ["Known", "MIN_LINE_WORDS", "MIN_RUN_WORDS", "cut", "passes", "piece_starts", "remove_repeats", "repeated",
           "repeated_units", "seeds", "units_of", "windows"]
