"""Mixing sources to target weights by systematic sampling.

A source's target is its weight's share of all words, at most ``cap`` times the
source's size; what it can't take is shared again by weight. Within a source
every document expects ``target / size`` copies; a prefix sum of these, shifted
by one random offset per source, emits a document once per integer boundary it
crosses. Documents are laid out by size, so that neighbours on the line are
alike and the words taken stay within about one document of the target.

The prefix sum is two-level: documents fall into cells (source, size, salt);
cell counts are aggregated map-side, offsets are summed over cells, and the
position inside a cell comes from a window over that cell only. A source with a
third of all rows is so spread over its sizes and salts.

Defined results: a null or wordless text has size 0 and takes 0; a null source
is a source of its own, last in order; with no words at all every target is 0;
rows of equal id are separate documents; an empty table gives no rows; other
columns pass through (a clash with an added column drops the old one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinprice.llm.common import store, word_count

SALTS = 64
ADDED = ("size", "source_size", "target", "copies")


def _hex_uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size, target of every source; ``sizes`` has source, source_size, one row each.

    Re-sharing ends at a level where an uncapped source gets level * weight and
    a capped one cap * size. With sources in rising order of cap * size /
    weight, capping one more raises the level as long as that one can't hold
    its share and lowers it afterwards, so the level is the greatest of these
    steps. The windows run over one row per source, not over documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]),
                     ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    rows = sizes.select("source", "source_size", w.alias("weight"))
    room = W.orderBy((cap * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = room.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    steps = rows.select(
        "*", F.sum("source_size").over(everything).alias("t"), F.sum("weight").over(everything).alias("w"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("t0"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("w0"))
    step = (F.col("t") - cap * F.col("t0")).cast("double") / (F.col("w") - F.col("w0")).cast("double")
    level = F.max(step).over(everything)
    return steps.select("source", "source_size", F.least(
        (cap * F.col("source_size")).cast("double"), level * F.col("weight").cast("double")).alias("target"))


def _placed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17,
            source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
            size_col: str | None = None) -> DataFrame:
    """``row`` (the whole row of ``docs``) with size, source_size, target and ``copies``."""
    size = F.coalesce(F.col(f"`{size_col}`"), F.lit(0)).cast("long") if size_col else word_count(F.col(f"`{text_col}`"))
    salt = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
                                           .cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(SALTS))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(f"`{source_col}`").alias("source"), size.alias("size"), salt.alias("salt"))
    cells = store(keyed.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("m"))
    goal = targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, cap)
    # documents with words before a size, then before a salt of that size
    line = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    sized = by_size.where("size > 0").select("source", "size", F.coalesce(F.sum("m").over(line), F.lit(0)).alias("at0"))
    inside = W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    placed = cells.select("source", "size", "salt", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("at1"))
    placed, sized, goal = placed.alias("p"), sized.alias("s"), goal.alias("g")
    starts = (placed.join(sized, [F.col("p.source").eqNullSafe(F.col("s.source")),
                                  F.col("p.size") == F.col("s.size")], "left")
              .join(goal, F.col("p.source").eqNullSafe(F.col("g.source")), "left")
              .select(F.col("p.source").alias("source"), F.col("p.size").alias("size"), F.col("p.salt").alias("salt"),
                      (F.col("at1") + F.coalesce("at0", F.lit(0))).alias("at"), "source_size", "target"))
    k, c = keyed.alias("k"), starts.alias("c")
    rank = F.row_number().over(W.partitionBy("k.source", "k.size", "k.salt").orderBy(F.col(f"k.row.`{id_col}`")))
    rows = (k.withColumn("r", rank - 1)
            .join(c, [F.col("k.source").eqNullSafe(F.col("c.source")), F.col("k.size") == F.col("c.size"),
                      F.col("k.salt") == F.col("c.salt")], "left")
            .select("row", F.col("k.size").alias("size"), "source_size", "target",
                    (F.col("at") + F.col("r")).cast("double").alias("j"), F.col("k.source").alias("src")))
    shift = _hex_uniform(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "src"), F.lit("null"))))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    part = rate - whole
    crossed = F.floor((F.col("j") + 1) * part + shift) - F.floor(F.col("j") * part + shift)
    copies = F.when(F.col("size") > 0, whole + crossed).otherwise(0).cast("int")
    return rows.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target and ``copies`` (0 to cap).

    Options: ``weights``, ``cap``, ``seed``, ``source_col``, ``text_col``, ``id_col``; ``size_col`` names a column
    that already holds the sizes.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    return _placed(docs, **options).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *ADDED)


def emit(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row once per copy that the mix takes; its columns come back as they are, whatever their names."""
    taken = _placed(docs, **options).where("copies > 0")
    each = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


__all__ = ["emit", "mix", "targets"]
