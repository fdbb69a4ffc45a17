"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the measurements and one failure
bit per rule go to a ledger. Policies are versioned masks over those bits, so
changing a policy or computing an ablation never reads a text again: both are
bitwise expressions and aggregates over the ledger.

Defined results: a null text has no words; lines are split at ``\\n`` only; an
empty table gives an empty ledger; repeated rows are measured row by row; every
text is measured whole. Further columns pass through untouched, a clash with a
ledger column being resolved in favour of the ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinprice.llm.common import ship_package, slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Symbols the contract counts, and its word separators (fixed values).
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition over the measurements; ``bit`` never changes once used."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_share", "n_words > 0 AND 100 * n_symbols > 20 * n_words"),
    Rule(3, "repeated_lines", "n_lines > 0 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the filter: a document is kept if none of its rules fails."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (
    BASE,
    Policy("keep-1", (*BASE.rules, "symbol_share", "repeated_lines")),
    Policy("keep-2", (*BASE.rules, "symbol_share", "repeated_lines", "word_length")),
)}
PRODUCTION = "keep-2"


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one whole text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() separates at exactly the six SPACES
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            covered_by_repeats(ids, len(index), 3), len(lines))


def covered_by_repeats(ids: np.ndarray, n_ids: int, width: int) -> int:
    """Positions inside windows of ``width`` ids that occur at least twice."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    code = ids[:n]
    for k in range(1, width):  # renumbered at each step, so that codes stay exact
        if k > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = code * n_ids + ids[k:k + n]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def _measured(schema: pa.Schema, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [measure(t) for t in b.column(text_at).to_pylist()]
            cols = np.array(got, np.int64).reshape(-1, len(MEASURES))
            kept = [b.column(i) for i in range(b.num_columns) if i != text_at]
            names = [b.schema.names[i] for i in range(b.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c) for c in cols.T)], names=[*names, *MEASURES])
    return run


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
           with_text: bool = False) -> DataFrame:
    """Carried columns, the measurements and ``fail_bits``, one row per document row."""
    ship_package(docs.sparkSession)
    keep = tuple(c for c in keep if c not in (*MEASURES, "fail_bits"))
    body = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))
    if with_text:
        body = body.withColumn("__kept", F.col("__text"))
    fields = [f for f in body.schema.fields if f.name != "__text"]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{m} long" for m in MEASURES])
    out = body.mapInArrow(_measured(None, body.columns.index("__text")), ddl)
    return out.withColumn("fail_bits", fail_bits())


def fail_bits() -> Column:
    """One bit per rule, set where it fails."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits + F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long")
    return bits


def passes(policy: Policy) -> Column:
    """True where no rule of the policy fails, from the ledger's bits alone."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents it fails, and those only it fails (kept without it)."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    used = [r for r in RULES if r.name in policy.rules]
    if not used:
        return rows.sparkSession.createDataFrame([], "rule string, n_failed long, n_only long, n_docs long")
    aggs = [F.count(F.lit(1)).alias("n_docs")]
    for r in used:
        one = F.lit(1 << r.bit)
        aggs += [F.count_if(bits.bitwiseAND(one) != 0).alias(f"f{r.bit}"), F.count_if(bits == one).alias(f"o{r.bit}")]
    one_row = rows.agg(*aggs)
    items = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"),
                               F.col(f"o{r.bit}").alias("n_only"), F.col("n_docs")) for r in used])
    return one_row.select(F.inline(items))


def keep_documents(docs: DataFrame, policy: Policy, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with its columns, that the policy keeps; measured in one pass."""
    others = tuple(c for c in docs.columns if c != text_col)
    clash = {c: f"__c{i}" for i, c in enumerate(others)}
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in clash.items()], F.col(f"`{text_col}`").alias("__t"))
    rows = ledger(named, "__t", tuple(clash.values()), with_text=True).where(passes(policy))
    back = {n: c for c, n in clash.items()} | {"__kept": text_col}
    order = {text_col: "__kept"} | clash
    return rows.select(*[F.col(order[c]).alias(back[order[c]]) for c in docs.columns])


__all__ = ["BASE", "MEASURES", "POLICIES", "PRODUCTION", "RULES", "Policy", "Rule", "ablations", "covered_by_repeats",
           "fail_bits", "keep_documents", "ledger", "measure", "passes"]
