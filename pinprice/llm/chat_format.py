"""Chat formatting by schema fingerprint (DataFrame functions only).

Records of unlike layouts (message lists, prompt/response pairs, instruction
sets, one row per turn) arrive as VARIANT values. The nested field paths of
each record are hashed to a fingerprint, the fingerprint selects a declarative
mapping, and the mapping gives canonical turns (position, role, text). Turns
are written in one template whose control strings are escaped inside texts,
with the loss mask as code-point spans of the assistant texts; ``read_back``
recovers turns and masked text from the output alone.

Defined results: a null role or text is empty; turns of a conversation are
ordered by position (null last), then role, then text, so ties and repeated
rows have one order and all are kept; a null id is a conversation of its own;
an empty table gives no rows; records of an unknown layout have a null
``layout`` and no turns (``unmapped`` returns them, nothing is dropped
silently); columns beyond the named ones are ignored. One conversation is one
training record, so its turns meet in one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Template and control strings.
BOS, EOS, TURN, END = "<s>", "</s>", "[TURN]", "[/TURN]"
CONTROL = (BOS, EOS, TURN, END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_OPEN = {"[": "(", "<": "{"}


@dataclass(frozen=True)
class Layout:
    """A mapping from one record shape to turns.

    ``shape`` lists the nested field paths (``a``, ``a[].b``). ``items`` names a
    list of turns with its role and text fields; otherwise ``turns`` gives
    (role, paths) pairs whose texts are joined by a blank line, or (None, role
    path, text path) with ``order`` for a table with one row per turn.
    """

    name: str
    shape: tuple[str, ...]
    items: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)


_GPT = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Layout("turn_rows", ("role", "text", "turn"), row=("turn", "role", "text")),
    Layout("messages", ("messages", "messages[].content", "messages[].role"),
           items=("messages", "role", "content")),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"),
           items=("conversations", "from", "value"), roles=_GPT),
    Layout("prompt_response", ("prompt", "response"),
           turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("completion", "prompt"),
           turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system_prompt_response", ("prompt", "response", "system"),
           turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"),
           turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", ("input", "instruction", "output"),
           turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def shape_of(record: Column) -> Column:
    """Field names and nesting of a variant without its scalar types.

    ``schema_of_variant`` writes objects with sorted keys and the union of the
    keys of a list's elements, so equal layouts give equal text.
    """
    s = F.schema_of_variant(record)
    return F.regexp_replace(s, r": (?!ARRAY<|OBJECT<)[A-Z][A-Z0-9_]*(\(\d+,\s?\d+\))?(?=[,>])", "")


def fingerprint(record: Column) -> Column:
    """64-bit hash of the nested field paths of a record."""
    return F.xxhash64(shape_of(record))


def _shape_text(paths: tuple[str, ...]) -> str:
    """The text ``shape_of`` gives for a layout's field paths."""
    tree: dict = {}
    for p in sorted(paths):
        head, _, tail = p.partition("[].")
        tree.setdefault(head, [])
        if tail:
            tree[head].append(tail)
    parts = [f"{k}: ARRAY<OBJECT<{', '.join(sorted(v))}>>" if v else k for k, v in sorted(tree.items())]
    return f"OBJECT<{', '.join(parts)}>"


def _text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit(""))


def _turns(layout: Layout, record: Column) -> Column:
    """array<struct<pos, role, text>> of a record of this layout."""
    def turn(pos: Column, role: Column, text: Column) -> Column:
        return F.struct(pos.cast("long").alias("pos"), role.alias("role"), text.alias("text"))

    def named(role: Column) -> Column:
        out = role
        for k, v in layout.roles.items():
            out = F.when(role == k, v).otherwise(out)
        return F.coalesce(out, F.lit(""))

    if layout.row:
        order, role, text = layout.row
        return F.array(turn(F.try_variant_get(record, f"$.{order}", "long"),
                            named(_text(record, role)), _text(record, text)))
    if layout.items:
        path, role, text = layout.items
        items = F.try_variant_get(record, f"$.{path}", f"array<struct<`{role}` string, `{text}` string>>")
        return F.transform(items, lambda x, i: turn(i, named(x[role]), F.coalesce(x[text], F.lit(""))))
    out = []
    for i, (role, paths) in enumerate(layout.turns):
        parts = [F.when(_text(record, p) != "", _text(record, p)) for p in paths]
        out.append(turn(F.lit(i), F.lit(role), F.concat_ws("\n\n", *parts)))
    return F.array(*out)


def canonical_turns(records: DataFrame, id_col: str, record_col: str,
                    layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Rows (id, layout, turn struct) of every record; unknown layouts give one row, turn null."""
    marked = records.select(F.col(id_col).alias("id"), F.col(record_col).alias("rec"),
                            fingerprint(F.col(record_col)).alias("fp"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<pos:bigint,role:string,text:string>>")
    for lay in reversed(layouts):
        hit = F.col("fp") == F.xxhash64(F.lit(_shape_text(lay.shape)))
        layout = F.when(hit, lay.name).otherwise(layout)
        turns = F.when(hit, _turns(lay, F.col("rec"))).otherwise(turns)
    rows = marked.select("id", layout.alias("layout"), turns.alias("turns"))
    return rows.select("id", "layout", F.explode_outer("turns").alias("turn"))


def unmapped(records: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The records whose fingerprint selects no mapping, with that fingerprint."""
    known = [F.xxhash64(F.lit(_shape_text(lay.shape))) for lay in layouts]
    fp = F.coalesce(fingerprint(F.col(record_col)), F.lit(0))
    return records.withColumn("fingerprint", fp).where(~F.col("fingerprint").isin(*known))


def escape(text: Column) -> Column:
    """Break every control string in a text; ``unescape`` is its inverse."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit("\\" + _OPEN[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for plain, code in _OPEN.items():
        out = F.replace(out, F.lit("\\" + code), F.lit(plain))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """id, formatted text and loss mask (code-point spans [start, end)) per conversation.

    ``turns``: id, pos, role, text. The running offset and the grouping share
    one exchange on id.
    """
    clean = turns.select("id", "pos", F.coalesce("role", F.lit("")).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    pieces = clean.select("id", "pos", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    order = W.partitionBy("id").orderBy(F.col("pos").asc_nulls_last(), "role", "text")
    size = F.length("head") + F.length("body") + len(END)
    placed = pieces.select(
        "id", F.row_number().over(order).alias("i"), "role", "head", "body",
        F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("stop"))
    placed = placed.select(
        "id", F.struct(
            "i", F.concat("head", "body", F.lit(END)).alias("piece"),
            F.when(F.col("role") == learn_role, F.struct(
                (F.col("stop") - len(END) - F.length("body") + len(BOS)).alias("start"),
                (F.col("stop") - len(END) + len(BOS)).alias("end"))).alias("span")).alias("p"))
    grouped = placed.groupBy("id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    spans = F.filter(F.transform("ps", lambda p: p["span"]), lambda s: s.isNotNull())
    return grouped.select(
        "id",
        F.concat(F.lit(BOS), F.array_join(F.transform("ps", lambda p: p["piece"]), ""), F.lit(EOS)).alias("formatted"),
        spans.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (role, text) and the unescaped masked texts, from the formatted output alone."""
    inner = F.expr(f"substring(formatted, {len(BOS) + 1}, length(formatted) - {len(BOS) + len(EOS)})")
    parts = F.filter(F.split(inner, r"\[/?TURN\]"), lambda x: x != "")
    turns = F.transform(parts, lambda x: F.struct(
        unescape(F.replace(F.substring_index(x, "\n", 1), F.lit("\\n"), F.lit("\n"))).alias("role"),
        unescape(F.substring(x, F.locate("\n", x) + 1, F.length(x))).alias("text")))
    learned = F.transform("loss_mask", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("id", "formatted", "loss_mask", turns.alias("turns"), learned.alias("learned"))


__all__ = ["CONTROL", "LAYOUTS", "Layout", "canonical_turns", "escape", "fingerprint", "format_conversations",
           "read_back", "shape_of", "unescape", "unmapped"]
