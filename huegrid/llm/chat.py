"""Chat formatting: conversations to training text with a loss flag per segment, in DataFrame functions alone.

A template is declared as data: what opens and closes a turn, which roles are learned, and which role may follow which
(a finite-state machine over roles; the state is the last role, from ``start``). Texts and role names are escaped so
that they hold no character of the markup, and unescaping returns them exactly: with the default template the backslash
becomes ``\\b``, ``<`` becomes ``\\l``, ``#`` becomes ``\\h`` and ``:`` in role names ``\\c``.

The rows of a conversation are first gathered by blocks of turns and then by conversation, so that the last grouping of a
very long conversation reads a few rows and not one for each turn. A conversation is one value of the result and must
fit in memory.

Defined results: rows go by turn (nulls first), then role, then text; null role and null text are empty; repeated rows
are repeated turns; a null conv_id is a conversation of its own; ``valid`` is false where the order of roles breaks the
machine, and such conversations are still formatted whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huegrid.llm.common import table

BLOCK = 64


@dataclass(frozen=True)
class Template:
    open: str = "### "  # before the role
    mid: str = ": "  # between role and text
    close: str = "</turn>\n"
    learned: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    ends: tuple[str, ...] = ("assistant", "user")
    #: Escapes in the order of escaping; the first one is the escape character itself.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
    role_escapes: tuple[tuple[str, str], ...] = ((":", "\\c"),)

    def escape(self, text: Column, role: bool = False) -> Column:
        for plain, safe in self.escapes + (self.role_escapes if role else ()):
            text = F.replace(text, F.lit(plain), F.lit(safe))
        return text

    def unescape(self, text: Column, role: bool = False) -> Column:
        for plain, safe in reversed(self.escapes + (self.role_escapes if role else ())):
            text = F.replace(text, F.lit(safe), F.lit(plain))
        return text


def conversations_formatted(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, valid, segments array<struct<text, loss>> and formatted (the segments' texts joined) per conversation."""
    t = template or Template()
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    block = F.floor(F.col("turn") / BLOCK)
    parts = rows.select("conv_id", block.alias("block"), turn.alias("t")).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "turns"))).alias("blocks"))
    whole = whole.select("conv_id", F.flatten(F.transform("blocks", lambda b: b["turns"])).alias("turns"))
    learned = lambda x: x["role"].isin(*t.learned) if t.learned else F.lit(False)
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                segment(F.concat(F.lit(t.open), t.escape(x["role"], role=True), F.lit(t.mid)), F.lit(False)),
                segment(t.escape(x["text"]), learned(x)),
                segment(F.lit(t.close), F.lit(False)),
            ),
        )
    )
    moves = F.array(*(F.lit(f"{a}>{b}") for a, after in t.follows.items() for b in after))
    state = F.aggregate(
        "turns",
        F.lit("start"),
        lambda s, x: F.when(F.array_contains(moves, F.concat(s, F.lit(">"), x["role"])), x["role"]).otherwise(F.lit("broken")),
    )
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        state.isin(*t.ends).alias("valid"),
        segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _read_columns(t: Template) -> tuple[Column, Column]:
    """The turns that ``formatted`` holds, and the texts of the segments under the loss mask, both unescaped."""
    turns = F.filter(F.split("formatted", _quoted(t.close)), lambda x: x != "")
    parsed = F.transform(
        turns,
        lambda x: F.struct(
            t.unescape(_between(x, len(t.open), t.mid), role=True).alias("role"),
            t.unescape(_after(x, t.mid)).alias("text"),
        ),
    )
    return parsed, F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"]))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turns array<struct<role, text>> read from ``formatted``, and learned array<string> read from ``segments``."""
    turns, learned = _read_columns(template or Template())
    return formatted.select("conv_id", turns.alias("turns"), learned.alias("learned"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def _between(text: Column, start: int, mark: str) -> Column:
    """What stands between the first ``start`` characters and the first mark, which no escaped role holds."""
    return F.substring(text, F.lit(start + 1), F.position(F.lit(mark), text) - F.lit(start + 1))


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark."""
    return F.substring(text, F.position(F.lit(mark), text) + F.lit(len(mark)), F.length(text))


def op5_chat_formatting(spark, sf_dir) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(own).alias("text"),
    )
    out = conversations_formatted(rows.union(extra))
    turns, learned = _read_columns(Template())
    said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(learned, "")
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
