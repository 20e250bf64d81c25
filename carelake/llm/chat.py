r"""Chat formatting from an event log, in DataFrame functions only.

``fold`` rebuilds the final messages of every conversation: the log is partitioned by
conversation and sorted by sequence; a ``message`` or ``edit`` sets a message's text, a
``regenerate`` empties it, a ``delta`` adds to it. ``render`` writes one string per
conversation and the spans of it that carry loss. ``read_back`` takes both apart again.

Template, per message: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Inside
texts and roles every ``<``, any number of backslashes, ``|`` gets one backslash more, so
no control string can appear there and taking one away restores the text exactly. In roles
``%`` and newline are first written ``%25`` and ``%0A``.

Defined results: null text is empty; null role is the empty role; rows without a
conversation id form one conversation with id null; a null sequence comes first; events
of equal sequence go by role, then text; repeated rows are events each for itself;
an empty log gives no conversations; columns not named in the arguments are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold(log: DataFrame, conv: str = "conv_id", message: str = "message", seq: str = "seq",
         kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, message, role, text): the final state of every message of an event log.

    ``message`` numbers the messages of a conversation and ``seq`` orders the events. The
    newest event that is not a delta decides where a message's text begins; what came
    before is not gathered. A message's role is that of its first remaining event."""
    events = log.select(
        F.col(conv).alias("conv_id"), F.col(message).alias("message"), F.col(seq).alias("seq"),
        F.coalesce(F.col(kind), F.lit("message")).alias("kind"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.struct(F.col("seq").isNotNull(), "seq", "role", "text")
    resets = (events.where("kind != 'delta'").groupBy("conv_id", "message")
              .agg(F.max(order).alias("since"))
              .select(F.col("conv_id").alias("_c"), F.col("message").alias("_m"), "since"))
    live = (events.join(resets, F.col("conv_id").eqNullSafe(F.col("_c"))
                        & F.col("message").eqNullSafe(F.col("_m")), "left")
            .where(F.col("since").isNull() | (order >= F.col("since"))))
    said = F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text"))
    parts = live.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(F.struct(
        F.col("seq").isNotNull().alias("dated"), "seq", "role", "text", said.alias("said")))).alias("parts"))
    return parts.select("conv_id", "message", F.get("parts", F.lit(0))["role"].alias("role"),
                        F.array_join(F.transform("parts", lambda p: p["said"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation of ``fold``'s messages.

    ``loss_spans`` are [begin, end) in code points of ``formatted``; each covers the
    escaped text of one message of ``loss_role``."""
    ranked = messages.select("conv_id", "message", "role", _role_out(F.col("role")).alias("head"),
                             escape(F.col("text")).alias("body"))
    ranked = ranked.withColumn(
        "piece", F.concat(F.lit(START), "head", F.lit("\n"), "body", F.lit(END)))
    line = Window.partitionBy("conv_id").orderBy(F.col("message").asc_nulls_first())
    before = F.coalesce(F.sum(F.length("piece")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = before + F.length(F.lit(START)) + F.length("head") + 1
    placed = ranked.withColumn("at", F.row_number().over(line)).withColumn("begin", begin)
    turns = F.sort_array(F.collect_list(F.struct(
        "at", "piece", "begin", (F.col("begin") + F.length("body")).alias("end"),
        (F.col("role") == loss_role).alias("loss"))))
    return placed.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]),
                    lambda t: F.struct(t["begin"].alias("begin"), t["end"].alias("end"))).alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns: array of (role, text), loss_text), from the output alone."""
    pieces = F.slice(F.split("formatted", F.lit(r"<\|im_start\|>")), 2, 1 << 30)
    turns = F.transform(pieces, lambda p: F.struct(
        _role_in(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1,
                          F.length(p) - F.instr(p, "\n") - F.lit(len(END)))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(
        F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")
    return rendered.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))
