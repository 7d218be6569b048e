"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it are context, and
its reply alone is trainable. Turns after the last reply get one example without a target,
so that nothing of a conversation is lost. The template marks a turn as

    ### role: text </turn>

with a line feed at the end. In roles and texts the characters that the marks need are
written as two: a backslash as ``\\b``, ``#`` as ``\\h``, ``<`` as ``\\l``, and in roles ``:`` as
``\\c``. No mark can then come from a text, and reading back gives the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, AFTER_ROLE, END = "### ", ": ", " </turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, escapes=ESCAPES) -> Column:
    for plain, written in escapes:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, escapes=ESCAPES) -> Column:
    # The backslash comes last: before that, each one in the text begins a written pair.
    for plain, written in reversed(escapes):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, example, n_turns, text, loss_start, loss_end, last): the examples of conversations.

    ``conversations`` needs conv_id, turn, role and text; other columns are not read. Turns
    are ordered by turn, then role, then text. ``text`` is the formatted example and
    text[loss_start:loss_end], in code points, the part that is trained on; both are null
    for an example without target. ``last`` marks the example that holds the whole
    conversation. Defined cases: null role or text is empty; null turns come first; each row
    without conv_id is a conversation of its own, told apart by ``part``, which is 0 for all
    others; repeated rows are turns of their own; roles are
    compared as they stand, so only ``assistant`` is a target; an empty table gives none.

    The turns of a conversation meet in one row, combined on the map side first; examples
    are made from that row without another shuffle.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    part = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)).alias("part")
    whole = conversations.select("conv_id", part, turn.alias("turn")).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(F.lit(BEGIN), escape(t["role"], ROLE_ESCAPES), F.lit(AFTER_ROLE), escape(t["text"]), F.lit(END)))
    count = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), count), lambda k: F.element_at("turns", k)["role"] == "assistant")
    tail = F.when(F.element_at("turns", -1)["role"] == "assistant", F.array().cast("array<int>")).otherwise(F.array(count))
    whole = whole.select("conv_id", "part", written.alias("written"), F.transform("turns", lambda t: t["role"] == "assistant").alias("is_reply"), F.concat(replies, tail).alias("ends"))
    one = whole.select("conv_id", "part", "written", "is_reply", F.posexplode("ends").alias("example", "n_turns"))
    text = F.array_join(F.slice("written", 1, F.col("n_turns")), "")
    one = one.select("conv_id", "part", "example", "n_turns", text.alias("text"), F.element_at("written", F.col("n_turns")).alias("target"), F.element_at("is_reply", F.col("n_turns")).alias("trained"), (F.col("n_turns") == F.size("written")).alias("last"))
    end = F.length("text") - len(END)
    start = F.length("text") - F.length("target") + len(BEGIN + "assistant" + AFTER_ROLE)
    return one.select("conv_id", "part", "example", "n_turns", "text", F.when(F.col("trained"), start).alias("loss_start"), F.when(F.col("trained"), end).alias("loss_end"), "last")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.filter(F.split(text, F.lit(END)), lambda p: p != "")

    def turn(part: Column) -> Column:
        head = F.substring_index(part, AFTER_ROLE, 1)
        body = F.substring(part, F.length(head) + len(AFTER_ROLE) + 1, F.length(part))
        return F.struct(unescape(F.substring(head, F.lit(len(BEGIN) + 1), F.length(head)), ROLE_ESCAPES).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def digest_examples(examples: DataFrame) -> DataFrame:
    """What training would see of each conversation, read back from its formatted examples."""
    trained = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    turns = F.when(F.col("last"), read_turns(F.col("text")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = examples.select("conv_id", "part", "example", F.length("text").cast("long").alias("chars"), F.coalesce(trained, F.lit("")).alias("trained"), turns.alias("turns"))
    each = each.select("conv_id", "part", "example", "chars", "trained", F.size("turns").cast("long").alias("n"), F.sha2(said, 256).alias("said"))
    by_conv = each.groupBy("conv_id", "part").agg(F.max("n").alias("n_turns"), F.max("said").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("example", "trained"))).alias("trained"))
    loss = F.array_join(F.col("trained")["trained"], "")
    return by_conv.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
