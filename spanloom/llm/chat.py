"""Chat formatting by prefix-target expansion (operator 8; DataFrame functions only).

Every assistant turn becomes one training example: all turns before it are context, and only its text is
trainable.  The examples are rows of their own with their contexts written out (`expanded`; `full_examples` those
with a target), so the output grows with the square of a conversation's turns; the query's results are read
back from these rows.  `pieces` gives the same examples without repetition: example k is the concatenation of
pieces 1 to k.  Turns after the last assistant turn form a last piece without a target.

Template: ``<|turn|>role<|text|>text<|end|>``, one after the other.  In roles and texts ``<|`` is written
``<\\|`` and any ``<\\..\\|`` gets one backslash more, so markers never occur inside a text and reading back
removes exactly what writing added.

Defined results: a null text or role is empty; turns are ordered by turn (null first), then role, then text, so
ties and repeated rows have one result; all rows with a null conv_id are one conversation.  Texts and conversations of any
length are taken whole; an empty table gives none.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def formatted(conversations: DataFrame) -> DataFrame:
    """``conv_id, pieces``: an array of (text, loss_start, loss_end, target) in order; loss bounds are code points
    within the piece, null where nothing is trainable."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", role.alias("role"), text.alias("text"))
    convs = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT))
    lines = F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("target"), head(t).alias("head"), escaped(t["text"]).alias("text")))
    convs = convs.select("conv_id", lines.alias("lines"))
    targets = F.filter(F.transform("lines", lambda x, i: F.when(x["target"], i + 1)), lambda i: i.isNotNull())
    ends = F.when(F.element_at("lines", -1)["target"], targets).otherwise(F.concat(targets, F.array(F.size("lines"))))
    convs = convs.withColumn("ends", ends)

    def piece(end: Column, k: Column) -> Column:
        begin = F.when(k == 0, 0).otherwise(F.get("ends", k - 1))
        line = F.element_at("lines", end)
        before = F.array_join(F.transform(F.slice("lines", begin + 1, end - begin - 1), lambda x: F.concat(x["head"], x["text"], F.lit(END))), "")
        start = F.length(before) + F.length(line["head"])
        return F.struct(F.concat(before, line["head"], line["text"], F.lit(END)).alias("text"), F.when(line["target"], start).alias("loss_start"), F.when(line["target"], start + F.length(line["text"])).alias("loss_end"), line["target"].alias("target"))

    return convs.select("conv_id", F.transform("ends", piece).alias("pieces"))


def pieces(conversations: DataFrame) -> DataFrame:
    """One row per example (and last piece): ``conv_id, example, piece, loss_start, loss_end, target``."""
    rows = formatted(conversations).select("conv_id", F.posexplode("pieces").alias("example", "p"))
    return rows.select("conv_id", "example", F.col("p.text").alias("piece"), "p.loss_start", "p.loss_end", "p.target")


def expanded(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn, its whole context before it, and one without target (null loss bounds) for turns after
    the last assistant turn: ``conv_id, example, text, loss_start, loss_end, target``.  Each row is a text of its own."""
    rows = formatted(conversations).select("conv_id", F.posexplode("pieces").alias("example", "p"), "pieces")
    before = F.array_join(F.transform(F.slice("pieces", F.lit(1), F.col("example")), lambda p: p["text"]), "")
    return rows.select("conv_id", "example", F.concat(before, "p.text").alias("text"), (F.length(before) + F.col("p.loss_start")).alias("loss_start"), (F.length(before) + F.col("p.loss_end")).alias("loss_end"), F.col("p.target").alias("target"))


def full_examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, example, text, loss_start, loss_end``, the whole context written out."""
    return expanded(conversations).where("target").drop("target")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the examples.

    Each example gives its masked reply; the turns, and the length of the conversation's text, are those of the last.
    The examples stay where their conversation was gathered: they are not shuffled.
    """
    examples = expanded(conversations)
    reply = F.when(F.col("target"), unescaped(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    rows = examples.select("conv_id", "example", "text", reply.alias("reply"))
    rows = rows.groupBy("conv_id").agg(F.max_by("text", "example").alias("whole"), F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"))
    parts = F.filter(F.split("whole", r"<\|end\|>", -1), lambda x: x != "")
    cut = lambda x: F.split(F.substring(x, len(TURN) + 1, 1 << 30), r"<\|text\|>", 2)
    told = F.array_join(F.transform(parts, lambda x: F.concat(unescaped(cut(x)[0]), F.lit("\n"), unescaped(cut(x)[1]), F.lit("\n"))), "")
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    rows = rows.select("conv_id", F.size(parts).cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), loss.alias("loss"), F.length("whole").cast("bigint").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
