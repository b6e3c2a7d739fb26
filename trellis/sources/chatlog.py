"""Chat logs as dated markdown (S10, S11) and chat turns from ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

ENTRY_SEPARATOR = "---\n\n"
QUESTION_PATTERN = r"\*\*Question:\*\* ([^\n]+)"


def chat_entries(conversations: DataFrame) -> DataFrame:
    """Question/answer turns as dated chat entries
    ``(chat_date, ts, question, answer, conv_id, q_turn)``; the date and time
    are derived from the conversation id and turn."""
    u = conversations.filter(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("q_turn"), F.col("text").alias("question"))
    a = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("q_turn"), F.col("text").alias("answer"))
    p = u.join(a, ["conv_id", "q_turn"])
    return p.select(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"),
                                 (F.col("conv_id") % 28).cast("int")), "yyyy-MM-dd")
        .alias("chat_date"),
        F.format_string("%02d:%02d:%02d UTC", (F.col("conv_id") % 24).cast("int"),
                        (F.col("q_turn") % 60).cast("int"),
                        ((F.col("conv_id") / 24) % 60).cast("int")).alias("ts"),
        "question", "answer", "conv_id", "q_turn")


def append_chat(entries: DataFrame, path: str) -> None:
    """Append entries to per-date folders (``chat_date=YYYY-MM-DD``),
    each entry written as ``## ts``, the question line, the answer and a
    ``---`` separator.  Appends add files; nothing is rewritten."""
    text = F.concat(F.lit("## "), F.col("ts"), F.lit("\n\n**Question:** "), F.col("question"),
                    F.lit("\n\n"), F.col("answer"), F.lit("\n\n---\n"))
    entries.select("chat_date", text.alias("value")).write.mode("append") \
        .partitionBy("chat_date").text(path)


def read_chat_logs(spark: SparkSession, path: str) -> DataFrame:
    """Entries of every log file as ``(chat_date, file, block, pos,
    question, answer)``; the question is the rest of the ``**Question:**`` line
    and the answer everything after it, stripped.

    Records end at the entry separator, so a long file is split among tasks
    like any line file and no row holds more than one entry.  ``block`` is the
    byte at which a split of the file starts and ``pos`` rises inside a split:
    by (file, block, pos) the entries stand as written."""
    ent = (spark.read.option("lineSep", ENTRY_SEPARATOR).text(path)
           .select(F.col("chat_date").cast("string").alias("chat_date"),
                   F.col("_metadata.file_name").alias("file"),
                   F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("pos"), F.col("value").alias("entry")))
    q = F.regexp_extract("entry", QUESTION_PATTERN, 1)
    after = F.regexp_extract("entry", r"\*\*Question:\*\* [^\n]+([\s\S]*)$", 1)
    strip = F.regexp_replace(after, r"(?U)^\s+|\s+$", "")
    return (ent.filter(F.col("entry").rlike(QUESTION_PATTERN))
            .select("chat_date", "file", "block", "pos",
                    F.regexp_replace(q, r"(?U)^\s+|\s+$", "").alias("question"),
                    strip.alias("answer"))
            .filter(F.col("answer") != ""))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
