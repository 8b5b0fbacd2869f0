"""Conversations: (conv_id, turn, role, text), a row for each message."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T


def from_transcripts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Messages of transcripts whose lines begin with `user:` or `assistant:`; other lines don't count."""
    lines = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("conv_id"), F.posexplode(F.split(F.regexp_replace(text_col, "\r", ""), "\n")).alias("p", "line"))
    said = lines.select("conv_id", "p", F.regexp_extract("line", "^(user|assistant): ", 1).alias("role"), F.regexp_replace("line", "^(user|assistant): ", "").alias("text")).where("role <> ''")
    return said.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("p")).alias("turn"), "role", "text")


def within_budget(messages: DataFrame, budget: int = 4000) -> DataFrame:
    """The latest messages of each conversation whose words together stay within the budget, up to the first that
    doesn't fit.  As words aren't negative, the running sum from the end decides it."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("used", F.sum(T.words(F.col("text"))).over(w)).where(F.col("used") <= budget).select("conv_id", "turn", "role", "used")


def split_for_prompt(messages: DataFrame, keep_turns: int = 4, summarise_turns: int = 6) -> DataFrame:
    """band `verbatim` for the last keep_turns turns (two messages each), `summary` for summarise_turns before them.
    A last pair of a user message and an assistant's `processing` doesn't count."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    m = messages.withColumns({"r": F.row_number().over(w), "_last": F.first(F.struct("role", F.lower(F.trim("text")).alias("text"))).over(w), "_before": F.nth_value("role", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    pending = (F.col("_last.role") == "assistant") & (F.col("_last.text") == "processing") & (F.col("_before") == "user")
    m = m.withColumn("r", F.col("r") - F.when(pending, 2).otherwise(0)).where("r > 0")
    band = F.when(F.col("r") <= 2 * keep_turns, "verbatim").when(F.col("r") <= 2 * (keep_turns + summarise_turns), "summary")
    return m.withColumn("band", band).where("band is not null").select("conv_id", "turn", "role", "band")


def rollover_chunks(messages: DataFrame, turns: int) -> DataFrame:
    """(conv_id, chunk, first_turn, last_turn), in numbers of messages: a chunk ends after `turns` turns of two messages,
    counted from 0 again for each chunk; each but the first begins with the last completed turn of the one before.
    A chunk that holds nothing but that turn isn't begun yet."""
    size = 2 * turns
    n = messages.groupBy("conv_id").agg(F.max("turn").alias("n"))
    at = n.select("conv_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("chunk"))
    return at.select("conv_id", "chunk", F.greatest(F.lit(1), F.col("chunk") * size - 1).alias("first_turn"), F.least((F.col("chunk") + 1) * size, F.col("n")).cast("int").alias("last_turn"))


def token_rollover(messages: DataFrame, limit: int = 4000) -> DataFrame:
    """(conv_id, turn, chunk): a chunk ends with the message by which a quarter of its characters, rounded down once,
    reaches the limit; the next one counts anew.  A conversation is one group by nature; only lengths are gathered."""
    g = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce(F.length("text"), F.lit(0)).alias("n")))).alias("m"))
    zero = F.struct(F.lit(0).cast("bigint").alias("chars"), F.lit(0).alias("chunk"), F.array().cast("array<struct<turn:int,chunk:int>>").alias("out"))

    def step(acc, x):
        over = F.floor(acc["chars"] / 4) >= limit
        chunk = acc["chunk"] + over.cast("int")
        chars = F.when(over, F.lit(0)).otherwise(acc["chars"]) + x["n"]
        return F.struct(chars.cast("bigint").alias("chars"), chunk.alias("chunk"), F.concat(acc["out"], F.array(F.struct(x["turn"].alias("turn"), chunk.alias("chunk")))).alias("out"))

    return g.select("conv_id", F.explode(F.aggregate("m", zero, step, lambda a: a["out"])).alias("r")).select("conv_id", "r.turn", "r.chunk")


HEADER = "Summarize the following conversation in a few sentences:\n\n"  # fixed value


def summary_prompt(messages: DataFrame, budget: int | None, header: str = HEADER) -> DataFrame:
    """(conv_id, prompt, kept): the header and lines `role: text` within a budget of words, from the newest back to the
    first that doesn't fit; a line takes one more for its break.  The newest line always stays: clipped to what is left,
    with an ellipsis, or its role alone where nothing is.  Without a budget all lines stay."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    m = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), line.alias("line"))
    if budget is not None and budget > 0:
        left = budget - len(header.split())
        w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
        m = m.withColumns({"r": F.row_number().over(w), "w": F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")})
        room = F.lit(left - 2)  # the break and the role
        clipped = F.when(room <= 0, F.concat("role", F.lit(":"))).otherwise(F.concat(F.col("role"), F.lit(": "), F.array_join(F.slice("w", F.lit(1), F.greatest(F.lit(1), room)), " "), F.lit("…")))
        first = (F.col("r") == 1) & (T.words(F.col("line")) + 1 > left)
        m = m.withColumn("line", F.when(first, clipped).otherwise(F.col("line")))
        used = F.sum(T.words(F.col("line")) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
        m = m.withColumn("used", used).where((F.col("r") == 1) | (F.col("used") <= left))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("a"))
    return g.select("conv_id", F.concat(F.lit(header), F.array_join(F.transform("a", lambda x: x["line"]), "\n")).alias("prompt"), F.size("a").alias("kept"))


def history_key(messages: DataFrame) -> DataFrame:
    """(conv_id, key): a hash of the whole conversation, to know a summary by.  A conversation is one group by nature."""
    line = F.concat_ws("\u001f", "role", "text")
    g = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("a"))
    return g.select("conv_id", F.sha1(F.array_join(F.transform("a", lambda x: x["l"]), "\u001e")).alias("key"))
