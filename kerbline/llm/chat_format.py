"""Chat formatting with Spark expressions only: turns are sorted, runs of one role merged, and the text concatenated.

A run becomes `<|im_start|>role\\n text <|im_sep|> text <|im_end|>\\n` (without the blanks), so every turn can be read back.
Control strings in texts and roles are escaped with U+241B, itself escaped first. Null roles and texts count as
empty; turns of equal number are ordered by role and text; repeated rows are turns of their own; null conversation ids
form one conversation; an empty table gives an empty table; other columns are not looked at. A conversation is one row of
the result, so its whole text must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

START, SEP, END, ESC = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "␛"
#: Pieces whose lengths are added at a time.
BLOCK = 64
TRAP = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC), F.lit(ESC + "e")), F.lit("<|"), F.lit(ESC + "l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC + "l"), F.lit("<|")), F.lit(ESC + "e"), F.lit(ESC))


def role_in(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ESC + "n"))


def role_out(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESC + "n"), F.lit("\n")))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: code-point spans (start from 0, end exclusive) of the texts that count for the loss."""
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]),
    )
    with_starts = sorted_turns.select("conv_id", "turns", starts.alias("starts"))
    runs = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.transform(
                F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda t: escape(t["text"])
            ).alias("texts"),
        ),
    )
    merged = with_starts.select("conv_id", runs.alias("runs"))
    head = lambda r: F.concat(F.lit(START), role_in(r["role"]), F.lit("\n"))

    def of_run(r: Column) -> Column:
        """The texts of a run with what stands before each, and behind the last."""
        lead = lambda j: F.when(j == 0, head(r)).otherwise(F.lit(SEP))
        tail = lambda j: F.when(j == F.size(r["texts"]) - 1, F.lit(END + "\n")).otherwise(F.lit(""))
        return F.transform(r["texts"], lambda t, j: F.struct(F.concat(lead(j), t, tail(j)).alias("piece"), F.char_length(lead(j)).alias("lead"), F.char_length(t).alias("chars"), (r["role"] == loss_role).alias("counts")))

    pieces = merged.select("conv_id", F.flatten(F.transform("runs", of_run)).alias("pieces"))
    joined = pieces.select("conv_id", "pieces", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), F.transform("pieces", lambda p: F.char_length(p["piece"]).cast("long")).alias("steps"))
    # Where pieces start, by sums of blocks, so that a long conversation takes little more for each turn than a short one.
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda u, v: u + v)
    count = F.floor((F.size("steps") + BLOCK - 1) / BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), count - 1), lambda k: add(F.slice("steps", k * BLOCK + 1, F.lit(BLOCK))))
    summed = joined.select("conv_id", "pieces", "formatted", "steps", sums.alias("sums"))
    before = F.transform(F.sequence(F.lit(0), F.size("sums") - 1), lambda k: add(F.slice("sums", F.lit(1), k)))
    placed = summed.select("conv_id", "pieces", "formatted", "steps", before.alias("before"))

    def span(p: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = F.get("before", block) + add(F.slice("steps", block * BLOCK + 1, i - block * BLOCK)) + p["lead"]
        return F.struct(start.alias("start"), (start + p["chars"]).alias("end"), p["counts"].alias("counts"))

    spans = F.transform(F.filter(F.transform("pieces", span), lambda x: x["counts"]), lambda x: x.dropFields("counts"))
    return placed.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns as they were, in order."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        rest = F.substring(block, F.char_length(role) + 2, F.char_length(block) - F.char_length(role) - 2 - len(END))
        return F.transform(
            F.split(rest, r"<\|im_sep\|>", -1), lambda x: F.struct(role_out(role).alias("role"), unescape(x).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRAP).alias("text"),
    )
    return digests(format_chats(turns.unionByName(trap)))


def digests(chats: DataFrame) -> DataFrame:
    back = chats.select(
        "conv_id",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        read_back(F.col("formatted")).alias("turns"),
        F.array_join(
            F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), ""
        ).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql() -> str:
    e = f"replace(replace(t, '{ESC}', '{ESC}e'), '<|', '{ESC}l')"
    r = f"replace(replace(replace(r, '{ESC}', '{ESC}e'), '<|', '{ESC}l'), chr(10), '{ESC}n')"
    return f"""
WITH a AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{TRAP}' FROM range(2) x(i)
), b AS (
  SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum(length({e}) + CASE WHEN before IS NOT DISTINCT FROM r THEN {len(SEP)} ELSE {len(START)} + length({r}) + 1 END
    + CASE WHEN after IS NOT DISTINCT FROM r THEN 0 ELSE {len(END)} + 1 END)::BIGINT AS formatted_chars
FROM b GROUP BY conv_id"""


SQL = _sql()
