"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<s>[INST]role[/INST]\\n`` text ``</s>\\n`` for each turn. A deterministic parser reads the
rendered text back; where the recovered turns differ from the source, the conflicting content (control strings, or what looks
like an escaped one) is escaped by one backslash after its first character and the result parsed again. A text escaped once
holds no control string and unescapes to itself, so the second reading is identical; ``identical`` tells it for each row.

Null role or text counts as empty; turns go by (turn, role, text), nulls first, and repeated rows stay, side by side;
very long and empty texts have no special case; a null conv_id is a conversation of its own; extra columns are ignored.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.columns import let, sums_before

#: The control strings of the template.
TURN, MID, END = "<s>[INST]", "[/INST]\n", "</s>\n"
CONTROL = r"</?s>|\[/?INST\]"
#: A control string with any number of backslashes after its first character.
PLAIN = r"(<(?=\\*/?s>)|\[(?=\\*/?INST\]))"
ESCAPED = r"(?:(<)\\(?=\\*/?s>)|(\[)\\(?=\\*/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def render(turns: Column, escaped: bool) -> Column:
    """The text of an array of (role, text)."""
    held = escape if escaped else (lambda c: c)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), held(t["role"]), F.lit(MID), held(t["text"]), F.lit(END))), "")


def parse(text: Column) -> Column:
    """The turns of a rendered text: an array of (role, text, length of the text as rendered); null if it breaks the grammar."""
    parts = F.split(text, END, -1)
    form = r"(?s)^<s>\[INST\](.*?)\[/INST\]\n(.*)$"
    body = F.slice(parts, 1, F.size(parts) - 1)
    strict = F.forall(body, lambda p: p.rlike(form) & ~F.regexp_extract(p, form, 1).rlike(CONTROL) & ~F.regexp_extract(p, form, 2).rlike(CONTROL)) & (F.element_at(parts, -1) == "")
    turns = F.transform(
        body,
        lambda p: F.struct(unescape(F.regexp_extract(p, form, 1)).alias("role"), unescape(F.regexp_extract(p, form, 2)).alias("text"), F.length(F.regexp_extract(p, form, 1)).alias("head"), F.length(F.regexp_extract(p, form, 2)).alias("width")),
    )
    return F.when(strict, turns)


def _same(recovered: Column, source: Column) -> Column:
    pair = lambda a: F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce(pair(recovered) == pair(source), F.lit(False))


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (recovered), loss_spans (start and length in code points of the
    assistant texts inside ``formatted``), escaped, identical."""
    rows = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("source"))
    held = held.withColumn("plain", render(F.col("source"), False))
    held = held.withColumn("fine", _same(parse(F.col("plain")), F.col("source")))
    held = held.withColumn("formatted", F.when(F.col("fine"), F.col("plain")).otherwise(render(F.col("source"), True)))
    held = held.withColumn("turns", parse(F.col("formatted")))
    widths = F.transform("turns", lambda t: t["head"] + t["width"] + len(TURN) + len(MID) + len(END))

    def loss(t: Column, before: Column) -> Column:
        start = before + len(TURN) + len(MID) + t["head"]
        return F.when(t["role"] == "assistant", F.struct(start.cast("long").alias("start"), t["width"].cast("long").alias("length")))

    spans = let(sums_before(widths), lambda before: F.filter(F.transform("turns", lambda t, k: loss(t, F.get(before, k))), lambda s: s.isNotNull()))
    return held.select("conv_id", "formatted", "turns", spans.alias("loss_spans"), (~F.col("fine")).alias("escaped"), _same(F.col("turns"), F.col("source")).alias("identical"))


def digests(formatted: DataFrame) -> DataFrame:
    """The query's columns, all read back from ``formatted``."""
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    told = formatted.withColumn("masked", masked)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "escaped", "identical",
    )


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all conversations, and one that says control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_conversations(rows.unionByName(own)))


CHAT_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, regexp_matches(role || ' ' || text, '<\\\\*/?s>|\\[\\\\*/?INST\\]') AS hit,
    length(regexp_replace(text, '(<|\\[)(\\\\*(?:/?s>|/?INST\\]))', '\\1\\\\\\2', 'g')) + length(role) + 22 AS width
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(width)::BIGINT AS formatted_chars, bool_or(hit) AS escaped, true AS identical
FROM marked GROUP BY conv_id
"""
