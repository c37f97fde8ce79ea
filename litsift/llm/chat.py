"""Chat formatting of typed content parts, in DataFrame functions only.

A message is a list of parts (kind, text, ref, units). A visitor flattens them in order: text is escaped, an image, audio
or document part becomes a placeholder and an attachment reference with its expanded token count. Turns are framed by
control strings, which all begin with "<|"; every "<" of a text is written "<~" and read back as "<". So no text has a
control string, and neither have any texts side by side, however a message is cut into parts.

Edge cases: a null text is an empty one, a null role an empty role, a null or empty list of parts an empty turn; parts of
another kind count as text; turns with equal numbers are ordered by role, then body; a null turn stands first; a null
conv_id is a conversation of its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a placeholder expands to for each unit: image tiles, audio seconds, document pages.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PLACEHOLDER = "<\\|(?:" + "|".join(UNIT_TOKENS) + ")\\|>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("<~"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<~"), F.lit("<"))


def escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def text_parts(text: Column) -> Column:
    """One text part, for tables that have plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def attached(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*UNIT_TOKENS), F.lit(False))


def tokens(part: Column) -> Column:
    each = F.create_map(*(F.lit(x) for kv in UNIT_TOKENS.items() for x in kv))
    return (F.coalesce(part["units"], F.lit(1)) * each[part["kind"]]).cast("long")


def format_chat(messages: DataFrame) -> DataFrame:
    """From rows (conv_id, turn, role, parts): conv_id, formatted, attachments (ref, kind, n_tokens in order) and n_attachment_tokens."""
    parts = F.coalesce(F.col("parts"), F.filter(text_parts(F.lit("")), lambda p: F.lit(False)))
    body = F.array_join(F.transform(parts, lambda p: F.when(attached(p), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))), "")
    refs = F.transform(F.filter(parts, attached), lambda p: F.struct(p["ref"].alias("ref"), p["kind"].alias("kind"), tokens(p).alias("n_tokens")))
    rows = messages.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), body.alias("body"), refs.alias("refs")).alias("m"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    framed = F.transform("ms", lambda m: F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n"), m["body"], F.lit(END + "\n")))
    out = turns.select("conv_id", F.array_join(framed, "").alias("formatted"), F.flatten(F.transform("ms", lambda m: m["refs"])).alias("attachments"))
    return out.withColumn("n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, r: a + r["n_tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), placeholders left out, everything unescaped."""
    pieces = F.filter(F.split(formatted, "<\\|im_start\\|>", -1), lambda x, i: i > 0)
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.regexp_replace(F.regexp_extract(x, "(?s)^[^\n]*\n(.*)<\\|im_end\\|>\n$", 1), PLACEHOLDER, "")).alias("text"),
        ),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text holds, read back from it; the loss mask covers the assistant's texts."""
    turns = formatted.withColumn("turns", read_turns(F.col("formatted")))
    said = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"), F.sha2(said.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB SQL for digest() over the conversations table and conversation -1.
SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, replace(text, '<', '<~') AS body, replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') AS head FROM m
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, body), '')) AS loss_sha256,
  CAST(sum(12 + length(head) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
