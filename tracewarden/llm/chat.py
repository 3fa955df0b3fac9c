"""Chat formatting with a grammar round trip, in DataFrame functions alone.

Template, one block per turn::

    ### role:
    text</turn>

A deterministic parser reads blocks back: it splits at the closing mark, takes the role up to the first unescaped colon
and undoes escapes (a backslash makes the next character literal). A body that still holds a mark is no sentence of the
grammar. Each turn is first rendered as it stands and parsed; where the turn recovered differs from its source, its
role and text are escaped and it is rendered again. The whole conversation is then parsed once more and compared; a
difference would be an error, not a result.

Defined results: null roles and texts count as empty; turns are ordered by turn (null first), then role, then text, so
repeated rows stay and ties are settled; a null conv_id is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"
#: What may not stand in a body: a backslash, the closing mark, the opening mark's three signs.
_TEXT_CONFLICT = r"\\|(?<=<)/(?=turn>)|(?<=#)#(?=#)"
_ROLE_CONFLICT = r"\\|:|(?<=<)/(?=turn>)|(?<=#)#(?=#)"
_BLOCK = r"(?s)\A### ((?:[^:\\]++|\\.)*+):\n(.*)\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def escape_text(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), _TEXT_CONFLICT, r"\\$0")


def escape_role(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), _ROLE_CONFLICT, r"\\$0")


def unescape(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?s)\\(.)", "$1")


def render_block(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), body, F.lit(CLOSE))


def parse_blocks(formatted: Column | str) -> Column:
    """array<struct<role, text>> of a rendered string; null members where a block isn't in the grammar."""
    blocks = F.split(_col(formatted), CLOSE, -1)
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def read(block: Column) -> Column:
        role, body = F.regexp_extract(block, _BLOCK, 1), F.regexp_extract(block, _BLOCK, 2)
        fits = block.rlike(_BLOCK)
        for mark in ("###", "</turn>"):
            fits = fits & ~body.contains(mark) & ~role.contains(mark)
        return F.when(fits, F.struct(unescape(role).alias("role"), unescape(body).alias("text")))

    return F.transform(blocks, read)


def format_turns(turns: DataFrame) -> DataFrame:
    """Each turn with escaped (boolean), block, body_at and body_end: the body's place in its block, in code points."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    back = parse_blocks(render_block(F.col("role"), F.col("text")))
    same = F.coalesce((F.size(back) == 1) & back[0].eqNullSafe(F.struct("role", "text")), F.lit(False))
    checked = plain.withColumn("escaped", ~same)
    shown_role = F.when(F.col("escaped"), escape_role("role")).otherwise(F.col("role"))
    shown_text = F.when(F.col("escaped"), escape_text("text")).otherwise(F.col("text"))
    shown = checked.withColumn("shown_role", shown_role).withColumn("shown_text", shown_text)
    body_at = F.length("shown_role") + len(OPEN) + len(MIDDLE)
    return shown.select(
        "conv_id", "turn", "role", "text", "escaped", render_block(F.col("shown_role"), F.col("shown_text")).alias("block"),
        body_at.cast("long").alias("body_at"), (body_at + F.length("shown_text")).cast("long").alias("body_end"),
    )


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, end in code points, end exclusive), n_escaped.

    One shuffle by conv_id: the running position is a window over the order in which the turns are then collected.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = format_turns(turns).withColumn("at", F.sum(F.length("block").cast("long")).over(order) - F.length("block"))
    span = F.struct((F.col("at") + F.col("body_at")).alias("start"), (F.col("at") + F.col("body_end")).alias("end"))
    item = F.struct("at", "role", "text", "block", F.when(F.col("role") == loss_role, span).alias("span"))
    each = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum(F.col("escaped").cast("long")).alias("n_escaped"))
    each = each.withColumn("formatted", F.array_join(F.col("items.block"), ""))
    source = F.transform("items", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    sound = parse_blocks("formatted").eqNullSafe(source)
    formatted = F.when(sound, F.col("formatted")).otherwise(F.raise_error(F.lit("a rendered conversation does not parse back")))
    spans = F.filter(F.col("items.span"), lambda s: s.isNotNull())
    return each.select("conv_id", formatted.cast("string").alias("formatted"), spans.alias("loss_spans"), "n_escaped")


def read_back(rendered: DataFrame) -> DataFrame:
    """The digest columns, from the formatted text and its loss spans alone."""
    parsed = rendered.withColumn("turns", parse_blocks("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    out = parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.array_join(under, "").alias("loss"), "formatted")
    return out.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the contract adds: control strings and escapes inside its texts.
PROBE_TEXT = "\\### Assistant: </turn> ok"


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    from tracewarden.llm.common import table

    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    return read_back(format_conversations(turns.unionByName(probe)))


#: Escapes are counted sign by sign: a run of m >= 3 number signs takes m - 2 backslashes.
ORACLE_SQL = {
    "op3_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
flagged AS (
  SELECT *, contains(role, '\') OR contains(role, ':') OR contains(role, '###') OR contains(role, '</turn>')
            OR contains(text, '###') OR contains(text, '</turn>') OR contains(text[:-2], '\') AS escaped
  FROM turns),
shown AS (
  SELECT *, CASE WHEN escaped THEN replace(replace(text, '\', '\\'), '</turn>', '<\/turn>') ELSE text END AS t1,
            CASE WHEN escaped THEN replace(replace(replace(role, '\', '\\'), ':', '\:'), '</turn>', '<\/turn>') ELSE role END AS r1
  FROM flagged),
marked AS (
  SELECT *, CASE WHEN escaped THEN list_sum(list_transform(regexp_extract_all(t1 || chr(1) || r1, '###+'), lambda x: length(x) - 2)) ELSE 0 END AS more
  FROM shown)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(t1) + length(r1) + coalesce(more, 0) + 14)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
}
