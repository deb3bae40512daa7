r"""Chat formatting by event-sourced reconstruction (native DataFrame code only).

An event log has the columns ``conv_id, seq, kind, turn, role, text``:

* ``message``     opens or extends a turn with a whole text,
* ``delta``       appends a streamed piece to the turn,
* ``edit``        replaces the text that the turn has so far,
* ``regenerate``  empties the turn and discards what was said after it, i.e. all
                  events of later turns with a smaller ``seq``.

``fold`` partitions the log by conversation, sorts it by sequence and folds it
into final messages.  The fold runs per turn first, with window maxima that find
the last reset, so that only live pieces meet in one group; conversations are
put together from finished turns.

``render`` writes each conversation with a template.  A turn is::

    <|im_start|>ROLE\nTEXT<|im_end|>\n

Control strings inside a text (those of this template and of other common ones)
get a backslash after their first character, and a control string that already
has backslashes there gets one more, so unescaping is exact.  Roles are
percent-encoded where they hold ``%``, ``<`` or a line end.  The loss mask is a
list of code-point spans (start, length) of the assistant texts.

Defined results: a null text or role is empty; a null ``turn`` or ``seq`` sorts
first; rows with equal ``turn`` are pieces of one turn only in an event log - in
a table of rows by turn each row is a turn, equal turns in the order of role and
text; null conversation ids form one conversation; an empty table gives none.
Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

# The control strings of this template and of other common templates.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL_TAILS = [
    r"\|im_start\|>",
    r"\|im_end\|>",
    r"\|endoftext\|>",
    r"\|startoftext\|>",
    r"/?s>",
    r"/?SYS>>",
]
BRACKET_TAILS = [r"/?INST\]"]

_ESCAPE = r"(<(?=\\*(?:" + "|".join(CONTROL_TAILS) + r"))|\[(?=\\*(?:" + "|".join(BRACKET_TAILS) + r")))"
_UNESCAPE = r"(<(?=\\+(?:" + "|".join(CONTROL_TAILS) + r"))|\[(?=\\+(?:" + "|".join(BRACKET_TAILS) + r")))\\"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


def encoded_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def decoded_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Rows by turn as a log: one ``message`` event for each row, numbered per conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    number = F.row_number().over(order)
    return turns.select(
        "conv_id",
        number.cast("long").alias("seq"),
        F.lit("message").alias("kind"),
        number.cast("long").alias("turn"),
        "role",
        "text",
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, turn, role, text``, one row per turn that still stands."""
    restart = F.col("kind") == "regenerate"
    earlier_turns = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "turn")
    log = events.select("conv_id", "seq", "kind", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = log.withColumn("cut", F.max(F.when(restart, F.col("seq"))).over(earlier_turns))
    log = log.where(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    log = log.withColumn("reset", F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(own))
    log = log.withColumn("live", F.col("reset").isNull() | (F.col("seq") >= F.col("reset")) | F.col("seq").isNull() & F.col("reset").isNull())
    piece = F.struct(F.col("seq"), F.when(restart, F.lit("")).otherwise(F.col("text")).alias("text"))
    return (
        log.groupBy("conv_id", "turn")
        .agg(
            F.min_by("role", F.struct("seq", "role")).alias("role"),
            F.array_sort(F.collect_list(F.when(F.col("live"), piece))).alias("pieces"),
        )
        .select("conv_id", "turn", "role", F.concat_ws("", F.transform("pieces", lambda p: p["text"])).alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length) of each conversation."""
    body = escaped(F.col("text"))
    head = F.concat(F.lit(START), encoded_role(F.col("role")), F.lit("\n"))
    turn = F.struct(
        F.col("turn"),
        F.concat(head, body, F.lit(END + "\n")).alias("segment"),
        F.length(head).alias("at"),
        F.length(body).alias("n"),
        (F.col("role") == "assistant").alias("loss"),
    )
    grouped = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["end"] + F.length(t["segment"])).alias("end"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["end"] + t["at"]).alias("start"), t["n"].alias("length")))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return grouped.select("conv_id", F.concat_ws("", F.transform("turns", lambda t: t["segment"])).alias("formatted"), spans["spans"].alias("loss_spans"))


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """The written output for a table of rows by turn, with the fixed conversation -1."""
    spark = turns.sparkSession
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t"),
    ).select("conv_id", "t.*")
    rows = turns.select("conv_id", "turn", "role", "text").unionByName(extra)
    return stored(render(fold(events_of_turns(rows))), "chat")


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    segments = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda s: s != "")

    def turn(s: Column) -> Column:
        cut = F.instr(s, "\n")
        return F.struct(
            decoded_role(F.substr(s, F.lit(1), cut - 1)).alias("role"),
            unescaped(F.substr(s, cut + 1, F.length(s) - cut - F.lit(len(END) + 1))).alias("text"),
        )

    return F.transform(segments, turn)


def digest(output: DataFrame) -> DataFrame:
    turns = parsed(F.col("formatted"))
    masked = F.concat_ws("", F.transform("loss_spans", lambda x: unescaped(F.substr(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"]))))
    parts = output.select("conv_id", turns.alias("turns"), masked.alias("masked"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return parts.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text)
    + len(regexp_extract_all(text, '<\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|/?s>|/?SYS>>)|\[\\*/?INST\]')) AS n
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
