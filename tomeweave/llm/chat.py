r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the whole conversation up to that turn, of
which only the reply's text is trainable. A conversation that does not end in a reply ends in one
more example with nothing trainable, so the examples hold every turn.

A turn is written ``<|im_start|>role<|im_sep|>text<|im_end|>``. Control strings inside roles and
texts get a backslash behind their first character, and so do those that already have some there;
taking one away again restores the text exactly, and no control string of the output stems from
a text.

Defined results: turns are ordered by ``turn`` (NULL first), then role, then text, so ties and
repeated rows have one order and all are kept. NULL roles and texts are empty. A NULL ``conv_id``
is a conversation of its own. An empty table gives no examples. Other columns are not read. A
conversation of n turns is written in up to n prefixes, which is what the method asks for; each
conversation is one row while it is formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# What must not come out of a text: this template's marks and those of other common ones.
_TAILS = r"(\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|INST\]|/INST\])"
_FIRST = r"(<|\[)"
REPLY = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_FIRST}(\\*){_TAILS}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_FIRST}\\(\\*){_TAILS}", "$1$2$3")


def expand(conversations: DataFrame) -> DataFrame:
    """``conv_id, example, n_turns, text, loss_start, loss_length, closing``, one row per example.

    ``n_turns`` counts the turns in ``text``. The trainable part is ``loss_length`` code points
    from ``loss_start`` (0-based) of ``text``. ``closing`` marks a conversation's last example,
    which holds all of it.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            role.alias("role"),
            text.alias("text"),
            F.concat(F.lit(START), escape(role), F.lit(SEP)).alias("head"),
            escape(text).alias("body"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    ends = F.aggregate(
        "ts",
        F.array().cast("array<int>"),
        lambda acc, t: F.array_append(
            acc,
            F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))
            + F.length(t["head"]) + F.length(t["body"]) + len(END),
        ),
    )
    written = F.array_join(
        F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""
    )
    n = F.size("ts")
    targets = F.filter(
        F.transform(
            "ts",
            lambda t, i: F.struct(
                (i + 1).alias("n_turns"),
                F.get("ends", i).alias("end"),
                F.when(t["role"] == REPLY, F.length(t["body"])).otherwise(0).alias("length"),
                ((t["role"] == REPLY) | (i + 1 == n)).alias("wanted"),
                (i + 1 == n).alias("closing"),
            ),
        ),
        lambda e: e["wanted"],
    )
    return (
        whole.withColumn("ends", ends)
        .select("conv_id", written.alias("written"), targets.alias("targets"))
        .select("conv_id", "written", F.posexplode("targets").alias("at", "e"))
        .select(
            "conv_id",
            (F.col("at") + 1).alias("example"),
            F.col("e.n_turns").alias("n_turns"),
            F.col("written").substr(F.lit(1), F.col("e.end")).alias("text"),
            (F.col("e.end") - len(END) - F.col("e.length")).alias("loss_start"),
            F.col("e.length").alias("loss_length"),
            F.col("e.closing").alias("closing"),
        )
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples say: turns, trainable text and size, as digests."""
    masked = unescape(F.col("text").substr(F.col("loss_start") + 1, F.col("loss_length")))
    parts = examples.groupBy("conv_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("example", masked.alias("loss")))),
                lambda e: e["loss"],
            ),
            "",
        ).alias("loss"),
        F.get(F.collect_list(F.when(F.col("closing"), F.col("text"))), F.lit(0)).alias("whole"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    pieces = F.split("whole", r"<\|im_start\|>")
    written = F.slice(pieces, F.lit(2), F.size(pieces))
    turn = F.transform(
        written,
        lambda t: F.concat(
            unescape(F.substring_index(t, SEP, 1)),
            F.lit("\n"),
            unescape(F.substring_index(F.substring_index(t, SEP, -1), END, 1)),
            F.lit("\n"),
        ),
    )
    return parts.select(
        "conv_id",
        F.size(written).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


# The contract's own conversation, whose texts consist of control strings.
PLANTED = "</s>[INST] ok [/INST]"


def query(spark, folder: str) -> DataFrame:
    """Contract ``op3``: all conversations and number -7, formatted and read back."""
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(REPLY).alias("role"),
        F.lit(PLANTED).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(expand(rows.unionByName(planted)))


_SQL_TAILS = r"(\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|INST\]|/INST\])"
SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}'
  UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'
), sized AS (
  SELECT *,
    len(regexp_replace(role, '(<|\[)(\\*){_SQL_TAILS}', '\1\\\2\3', 'g'))
      + len(regexp_replace(text, '(<|\[)(\\*){_SQL_TAILS}', '\1\\\2\3', 'g'))
      + len('<|im_start|><|im_sep|><|im_end|>') AS piece
  FROM rows
), placed AS (
  SELECT *,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    sum(piece) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant' OR pos = n) AS n_examples
FROM placed GROUP BY conv_id
"""
