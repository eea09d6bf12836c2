"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A conversation becomes one training example for every assistant turn: all turns before it are context, its text
alone is under the loss mask. Turns after the last assistant turn form one more example without a target, so that
nothing of the input is lost.

Template: every turn is ``<s>[INST]role[/INST]text</s>``. Roles and texts are escaped: each backslash is doubled,
then a backslash goes after the first character of every control string (``<s>``, ``</s>``, ``[INST]``,
``[/INST]``), so none of them occurs inside a turn and ``\\x`` always reads back as ``x``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONTROL = r"(<|\[)(/?(?:s>|INST\]))"
_OPEN, _MIDDLE, _CLOSE = "<s>[INST]", "[/INST]", "</s>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(turn: Column) -> Column:
    return F.concat(F.lit(_OPEN), escape(turn["role"]), F.lit(_MIDDLE), escape(turn["text"]), F.lit(_CLOSE))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, example, is_last, formatted, loss_start, loss_length for (conv_id, turn, role, text).

    ``example`` is the position of its last turn; the loss mask are the ``loss_length`` code points of
    ``formatted`` from offset ``loss_start`` (0 and 0 in an example without target). Turns are ordered by turn
    (null first), then role and text, so ties and repeated rows keep a fixed order and all stay. Null roles and
    texts count as empty; other columns are ignored. A row with a null conv_id belongs to no conversation: each is one
    of its own. Longer histories make proportionally longer examples: that is what the expansion is. No rows, no
    examples.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select("conv_id", turn.alias("t"))
    chats = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    chats = chats.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("t").alias("ts")))
    chats = chats.select("conv_id", "ts", F.transform("ts", _render).alias("rendered"))
    ends = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (F.element_at(F.col("ts"), i)["role"] == ASSISTANT) | (i == F.size("ts")))
    examples = chats.select("conv_id", "ts", "rendered", F.explode(ends).alias("example"))
    last = F.element_at("ts", F.col("example"))
    context = F.array_join(F.slice("rendered", F.lit(1), F.col("example") - 1), "")
    return examples.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        (F.col("example") == F.size("ts")).alias("is_last"),
        F.concat(context, F.element_at("rendered", F.col("example"))).alias("formatted"),
        F.when(last["role"] == ASSISTANT, F.length(context) + len(_OPEN) + len(ASSISTANT) + len(_MIDDLE)).otherwise(0).cast("long").alias("loss_start"),
        F.when(last["role"] == ASSISTANT, F.length(escape(last["text"]))).otherwise(0).cast("long").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs of a formatted example."""
    parts = F.split(formatted, _CLOSE)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def parse(part: Column) -> Column:
        middle = F.locate(_MIDDLE, part)
        head = F.substr(part, F.lit(len(_OPEN) + 1), middle - len(_OPEN) - 1)
        return F.struct(unescape(head).alias("role"), unescape(F.substr(part, middle + len(_MIDDLE))).alias("text"))

    return F.transform(parts, parse)


def digests(examples: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its formatted examples; one for each row without conv_id.

    The turns are read from the example that holds all of them, the loss text from every example's own mask.
    """
    whole = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    read = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.struct(F.size(read_turns(F.col("formatted"))).cast("long").alias("n"), F.sha2(F.array_join(whole, "").cast("binary"), 256).alias("sha"))).alias("all"),
        F.when(F.col("loss_length") > 0, F.struct("example", masked.alias("text"))).alias("loss"),
    )
    by_chat = read.where("conv_id IS NOT NULL").groupBy("conv_id").agg(
        F.max("all").alias("all"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("loss")).alias("loss")
    )
    alone = read.where("conv_id IS NULL").select("conv_id", "all", F.col("chars").alias("formatted_chars"), F.array_compact(F.array("loss")).alias("loss"))
    by_chat = by_chat.unionByName(alone)
    loss = F.array_join(F.transform("loss", lambda x: x["text"]), "")
    return by_chat.select(
        "conv_id",
        F.col("all.n").alias("n_turns"),
        F.col("all.sha").alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The conversation that the query adds: its texts hold control strings of the template.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    rows = [(-1, 0, "user", PROBE), (-1, 1, ASSISTANT, PROBE)]
    probe = turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


SQL = rf"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT conv_id, NULL, turn, role, text FROM (VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')) v(conv_id, turn, role, text)),
e AS (
  SELECT *, length(regexp_replace(replace(role, '\', '\\'), '(<|\[)(/?(?:s>|INST\]))', '\1\\\2', 'g'))
          + length(regexp_replace(replace(text, '\', '\\'), '(<|\[)(/?(?:s>|INST\]))', '\1\\\2', 'g')) + {len(_OPEN + _MIDDLE + _CLOSE)} AS chars
  FROM t),
p AS (
  SELECT *, sum(chars) OVER w AS upto, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back
  FROM e WINDOW w AS (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR back = 1))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id, own
"""
