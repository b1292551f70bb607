"""Responses and chat messages as tables (survey C11, C12).

The reference calls a chat service one question at a time; here the
prompts are a table (``context.messages``) and the service's replies are read
back as a table of response strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def extract_answer(response: Column) -> Column:
    """C11: answer text of a response string.

    JSON text (after leading blanks, starts with '{') -> ``choices[0].message.content``
    when non-empty, else ``content``, ``text`` or ``answer`` (stripped); text that
    is not JSON, or JSON with none of these keys, is returned unchanged."""
    r = response.cast("string")
    is_json_like = F.startswith(F.ltrim(F.regexp_replace(r, r"^\s+", "")), F.lit("{"))
    # strict: the text in brackets has to be an array of one object, so neither quotes nor trailing text slip through
    one = F.from_json(F.concat(F.lit("["), r, F.lit("]")), "array<struct<content:string>>", {"allowSingleQuotes": "false"})
    valid = F.coalesce(F.size(one) == 1, F.lit(False)) & F.get_json_object(r, "$").isNotNull()
    choice = F.get_json_object(r, "$.choices[0].message.content")
    pick = (F.when(F.coalesce(choice, F.lit("")) != "", _strip(choice))
            .when(F.get_json_object(r, "$.content").isNotNull(), _strip(F.get_json_object(r, "$.content")))
            .when(F.get_json_object(r, "$.text").isNotNull(), _strip(F.get_json_object(r, "$.text")))
            .when(F.get_json_object(r, "$.answer").isNotNull(), _strip(F.get_json_object(r, "$.answer"))))
    return F.when(is_json_like & valid, F.coalesce(pick, r)).otherwise(r)


def chat_messages(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", content_col: str = "text") -> DataFrame:
    """One ordered message list per conversation.

    Missing role -> 'user', missing content -> ''. A conversation's turns are
    one group; the list is that conversation's own transcript."""
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit("user")).alias("role"),
                     F.coalesce(F.col(content_col).cast("string"), F.lit("")).alias("content"))
    return (t.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
            .select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"),
                                                                   x["content"].alias("content"))).alias("messages")))
