"""The request contract and the client's branches over whole tables: bodies, modes, notes and keyword lists made from their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_QUESTION, keyword_list
from ..operators import client, contract
from ..session import table
from . import query

#: White space that Python's str.strip takes off, as DuckDB writes it.
_SPACE = r"[ \t\n\r\x0B\f\x1C-\x1F\x{85}\x{A0}\x{2003}\x{3000}]"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _bodies(turns: DataFrame) -> DataFrame:
    """A JSON body for each turn; eleven shapes in turn, by conversation and turn."""
    text, shape = F.coalesce("text", F.lit("")), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(11))
    one = lambda name, value: F.to_json(F.struct(value.alias(name)))
    nested = F.to_json(F.struct(text.alias("question"), F.struct(F.lit(True).alias("question")).alias("meta")))
    body = F.when(shape == 0, one("question", text))
    for n, made in enumerate(('{"question":null}', '{"question":true}', one("question", F.col("turn")), "[]", " {} ", "false", one("other", text), "[1]", nested, one("question", F.concat(F.lit("　 "), text, F.lit("\t")))), 1):
        body = body.when(shape == n, F.lit(made) if isinstance(made, str) else made)
    return turns.select("conv_id", "turn", body.alias("body"))


_SHAPED = f"SELECT conv_id, turn, {_strip("coalesce(text, '')")} AS said, (conv_id * 7 + turn) % 11 AS shape FROM conversations"
_ASKED = "CASE shape WHEN 0 THEN said WHEN 1 THEN 'None' WHEN 2 THEN 'True' WHEN 3 THEN turn::VARCHAR WHEN 9 THEN said WHEN 10 THEN said ELSE '' END"


@query(f"""SELECT conv_id, turn, question, CAST(CASE WHEN shape = 8 THEN 500 WHEN question = '' THEN 400 ELSE 200 END AS INTEGER) AS status
    FROM (SELECT *, {_ASKED} AS question FROM ({_SHAPED}))""")
def contract_on_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falsy, malformed and nested bodies, nulls, booleans and numbers."""
    return contract.requests(_bodies(table(spark, sf_dir, "conversations"))).select("conv_id", "turn", "question", "status")


@query(f"""SELECT conv_id, turn, note FROM (SELECT *, CASE WHEN shape = 8 THEN '{client.FAILED}：{client.FAILED}' WHEN {_ASKED} = '' THEN '{client.FAILED}：{contract.NO_QUESTION}' END AS note FROM ({_SHAPED}))
    WHERE note IS NOT NULL""")
def failure_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that failed, with what the waiting page shows; a server error has no message of its own."""
    answered = contract.responses(_bodies(table(spark, sf_dir, "conversations")))
    error = F.when(F.col("status") == 400, F.get_json_object("response", "$.error"))
    note = client.failure_note(client.outcome(F.col("status"), error))
    return answered.select("conv_id", "turn", note.alias("note")).filter("note is not null")


@query(f"""SELECT doc_id, mode, coalesce(CASE mode WHEN 'ai' THEN nullif(body, '') WHEN 'text' THEN nullif(src, '')
      WHEN 'field' THEN coalesce(CASE WHEN lang = 'en' THEN nullif(src, '') END, nullif({_strip("lang")}, '')) WHEN 'voice' THEN nullif(body, '') END, '{DEFAULT_QUESTION}') AS asked
    FROM (SELECT *, ['ai', 'text', 'field', 'voice', 'image'][CAST(doc_id % 5 AS INTEGER) + 1] AS mode, {_strip("text")} AS body, {_strip("source")} AS src FROM documents)""")
def questions_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a request of one of five modes: its text, its source as keywords or as an English company, its language as ticker."""
    modes = F.array(*[F.lit(m) for m in client.MODE_FIELDS])
    none: Column = F.lit(None).cast("string")
    asked = table(spark, sf_dir, "documents").select(
        "doc_id", F.element_at(modes, (F.col("doc_id") % len(client.MODE_FIELDS)).cast("int") + 1).alias("mode"), F.col("text").alias("question"), F.col("source").alias("keywords"),
        F.when(F.col("lang") == "en", F.col("source")).otherwise(" ").alias("company"), F.col("lang").alias("ticker"), none.alias("news_url"), none.alias("post_url"),
    )
    return client.extract_question(asked).select("doc_id", "mode", "asked")


@query(f"""SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i), '|') AS keywords
    FROM (SELECT conv_id, turn, list_transform(regexp_split_to_array(text, '[、,，]+'), lambda x: {_strip("x")}) AS l FROM conversations WHERE text IS NOT NULL)""")
def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a keyword box would make of each turn: parts between commas, stripped, each once."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    return turns.select("conv_id", "turn", F.array_join(keyword_list(F.col("text")), "|").alias("keywords"))
