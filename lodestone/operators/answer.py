"""Context assembly, prompts, answer clean-up, word stream, chat log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROAD_BUDGET, LEAST_REST, SPECIFIC_CUT = 7000, 100, 1500
NO_RESULT = "None of the indexed documents bears on this question."
BROAD_NOTICE = "Answered from all documents and sections"
ANSWER_TOKENS = {"broad": 1500, "specific": 1000}
TEMPERATURE = 0.2
#: Prompts by part; $ marks a column.
BROAD_PROMPT = [
    "Summarise the documents below for the reader.\n\nIndexed documents: ",
    "$sources",
    "\n\nUse every passage. Give each section that occurs its own heading, and in lists name every single item, without leaving any out.\n\nPassages:\n",
    "$context",
    "\n\nRequest: ",
    "$raw",
    "\n\nSummary:",
]
SPECIFIC_PROMPT = [
    "Answer the question from the passages below.\n\nIndexed documents: ",
    "$sources",
    "\n\nRely on the passages alone, drawing conclusions where they allow it. Be direct, leave out file names and page numbers, give lists in full, and say that the answer was not found only if no passage bears on it.\n\nPassages:\n",
    "$context",
    "\n\nQuestion: ",
    "$raw",
    "\nAnswer:",
]


def _shown(text: Column) -> Column:
    return F.concat(F.lit("[SOURCE: "), F.col("source"), F.lit(" | Page "), F.col("page").cast("string"), F.lit("]\n"), text)


def _joined(rows: DataFrame, order: list[str]) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(*order, "shown")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(packed, lambda x: x["shown"]), "\n\n").alias("context"))


def broad_context(results: DataFrame, budget: int = BROAD_BUDGET, least: int = LEAST_REST) -> DataFrame:
    """(query_id, context): by source and page, ties by rank, until the texts pass
    the budget; the text that passes it is cut to what is left, if that is over `least`."""
    w = Window.partitionBy("query_id").orderBy("source", "page", "rank")
    upto = F.sum(F.char_length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = results.withColumn("upto", upto).withColumn("before", F.col("upto") - F.char_length("text"))
    left = F.lit(budget) - F.col("before")
    cut = F.when(F.col("upto") <= budget, F.col("text")).when((F.col("before") <= budget) & (left > least), F.substring(F.col("text"), F.lit(1), left.cast("int")))
    return _joined(rows.withColumn("shown", _shown(cut)).where(F.col("shown").isNotNull()), ["source", "page", "rank"])


def specific_context(results: DataFrame, cut: int = SPECIFIC_CUT) -> DataFrame:
    """(query_id, context): by rank, each text cut."""
    return _joined(results.withColumn("shown", _shown(F.substring("text", 1, cut))), ["rank"])


def source_list(chunks: DataFrame) -> DataFrame:
    """One row: the sources' names in alphabetical order, joined by commas."""
    return chunks.select("source").distinct().agg(F.array_join(F.array_sort(F.collect_list("source")), ", ").alias("sources"))


def prompts(analysed: DataFrame, contexts: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, prompt, max_tokens); questions without context have no prompt."""
    rows = analysed.join(contexts, "query_id").crossJoin(F.broadcast(sources))
    filled = lambda parts: F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])
    broad, specific = filled(BROAD_PROMPT), filled(SPECIFIC_PROMPT)
    wide = F.col("intent") == "broad"
    return rows.select("query_id", F.when(wide, broad).otherwise(specific).alias("prompt"), F.when(wide, ANSWER_TOKENS["broad"]).otherwise(ANSWER_TOKENS["specific"]).alias("max_tokens"))


def cleaned(answer: Column) -> Column:
    """Without pairs of inline backticks."""
    return F.regexp_replace(answer, "`([^`]+)`", "$1")


def with_fallback(analysed: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, answer): the cleaned answer, or the fixed message where there is none."""
    return analysed.select("query_id").join(answers, "query_id", "left").select("query_id", F.coalesce(cleaned(F.col("answer")), F.lit(NO_RESULT)).alias("answer"))


def word_stream(answers: DataFrame) -> DataFrame:
    """(query_id, position, piece): the answer's words, each with a space behind it."""
    return answers.select("query_id", F.posexplode(F.split("answer", " ", -1)).alias("position", "w")).select("query_id", "position", F.concat("w", F.lit(" ")).alias("piece"))


def notices(analysed: DataFrame) -> DataFrame:
    """(query_id, corrected_notice, broad_notice); page look-ups have neither."""
    hybrid = F.coalesce(F.col("page_num") == 0, F.lit(True))
    return analysed.select(
        "query_id",
        F.when(hybrid & F.col("was_changed"), F.concat(F.lit("Query corrected: "), F.col("corrected"))).alias("corrected_notice"),
        F.when(hybrid & (F.col("intent") == "broad"), F.lit(BROAD_NOTICE)).alias("broad_notice"),
    )


def chat_log(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(session_id, turn, role, content): each question and, behind it, its answer.
    questions: (session_id, query_no, query_id, raw), query_no from 0."""
    asked = questions.select("session_id", (F.col("query_no") * 2).alias("turn"), F.lit("user").alias("role"), F.col("raw").alias("content"))
    said = questions.join(answers, "query_id").select("session_id", (F.col("query_no") * 2 + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))
    return asked.unionByName(said)
