"""Answers put together from ranked entries, one row a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import shortened


def answers(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """``questions(question_id, question, kind)``, ``ranked(question_id, rank, id, title, type, content, created_at)``.

    Gives (question_id, answer, citations, has_answer). Ranks start at 0; relevance falls by 0.05 a rank.
    Whatever was retrieved is cited: the search's own limit bounds a question's group.
    """
    entry = F.struct("rank", "id", "title", "type", "content", "created_at")
    held = ranked.groupBy("question_id").agg(F.sort_array(F.collect_list(entry)).alias("found"))
    q = questions.join(held, "question_id", "left").withColumn("found", F.coalesce("found", F.expr("array()").cast(held.schema["found"].dataType)))
    line = lambda n: lambda e: F.concat(F.lit("- **"), e["title"], F.lit("** ["), e["type"], F.lit("]: "), shortened(e["content"], n))
    dated = lambda e: F.concat(F.lit("- **"), e["title"], F.lit("** ("), F.date_format(e["created_at"], "yyyy-MM-dd"), F.lit("): "), shortened(e["content"], 300))
    whole = F.filter("found", lambda e: e["type"] == "architecture")
    asked = F.concat(F.lit("## "), F.col("question"), F.lit("\n"))
    overview = F.when(F.size(whole) > 0, F.concat(F.array(asked), F.flatten(F.transform(whole, lambda e: F.array(e["content"], F.lit("")))))).otherwise(
        F.concat(F.array(asked), F.transform(F.slice("found", 1, 5), line(200)))
    )
    parts = (
        F.when(F.col("kind") == "architecture", overview)
        .when(F.col("kind") == "decision", F.concat(F.array(F.lit("## Relevant Decisions\n")), F.transform("found", lambda e: F.concat(F.lit("### "), e["title"], F.lit("\n"), e["content"], F.lit("\n")))))
        .when(F.col("kind") == "bug-history", F.concat(F.array(F.lit("## Bug History\n")), F.transform("found", dated)))
        .otherwise(F.concat(F.array(asked), F.transform(F.slice("found", 1, 8), line(250))))
    )
    cited = F.transform("found", lambda e: F.struct(e["id"].alias("id"), F.greatest(F.lit(0.0), 1 - e["rank"] * 0.05).alias("relevance"), shortened(e["content"], 200).alias("excerpt")))
    some = F.size("found") > 0
    return q.select("question_id", F.when(some, F.array_join(parts, "\n")).otherwise("").alias("answer"), cited.alias("citations"), some.alias("has_answer"))
