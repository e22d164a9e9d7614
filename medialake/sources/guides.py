"""Help texts in Markdown: topics with their blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HEADING = r"^## +(.*?)\s*\{#\s*([^}]*?)\s*\}"


def topics(texts: DataFrame) -> DataFrame:
    """(file, topic, id, title, line, text): the lines of the topics of Markdown texts (``file``, ``text``).

    A topic begins with a heading like ``## Title {#id}``; lines before the first one, first-order headings and the lines
    of a heading without id or title belong to none.
    """
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    second = F.col("text").startswith("## ")
    title, name = F.trim(F.regexp_extract("text", _HEADING, 1)), F.regexp_extract("text", _HEADING, 2)
    marked = lines.where(second | ~F.col("text").startswith("# ")).withColumn("heading", F.when(second, F.struct(title.alias("title"), name.alias("id"))))
    seen = marked.withColumn("_h", F.last("heading", ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    topic = F.sum(F.col("heading").isNotNull().cast("int")).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    of = seen.withColumn("topic", topic).where("heading IS NULL AND _h.title <> '' AND _h.id <> ''")
    return of.select("file", "topic", F.col("_h.id").alias("id"), F.col("_h.title").alias("title"), "line", "text")


def blocks(topic_lines: DataFrame) -> DataFrame:
    """(file, topic, id, title, block, kind, items): paragraphs (one text), bullets and steps of the topics, in order."""
    line = F.trim("text")
    bullet, step = r"^[-*] ", r"^\d+\. "
    kind = F.when(line == "", None).when(line.rlike(bullet), "bullets").when(line.rlike(step), "steps").otherwise("paragraph")
    w = Window.partitionBy("file", "topic").orderBy("line")
    rows = topic_lines.withColumn("kind", kind).withColumn("item", F.when(kind == "bullets", F.regexp_replace(line, bullet, "")).when(kind == "steps", F.trim(F.regexp_replace(line, step, ""))).otherwise(line))
    begins = F.col("kind").isNotNull() & ~F.coalesce(F.col("kind") == F.lag("kind").over(w), F.lit(False))
    numbered = rows.withColumn("block", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind IS NOT NULL")
    grouped = numbered.groupBy("file", "topic", "id", "title", "block", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "item"))), lambda x: x["item"]).alias("items"))
    joined = F.when(F.col("kind") == "paragraph", F.array(F.array_join("items", " "))).otherwise(F.col("items"))
    return grouped.withColumn("items", joined)
