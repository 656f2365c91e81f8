"""Tagged lines to typed blocks, without a state machine: only openers start a segment.

Within a segment that a bare opener started, lines belong to its block until the first closing line of its kind; all
other lines stand alone. Running sums and maxima over a document's lines say which is which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, trim

#: The tags.
OPENER = rf"(?is)\A{WS}*([-*•]{WS}+)?<(H1|H2|P)>{WS}*(.*)\z"
CLOSER = rf"(?i)\A{WS}*</(H1|H2|P)>{WS}*\z"
TAGS = r"(?i)</?(?:H1|H2|P)>"
LONGEST_HEADING = 120


def lines(docs: DataFrame, column: str = "content") -> DataFrame:
    """doc_id, line_no (from 0, blank lines counted), line (trimmed, not blank)."""
    split = F.split(F.regexp_replace(F.col(column), r"\r\n?", "\n"), "\n", -1)
    return docs.select("doc_id", F.posexplode(split).alias("line_no", "line")).withColumn("line", trim(F.col("line"))).where("line <> ''")


def clean(c: Column) -> Column:
    return trim(F.regexp_replace(c, TAGS, ""))


def blocks(docs: DataFrame, column: str = "content") -> DataFrame:
    """doc_id, line_no, kind (H1, H2 or P), text, in order of line_no. Null content has no blocks."""
    d = lines(docs, column)
    line = F.col("line")
    d = d.withColumn("opens", F.nullif(F.upper(F.regexp_extract(line, OPENER, 2)), F.lit("")))
    d = d.withColumn("closes", F.nullif(F.upper(F.regexp_extract(line, CLOSER, 1)), F.lit("")))
    body, bullet = F.regexp_extract(line, OPENER, 3), F.regexp_extract(line, OPENER, 1)
    d = d.withColumn("body", F.when(F.col("opens").isNotNull(), body)).withColumn("bullet", F.when(bullet != "", "- ").otherwise(""))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    d = d.withColumn("seg", F.sum(F.col("opens").isNotNull().cast("int")).over(order))
    segment = Window.partitionBy("doc_id", "seg").orderBy("line_no")
    bare = F.when(F.col("body") == "", F.col("opens"))
    d = d.withColumn("seg_kind", F.first(bare).over(segment))
    d = d.withColumn("over", F.coalesce(F.max(F.col("closes") == F.col("seg_kind")).over(segment), F.lit(False)))
    end = F.expr("locate(concat('</', lower(opens), '>'), lower(body))")
    inline = F.when(end > 0, trim(F.concat("bullet", F.expr("substring(body, 1, locate(concat('</', lower(opens), '>'), lower(body)) - 1)")))).otherwise(trim(F.concat("bullet", "body")))
    d = d.where("(opens is not null and body <> '') or (opens is null and closes is null)")
    whole = F.col("opens").isNotNull()
    inside = ~whole & F.col("seg_kind").isNotNull() & ~F.col("over")
    d = d.select("doc_id", "line_no", whole.alias("whole"), inside.alias("inside"), F.when(whole, F.col("opens")).when(inside, F.col("seg_kind")).otherwise("P").alias("kind"), F.when(whole, inline).otherwise(line).alias("part"), F.when(inside, -F.col("seg")).otherwise(F.col("line_no")).alias("block"))
    # lines of one block have the number of its segment, others their own; the windows' partitioning by document serves
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"])
    g = d.groupBy("doc_id", "block").agg(F.min("line_no").alias("line_no"), F.first("kind").alias("kind"), F.first("whole").alias("whole"), F.first("inside").alias("inside"), F.array_join(parts, " ").alias("joined"))
    g = g.select("doc_id", "line_no", "kind", F.when(F.col("whole"), F.col("joined")).otherwise(clean(F.col("joined"))).alias("text"), (F.col("whole") | F.col("inside")).alias("drops"))
    return g.where("text <> '' or not drops").drop("drops")


def effective_kind(kind: Column, text: Column) -> Column:
    """Headings that are list items, lines of a table of contents or too long are paragraphs."""
    toc = text.rlike(rf"\.{{2,}}{WS}*\p{{Nd}}+{WS}*\z") | (F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", "")) > LONGEST_HEADING)
    return F.when(kind.isin("H1", "H2") & text.startswith("- "), "P").when((kind == "H2") & toc, "P").otherwise(kind)
