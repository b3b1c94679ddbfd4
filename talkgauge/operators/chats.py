"""Conversations in their raw layouts, as DataFrame operators for exports of any size.

A chat export's lines become messages by a running count of the lines that begin one; an exchange per row and a
message per row become messages by unpivoting; JSON records become cells by recursion over their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgauge.functions import names, text
from talkgauge.functions.patterns import to_java
from talkgauge.sources.files import STAMP

STAMPED = to_java(STAMP, ignore_case=True)
SPOKEN = to_java(STAMP + r"\s?[-–]?\s?(?P<speaker>[^:]{1,60}): ", ignore_case=True)
#: Lines of a file that are numbered together.
BLOCK_LINES = 10_000
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line, value) of every line of files (path, value)."""
    return files.select("path", F.posexplode(F.split("value", LINE_BREAK, -1)).alias("line", "value"))


def export_messages(lines: DataFrame) -> DataFrame:
    """(path, message, speaker, body) from the lines of chat exports.

    A line with a stamp and a sender begins a message; one with a stamp alone is a notice and belongs to none;
    others go on with the message before, and those before the first message are dropped. Messages are counted
    block by block, and a block starts from the count of those before it, so a long export is not one task's work.
    """
    spoken, stamped = F.col("value").rlike(SPOKEN), F.col("value").rlike(STAMPED)
    rows = lines.withColumn("begins", spoken).filter(spoken | ~stamped).withColumn("block", F.floor(F.col("line") / BLOCK_LINES))
    begun = F.sum(F.col("begins").cast("long"))
    blocks = rows.groupBy("path", "block").agg(begun.alias("held"))
    earlier = F.coalesce(F.sum("held").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("path").alias("of"), F.col("block").alias("in"), earlier.alias("earlier"))
    rows = rows.withColumn("inside", begun.over(W.partitionBy("path", "block").orderBy("line")))
    rows = rows.join(blocks, F.col("path").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in")))
    rows = rows.withColumn("message", F.col("earlier") + F.col("inside")).filter("message > 0")
    said = F.when(F.col("begins"), F.regexp_replace("value", SPOKEN, "")).otherwise(F.col("value"))
    speaker = F.when(F.col("begins"), text.stripped(F.regexp_extract("value", SPOKEN, 1)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", said.alias("said")))), lambda x: x["said"]), "\n")
    return rows.groupBy("path", "message").agg(F.max(speaker).alias("speaker"), body.alias("body"))


def table_messages(rows: DataFrame, order: str) -> DataFrame | None:
    """(seq, place, speaker, body) from a table in either layout of conversations; blank bodies are left out. None: neither layout."""
    if pair := names.exchange(rows.columns):
        cells = rows.select(F.col(f"`{order}`").alias("seq"), *[F.col(f"`{c}`").cast("string").alias(c) for c in pair]).unpivot("seq", list(pair), "speaker", "body")
        out = cells.withColumn("place", F.when(F.col("speaker") == pair[0], 0).otherwise(1))
    elif found := names.message(rows.columns):
        who = text.stripped(F.coalesce(F.col(f"`{found[0]}`").cast("string"), F.lit("?")))
        out = rows.select(F.col(f"`{order}`").alias("seq"), F.lit(0).alias("place"), F.when(who == "", "?").otherwise(who).alias("speaker"), F.col(f"`{found[1]}`").cast("string").alias("body"))
    else:
        return None
    return out.filter(F.col("body").isNotNull() & ~text.is_blank(F.col("body"))).select("seq", "place", "speaker", "body")


def json_cells(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, name, value) of every scalar in JSON records: nested names are joined by dots; no booleans, nulls or lists in lists.

    Objects are opened level by level, to the deepest; what is still closed is kept, so that no level is parsed twice.
    """
    level = records.select(F.col(id_col).alias("id"), F.lit("").alias("prefix"), F.try_parse_json(F.col(json_col)).alias("v")).filter("schema_of_variant(v) like 'OBJECT%'")
    out = None
    while out is None or not level.isEmpty():
        opened = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key"), F.col("value").alias("x")))
        # A list's items stand for it, so that one explode opens both; lists in lists stay closed.
        items = F.when(F.schema_of_variant("x").like("ARRAY%"), F.col("x").cast("array<variant>")).otherwise(F.array("x"))
        both = opened.select("id", F.concat("prefix", "key").alias("name"), F.explode(items).alias("x")).withColumn("kind", F.schema_of_variant("x"))
        scalars = both.filter("kind in ('STRING', 'BIGINT', 'DOUBLE', 'FLOAT') or kind like 'DECIMAL%'").select("id", "name", F.col("x").cast("string").alias("value"))
        out = scalars if out is None else out.unionByName(scalars)
        level = both.filter("kind like 'OBJECT%'").select("id", F.concat("name", F.lit(".")).alias("prefix"), F.col("x").alias("v")).persist()
    return out
