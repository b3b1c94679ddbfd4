"""Registered queries: the library's operators on the driver's tables, and the same in DuckDB's SQL.

RE2 knows neither look-around nor back-references, and its ``\\b`` is ASCII; where an operator needs those and
its SQL would not be the same, it has no SQL here and is tested against Python's own ``re``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgauge.functions import names, packs, text
from talkgauge.functions.packs import get_pack
from talkgauge.operators import chats, profile, rules, validate
from talkgauge.plans import golden
from talkgauge.plans.recommend import BARS, decision_matrix
from talkgauge.sources.files import TABLE_CHARS
from talkgauge.streaming import rescan

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


def words_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(text.word_count(F.col("text"))).alias("words"), F.max("n_chars").alias("longest"))


#: E-mail addresses alone: what SQL can say of the packs' patterns.
MAIL = packs.Pack("mail", languages=("en",), patterns=(packs.EMAIL,))


def doc_pii_email(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.size(text.find_pii(F.col("text"), MAIL)).cast("long").alias("emails")).filter("emails > 0")


def pii_by_source(spark, sf_dir):
    """Every kind that the US pack finds, by source: patterns, checks, contexts and overlaps."""
    spans = profile.span_rows(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("text"), get_pack("en-US"))
    return spans.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


def doc_cards_luhn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]{4}"))
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), F.lit(0))).alias("number"))
    return runs.withColumn("valid", packs.CARD.check(F.col("number"))).groupBy("doc_id").agg(F.count_if("valid").alias("cards"), F.count(F.lit(1)).alias("runs"))


def page_visible_words(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.word_count(text.page_text(F.col("html"))).alias("words"))


def speakers_top10(spark, sf_dir):
    chats_ = table(spark, sf_dir, "conversations").select(F.lit("all").alias("path"), F.col("role").alias("name"), F.struct("conv_id", "turn").alias("seq"))
    return profile.speakers(chats_).select(F.col("name").alias("role"), "n", "rank")


def message_counts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter(~text.is_blank(F.col("text")))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(text.word_count(F.col("text"))).alias("words"))


def message_langs_hinglish(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.lit("all").alias("path"), F.struct("conv_id", "turn").alias("seq"), F.col("text").alias("value"))
    return profile.message_languages(rows, get_pack("hi-Latn-IN")).select(F.col("key").alias("lang"), "n")


def lang_mix(spark, sf_dir):
    mix = F.array_join(text.lang_mix(F.col("text"), get_pack("hi-Latn-IN")), "+").alias("mix")
    return table(spark, sf_dir, "documents").select(mix).groupBy("mix").agg(F.count(F.lit(1)).alias("n"))


def normalized_plain(spark, sf_dir):
    plain = packs.Pack("plain", languages=("xx",))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_text(F.col("text"), plain).alias("normal"))


def normalized_text_en(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_text(F.col("text"), get_pack("en-US")), 256).alias("normal_sha256"))


def budget_prefix_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return profile.within_budget(docs, "source", "doc_id", F.col("n_chars"), TABLE_CHARS)


def id_columns_tools(spark, sf_dir):
    """Identifier columns of every table, and the lookups that the first three of them offer."""
    rows = []
    for t in TABLES:
        ids, _, tools = names.tools(t, table(spark, sf_dir, t).columns)
        rows += [(t, c, tools[i] if i < len(tools) else None) for i, c in enumerate(ids)]
    return spark.createDataFrame(rows, "table_name string, column_name string, tool string")


def table_pii_by_column(spark, sf_dir):
    """Cells of customers and events, unpivoted and scanned with their column's name as context."""
    out = None
    for name, seq in (("customer", "c_custkey"), ("events", "event_id")):
        rows = table(spark, sf_dir, name)
        # An array of pairs, as generated code for unpivoted columns doesn't compile beside the patterns' expressions.
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in rows.columns])
        cells = rows.select(F.lit(name).alias("path"), F.col(seq).alias("seq"), F.inline(pairs)).filter("value <> ''")
        out = cells if out is None else out.unionByName(cells)
    return profile.cell_pii(out, get_pack("en-US")).select("path", "name", "type", "n")


def json_cells(spark, sf_dir):
    """Scalars in the events' JSON, by dotted name and type."""
    cells = chats.json_cells(table(spark, sf_dir, "events").select("event_id", "props"), "event_id", "props")
    return cells.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("different"), F.min("value").alias("least"))


def turn_order_check(spark, sf_dir):
    """The first turn of each conversation that is out of order, by made-up times of its turns."""
    start = ((F.col("turn") * 7 + F.col("conv_id")) % 5 + F.col("turn")).cast("double")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", start.alias("start"), (start + 3).alias("end"), F.lit(True).alias("overlap")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return whole.select("conv_id", rules.order_rules(F.col("turns")).alias("message"))


def dup_ids(spark, sf_dir):
    """Second and later documents of one text, as records of one id."""
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.md5("text").alias("id"))
    return validate.duplicate_ids(records).select("line", "conv_id", "field", "message")


def coverage_full_outer(spark, sf_dir):
    """Documents as records of a split against the splits that labels list: issues by kind."""
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "en", "train").otherwise("test").alias("value"))
    split = F.when(F.col("quality") == 1, "train").when(F.col("toxic") == 1, "val").otherwise("test")
    listed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("place"), (F.col("doc_id") + F.when(F.col("doc_id") % 9 == 0, 1_000_000).otherwise(0)).cast("string").alias("listed_id"), split.alias("split"))
    return validate.split_issues(records, listed).groupBy("field", "message").agg(F.count(F.lit(1)).alias("n"))


def redaction_rescan(spark, sf_dir):
    """E-mail addresses that are still in messages: where, not what."""
    turns = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@")))
    spans = profile.span_rows(turns.select("doc_id", "text"), F.col("text"), MAIL)
    return spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("left"))


def decisions(spark, sf_dir):
    """Every goal's state, for one summary per source of documents taken as messages."""
    docs = table(spark, sf_dir, "documents")
    summaries = docs.groupBy(F.col("source").alias("summary_id")).agg(
        (F.count(F.lit(1)) * 10).alias("chat_messages"), (F.count_if(F.col("lang") != "en") * 10).alias("non_english_messages"), (F.sum("n_chars") / 10_000).alias("audio_hours")
    )
    return decision_matrix(summaries).drop("verified")


def whatsapp_sessionise(spark, sf_dir):
    """Messages put together again from the lines of a chat export."""
    turns = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("12/03/24, 10:15 - "), F.col("role"), F.lit(": "), F.col("text"))
    whole = turns.groupBy(F.col("conv_id").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", body.alias("b")))), lambda x: x["b"]), "\n").alias("value"))
    found = chats.export_messages(chats.lines_of(whole))
    return found.groupBy("speaker").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("body")).cast("long").alias("chars"))


def stream_rescan(spark, sf_dir):
    """The e-mail scan over a stream of documents, run until it has caught up."""
    return rescan.rescan_once(spark, f"{sf_dir}/documents.parquet", get_pack("en"))


def stream_duplicates(spark, sf_dir):
    """Events of a stream, each id once within the watermark, counted by the hour."""
    return rescan.hourly_once(spark, f"{sf_dir}/events.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        words_by_lang, doc_words, doc_pii_email, pii_by_source, doc_cards_luhn, page_visible_words, speakers_top10, message_counts, message_langs_hinglish, lang_mix,
        normalized_plain, normalized_text_en, budget_prefix_rows, id_columns_tools, table_pii_by_column, json_cells, turn_order_check, dup_ids, coverage_full_outer,
        redaction_rescan, decisions, whatsapp_sessionise, stream_rescan, stream_duplicates,
    )
    return {f.__name__: f for f in own} | golden.queries()


_WORD = r"[\p{L}\p{N}_]+"
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_BLOCKS = "|".join(text.BLOCKS)


def _page_sql(html: str) -> str:
    out = html
    for tag in text.HIDDEN_TAGS:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)</?(?:{_BLOCKS})\\b[^>]*>', E'\\n\\n', 'g')"
    return f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"


def _hinglish_sql(column: str) -> str:
    words = f"list_transform(regexp_extract_all({column}, '[A-Za-z]+'), lambda w: lower(w))"
    listed = ", ".join(f"'{w}'" for w in sorted(text.ROMAN_HINDI))
    return f"len(regexp_extract_all({column}, '[\\x{{0900}}-\\x{{097F}}]')) AS deva, len({words}) AS words, len(list_filter({words}, lambda w: w IN ({listed}))) AS hits, len(regexp_extract_all({column}, '[A-Za-z]')) AS latin"


_LANG = "CASE WHEN deva > 0 AND deva >= latin THEN 'hi' WHEN hits > 0 AND hits / words >= 0.2 THEN 'hi-Latn' ELSE 'en-IN' END"


def oracle_sql() -> dict[str, str]:
    words = f"len(regexp_extract_all(text, '{_WORD}'))"
    luhn = (
        "list_sum(list_transform(range(len(n)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(n[len(n) - i] AS INT) "
        "ELSE CASE WHEN CAST(n[len(n) - i] AS INT) > 4 THEN CAST(n[len(n) - i] AS INT) * 2 - 9 ELSE CAST(n[len(n) - i] AS INT) * 2 END END)) % 10 = 0"
    )
    key = lambda c: f"trim(regexp_replace(lower({c}), '[^0-9a-z]+', '_', 'g'), '_')"
    bars = ", ".join(f"('{g}', '{b.unit}', {b.floor}, {'NULL' if b.target is None else b.target})" for g, b in BARS.items())
    return {
        "words_by_lang": f"SELECT lang, count(*) AS docs, CAST(sum({words}) AS BIGINT) AS words, max(n_chars) AS longest FROM documents GROUP BY lang",
        "doc_words": f"SELECT doc_id, CAST({words} AS BIGINT) AS words FROM documents",
        "doc_pii_email": f"SELECT * FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '{_EMAIL}')) AS BIGINT) AS emails FROM documents) WHERE emails > 0",
        "doc_cards_luhn": f"WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{13,19}}')) AS n FROM documents) SELECT doc_id, count(*) FILTER (WHERE {luhn}) AS cards, count(*) AS runs FROM runs GROUP BY doc_id",
        "page_visible_words": f"SELECT page_id, CAST(len(regexp_extract_all({_page_sql('html')}, '{_WORD}')) AS BIGINT) AS words FROM pages",
        "speakers_top10": "SELECT role, n, CAST(row_number() OVER (ORDER BY n DESC, first) AS INT) AS rank FROM (SELECT role, count(*) AS n, min((conv_id, turn)) AS first FROM conversations GROUP BY role) QUALIFY rank <= 10",
        "message_counts": rf"SELECT conv_id, count(*) AS messages, CAST(sum({words}) AS BIGINT) AS words FROM conversations WHERE regexp_matches(text, '\S') GROUP BY conv_id",
        "message_langs_hinglish": rf"SELECT {_LANG} AS lang, count(*) AS n FROM (SELECT {_hinglish_sql('text')} FROM conversations WHERE regexp_matches(text, '\S')) GROUP BY 1",
        "lang_mix": (
            f"SELECT lang || CASE WHEN deva > 0 AND lang <> 'hi' THEN '+hi' ELSE '' END || CASE WHEN hits > 0 AND lang <> 'hi-Latn' THEN '+hi-Latn' ELSE '' END || "
            f"CASE WHEN words > hits AND lang <> 'en-IN' THEN '+en-IN' ELSE '' END AS mix, count(*) AS n FROM (SELECT *, {_LANG} AS lang FROM (SELECT {_hinglish_sql('text')} FROM documents)) GROUP BY 1"
        ),
        "normalized_plain": r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s\p{Z}]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS normal FROM conversations",
        "budget_prefix_rows": (
            f"SELECT source, doc_id, n_chars FROM (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b <= {TABLE_CHARS}"
        ),
        "id_columns_tools": (
            "SELECT table_name, column_name, CASE WHEN row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) <= 3 THEN "
            f"'lookup_' || {key('table_name')} || '_by_' || {key('column_name')} END AS tool FROM information_schema.columns "
            f"WHERE table_name IN ({', '.join(repr(t) for t in TABLES)}) AND regexp_matches({key('column_name')}, '{names.ID_HEADER}')"
        ),
        "json_cells": (
            "SELECT key AS name, count(*) AS n, count(DISTINCT value) AS different, min(value) AS least FROM (SELECT e.key, e.value ->> '$' AS value, e.type FROM events, json_each(props) AS e) "
            "WHERE type NOT IN ('NULL', 'BOOLEAN', 'OBJECT', 'ARRAY') GROUP BY key"
        ),
        "turn_order_check": (
            "WITH t AS (SELECT conv_id, turn, CAST((turn * 7 + conv_id) % 5 + turn AS DOUBLE) AS s FROM conversations), "
            "l AS (SELECT *, row_number() OVER w - 1 AS i, lag(s) OVER w AS p FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
            "m AS (SELECT conv_id, i, 'turn ' || i || CASE WHEN s < p THEN ' starts before the turn ahead of it' ELSE ' overlap is true, but it starts at ' || s || ' s and the turn ahead of it ends at ' || (p + 3) || ' s' END AS message "
            "FROM l WHERE s < p OR s >= p + 3) SELECT DISTINCT c.conv_id, x.message FROM conversations c LEFT JOIN (SELECT conv_id, arg_min(message, i) AS message FROM m GROUP BY conv_id) x ON c.conv_id = x.conv_id"
        ),
        "dup_ids": "SELECT doc_id AS line, md5(text) AS conv_id, 'id' AS field, 'duplicate id' AS message FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1",
        "coverage_full_outer": (
            "WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS s FROM documents), "
            "l AS (SELECT CAST(doc_id + CASE WHEN doc_id % 9 = 0 THEN 1000000 ELSE 0 END AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'train' WHEN toxic = 1 THEN 'val' ELSE 'test' END AS s FROM labels), "
            "j AS (SELECT r.s AS said, l.s AS listed, r.id AS rid FROM r FULL OUTER JOIN l ON r.id = l.id) "
            "SELECT CASE WHEN said IS NULL OR listed IS NULL THEN 'splits.json' ELSE 'meta.split' END AS field, CASE WHEN said IS NULL THEN 'names no valid conversation in this manifest' WHEN listed IS NULL THEN 'not assigned to any split' "
            "ELSE 'row says ''' || said || ''', splits.json says ''' || listed || '''' END AS message, count(*) AS n FROM j WHERE said IS NULL OR listed IS NULL OR said <> listed GROUP BY 1, 2"
        ),
        "redaction_rescan": f'SELECT doc_id, CAST(len(regexp_extract_all(text, \'{_EMAIL}\')) AS BIGINT) AS "left" FROM documents WHERE regexp_matches(text, \'{_EMAIL}\')',
        "decisions": (
            f"WITH bars(goal, unit, floor, target) AS (VALUES {bars}), s AS (SELECT source AS summary_id, count(*) * 10 AS m, count(*) FILTER (WHERE lang <> 'en') * 10 AS f, sum(n_chars) / 10000 AS h FROM documents GROUP BY source), "
            "x AS (SELECT summary_id, goal, unit, floor, target, CAST(CASE WHEN unit = 'examples' THEN 0 WHEN unit = 'hours' THEN h WHEN unit = 'seconds' THEN h * 3600 WHEN goal = 'language' THEN f ELSE m END AS DOUBLE) AS have FROM s, bars), "
            "r AS (SELECT *, CASE WHEN goal IN ('knowledge', 'duplex') OR have < floor THEN 0 WHEN have < target OR unit IN ('hours', 'seconds') THEN 1 ELSE 2 END AS rank FROM x) "
            "SELECT summary_id, goal, unit, have, ['blocked', 'baseline_first', 'candidate'][rank + 1] AS state, ['blocked', 'baseline_first', 'candidate'][max(rank) OVER (PARTITION BY summary_id) + 1] AS fine_tune FROM r"
        ),
        "whatsapp_sessionise": "SELECT role AS speaker, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role",
        "stream_rescan": f"SELECT CAST(sum(len(regexp_extract_all(text, '{_EMAIL}'))) AS BIGINT) AS n, 'email' AS type FROM documents WHERE regexp_matches(text, '{_EMAIL}')",
        **golden.oracle_sql(),
        "stream_duplicates": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, ts, event_type FROM events) GROUP BY 1, 2",
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, words and personal data by language: one scan, one exchange."""
    pack = get_pack("en-US")
    docs = table(spark, sf_dir, "documents").select("lang", text.word_count(F.col("text")).alias("words"), F.transform(text.find_pii(F.col("text"), pack), lambda s: s["type"]).alias("kinds"))
    counts = [F.sum(F.size(F.array_remove(F.col("kinds"), k)) * -1 + F.size("kinds")).cast("long").alias(k) for k in dict.fromkeys(p.name for p in pack.all_patterns())]
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("words").alias("words"), *counts).orderBy("lang")


