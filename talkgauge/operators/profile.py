"""Profiles of a folder's files: words, languages, personal data, speakers, identifier columns.

One plan for all files: texts, cells and messages are rows keyed by file, every count is a grouped
aggregate, and what reaches the driver is one row per file and counted thing. Counters are ordered by count and,
among equals, by first occurrence, so every aggregate carries the least ordinal at which its key was seen.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgauge.functions import names, text
from talkgauge.functions.packs import Pack
from talkgauge.functions.patterns import to_java
from talkgauge.sources.files import TABLE_CHARS, parts

#: Kinds in report order, speakers that a report names, version of the report.
KINDS = ("document", "table", "chat", "audio", "other")
SPEAKERS_SHOWN = 10
REPORT_VERSION = "0.1"


def counted(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` counted by key: n, and first, the least of the ``order`` columns at which the key occurs."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))


def within_budget(rows: DataFrame, group: str, order: str, size: Column, budget: int = TABLE_CHARS) -> DataFrame:
    """Rows of each group that begin within the budget: the sizes of those before them add up to at most ``budget``."""
    before = F.sum(size).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("before_", F.coalesce(before, F.lit(0))).filter(F.col("before_") <= budget).drop("before_")


def span_rows(rows: DataFrame, value: Column, pack: Pack, cue: Column | None = None) -> DataFrame:
    """One row per personal datum in ``value``: place (its number) and type. A cue before the text is context only."""
    whole = F.concat(cue, value) if cue is not None else value
    spans = text.find_pii(whole, pack)
    if cue is not None:
        spans = F.filter(spans, lambda s: s["start"] >= F.length(cue))
    return rows.select("*", F.posexplode(F.transform(spans, lambda s: s["type"])).alias("place", "type"))


def cell_cue(column: Column) -> Column:
    return F.concat(text.stripped(F.regexp_replace(column, to_java(r"[\W_]+"), " ")), F.lit(": "))


def cell_pii(cells: DataFrame, pack: Pack) -> DataFrame:
    """(path, name, type, n, first) from cells (path, seq, name, value): by pattern with the column as cue, and by header."""
    by_header = cells.withColumn("type", names.header_kind_column(F.col("name"))).filter(F.col("type").isNotNull() & ~text.is_blank(F.col("value")))
    by_header = by_header.select("path", "name", "type", "seq", F.lit(-1).alias("place"))
    by_pattern = span_rows(cells, F.col("value"), pack, cell_cue(F.col("name"))).select("path", "name", "type", "seq", "place")
    return counted(by_header.unionByName(by_pattern), ["path", "name", "type"], [F.col("seq"), F.col("place")])


def text_facts(texts: DataFrame, pack: Pack) -> tuple[DataFrame, DataFrame]:
    """From texts (path, value): (path, words), and counts (path, what, key, n, first) of languages and personal data."""
    words = texts.select("path", text.word_count(F.col("value")).alias("words"))
    sampled = F.slice(text.paragraphs(F.col("value")), 1, text.SAMPLED_PARAGRAPHS)
    langs = texts.select("path", F.posexplode(sampled).alias("seq", "part")).withColumn("key", text.detect_lang(F.col("part"), pack))
    langs = counted(langs.withColumn("what", F.lit("languages")), ["path", "what", "key"], [F.col("seq")])
    pii = span_rows(texts, F.col("value"), pack).select("path", F.lit("pii").alias("what"), F.col("type").alias("key"), F.col("place").alias("seq"))
    return words, langs.unionByName(counted(pii, ["path", "what", "key"], [F.col("seq")]))


def message_text(messages: DataFrame) -> DataFrame:
    """The messages (path, seq, value) of each file as one text, in order, with blank lines between."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda m: m["value"])
    return messages.groupBy("path").agg(F.array_join(ordered, "\n\n").alias("value"))


def speakers(messages: DataFrame, top: int = SPEAKERS_SHOWN) -> DataFrame:
    """(path, name, n, rank) of the speakers with the most messages."""
    found = counted(messages, ["path", "name"], [F.col("seq")])
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("n"), "first"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)


def message_languages(messages: DataFrame, pack: Pack) -> DataFrame:
    """(path, key, n, first): languages over every message that is not blank."""
    spoken = messages.filter(~text.is_blank(F.col("value"))).withColumn("key", text.detect_lang(F.col("value"), pack))
    return counted(spoken, ["path", "key"], [F.col("seq")])


def _most_common(rows) -> dict[str, int]:
    return {k: n for k, n, _ in sorted(rows, key=lambda r: (-r[1], r[2]))}


def inspect_folder(spark: SparkSession, root: str, pack: Pack, on_file: Callable[[int, int, str], None] | None = None) -> dict:
    """The report on a folder. ``on_file(done, total, path)`` is called for every file as its facts are put together."""
    found = parts(spark, root).persist()
    try:
        return _report(found, root, pack, on_file)
    finally:
        found.unpersist()


def _report(found: DataFrame, root: str, pack: Pack, on_file) -> dict:
    of = lambda what: found.filter(F.col("what") == what)
    files = of("file").select("path", "kind", "format", "readable", "note", "value").collect()
    messages = of("message")
    whole = of("text").select("path", "value").unionByName(message_text(messages))
    words, counts = text_facts(whole, pack)
    words = dict(words.collect())
    by_file: dict[tuple[str, str], list] = {}
    for r in counts.collect():
        by_file.setdefault((r.path, r.what), []).append((r.key, r.n, tuple(r.first)))
    for r in message_languages(messages, pack).collect():
        by_file.setdefault((r.path, "message_languages"), []).append((r.key, r.n, tuple(r.first)))
    for r in speakers(messages).collect():
        by_file.setdefault((r.path, "speakers"), []).append((r.name, r.n, tuple(r.first)))
    cells: dict[str, list] = {}
    for r in cell_pii(of("cell").select("path", "seq", "name", "value"), pack).collect():
        cells.setdefault(r.path, []).append((tuple(r.first), r.name, r.type, r.n))
    entries = []
    for done, f in enumerate(sorted(files, key=lambda f: f.path.split("/"))):
        if on_file:
            on_file(done, len(files), f.path)
        entry = {"path": f.path, "kind": f.kind, "format": f.format, "readable": f.readable}
        if f.note:
            entry["note"] = f.note
        facts = json.loads(f.value)
        if "error" in facts:
            entry["readable"] = False
            entry["error"] = facts["error"]
        elif f.readable and f.kind != "other":
            counters = {w: _most_common(by_file.get((f.path, w), [])) for w in ("languages", "pii", "message_languages", "speakers")}
            entry["facts"] = _facts(f, facts, words.get(f.path, 0), counters, cells.get(f.path, []))
        entries.append(entry)
    return {"report_version": REPORT_VERSION, "root": root.rstrip("/"), "locale": pack.id, "summary": summarise(entries), "files": entries}


def _columns(cells: list) -> tuple[dict[str, dict[str, int]], Counter]:
    """Personal data by column, in the order in which the columns first showed some, and in all."""
    by_column: dict[str, Counter] = {}
    for _, name, kind, n in sorted(cells):
        by_column.setdefault(name, Counter())[kind] += n
    total: Counter = sum(by_column.values(), Counter())
    return {c: dict(n.most_common()) for c, n in by_column.items()}, total


def _facts(f, facts: dict, words: int, counters: dict[str, dict[str, int]], cells: list) -> dict:
    """A file's facts in their reported order."""
    by_column, in_cells = _columns(cells)
    if f.kind == "audio":
        return facts
    told = {"words": words, "languages": counters["languages"], "pii": counters["pii"]}
    if f.kind == "document":
        return told | facts
    if f.kind == "table":
        pii = Counter(counters["pii"])
        for name, t in facts["tables"].items():
            if "rows_scanned" in t:
                scanned = t.pop("rows_scanned")
                t |= {"pii_columns": by_column, "rows_scanned": scanned}
            ids, texts, tools = names.tools(name, t["columns"])
            t["id_columns"] = ids
            if texts:
                t["labelled_texts"] = texts
            t["tool_candidates"] = tools
        pii.update(dict(in_cells.most_common()))
        rest = {k: v for k, v in facts.items() if k != "tables"}
        return {"tables": facts["tables"], "pii": dict(pii.most_common())} | rest
    said = dict(Counter(facts.pop("all_speakers")).most_common(SPEAKERS_SHOWN)) if "all_speakers" in facts else counters["speakers"]
    told |= {"messages": facts.pop("messages"), "speakers": said, "message_languages": counters["message_languages"]}
    if in_cells:
        told["pii"] = dict((Counter(told["pii"]) + Counter(dict(in_cells.most_common()))).most_common())
        facts["pii_columns"] = by_column
    return told | facts


def summarise(entries: list[dict]) -> dict:
    """A folder's totals, over the files that yielded facts; counts are of all files found."""
    facts = [(e["kind"], e["facts"]) for e in entries if "facts" in e]
    tables = [t for _, f in facts for t in f.get("tables", {}).values()]
    seconds = sum(f.get("duration_s", 0.0) for k, f in facts if k == "audio")

    def counter(key: str, kinds=KINDS) -> dict[str, int]:
        out: Counter = Counter()
        for kind, f in facts:
            if kind in kinds:
                out.update(f.get(key, {}))
        return dict(out.most_common())

    return {
        "counts": {k: sum(e["kind"] == k for e in entries) for k in KINDS},
        "profiled": {k: sum(kind == k for kind, _ in facts) for k in KINDS},
        "unreadable": sum(not e["readable"] for e in entries),
        "truncated": sum(bool(f.get("truncated")) for _, f in facts),
        "document_words": sum(f.get("words", 0) for k, f in facts if k == "document"),
        "chat_messages": sum(f.get("messages", 0) for k, f in facts if k == "chat"),
        "audio_hours": round(seconds / 3600, 4),
        "two_channel_audio_files": sum(f.get("channels") == 2 for k, f in facts if k == "audio"),
        "languages": counter("languages"),
        "chat_languages": counter("message_languages", ("chat",)),
        "pii": counter("pii"),
        "tool_candidates": list(dict.fromkeys(c for t in tables for c in t["tool_candidates"])),
        "labelled_text_tables": sum("labelled_texts" in t for t in tables),
    }


def is_sampled(report: dict) -> bool:
    """Whether some file was checked only in part."""
    facts = [e.get("facts", {}) for e in report["files"]]
    scanned = [t for f in facts for t in f.get("tables", {}).values() if "rows_scanned" in t]
    return any(t["rows_scanned"] < t["rows"] for t in scanned) or any("messages_scanned" in f or f.get("truncated") for f in facts)


def write_report(report: dict, path: str) -> str:
    """The report as indented JSON in UTF-8; folders are made as needed."""
    from pathlib import Path

    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps(report, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return str(out)
