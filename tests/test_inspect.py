"""A folder of every kind of file: classification, profiles, summary, decisions."""

import json
import struct

import numpy as np
import pytest

from talkgauge.functions.packs import get_pack
from talkgauge.operators.profile import inspect_folder, is_sampled
from talkgauge.sources import files
from talkgauge.plans.recommend import Constraints, SummaryError, decision_matrix, recommend


def wave(path, seconds=2.0, rate=24000, channels=1, silent=0.0):
    t = np.arange(int(seconds * rate)) / rate
    tone = (0.3 * np.sin(2 * np.pi * 440 * t)).astype("<f4")
    tone[: int(len(tone) * silent)] = 0
    data = np.repeat(tone[:, None], channels, 1).tobytes()
    form = struct.pack("<HHIIHH", 3, channels, rate, rate * 4 * channels, 4 * channels, 32)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    put = lambda name, value: ((root / name).parent.mkdir(parents=True, exist_ok=True), (root / name).write_text(value, encoding="utf-8"))
    put("page.html", "<head><title>x</title></head><style>p{}</style><h1>Call us</h1><p>+91 98765 43210 &amp; more</p><p>bye</p>")
    put("page_files/script.js", "var x")
    put("crm.csv", "﻿customer_id,mobile,email,Customer Name\n1,9876543210,a@b.co,Ann\n2,9876543211,c@d.co,Bob\n\n")
    put("faq.csv", "question,answer\nWhere?,Here.\nWhen?,Now.\n")
    put("pairs.csv", 'input,output,customer_name\nhello,"hi\nthere",Ann\nbye,,Bob\n')
    put("rows.csv", "conv_id,turn_index,Role,Text\n1,0,user,namaste ji\n1,1,agent,hello sir\n1,2,,\n")
    put("chat.jsonl", json.dumps({"messages": [{"role": "user", "content": "hi"}, {"role": "bot", "content": ""}]}) + "\n{BROKEN\n")
    put("wrapped.json", json.dumps({"items": [{"sku": "a", "price": 1, "by": {"phone": "9876543210", "tags": ["x", True, None]}}, {"sku": "b"}]}))
    put("lines.json", '{"question": "a?", "answer": "b"}\n{"question": "c?", "answer": "d"}\n')
    put("dump.sql", "CREATE TABLE IF NOT EXISTS `shop`.`orders` (\n `order_id` int,\n  note text,\n PRIMARY KEY (order_id)\n);\nINSERT INTO orders VALUES (1, 'x@y.co');")
    put("export.txt", "12/03/24, 10:14 - Messages are encrypted\n12/03/24, 10:15 - Priya: hello\nmore\n12/03/24, 10:16 - Sam: haan ji theek hai\n[12/03/24, 10:17] Priya: bye\n")
    put("bad.json", "[{")
    put("deck.pptx", "x")
    put(".hidden.md", "secret")
    put("node_modules/a.md", "no")
    put("labels.csv", "id,text,category\n1,where is it,status\n")
    put("notes.md", "One two.\n\nतीन शब्द हैं\n")
    wave(root / "call.wav", channels=2)
    wave(root / "narrow.wav", rate=8000, silent=0.5)
    put("song.mp3", "xx")
    return inspect_folder(spark, str(root), get_pack("hi-Latn-IN"))


def facts(report, path):
    return next(f["facts"] for f in report["files"] if f["path"] == path)


def test_kinds(report):
    kinds = {f["path"]: (f["kind"], f["format"], f["readable"]) for f in report["files"]}
    assert kinds == {
        "bad.json": ("table", "json", False),
        "call.wav": ("audio", "wav", True),
        "chat.jsonl": ("chat", "jsonl", True),
        "crm.csv": ("table", "csv", True),
        "deck.pptx": ("document", "pptx", False),
        "dump.sql": ("table", "sql", True),
        "export.txt": ("chat", "whatsapp", True),
        "faq.csv": ("document", "csv", True),
        "labels.csv": ("table", "csv", True),
        "lines.json": ("document", "jsonl", True),
        "narrow.wav": ("audio", "wav", True),
        "notes.md": ("document", "md", True),
        "page.html": ("document", "html", True),
        "pairs.csv": ("chat", "csv", True),
        "rows.csv": ("chat", "csv", True),
        "song.mp3": ("audio", "mp3", False),
        "wrapped.json": ("table", "json", True),
    }
    assert [f["path"] for f in report["files"]] == sorted(kinds)


def test_profiles(report):
    assert facts(report, "page.html") == {"words": 7, "languages": {"en-IN": 3}, "pii": {"phone": 1}}
    crm = facts(report, "crm.csv")
    assert crm["tables"]["crm"]["pii_columns"] == {"mobile": {"phone": 2}, "email": {"email": 2}, "Customer Name": {"person_name": 2}}
    assert crm["tables"]["crm"]["rows"] == 2 and crm["tables"]["crm"]["id_columns"] == ["customer_id", "email"]
    assert facts(report, "faq.csv")["faq_pairs"] == 2
    pairs = facts(report, "pairs.csv")
    assert pairs["messages"] == 3 and pairs["speakers"] == {"input": 2, "output": 1} and pairs["pii_columns"] == {"customer_name": {"person_name": 2}}
    rows = facts(report, "rows.csv")
    assert rows["messages"] == 2 and rows["message_languages"] == {"hi-Latn": 1, "en-IN": 1}
    chat = facts(report, "chat.jsonl")
    assert chat["messages"] == 2 and chat["parse_errors"][0].startswith("line 2:")
    wrapped = facts(report, "wrapped.json")["tables"]["wrapped"]
    assert wrapped["columns"] == ["sku", "price", "by"] and wrapped["rows"] == 2 and wrapped["pii_columns"] == {"by.phone": {"phone": 1}}
    dump = facts(report, "dump.sql")
    assert dump["tables"]["orders"]["columns"] == ["order_id", "note"] and dump["pii"] == {"email": 1}
    export = facts(report, "export.txt")
    assert export["messages"] == 3 and export["speakers"] == {"Priya": 2, "Sam": 1}
    assert facts(report, "labels.csv")["tables"]["labels"]["labelled_texts"] == ["text", "category"]
    assert facts(report, "notes.md") == {"words": 7, "languages": {"en-IN": 1, "hi": 1}, "pii": {}}
    narrow = facts(report, "narrow.wav")
    assert narrow["narrowband"] and narrow["silence_ratio"] == 0.5 and narrow["duration_s"] == 2.0 and not narrow["stats_partial"]
    assert facts(report, "call.wav")["channels"] == 2


def test_summary(report):
    s = report["summary"]
    assert s["counts"] == {"document": 5, "table": 5, "chat": 4, "audio": 3, "other": 0}
    assert s["profiled"] == {"document": 4, "table": 4, "chat": 4, "audio": 2, "other": 0}
    assert s["unreadable"] == 3 and s["chat_messages"] == 10 and s["two_channel_audio_files"] == 1 and s["labelled_text_tables"] == 1
    assert s["audio_hours"] == round(4 / 3600, 4)
    assert "lookup_crm_by_customer_id" in s["tool_candidates"]
    assert not is_sampled(report)


def test_recommend(report):
    rec = recommend(report["summary"], get_pack("hi-Latn-IN"))
    assert rec.goals == ["tools", "workflow", "recognition", "knowledge", "language"] and rec.primary_problem == "tools"
    assert rec.fine_tune == "blocked" and {d.eligibility for d in rec.goal_decisions} == {"blocked"}
    assert rec.consent[0].startswith("call recordings: consent rule for hi-Latn-IN is 'notice_required'")


def summary(**more):
    return {"counts": {"chat": 1}, "profiled": {"chat": 1}, "chat_messages": 1000, "languages": {"en-US": 5}, "chat_languages": {"en-US": 1000}} | more


def test_states():
    us = get_pack("en-US")
    rec = recommend(summary(), us, Constraints(gpu="24"))
    d = rec.decision("workflow")
    assert d.eligibility == "candidate" and d.recipe == "lfm25-audio" and rec.fine_tune == "candidate"
    assert recommend(summary(chat_messages=300), us).decision("workflow").eligibility == "baseline_first"
    assert recommend(summary(chat_messages=100), us).decision("workflow").eligibility == "blocked"
    duplex = recommend(summary(), us, Constraints(duplex=True))
    assert duplex.primary_problem == "duplex" and duplex.decision("duplex").recipe == "moshi-lora" and duplex.decision("duplex").blockers
    hours = recommend(summary(audio_hours=30.0, profiled={"audio": 2}), us, Constraints(goals=("recognition",)))
    assert hours.decision("recognition").eligibility == "baseline_first"
    assert recommend({}, us).next_steps[0].startswith("nothing here is evidence yet")
    old = recommend({"chat_messages": 1000, "languages": {"hi": 3, "en": 1}}, get_pack("hi-Latn-IN"), Constraints(goals=("language",)))
    assert old.decision("language").have == 750 and old.decision("language").eligibility == "baseline_first"
    with pytest.raises(SummaryError):
        recommend({"counts": 5}, us)


def test_matrix_agrees(spark):
    cases = [(i, m, f, h) for i, (m, f, h) in enumerate([(0, 0, 0.0), (100, 100, 5.0), (300, 250, 15.0), (1000, 0, 2000.0)])]
    rows = decision_matrix(spark.createDataFrame(cases, "summary_id long, chat_messages long, non_english_messages long, audio_hours double")).collect()
    us = get_pack("en-US")
    for i, m, f, h in cases:
        given = summary(chat_messages=m, chat_languages={"fr": f, "en": m - f}, audio_hours=h, two_channel_audio_files=1)
        for r in (r for r in rows if r.summary_id == i):
            d = recommend(given, us, Constraints(goals=(r.goal,))).decision(r.goal)
            assert r.have == d.have and r.state == d.eligibility, (r, d)


def test_registered_profiler(spark, tmp_path):
    """A profiler of one's own for a kind: its facts and texts are reported, and errors stay with their file."""

    def shout(form, content, facts, stem):
        if b"bad" in content:
            raise ValueError("no shouting")
        facts["letters"] = len(content)
        return [("text", None, content.decode().upper() + f" {stem}@x.example")]

    (tmp_path / "a.md").write_text("hello there")
    (tmp_path / "b.md").write_text("bad")
    before = files.PROFILERS["document"]
    files.register_profiler("document", shout)
    try:
        report = inspect_folder(spark, str(tmp_path), get_pack("en-US"))
    finally:
        files.register_profiler("document", before)
    assert facts(report, "a.md") == {"words": 5, "languages": {"en-US": 1}, "pii": {"email": 1}, "letters": 11}
    assert [f.get("error") for f in report["files"]] == [None, "ValueError: no shouting"]
