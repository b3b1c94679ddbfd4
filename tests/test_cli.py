"""The command line and the page."""

import json

import pytest

from talkgauge.cli import load_config, main
from talkgauge.plans.page import render, sentence


def test_project_to_page(spark, tmp_path, capsys):
    project = tmp_path / "shop"
    assert main(["init", str(project), "-l", "hi-Latn-IN", "-l", "en-US"]) == 0
    assert load_config(project) == {"name": "shop", "locales": ["hi-Latn-IN", "en-US"]}
    assert main(["init", str(project), "-l", "en"]) == 2 and main(["init", str(tmp_path / "x"), "-l", "nope"]) == 2
    raw = project / "data/raw"
    (raw / "faq.md").write_text("kya haal hai <b>\n\ncall +91 98765 43210", encoding="utf-8")
    (raw / "chat.txt").write_text("".join(f"12/03/24, 10:1{i} - Priya Secret: theek hai\n" for i in range(4)), encoding="utf-8")
    report, rec, page = (str(tmp_path / x) for x in ("inspect.json", "rec.json", "out/page.html"))
    assert main(["inspect", str(raw), "-o", report]) == 0
    told = json.loads(open(report, encoding="utf-8").read())
    assert told["locale"] == "hi-Latn-IN" and told["summary"]["chat_messages"] == 4
    assert main(["recommend", report, "-o", rec, "--gpu", "24"]) == 0
    assert main(["report", report, rec, "-o", page]) == 0
    html = open(page, encoding="utf-8").read()
    assert "Priya" not in html and str(raw) not in html and "Next steps" in html and "<h1>raw</h1>" in html
    assert "hi-Latn-IN" in capsys.readouterr().out


@pytest.mark.parametrize("argv", [["inspect", "/nowhere"], ["recommend", "/nowhere.json"], ["recommend", "/tmp", "-g", "x"], ["recommend", "/tmp", "--gpu", "7"], ["locales", "zz"], ["validate", "/nowhere"]])
def test_wrong_use(argv, capsys):
    assert main(argv) == 2 and capsys.readouterr().err


def test_wrong_reports(tmp_path):
    bad = tmp_path / "bad.json"
    for text in ("[]", "{", "{}", '{"locale": []}', '{"locale": "en-US", "summary": {"counts": 5}}'):
        bad.write_text(text)
        assert main(["recommend", str(bad), "-o", str(tmp_path / "r.json")]) == 2
        assert main(["report", str(bad), "-o", str(tmp_path / "r.html")]) == 2


def test_small_commands(tmp_path, capsys):
    assert main(["locales"]) == 0 and main(["locales", "en-GB"]) == 0 and main(["schema"]) == 0
    out = capsys.readouterr().out
    assert "quid" in out and '"additionalProperties": false' in out
    assert main(["schema", "-o", str(tmp_path / "a/s.json")]) == 0


def test_page_escapes():
    counts = dict.fromkeys(("document", "table", "chat", "audio", "other"), 0)
    summary = {"counts": counts, "profiled": counts, "unreadable": 1, "truncated": 0, "document_words": 2002646, "chat_messages": 0, "audio_hours": 0.0, "two_channel_audio_files": 0}
    summary |= {"languages": {"<i>": 1}, "chat_languages": {}, "pii": {}, "tool_candidates": ["<script>"], "labelled_text_tables": 0}
    page = render({"root": "/a/b<c", "locale": "en", "summary": summary, "files": [{"path": "<img>", "kind": "other", "format": "x", "readable": False}]})
    assert "<script>" not in page and "<img>" not in page and "<i>" not in page.replace('<i style', "") and "2 002 646" in page
    assert sentence("lfm25-audio fits, arXiv 2305.11206 has 12345") == "lfm25-audio fits, arXiv 2305.11206 has 12 345"
