"""Command line: init, validate, schema, inspect, recommend, report, locales. Exit codes: 2 for wrong use or input, 1 for issues found."""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from talkgauge import __version__
from talkgauge.functions.packs import Pack, get_pack, list_packs

CONFIG_NAME = "talkgauge.yaml"
#: Keys that earlier projects may have and nothing reads.
RETIRED_KEYS = ("data_dir",)
IGNORED = "data/ runs/ inspect.json recommend.json report.html .venv/ *.wav *.mp3 *.flac *.ogg *.oga *.opus *.m4a *.safetensors *.bin *.pt *.gguf".split()
FOLDERS = ("data/raw", "data/audio", "configs", "runs")


class Usage(Exception):
    """Wrong use or input: printed, exit code 2."""


def safe_stream(stream) -> None:
    """Characters that the terminal's encoding lacks are replaced, not fatal."""
    if (getattr(stream, "encoding", "") or "").lower().replace("-", "") != "utf8" and hasattr(stream, "reconfigure"):
        stream.reconfigure(errors="replace")


def load_config(folder: Path) -> dict:
    """A project's name and locales: ``key: value`` lines, and lists in brackets or by dashes."""
    out: dict = {}
    key = None
    for line in (folder / CONFIG_NAME).read_text(encoding="utf-8").splitlines():
        line = re.sub(r"(^|\s)#.*", "", line).rstrip()
        if m := re.match(r"\s*-\s+(.*)$", line):
            if key is None:
                raise Usage(f"{CONFIG_NAME}: a list item without a key")
            out[key] = [*(out[key] if isinstance(out[key], list) else []), m[1].strip("'\" ")]
        elif m := re.match(r"(\w+):\s*(.*)$", line):
            key, value = m[1], m[2].strip()
            listed = re.fullmatch(r"\[(.*)\]", value)
            out[key] = [x.strip("'\" ") for x in listed[1].split(",") if x.strip()] if listed else value.strip("'\"")
        elif line.strip():
            raise Usage(f"{CONFIG_NAME}: cannot read {line!r}")
    for k in RETIRED_KEYS:
        out.pop(k, None)
    if set(out) != {"name", "locales"} or not isinstance(out["locales"], list) or not out["locales"]:
        raise Usage(f"{CONFIG_NAME}: needs name and a list of locales, and nothing else")
    return out


def project_locale(path: Path) -> str | None:
    """The first locale of the nearest project at or above ``path``."""
    for folder in (path, *path.parents):
        if (folder / CONFIG_NAME).is_file():
            return load_config(folder)["locales"][0]
    return None


def pack_for(pack_id: str | None, missing: str) -> Pack:
    if pack_id is None:
        raise Usage(f"no locale: {missing}")
    try:
        return get_pack(pack_id)
    except KeyError as e:
        raise Usage(e.args[0]) from None


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("talkgauge").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def read_object(path: str, what: str) -> dict:
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    except (OSError, ValueError) as e:
        raise Usage(f"{path}: cannot read: {e}") from None
    if not isinstance(data, dict):
        raise Usage(f"{path} is not a JSON object; is it {what}?")
    return data


def table(rows: list[tuple[str, str]], title: str) -> None:
    print(title)
    width = max(len(k) for k, _ in rows)
    for k, v in rows:
        print(f"  {k:<{width}}  {v}")


def init(a) -> int:
    folder = Path(a.folder)
    for pack_id in a.locale:
        pack_for(pack_id, "")
    if folder.exists() and (not folder.is_dir() or any(folder.iterdir())):
        raise Usage(f"{folder} is not empty")
    for name in FOLDERS:
        (folder / name).mkdir(parents=True, exist_ok=True)
    (folder / ".gitignore").write_text("\n".join(IGNORED) + "\n", encoding="utf-8")
    (folder / CONFIG_NAME).write_text("\n".join([f"name: {folder.resolve().name}", "locales:", *[f"- {x}" for x in a.locale]]) + "\n", encoding="utf-8")
    print(f"created {folder}")
    return 0


def validate(a) -> int:
    from talkgauge.operators.validate import counts, validate_manifest

    if not Path(a.manifest).is_file():
        raise Usage(f"{a.manifest} does not exist")
    records, issues = validate_manifest(session(), a.manifest, a.allow_unconsented)
    for i in issues.toLocalIterator():
        print(f"{f'line {i.line} ' if i.line else ''}{i.conv_id} · {i.field}: {i.message}{f'  → {i.fix}' if i.fix else ''}")
    n, clean, found = counts(records, issues)
    print(f"{n} conversations, {clean} clean, {found} issues")
    return int(found > 0)


def schema(a) -> int:
    from talkgauge.operators.records import json_schema

    said = json.dumps(json_schema(), indent=2, ensure_ascii=False)
    if a.out:
        Path(a.out).parent.mkdir(parents=True, exist_ok=True)
        Path(a.out).write_text(said + "\n", encoding="utf-8")
    else:
        print(said)
    return 0


def _inspected(path: str, pack: Pack) -> dict:
    from talkgauge.operators.profile import inspect_folder

    progress = (lambda done, total, name: print(f"\r{done + 1}/{total} {name[:60]:<60}", end="", file=sys.stderr)) if sys.stderr.isatty() else None
    return inspect_folder(session(), path, pack, progress)


def inspect(a) -> int:
    from talkgauge.operators.profile import is_sampled, write_report
    from talkgauge.plans.recommend import fmt_kinds

    if not Path(a.folder).is_dir():
        raise Usage(f"{a.folder} is not a folder")
    pack = pack_for(a.locale or project_locale(Path(a.folder).resolve()), f"pass --locale (one of {', '.join(list_packs())}) or run inside a project")
    report = _inspected(a.folder, pack)
    s, join = report["summary"], lambda d: ", ".join(f"{k} {v}" for k, v in d.items())
    hours = s["audio_hours"]
    table(
        [
            ("files", fmt_kinds(s["counts"]) or "none"),
            ("profiled", f"{sum(s['profiled'].values())} of {sum(s['counts'].values())}"),
            ("documents", f"{s['document_words']} words"),
            ("chats", f"{s['chat_messages']} messages"),
            ("audio", f"{f'{hours} h' if hours >= 1 else f'{round(hours * 60, 1)} min'}, {s['two_channel_audio_files']} two-channel file(s)"),
            ("languages", join(s["languages"]) or "-"),
            ("personal data", (join(s["pii"]) or "none found") + (" (large files sampled)" if is_sampled(report) else "")),
            ("tool candidates", ", ".join(s["tool_candidates"][:6]) or "-"),
        ],
        f"{a.folder} · locale {pack.id}",
    )
    for f in report["files"]:
        if not f["readable"]:
            print(f"skipped {f['path']}: {f.get('error') or f.get('note') or 'unsupported type'}", file=sys.stderr)
        elif f.get("facts", {}).get("truncated"):
            print(f"partial {f['path']}: too large to read whole, counts cover the start", file=sys.stderr)
    print(f"wrote {write_report(report, a.out)}")
    return 0


def recommend(a) -> int:
    from talkgauge.operators.profile import write_report
    from talkgauge.plans import recommend as rules

    if bad := [g for g in a.goal if g not in rules.GOALS]:
        raise Usage(f"unknown goal {bad[0]!r}; choose from {', '.join(rules.GOALS)}")
    if a.gpu not in rules.GPU_GB:
        raise Usage(f"--gpu must be one of {', '.join(rules.GPU_GB)}")
    source = Path(a.source)
    if source.is_dir():
        pack = pack_for(a.locale or project_locale(source.resolve()), "pass --locale or run inside a project")
        summary = _inspected(a.source, pack)["summary"]
    else:
        report = read_object(a.source, "an inspect.json")
        if not isinstance(report.get("locale"), (str, type(None))):
            raise Usage(f"{source}: locale: must be a string; is it an inspect.json?")
        pack = pack_for(a.locale or report.get("locale"), "none in the report; pass --locale")
        if "summary" not in report:
            raise Usage(f"{source} has no 'summary'; is it an inspect.json?")
        summary = report["summary"]
    try:
        rec = rules.recommend(summary, pack, rules.Constraints(tuple(a.goal), a.gpu, a.duplex))
    except rules.SummaryError as e:
        raise Usage(f"{source}: summary.{e}; is it an inspect.json?") from None
    rows = [("primary problem", rec.primary_problem or "none yet: no usable evidence"), ("goals", ", ".join(rec.goals) or "-")]
    rows += [(r.source, f"{r.route}  {r.why}") for r in rec.routes]
    table([*rows, ("fine-tune?", f"{rules.VERDICT_LABELS[rec.fine_tune]}  {rec.fine_tune_reason}")], f"recommendation · locale {pack.id}")
    for d in rec.goal_decisions:
        rows = [("fine-tune?", f"{rules.VERDICT_LABELS[d.eligibility]}  {d.reason}")]
        if d.need is not None:
            rows.append((f"data ({d.unit})", f"{rules.fmt_number(d.have)} of ~{rules.fmt_number(d.need)}  from {d.have_from}"))
        rows += [("not counted", x) for x in d.uncounted] + [("blocked on", x) for x in d.blockers]
        rows.append(("recipe", f"{d.recipe or 'none'}  {d.recipe_reason}"))
        if d.recipe_method:
            rows.append(("method", f"{d.recipe_method}  (planned, not yet run)"))
        table([*rows, (f"evidence ({d.confidence})", d.evidence)], f"goal · {d.goal}")
    if rec.consent:
        print("consent and privacy (not legal advice)", *[f"  • {x}" for x in rec.consent], sep="\n")
    print("next steps", *[f"  {i}. {x}" for i, x in enumerate(rec.next_steps, 1)], sep="\n")
    print(f"wrote {write_report({'locale': pack.id, **rec.to_dict()}, a.out)}")
    return 0


def report(a) -> int:
    from talkgauge.plans.page import render

    data, rec = read_object(a.inspect_json, "an inspect.json"), None
    if not isinstance(data.get("summary"), dict) or not isinstance(data.get("files"), list):
        raise Usage(f"{a.inspect_json} has no summary and files; is it an inspect.json?")
    if a.recommend_json:
        rec = read_object(a.recommend_json, "a recommend.json")
        if "goal_decisions" not in rec:
            raise Usage(f"{a.recommend_json} has no goal_decisions; is it a recommend.json?")
        if rec.get("locale") != data.get("locale"):
            print(f"warning: {a.recommend_json} is for locale {rec.get('locale')}, {a.inspect_json} for {data.get('locale')}; are they from the same folder?", file=sys.stderr)
    try:
        page = render(data, rec)
    except (KeyError, TypeError, AttributeError, ValueError) as e:
        raise Usage(f"cannot build the page: {type(e).__name__}: {e}; were both files written by this tool?") from None
    Path(a.out).parent.mkdir(parents=True, exist_ok=True)
    Path(a.out).write_text(page, encoding="utf-8")
    print(f"wrote {a.out}  (open it in a browser; print it to save a PDF)")
    return 0


def locales(a) -> int:
    if a.pack is None:
        for pack_id in list_packs():
            p = get_pack(pack_id)
            print(f"{p.id:<12}{p.name:<20}{p.parent or '-':<8}{', '.join(sorted(p.all_languages())):<28}{p.resolved('call_recording_consent') or '-':<18}{len(p.all_patterns())} PII patterns")
        return 0
    p = pack_for(a.pack, "")
    formats, notes, support = p.resolved("formats"), p.resolved("privacy_notes"), p.resolved("recipe_support")
    print(f"{p.id} {p.name}" + (f"  (inherits {p.parent})" if p.parent else ""))
    print(f"languages: {', '.join(sorted(p.all_languages()))}")
    if formats:
        print(
            f"currency: {' '.join(formats.currency_symbols)} ({', '.join(formats.currency_words)}) · dates {formats.date_order} · "
            f"phone e.g. {formats.phone_example} · postal e.g. {formats.postal_example}"
        )
    print(f"PII: {', '.join(x.name for x in p.all_patterns())}")
    print(f"call-recording consent: {p.resolved('call_recording_consent') or 'not set'}")
    if support:
        print("recipes: " + ", ".join(f"{r}={s}" for r, s in support.items()))
    if notes:
        print(f"privacy (not legal advice): {notes.summary}", *[f"  {x}" for x in notes.links], sep="\n")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="talkgauge", description="Take stock of conversation data with Spark.")
    top.add_argument("--version", action="version", version=f"talkgauge {__version__}")
    commands = top.add_subparsers(dest="command", required=True)

    def command(run, *arguments):
        own = commands.add_parser(run.__name__, help=run.__doc__)
        own.set_defaults(run=run)
        for names, options in arguments:
            own.add_argument(*names, **options)

    locale = (("--locale", "-l"), {"default": None})
    out = lambda default: (("--out", "-o"), {"default": default})
    command(init, (("folder",), {}), (("--locale", "-l"), {"action": "append", "required": True}))
    command(validate, (("manifest",), {}), (("--allow-unconsented",), {"action": "store_true"}))
    command(schema, out(None))
    command(inspect, (("folder",), {}), locale, out("inspect.json"))
    command(recommend, (("source",), {}), (("--goal", "-g"), {"action": "append", "default": []}), (("--gpu",), {"default": "none"}), (("--duplex",), {"action": "store_true"}), locale, out("recommend.json"))
    command(report, (("inspect_json",), {"nargs": "?", "default": "inspect.json"}), (("recommend_json",), {"nargs": "?"}), out("report.html"))
    command(locales, (("pack",), {"nargs": "?"}))
    return top


def main(argv: list[str] | None = None) -> int:
    safe_stream(sys.stdout)
    safe_stream(sys.stderr)
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except Usage as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
