"""The rules of a conversation record that go beyond its shape, as columns over the parsed record.

A rule is a condition and what is said if it holds. Rules of one part (the recording, a turn, the provenance) are tried
in order and the first that holds is reported; a part whose shape is wrong is null, and no rule holds for it. The
rules across turns are tried on records that have no other issue. All of them look at one record, so no
row leaves its task: order is read from the neighbour in the array, and the life of a tool call from the
place at which an id first occurs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much longer than its recording a conversation may seem, in seconds.
SLACK_SECONDS = 0.5

#: A record as the walk over its shape leaves it; free-form values stay JSON.
RECORD = (
    "id string, locale string, system_prompt string, "
    "audio struct<path:string,sample_rate:long,channels:int,channel_map:map<string,string>,duration_s:double>, "
    "tools array<struct<name:string,parameters:string>>, "
    "turns array<struct<speaker:string,start:double,end:double,text:string,lang:string,lang_mix:array<string>,overlap:boolean,"
    "entities:array<struct<text:string,start_char:long,end_char:long>>,call:struct<id:string,name:string,arguments:string>,result:struct<id:string,content:string>>>, "
    "meta struct<source:string,consent:string,consent_ref:string,allowed_uses:array<string>,voice_consent_ref:string,license:string,pii_redacted:boolean,redaction_log:string,split:string>"
)
#: A redaction log likewise.
LOG = (
    "conversation_id string, spans array<struct<type:string,field:string,turn:long,placeholder:string,start:long,end:long,"
    "audio:struct<start_s:double,end_s:double,method:string>>>"
)


def first_broken(*rules: tuple[Column, Column | str], of: Column | None = None) -> Column:
    """What the first rule says whose condition holds; null if none does, or the part ``of`` is null. An unknown condition doesn't hold."""
    said = F.coalesce(*[F.when(holds, F.lit(says) if isinstance(says, str) else says) for holds, says in rules])
    return said if of is None else F.when(of.isNotNull(), said)


def first_found(items: Column) -> Column:
    """The first element that is not null."""
    return F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))


def _missing(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _said(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *[v.cast("string") for v in values])


def path_rules(path: Column, name: str) -> list[tuple[Column, Column | str]]:
    """A path that stays below the manifest's folder as far as its spelling tells."""
    plain = F.translate(path, "\\", "/")
    return [
        (F.trim(path) == "", f"{name} is blank"),
        (plain.startswith("/") | path.rlike("^[A-Za-z]:"), _said(f"{name} has to be relative to the manifest: '%s'", path)),
        (F.array_contains(F.split(plain, "/"), ".."), _said(f"{name} goes up a folder ('..'): '%s'", path)),
    ]


def audio_rules(audio: Column) -> Column:
    channels, given = audio["channels"], audio["channel_map"]
    expected = F.transform(F.sequence(F.lit(0), channels - 1), lambda i: i.cast("string"))
    return first_broken(
        *path_rules(audio["path"], "audio.path"),
        ((channels == 2) & given.isNull(), "two channels need a channel_map that says who is on which"),
        (F.array_sort(F.map_keys(given)) != expected, _said("channel_map has to name each of the channels %s once", F.array_join(expected, ", "))),
        ((channels == 2) & (F.array_sort(F.map_values(given)) != F.array(F.lit("agent"), F.lit("user"))), "of two channels, one is the user's and the other the agent's"),
        of=audio,
    )


def entity_rules(entity: Column, place: Column, text: Column) -> Column:
    """Offsets cut the entity's text out of the turn's. What is said never repeats either."""
    begin, end = entity["start_char"], entity["end_char"]
    cut = F.substring(text, begin.cast("int") + 1, (end - begin).cast("int"))
    here = F.concat(F.lit("entity "), place.cast("string"), F.lit(": "))
    said = first_broken(
        (begin.isNull() != end.isNull(), "one offset is set and the other is not"),
        ((begin < 0) | (end < begin), _said("offsets %s to %s are no stretch of text", begin, end)),
        (end > F.length(text), _said("end_char %s lies past the turn's text", end)),
        (cut != entity["text"], _said("offsets %s to %s don't cut out the entity's text", begin, end)),
    )
    return F.concat(here, said)


def turn_rules(turn: Column) -> Column:
    call, result, text = turn["call"], turn["result"], F.coalesce(turn["text"], F.lit(""))
    mix = F.coalesce(turn["lang_mix"], F.array().cast("array<string>"))
    calls, answers = call.isNotNull(), result.isNotNull()
    spoken = ~calls & ~answers
    return first_broken(
        (turn["end"] < turn["start"], _said("ends at %s s, before its start at %s s", turn["end"], turn["start"])),
        (calls & answers, "holds a tool_call and a tool_result; only one is possible"),
        (calls & (turn["speaker"] != "agent"), "only the agent calls tools"),
        (answers & (turn["speaker"] != "tool"), "only a tool gives results"),
        (~answers & (turn["speaker"] == "tool"), "a tool's turn needs its tool_result"),
        (spoken & _missing(turn["text"]), "a spoken turn needs text"),
        (spoken & _missing(turn["lang"]), "a spoken turn needs lang (a BCP-47 tag)"),
        (F.size(F.array_distinct(mix)) < F.size(mix), "lang_mix names a language twice"),
        ((F.size(mix) > 0) & ~F.coalesce(F.get(mix, F.lit(0)) == turn["lang"], F.lit(False)), "lang_mix has to begin with the turn's lang"),
        (F.lit(True), first_found(F.transform(turn["entities"], lambda e, k: entity_rules(e, k, text)))),
        of=turn,
    )


def provenance_rules(meta: Column) -> Column:
    real, consent = meta["source"] == "real", meta["consent"]
    return first_broken(
        (consent.isin("recorded_verbal", "written") & _missing(meta["consent_ref"]), "this consent needs consent_ref: the recording or the form"),
        ((consent == "public_license") & _missing(meta["license"]), "data under a public licence has to name it in license"),
        ((consent == "synthetic") & (meta["source"] != "synthetic"), _said("synthetic consent belongs to synthetic data, not to source '%s'", meta["source"])),
        *[(~_missing(meta["redaction_log"]) & holds, says) for holds, says in path_rules(meta["redaction_log"], "meta.redaction_log")],
        (F.size(meta["allowed_uses"]) == 0, "allowed_uses is empty: nothing may be done with this record"),
        (F.array_contains(meta["allowed_uses"], "voice_clone") & real & _missing(meta["voice_consent_ref"]), "cloning a real voice needs voice_consent_ref, the speaker's own consent"),
        (real & ~meta["pii_redacted"], "real data has to be redacted first (pii_redacted)"),
        (real & _missing(meta["redaction_log"]), "redacted real data needs its redaction_log"),
        of=meta,
    )


def order_rules(turns: Column) -> Column:
    """Starts never go back, and overlap says whether a turn starts before the one ahead of it has ended."""

    def rules(turn: Column, i: Column) -> Column:
        ahead = F.get(turns, i - 1)
        said = first_broken(
            (turn["start"] < ahead["start"], "starts before the turn ahead of it"),
            (turn["overlap"] != (turn["start"] < ahead["end"]), _said("overlap is %s, but it starts at %s s and the turn ahead of it ends at %s s", turn["overlap"], turn["start"], ahead["end"])),
        )
        return F.concat(F.lit("turn "), i.cast("string"), F.lit(" "), said)

    return first_found(F.transform(turns, rules))


def tool_rules(turns: Column, tools: Column) -> Column:
    """Tools have different names; a call has an id of its own and names a tool; a result answers an earlier call, once."""
    names = F.transform(tools, lambda x: x["name"])
    call_ids, answered = F.transform(turns, lambda t: t["call"]["id"]), F.transform(turns, lambda t: t["result"]["id"])

    def earlier(ids: Column, value: Column, i: Column) -> Column:
        return F.array_position(ids, value).between(1, i)

    twice = first_found(F.transform(tools, lambda x, i: F.when(earlier(names, x["name"], i), _said("tool %s has the name of an earlier one, '%s'", i, x["name"]))))

    def rules(turn: Column, i: Column) -> Column:
        call, result = turn["call"], turn["result"]
        said = first_broken(
            (earlier(call_ids, call["id"], i), _said("calls with the id of an earlier call, '%s'", call["id"])),
            (call.isNotNull() & ~F.array_contains(names, call["name"]), _said("calls '%s', which is not among tools", call["name"])),
            (result.isNotNull() & ~earlier(call_ids, result["id"], i), _said("answers '%s', which no earlier turn calls", result["id"])),
            (earlier(answered, result["id"], i), _said("answers '%s' a second time", result["id"])),
        )
        return F.concat(F.lit("turn "), i.cast("string"), F.lit(" "), said)

    given = lambda ids: F.filter(ids, lambda x: x.isNotNull())
    last = F.element_at(turns, -1)["call"]["id"]
    left = F.array_sort(F.array_except(given(call_ids), F.concat(given(answered), given(F.array(last)))))
    unanswered = F.when(F.size(left) > 0, _said("never answered, though the conversation goes on: %s", F.array_join(left, ", ")))
    return F.coalesce(twice, first_found(F.transform(turns, rules)), unanswered)


def length_rules(turns: Column, audio: Column) -> Column:
    end = F.array_max(F.transform(turns, lambda t: t["end"]))
    return first_broken((end > audio["duration_s"] + SLACK_SECONDS, _said("turns go on to %s s, the recording to %s s", end, audio["duration_s"])))


def record_rules(turns: Column, tools: Column, audio: Column) -> Column:
    """What the first rule across turns says that a record breaks, if its parts are sound."""
    return F.coalesce(order_rules(turns), tool_rules(turns, tools), length_rules(turns, audio))


def span_rules(span: Column) -> Column:
    """Where a redaction log's span can lie."""
    prompt, audio = span["field"] == "system_prompt", span["audio"]
    return first_broken(
        (audio["end_s"] <= audio["start_s"], _said("the masked sound ends at %s s, not after its start at %s s", audio["end_s"], audio["start_s"])),
        (prompt & span["turn"].isNotNull(), "the system prompt is in no turn: leave turn out"),
        (~prompt & span["turn"].isNull(), _said("a span of %s needs its turn", span["field"])),
        (span["start"].isNull() != span["end"].isNull(), "start or end is set without the other"),
        ((span["start"] < 0) | (span["end"] < span["start"]), _said("%s to %s is no stretch of text", span["start"], span["end"])),
    )
