"""Small written inputs, and what the operators must make of them: the inputs of ``golden``'s queries.

What is expected was written from the survey's rules and fixtures, not taken from a run.
"""

from __future__ import annotations

import copy
import json
import struct

import numpy as np

RECORD = {
    "id": "c1",
    "schema_version": "0.1",
    "audio": {"path": "audio/c1.wav", "sample_rate": 24000, "channels": 2, "channel_map": {"0": "user", "1": "agent"}, "duration_s": 2.0, "condition": "phone"},
    "locale": "en-US",
    "language": {"primary": "en-US", "mix": ["en-US"]},
    "tools": [{"name": "book", "parameters": {"type": "object", "properties": {"customer_id": {"type": "string"}}, "required": ["customer_id"]}}],
    "turns": [
        {"speaker": "agent", "start": 0.0, "end": 0.8, "text": "Hi.", "lang": "en-US"},
        {"speaker": "user", "start": 0.9, "end": 1.5, "text": "Book me, ID A-1.", "lang": "en-US", "entities": [{"type": "customer_id", "text": "A-1", "start_char": 12, "end_char": 15}]},
        {"speaker": "agent", "start": 1.5, "end": 1.5, "tool_call": {"id": "k", "name": "book", "arguments": {"customer_id": "A-1"}}},
        {"speaker": "tool", "start": 1.5, "end": 1.5, "tool_result": {"id": "k", "content": {"ok": True}}},
        {"speaker": "agent", "start": 1.6, "end": 2.0, "text": "Done.", "lang": "en-US"},
    ],
    "meta": {"source": "synthetic", "consent": "synthetic", "pii_redacted": True, "split": "train", "created": "2026-09-16T10:12:00Z"},
}


def changed(**paths) -> dict:
    """The record with values at dotted paths (double underscores for dots, n4 for the fifth of a list)."""
    out = copy.deepcopy(RECORD)
    for path, value in paths.items():
        at = out
        *way, last = (int(k[1:]) if k[0] == "n" and k[1:].isdigit() else k for k in path.split("__"))
        for k in way:
            at = at[k]
        at[last] = value
    return out


_T = "turns.1"
_LATE = {"speaker": "agent", "start": 1.6, "end": 2.0}
#: (what is changed, field, message): each breaks one rule of a record.
RULE_CASES = (
    # shapes
    ({"extra": 1}, "extra", "Extra inputs are not permitted"),
    ({"schema_version": "9"}, "schema_version", "Input should be '0.1'"),
    ({"turns": []}, "turns", "List should have at least 1 item after validation, not 0"),
    ({"audio__channels": 3}, "audio.channels", "Input should be less than or equal to 2"),
    ({"turns__n0__end": -1}, "turns.0.end", "Input should be greater than or equal to 0"),
    ({"turns__n1__speaker": "bot"}, "turns.1.speaker", "Input should be 'user', 'agent' or 'tool'"),
    ({"meta__created": "soon"}, "meta.created", "Input should be a valid datetime"),
    ({"locale": None}, "locale", "Input should be a valid string"),
    # the recording
    ({"audio__channel_map": None}, "audio", "two channels need a channel_map that says who is on which"),
    ({"audio__channel_map": {"0": "user", "2": "agent"}}, "audio", "channel_map has to name each of the channels 0, 1 once"),
    ({"audio__channel_map": {"0": "user", "1": "user"}}, "audio", "of two channels, one is the user's and the other the agent's"),
    ({"audio__path": "../x.wav"}, "audio", "audio.path goes up a folder ('..'): '../x.wav'"),
    ({"audio__path": "a\\..\\x.wav"}, "audio", "audio.path goes up a folder ('..'): 'a\\..\\x.wav'"),
    ({"audio__path": "C:x.wav"}, "audio", "audio.path has to be relative to the manifest: 'C:x.wav'"),
    ({"audio__path": "/x.wav"}, "audio", "audio.path has to be relative to the manifest: '/x.wav'"),
    ({"audio__path": "  "}, "audio", "audio.path is blank"),
    # a turn
    ({"turns__n1__end": 0.1}, _T, "ends at 0.1 s, before its start at 0.9 s"),
    ({"turns__n1__tool_call": {"id": "q", "name": "book"}, "turns__n1__tool_result": {"id": "k"}}, _T, "holds a tool_call and a tool_result; only one is possible"),
    ({"turns__n1__tool_call": {"id": "q", "name": "book"}}, _T, "only the agent calls tools"),
    ({"turns__n1__tool_result": {"id": "k"}}, _T, "only a tool gives results"),
    ({"turns__n1__speaker": "tool"}, _T, "a tool's turn needs its tool_result"),
    ({"turns__n1__text": ""}, _T, "a spoken turn needs text"),
    ({"turns__n1__lang": None}, _T, "a spoken turn needs lang (a BCP-47 tag)"),
    ({"turns__n1__lang_mix": ["en-US", "en-US"]}, _T, "lang_mix names a language twice"),
    ({"turns__n1__lang_mix": ["hi", "en-US"]}, _T, "lang_mix has to begin with the turn's lang"),
    ({"turns__n1__entities": [{"type": "x", "text": "A-1", "start_char": 0, "end_char": 3}]}, _T, "entity 0: offsets 0 to 3 don't cut out the entity's text"),
    ({"turns__n1__entities": [{"type": "x", "text": "z"}, {"type": "x", "text": "A-1", "start_char": 12}]}, _T, "entity 1: one offset is set and the other is not"),
    ({"turns__n1__entities": [{"type": "x", "text": "A-1", "start_char": 4, "end_char": 2}]}, _T, "entity 0: offsets 4 to 2 are no stretch of text"),
    ({"turns__n1__entities": [{"type": "x", "text": "A-1", "start_char": 12, "end_char": 99}]}, _T, "entity 0: end_char 99 lies past the turn's text"),
    # provenance
    ({"meta__consent": "written"}, "meta", "this consent needs consent_ref: the recording or the form"),
    ({"meta__source": "public", "meta__consent": "public_license"}, "meta", "data under a public licence has to name it in license"),
    ({"meta__source": "real"}, "meta", "synthetic consent belongs to synthetic data, not to source 'real'"),
    ({"meta__redaction_log": "/l.json"}, "meta", "meta.redaction_log has to be relative to the manifest: '/l.json'"),
    ({"meta__allowed_uses": []}, "meta", "allowed_uses is empty: nothing may be done with this record"),
    ({"meta__source": "real", "meta__consent": "none", "meta__allowed_uses": ["voice_clone"]}, "meta", "cloning a real voice needs voice_consent_ref, the speaker's own consent"),
    ({"meta__source": "real", "meta__consent": "none", "meta__pii_redacted": False}, "meta", "real data has to be redacted first (pii_redacted)"),
    ({"meta__source": "real", "meta__consent": "none"}, "meta", "redacted real data needs its redaction_log"),
    # across turns
    ({"turns__n4__start": 1.0}, "<record>", "turn 4 starts before the turn ahead of it"),
    ({"turns__n4__overlap": True}, "<record>", "turn 4 overlap is true, but it starts at 1.6 s and the turn ahead of it ends at 1.5 s"),
    ({"turns__n1__start": 0.5}, "<record>", "turn 1 overlap is false, but it starts at 0.5 s and the turn ahead of it ends at 0.8 s"),
    ({"tools": [{"name": "book"}, {"name": "book"}]}, "<record>", "tool 1 has the name of an earlier one, 'book'"),
    ({"turns__n4": _LATE | {"tool_call": {"id": "k", "name": "book"}}}, "<record>", "turn 4 calls with the id of an earlier call, 'k'"),
    ({"turns__n2__tool_call": {"id": "k", "name": "nope"}}, "<record>", "turn 2 calls 'nope', which is not among tools"),
    ({"turns__n3__tool_result": {"id": "z", "content": None}}, "<record>", "turn 3 answers 'z', which no earlier turn calls"),
    ({"turns__n4": _LATE | {"speaker": "tool", "tool_result": {"id": "k"}}}, "<record>", "turn 4 answers 'k' a second time"),
    ({"turns__n3": {"speaker": "agent", "start": 1.5, "end": 1.5, "text": "so", "lang": "en"}}, "<record>", "never answered, though the conversation goes on: k"),
    ({"audio__duration_s": 1.0}, "<record>", "turns go on to 2.0 s, the recording to 1.0 s"),
)
#: Changes that break nothing: a trailing call, no recording, offsets in code points, a recording half a second short, numbers in strings.
SOUND_CASES = (
    {},
    {
        "turns__n2": RECORD["turns"][0] | {"start": 1.5, "end": 1.5},
        "turns__n3": {"speaker": "agent", "start": 1.5, "end": 1.9, "text": "so", "lang": "en"},
        "turns__n4": {"speaker": "agent", "start": 1.9, "end": 2, "tool_call": {"id": "k2", "name": "book"}},
    },
    {"audio": None},
    {"turns__n1__entities": [{"type": "x", "text": "\U0001f600", "start_char": 1, "end_char": 2}], "turns__n1__text": "a\U0001f600b"},
    {"audio__duration_s": 1.5},
    {"turns__n0__start": "0", "audio__sample_rate": "24000", "meta__pii_redacted": "yes"},
)


def wave_bytes(seconds: float = 2.0, rate: int = 24000, channels: int = 1, silent: float = 0.0) -> bytes:
    """A tone in floating-point samples, silent at first for a share of its length."""
    t = np.arange(int(seconds * rate)) / rate
    tone = (0.3 * np.sin(2 * np.pi * 440 * t)).astype("<f4")
    tone[: int(len(tone) * silent)] = 0
    data = np.repeat(tone[:, None], channels, 1).tobytes()
    form = struct.pack("<HHIIHH", 3, channels, rate, rate * 4 * channels, 4 * channels, 32)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


_BOOK = {"id": "k", "name": "book"}
_LOG = {"conversation_id": "other", "spans": [{"type": "phone", "turn": 1, "placeholder": "[PHONE]"}, {"type": "x", "turn": 99, "placeholder": "p"}, {"type": "x", "turn": 0, "placeholder": "Hi", "audio": {"start_s": 0, "end_s": 9, "method": "tone"}}]}
_LINES = (
    RECORD,
    changed(id="c2", audio__path="audio/long.wav"),
    changed(id="c3", audio__path="audio/none.wav", turns__n4__text="mail a@b.co", turns__n4__lang="fr"),
    changed(id="c4", locale="xx"),
    changed(id="c1"),
    changed(id="c5", meta__consent="none", meta__source="public", meta__redaction_log="log.json", turns__n2__tool_call=_BOOK | {"arguments": {"customer_id": 4}}),
    changed(id="c6", turns=[]),
    changed(id="c7", tools=[{"name": "book", "parameters": {"type": "thing"}}]),
    changed(id="c8", audio__path="audio/slow.wav", meta__redaction_log="none.json"),
)
#: A manifest with its recordings, a redaction log and splits.
MANIFEST_FILES = {
    "m.jsonl": ("﻿" + "\n".join(map(json.dumps, _LINES)) + "\n\n{bad\n").encode(),
    "audio/c1.wav": wave_bytes(2.0, channels=2),
    "audio/long.wav": wave_bytes(9.0),
    "audio/slow.wav": wave_bytes(2.0, rate=8000, channels=2),
    "log.json": json.dumps(_LOG).encode(),
    "splits.json": json.dumps({"train": ["c1", "c1", "c2", "c3", "c4", "ghost"], "val": ["c2", "c7"], "dev": [], "seed": True}).encode(),
}
_RESAMPLE = "run `prepare` to resample or fix the declaration"
#: (line, conversation, field, message) of its issues; 0 is no line.
MANIFEST_ISSUES = (
    (2, "c2", "audio.channels", "declared 2, file has 1"),
    (2, "c2", "audio.duration_s", "declared 2.0, file is 9.00"),
    (3, "c3", "audio.path", "audio/none.wav does not exist"),
    (3, "c3", "turns[4].lang", "'fr' is not declared by pack 'en-US' (allowed: ['en', 'en-US'])"),
    (3, "c3", "turns[4].text", "pii_redacted is true, but email is still present at characters 5-11"),
    (4, "c4", "locale", "\"unknown locale pack 'xx'; known: ['en', 'en-GB', 'en-IN', 'en-US', 'hi-Latn-IN']\""),
    (5, "c1", "id", "duplicate id"),
    (6, "c5", "turns[2].tool_call.arguments", "4 is not of type 'string'"),
    (6, "c5", "meta.consent", "consent is 'none'"),
    (6, "c5", "meta.redaction_log", "names conversation 'other', not this one"),
    (6, "c5", "meta.redaction_log", "spans[0] claims placeholder '[PHONE]' in turns[1].text, which does not contain it"),
    (6, "c5", "meta.redaction_log", "spans[1] points at turn 99, which does not exist"),
    (6, "c5", "meta.redaction_log", "spans[2] redacts audio up to 9.0s, past the end of the 2.0s recording"),
    (7, "c6", "turns", "List should have at least 1 item after validation, not 0"),
    (8, "c7", "tools[0].parameters", "invalid JSON Schema: 'thing' is not valid under any of the given schemas"),
    (9, "c8", "audio.sample_rate", "declared 24000, file is 8000"),
    (9, "c8", "meta.redaction_log", "none.json does not exist"),
    (11, "<unparsed>", "json", "Expecting property name enclosed in double quotes: line 1 column 2 (char 1)"),
    (0, "<splits.json>", "splits.json", "unknown key 'dev'"),
    (0, "<splits.json>", "splits.json", "'seed' must be a whole number, got true"),
    (0, "c1", "splits.json", "listed twice in train"),
    (0, "ghost", "splits.json", "names no valid conversation in this manifest"),
    (0, "c2", "splits.json", "in both train and val"),
    (0, "c2", "meta.split", "row says 'train', splits.json says 'val'"),
    (0, "c7", "meta.split", "row says 'train', splits.json says 'val'"),
    (0, "c5", "splits.json", "not assigned to any split"),
    (0, "c8", "splits.json", "not assigned to any split"),
)

#: Redaction logs by name, of conversation "c" with two turns, the texts "Hi" and "a p", and a recording of 2 s; and what is said about each.
LOG_FILES = {
    "good.json": {"conversation_id": "c", "spans": [{"type": "x", "turn": 0, "placeholder": "Hi", "audio": {"start_s": 0, "end_s": 1, "method": "tone"}}, {"type": "x", "field": "system_prompt", "placeholder": "p"}]},
    "unplaced.json": {"conversation_id": "c", "spans": [{"type": "x", "placeholder": "p"}]},
    "prompt.json": {"conversation_id": "c", "spans": [{"type": "x", "field": "system_prompt", "turn": 0, "placeholder": "p"}]},
    "half.json": {"conversation_id": "c", "spans": [{"type": "x", "turn": 0, "placeholder": "Hi", "start": 1}]},
    "back.json": {"conversation_id": "c", "spans": [{"type": "x", "turn": 0, "placeholder": "Hi", "audio": {"start_s": 1, "end_s": 1, "method": "tone"}}]},
    "shape.json": {"conversation_id": ""},
    "late.json": {"conversation_id": "c", "spans": [{"type": "x", "turn": 0, "placeholder": "Hi", "audio": {"start_s": 0, "end_s": 9, "method": "tone"}}]},
    "false.json": {"conversation_id": "d", "spans": [{"type": "x", "turn": 1, "placeholder": "Hi"}, {"type": "x", "turn": 2, "placeholder": "p"}]},
    "broken.json": None,
    "none.json": None,
}
LOG_ISSUES = (
    ("unplaced.json", "malformed at spans.0: a span of text needs its turn"),
    ("prompt.json", "malformed at spans.0: the system prompt is in no turn: leave turn out"),
    ("half.json", "malformed at spans.0: start or end is set without the other"),
    ("back.json", "malformed at spans.0: the masked sound ends at 1.0 s, not after its start at 1.0 s"),
    ("shape.json", "malformed at conversation_id: String should have at least 1 character"),
    ("late.json", "spans[0] redacts audio up to 9.0s, past the end of the 2.0s recording"),
    ("false.json", "names conversation 'd', not this one"),
    ("false.json", "spans[0] claims placeholder 'Hi' in turns[1].text, which does not contain it"),
    ("false.json", "spans[1] points at turn 2, which does not exist"),
    ("broken.json", "malformed at <log>: Expecting property name enclosed in double quotes: line 1 column 2 (char 1)"),
    ("none.json", "none.json does not exist"),
)

#: (schema, arguments, problems), problems joined by semicolons.
ARGUMENT_CASES = (
    ({"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}, {"a": "x"}, ""),
    ({"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}, {"a": 4}, "4 is not of type 'string'"),
    ({"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}, {}, "'a' is a required property"),
    ({"properties": {"n": {"type": "integer", "minimum": 2, "maximum": 5}}}, {"n": 1}, "1 is less than the minimum of 2"),
    ({"properties": {"n": {"type": "integer", "exclusiveMaximum": 5}}}, {"n": 5}, "5 is greater than or equal to the maximum of 5"),
    ({"properties": {"n": {"enum": ["a", "b"]}}}, {"n": "c"}, "'c' is not one of ['a', 'b']"),
    ({"properties": {"n": {"const": 1}}}, {"n": 2}, "1 was expected"),
    ({"properties": {"a": {}}, "additionalProperties": False}, {"a": 1, "b": 2}, "Additional properties are not allowed ('b' was unexpected)"),
    ({"properties": {"l": {"type": "array", "items": {"type": "boolean"}, "minItems": 1}}}, {"l": [True, 1]}, "1 is not of type 'boolean'"),
    ({"properties": {"l": {"type": "array", "minItems": 1}}}, {"l": []}, "[] should be non-empty"),
    ({"properties": {"l": {"minItems": 2}}}, {"l": [1]}, "[1] is too short"),
    ({"$defs": {"n": {"type": "integer"}}, "properties": {"a": {"$ref": "#/$defs/n"}}}, {"a": "x"}, "'x' is not of type 'integer'"),
    ({"properties": {"a": {"anyOf": [{"type": "string"}, {"type": "null"}]}}}, {"a": 1}, "1 is not valid under any of the given schemas"),
    ({"properties": {"a": {"oneOf": [{"type": "integer"}, {"minimum": 2}]}}}, {"a": 1}, ""),
    ({"properties": {"a": {"not": {"type": "string"}}}}, {"a": "x"}, "'x' should not be valid under {'type': 'string'}"),
    ({"allOf": [{"required": ["a"]}, {"required": ["b"]}]}, {"a": 1}, "'b' is a required property"),
    ({"if": {"required": ["a"]}, "then": {"required": ["b"]}}, {"a": 1}, "'b' is a required property"),
    ({"patternProperties": {"^x": {"type": "string"}}, "additionalProperties": False}, {"x1": 1}, "1 is not of type 'string'"),
    ({"properties": {"l": {"uniqueItems": True}}}, {"l": [1, 1]}, "[1, 1] has non-unique elements"),
    ({"properties": {"l": {"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}}}, {"l": ["a", "b"]}, "'b' is not of type 'integer'"),
    ({"properties": {"n": {"multipleOf": 3}}}, {"n": 4}, "4 is not a multiple of 3"),
    ({"dependentRequired": {"a": ["b"]}}, {"a": 1}, "'b' is a dependency of 'a'"),
    ({"properties": {"s": {"type": "string", "format": "date", "x-note": "own"}}}, {"s": "no date"}, ""),
    ({"properties": {"b": {"enum": [1]}}}, {"b": True}, "True is not one of [1]"),
    ({"properties": {"s": {"pattern": "^x", "maxLength": 2}}}, {"s": "yyy"}, "'yyy' does not match '^x'; 'yyy' is too long"),
    ({"type": "thing"}, {}, "schema: 'thing' is not valid under any of the given schemas"),
    ({"properties": 3}, {}, "schema: 3 is not of type 'object'"),
    ({"required": "a"}, {}, "schema: 'a' is not of type 'array'"),
)

#: (pack, text, spans as kind:start:end joined by commas)
SPAN_CASES = (
    ("en", "Mail me at ann.lee+x@shop.example.co.uk or call (415) 555-0134.", "email:11:39"),
    ("en-US", "Mail me at ann.lee+x@shop.example.co.uk or call (415) 555-0134.", "email:11:39,phone:48:62"),
    ("en-US", "my ssn is 123-45-6789, again 123456789; ssn 123456789 and order 4155550134", "ssn:10:21,ssn:44:53"),
    ("en-US", "ssn 000-12-3456 and 666-12-3456 and 123-00-4567", ""),
    ("en-US", "invoice 4155550134, ref: 415-555-0134, call 4155550134", "phone:44:54"),
    ("en", "card 4111 1111 1111 1111 and order number is 4111111111111111; 5500-0000-0000-0004", "card_number:5:24,card_number:63:82"),
    ("en", "card 4111 1111 1111 1112", ""),
    ("en", "iban gb82 west 1234 5698 7654 32 please, ZZ82WEST12345698765432, DE89370400440532013000", "iban:5:32,iban:65:87"),
    ("en-GB", "NI ab 12 34 56 c, mobile 07700 900123, landline 020 7946 0958, x07700900123", "ni_number:3:16,phone:25:37,phone:48:61"),
    ("en-GB", "BG 12 34 56 C", ""),
    ("en-IN", "Aadhaar 2363 2363 2363 or 234567890124, PAN abcpe1234f, phone +91 98765 43210, invoice 9876543210", "aadhaar:26:38,pan:44:54,phone:62:77"),
    ("hi-Latn-IN", "order cancel karke mera 9876543210 par call karo \U0001f600 test@example.com", "phone:24:34,email:51:67"),
    ("hi-Latn-IN", "₹1,00,000 का order ०१२३ 98765-43210", "phone:24:35"),
    ("en-IN", "9876543210 9876543211 a/c 9876543212 tracking no: 9876543213", "phone:0:10,phone:11:21"),
    ("en-US", "", ""),
    ("en-US", "no data here at all", ""),
)

#: (pack, text, normal form)
NORMAL_CASES = (
    ("en-US", "It's $1,200.50, i.e. 10 % off & more!", "it s 1200.50 dollars i e 10 percent off and more"),
    ("en-GB", "£3 each", "3 pounds each"),
    ("en-IN", "₹2,00,000 or Rs. 5 lakh", "200000 rupees or 5 lakh rupees"),
    ("hi-Latn-IN", "Nahin, ₹१,००० thik hai! 3.5 %", "nahi 1000 rupees theek hai 3.5 percent"),
    ("hi-Latn-IN", "मुझे मदद चाहिए।", "मुझे मदद चाहिए"),
    ("en", "", ""),
)

#: (text, language, mix) by the Hinglish pack
LANGUAGE_CASES = (
    ("order cancel kar do", "hi-Latn", "hi-Latn+en-IN"),
    ("please cancel my order", "en-IN", "en-IN"),
    ("मुझे refund चाहिए और जल्दी चाहिए", "hi", "hi+en-IN"),
    ("", "en-IN", "en-IN"),
    ("cancel कर my whole order now please", "en-IN", "en-IN+hi"),
)

#: (number, check, valid)
NUMBER_CASES = (
    ("4111 1111 1111 1111", "luhn", True),
    ("4111 1111 1111 1112", "luhn", False),
    ("411111111111", "luhn", False),
    ("0" * 19, "luhn", True),
    ("234567890124", "verhoeff", True),
    ("234567890125", "verhoeff", False),
    ("2363", "verhoeff", True),
    ("", "verhoeff", False),
    ("GB82 WEST 1234 5698 7654 32", "iban", True),
    ("gb82west12345698765432", "iban", True),
    ("GB82WEST12345698765433", "iban", False),
    ("ZZ82WEST12345698765432", "iban", False),
    ("DE89370400440532013000", "iban", True),
    ("DE8937040044053201300", "iban", False),
)

#: (columns, the layouts that their names tell)
HEADER_CASES = (
    ("Customer,x,Agent", "exchange=Customer+Agent"),
    ("Question,Answer", "question=Question+Answer"),
    ("conv_id,Role,Text", "message=Role+Text"),
    ("sentence,intent", "labelled=sentence+intent"),
    ("Input,Output,Text,Label", "exchange=Input+Output;labelled=Text+Label"),
    ("Ticket ID,Status", ""),
)
#: (name, key, kind of personal data, cue)
NAME_CASES = (
    ("Customer Name", "customer_name", "person_name", "Customer Name: "),
    ("Billing Address", "billing_address", "address", "Billing Address: "),
    ("DOB", "dob", "date_of_birth", "DOB: "),
    ("Product Name", "product_name", None, "Product Name: "),
    ("Address Line 1", "address_line_1", "address", "Address Line 1: "),
    ("zip_plus_four", "zip_plus_four", None, "zip plus four: "),
    ("--ID--", "id", None, "ID: "),
)
#: (table, columns, identifier columns, labelled texts, tools)
TOOL_CASES = (
    ("Orders", "Ticket ID,Customer-ID,Order No,sku,Status", "Ticket ID,Customer-ID,Order No,sku", "", "lookup_orders_by_ticket_id,lookup_orders_by_customer_id,lookup_orders_by_order_no"),
    ("t", "id,text,category", "id", "text,category", ""),
    ("crm", "customer_id,mobile,email,Customer Name", "customer_id,email", "", "lookup_crm_by_customer_id,lookup_crm_by_email"),
)

_HTML = "<head><title>x</title></head><style>p{}</style><h1>Call us</h1><p>+91 98765 43210 &amp; more</p><p>bye</p>"
#: A folder with a file of every kind.
FOLDER_FILES = {
    "page.html": _HTML.encode(),
    "page_files/script.js": b"var x",
    "crm.csv": "﻿customer_id,mobile,email,Customer Name\n1,9876543210,a@b.co,Ann\n2,9876543211,c@d.co,Bob\n\n".encode(),
    "faq.csv": b"question,answer\nWhere?,Here.\nWhen?,Now.\n",
    "pairs.csv": b'input,output,customer_name\nhello,"hi\nthere",Ann\nbye,,Bob\n',
    "rows.csv": b"conv_id,turn_index,Role,Text\n1,0,user,namaste ji\n1,1,agent,hello sir\n1,2,,\n",
    "chat.jsonl": (json.dumps({"messages": [{"role": "user", "content": "hi"}, {"role": "bot", "content": ""}]}) + "\n{BROKEN\n").encode(),
    "wrapped.json": json.dumps({"items": [{"sku": "a", "price": 1, "by": {"phone": "9876543210", "tags": ["x", True, None]}}, {"sku": "b"}]}).encode(),
    "lines.json": b'{"question": "a?", "answer": "b"}\n{"question": "c?", "answer": "d"}\n',
    "dump.sql": b"CREATE TABLE IF NOT EXISTS `shop`.`orders` (\n `order_id` int,\n  note text,\n PRIMARY KEY (order_id)\n);\nINSERT INTO orders VALUES (1, 'x@y.co');",
    "export.txt": b"12/03/24, 10:14 - Messages are encrypted\n12/03/24, 10:15 - Priya: hello\nmore\n12/03/24, 10:16 - Sam: haan ji theek hai\n[12/03/24, 10:17] Priya: bye\n",
    "bad.json": b"[{",
    "deck.pptx": b"x",
    ".hidden.md": b"secret",
    "node_modules/a.md": b"no",
    "labels.csv": b"id,text,category\n1,where is it,status\n",
    "notes.md": "One two.\n\nतीन शब्द हैं\n".encode(),
    "call.wav": wave_bytes(channels=2),
    "narrow.wav": wave_bytes(rate=8000, silent=0.5),
}


def _sound(rate: int, channels: int, silence: float, narrow: bool) -> dict:
    return {"duration_s": 2.0, "sample_rate": rate, "channels": channels, "narrowband": narrow, "clipping_ratio": 0.0, "silence_ratio": silence, "stats_sampled_s": 2.0, "stats_partial": False}


def _table(columns: str, rows: int | None, ids: str, tools: str, **more) -> dict:
    scanned = {} if rows is None else {"pii_columns": {}, "rows_scanned": rows}
    return {"columns": columns.split(","), "rows": rows, "id_columns": ids.split(","), "tool_candidates": tools.split(",") if tools else []} | scanned | more


#: (path, kind, format, readable, facts) of every file that is listed.
FOLDER_FACTS = (
    ("bad.json", "table", "json", False, None),
    ("call.wav", "audio", "wav", True, _sound(24000, 2, 0.0, False)),
    ("chat.jsonl", "chat", "jsonl", True, {"words": 1, "languages": {"en-IN": 1}, "pii": {}, "messages": 2, "speakers": {"user": 1, "bot": 1}, "message_languages": {"en-IN": 1}, "parse_errors": ["line 2: Expecting property name enclosed in double quotes"]}),
    ("crm.csv", "table", "csv", True, {"tables": {"crm": _table("customer_id,mobile,email,Customer Name", 2, "customer_id,email", "lookup_crm_by_customer_id,lookup_crm_by_email", pii_columns={"mobile": {"phone": 2}, "email": {"email": 2}, "Customer Name": {"person_name": 2}})}, "pii": {"phone": 2, "email": 2, "person_name": 2}}),
    ("deck.pptx", "document", "pptx", False, None),
    ("dump.sql", "table", "sql", True, {"tables": {"orders": _table("order_id,note", None, "order_id", "lookup_orders_by_order_id")}, "pii": {"email": 1}}),
    ("export.txt", "chat", "whatsapp", True, {"words": 7, "languages": {"en-IN": 2, "hi-Latn": 1}, "pii": {}, "messages": 3, "speakers": {"Priya": 2, "Sam": 1}, "message_languages": {"en-IN": 2, "hi-Latn": 1}}),
    ("faq.csv", "document", "csv", True, {"words": 4, "languages": {"en-IN": 4}, "pii": {}, "faq_pairs": 2}),
    ("labels.csv", "table", "csv", True, {"tables": {"labels": _table("id,text,category", 1, "id", "", labelled_texts=["text", "category"])}, "pii": {}}),
    ("lines.json", "document", "jsonl", True, {"words": 4, "languages": {"en-IN": 4}, "pii": {}, "faq_pairs": 2}),
    ("narrow.wav", "audio", "wav", True, _sound(8000, 1, 0.5, True)),
    ("notes.md", "document", "md", True, {"words": 7, "languages": {"en-IN": 1, "hi": 1}, "pii": {}}),
    ("page.html", "document", "html", True, {"words": 7, "languages": {"en-IN": 3}, "pii": {"phone": 1}}),
    ("pairs.csv", "chat", "csv", True, {"words": 4, "languages": {"en-IN": 3}, "pii": {"person_name": 2}, "messages": 3, "speakers": {"input": 2, "output": 1}, "message_languages": {"en-IN": 3}, "pair": ["input", "output"], "pii_columns": {"customer_name": {"person_name": 2}}}),
    ("rows.csv", "chat", "csv", True, {"words": 4, "languages": {"hi-Latn": 1, "en-IN": 1}, "pii": {}, "messages": 2, "speakers": {"user": 1, "agent": 1}, "message_languages": {"hi-Latn": 1, "en-IN": 1}, "message_columns": ["Role", "Text"]}),
    ("wrapped.json", "table", "json", True, {"tables": {"wrapped": _table("sku,price,by", 2, "sku", "lookup_wrapped_by_sku", pii_columns={"by.phone": {"phone": 1}})}, "pii": {"phone": 1}}),
)
#: The folder's summary.
FOLDER_SUMMARY = {
    "counts": {"document": 5, "table": 5, "chat": 4, "audio": 2, "other": 0},
    "profiled": {"document": 4, "table": 4, "chat": 4, "audio": 2, "other": 0},
    "unreadable": 2,
    "truncated": 0,
    "document_words": 22,
    "chat_messages": 10,
    "audio_hours": 0.0011,
    "two_channel_audio_files": 1,
    "languages": {"en-IN": 19, "hi-Latn": 2, "hi": 1},
    "chat_languages": {"en-IN": 7, "hi-Latn": 2},
    "pii": {"phone": 4, "person_name": 4, "email": 3},
    "tool_candidates": ["lookup_crm_by_customer_id", "lookup_crm_by_email", "lookup_orders_by_order_id", "lookup_wrapped_by_sku"],
    "labelled_text_tables": 1,
}

_CHATS = {"counts": {"chat": 1}, "profiled": {"chat": 1}, "languages": {"en-US": 5}}
_AUDIO = {"counts": {"audio": 2}, "profiled": {"audio": 2}}
#: (case, pack, summary, constraints, {goal: (state, have, recipe)}, the state in all)
DECISION_CASES = (
    ("many messages", "en-US", _CHATS | {"chat_messages": 1000, "chat_languages": {"en-US": 1000}}, {"gpu": "24"}, {"workflow": ("candidate", 1000.0, "lfm25-audio")}, "candidate"),
    ("some messages", "en-US", _CHATS | {"chat_messages": 300, "chat_languages": {"en-US": 300}}, {}, {"workflow": ("baseline_first", 300.0, "lfm25-audio")}, "baseline_first"),
    ("few messages", "en-US", _CHATS | {"chat_messages": 100, "chat_languages": {"en-US": 100}}, {}, {"workflow": ("blocked", 100.0, None)}, "blocked"),
    ("hours", "en-US", _AUDIO | {"audio_hours": 30.0}, {"goals": ("recognition",)}, {"recognition": ("baseline_first", 30.0, "lfm25-audio")}, "baseline_first"),
    ("hours below the floor", "en-US", _AUDIO | {"audio_hours": 9.5}, {"goals": ("recognition",)}, {"recognition": ("blocked", 9.5, None)}, "blocked"),
    ("foreign turns of an old report", "hi-Latn-IN", {"chat_messages": 1000, "languages": {"hi": 3, "en": 1}}, {"goals": ("language",)}, {"language": ("baseline_first", 750.0, "cascade")}, "baseline_first"),
    ("facts", "en-US", _CHATS | {"chat_messages": 1000, "chat_languages": {"en-US": 1000}}, {"goals": ("knowledge",)}, {"knowledge": ("blocked", 1000.0, None)}, "blocked"),
)
