"""What a column's name tells: exchanges, questions and answers, messages, labels, identifiers, personal data.

Names are compared by key, so that "Ticket ID" and "ticket-id" are the same. The functions on lists of names
run on the driver, where headers are; ``key_column`` and ``id_column`` are their column forms.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that mark a layout, in order of preference.
EXCHANGES = (
    ("input", "output"),
    ("instruction", "response"),
    ("query", "response"),
    ("prompt", "response"),
    ("prompt", "completion"),
    ("customer", "agent"),
    ("user", "assistant"),
    ("user", "agent"),
    ("user", "bot"),
)
QUESTIONS = (("question", "answer"), ("questions", "answers"))
SPEAKERS = ("role", "speaker", "author", "from", "sender")
BODIES = ("text", "content", "message", "body", "utterance")
LABELS = ("intent", "category", "label", "class", "topic")
PERSON_HEADERS = frozenset(
    "full_name first_name last_name middle_name given_name family_name surname customer_name client_name contact_name caller_name "
    "patient_name member_name holder_name account_holder_name cardholder_name sender_name recipient_name agent_name employee_name "
    "staff_name rep_name".split()
)
BIRTH_HEADERS = frozenset("dob date_of_birth birth_date birthdate birthday".split())
ADDRESS_HEADER = r"^(?:(?:home|billing|shipping|postal|mailing|street|residential|delivery|customer)_)?address(?:_line)?_?\d?$"
ID_HEADER = r"(^id$|_id$|^id_|number$|_no$|^sku$|^email$|^phone$)"
#: Fixed value: identifier columns of a table that become lookup tools.
TOOLS_PER_TABLE = 3


def key(name: object) -> str:
    return re.sub(r"[^0-9a-z]+", "_", str(name).lower()).strip("_")


def key_column(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^0-9a-z]+", "_"), F.lit("_"))


def id_column(name: Column) -> Column:
    return key_column(name).rlike(ID_HEADER)


def _own(names: Iterable[object]) -> dict[str, str]:
    return {key(n): str(n) for n in names}


def _pair(names: Iterable[object], pairs) -> tuple[str, str] | None:
    own = _own(names)
    return next(((own[a], own[b]) for a, b in pairs if a in own and b in own), None)


def _firsts(names: Iterable[object], *choices) -> tuple[str, ...] | None:
    own = _own(names)
    found = tuple(next((own[k] for k in keys if k in own), None) for keys in choices)
    return found if all(found) else None


def exchange(names: Iterable[object]) -> tuple[str, str] | None:
    """The columns of what a user said and of the reply, as the file spells them."""
    return _pair(names, EXCHANGES)


def question(names: Iterable[object]) -> tuple[str, str] | None:
    return _pair(names, QUESTIONS)


def message(names: Iterable[object]) -> tuple[str, str] | None:
    """The columns of a speaker and of what was said."""
    return _firsts(names, SPEAKERS, BODIES)


def labelled(names: Iterable[object]) -> tuple[str, str] | None:
    """The columns of a text and of its label."""
    return _firsts(names, (*BODIES, "sentence"), LABELS)


def header_kind(name: object) -> str | None:
    """The personal data that a column holds by its name alone."""
    k = key(name)
    if k in PERSON_HEADERS:
        return "person_name"
    if re.match(ADDRESS_HEADER, k):
        return "address"
    return "date_of_birth" if k in BIRTH_HEADERS else None


def header_kind_column(name: Column) -> Column:
    k = key_column(name)
    return (
        F.when(k.isin(*sorted(PERSON_HEADERS)), "person_name").when(k.rlike(ADDRESS_HEADER), "address").when(k.isin(*sorted(BIRTH_HEADERS)), "date_of_birth")
    )


def cue(name: object) -> str:
    """A column's name as the words before a cell's text."""
    return re.sub(r"[\W_]+", " ", str(name)).strip() + ": "


def tools(table: str, columns: list[str]) -> tuple[list[str], list[str] | None, list[str]]:
    """(identifier columns, the text and label columns if it is a table of labelled texts, lookup tools)."""
    ids = [c for c in columns if re.search(ID_HEADER, key(c))]
    texts = labelled(columns)
    if texts and all(key(c) == "id" for c in ids):
        return ids, list(texts), []
    return ids, None, [f"lookup_{key(table)}_by_{key(c)}" for c in ids[:TOOLS_PER_TABLE]]
