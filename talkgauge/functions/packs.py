"""Locale packs: what a market's texts look like, as data, and the registry of packs.

A pack names its parent; patterns and languages are inherited and extended, single settings are taken from
the nearest pack that has one. Packs are few and small: they are resolved on the driver, and their rules
become column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column

from talkgauge.functions import checksums
from talkgauge.functions.patterns import to_java

#: Characters before a match that a context pattern sees.
CONTEXT_WINDOW = 40

# Words that introduce a reference number, and fillers between such a word and the number.
REFERENCE_WORDS = (
    "order purchase invoice ref reference ticket txn transaction receipt policy account acc a/c card imei sku awb pnr gst "
    "tracking case claim booking confirmation member membership"
).split()
FILLERS = "number no num nbr id ref code is was the my your our".split()
#: Reference words that introduce card numbers themselves.
CARD_WORDS = ("card", "account", "acc", "a/c")


@dataclass(frozen=True)
class Pattern:
    """One kind of personal data: a regular expression (Python's syntax), a check, and what must or must not come before."""

    name: str
    regex: str
    ignore_case: bool = False
    check: Callable[[Column], Column] | None = None
    deny: str | None = None
    require: str | None = None
    #: A one-character class without which nothing can match, to skip texts cheaply.
    hint: str = r"\p{Nd}"

    @property
    def java(self) -> str:
        return to_java(self.regex, self.ignore_case)


def reference_cue(*words: str) -> str:
    """Before a number that is a reference: one of ``words``, then nothing but fillers and one mark."""
    return rf"\b(?:{'|'.join(words)})\b(?:\s+(?:{'|'.join(FILLERS)}))*\s*[:#=.\-]?\s*$"


@dataclass(frozen=True)
class Formats:
    currency_symbols: tuple[str, ...] = ()
    currency_words: tuple[str, ...] = ()
    date_order: str = "DMY"
    phone_example: str = ""
    postal_example: str = ""


@dataclass(frozen=True)
class PrivacyNotes:
    summary: str
    links: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pack:
    """A locale pack. ``detect`` and ``normal`` name the text rules (see ``talkgauge.functions.text``); custom
    rules are column functions: ``custom`` maps detect_lang, lang_mix, normalize_text or find_pii to one."""

    id: str
    name: str = ""
    languages: tuple[str, ...] = ()
    parent: str | None = None
    formats: Formats | None = None
    patterns: tuple[Pattern, ...] = ()
    call_recording_consent: str | None = None
    privacy_notes: PrivacyNotes | None = None
    recipe_support: dict[str, str] = field(default_factory=dict)
    normal: str | None = None
    detect: str | None = None
    custom: dict[str, Callable] = field(default_factory=dict)

    def chain(self) -> list[Pack]:
        """This pack, its parent, and so on."""
        out = [self]
        while out[-1].parent:
            out.append(get_pack(out[-1].parent))
        return out

    def resolved(self, setting: str):
        """The nearest value of a setting that is not empty."""
        return next((v for p in self.chain() if (v := getattr(p, setting))), getattr(self, setting))

    def all_languages(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(lang for p in self.chain() for lang in p.languages))

    def all_patterns(self) -> tuple[Pattern, ...]:
        """Own patterns, then inherited ones whose name no nearer pack has."""
        out: list[Pattern] = []
        for p in self.chain():
            names = {x.name for x in out}
            out += [x for x in p.patterns if x.name not in names]
        return tuple(out)


_PACKS: dict[str, Pack] = {}


def register(pack: Pack) -> Pack:
    """Makes a pack known; a pack with the same id is replaced."""
    _PACKS[pack.id] = pack
    return pack


def get_pack(pack_id: str) -> Pack:
    if pack_id not in _PACKS:
        raise KeyError(f"unknown locale pack {pack_id!r}; known: {list_packs()}")
    return _PACKS[pack_id]


def list_packs() -> list[str]:
    return sorted(_PACKS)


_NATIVE = {recipe: "native" for recipe in ("lfm25-audio", "moshi-lora", "qwen-omni", "cascade")}

# Patterns of personal data, packs, their formats, notes and support levels.
EMAIL = Pattern("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", hint="@")
CARD = Pattern(
    "card_number", r"(?<![\w-])(?:\d[ -]?){12,18}\d(?![\w-])", check=checksums.luhn_valid, deny=reference_cue(*[w for w in REFERENCE_WORDS if w not in CARD_WORDS])
)
IBAN = Pattern(
    "iban", r"\b[A-Za-z]{2}\d{2}(?:[A-Za-z0-9]{11,30}|(?:[ -][A-Za-z0-9]{4})*[ -][A-Za-z0-9]{1,4})\b", check=checksums.iban_valid
)
SSN = Pattern("ssn", r"\b(?!000|666|9\d\d)\d{3}[- ](?!00)\d{2}[- ](?!0000)\d{4}\b")
SSN_COMPACT = replace(
    SSN,
    regex=r"\b(?!000|666|9\d\d)\d{3}(?!00)\d{2}(?!0000)\d{4}\b",
    require=r"\b(ssn|social(?:\s+security)?(?:\s+number)?|tin)\b[^0-9]{0,12}$",
)
PHONE_US = Pattern(
    "phone", r"(?<![\w+])(?:\+?1[\s.-]?)?\(?[2-9]\d{2}\)?[\s.-]?[2-9]\d{2}[\s.-]?\d{4}\b", deny=reference_cue(*REFERENCE_WORDS)
)
NI_NUMBER = Pattern(
    "ni_number", r"\b(?!BG|GB|KN|NK|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b", ignore_case=True
)
PHONE_GB = Pattern("phone", r"(?<![\w+])(?:(?:\+44\s?|0)7\d{3}\s?\d{3}\s?\d{3}|(?:\+44\s?|0)[12]\d{1,3}\s?\d{3,4}\s?\d{3,4})\b")
AADHAAR = Pattern("aadhaar", r"(?<![\w-])[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}(?![\w-])", check=checksums.verhoeff_valid)
PAN = Pattern("pan", r"\b[A-Z]{3}[ABCFGHJLPT][A-Z]\d{4}[A-Z]\b", ignore_case=True)
PHONE_IN = Pattern("phone", r"(?<![\w+])(?:\+91[\s-]?|0)?[6-9]\d{4}[\s-]?\d{5}(?!\w)", deny=reference_cue(*REFERENCE_WORDS))

register(Pack("en", "English (shared)", ("en",), patterns=(EMAIL, CARD, IBAN), normal="english"))
register(
    Pack(
        "en-US",
        "US English",
        ("en-US",),
        "en",
        Formats(("US$", "$"), ("dollars", "bucks", "grand"), "MDY", "(415) 555-0134", "94107 or 94107-1234"),
        (SSN, SSN_COMPACT, PHONE_US),
        "varies_by_state",
        PrivacyNotes(
            "No single federal privacy law. State laws apply, for example California CCPA/CPRA. Illinois BIPA treats voiceprints as "
            "biometric identifiers. Call-recording consent varies by state; several, including California, require all parties to consent.",
            ("https://oag.ca.gov/privacy/ccpa", "https://www.ilga.gov/legislation/ilcs/ilcs3.asp?ActID=3004"),
        ),
        _NATIVE,
    )
)
register(
    Pack(
        "en-GB",
        "UK English",
        ("en-GB",),
        "en",
        Formats(("£",), ("pounds", "quid"), "DMY", "07700 900123", "SW1A 1AA"),
        (NI_NUMBER, PHONE_GB),
        "notice_required",
        PrivacyNotes(
            "UK GDPR and the Data Protection Act 2018 apply. Recording and processing calls needs a lawful basis and notice to callers. "
            "Voice used to identify someone is special-category biometric data. ICO guidance applies.",
            ("https://ico.org.uk/for-organisations/uk-gdpr-guidance-and-resources/",),
        ),
        _NATIVE,
    )
)
register(
    Pack(
        "en-IN",
        "Indian English",
        ("en-IN",),
        "en",
        Formats(("₹", "Rs.", "Rs", "INR"), ("rupees", "lakh", "crore"), "DMY", "+91 98765 43210", "560001"),
        (AADHAAR, PAN, PHONE_IN),
        "notice_required",
        PrivacyNotes(
            "The Digital Personal Data Protection Act, 2023 and its rules apply: give notice and obtain consent before processing personal "
            "data, and honour withdrawal. Aadhaar numbers must not be stored or displayed in full.",
            ("https://www.meity.gov.in/data-protection-framework",),
        ),
        _NATIVE,
        normal="indian",
    )
)
register(
    Pack(
        "hi-Latn-IN",
        "Hinglish",
        ("hi-Latn", "hi"),
        "en-IN",
        recipe_support={"lfm25-audio": "understand_only", "moshi-lora": "understand_only", "qwen-omni": "unsupported", "cascade": "native"},
        normal="hinglish",
        detect="hinglish",
    )
)
