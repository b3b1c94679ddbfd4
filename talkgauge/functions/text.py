"""Text rules of a locale pack as column expressions: words, paragraphs, language, normal form, personal data."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkgauge.functions.packs import CONTEXT_WINDOW, Pack, Pattern
from talkgauge.functions.patterns import to_java
from talkgauge.functions.spans import none, places

SPANS = "array<struct<type:string,start:int,end:int,text:string>>"
WORD = to_java(r"\w+")
SPACE = to_java(r"\s")
PARAGRAPH_BREAK = to_java(r"\n\s*\n")
#: Fixed value: paragraphs of a text whose language is looked at.
SAMPLED_PARAGRAPHS = 200

# Elements whose content a page doesn't show, and elements that end a paragraph.
HIDDEN_TAGS = "script style noscript template svg head".split()
BLOCKS = (
    "p div li h[1-6] br tr td th section article header footer nav main aside blockquote pre dt dd figcaption table ul ol form label button"
).split()

# Frequent words of Hindi in Roman script (none that English also has), and spelling variants.
ROMAN_HINDI = frozenset(
    """
    hai hain hoon hun tha thi hoga hogi honge ka ki ke ko se mein mai mera meri mere tera teri tere hamara hamari apna apni
    apne aap aapka aapki aapko tum tumhe tumhara mujhe humko hume unko usko isko inko kya kaise kyun kyon kab kahan kaun
    kitna kitni kitne nahi nahin nai haan han ji theek thik accha acha achha bilkul zaroor aur ya lekin magar bhi sirf phir
    abhi kal aaj parso pehle baad jaldi thoda thodi bahut zyada jyada kam sab kuch koi ek kar karo karna karein kijiye
    karunga karenge kiya kiye raha rahi rahe rha rhi sakta sakti sakte chahiye batao bataiye bolo bol boliye dekho dekhiye
    suno suniye wala wali wale waala liye yeh ye woh wo yahan wahan namaste namaskar dhanyavaad dhanyawad shukriya bhai didi
    bhaiya paisa paise rupaye din mahina saal ghar dukaan nhi krna kro krke dedo dena deke lena lekar milega milegi milta
    chahta chahti chahte samajh samjha pata malum mujhko tumko wapas wapis chalu chalta dikkat turant kyunki matlab bataye
    hua hui gaya gayi rakho bhejo bhej aayega aayegi aaya aayi
    """.split()
)
VARIANTS = {
    "nahin": "nahi",
    "nai": "nahi",
    "han": "haan",
    "thik": "theek",
    "acha": "accha",
    "achha": "accha",
    "kyon": "kyun",
    "mai": "main",
    "hun": "hoon",
    "jyada": "zyada",
    "dhanyawad": "dhanyavaad",
    "rha": "raha",
    "rhi": "rahi",
    "waala": "wala",
}
DEVANAGARI = "[ऀ-ॿ]"
DEVANAGARI_DIGITS = "०१२३४५६७८९"
#: Fixed value: the share of Hindi words from which a Roman text is Hindi.
HINDI_SHARE = 0.2


def is_blank(text: Column) -> Column:
    """Nothing but white space."""
    return ~text.rlike(to_java(r"\S"))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def paragraphs(text: Column) -> Column:
    """The parts between blank lines that are not blank."""
    return F.filter(F.split(text, PARAGRAPH_BREAK, -1), lambda p: ~is_blank(p))


def page_text(markup: Column) -> Column:
    """What a reader sees of a page, paragraph by paragraph; entities stay as they are written."""
    hidden = rf"(?is)<({'|'.join(HIDDEN_TAGS)})\b.*?</\1\s*>|<!--.*?-->"
    broken = F.regexp_replace(F.regexp_replace(markup, hidden, " "), rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n\n")
    return F.regexp_replace(broken, "<[^>]+>", " ")


def _collapsed(text: Column) -> Column:
    return stripped(F.regexp_replace(text, f"{SPACE}+", " "))


def _latin_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)


def _hindi_hits(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*sorted(ROMAN_HINDI))))


def detect_lang(text: Column, pack: Pack) -> Column:
    """The language tag of a text."""
    if own := pack.custom.get("detect_lang"):
        return own(text)
    if pack.detect != "hinglish":
        return F.when(text.isNotNull(), F.lit(pack.languages[0]))
    devanagari = F.regexp_count(text, F.lit(DEVANAGARI))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    words = _latin_words(text)
    hits = _hindi_hits(words)
    return (
        F.when(text.isNull(), None)
        .when((devanagari > 0) & (devanagari >= latin), "hi")
        .when((hits > 0) & (hits / F.size(words) >= HINDI_SHARE), "hi-Latn")
        .otherwise("en-IN")
    )


def lang_mix(text: Column, pack: Pack) -> Column:
    """Every language in a text, the first one first."""
    if own := pack.custom.get("lang_mix"):
        return own(text)
    first = detect_lang(text, pack)
    if pack.detect != "hinglish":
        return F.array(first)
    words = _latin_words(text)
    hits = _hindi_hits(words)
    more = F.array(
        F.when(text.rlike(DEVANAGARI), F.lit("hi")),
        F.when(hits > 0, F.lit("hi-Latn")),
        F.when(F.size(words) > hits, F.lit("en-IN")),
    )
    return F.array_distinct(F.concat(F.array(first), F.array_compact(more)))


def normalize_text(text: Column, pack: Pack) -> Column:
    """The form in which two transcripts are compared."""
    if own := pack.custom.get("normalize_text"):
        return own(text)
    kind = pack.resolved("normal")
    if kind == "hinglish":
        return _hinglish_normal(text)
    if kind == "indian":
        text = _rupees(F.regexp_replace(text, to_java(r"(?<=\d),(?=\d)"), ""))
    if kind in ("english", "indian"):
        return _english_normal(text, pack)
    return _collapsed(F.regexp_replace(F.lower(text), to_java(r"[^\w\s]"), " "))


def _rupees(text: Column) -> Column:
    amount = to_java(r"(?:₹|rs\.?|inr)\s?(\d[\d,]*(?:\.\d+)?)(\s?(?:lakhs?|crores?|k|thousand))?", ignore_case=True)
    return F.regexp_replace(text, amount, "$1$2 rupees")


def _english_normal(text: Column, pack: Pack) -> Column:
    out, formats = F.lower(text), pack.resolved("formats")
    if formats and formats.currency_symbols and formats.currency_words:
        symbols = "|".join(re.escape(s) for s in formats.currency_symbols)
        money = to_java(rf"(?:{symbols})\s?(\d[\d,]*(?:\.\d+)?)", ignore_case=True)
        out = F.regexp_replace(out, money, f"$1 {formats.currency_words[0]}")
    out = F.regexp_replace(out, to_java(r"(?<=\d),(?=\d{3}\b)"), "")
    out = F.regexp_replace(out, to_java(r"(?<=\d)\s?%"), " percent")
    out = F.replace(out, F.lit("&"), F.lit(" and "))
    return _collapsed(F.regexp_replace(out, to_java(r"(?!(?<=\d)\.(?=\d))[^\w\s]"), " "))


def _hinglish_normal(text: Column) -> Column:
    out = F.regexp_replace(F.translate(text, DEVANAGARI_DIGITS, "0123456789"), to_java(r"(?<=\d),(?=\d)"), "")
    out = F.regexp_replace(F.lower(_rupees(out)), to_java(r"(?<=\d)\s?%"), " percent")
    out = F.replace(out, F.lit("&"), F.lit(" and "))
    # Digits here are those that str.isdigit knows: decimal ones, superscripts and the like.
    digit = r"[\p{Nd}²³¹⁰-⁹₀-₉]"
    out = F.regexp_replace(out, rf"(?!(?<={digit})\.(?={digit}))[\p{{P}}\p{{S}}]", " ")
    same = F.create_map(*[F.lit(x) for pair in VARIANTS.items() for x in pair])
    words = F.filter(F.split(_collapsed(out), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(same, w), w)), " ")


def _hits(text: Column, pattern: Pattern, order: int) -> Column:
    """A pattern's matches that pass its check and its context, ready to be sorted."""
    looks = bool(pattern.deny or pattern.require)
    found = places(text, pattern.java, CONTEXT_WINDOW if looks else 0)
    if pattern.check:
        check = pattern.check
        found = F.filter(found, lambda x: F.coalesce(check(x["value"]), F.lit(False)))
    if pattern.deny:
        deny = to_java(pattern.deny, ignore_case=True).replace("$", r"\z")
        found = F.filter(found, lambda x: ~x["before"].rlike(deny))
    if pattern.require:
        require = to_java(pattern.require, ignore_case=True).replace("$", r"\z")
        found = F.filter(found, lambda x: x["before"].rlike(require))
    if looks:
        found = F.transform(found, lambda x: F.struct(x["start"], x["end"], x["value"]))
    found = F.when(text.rlike(pattern.hint), found).otherwise(none())
    return F.transform(
        found,
        lambda x: F.struct(
            x["start"].alias("start"),
            (x["start"] - x["end"]).alias("minus"),
            F.lit(order).alias("order"),
            F.lit(pattern.name).alias("type"),
            x["end"].alias("end"),
            x["value"].alias("text"),
        ),
    )


def find_pii(text: Column, pack: Pack) -> Column:
    """Personal data in a text: (type, start, end, text), earliest first; of overlapping matches the first, at one start the longest."""
    if own := pack.custom.get("find_pii"):
        return own(text)
    patterns = pack.all_patterns()
    hits = F.array_sort(F.concat(*[_hits(text, p, i) for i, p in enumerate(patterns)]))

    def keep(acc: Column, x: Column) -> Column:
        span = F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))
        overlaps = (F.size(acc) > 0) & (x["start"] < F.try_element_at(acc, F.lit(-1))["end"])
        return F.when(overlaps, acc).otherwise(F.concat(acc, F.array(span)))

    some = reduce(lambda a, b: a | b, [text.rlike(h) for h in dict.fromkeys(p.hint for p in patterns)])
    empty = F.from_json(F.lit("[]"), SPANS)
    return F.when(some, F.aggregate(hits, empty, keep)).otherwise(F.when(text.isNotNull(), empty))
