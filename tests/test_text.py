"""Text rules against Python's own re on the same patterns, and fixed expectations."""

import re

import pytest
from pyspark.sql import functions as F

from talkgauge.functions import checksums, names, text
from talkgauge.functions.packs import CONTEXT_WINDOW, Pack, get_pack, list_packs, register

TEXTS = [
    "Mail me at ann.lee+x@shop.example.co.uk or call (415) 555-0134.",
    "my ssn is 123-45-6789, again 123456789; ssn 123456789 and order 4155550134",
    "card 4111 1111 1111 1111 and order number is 4111111111111111; 5500-0000-0000-0004",
    "iban gb82 west 1234 5698 7654 32 please, ZZ82WEST12345698765432, DE89370400440532013000",
    "Aadhaar 2363 2363 2363 or 234567890124, PAN abcpe1234f, phone +91 98765 43210, invoice 9876543210",
    "NI ab 12 34 56 c, mobile 07700 900123, landline 020 7946 0958, x07700900123",
    "order cancel karke mera 9876543210 par call karo 😀 test@example.com",
    "₹1,00,000 का order ०१२३ 98765-43210",
    "",
    "no data here at all",
    "9876543210 9876543211 a/c 9876543212 tracking no: 9876543213",
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for i, n in enumerate(reversed(d))) % 10 == 0


def iban(s):
    s = "".join(s.split()).upper()
    if checksums.IBAN_LENGTH.get(s[:2]) != len(s) or not s.isalnum():
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def verhoeff(s):
    d = "".join(c for c in s if c.isdigit())
    return checksums.verhoeff_digit(d[:-1]) == int(d[-1])


CHECKS = {"card_number": luhn, "iban": iban, "aadhaar": verhoeff}


def brute(pack, t):
    hits = []
    for order, p in enumerate(pack.all_patterns()):
        for m in re.finditer(p.regex, t, re.I if p.ignore_case else 0):
            before = t[max(0, m.start() - CONTEXT_WINDOW) : m.start()]
            if p.name in CHECKS and not CHECKS[p.name](m[0]):
                continue
            if p.deny and re.search("(?i)" + p.deny, before) or p.require and not re.search("(?i)" + p.require, before):
                continue
            hits.append((m.start(), m.start() - m.end(), order, p.name, m.end()))
    kept = []
    for start, _, _, name, end in sorted(hits):
        if not kept or start >= kept[-1][2]:
            kept.append((name, start, end))
    return kept


@pytest.mark.parametrize("pack_id", list_packs())
def test_pii_like_re(spark, pack_id):
    pack = get_pack(pack_id)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    got = {r.i: r.s for r in df.select("i", text.find_pii(F.col("t"), pack).alias("s")).collect()}
    for i, t in enumerate(TEXTS):
        assert [(s.type, s.start, s.end) for s in got[i]] == brute(pack, t), t
        assert all(t[s.start : s.end] == s.text for s in got[i])
    assert got[len(TEXTS)] is None


def test_pii_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    pack = get_pack("en-US")
    for r in docs.select("text", text.find_pii(F.col("text"), pack).alias("s")).collect():
        assert [(s.type, s.start, s.end) for s in r.s] == brute(pack, r.text)


def test_verhoeff_finds_every_single_error():
    number = "23632363236"
    whole = number + str(checksums.verhoeff_digit(number))
    assert verhoeff(whole)
    wrong = [whole[:i] + c + whole[i + 1 :] for i in range(12) for c in "0123456789" if c != whole[i]]
    assert not any(verhoeff(w) for w in wrong)


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("pack", "raw", "normal"),
    [
        ("en-US", "It's $1,200.50, i.e. 10 % off & more!", "it s 1200.50 dollars i e 10 percent off and more"),
        ("en-GB", "£3 each", "3 pounds each"),
        ("en-IN", "₹2,00,000 or Rs. 5 lakh", "200000 rupees or 5 lakh rupees"),
        ("hi-Latn-IN", "Nahin, ₹१,००० thik hai! 3.5 %", "nahi 1000 rupees theek hai 3.5 percent"),
        ("hi-Latn-IN", "मुझे मदद चाहिए।", "मुझे मदद चाहिए"),
    ],
)
def test_normal_form(spark, pack, raw, normal):
    assert one(spark, raw, lambda t: text.normalize_text(t, get_pack(pack))) == normal


@pytest.mark.parametrize(
    ("raw", "lang", "mix"),
    [
        ("order cancel kar do", "hi-Latn", ["hi-Latn", "en-IN"]),
        ("please cancel my order", "en-IN", ["en-IN"]),
        ("मुझे refund चाहिए और जल्दी चाहिए", "hi", ["hi", "en-IN"]),
        ("", "en-IN", ["en-IN"]),
        ("cancel कर my whole order now please", "en-IN", ["en-IN", "hi"]),
    ],
)
def test_languages(spark, raw, lang, mix):
    pack = get_pack("hi-Latn-IN")
    assert one(spark, raw, lambda t: text.detect_lang(t, pack)) == lang
    assert one(spark, raw, lambda t: text.lang_mix(t, pack)) == mix


def test_words_and_paragraphs(spark):
    raw = "Hello wörld मदद 2nd\n \n\nsecond_part\n\n \n"
    assert one(spark, raw, text.word_count) == len(re.findall(r"\w+", raw))
    assert one(spark, raw, text.paragraphs) == ["Hello wörld मदद 2nd", "second_part"]


def test_packs_inherit():
    hinglish = get_pack("hi-Latn-IN")
    assert set(hinglish.all_languages()) == {"hi-Latn", "hi", "en-IN", "en"}
    assert [p.name for p in hinglish.all_patterns()] == ["aadhaar", "pan", "phone", "email", "card_number", "iban"]
    assert [p.name for p in get_pack("en-US").all_patterns()] == ["ssn", "ssn", "phone", "email", "card_number", "iban"]
    assert hinglish.resolved("call_recording_consent") == "notice_required"
    assert hinglish.resolved("formats").date_order == "DMY"
    with pytest.raises(KeyError, match="known"):
        get_pack("xx")


def test_custom_pack_rules(spark):
    pack = register(Pack("en-XX", languages=("en-XX",), parent="en", custom={"detect_lang": lambda t: F.when(t.contains("!"), "loud").otherwise("en-XX")}))
    assert one(spark, "hey!", lambda t: text.detect_lang(t, pack)) == "loud"
    assert one(spark, "A, B", lambda t: text.normalize_text(t, pack)) == "a b"


def test_names():
    assert names.exchange(["Customer", "x", "Agent"]) == ("Customer", "Agent")
    assert names.question(["Question", "Answer"]) == ("Question", "Answer")
    assert names.message(["conv_id", "Role", "Text"]) == ("Role", "Text")
    assert names.labelled(["sentence", "intent"]) == ("sentence", "intent")
    assert names.tools("Orders", ["Ticket ID", "Customer-ID", "Order No", "sku", "Status"])[2] == ["lookup_orders_by_ticket_id", "lookup_orders_by_customer_id", "lookup_orders_by_order_no"]
    assert names.tools("t", ["id", "text", "category"]) == (["id"], ["text", "category"], [])
    assert [names.header_kind(x) for x in ("Customer Name", "Billing Address", "DOB", "Product Name", "Name", "Address Line 1")] == ["person_name", "address", "date_of_birth", None, None, "address"]
    assert names.cue("zip_plus_four") == "zip plus four: "
