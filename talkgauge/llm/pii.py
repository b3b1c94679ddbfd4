r"""Personal data in texts: patterns, and terms that disclose what the patterns protect.

Four kinds of values are found by pattern, each kind leftmost and non-overlapping for itself: e-mail addresses,
IP addresses (parts up to 255), payment cards (14 to 19 digits that pass Luhn) and phone numbers (10 to
15 digits). A match that fails its check is dropped, and its text is not tried again for that kind.

Hiding the values is not enough where a word gives them away. After Sanchez and Batet ("C-sanitized: a
privacy model for document redaction and sanitization", 2016), the corpus tells how much a term reveals of a
protected value: the pointwise mutual information of the two, as a share of the value's own information
content. Everything is counted in different texts, so that exact copies of a text are one observation and
a passage that different texts share is one in each. A term occurs beside a value if it is among the words next to it.
With n_t texts that hold the term, n_c that hold the value, n_ct with the term beside it and N texts in all

    disclosure = log(n_ct N / (n_c n_t)) / log(N / n_c)

which is 1 if the term occurs beside the value only. Terms seen beside a value in MIN_CONTEXTS texts or
more are generalised (replaced by the kind of value that they point to) from GENERALISE on, and removed from
REMOVE on, in every text.

The patterns are written so that Java's matcher scans each character a bounded number of times and never
recurses: single separators are first marked by a one-character rule, and the marks then belong to a
character class. Marking keeps every position; the mark characters themselves are taken out of the text
before. All is done with DataFrame functions.

A null text is an empty text: it has no spans, and stays null in the sanitised column. Values that occur in
no other text disclose nothing. Of terms that point to several kinds of values, ties go to the last kind by name.
Repeated rows are treated alike and counted once; texts of any length are taken whole; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.functions.spans import none, places
from talkgauge.llm.common import broadcast_if_small, scratch, without, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

#: Words on each side of a value that make its context; other values between them are passed over.
CONTEXT_WORDS = 5
MIN_CONTEXTS = 3
GENERALISE, REMOVE = 0.8, 0.95
WORD = r"\p{L}{3,}"

_DOT, _GAP, _NONE, _VALUE = "\x01", "\x02", "\x03", "\x04"
_LOCAL = rf"A-Za-z0-9._%+{_DOT}\-"
_EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"(?<![0-9{_GAP}])[0-9][0-9{_GAP}]{{13,36}}(?![0-9{_GAP}])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"


def base_spans(text: Column) -> Column:
    """The values of all kinds in a text that is not null: (start, k, end, value), by start and then kind.

    The value is as it is counted: addresses in lower case, of cards and phones the digits.
    """
    clean = F.translate(text, _DOT + _GAP, _NONE + _NONE)
    dotted = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    spaced = F.regexp_replace(clean, "(?<=[0-9])[ -](?=[0-9])", _GAP)
    some_digit = text.rlike("[0-9]")
    email = F.when(F.contains(text, F.lit("@")), places(dotted, _EMAIL)).otherwise(none())
    ip = F.when(some_digit & text.rlike(r"[0-9]\.[0-9]"), places(text, _IP)).otherwise(none())
    card = F.when(some_digit, places(spaced, _CARD)).otherwise(none())
    phone = F.when(F.contains(text, F.lit("+")), places(text, _PHONE)).otherwise(none())

    def small(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+", "")
        return (F.length(digits) <= 3) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255)

    def digits_of(x: Column) -> Column:
        return F.regexp_replace(x["value"], "[^0-9]", "")

    checked = (
        email,
        F.filter(ip, lambda x: F.forall(F.split(x["value"], r"\."), small)),
        F.filter(card, lambda x: F.length(digits_of(x)).between(14, 19) & F.call_function("luhn_check", digits_of(x))),
        F.filter(phone, lambda x: F.length(digits_of(x)).between(10, 15)),
    )

    said = (lambda x: F.lower(F.translate(x["value"], _DOT, ".")), lambda x: x["value"], digits_of, digits_of)

    def marked(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), said[k](x).alias("value")))

    return F.array_sort(F.concat(*[marked(spans, k) for k, spans in enumerate(checked)]))


def _digest(spans: Column, names: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, k: int) -> Column:
    """How many spans are of the k-th kind."""
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def kind_names() -> Column:
    return F.array(*[F.lit(k) for k in (*KINDS, TERM)])


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return _digest(spans, kind_names())


_STRETCHES = "array<struct<start:int,end:int,say:string,of:array<struct<k:int,value:string>>>>"


def _stretches(spans: Column) -> Column:
    """The stretches that spans (start, k, end, value, say) cover, each with what its first span says and what it holds."""

    def merge(acc: Column, x: Column) -> Column:
        last, held = F.element_at(acc, -1), F.array(F.struct(x["k"].alias("k"), x["value"].alias("value")))
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["say"].alias("say"), held.alias("of"))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["say"].alias("say"), F.concat(last["of"], held).alias("of"))
        inside = (F.size(acc) > 0) & (x["start"] < F.when(F.size(acc) > 0, last["end"]))
        return F.when(inside, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(own)))

    return F.aggregate(spans, F.from_json(F.lit("[]"), _STRETCHES), merge)


def _replaced(text: Column, stretches: Column, by) -> Column:
    """``text`` with every stretch replaced by what ``by`` makes of it."""
    begins = F.concat(F.array(F.lit(0)), F.transform(stretches, lambda x: x["end"]))
    pieces = F.zip_with(
        begins,
        F.concat(stretches, F.array(F.lit(None).cast(_STRETCHES[6:-1]))),
        lambda at, x: F.when(x.isNull(), F.substring(text, at + 1, F.length(text))).otherwise(F.concat(F.substring(text, at + 1, x["start"] - at), by(x))),
    )
    return F.array_join(pieces, "")


def _saying(spans: Column, say) -> Column:
    """Spans (start, k, end, value) with ``say``, which is made of each span."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), x["value"].alias("value"), say(x).alias("say")))


def with_base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base_spans: (start, k, end) by start and kind, in code points of the text."""
    docs = without(docs, "base_spans")
    return docs.withColumn("base_spans", base_spans(F.coalesce(F.col(text_col), F.lit(""))))


def _text_key(text: Column) -> list[Column]:
    """What stands for a text in joins: 128 bits of hashes, and its length."""
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(1), text).alias("key2"), F.length(text).alias("key3")]


def contexts(spanned: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, value, words, key1, key2) of every base span: the words nearest to it, CONTEXT_WORDS on each side.

    Values are replaced by marks, and a text's words and marks are listed in order: the words before the j-th mark are
    then as many as its place less j.
    """
    rows = spanned.filter(F.size("base_spans") > 0).select(F.col(text_col).alias("text"), _stretches(_saying(F.col("base_spans"), lambda _: F.lit(""))).alias("stretches"))
    marked = _replaced(F.translate("text", _VALUE, " "), F.col("stretches"), lambda _: F.lit(_VALUE))
    rows = rows.select(*_text_key(F.col("text"))[:2], "stretches", F.regexp_extract_all(F.lower(marked), F.lit(f"{WORD}|{_VALUE}"), F.lit(0)).alias("listed"))
    words = F.filter("listed", lambda x: x != _VALUE)
    marks = F.filter(F.transform("listed", lambda x, i: F.when(x == _VALUE, i)), lambda i: i.isNotNull())
    rows = rows.select("key1", "key2", "stretches", words.alias("words"), F.transform(marks, lambda i, j: i - j).alias("before"))

    def beside(n: Column) -> Column:
        return F.concat(F.slice("words", F.greatest(n - CONTEXT_WORDS, F.lit(0)) + 1, F.least(n, F.lit(CONTEXT_WORDS))), F.slice("words", n + 1, CONTEXT_WORDS))

    each = F.zip_with("stretches", "before", lambda x, n: F.struct(x["of"].alias("of"), F.array_distinct(beside(n)).alias("words")))
    rows = rows.select("key1", "key2", F.inline(each)).select("key1", "key2", "words", F.inline("of"))
    return rows.select(F.element_at(kind_names(), F.col("k") + 1).alias("kind"), "value", "words", "key1", "key2")


def _words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lower))


def disclosing_terms(spanned: DataFrame, text_col: str = "text", min_contexts: int = MIN_CONTEXTS, generalise: float = GENERALISE) -> DataFrame | None:
    """(term, kind, disclosure) of the terms that give a protected value away; None if there is no candidate."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = written(contexts(spanned, text_col).select("kind", "value", "key1", "key2", F.explode_outer("words").alias("term")).distinct())
    per_value = seen.select("kind", "value", "key1", "key2").distinct().groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_c"))
    beside = seen.filter("term is not null")
    pairs = beside.groupBy("kind", "value", "term").agg(F.count(F.lit(1)).alias("n_ct"))
    pairs = pairs.filter(F.col("n_ct") >= min_contexts).join(per_value, ["kind", "value"])
    # log(N / n_c); a term is held by at least the texts that hold it beside some value, which already rules the common words out.
    total = spanned.select(*_text_key(text)[:2]).distinct().count()
    content = F.log(F.greatest(F.lit(float(total)), F.col("n_c") + 1.0) / F.col("n_c"))
    disclosure = lambda n_t: 1 - F.log(F.greatest(n_t, F.col("n_ct")) / F.col("n_ct")) / content
    least = beside.select("term", "key1", "key2").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("least_n_t"))
    pairs = written(pairs.join(least, "term").filter(disclosure(F.col("least_n_t")) >= generalise))
    terms = written(pairs.select("term").distinct())
    if terms.isEmpty():
        return None
    held = spanned.select(*_text_key(text), F.explode(_words(text)).alias("held"))
    held = held.join(broadcast_if_small(terms, F.octet_length("term")), F.col("held") == F.col("term"))
    texts = held.select("term", "key1", "key2").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    scored = pairs.join(texts, "term")
    scored = scored.withColumn("disclosure", disclosure(F.col("n_t"))).filter(F.col("disclosure") >= generalise)
    worst = scored.groupBy("term").agg(F.max(F.struct("disclosure", "kind")).alias("worst"))
    return written(worst.select("term", F.col("worst.kind").alias("kind"), F.col("worst.disclosure").alias("disclosure")))


def sanitise(docs: DataFrame, text_col: str = "text", min_contexts: int = MIN_CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with base_spans, spans (also those of disclosing terms: k is 4, with what to say) and sanitised."""
    docs = without(docs, "base_spans", "spans", "sanitised")
    spanned = with_base_spans(docs, text_col)
    text, keys = F.col(text_col), _text_key(F.coalesce(F.col(text_col), F.lit("")))
    places_of = F.array(*[F.lit(PLACEHOLDERS[k]) for k in KINDS])
    with scratch(docs.sparkSession) as keep:
        terms = disclosing_terms(spanned, text_col, min_contexts, generalise)
        hits = None
        if terms is not None:
            said = F.when(F.col("disclosure") >= remove, F.lit("")).otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit(" TERM]")))
            known = broadcast_if_small(terms.select("term", said.alias("say")), F.octet_length("term"))
            held = docs.select(*keys, F.explode(_words(F.coalesce(text, F.lit("")))).alias("held")).join(known, F.col("held") == F.col("term"))
            hits = held.groupBy("key1", "key2", "key3").agg(F.map_from_entries(F.collect_set(F.struct("term", "say"))).alias("_says"))
            hits = keep(hits.select("_says", *[F.col(f"key{i}").alias(f"_hit{i}") for i in (1, 2, 3)]))
    spans = _saying(F.col("base_spans"), lambda x: F.element_at(places_of, x["k"] + 1))
    joined = spanned
    if hits is not None:
        joined = spanned.join(broadcast_if_small(hits, 64 * F.size("_says")), (keys[0] == F.col("_hit1")) & (keys[1] == F.col("_hit2")) & (keys[2] == F.col("_hit3")), "left")
        found = F.filter(places(text, WORD), lambda x: F.map_contains_key(F.col("_says"), F.lower(x["value"])))
        found = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("k"), x["end"].alias("end"), F.lower(x["value"]).alias("value")))
        found = _saying(found, lambda x: F.element_at(F.col("_says"), x["value"]))
        # A term inside a value is covered by it already.
        found = F.filter(found, lambda x: ~F.exists("base_spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        spans = F.when(F.col("_says").isNull(), spans).otherwise(F.array_sort(F.concat(spans, found)))
    out = joined.withColumn("_spans", spans)
    clean = F.when(F.size("_spans") > 0, _replaced(text, _stretches(F.col("_spans")), lambda x: x["say"])).otherwise(text)
    # The values themselves stay behind.
    place = lambda x: (x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"))
    return out.select(
        *[spanned[c] for c in docs.columns],
        F.transform("base_spans", lambda x: F.struct(*place(x))).alias("base_spans"),
        F.transform("_spans", lambda x: F.struct(*place(x), x["say"].alias("say"))).alias("spans"),
        clean.alias("sanitised"),
    )
