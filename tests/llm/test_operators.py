"""Each operator against a brute-force version, on awkward rows and on the smallest tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgauge.llm import bpe, components, embedding_dedup, langid, licenses, mixing, mpegts, ngram_join, packing, pii, queries, warc
from tests.llm.fixtures import BASE, awkward, empty

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).persist()


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# ---- 1 -------------------------------------------------------------------------------------------------------


def luhn(d):
    return sum(n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0


def spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for k, pattern, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if lo <= len(d) <= hi and (k == 3 or luhn(d)):
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


TRICKY = [
    "a@b.c%d@e.f x@y.z.w. q@r.s a.b.@c.d..e @ f@g.h ..@a.b a@b@c.d",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 0000000255.1.1.1 1..2.3.4.5",
    "4111 1111-1111 1111 4111-1111-1111-11111 41111111111111 4111  1111 1111 1111 6011-0000-0000-0004-5",
    "+1 (212) 555-0147 +12 +44.20.7946.0958+1 234 567 8901 + 1 +1-",
    "",
    "é😀 a@b.co 10.0.0.1\n+49 30 1234567 4532\x010151\x021283\x030366",
    "a" * 60_000 + "@b.com " + "1 " * 30_000 + "4." * 30_000,
    "a@b" + ".g" * 30_000,
    " ".join(f"10.0.{i % 256}.{i % 199}" for i in range(2000)),
]


def test_pii_patterns(spark, docs, small):
    rows = [*enumerate(TRICKY), *[(1000 + i, t) for i, t in small]]
    found = pii.with_base_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in found.select("text", pii.spans_text(F.col("base_spans")).alias("s")).collect():
        assert r.s == spans(r.text), r.text[:100]
    got = {r.doc_id: r.s for r in pii.with_base_spans(docs).select("doc_id", pii.spans_text(F.col("base_spans")).alias("s")).collect()}
    assert got[9] == spans(docs.filter("doc_id = 9").first().text) and got[4] == got[5] == ""


def test_pii_terms(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        words = ["".join(rng.choice(x) for x in ("bcdfg", "aeiou", "klmnp", "aeiou")) for _ in range(30)]
        if i % 50 == 0:
            words[10:10] = ["Zorblax", "ann@corp.example", "the"]
        rows.append((i, " ".join(words) + f" the {i}"))
    rows += [(900, "plain zorblax here"), (901, None), (902, "")]
    rows += [(1000 + i, "Kwyjibo rare@one.example says") for i in range(9)]  # copies of one context are one observation
    clean = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[900].sanitised == "plain  here" and clean[901].sanitised is None and clean[902].sanitised == ""
    assert "Zorblax" not in clean[50].sanitised and "[EMAIL]" in clean[50].sanitised and " the " in clean[50].sanitised
    assert clean[1003].sanitised == "Kwyjibo [EMAIL] says"
    assert [s.k for s in clean[50].spans] == [4, 0]
    assert clean[1].sanitised == rows[1][1]


def test_pii_terms_of_a_shared_signature(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(x) for x in ("bcdfg", "aeiou", "klmnp", "aeiou"))
    signed = " Sales lead Zorblax Kwyj, write to ann@corp.example for any open order"
    bodies = [" ".join(word() for _ in range(30)) + " sales lead write for any open order" for _ in range(300)]
    rows = [(i, b + (signed if i % 30 == 0 else "")) for i, b in enumerate(bodies)]
    rows += [(900, "plain zorblax here"), *[(1000 + i, "Qwertz said rare@one.example once") for i in range(50)]]
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[30] == bodies[30] + " Sales lead  , write to [EMAIL] for any open order"
    assert clean[900] == "plain  here" and clean[1] == bodies[1]
    assert clean[1000] == "Qwertz said [EMAIL] once"  # exact copies are one text


def brute_terms(texts, least=3, generalise=0.8):
    """The disclosing terms, counted text by text: {term: (kind, disclosure)}."""
    texts = sorted(set(texts))
    words_of = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}
    holds, beside, held = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        for w in words_of(t):
            held[w].add(i)
        found = sorted((int(s), k, int(e)) for k, s, e in (x.split(":") for x in spans(t).split(",") if x))
        stretches = []
        for s, k, e in found:
            if stretches and s < stretches[-1][1]:
                stretches[-1] = (stretches[-1][0], max(e, stretches[-1][1]), stretches[-1][2] + [(k, s, e)])
            else:
                stretches.append((s, e, [(k, s, e)]))
        for a, b, own in stretches:
            blank = list(t)
            for x, y, _ in stretches:
                blank[x:y] = " " * (y - x)
            near = re.findall(r"[^\W\d_]{3,}", "".join(blank[:a]))[-5:] + re.findall(r"[^\W\d_]{3,}", "".join(blank[b:]))[:5]
            for k, s, e in own:
                raw = t[s:e]
                value = (k, raw.lower() if k == "email" else raw if k == "ip" else re.sub("[^0-9]", "", raw))
                holds[value].add(i)
                for w in {w.lower() for w in near}:
                    beside[value, w].add(i)
    out = {}
    for (value, w), seen in beside.items():
        n_c, n_t, n_ct = len(holds[value]), max(len(held[w]), len(seen)), len(seen)
        score = 1 - np.log(n_t / n_ct) / np.log(max(len(texts), n_c + 1) / n_c)
        if n_ct >= least and score >= generalise:
            out[w] = max(out.get(w, (0, "")), (score, value[0]))
    return out


def test_pii_terms_like_brute_force(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice(x) for x in ("bcdfg", "aeiou", "klmnp", "aeiou", "rst")) for _ in range(300)]
    secrets = [("ann@corp.example", "Zorblax"), ("10.1.2.3", "Kwyjibo"), ("+1 (212) 555-0147", "Vexor"), ("4111 1111 1111 1111", "Quonset"), ("bo.b@x.example.org", "Wibble" * 30)]
    texts = []
    for i in range(300):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        for value, name in rng.sample(secrets, rng.randrange(0, 4)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice([[name, value], [value, "is", name], [name, "10.9.9.9", "200.0.0.1", value], [value]])
        texts += [" ".join(body)] * rng.choice([1, 1, 3])
    rows = [*enumerate(texts), (9000, None), (9001, "")]
    terms = pii.disclosing_terms(pii.with_base_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = brute_terms([t or "" for _, t in rows])
    assert len(want) > 3 and {r.term: (pytest.approx(r.disclosure), r.kind) for r in terms} == want


def test_pii_awkward(docs, spark):
    out = pii.sanitise(docs)
    assert out.count() == docs.count() and pii.sanitise(empty(spark)).count() == 0
    assert out.filter("doc_id = 9").first().sanitised == "mail [EMAIL] or [PHONE], card 4111 1111 1111 1111 1 at [IP]"


# ---- 2 -------------------------------------------------------------------------------------------------------


def license_matches(t, templates=licenses.TEMPLATES):
    templates = [(n, licenses.template_words(x)) for n, x in templates]
    line_words = lambda x: [] if re.match(r"(?i)^[\W_]*copyright\b", x) else licenses.template_words(x)
    parts, lines, paragraphs = {}, t.split("\n"), re.split(r"\n[ \t]*\n\s*", t)
    parts["text0"] = [w for x in lines for w in line_words(x)]
    parts |= {f"line{i}": line_words(x) for i, x in enumerate(lines) if len(lines) > 1}
    parts |= {f"paragraph{i}": [w for x in p.split("\n") for w in line_words(x)] for i, p in enumerate(paragraphs) if len(paragraphs) > 1}
    out = []
    for name, w in parts.items():
        best = (0, "")
        for n, tw in templates:
            if len(w) > 1:
                both = sum((Counter(zip(w, w[1:])) & Counter(zip(tw, tw[1:]))).values())
                dice = 2 * both / (len(w) + len(tw) - 2)
                best = max(best, (dice, n), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        if best[0] >= licenses.THRESHOLD:
            out.append((name, best[1], round(best[0], 6)))
    return sorted(out)


def test_licenses(spark, small, docs):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    rows = [*small, (-1, f"Copyright (c) 2020 Ann\n\n{mit}"), (-2, "# " + mit.replace(". ", ".\n# ")), (-3, mit + " and more" * 200), (-4, "LICENSED under the mit license!\nx"), (-5, ("Released under the MIT License. " * 40).strip())]
    got = {r.doc_id: sorted((x.part, x.license, round(x.dice, 6)) for x in r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == license_matches(t), (i, t[:80])
    assert got[-1] and got[-2] and got[-4] and not got[-3]
    out = licenses.scan(docs)
    assert out.count() == docs.count() and out.filter("doc_id = 7").first().licenses[0].license == "MIT"
    assert licenses.scan(empty(spark)).count() == 0


def test_license_runs(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and len(t) > 200)
    isc = next(t for n, t in licenses.TEMPLATES if n == "ISC")
    three = mit.replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    more = "further words of a longer document that say something else\n\n" * 20
    wrapped = lambda t, mark: "\n".join(mark + " ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    code = "\n".join(f"x{i} = call(y{i}, z{i})" for i in range(60))
    rows = [
        (1, f"{more}MIT License\n\nCopyright (c) 2020 Ann\n\n{three}\n\n{more}"),
        (2, f"{code}\n//\n{wrapped(gpl, '// ')}\n//\n{code}"),
        (3, f"/*\n * about\n *\n{wrapped(isc, ' * ')}\n */\n{code}"),
        (4, more + code),
        (5, three),
    ]
    got = {r.doc_id: [(x.part, x.license, x.dice) for x in r.licenses] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x[:2] for x in got[1]] == [("lines44-48", "MIT")] and got[1][0][2] == 1
    assert [x[1:] for x in got[2]] == [("GPL-3.0", 1.0)] and [x[1:] for x in got[3]] == [("ISC", 1.0)]
    assert got[4] == [] and [x[:2] for x in got[5]] == [("text0", "MIT")]


def brute_runs(t, templates):
    """Every run of lines against every template; the best that begins at a line, unless a better one or a part makes it needless."""
    raw, parts, sizes = t.split("\n"), [], [(n, licenses.template_words(x)) for n, x in templates]
    words = [[] if re.match(r"(?i)^[\W_]*copyright\b", x) else licenses.template_words(x) for x in raw]
    paragraph, at = [], 0
    separators = [m.start() for m in re.finditer(r"\n[ \t]*\n\s*", t)]
    for x in raw:
        paragraph.append(sum(begin < at for begin in separators))
        at += len(x) + 1
    full = [i for i, w in enumerate(words) if w]
    best = []
    for k in range(len(full)):
        tried = []
        for e in range(k + 1, len(full)):
            w = [x for i in full[k : e + 1] for x in words[i]]
            own = Counter(zip(w, w[1:]))
            begins = set(list(zip(w, w[1:]))[: len(words[full[k]])])
            for name, tw in sizes:
                if not begins & set(zip(tw, tw[1:])):
                    continue  # it begins with a line that has nothing of the template
                both = sum((own & Counter(zip(tw, tw[1:]))).values())
                dice = 2 * both / (len(w) - 1 + len(tw) - 1)
                if dice >= licenses.THRESHOLD:
                    tried.append((-dice, e - k, k, name))
        if tried:
            best.append(min(tried))
    best = [x for x in best if not any(y < x and y[2] <= x[2] + x[1] and x[2] <= y[2] + y[1] for y in best)]
    out = []
    for minus, more, k, name in best:
        a, b = full[k], full[k + more]
        needless = False
        for part, said, dice in license_matches(t, templates):
            kind, no = re.match(r"([a-z]+)(\d+)", part).groups()
            meets = kind == "text" or (a <= int(no) <= b if kind == "line" else paragraph[a] <= int(no) <= paragraph[b])
            holds = kind == "text" or kind == "paragraph" and paragraph[a] == paragraph[b] == int(no)
            good, same = dice >= round(-minus, 6), said == name
            needless |= meets and ((same or holds) and good or same and holds)
        if not needless:
            out.append((f"lines{a}-{b}", name, round(-minus, 6)))
    return out


def test_license_runs_like_brute_force(spark):
    rng = random.Random(12)
    templates = (
        ("A", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
        ("B", "go on go on go on and stop go on then stop and go"),
        ("C", "alpha beta gamma delta epsilon zeta and then something else entirely ends"),
        ("D", "nu xi omicron pi rho sigma tau upsilon phi chi psi omega alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    )
    rows = []
    for i in range(160):
        text = ""
        for _ in range(rng.randrange(1, 6)):
            body = list(rng.choice(templates)[1].split()) if rng.random() < 0.8 else ["noise", "words", "here"] * rng.randrange(1, 6)
            for _ in range(rng.randrange(0, 3)):
                body[rng.randrange(len(body))] = rng.choice(["odd", "go", "on", "alpha", "beta"])
            text += "".join(w + rng.choice([" ", " ", " ", "\n", "\n// ", "\n\n", "\n \n\t", "\n***\n", "\nCopyright 2020 x\n", "\n\x0b\n"]) for w in body)
            text += rng.choice(["", "\n", "\n\n", "tail "])
        rows.append((i, text))
    df = spark.createDataFrame(rows + rows[:20], "doc_id long, text string")
    got = defaultdict(list)
    for r in licenses.scan(df, templates=templates).collect():
        got[r.doc_id].append(sorted((x.part, x.license, round(x.dice, 6)) for x in r.licenses))
    found = 0
    for i, t in rows:
        want = brute_runs(t, templates)
        found += len(want)
        for x in got[i]:
            assert x == sorted(license_matches(t, templates) + want), t
    assert found > 40 and all(len(got[i]) == 2 for i in range(20))


def test_license_folder(spark, tmp_path):
    body = "First part of a licence text that is long enough.\n\nSecond part of the licence, which is also long enough to be one."
    (tmp_path / "Own-1.0.txt").write_text(body)
    templates = licenses.read_templates(spark, str(tmp_path))
    assert [n for n, _ in templates] == ["Own-1.0"] * 3
    df = spark.createDataFrame([(1, "some words before\n\n" + body.split("\n\n")[1] + "\n\nand after"), (2, body)], "doc_id long, text string")
    assert {r.doc_id: {(x.license, x.part) for x in r.licenses} for r in licenses.scan(df, templates=templates).collect()} == {
        1: {("Own-1.0", "paragraph1"), ("Own-1.0", "line2")},
        2: {("Own-1.0", "text0"), ("Own-1.0", "paragraph0"), ("Own-1.0", "paragraph1"), ("Own-1.0", "line0"), ("Own-1.0", "line2")},
    }


def test_license_bounds():
    for size in range(2, 60):
        lo, hi = licenses.bounds(size, 0.85)
        best = lambda a: 2 * min(a, size) / (a + size)
        assert best(lo) >= 0.85 - 1e-12 and best(hi) >= 0.85 - 1e-12 and best(lo - 1) < 0.85 and best(hi + 1) < 0.85


# ---- 3 -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def test_bpe(spark, docs, small, tokenizer):
    import tiktoken

    path, pattern = tokenizer
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [t for _, t in small] + ["", None, "  \n\n x\t\ty  ", "naïve 漢字かな 😀👩‍👩‍👧 \x00\x01", "<|endoftext|>", "a" * 5000, "⁇ <unk> ▁", "don't I'LL 123456789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.decode(bpe.encode(df, path, pattern), path, pattern, ["doc_id"]).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        ids = exact.encode_ordinary(t)
        assert r.n_tokens == len(ids) and r.decoded == t.encode(), t[:50]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert len(rows) == len(texts)
    assert bpe.encode(docs, path, pattern).count() == docs.count() and bpe.encode(empty(spark), path, pattern).count() == 0


def test_bpe_every_token_is_itself(tokenizer):
    ranks = bpe.read_ranks(tokenizer[0])
    model, tokens = bpe.serialise_model(ranks)
    codec = bpe.Codec(model, tokens, [0, *(ranks[t] for t in tokens[1:])], tokenizer[1])
    assert all(codec.decode(codec.encode(t)) == t.encode() for t in ("x", " y", "é"))
    codec.whole = {}  # without the short cut, merges lead to the same token
    some = [t.decode() for t in random.Random(3).sample(tokens[1:], 3000) if not any(b > 127 for b in t)]
    same = sum(codec.encode(t) == np.array([ranks[t.encode()]], "<u4").tobytes() for t in some if len(codec.split(t)) == 1)
    assert same > 0.99 * sum(len(codec.split(t)) == 1 for t in some)


# ---- 4 -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 10, 169, 170, 175, 176, 177, 183, 184, 185, 576, 18_431, 18_432, 18_433, 40_000, 300_000])
def test_transport_stream(n):
    payload = random.Random(n).randbytes(n)
    media = mpegts.multiplex(payload)
    out = mpegts.demultiplex(media)
    pes = -(-n // 18_432)
    assert out["payload"] == payload and out["cc_errors"] == 0 and out["n_pes"] == pes and len(media) % 188 == 0
    assert out["pts"] == [k * 32 * 6480 for k in range(pes)] and out["random_access"] == list(range(0, pes, 4))


def test_transport_stream_damage():
    media = mpegts.multiplex(b"x" * 20_000)
    assert mpegts.demultiplex(media[: 188 * 5] + media[188 * 6 :])["cc_errors"] == 1
    with pytest.raises(ValueError, match="damaged"):
        mpegts.demultiplex(media[:10] + b"\x55" + media[11:])
    with pytest.raises(ValueError, match="synchronisation"):
        mpegts.demultiplex(b"\0" + media[1:])


def plain_reader(media):
    """A second reader of transport streams, packet by packet: payload, stamps and random-access points."""
    sections, counter, pes, stamps, marks, program_map, stream = {}, None, [], [], [], None, None
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47
        pid, start, has_field, counter_now = (p[1] & 31) * 256 + p[2], p[1] >> 6 & 1, p[3] >> 5 & 1, p[3] & 15
        body = p[4 + (p[4] + 1 if has_field else 0) :]
        if pid in (0, program_map):
            table = body[1 + body[0] :]
            size = 3 + (table[1] & 15) * 256 + table[2]
            assert zlib.crc32(bytes(int(f"{b:08b}"[::-1], 2) for b in table[: size - 4])) ^ 0xFFFFFFFF == int(f"{int.from_bytes(table[size - 4 : size], 'big'):032b}"[::-1], 2)
            sections[pid] = table[8 : size - 4]
            if pid == 0:
                program_map = int.from_bytes(sections[0][2:4], "big") & 0x1FFF
            else:
                stream = int.from_bytes(sections[pid][5:7], "big") & 0x1FFF
        elif pid == stream:
            assert counter is None or counter_now == (counter + 1) % 16
            counter = counter_now
            if start:
                pes.append(b"")
                if has_field and p[4] and p[5] & 0x40:
                    marks.append(len(pes) - 1)
            pes[-1] += body
    payload = b""
    for x in pes:
        assert x[:4] == b"\0\0\1\xbd" and int.from_bytes(x[4:6], "big") == len(x) - 6
        bits = "".join(f"{b:08b}" for b in x[9:14])
        stamps.append(int(bits[4:7] + bits[8:23] + bits[24:39], 2))
        payload += x[9 + x[8] :]
    return payload, stamps, marks


def test_transport_stream_by_another_reader(small):
    for raw in [b"a" * n for n in (576, 576 * 32, 576 * 33, 576 * 130)] + [mpegts.padded(t.encode()) for _, t in small]:
        media = mpegts.multiplex(raw)
        payload, stamps, marks = plain_reader(media)
        x = mpegts.demultiplex(media)
        assert payload == raw == x["payload"] and stamps == x["pts"] and marks == x["random_access"]


def test_media_that_cannot_be_read(spark):
    good = mpegts.multiplex(mpegts.padded(b"z" * 5000))
    packets = [good[i : i + 188] for i in range(0, len(good), 188)]
    jump = bytearray(packets[6])
    jump[3] = jump[3] & 0xF0 | (jump[3] + 5) & 15
    cases = {
        "good": good,
        "repeated packet": b"".join([*packets[:6], packets[5], *packets[6:]]),
        "lost packet": b"".join([*packets[:5], *packets[6:]]),
        "cut": good[:-100],
        "out of step": good[1:] + b"x",
        "no tables": b"".join(packets[2:]),
        "no map": b"".join([packets[0], *packets[2:]]),
        "damaged table": packets[0][:20] + b"\0" + packets[0][21:] + b"".join(packets[1:]),
        "tables only": b"".join(packets[:2]),
        "last lost": b"".join(packets[:-1]),
        "random": random.Random(1).randbytes(188 * 5),
        "field too long": packets[0] + packets[1] + packets[2][:3] + b"\x30\xff" + packets[2][5:] + b"".join(packets[3:]),
        "jump": b"".join([*packets[:6], bytes(jump), *packets[7:]]),
        "null": None,
        "empty": b"",
    }
    got = {r.name: r for r in mpegts.load(spark.createDataFrame([(k, None if v is None else bytearray(v), "own") for k, v in cases.items()], "name string, media binary, error string")).collect()}
    fine = {k for k in cases if got[k].error is None}
    assert fine == {"good", "repeated packet", "lost packet", "tables only", "jump", "null", "empty"}, fine
    assert got["lost packet"].cc_errors == 1 and got["lost packet"].payload == mpegts.padded(b"z" * 5000)[184:]
    assert got["good"].payload == got["repeated packet"].payload == got["jump"].payload == mpegts.padded(b"z" * 5000)
    assert (got["good"].cc_errors, got["repeated packet"].cc_errors, got["jump"].cc_errors) == (0, 0, 2)
    assert got["cut"].payload is None and got["tables only"].payload == b""


def test_media_columns(spark, docs):
    out = mpegts.load(mpegts.store(docs))
    for r in out.collect():
        t = next(x.text for x in docs.collect() if x.doc_id == r.doc_id and (r.doc_id is not None or x.doc_id is None)) or ""
        raw = t.encode()
        assert r.n_bytes == len(raw) and r.payload == raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
    assert mpegts.load(mpegts.store(empty(spark))).count() == 0
    q = queries.op4_media_columns(spark, SF).first()
    assert q.tail_crc32 == zlib.crc32(b"\xff" * 32) or q.payload_bytes == q.n_bytes or q.payload_bytes - q.n_bytes < 32


# ---- 5 -------------------------------------------------------------------------------------------------------


def brute_links(ids, vectors, threshold=0.95):
    good = [i for i, v in enumerate(vectors) if ids[i] is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, low = [0] * len(ids), list(ids)
    links = defaultdict(set)
    for a in good:
        for b in good:
            if a != b and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    n[a] += 1
                    links[a].add(b)
    for _ in ids:
        for a in good:
            low[a] = min([low[a], *[low[b] for b in links[a]]])
    return sorted(zip(map(str, ids), n, map(str, low), strict=True))


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24)).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 7] + rng.normal(size=24).astype("f4") * s).tolist()) for i, s in enumerate(np.linspace(0.05, 0.5, 40))]
    rows += [(200 + i, base[3].tolist()) for i in range(30)] + [(300, (base[3] * 7).tolist()), (301, [0.0] * 24), (302, None), (303, [1.0, None] + [0.0] * 22), (304, [float("nan")] * 24), (305, [float("inf")] * 24)]
    rows += [(306, []), (307, [1.0, 2.0]), (308, [2.0, 4.0]), (None, base[3].tolist()), (5, base[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for tile in (16_384, 16):
        got = embedding_dedup.near_copies(df, tile=tile).collect()
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute_links(*zip(*rows, strict=True))
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_copies(df.limit(0)).count() == 0


def test_embeddings_of_repeated_ids(spark):
    """Links and components belong to vectors: rows of one id with unlike vectors have their own."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.01]), (3, [1.0, 0.0]), (4, [0.0, 5.0]), (1, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "vec_id long, embedding array<float>, first string, key int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_copies(df).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 1, False)]


def test_bounds_stop_nothing_that_links():
    rng = np.random.default_rng(6)
    x = embedding_dedup.unit(np.concatenate([rng.normal(size=(200, 64)), rng.normal(size=(5, 64)).repeat(20, 0) + rng.normal(size=(100, 64)) * 0.2]))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    i, j = embedding_dedup.linked_pairs(x @ axes, x @ axes, x, x, 0.95)
    assert sorted(zip(i, j, strict=True)) == sorted(zip(*np.nonzero(x @ x.T >= 0.95), strict=True))


# ---- 6 -------------------------------------------------------------------------------------------------------


def shingles(t, k):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, percent):
    sets, low = [shingles(t, k) for _, t in rows], {}
    by = defaultdict(set)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[doc] = doc
            for x in sets[i]:
                by[x].add(i)
    pairs = {(min(a, b), max(a, b)) for own in by.values() for a in own for b in own if a != b}
    links = [(rows[a][0], rows[b][0]) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return sorted((str(d), len(s), str(low.get(d))) for (d, _), s in zip(rows, sets, strict=True))


def near_rows():
    rng = random.Random(8)
    rows, words = [], [f"v{i}" for i in range(400)]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 20, 60, 200]))]
        for _ in range(rng.choice([1, 4, 12])):
            own = base[:]
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own = own[: len(own) - rng.randrange(0, 1 + len(own) // 6)] or own
            rows.append((len(rows) * 3 + g, " ".join(own).upper() if rng.random() < 0.2 else "\t".join(own)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, docs, k, percent):
    own = [(r.doc_id, r.text) for r in docs.collect()]
    rows = near_rows() + [(5000 + (i or 0) if i is not None else None, t) for i, t in own]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, k, percent)


def test_jaccard_edges(spark, docs):
    assert ngram_join.jaccard_components(empty(spark)).count() == 0
    kept = ngram_join.first_of_each(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "8", "9", "10", "11", "None", "12"])
    assert kept.columns == docs.columns and BASE in {r.text for r in kept.collect()}


def test_first_of_each_tells_rows_apart(spark):
    other = " ".join(f"z{i}" for i in range(30))
    rows = [(1, BASE, "x"), (1, other, "y"), (1, other, "z"), (2, BASE + " today", "x"), (None, other, "n"), (None, "lone row of five words", "n"), (None, None, "n"), (3, "", "e"), (3, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string")
    kept = sorted((str(r.doc_id), str(r.text)) for r in ngram_join.first_of_each(docs).collect())
    assert kept == sorted([("1", BASE), ("1", other), ("None", "lone row of five words"), ("None", "None"), ("3", ""), ("3", "")])


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1000 + i + 1) for i in range(40)] + [(2000, 2000), (None, 3), (500, 501), (501, 500)]
    low = {x: x for a, b in links if a is not None and a != b for x in (a, b)}
    for _ in range(60):
        for a, b in links:
            if a in low and b in low and a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == low
    half = components.components(spark.createDataFrame(links[:80], "a long, b long"))
    both = components.merged(half, spark.createDataFrame(links[80:], "a long, b long"))
    assert {r.node: r.component for r in both.collect()} == low
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 7 -------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped, left = {}, set(), float(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in capped]
        share = {s: (left - sum(most * sizes[c] for c in capped)) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > most * sizes[s]}
        target = {**{s: most * sizes[s] for s in capped}, **share}
        if not over:
            return target
        capped |= over


def test_mixing(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "c", "é", "Z", "d" * 3, None]) if i % 3 else "hot") for i in range(3000)]
    rows += [(5000, "x " * 3, "tiny"), (5001, None, "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mix(df, chunk=64)
    got = first.collect()
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7), chunk=64).collect()}
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size and again[r.doc_id] == r.taken
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 301 for s in want), (taken, want)
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(empty(spark)).count() == 0
    assert mixing.apply_mix(docs).columns == docs.columns and mixing.apply_mix(empty(spark)).count() == 0


def test_mixing_of_repeated_rows(spark):
    """Unlike rows of one id, null ids, and many equal rows: the copies that ``mix`` counts are those that ``apply_mix`` makes."""
    rng = random.Random(5)
    rows = [(None, " ".join(["n"] * rng.randrange(1, 9)) + f" {i}", "nulls") for i in range(40)]
    rows += [(7, f"text {i} " + "x " * (i % 5), "one id") for i in range(50)]
    rows += [(9, "the same row", "equal")] * 333 + [(10, "other words", "equal")] * 2
    rows += [(100 + i, "w " * rng.randrange(0, 30), "plain") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mixed = mixing.mix(docs, chunk=16).collect()
    want, target = defaultdict(int), {r.source: r.target for r in mixed}
    for r in mixed:
        want[r.source] += r.taken
    made, times = defaultdict(int), Counter()
    for r in mixing.apply_mix(docs, chunk=16).collect():
        made[r.source] += len(WORDS.findall(r.text))
        times[r] += 1
    assert len(mixed) == len(rows) and {k: v for k, v in want.items() if v} == made
    longest = {s: max(len(WORDS.findall(t)) for _, t, x in rows if x == s) for s in target}
    assert all(abs(made[s] - target[s]) <= longest[s] for s in target), (made, target)
    held = Counter(rows)
    assert all(times[r] <= 3 * held[tuple(r)] for r in times) and {r.copies for r in mixed if r.doc_id == 9} <= {0, 1, 2, 3}
    equal = [r.copies for r in mixed if r.doc_id == 9]
    assert max(equal) - min(equal) <= 1


def test_pivot_keeps_words_and_means():
    size, part = np.array([50, 40, 30, 20, 10, 5]), np.array([0.3, 0.7, 0.5, 0.25, 0.9, 0.4])
    rng, total = np.random.default_rng(1), np.zeros(6)
    for _ in range(4000):
        made = mixing.pivot(size, part, rng.random(6))
        assert (size * made).sum() == pytest.approx((size * part).sum()) and ((made > 0) & (made < 1)).sum() <= 1
        total += made
    assert np.abs(total / 4000 - part).max() < 0.04


# ---- 8 -------------------------------------------------------------------------------------------------------


def test_language(spark, docs):
    labelled = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", langid.train_split())
    proto = langid.learn(labelled.filter("not held_out"))
    judged = langid.identify(labelled, proto)
    right = judged.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95 and judged.filter("score < 0 or score > 1").count() == 0
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, proto).collect()}
    assert len(got) == len({r.doc_id for r in docs.collect()}) and got[4] == got[5] == got[6] == got[11] == ("und", 0.0) and got[10][0] == "fr" and got[1] == got[2]
    assert langid.identify(empty(spark), proto).count() == 0 and langid.learn(empty(spark)) == {}
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_profiles_like_brute_force(spark):
    """Prototypes and scores against vectors bound and bundled letter by letter, as the method says."""
    rows = [(1, "Ab ba, çaa!", "x"), (2, "bab", "y"), (3, "ab ab 7 ab", "x"), (4, "zz" * 3000 + " ß", "y"), (5, "ça b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def vector(text):
        words = re.findall(r"[^\W\d_]+", text.lower())
        line, out = " " + " ".join(words) + " ", np.zeros(64)
        for i in range(len(line) - 2 if words else 0):
            bound = np.ones(64)
            for place, c in enumerate(line[i : i + 3]):
                bound *= np.roll(np.random.default_rng((langid.SEED, ord(c))).integers(0, 2, 64, np.int8) * 2.0 - 1, 2 - place)
            out += bound
        return out

    want = {lang: sum(vector(t) / np.linalg.norm(vector(t)) for _, t, x in rows if x == lang) for lang in ("x", "y")}
    want = {k: v / np.linalg.norm(v) for k, v in want.items()}
    got = langid.learn(df, dim=64)
    assert all(np.allclose(got[k], want[k], atol=1e-4) for k in want)
    for r in langid.identify(df, got, dim=64).collect():
        v = vector(r.text)
        cosines = {k: v @ p / np.linalg.norm(v) for k, p in want.items()}
        assert r.lang_pred == max(cosines, key=cosines.get) and r.score == pytest.approx(min(1, max(0, max(cosines.values()))), abs=1e-4)


def test_language_rejects_by_score(spark):
    labelled = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null")
    proto = langid.learn(labelled)
    medians = langid.expected(labelled, proto)
    assert 1 < len(medians) <= 32 and langid.expected(empty(spark), proto) == {}
    rng = random.Random(3)
    letters = "ξψωχφбгджщъ"
    rows = [(1, "Ξ" * 3000), (2, " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(400))), (3, labelled.filter("n_chars > 500").first().text), (4, None), (5, "12 !"), (6, "")]
    judged = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), proto)
    gone = langid.rejects(F.col("text"), F.col("lang_pred"), F.col("score"), medians)
    assert {r.doc_id for r in judged.filter(gone).collect()} == {1, 2, 4, 5, 6}
    assert {r.doc_id for r in judged.filter(~langid.rejects(F.col("text"), F.col("lang_pred"), F.col("score"), {})).collect()} >= {3}


def test_expected_scores_are_of_all_texts(spark):
    """More texts than 65,536, whose scores are all different: every one of them counts, and the medians are exact."""
    proto = langid.learn(spark.createDataFrame([("the quick brown fox jumps over the lazy dog", "en")], "text string, lang string"))
    words = F.concat(F.lit("the "), F.translate(F.hex(F.xxhash64("id")), "0123456789", "ghijklmnop"))
    texts = spark.range(70_000, numPartitions=4).select(F.when(F.col("id") < 69_990, words).otherwise(F.repeat(words, (F.col("id") - 69_980).cast("int"))).alias("text"))
    scores = defaultdict(list)
    for r in langid.identify(texts, proto).collect():
        scores[sum(map(str.isalpha, r.text)).bit_length() - 1].append(r.score)
    want = {c: sorted(s)[(len(s) - 1) // 2] for c, s in scores.items()}
    assert len(want) > 2 and langid.expected(texts, proto) == pytest.approx(want, abs=1e-12)


def test_medians_like_brute_force(spark):
    rng = random.Random(5)
    rows = [(1, rng.random()) for _ in range(2001)] + [(2, 0.5 + k * 2**-53) for k in range(7)] + [(3, 0.0), (3, 1.0), (4, 0.25)] + [(5, x) for x in (0.1, 0.9, 0.9, 0.9)] + [(6, 0.3)] * 40
    want = {c: sorted(s for k, s in rows if k == c)[(sum(k == c for k, _ in rows) - 1) // 2] for c in range(1, 7)}
    scores = spark.createDataFrame(rows, "class int, score double").repartition(5)
    assert langid.medians_of(scores) == langid.medians_of(scores, 2) == want and langid.medians_of(scores.limit(0)) == {}


def test_grams():
    code, owner = langid.grams_of(["Ab c", "", "!d"], 3, {})
    spell = lambda c: "".join(chr(int(c) >> 21 * i & 0x1FFFFF) for i in (2, 1, 0))
    assert [(spell(c), o) for c, o in zip(code, owner, strict=True)] == [(" ab", 0), ("ab ", 0), ("b c", 0), (" c ", 0), (" d ", 2)]


def test_binding_is_by_place():
    letters = langid.Letters(256, 3)
    a, b = (np.array([sum(ord(c) << 21 * (2 - i) for i, c in enumerate(s))], np.uint64) for s in ("abc", "cba"))
    x, y = letters.bind(a)[0].astype(int), letters.bind(b)[0].astype(int)
    assert abs(x @ y) < 80 and x @ x == 256


# ---- 9 -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "canonical"),
    [
        ("HTTP://WWW.Shop.Example:80/A/b/?utm_source=x&b=2&a=1#top", "shop.example/A/b?a=1&b=2"),
        ("https://shop.example/A/b?a=1&b=2", "shop.example/A/b?a=1&b=2"),
        ("https://user:pw@shop.example:443", "shop.example"),
        ("https://shop.example/?ref=1", "shop.example"),
        (None, None),
    ],
)
def test_canonical(spark, url, canonical):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u")).alias("c")).first().c == canonical


def test_revisits(spark):
    rng, urls, rows = random.Random(9), ["http://a.example/x", "https://www.a.example/x/", "http://b.example/", None], []
    for i in range(300):
        full = rng.random() < 0.5
        names = [("etag", rng.choice(['"1"', 'W/"1"', '"2"'])), ("last-modified", rng.choice("ab")), ("content-type", f"t{i}"), ("x", str(i))]
        rows.append((i, rng.choice(urls), rng.randrange(0, 400) * 300, 200 if full else rng.choice([304, 304, 404]), f"d{i}" if full else None, [h for h in names if rng.random() < 0.7] if rng.random() < 0.95 else None))
    df = spark.createDataFrame(rows, "record_id long, url string, at long, status int, digest string, headers array<struct<name:string,value:string>>").withColumn("ts", F.timestamp_seconds("at"))
    canon = {u: c for u, c in zip(urls, ["a.example/x", "a.example/x", "b.example", None], strict=True)}
    for bucket in (1, 3600, 10**9):
        got = {r.record_id: r for r in warc.resolve_revisits(df, bucket).collect()}
        assert set(got) == {r[0] for r in rows if r[3] == 304}
        for i, url, at, _, _, headers in (r for r in rows if r[3] == 304):
            before = [r for r in rows if r[3] == 200 and url and canon.get(r[1]) == canon[url] and r[2] < at]
            best = max(before, key=lambda r: (r[2], r[0]), default=None)
            assert got[i].refers_to == (best[0] if best else None)
            if not best:
                assert got[i].validator == "unresolved" and got[i].headers is None
                continue
            old, new = dict(best[5] or []), dict(headers or [])
            key = next((k for k in ("etag", "last-modified") if k in old and k in new), None)
            agree = key and old[key].removeprefix("W/") == new[key].removeprefix("W/")
            assert got[i].validator == (key if agree else "mismatch" if key else "absent")
            if key and not agree:
                assert got[i].digest is None
            else:
                assert got[i].digest == best[4] and {h.name: h.value for h in got[i].headers} == old | {k: v for k, v in new.items() if k != "content-type"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    """Captures and a revisit written as WARC records, plain and compressed, one file broken off."""
    import gzip

    def record(kind, uri, date, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{kind}:{uri}:{date}>", "WARC-Target-URI": uri, "WARC-Date": date, "Content-Length": str(len(block)), **more}
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\nContent-Type: text/html\r\n\r\n<p>WARC/1.0 inside\r\n\r\n</p>"
    parts = [
        record("warcinfo", "", "2024-01-01T00:00:00Z", b"software: x\r\n"),
        record("response", "http://a.example/x", "2024-01-01T00:00:00Z", page),
        record("request", "http://a.example/x", "2024-01-01T00:00:01Z", b"GET /x HTTP/1.1\r\n\r\n"),
        record("response", "http://a.example/x?utm_source=y", "2024-01-02T00:00:00Z", page.replace(b'"a"', b'"b"'), **{"WARC-Payload-Digest": "sha1:own"}),
    ]
    revisit = record("revisit", "https://www.a.example/x/", "2024-01-03T00:00:00Z", b'HTTP/1.1 304 Not Modified\r\nETag: W/"b"\r\nX: new\r\n\r\n', **{"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/server-not-modified"})
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(revisit) + gzip.compress(parts[1])[:-30])
    (tmp_path / "c.warc").write_bytes(b"")
    records = warc.read_warc(spark, str(tmp_path))
    assert sorted((r.status, r.digest or "") for r in records.collect()) == [(200, f"sha1:{hashlib.sha1(page.partition(b'\r\n\r\n')[2]).hexdigest()}"), (200, "sha1:own"), (304, "")]
    (found,) = warc.resolve_revisits(records).collect()
    assert (found.validator, found.digest, str(found.refers_ts)) == ("etag", "sha1:own", "2024-01-02 00:00:00")
    assert {h.name: h.value for h in found.headers} == {"content-type": "text/html", "etag": 'W/"b"', "x": "new"}


def test_revisits_awkward(spark):
    """Null and equal times, repeated records, one hot URL, and columns named like the operator's own."""
    hot = [(i, "http://h.example/", 1000, 200, f"d{i}", None) for i in range(500)] + [(500 + i, "http://h.example/", 1000, 304, None, None) for i in range(500)]
    rows = [*hot, (2000, "http://h.example/", 1001, 304, None, None), (2000, "http://h.example/", 1001, 304, None, None), (2001, "http://h.example/", None, 304, None, None), (2002, "http://h.example/", None, 200, "n", None), (None, "http://h.example/", 1001, 304, None, None), (2003, None, 5000, 304, None, None)]
    df = spark.createDataFrame([(*r, "own", 1, True) for r in rows], "record_id long, url string, at long, status int, digest string, headers array<struct<name:string,value:string>>, source string, bucket int, full boolean")
    got = warc.resolve_revisits(df.withColumn("ts", F.timestamp_seconds("at"))).collect()
    assert len(got) == 505 and {r.refers_to for r in got if r.record_id and r.record_id < 1000} == {None}
    assert [r.refers_to for r in got if r.record_id == 2000] == [499, 499] and [r.digest for r in got if r.record_id is None] == ["d499"]
    assert all(r.validator == "unresolved" for r in got if r.record_id in (2001, 2003))


# ---- 10 ------------------------------------------------------------------------------------------------------


def test_best_fit():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 800)
    where, n = packing.best_fit(lengths, 64)
    room: list[int] = []  # the same rule, by looking at every row
    for x in sorted(lengths.tolist(), reverse=True):
        fits = [r for r in room if r >= x]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - x)
        else:
            room.append(64 - x)
    assert np.bincount(where, lengths, n).max() <= 64 and sorted(64 - np.bincount(where, lengths, n)) == sorted(room)


def test_packing(spark, docs):
    """Lossless, the same however the table is partitioned, and nearly full."""
    texts = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])

    def ids_of(kind):
        as_ids = F.udf(lambda t: None if t is None else np.frombuffer(t.encode(), np.uint8).astype(kind).tobytes(), "binary")
        return texts.select("doc_id", as_ids("text").alias("ids"), "key")

    for row, window, vocabulary in ((2048, 4 << 20, 256), (16, 400, 256), (64, 4000, 1 << 17)):
        kind = packing.id_type(vocabulary)
        df = ids_of(kind)
        packed = packing.pack(df, vocabulary, row=row, window_ids=window)
        rows = [r.asDict() for r in packed.collect()]
        want = {r.doc_id: np.frombuffer(r.ids or b"", kind).tolist() for r in df.collect()}
        assert {d: x.tolist() for d, x in packing.unpack(rows, vocabulary).items()} == want
        for r in rows:
            line = np.frombuffer(r["ids"], kind)
            assert len(line) == row and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_ids"] and r["resets"] == r["cu_seqlens"][:-1] and (line[r["n_ids"] :] == vocabulary + 1).all()
            assert all((line[e - 1] == vocabulary) == last for e, last in zip(r["cu_seqlens"][1:], r["last"], strict=True))
        counted = sum(len(x) + 1 for x in want.values())
        again = packing.pack(df.repartition(7), vocabulary, row=row, window_ids=window, most_ids=counted).collect()
        assert sorted(r.ids for r in again) == sorted(r["ids"] for r in rows)
        least = sum(len(x) + 1 for x in want.values()) / row
        windows = -(-sum(len(x) + 1 for x in want.values()) // window)
        assert len(rows) <= 11 / 9 * least + 2 * windows and packing.fill(packed, row) == pytest.approx(least / len(rows))
    df = ids_of(packing.id_type(256))
    assert packing.pack(df.limit(0), 256).count() == 0 and packing.fill(packing.pack(df.limit(0), 256)) == 1.0
    assert packing.pack(df.unionByName(df).withColumn("doc_id", F.lit(None).cast("long")), 256).count() > 0
    with pytest.raises(Exception, match="vocabulary of 10"):
        packing.pack(df, 10).collect()


def test_packed_token_ids(spark, tokenizer):
    """The registered query packs the tokenizer's ids of every whole text, and nearly fills its rows."""
    import tiktoken

    path, pattern = tokenizer
    ranks = bpe.read_ranks(path)
    exact = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    packed = queries.op10_token_packing(spark, SF)
    got = packing.unpack([r.asDict() for r in packed.collect()], len(ranks))
    assert {r.doc_id: got[r.doc_id].tolist() for r in docs.collect()} == {r.doc_id: exact.encode_ordinary(r.text or "") for r in docs.collect()}
    assert packing.fill(packed) > 0.97
