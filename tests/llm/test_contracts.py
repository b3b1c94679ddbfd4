"""Every registered query on the smallest tables: its columns and types, and its values against plain computations."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from talkgauge.llm import langid, queries
from tests.llm.test_operators import SF, WORDS, brute_components, brute_links, brute_targets, spans

CONTRACT = {
    "op1_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op5_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op6_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op7_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    found = queries.queries()[name](spark, SF)
    types = {f.name: f.dataType.simpleString() for f in found.schema}
    want = [x.split() for x in CONTRACT[name].split(", ")]
    assert list(types)[: len(want)] == [n for n, _ in want] and all(types[n] == t for n, t in want)
    return found.collect()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op1(spark, documents):
    rows = run(spark, "op1_pii")
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        base = spans(documents[r.doc_id].text or "")
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], sha(base))
        assert set(base.split(",")) <= set(r.spans.split(","))
        starts = [int(x.split(":")[1]) for x in r.spans.split(",") if x]
        assert starts == sorted(starts)


def test_op3(spark, documents):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = run(spark, "op3_byte_bpe")
    assert len(rows) == len(documents)
    for r in rows:
        t = documents[r.doc_id].text or ""
        ids = exact.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t))


def test_op4(spark, documents):
    rows, by_text = run(spark, "op4_media_columns"), defaultdict(set)
    assert len(rows) == len(documents)
    for r in rows:
        raw = (documents[r.doc_id].text or "").encode()
        payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert r.media_bytes % 188 == 0 and r.media_bytes > len(payload) and "cc_errors=0" in r.feature
        by_text[raw].add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


def test_op5(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = brute_links([r.vec_id for r in vectors], [r.embedding for r in vectors])
    rows = run(spark, "op5_embedding_dedup")
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in rows) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_op6(spark, documents):
    rows = run(spark, "op6_ngram_jaccard")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == brute_components([(d, r.text) for d, r in documents.items()], 4, 85)


def test_op7(spark, documents):
    rows, again = run(spark, "op7_source_mixing"), {r.doc_id: r.taken for r in run(spark, "op7_source_mixing")}
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in documents.values():
        n = len(WORDS.findall(r.text or ""))
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    want = brute_targets(dict(sizes))
    assert len(rows) == len(documents)
    for r in rows:
        source = documents[r.doc_id].source
        assert r.size == len(WORDS.findall(documents[r.doc_id].text or "")) and r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0) and again[r.doc_id] == r.taken
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in want)


def test_op8(spark, documents):
    rows = run(spark, "op8_language_id")
    assert len(rows) == len(documents)
    learned = {r.lang for d, r in documents.items() if r.lang is not None and zlib.crc32(str(d).encode()) % 5}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", documents[r.doc_id].text or "")) and r.lang_pred in learned | {"und"}
    held = [r for r in rows if r.held_out and documents[r.doc_id].lang is not None]
    assert sum(documents[r.doc_id].lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_op8_never_reads_labels_of_what_it_predicts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.withColumn("lang", docs.lang).filter(~langid.train_split()).write.parquet(str(tmp_path / "a/documents.parquet"))
    held = docs.filter(langid.train_split()).selectExpr("doc_id", "text", "'xx' AS lang", "'none' AS source", "n_chars")
    held.unionByName(docs.filter(~langid.train_split())).write.parquet(str(tmp_path / "b/documents.parquet"))
    given = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in run(spark, "op8_language_id")}
    changed = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in queries.op8_language_id(spark, str(tmp_path / "b")).collect()}
    assert changed == given


def test_op2_and_op9_and_op10_columns(spark, documents):
    found = queries.op2_license_scan(spark, SF)
    assert found.columns == ["doc_id", "n_matches", "licenses", "matches"] and found.count() == len(documents)
    found = queries.op9_warc_revisits(spark, SF)
    assert found.columns == ["page_id", "canonical_url", "refers_to", "validator", "digest", "headers"] and found.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    found = queries.op10_token_packing(spark, SF)
    assert dict(found.dtypes) == {"ids": "binary", "n_ids": "int", "cu_seqlens": "array<int>", "resets": "array<int>", "doc_ids": "array<bigint>", "pieces": "array<int>", "last": "array<boolean>"}
    rows = found.collect()
    assert {d for r in rows for d in r.doc_ids} == set(documents) and all(len(r.ids) == 4096 and np.all(np.diff(r.cu_seqlens) > 0) for r in rows)
