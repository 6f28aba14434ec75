"""The registered queries' own columns on the smallest tables, each against a plain version of the contract."""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from factloom.llm import registry
from tests.conftest import SMALL
from tests.llm.test_operators import TOKENIZER, brute_components, brute_contamination, brute_simhash, brute_spans


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, SMALL).collect()]


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def test_op1(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op1_fingerprints")}
    order = sorted(docs, key=lambda d: -d[0])
    prints = defaultdict(set)
    for k, (doc, text, _) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[text].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_op2(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op2_simhash")}
    fp = {d: brute_simhash(t) for d, t, _ in docs}
    root = brute_components(fp.values())
    least = {}
    for d, f in sorted(fp.items()):
        least.setdefault(root[f], d)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{f:016x}", least[root[f]]) for d, f in fp.items()}


def test_op3(spark, docs):
    from factloom.llm.packing import byte_alphabet

    with open(TOKENIZER, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, special = byte_alphabet(), {t["content"] for t in spec.get("added_tokens") or []}
    vocabulary = {bytes(alphabet[c] for c in t) for t in spec["model"]["vocab"] if t not in special}
    longest = max(map(len, vocabulary))

    def greedy(word):
        n = i = 0
        while i < len(word):
            j = next(j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in vocabulary)
            n, i = n + 1, j
        return n

    known = {}
    for r in rows(spark, "op3_token_counts"):
        text = next(t for d, t, _ in docs if d == r["doc_id"]) or ""
        words = text.split()
        for w in set(words) - known.keys():
            known[w] = greedy(b" " + w.encode())
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))


def test_op4(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = rows(spark, "op4_pack")
    want, total = set(), 0
    for doc, text, _ in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first, start, k = len(ids) % 2048 or 2048, 0, 0
        while start < len(ids):
            part = ids[start : start + (first if k == 0 else 2048)]
            want.add((doc, k, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
            start, k = start + len(part), k + 1
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got} == want and len(got) == len(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(total / 2048) + 1


def test_op5(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op5_pii")}
    for doc, text, _ in docs:
        spans = brute_spans(text)
        kinds = Counter(s.split(":")[0] for s in spans.split(",") if s)
        r = got[doc]
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds[k] for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))


def test_op6(spark, docs):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SMALL}/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    got = {r["doc_id"]: r for r in rows(spark, "op6_quality")}
    assert len(got) == len(docs)
    for doc, r in got.items():
        assert r["held_out"] == held_out(doc) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    tested = [d for d in labels if held_out(d) and d in got]
    base = sum(labels[d] for d in tested) / len(tested)
    assert sum(got[d]["predicted"] == labels[d] for d in tested) / len(tested) >= max(base, 1 - base) - 1e-9


def test_op7(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op7_language")}
    known = {lang for _, _, lang in docs if lang}
    right = total = 0
    for doc, text, lang in docs:
        r = got[doc]
        assert r["held_out"] == held_out(doc) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and r["lang_pred"] in known | {"und"}
        if held_out(doc) and lang and r["lang_pred"] != "und":
            right, total = right + (r["lang_pred"] == lang), total + 1
    assert right / total >= 0.9


def test_op8(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    got = {r["doc_id"]: r for r in rows(spark, "op8_decontaminate")}
    for doc, n_words, n_hit, ids, bad in brute_contamination([(d, t) for d, t, _ in docs], items):
        r = got[doc]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n_words, n_hit, len(ids), bad)
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_op10(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op10_substrings")}
    texts = {d: (t or "").encode() for d, t, _ in docs}
    count = Counter(hash(t[i : i + 400]) for t in texts.values() for i in range(len(t) - 399))
    for doc, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if count[hash(t[i : i + 400])] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        r = got[doc]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest())
        assert r["text"] == kept.decode(errors="replace")


def test_one_very_long_text(spark):
    """A text of two million bytes through every operator of texts."""
    import random

    from factloom.llm import decontaminate, fingerprints, language, packing, pii, quality, resemblance, simhash, substrings, tokencount

    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(300_000)) + " mail a@b.cd"
    df = spark.createDataFrame([(1, text, "en"), (2, text + " x", "en"), (3, "short one", "en")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, " ".join(text.split()[5000:5040]))], "item_id long, text string")
    assert fingerprints.fingerprints(df).where("size(sketch) = 128").count() == 2
    assert simhash.near_duplicates(spark, df).where("component_id = 1").count() == 2
    assert resemblance.keep_one(spark, df).count() == 2
    assert tokencount.token_counts(df, TOKENIZER).where("n_words > 300000").count() == 2
    assert packing.pack(spark, df, TOKENIZER).where("doc_id = 1").count() > 100
    assert pii.personal_data(spark, df).where("size(base) = 1").count() == 2
    assert quality.quality(df, None).count() == 3
    assert language.keep_languages(df, None).count() == 0
    assert decontaminate.contamination(spark, df, bench).where("n_hit = 40").count() == 2
    assert substrings.remove_repeats(spark, df).where("length(kept) <= 10").count() == 3
