"""Each operator against a brute-force version, and its defined results for awkward inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import decontaminate, fingerprints, language, packing, pii, quality, simhash, substrings, tokencount
from factloom.llm import html as pages
from factloom.llm.suffix_grouping import suffix_arrays
from tests.conftest import SMALL
from tests.llm.helpers import CLASHES, DOCS, clashing, documents, frame, sentence

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


# 1 --------------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_follow_true_likeness(spark, tmp_path):
    rows = [r for r in documents() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op1_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(after)
        for near, x, y in ((r.near_edited, a, b), (r.near_next, a, c)):
            true = len(x & y) / len(x | y) if x | y else 1.0
            assert abs(near - true) <= (0.16 if len(x | y) > fingerprints.K else 1e-9)
        if len(a) <= fingerprints.K:
            assert r.n_shingles == len(a)
    assert got[0].fingerprint == fingerprints_of(spark, rows[0][1])


def fingerprints_of(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(fingerprints.text_of(fingerprints.sketch(F.col("t")))).first()[0]


def test_sketches_merge(spark):
    rng = random.Random(5)
    parts = [sentence(rng, "en", 300) for _ in range(6)]
    df = spark.createDataFrame([(i % 2, p) for i, p in enumerate(parts)], "k int, t string").withColumn("s", fingerprints.sketch(F.col("t"), 64))
    merged = {r.k: r.s for r in fingerprints.merge(df, "k", "s", 64).withColumnRenamed("sketch", "s").collect()}
    for k in (0, 1):
        union = sorted({h for r in df.where(F.col("k") == k).collect() for h in r.s})[:64]
        assert merged[k] == union


def test_fingerprints_of_awkward_rows(spark, tmp_path):
    clashing(frame(spark)).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.op1_fingerprints(spark, str(tmp_path))
    assert got.count() == len(documents())
    assert got.where("doc_id = 60 AND fingerprint = ''").count() == 1
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprints.op1_fingerprints(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame([(5, "a b", None, None, None)], DOCS).write.parquet(f"{tmp_path}/one/documents.parquet")
    assert fingerprints.op1_fingerprints(spark, f"{tmp_path}/one").first().near_next == 1.0


# 2 --------------------------------------------------------------------------------------------------------------------


def brute_simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(s, 42) for s in ([b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)])]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(root)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in root}


@pytest.mark.parametrize("hot", [50_000, 3])
def test_near_duplicates(spark, hot):
    rows = documents()
    got = simhash.near_duplicates(spark, clashing(frame(spark)), hot).collect()
    fp = [brute_simhash(t) for _, t, *_ in rows]
    root = brute_components(fp)
    least = {}
    for (doc, *_), f in zip(rows, fp, strict=True):
        if doc is not None:
            least[root[f]] = min(doc, least.get(root[f], doc))
    want = sorted(repr((doc, f, least.get(root[f]))) for (doc, *_), f in zip(rows, fp, strict=True))
    assert sorted(repr((r.doc_id, r.fp & (1 << 64) - 1, r.component_id)) for r in got) == want


def test_gray_index_finds_all_close_pairs():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.array([1 << int(rng.integers(0, 64)) for _ in range(600)], dtype=np.uint64)
    words = np.unique(np.concatenate([words, np.repeat(words, 10) ^ flips]))
    for first, size in [*simhash.BLOCKS, (0, 0)]:
        index = simhash.GrayIndex(simhash.rotated(words, first, size))
        w = index.words
        got = {tuple(sorted(p)) for a, b in index.close_pairs(2, size, chunk=64) for p in zip(a.tolist(), b.tolist(), strict=True)}
        want = {
            (i, j) for i in range(len(w)) for j in range(i + 1, len(w))
            if int(w[i] ^ w[j]).bit_count() <= 2 and (size == 0 or (int(w[i]) ^ int(w[j])) >> (64 - size) == 0)
        }
        assert got == want


def test_gray_rank_orders_the_reflected_code():
    codes = np.arange(256, dtype=np.uint64) ^ np.arange(256, dtype=np.uint64) >> np.uint64(1)
    assert simhash.gray_rank(codes).tolist() == list(range(256))


def test_components_of_chains_and_hubs(spark):
    from factloom.llm.common import Scratch

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (7, 6)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}


def test_keep_one(spark):
    rows = documents()
    kept = simhash.keep_one(spark, clashing(frame(spark)))
    assert kept.columns == clashing(frame(spark)).columns
    found = kept.collect()
    root = brute_components([brute_simhash(t) for _, t, *_ in rows])
    assert len(found) == len(set(root.values()))
    assert {r.doc_id for r in found if r.doc_id is not None} == {r.component_id for r in simhash.near_duplicates(spark, frame(spark)).collect() if r.component_id is not None}
    assert simhash.keep_one(spark, frame(spark, [])).count() == 0


# 3 --------------------------------------------------------------------------------------------------------------------


def test_longest_match_is_greedy():
    rng = random.Random(2)
    for _ in range(60):
        vocabulary = {bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        automaton = tokencount.LongestMatch(vocabulary)
        for _ in range(40):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 12)))
            n = i = 0
            while i < len(word):
                j = next((j for j in range(len(word), i, -1) if word[i:j] in vocabulary), None)
                if j is None:
                    n = None
                    break
                n, i = n + 1, j
            assert automaton.count(word) == n, (vocabulary, word)


def test_token_counts(spark):
    automaton = tokencount.load(TOKENIZER)
    got = tokencount.token_counts(clashing(frame(spark)), TOKENIZER).collect()
    want = sorted(
        repr((d, len((t or "").split()), sum(automaton.count(b" " + w.encode()) for w in (t or "").split()))) for d, t, *_ in documents()
    )
    assert sorted(repr((r.doc_id, r.n_words, r.n_tokens)) for r in got) == want
    assert tokencount.token_counts(frame(spark, []), TOKENIZER).count() == 0


# 4 --------------------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(TOKENIZER), packing.load_encoder(TOKENIZER)
    rng = random.Random(9)
    texts = [t for _, t, *_ in documents() if t] + [
        "".join(rng.choices(" \t\n\r\x0b\x85\xa0'sdmtlvre09.,-äÉßxX  ", k=rng.randint(0, 60))) for _ in range(800)
    ] + ["'s'S'll we've", "日本語 テキスト", "a b ​", "é ﬁ ǅ", "<|endoftext|>", "x<|endoftext|> y"]
    for t in texts:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack(spark, capacity):
    encode = packing.load_encoder(TOKENIZER)
    rows = documents()
    got = packing.pack(spark, clashing(frame(spark)), TOKENIZER, capacity).collect()
    want = []
    for doc, text, *_ in rows:
        ids = np.append(encode(text or ""), 0).astype("<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        want += [repr((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // capacity) + 1
    assert packing.pack(spark, frame(spark, []), TOKENIZER).count() == 0


def test_fullest_is_optimal():
    rng = random.Random(4)
    for _ in range(150):
        have = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        rest = rng.randint(1, 60)
        sums = {0}
        for size, n in have.items():
            sums = {s + size * k for s in sums for k in range(n + 1)}
        chosen = packing.fullest(rest, have, sorted(have, reverse=True))
        assert all(k <= have[s] for s, k in chosen.items())
        assert sum(s * k for s, k in chosen.items()) == max(s for s in sums if s <= rest)


def test_ids_round_trip(spark):
    got = packing.pack(spark, frame(spark), TOKENIZER, 64, with_ids=True).where("doc_id = 63").orderBy("piece").collect()
    ids = [i for r in got for i in r.ids]
    from tokenizers import Tokenizer

    assert Tokenizer.from_file(TOKENIZER).decode(ids[:-1]) == next(t for d, t, *_ in documents() if d == 63)


# 5 --------------------------------------------------------------------------------------------------------------------

PERSONAL = [
    (0, "mail a.b+c@x-y.co.uk, or call +1 (555) 123-4567; from 10.0.0.1 and 300.1.1.1 pay 4111 1111 1111 1111 not 4111111111111112"),
    (1, None), (2, ""), (3, "1.2.3.4.5.6.7.8 +123 a@b @c.d x@y.z.w"), (None, "é a@b.cd"), (0, "same 1.2.3.4"), (0, "same 1.2.3.4"),
]
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 8 <= len(d) <= 15),
]


def brute_spans(text):
    out = []
    for kind, rule, test in RULES:
        for m in re.finditer(rule, text or ""):
            if test(m[0], [int(c) for c in m[0] if c in "0123456789"]):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark, tmp_path):
    rows = [(d, t, None, None, None) for d, t in PERSONAL] + documents()
    clashing(frame(spark, rows)).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op5_pii(spark, str(tmp_path)).collect()
    want = sorted(repr((d, hashlib.sha256(brute_spans(t).encode()).hexdigest(), brute_spans(t).count("email:"))) for d, t, *_ in rows)
    assert sorted(repr((r.doc_id, r.base_sha256, r.n_email)) for r in got) == want


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"Please reach me under number: +1 555 000 {1000 + i} thanks") for i in range(8)]
    rows += [(100, "please reach me under number: 555 123 9999 thanks"), (101, "some other words before 555 123 9999 here")]
    found = {r.doc_id: r for r in pii.personal_data(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.stop) for s in found[100].added] == [(3, 30, 42)]
    assert not found[3].added and len(found[3].base) == 1


def test_redact(spark):
    rows = [(d, t, None, None, 1) for d, t in PERSONAL]
    df = clashing(frame(spark, rows))
    out = pii.redact(spark, df)
    assert out.columns == df.columns and out.count() == len(rows)
    one = out.where("doc_id = 0 AND text LIKE 'mail%'").first()
    assert one.text == "mail [EMAIL], or call [PHONE]; from [IP] and 300.1.1.1 pay [CARD] not 4111111111111112"
    assert one.n_chars == len(one.text)
    assert pii.redact(spark, frame(spark, [])).count() == 0


# 6 --------------------------------------------------------------------------------------------------------------------


def test_pairwise_terms_in_linear_time():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(np.zeros((len(quality.STATISTICS), quality.BINS - 1)), 0.3, np.zeros(0), np.zeros(0))
    m.linear, m.factors = rng.standard_normal(m.n_features), rng.standard_normal((m.n_features, 4))
    index, value = np.array([5, 9, 70, 2]), rng.standard_normal(4).astype(np.float32)
    margin, _ = m.margins(index, value, np.array([0]))
    pairs = sum(m.factors[index[i]] @ m.factors[index[j]] * value[i] * value[j] for i in range(4) for j in range(i + 1, 4))
    assert margin[0] == pytest.approx(0.3 + m.linear[index] @ value + pairs, rel=1e-5)


def labelled(n=400):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = " ".join([rng.choice(["spam", "click"])] * rng.randint(5, 20)) if bad else sentence(rng, "en", rng.randint(5, 60)) + "."
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled()
    labels += [labels[0], (999, 1, 0), (5, None, 0), (None, 1, 0)]
    model = quality.train(clashing(frame(spark, docs)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in quality.quality(frame(spark, docs), model).collect()}
    held = [i for i in range(len(docs)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in held]) >= 0.95
    odd = quality.quality(clashing(frame(spark)), model).collect()
    assert len(odd) == len(documents()) and all(0 <= r.score <= 1 for r in odd)
    none = quality.train(frame(spark, docs), spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None and quality.quality(frame(spark, docs), none).first().score == 0.5
    assert quality.quality(frame(spark, []), model).count() == 0


# 7 --------------------------------------------------------------------------------------------------------------------


def languages(n=300):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        text = sentence(rng, lang, rng.randint(5, 80))
        rows.append((i, text, lang, "s", len(text)))
    return rows


def test_language_on_held_out_rows(spark):
    rows = languages()
    net = language.train(clashing(frame(spark, rows)))
    found = language.identify(clashing(frame(spark, rows)), net).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.95
    odd = language.identify(frame(spark), net).collect()
    assert len(odd) == len(documents())
    assert all(r.lang_pred == "und" and r.lang_score == 0 for r in odd if r.text is None or not any(c.isalpha() for c in r.text))
    assert all(0 <= r.lang_score <= 1 for r in odd)
    assert language.train(frame(spark, [])) is None
    assert language.identify(frame(spark), None).where("lang_pred <> 'und'").count() == 0
    kept = language.keep_languages(clashing(frame(spark)), net)
    assert kept.columns == clashing(frame(spark)).columns and kept.where("text IS NULL OR text = ''").count() == 0


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(2)
    net = language.ByteConvNet.fit(rng.integers(0, 256, (40, language.WINDOW), dtype=np.uint8), rng.integers(0, 2, 40), ["a", "b"], epochs=1)
    x = rng.integers(0, 256, (3, language.WINDOW), dtype=np.uint8)
    wide = max(language.WIDTHS)
    slow = [[net.embedding[w[i : i + wide]].ravel() @ net.kernel + net.bias for i in range(language.WINDOW - wide + 1)] for w in x]
    logits = np.maximum(np.array(slow).max(axis=1), 0) @ net.out + net.out_bias
    prob = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(net.predict(x, net.tables()), prob, atol=1e-4)
    assert not net.kernel[language.ByteConvNet.mask() == 0].any()


# 8 --------------------------------------------------------------------------------------------------------------------


def brute_contamination(rows, items):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = {}
    for item, text in items:
        w = cut.findall(low(text))
        if item is not None and w:
            for i in range(max(1, len(w) - 12)):
                windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w = cut.findall(low(text))
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def contaminated_tables():
    rng = random.Random(12)
    items = [(i, sentence(rng, "en", rng.choice([1, 2, 5, 13, 14, 30]))) for i in range(14)] + [(3, "Window! under-light"), (None, "the the"), (50, None), (51, "--"), (10, "the")]
    rows = [(d, t) for d, t, *_ in documents()]
    for i in range(30):
        parts = [sentence(rng, "en", rng.randint(0, 30)) for _ in range(3)]
        rows.append((200 + i, f"{parts[0]} {rng.choice(items)[1] or ''} {parts[1].upper()}, {rng.choice(items)[1] or ''} {parts[2]}"))
    return rows, items


def test_contamination(spark, monkeypatch):
    rows, items = contaminated_tables()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    want = sorted(map(repr, brute_contamination(rows, items)))
    for limit in (decontaminate.BLOCK_BYTES, 300):  # in one block, and in several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        got = decontaminate.contamination(spark, docs, bench).collect()
        assert sorted(repr((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated)) for r in got) == want
    kept = decontaminate.drop_contaminated(spark, docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum("False)" in w for w in want)


def test_contamination_of_empty_tables(spark):
    rows, items = contaminated_tables()
    docs, none = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(spark, docs, none).where("n_hit > 0 OR contaminated").count() == 0
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(spark, docs.where("false"), bench).count() == 0


def test_main_path_is_native(spark):
    rows, items = contaminated_tables()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for df in (decontaminate.contamination(spark, docs, bench), fingerprints.fingerprints(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().optimizedPlan().toString())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "the old river runs by a stone"), (2, "river x x x x x x x x stone"), (3, "stone river"), (None, "river stone")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "Stone, river"), (8, "absent"), (None, "river")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.proximity_matches(spark, docs, queries, 5).collect()}
    assert got == {(1, 7), (3, 7), (None, 7)}


# 9 --------------------------------------------------------------------------------------------------------------------

FRAME = (
    '<html><head><title>t</title><style>p{}</style></head><body><header><p>Site name</p></header><nav><a href="/">Home</a></nav>'
    '<div class="cookie-notice">We use cookies</div><script>var t="</p>";</script>%s<aside><p>Read also</p></aside>'
    '<form><label>Mail</label><input></form><section class="comments"><p>Nice one, thanks for this long and thoughtful comment of mine</p></section>'
    '<div class="ad">Buy now</div><footer>&copy; us</footer></body></html>'
)


def test_main_text():
    tree = pages.train()
    body = "<article><h1>A &amp; B</h1><p>One  two\n three&nbsp;four.<br>five <b>six</b><!-- no --> seven</p><p>Short.</p><ul><li>item</li></ul></article>"
    assert pages.main_text(FRAME % body, tree) == "A & B\nOne two three four. five six seven\nShort.\nitem"
    assert pages.main_text(FRAME % "<main><p>Only a line here</p></main>", tree) == "Only a line here"
    assert pages.main_text(None, tree) == pages.main_text("", tree) == pages.main_text("<p", tree) == ""
    assert pages.main_text("<article><p>open <b>end", tree) == "open end"


def test_main_text_of_all_pages(spark):
    from html import unescape

    tree = pages.train()
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in pages.op9_html(spark, SMALL).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1|h2)>", article)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert [r.text for r in pages.extract(odd, tree).collect()] == ["", "", ""]
    assert pages.extract(odd.where("false")).count() == 0


def test_tree_fits_its_table():
    from factloom.llm.html_examples import examples

    tree = pages.train()
    for page in examples():
        found = pages.blocks(page)
        assert [s >= 0.5 for s in tree.predict(pages.table(found))] == [b.text.startswith("+") for b in found]


# 10 -------------------------------------------------------------------------------------------------------------------


def test_suffix_arrays():
    rng = random.Random(7)
    for _ in range(80):
        texts = [[rng.randint(0, rng.randint(1, 4)) for _ in range(rng.randint(0, 50))] for _ in range(rng.randint(1, 6))] + [[1] * 20, [1, 2] * 9]
        bounds = np.cumsum([0, *map(len, texts)])
        got = suffix_arrays(np.array(sum(texts, []), dtype=np.int16), bounds)
        for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
            assert (got[a:b] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def brute_removed(texts, length):
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return out


@pytest.mark.parametrize(("length", "gram", "crowd", "parts"), [(40, 26, 32, 12), (40, 26, 4, 3), (40, 39, 32, 12), (30, 8, 5, 4)])
def test_remove_repeats(spark, length, gram, crowd, parts):
    rng = random.Random(length + gram)
    base = ["".join(rng.choices("abé ", k=rng.randint(1, 200))) for _ in range(10)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 9) :] if rng.random() < 0.5 else "".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(rng.randint(0, 5))) for _ in range(90)]
    texts += ["a" * 300, "ab" * 100, "", None, base[0] * 3, base[0], base[0]]
    texts += ["".join(rng.choices("xyz", k=30)) + base[1] + base[2] + "".join(rng.choices("xyz", k=30)) for _ in range(30)]
    rows = [(None if i % 17 == 3 else i % 80, t) for i, t in enumerate(texts)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = substrings.remove_repeats(spark, df, length, gram, crowd, parts).collect()
    want = []
    data = [(t or "").encode() for t in texts]
    for (doc, _), t, gone in zip(rows, data, brute_removed(data, length), strict=True):
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        want.append(repr((doc, len(t), bytes(b for b, x in zip(t, gone, strict=True) if not x), runs)))
    assert sorted(repr((r.doc_id, r.n_bytes, bytes(r.kept), len(r.removed))) for r in got) == sorted(want)
    assert substrings.remove_repeats(spark, df.where("false")).count() == 0


def test_no_operator_needs_a_clashing_name():
    assert len(set(CLASHES)) == len(CLASHES)
