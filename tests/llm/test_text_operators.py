"""Corpus operators against brute force on small, awkward tables."""

import collections
import hashlib
import os
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from oreline.llm import fertility, mixing, pii, queries, sentencepiece_bpe, simhash, suffix_dedup, topk

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(rnd, n, letters="abcdeé"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))) for _ in range(n))


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


# SentencePiece


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_bpe.Codec(sentencepiece_bpe.Vocabulary.load(sentencepiece_bpe.default_model()))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())


def test_encoding_equals_the_library(codec, library):
    rnd = random.Random(5)
    pool = ["a", "b", "the", "  ", "   ", " ", "\n", "\t", "▁", "é", "中文", "🙂", "in", "er", "10", "<s>", "</s>", "<0x0A>", "<unk>", "\x00", "ing", "....", "        ", "ﬁ", "İ"]
    for _ in range(5000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert codec.encode(text).tolist() == ids, text
        assert codec.decode(np.array(ids)) == library.decode(ids), text


@pytest.mark.parametrize("text", ["", " ", " " * 1000, "a" * 20000, "é" * 3000, "́" * 100, "abc " * 5000])
def test_encoding_of_odd_and_long_texts(codec, library, text):
    assert codec.encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_a_chunk_with_loose_ends_takes_what_is_known_of_its_word(codec, library, monkeypatch):
    searched, search = [], sentencepiece_bpe.Codec.segment
    monkeypatch.setattr(sentencepiece_bpe.Codec, "segment", lambda self, text: searched.append(text) or search(self, text))
    text = "zorvetick zorvetick, (zorvetick) zorvetick?! zorvetick,, zorvetick,zorvetick ,;,; , ." + ",;" * 30_000
    assert codec.encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert searched.count("▁zorvetick") == 1
    assert not {"▁zorvetick,", "▁zorvetick?"} & set(searched)
    rnd = random.Random(17)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "be", "the", "ing", ",", ".", ";", "?!", "))", "'s", '"', "é", "日", "1", "\n", " ", "\u2581", "\U0001f600"]) for _ in range(40))
        assert codec.encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_encode_decode_rows(spark, library):
    texts = [(1, None, "x"), (2, "", "x"), (2, "Hello  wörld\n", "y"), (2, "Hello  wörld\n", "y"), (None, "z" * 50000, None)]
    out = sentencepiece_bpe.encode_decode(spark.createDataFrame(texts, "doc_id long, text string, n_tokens string"), emit_ids=True)
    got = {(r["doc_id"], r["decoded"]): r for r in out.collect()}
    assert out.count() == 5
    for doc_id, text, _ in texts:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        r = got[doc_id, text or ""]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sentencepiece_bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# SimHash


def naive_fingerprint(text, k=3):
    ws = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or [b" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_match_spark_and_naive(spark):
    rnd = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50):
        text = words(rnd, n, "abÉxYZ")
        assert simhash.text_fingerprint(text) == naive_fingerprint(text)
    h = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert h % (1 << 64) == xxhash.xxh64_intdigest("a b c", 42)


def test_covering_reaches_every_close_word():
    rng = np.random.default_rng(1)
    fps = rng.integers(-(2**63), 2**63 - 1, 200)
    home, replicas = simhash.anchors(fps, 2)
    for fp, r in zip(fps, replicas):
        held = set(r.tolist())
        for _ in range(30):
            flips = rng.choice(64, rng.integers(0, 3), replace=False)
            e = np.bitwise_xor.reduce(np.array([0, *(1 << int(b) for b in flips)], np.uint64)).astype(np.uint64).view(np.int64)
            assert int(simhash.anchors(np.array([fp ^ e]), 0)[0][0]) in held


def naive_components(fps):
    ids = [d for d, _ in fps]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(fps)):
        groups[root(i)].append(i)
    return [(ids[i], f"{fps[i][1]:016x}", min((ids[j] for j in groups[root(i)] if ids[j] is not None), default=None)) for i in range(len(fps))]


def near_copies(rnd):
    base = words(rnd, 120).split()
    rows = [(i, words(rnd, rnd.randint(0, 60))) for i in range(60)]
    for i in range(40):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = words(rnd, 1)
        rows.append((100 + i, " ".join(w)))
    return rows + [(200, None), (201, ""), (202, " \t"), (None, rows[3][1]), (7, rows[5][1]), (7, rows[5][1])]


def test_simhash_groups(spark):
    rows = near_copies(random.Random(9))
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    got = simhash.simhash_groups(df).select("doc_id", simhash.fingerprint_hex(), "component_id")
    assert rows_of(got) == sorted(map(repr, naive_components([(d, naive_fingerprint(t)) for d, t in rows])))
    stay = simhash.one_of_each_group(df)
    assert stay.columns == df.columns
    groups = {c for _, _, c in naive_components([(d, naive_fingerprint(t)) for d, t in rows])}
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(groups)
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_replicas_are_shuffled_by_anchor_not_broadcast(spark):
    """Spark takes the replicas for little more than the fingerprints, which would fit a broadcast."""
    rnd = random.Random(29)
    fps = sorted({rnd.getrandbits(63) for _ in range(40)})
    fps += [fps[0] ^ 1, fps[1] ^ 6, fps[2] ^ 7]
    pairs = simhash.linked_pairs(spark.createDataFrame([(x,) for x in fps], "fp long"))
    assert {frozenset(r) for r in pairs.collect()} == {frozenset((fps[0], fps[0] ^ 1)), frozenset((fps[1], fps[1] ^ 6))}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan


# Top-k


def test_exact_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.integers(-3, 4, 8) / 256 * 100] for _ in range(150)]
    vectors[20:40] = [vectors[19]] * 20
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [1.0, None] * 4), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, vectors[0]), (904, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, v int")
    q = topk.quantised(df)
    got = topk.exact_top_k(q, q.where("vec_id % 7 = 0"), k=5)
    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in enumerate(vectors)}
    want = []
    for i in range(0, 150, 7):
        scored = sorted((-sum(map(int.__mul__, ints[i], ints[j])), j) for j in ints if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    assert rows_of(got) == sorted(map(repr, want))
    assert topk.exact_top_k(q.limit(0), q, 5).count() == 0


def test_top_k_of_huge_components_is_exact():
    q = np.array([[2.0**31, 1.0]])
    c = np.array([[2.0**30, 3.0], [2.0**30, 4.0]])
    assert topk.block_scores(q, c).tolist() == [[2**61 + 3, 2**61 + 4]]


def test_tiles_and_merge_levels(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 7)
    monkeypatch.setattr(topk, "SHARD_ROWS", 9)
    monkeypatch.setattr(topk, "MERGE_FAN_IN", 3)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)], "vec_id long, embedding array<double>")
    q = topk.quantised(df)
    v = {r["vec_id"]: np.array(r["v"], np.int64) for r in q.collect()}
    want = [(i, r + 1, j, s) for i in range(0, 120, 5) for r, (s, j) in enumerate(sorted(((int(v[i] @ v[j]), j) for j in v if j != i), key=lambda x: (-x[0], x[1]))[:3])]
    assert rows_of(topk.exact_top_k(q, q.where("vec_id % 5 = 0"), k=3)) == sorted(map(repr, want))


# Repeated strings


def naive_removal(texts, length):
    blobs = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
    out = []
    for b in blobs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length,seed", [(400, 1), (400, 2), (64, 3)])
def test_removed_repeats(spark, length, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 300)
    monkeypatch.setattr(suffix_dedup, "BUCKET_SUFFIXES", 40)
    shared = [words(rnd, n * length // 400) for n in (70, 100, 130, 90)]
    rows = []
    for i in range(40):
        parts = [rnd.choice([words(rnd, rnd.randint(1, 60)), rnd.choice(shared), rnd.choice(shared)[rnd.randint(0, 30) :], rnd.choice(shared)[: -rnd.randint(1, 60)]]) for _ in range(rnd.randint(0, 5))]
        rows.append((i, " ".join(parts)))
    base = words(rnd, 200).split()
    for i in range(12):
        w = list(base)
        for _ in range(rnd.randint(1, 4)):
            w[rnd.randrange(len(w))] = words(rnd, 1)
        rows.append((200 + i, " ".join(w)))
    rows += [(100, "a" * 1500), (101, "ab" * 700), (102, None), (103, ""), (None, shared[0]), (7, rows[3][1]), (7, rows[3][1]), (104, "x" * (length - 1)), (105, shared[1][:length]), (106, shared[1][: length + 1])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, kept string")
    got = suffix_dedup.removed_repeats(df, length=length)
    want = [(d, *r) for (d, _), r in zip(rows, naive_removal([t for _, t in rows], length))]
    assert rows_of(got) == sorted(map(repr, want))


def test_texts_of_one_id_with_equal_short_hashes_stay_apart(spark):
    texts = spark.range(0, 200_000, 1, 8).select(F.concat(*(F.sha2((F.col("id") * 17 + i).cast("string"), 256) for i in range(9))).alias("text"))
    pair = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("t")).where("size(t) > 1").first()["t"][:2]
    rows = [(None, pair[0]), (None, pair[1]), (1, pair[0][:450]), (2, pair[1][100:])]
    want = [(d, *r) for (d, _), r in zip(rows, naive_removal([t for _, t in rows], 400))]
    got = suffix_dedup.removed_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got) == sorted(map(repr, want))


def test_removed_repeats_of_an_empty_table(spark):
    assert suffix_dedup.removed_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_multikey_order_sorts_lexicographically():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 4, 500) for _ in range(3)]
    order = suffix_dedup.multikey_order(keys)
    got = list(zip(*(k[order].tolist() for k in keys)))
    assert got == sorted(got)


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [(s, pii.KINDS[k], e) for s, k, e in sorted(out)]


def test_base_patterns_are_the_plain_ones():
    rnd = random.Random(2)
    pool = ["1", "2", "55", "255", "0", ".", "-", " ", "+", "@", "a", "_", "(", ")", "é", "4111111111111111", "b.c"]
    for _ in range(20000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 25)))
        assert pii.base_spans(text) == naive_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "0" * 5000 + ".0.0.1"):
        pii.base_spans(text)


def test_field_adds_spans_and_keeps_base(spark):
    rows = [
        (1, "call (555) 123-4567 now, or write to john [at] mail [dot] com today", "x"),
        (2, "version 2.0.1 of 2024-05-17 at 10:30, look at the dot com", "x"),
        (3, "é a.b@c.de and 10.0.0.1", None), (4, None, ""), (5, "", ""), (5, "", ""),
    ]
    out = {r["doc_id"]: r for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    found = lambda i: [(s["kind"], rows[i - 1][1][s["start"] : s["end"]], s["base"]) for s in out[i]["spans"]]
    assert found(1) == [("phone", "(555) 123-4567", False), ("email", "john [at] mail [dot] com", False)]
    assert found(2) == []
    assert found(3) == [("email", "a.b@c.de", True), ("ip", "10.0.0.1", True)]
    assert out[4]["spans"] == [] and out[5]["spans"] == []


def test_marked_addresses_under_any_ending():
    finder = pii.Finder(pii.fitted())
    for address in ("anna [at] firma [dot] ch", "anna (at) firma (dot) at", "bob [at] host.it", "bob(at)example.nl", "joe [at] corp [dot] dev", "lea [at] uni-bern [dot] online"):
        text = f"write to {address} please"
        assert [(k, text[s:e]) for s, k, e, _ in finder.spans([text])[0]] == [("email", address)]
    for text in ("he is [at] home . He was", "meet anna at noon dot ch", "look at home dot now"):
        assert finder.spans([text])[0] == []


def test_redaction(spark):
    rows = [(1, "x a@b.cd +1 (555) 123-4567 y", "en", 5), (2, None, None, None), (3, "plain", "en", 5)]
    out = {r["doc_id"]: r for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")).collect()}
    assert out[1]["text"] == "x <EMAIL> <PHONE> y" and out[1]["n_chars"] == len("x <EMAIL> <PHONE> y")
    assert out[2]["text"] is None and out[3]["text"] == "plain"


# Quality rules


def naive_base(text):
    text = text or ""
    ws = WORD.findall(text)
    grams = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    hit = set()
    for i in range(len(ws) - 4):
        if grams[tuple(ws[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_base_measures():
    rnd = random.Random(8)
    for _ in range(400):
        text = "".join(rnd.choice(["a", "b", "é", " ", "\n", "\t", "*", " ", "a b c d e f\n", "\x0b"]) for _ in range(rnd.randint(0, 60)))
        assert fertility.base_measures(text) == naive_base(text), text
    assert fertility.base_measures("x y z q w " * 3) == (15, 15, 0, 0, 15)


def test_bands_reject_symbol_noise_and_keep_the_rest(spark):
    rnd = random.Random(4)
    plain = ["the", "river", "was", "seen", "from", "every", "window", "of", "that", "house", "and", "again", "people", "walked", "under", "trees", "garden", "slowly"]
    rows = [(i, " ".join(rnd.choice(plain) for _ in range(150)), "en", "x") for i in range(120)]
    rows += [(900, " ".join(rnd.choice(plain) + rnd.choice(["***", "%%%", "&&&"]) for _ in range(150)), "en", "x"), (901, None, "en", ""), (902, "", None, None), (903, "few words only", "fr", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")
    out = {r["doc_id"]: r for r in fertility.judged(df).collect()}
    assert not out[900]["kept"] and out[900]["reason"] == "chars_per_token"
    assert all(out[i]["kept"] for i in range(120))
    assert all(out[i]["base_failed"] and not out[i]["kept"] for i in (901, 902, 903))
    kept = fertility.accepted(df)
    assert kept.columns == df.columns and kept.count() == 120
    assert fertility.judged(df.limit(0)).count() == 0


def test_rare_languages_and_small_tables_have_bands(spark):
    rnd = random.Random(5)
    plain = ["the", "river", "was", "seen", "from", "every", "window", "of", "that", "house", "and", "again", "people", "walked", "under", "trees", "garden", "slowly"]
    clean = lambda: " ".join(rnd.choice(plain) for _ in range(150))
    noise = lambda: " ".join(rnd.choice(plain) + rnd.choice(["***", "%%%", "&&&"]) for _ in range(150))
    for size in (120, 20):  # the language has enough documents, or the whole table has not
        rows = [(i, clean(), "en") for i in range(size)] + [(900, noise(), "en"), (901, noise(), "zz"), (902, noise(), None), (903, clean(), "zz"), (904, clean(), None)]
        out = {r["doc_id"]: r["reason"] for r in fertility.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
        assert [out[i] for i in range(900, 905)] == ["chars_per_token"] * 3 + [None] * 2
        assert all(out[i] is None for i in range(size))
    rows = [(i, clean(), f"lang{i}") for i in range(2100)] + [(9000, noise(), "lang9000")]
    out = fertility.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [r["doc_id"] for r in out.where("not kept").collect()] == [9000]


def test_words_with_digits_are_judged(spark):
    rnd = random.Random(7)
    plain = ["the", "river", "was", "seen", "from", "every", "window", "of", "that", "house", "and", "again", "people", "walked", "under", "trees", "garden", "slowly"]
    clean = lambda n: [rnd.choice(plain) for _ in range(n)]
    key = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(16)) + "7"
    leet = lambda: "".join(rnd.choice("bcdfgh0134$") for _ in range(6)) + "3"
    rows = [(i, " ".join(clean(150) + (["in", "1987", "12,5"] if i % 2 else [])), "en") for i in range(120)]
    rows += [
        (900, " ".join(key() for _ in range(60)), "en"),
        (901, " ".join(str(rnd.randint(100, 10**6)) for _ in range(200)), "en"),
        (902, " ".join(w for x in clean(100) for w in (x, leet())), "en"),
        (903, " ".join(clean(30) + [key() for _ in range(20)]), None),
    ]
    out = {r["doc_id"]: r["reason"] for r in fertility.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i] for i in range(900, 904))
    assert all(out[i] is None for i in range(120))


def test_scripts():
    assert [fertility.script_of(t) for t in ("abc", "привет", "日本語です", "123", "")] == ["Latin", "Cyrillic", "Japanese", "None", "None"]


# Mixing


def naive_mix(rows, weights=(5, 2, 1), cap=3, block=64, shard=4096, seed=8):
    """Targets by resharing, seats one by one, words one by one; ``rows`` are id, text, source."""
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, free, left = {}, list(names), Fraction(sum(size.values()))
    while True:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > cap * size[s]]
        if not over:
            break
        for s in over:
            goal[s] = Fraction(cap * size[s])
        left -= sum(goal[s] for s in over)
        free = [s for s in free if s not in over]
    goal |= {s: share * weight[s] for s in free}
    held = dict.fromkeys(free, 0)
    line = lambda: max(free, key=lambda s: (Fraction(weight[s], 2 * held[s] + 1), -names.index(s)))
    for _ in range(int(left) // block):
        held[line()] += 1
    quota = {s: held[s] * block for s in free}
    quota[line()] += int(left) % block
    quota = {s: min(quota.get(s, cap * size[s]), cap * size[s]) for s in names}
    out = {}
    for s in names:
        mine = sorted(((hashlib.md5(f"{seed}:{'' if i is None else i}:{t or ''}".encode()).hexdigest(), i, t) for i, t, x in rows if x == s), key=lambda r: r[0])
        passes, rest = divmod(quota[s], max(1, size[s]))
        lengths = [min(shard * block, size[s] - at) for at in range(0, size[s], shard * block)]
        seats = [0] * len(lengths)
        for turn in range(rest // block + 1):
            open_ = [k for k in range(len(lengths)) if seats[k] < lengths[k] // block] or [len(lengths) - 1]
            best = max(open_, key=lambda k: (Fraction(lengths[k], 2 * seats[k] + 1), -k)) if lengths else None
            if turn < rest // block:
                seats[best] += 1
        taken_word = []
        for k, n in enumerate(lengths):
            full = n // block
            for at in range(-(-n // block)):
                rank = (at + k * 7919 + seed) % full if at < full else full
                words_here = min(block, n - at * block)
                some = block if rank < seats[k] else rest % block if rank == seats[k] and k == best else 0
                taken_word += [w < some for w in range(words_here)]
        at = 0
        for _, i, t in mine:
            n = len(WORD.findall(t or ""))
            out.setdefault(s, []).append((i, t, n, size[s], float(goal[s]), passes * n + sum(taken_word[at : at + n]), passes, taken_word[at : at + n]))
            at += n
    return out


def mix_tables(rnd, long=4000):
    mixed_up = [(i, words(rnd, rnd.randint(0, 80)), rnd.choice(["a", "b", "c", None, "Z", "é"])) for i in range(500)]
    mixed_up += [(1, None, "a"), (1, "w " * 3000, "b"), (None, "q r", "c"), (None, "q s", "c"), (5, "s t", "c"), (5, "s t", "c")]
    one_word = [(i, "w", "short") for i in range(2000)] + [(5000 + i, "x " * long, "long") for i in range(50)] + [(9000, "y " * 20, "tiny"), (9001, "", "none")]
    hot = [(i, words(rnd, rnd.randint(1, 40)), "hot" if i % 3 else f"s{i % 60}") for i in range(600)]
    return [mixed_up, one_word, hot]


@pytest.mark.parametrize("block,shard", [(64, 4096), (3, 7), (16, 5)])
@pytest.mark.parametrize("table", [0, 1, 2])
def test_mix_is_the_naive_one(spark, table, block, shard):
    rows = mix_tables(random.Random(table), 4000 if block == 64 else 30)[table]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, taken string")
    mix = mixing.mixed(df.repartition(3), block=block, shard=shard)
    got = mix.select("row.doc_id", "row.text", "row.source", "size", "source_size", "target", "taken").collect()
    want = naive_mix(rows, block=block, shard=shard)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, t, s, *rest)) for s, found in want.items() for i, t, *rest, _, _ in found)
    per = mix.groupBy("row.source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 * block for r in per)
    texts = mixing.taken_texts(mix, n_chars=None)
    assert texts.columns == df.columns
    assert texts.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(r["taken"] for r in per)


def test_every_source_comes_within_a_block_of_its_target(spark):
    rows = mix_tables(random.Random(1))[1]
    mix = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    per = {r["source"]: r for r in mix.groupBy("row.source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert per["tiny"]["taken"] == 60 == per["tiny"]["target"] and per["short"]["taken"] == 6000
    assert abs(per["long"]["taken"] - per["long"]["target"]) <= 64 and per["none"]["taken"] == 0
    assert mix.where("taken > 3 * size").count() == 0


def test_mix_of_an_empty_table_and_of_texts_without_words(spark):
    schema = "doc_id long, text string, source string, size string, n_chars long"
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    blank = mixing.mixed(spark.createDataFrame([(1, "", "a", "x", 0), (2, None, None, "y", None)], schema))
    assert [tuple(r) for r in blank.select("size", "target", "taken").collect()] == [(0, 0.0, 0)] * 2
    kept = mixing.taken_texts(mixing.mixed(spark.createDataFrame([(1, "a  b", "a", "mine", 9)], schema)))
    assert [tuple(r) for r in kept.collect()] == [(1, "a  b", "a", "mine", 4)]


def test_mix_query_equals_its_sql(spark, sf_dir):
    got = queries.op8_mixing(spark, sf_dir)
    want = duckdb.sql(queries.OP8_SQL.replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'"))
    assert sorted(tuple(r) for r in got.select(*sorted(got.columns)).collect()) == sorted(want.project(", ".join(sorted(want.columns))).fetchall())


@pytest.mark.parametrize("length", [400])
def test_removed_repeats_of_the_whole_largest_table(spark, length):
    """Every window of 10,000 documents, told apart by Python's keyed 64-bit hash of its bytes."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not here")
    rows = spark.read.parquet(path).select("doc_id", "text").collect()
    blobs = [(r["text"] or "").encode() for r in rows]
    sizes = np.array([max(0, len(b) - length + 1) for b in blobs])
    hashes = np.fromiter((hash(b[i : i + length]) for b, n in zip(blobs, sizes.tolist()) for i in range(n)), np.int64, int(sizes.sum()))
    order = np.argsort(hashes)
    same = np.concatenate([[False], hashes[order][1:] == hashes[order][:-1], [False]])
    repeated = np.empty(len(hashes), bool)
    repeated[order] = same[1:] | same[:-1]
    want = {}
    for r, b, hits in zip(rows, blobs, np.split(repeated, np.cumsum(sizes)[:-1])):
        step = np.zeros(len(b) + 1, np.int64)
        np.add.at(step, np.flatnonzero(hits), 1)
        np.add.at(step, np.flatnonzero(hits) + length, -1)
        gone = np.cumsum(step)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[r["doc_id"]] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removed_repeats(spark.read.parquet(path)).collect()}
    assert got == want
    assert got[6199][1] == 488  # a block of windows over two runs once lost three bytes here


def test_scores_beyond_64_bits_are_the_largest_and_rank_as_such(spark):
    big = float(1 << 40)
    rows = [(0, [big, 0.0]), (1, [big, 1.0]), (2, [-big, 1.0]), (3, [1e308, 1.0]), (4, [1.0, 1.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r["vec_id"]: r["score"] for r in topk.exact_top_k(vectors, vectors.where("vec_id = 0")).collect()}
    assert got == {1: 2**63 - 1, 3: 2**63 - 1, 4: (1 << 48) * 256, 2: -(2**63 - 1)}
