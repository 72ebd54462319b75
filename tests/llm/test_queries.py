"""The registered queries themselves, on the smallest tables, against plain versions."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from oreline.llm import boosting, fertility, mixing, near_copies, pii, quality, queries, sentencepiece_bpe, simhash, toxicity
from tests.llm.test_text_operators import naive_base, naive_components, naive_fingerprint

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def plain_spans(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    tests = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (CARD, lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    }
    found = [(m.start(), i, kind, m.end()) for i, (kind, (pattern, ok)) in enumerate(tests.items()) for m in pattern.finditer(text or "") if ok(m[0])]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def test_op1(spark, sf_dir, documents):
    got = queries.op1_pii(spark, sf_dir).collect()
    assert len(got) == len(documents)
    for r in got:
        base = plain_spans(documents[r["doc_id"]]["text"])
        count = collections.Counter(k for k, _, _ in base)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(count[k] for k in pii.KINDS)
        names = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert set(names) <= set(every) and r["n_spans"] == len(every)
        assert every == sorted(every, key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])))


def test_op4(spark, sf_dir, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    got = queries.op4_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(documents)
    for r in got:
        ids = library.encode(documents[r["doc_id"]]["text"] or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_op5_equals_its_sql(spark, sf_dir):
    got = queries.op5_suffix_dedup(spark, sf_dir)
    want = duckdb.sql(queries.OP5_SQL.replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'"))
    assert sorted(tuple(r) for r in got.select(*sorted(got.columns)).collect()) == sorted(want.project(", ".join(sorted(want.columns))).fetchall())


def test_op6_base_columns(spark, sf_dir, documents):
    for r in queries.op6_fertility(spark, sf_dir).collect():
        text = documents[r["doc_id"]]["text"]
        n, chars, symbols, lines, repeated = naive_base(text or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n) and not (r["base_failed"] and r["kept"])


def test_op9(spark, sf_dir, documents):
    got = sorted(map(repr, map(tuple, queries.op9_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect())))
    assert got == sorted(map(repr, naive_components([(d, naive_fingerprint(r["text"])) for d, r in documents.items()])))


@pytest.mark.parametrize("name,threshold", [("op3_toxicity", 0.5), ("op10_quality", 0.3), ("op7_langid", None)])
def test_learned_queries(spark, sf_dir, documents, name, threshold):
    got = queries.queries()[name](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(documents)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if threshold:
            assert r["predicted"] == int(r["score"] >= threshold)
        else:
            assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", documents[r["doc_id"]]["text"] or ""))


# The learned models against plain versions of their rules


def test_quality_scores_are_dot_products_of_every_ngram(spark):
    texts = ["good words here", "bad bad ## stuff", "", None, "good good good " * 3000]
    docs = spark.createDataFrame([(i, texts[i % 5] if i % 5 > 1 else f"{texts[i % 5]} w{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int")
    weights = quality.fitted(docs, labels.withColumnRenamed("quality", "label"), "label")
    for r in quality.scored(docs, labels).join(docs, "doc_id").collect():
        total, n = 0.0, 0
        for g in quality.ngrams(r["text"]).tolist():
            total, n = total + float(weights[g]), n + 1
        z = total / max(1, n) ** 0.5 + float(weights[-1])
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-6


def test_ftrl_steps_are_those_of_the_rule():
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 50, rng.integers(0, 12)).astype(np.int32) for _ in range(40)]
    labels = rng.integers(0, 2, 40)
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.5
    bias = 1 << quality.BITS
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(10)
    for _ in range(3):
        for i in order.permutation(40):
            x = {int(k): v / max(1, len(rows[i])) ** 0.5 for k, v in collections.Counter(rows[i].tolist()).items()} | {bias: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-sum(w[k] * x[k] for k in x)))
            for k in x:
                g = (p - labels[i]) * x[k]
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / alpha * w[k]
                n[k] += g * g
    got = quality.fit_ftrl(rows, labels)
    assert all(abs(got[k] - weight(k)) < 1e-5 for k in [*range(50), bias])


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 8, (200, 3)).astype(float)
    y = (x[:, 1] > 4).astype(float)
    y[:20] = 1 - y[:20]
    trees = boosting.fit_trees(x, y, trees=1, depth=1, l2=5.0)
    p = y.mean()

    def gain(j, cut):
        g, h = p - y, np.full(200, p * (1 - p))
        hit = x[:, j] > cut
        return sum((g[m].sum()) ** 2 / (h[m].sum() + 5.0) for m in (hit, ~hit))

    best = max(((gain(j, c), j, c) for j in range(3) for c in range(7)))
    assert (trees.feature[0, 0], np.floor(trees.cut[0, 0])) == (best[1], best[2])


def test_calibration_is_the_closest_rising_step_function():
    rng = np.random.default_rng(3)
    margin = rng.normal(size=60)
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * margin))).astype(float)
    at, value = boosting.fit_isotonic(margin, y)
    fitted = np.interp(np.sort(margin), at, value)
    ys = y[np.argsort(margin)]
    # min-max formula of isotonic regression
    want = [max(min(ys[i : k + 1].mean() for k in range(j, 60)) for i in range(j + 1)) for j in range(60)]
    assert np.allclose(fitted, want)


# Columns of clashing names


@pytest.fixture(scope="module")
def awkward(spark):
    text = "the quick brown fox jumps over the lazy dog and mails a.b@c.de before noon on monday"
    names = ["row", "fp", "__fp", "text_", "spans", "__spans", "node", "place", "id", "by_text", "size", "taken", "passes", "cuts", "key", "deal", "of", "middle", "n_tokens", "kept", "__language", "__middle_entropy", "a.b", "found"]
    rows = [(i, text if i % 2 else f"{text} {i}", "en", ["s", None][i % 2], 5, *[f"mine{i}"] * len(names)) for i in range(12)]
    rows.append((None, None, None, None, None, *[None] * len(names)))
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{n}` string" for n in names)])
    return spark.createDataFrame(rows, schema), names


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]] + ["simhash"])
def test_stages_keep_columns_of_any_name(spark, awkward, stage):
    docs, names = awkward
    call = {**dict(corpus_pipeline.STAGES), "simhash": lambda _, d, __: simhash.one_of_each_group(d)}[stage]
    out = call(spark, docs, "")
    assert out.columns == docs.columns and out.schema.names == docs.schema.names
    for r in out.collect():
        want = None if r["doc_id"] is None else f"mine{r['doc_id']}"
        assert all(r[n] == want for n in names), stage


def test_operators_take_columns_of_any_name(spark, awkward):
    docs, names = awkward
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    assert fertility.judged(docs).count() == 13
    assert pii.with_spans(docs).count() == 13
    assert sentencepiece_bpe.encode_decode(docs).count() == 13
    assert quality.scored(docs, labels).count() == 13 and toxicity.scored(docs, labels).count() == 13
    assert mixing.mixed(docs).count() == 13 and near_copies.one_of_each_group(docs).count() <= 13
    assert simhash.simhash_groups(docs.drop("fp")).count() == 13
    assert queries.suffix_dedup.removed_repeats(docs).count() == 13
    assert queries.langid.identified(docs).where(F.col("lang_pred").isNotNull()).count() == 13
