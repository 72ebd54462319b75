"""The pipeline against its stages done plainly in Python."""

import hashlib
import random

import numpy as np
import sentencepiece

import corpus_pipeline
from oreline.llm import fertility, near_copies, pii, sentencepiece_bpe, simhash
from tests.llm.test_text_operators import WORD, naive_base, naive_components, naive_fingerprint, naive_mix, words


def _documents(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(160):
        text = words(rnd, rnd.randint(5, 90), "abcdefghij")
        if i % 9 == 0:
            text += " mail a.b@c.de or +1 (555) 123-4567"
        rows.append((i, text, "en", rnd.choice(["s1", "s2", "s3"]), len(text)))
    rows += [(200 + i, rows[4][1], "en", "s1", len(rows[4][1])) for i in range(6)]
    rows += [(300, "again and again " * 40, "en", "s2", 640), (301, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_stages_against_brute_force(spark, tmp_path):
    docs, rows = _documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "personal_data", "source_mix", "encoding"]

    # quality: all texts are letters of one kind here, so the bands reject nothing
    def fails(text):
        n, _, _, _, rep = naive_base(text)
        return n < 10 or 100 * rep > 20 * n

    judged = {r["doc_id"]: r["kept"] for r in fertility.judged(docs).collect()}
    kept = [r for r in rows if judged[r[0]]]
    assert all(judged[r[0]] <= (not fails(r[1])) for r in rows)
    assert sum(not fails(r[1]) for r in rows) - len(kept) <= 3

    groups = naive_components([(r[0], naive_fingerprint(r[1])) for r in kept])
    stay = {c for _, _, c in groups}
    kept = [r for r in kept if r[0] in stay]

    finder = pii.Finder(pii.fitted())
    masked = []
    for r in kept:
        out, at = "", 0
        for s, k, e, _ in finder.spans([r[1]])[0]:
            if s >= at:
                out += r[1][at:s] + f"<{k.upper()}>"
            at = max(at, e)
        masked.append((r[0], out + r[1][at:], r[3]))  # id, text, source

    result = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    want = []
    for source, found in naive_mix(masked).items():
        for doc_id, text, n, _, _, _, passes, chosen in found:
            copies = [text] * (passes + (n > 0 and all(chosen)))
            if any(chosen) and not all(chosen):
                copies.append(" ".join(w for w, hit in zip(WORD.findall(text), chosen) if hit))
            for copy in copies:
                ids = library.encode(copy, add_bos=True, add_eos=True)
                decoded = library.decode(ids)
                want.append((doc_id, source, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(repr, result)) == sorted(map(repr, want))


def test_stages_of_an_empty_table(spark, tmp_path):
    docs, _ = _documents(spark)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_outputs_keep_the_columns_of_documents(spark):
    docs, _ = _documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name


def test_one_of_each_group_is_the_smallest_id(spark):
    docs, rows = _documents(spark)
    kept = {r["doc_id"] for r in simhash.one_of_each_group(docs).collect()}
    assert 4 in kept and not kept & set(range(200, 206))


def test_texts_that_only_fingerprints_link_are_one_group(spark):
    """Forty repeats of nine words and an end of their own: one fingerprint, but five-word sets that share too little."""
    rnd = random.Random(3)
    base = [words(rnd, 1, "abcdefghij") for _ in range(9)]
    long_ = " ".join(base * 40)
    ends = [f"{long_} {words(rnd, 3, 'klmnop')}" for _ in range(3)]
    rows = [(1, ends[0]), (2, ends[1]), (3, ends[2]), (9, words(rnd, 60, "qrstuv"))]
    assert len({naive_components([(i, naive_fingerprint(t)) for i, t in rows[:3]])[k][2] for k in range(3)}) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, "").collect()) == [1, 9]
    assert sorted(r["doc_id"] for r in near_copies.one_of_each_group(docs).collect()) == [1, 2, 3, 9]
