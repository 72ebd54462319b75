"""Trained models: held-out accuracy, defined results for odd rows, small numeric checks."""

import os

import numpy as np
import pytest

from oreline.llm import boosting, crf, langid, quality, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    return read("documents"), read("labels")


def _held_out(scored, labels, label):
    rows = scored.where("held_out").join(labels, "doc_id").select(label, "predicted").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    y, p = _held_out(quality.scored(docs, labels), labels, "quality")
    assert (p[y == 1] == 1).mean() > 0.98 and (p[y == 0] == 0).mean() > 0.6


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    y, p = _held_out(toxicity.scored(docs, labels), labels, "toxic")
    assert (p == y).mean() > 0.95 and (p[y == 0] == 0).mean() > 0.98


def test_language_on_held_out_rows(tables):
    docs, _ = tables
    rows = langid.identified(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


ODD = [(1, None, "en"), (2, "", "fr"), (3, "12 34 --", None), (None, "the house and the river", "en"), (5, "x" * 40000, "en"), (5, "x" * 40000, "en")]


def test_odd_rows_have_defined_results(spark):
    docs = spark.createDataFrame([(*r, "a") for r in ODD], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for scored in (quality.scored(docs, labels), toxicity.scored(docs, labels)):
        rows = scored.collect()
        assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    found = {r["doc_id"]: r for r in langid.identified(docs).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[1]["score"] == 0
    nothing = labels.limit(0)
    assert {r["score"] for r in quality.scored(docs, nothing).collect()} == {0.5}
    assert {r["score"] for r in toxicity.scored(docs, nothing).collect()} == {0.0}
    empty = docs.limit(0)
    assert quality.scored(empty, labels).count() == toxicity.scored(empty, labels).count() == langid.identified(empty).count() == 0


def test_hidden_spellings_are_read():
    words = toxicity.Words({})
    for spelling in ("1d10t", "ID!OT", "i.d.i.o.t", "idiot"):
        row = words.table(np.array([words[spelling]]))[0]
        assert row[0] > 0 or row[1] > 0, spelling


def test_trees_learn_and_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    trees = boosting.fit_trees(x, y)
    margin = trees.margin(x)
    assert ((margin > 0) == y).mean() > 0.97
    at, value = boosting.fit_isotonic(margin, y)
    assert (np.diff(at) >= 0).all() and (np.diff(value) >= 0).all()


def test_folded_tables_equal_the_filters():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    net = langid.train(x, rng.integers(0, 3, 40), list("abc"), epochs=1)
    pooled = np.concatenate([np.maximum(net.responses(x, k).max(axis=1), 0) for k in range(len(langid.WIDTHS))], axis=1)
    z = pooled @ net.dense + net.dense_bias
    e = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(net.probabilities(x), e / e.sum(axis=1, keepdims=True), atol=1e-5)


def test_batched_viterbi_equals_one_by_one():
    labels = ["O", "B-x", "I-x"]
    table = [[("a", "O"), ("1", "B-x"), ("2", "I-x"), ("b", "O")], [("b", "O"), ("a", "O")], [("1", "B-x"), ("a", "O"), ("2", "O")]] * 4
    model = crf.fit(table, lambda w: (w, "d" if w.isdigit() else "x"), labels, rounds=40)
    classes = crf.Classes(model, lambda w: (w, "d" if w.isdigit() else "x"))
    rng = np.random.default_rng(1)
    sentences = [[["a", "b", "1", "2", "zz"][i] for i in rng.integers(0, 5, n)] for n in (1, 7, 2, 30, 4, 1)]
    ids = [np.array([classes[w] for w in s]) for s in sentences]
    starts = np.cumsum([0, *(len(i) for i in ids[:-1])])
    batch = crf.viterbi(model, classes, np.concatenate(ids), starts)
    for i, s in zip(ids, starts):
        assert (batch[s : s + len(i)] == crf.viterbi(model, classes, i, np.array([0]))).all()
        score = classes.scores[0][i] + classes.scores[1][np.append(0, i[:-1])] + classes.scores[2][np.append(i[1:], 0)]
        if len(i) <= 7:
            import itertools

            value = lambda p: model.start[p[0]] + sum(score[t, p[t]] for t in range(len(p))) + sum(model.steps[a, b] for a, b in zip(p, p[1:]))
            best = max(itertools.product(range(3), repeat=len(i)), key=value)
            assert np.isclose(value(best), value(batch[s : s + len(i)].tolist()), atol=1e-4)


def test_isotonic_steps_with_tied_margins():
    """Against the min-max form of isotonic regression, whatever the order of equal margins."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        margin, y = rng.integers(0, 6, n).astype(float), rng.integers(0, 2, n).astype(float)
        at = np.unique(margin)
        want = []
        for v in at:
            low = [max(min(y[(margin >= a) & (margin <= b)].mean() for b in at[at >= v]) for a in at[at <= v])]
            want.append(low[0])
        for order in (np.arange(n), rng.permutation(n)):
            knots, values = boosting.fit_isotonic(margin[order], y[order])
            assert np.allclose(np.interp(at, knots, values), want)
    assert np.interp(0.0, *boosting.fit_isotonic(np.zeros(4), np.array([0.0, 0, 1, 1]))) == 0.5


def plain_features(text, lexicon):
    """The 18 features word by word, from their description."""
    words = (text or "").split()
    if not words:
        return [0.0] * 18
    best = lambda w: max([lexicon.get(s, 0.0) for s in toxicity.stems(w)], default=0.0)
    known = lambda w: max(best(w), 6.0) if w in toxicity.INSULTS else best(w)
    rows = []
    for w in words:
        core, plain, readable = w.strip(toxicity._SIGNS), toxicity.plain_form(w), toxicity.readable_form(w)
        if core.isalpha():
            plain = readable = core.lower()
        open_ = known(plain)
        hidden = known(readable) if readable != plain and not open_ else 0.0
        letters, caps = sum(c.isalpha() for c in w), sum(c.isupper() for c in w)
        mixed = not core.isalpha() and any(c.isalpha() for c in plain)
        rows.append((open_, hidden, plain in toxicity.SECOND_PERSON, caps, letters, letters > 1 and caps == letters, mixed, len(w) - letters, plain if core.isalpha() else None, w))
    n, hits = len(rows), [i for i, r in enumerate(rows) if r[0] > 0 or r[1] > 0]
    near = [any(rows[j][2] for j in range(max(0, i - 6), min(n, i + 7))) for i in hits]
    letters, signs = sum(r[4] for r in rows), sum(r[7] for r in rows)
    total = sum(r[0] + r[1] for r in rows)
    strong = sorted(max(r[0], r[1]) for r in rows)[-3:]
    return [
        len(hits) / n, np.log1p(len(hits)), total / n, np.log1p(total), max(max(r[0], r[1]) for r in rows), len({rows[i][9].lower() for i in hits}),
        sum(r[1] > 0 for r in rows) / n, sum(r[1] > 0 for r in rows), sum(near) / n, sum(near) / len(hits) if hits else 0.0, sum(r[2] for r in rows) / n,
        sum(r[3] for r in rows) / max(1, letters), sum(r[5] for r in rows) / n, signs / (max(1, letters) + signs), sum(r[6] for r in rows) / n,
        (text.count("!") + text.count("?")) / n, np.log1p(n), sum(strong),
    ]


def test_toxicity_scores_are_those_of_plain_rules(tables):
    """Features word by word, trees walked node by node, steps looked up one by one."""
    docs, labels = tables
    texts = docs.select("doc_id", "text").limit(150)
    known = labels.select("doc_id", toxicity.F.col("toxic").alias("label"))
    lexicon, trees, (knots, values) = toxicity.fitted(toxicity.training_texts(docs.select("doc_id", "text"), known, "label", toxicity.TRAINING_BOUND).select("doc_id", "text", "label"))
    assert lexicon and all(b >= a for a, b in zip(values, values[1:]))
    words = toxicity.Words(lexicon)
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, labels).collect()}
    odd = ["", "You are an 1d10t!!! yes YOU", "i.d.i.o.t ... ok", "ALL CAPS ++ 12 a1b2 d'accord", "¿estúpido? tú"]
    for text in odd + [r["text"] for r in texts.collect()]:
        assert np.allclose(toxicity.features(text, words), plain_features(text, lexicon), rtol=1e-4, atol=1e-5), text[:80]
    for r in texts.collect():
        x = toxicity.features(r["text"], words).astype(float)
        margin = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
            margin += leaf[node - len(feature)]
        at = np.searchsorted(knots, margin)
        if at == 0 or at == len(knots):
            want = values[0] if at == 0 else values[-1]
        else:
            a, b = knots[at - 1], knots[at]
            want = values[at - 1] + (values[at] - values[at - 1]) * ((margin - a) / (b - a) if b > a else 1.0)
        assert abs(scores[r["doc_id"]] - want) < 1e-6


def test_language_predictions_are_means_over_all_windows(tables):
    docs, _ = tables
    source = docs.select("doc_id", "text", "lang")
    net = langid.fitted(source)
    got = {r["doc_id"]: r for r in langid.identified(docs).collect()}
    for r in source.limit(120).collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        each = [net.probabilities(w[None])[0] for w in langid.windows_of(r["text"])]
        mean = sum(each) / len(each)
        assert got[r["doc_id"]]["lang_pred"] == net.languages[int(np.argmax(mean))] and abs(got[r["doc_id"]]["score"] - min(1.0, mean.max())) < 1e-4
