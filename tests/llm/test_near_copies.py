"""The pipeline's near-dedup against all pairs of shingle sets."""

import random

import pytest

import corpus_pipeline
from oreline.llm import near_copies
from tests.llm.test_text_operators import words


def naive_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def naive_kept(rows):
    sets = [naive_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def test_copies_with_a_few_edits_go(spark):
    rnd = random.Random(3)
    base = words(rnd, 100, "abcdefgh").split()
    rows = [(1, " ".join(base))]
    for i in range(20):
        w = list(base)
        w[4 * i + 8] = "edited"
        rows.append((2 + i, " ".join(w)))
    rows.append((50, words(rnd, 100, "abcdefgh")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [1, 50]


def test_rounds_join_only_sets_that_are_still_apart(spark, monkeypatch):
    rnd = random.Random(12)
    base = words(rnd, 100, "abcdefgh").split()
    rows = [(1, " ".join(base))] + [(2 + i, " ".join([*base[: 4 * i], "edited", *base[4 * i + 1 :]])) for i in range(20)]
    joined, alike = [], near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, sets, sketches: joined.append((sets.count(), sketches.count())) or alike(pairs, sets, sketches))
    got = near_copies.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in got.collect()] == [1]
    assert joined[0] == (21, 21)
    assert set(joined[1:]) == {(0, 0)}  # all are one component with their centre


def test_groups_are_those_of_all_pairs(spark):
    rnd = random.Random(8)
    rows = [(i, words(rnd, rnd.randint(0, 60), "abcdefgh")) for i in range(60)]
    for start in (100, 200, 300):
        text = words(rnd, 120, "abcdefgh").split()
        for i in range(30):  # a chain: each text is an edit of the one before
            rows.append((start + i, " ".join(text)))
            for _ in range(rnd.randint(0, 2)):
                text[rnd.randrange(len(text))] = words(rnd, 1, "abcdefgh")
    rows += [(400, ""), (401, None), (402, " \n"), (403, "one two"), (404, "ONE  two"), (405, "one two three")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = near_copies.one_of_each_group(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == naive_kept(rows)
    assert near_copies.one_of_each_group(df.limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [0, 2])
def test_families_truncated_and_shared_edits(spark, monkeypatch, rounds):
    """Groups whose members are not near their centre, but near each other in many ways."""
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    monkeypatch.setattr(near_copies, "FEW", 1)
    rnd = random.Random(21)
    base = words(rnd, 150, "abcdefgh").split()
    rows = [(i, " ".join(base)) for i in range(2)]
    edit = lambda w, places: [f"e{rnd.randrange(10**6)}" if i in places else x for i, x in enumerate(w)]
    for family in range(6):  # far from the base, with a family of its own
        start = edit(base, set(rnd.sample(range(150), 5)))
        for i in range(8):
            rows.append((100 + 10 * family + i, " ".join(edit(start, set(rnd.sample(range(150), rnd.choice([1, 2, 4])))))))
    for i in range(30):  # pieces of the base, sizes from a third on
        n = rnd.randint(50, 149)
        at = rnd.choice([0, 150 - n, rnd.randint(0, 150 - n)])
        rows.append((300 + i, " ".join(base[at : at + n])))
    rows += [(400 + i, " ".join(edit(base, set(rnd.sample(range(150), 6))))) for i in range(25)]
    got = near_copies.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == naive_kept(rows)


def test_shingles_of_one_member_only_are_not_dealt_out(spark, monkeypatch):
    """Far edits of one text, each with words of its own: nothing that two of them share is left to look for."""
    monkeypatch.setattr(near_copies, "FEW", 1)
    rnd = random.Random(5)
    base = words(rnd, 150, "abcdefgh").split()
    rows = [(1, " ".join(base))]
    for i in range(25):
        places = set(rnd.sample(range(150), 6))
        rows.append((2 + i, " ".join(f"e{i}x{j}" if j in places else x for j, x in enumerate(base))))
    held, dealt = [], near_copies._dealt
    monkeypatch.setattr(near_copies, "_dealt", lambda members: held.append(sum(len(r["rest"]) for r in members.collect())) or dealt(members))
    got = near_copies.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == naive_kept(rows)
    assert held and max(held) < 100  # 876 before, about 30 a member


def test_rows_without_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l"), (5, "x y"), (5, "x y"), (5, "y x")]
    out = near_copies.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, [(3, "a b c d e f"), (None, "g h i j k l"), (5, "x y"), (5, "y x")]))
