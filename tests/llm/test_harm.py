"""Severity: disguises, defined cases, and held-out accuracy on rated documents."""

import os

import numpy as np
import pytest

from hitlore.llm import harm
from hitlore.llm.queries import SEVERE

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    ("written", "plain"),
    [("mooooron", "moron"), ("th_ieves", "thieves"), ("asSHole", "ashole"), ("ve''rmin", "vermin"), ("h4lfw1t", "halfwit"), ("5lut", "slut"), ("f​ick", "fick"),
     ("bаstаrd", "bastard"), ("ja.ckass", "jackas"), ("débile", "debile"), ("𝔊𝔬𝔱𝔥𝔦𝔠", "gothic"), ("1928", "#"), ("class", "clas"), ("bad", "bad")],
)
def test_disguises(written, plain):
    assert harm.canonical(written) == plain


def test_stars_and_letters_apart():
    v = harm.Vocabulary.of_words({"vermin": 2, "sterben": 3, "pathetic": 4, "a": 5}, ["vermin", "sterben"])
    assert v.numbers("v*rmin ste*ben v**min x*y").tolist() == [2, 3, 2, 0]
    assert 4 in v.numbers("what a p a t h e t i c thing").tolist()
    assert v.numbers(None).tolist() == [] and v.numbers(" \n").tolist() == []


@pytest.mark.parametrize("text", ["\nf u c k!", '"f u c k"', "<p>f u c k</p>", "f u c k", "(f u c k)", "so f u c k\nyou"])
def test_letters_apart_beside_any_sign(text):
    assert 2 in harm.Vocabulary.of_words({"fuck": 2}).numbers(text).tolist()


def test_many_stars_stars_at_the_end_and_three_letters_apart():
    v = harm.Vocabulary.of_words({"fucker": 2, "fuck": 3, "ass": 4, "a": 5, "bold": 6, "b": 7, "c": 8, "die": 9, "#": 10, "d": 11, "i": 12, "e": 13}, ["ass", "fuck", "fucker"])
    assert v.numbers("f****r F***, (f***) f*** 'f*****'").tolist() == [2, 3, 3, 3, 2]
    assert v.numbers("A* **bold** bold* 1928* *** * a").tolist() == [5, 6, 6, 10, 5]
    # Three letters stay, because they may be initials, and come as one word as well.
    assert v.numbers("(a s s) a b c\na s s").tolist() == [5, 0, 0, 4, 5, 7, 8, 0, 5, 0, 0, 4]
    assert v.numbers("d i e").tolist() == [11, 12, 13, 9]
    assert v.numbers("a b c").tolist() == [5, 7, 8, 0]
    assert harm.tokens("f****r f*** a*b*c") == ["f****r", "f***", "a*b*c"]


def texts(n=120):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(60)]
    fill = lambda k: " ".join(rng.choice(words, k))
    out, grades = [], []
    for i in range(n):
        bad = i % 4 == 0
        # A word that is an insult in one place and an animal in another.
        out.append(fill(30) + (" you are a stupid grumple lol " if bad else " the grumple is an animal of the valley ") + fill(30))
        grades.append(2 if bad else 0)
    grades[0], grades[1] = 1, 1
    return out, np.array(grades)


def test_context_decides():
    x, y = texts()
    model = harm.fit(x, y)
    s = model.score_texts([*x, "the grumple is an animal of the valley", "You are a STUPID gr.umple!", "", None, "   "])
    assert ((s[2 : len(x)] >= 1) == (y[2:] == 2)).mean() > 0.97
    assert s[-5] < 1 <= s[-4] and s[-3:].tolist() == [0, 0, 0]
    assert (np.diff(model.thresholds) >= 0).all()
    alone = [model.score_texts([t])[0] for t in x]
    assert np.allclose(alone, s[: len(x)])  # texts scored together do not see each other


def test_without_ratings_nothing_is_severe():
    for x, y in (([], []), (["a b", "you scum"], [0, 0])):
        s = harm.fit(x, np.array(y, int)).score_texts(["fuck you stupid worthless cunt", "a quiet village near the river"])
        assert s[0] == s[1] < 0.6


def test_gradients_of_the_cumulative_likelihood():
    rng = np.random.default_rng(5)
    scores, grades, cuts = rng.normal(0, 2, 40), rng.integers(0, 3, 40), np.array([0.3, -0.4])
    loss, by_score, by_cuts = harm.cumulative_loss(scores, grades, cuts)
    theta, e = harm.ordered(cuts), 1e-6
    assert theta[0] < theta[1]
    reached = np.column_stack([np.ones(40), 1 / (1 + np.exp(theta[None, :] - scores[:, None])), np.zeros(40)])
    assert np.isclose(loss, -np.log(reached[np.arange(40), grades] - reached[np.arange(40), grades + 1]).sum())
    for i in range(40):
        moved = scores.copy()
        moved[i] += e
        assert np.isclose((harm.cumulative_loss(moved, grades, cuts)[0] - loss) / e, by_score[i], atol=1e-4)
    for i in range(2):
        moved = cuts.copy()
        moved[i] += e
        assert np.isclose((harm.cumulative_loss(scores, grades, moved)[0] - loss) / e, by_cuts[i], atol=1e-3)


def test_words_are_learnt_from_the_ratings_and_read_through_stars():
    rng = np.random.default_rng(4)
    fill = lambda k: " ".join(rng.choice([f"word{c}" for c in "abcdefghijklmnopq"], k))
    x = [fill(30) + (f" they are {w} all of them" if w else " ") + fill(20) for w in ["grumples", "flobs", "", "", "", ""] * 24]
    y = np.array([2, 2, 0, 0, 0, 0] * 24)
    model = harm.fit(x, y)
    assert {"grumples", "flobs"} <= set(model.vocabulary.stars.words) and "worda" not in model.vocabulary.stars.words
    s = model.score_texts([f"{x[4]} they are {w} all of them {x[9]}" for w in ("grumples", "gr*mples", "g.rumples", "grum\u200bples", "GRUUUMPLES")] + [x[4]])
    assert (s[:5] >= 0.6).all() and s[5] < 0.6


def test_long_texts_are_read_to_the_end():
    x, y = texts()
    model = harm.fit(x, y)
    assert model.score_texts(["quiet words " * 20_000 + "you are a stupid grumple lol"])[0] >= 1


def test_grades_and_defined_cases(spark):
    labels = spark.createDataFrame(
        [(1, 1, "a", "harmful"), (2, 1, "b", "fine"), (3, 2, "a", "fine"), (4, 3, "a", None), (5, 4, "a", "harmful"), (6, 4, "a", "harmful"), (7, None, "a", "harmful")],
        "label_id long, doc_id long, rater string, verdict string",
    )
    assert {r.doc_id: r.grade for r in harm.graded(labels).collect()} == {1: 1, 2: 0, 4: 2}
    docs = spark.createDataFrame([(1, "x y", "s"), (2, None, None), (4, "fuck off", "s"), (4, "fuck off", "s")], "doc_id long, text string, severity string")
    model = harm.train(docs, labels)
    got = harm.score(docs, model).collect()
    assert len(got) == 4 and [r.severity for r in got if r.doc_id == 2] == [0.0]
    assert harm.score(docs.limit(0), model).count() == 0
    assert harm.train(docs.limit(0), labels.limit(0)).score_texts(["x"])[0] < 0.6


def test_training_on_executors_is_training_in_one_process(spark):
    x, y = texts(60)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(x)], "doc_id long, text string, page_id long").repartition(5)
    labels = spark.createDataFrame([(j, i, str(j), "harmful" if (g == 2 or (g == 1 and j)) else "fine") for i, g in enumerate(y) for j in (0, 1)], "label_id long, doc_id long, rater string, verdict string")
    here, there = harm.fit(x, y, [str(i) for i in range(60)]), harm.train(docs, labels)
    assert np.allclose(here.score_texts(x), there.score_texts(x), atol=0.02)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy():
    import duckdb

    con = duckdb.connect()
    rows = con.sql(f"""SELECT d.page_id, d.text, count(*) FILTER (verdict = 'harmful') AS h, count(*) AS n FROM '{SF}/review_labels.parquet' l
        JOIN '{SF}/documents.parquet' d ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL AND verdict IS NOT NULL GROUP BY d.doc_id, d.page_id, d.text ORDER BY d.doc_id""").fetchall()
    grade = lambda r: 0 if r[2] == 0 else 2 if r[2] == r[3] else 1
    train, test = [r for r in rows if r[0] % 3], [r for r in rows if not r[0] % 3]
    model = harm.fit([r[1] for r in train], np.array([grade(r) for r in train]), [r[0] for r in train])
    sure = [r for r in test if grade(r) != 1]
    s = model.score_texts([r[1] for r in sure])
    assert np.mean((s >= SEVERE) == np.array([grade(r) == 2 for r in sure])) > 0.9  # raters err in about a tenth of the documents
