"""Leaked passages against brute force, with a roomy and a crowded filter."""

import random

import numpy as np
import pytest

from hitlore.llm import leaks, plain

random.seed(3)
VOCABULARY = [f"w{i}" for i in range(40)] + ["Été", "straße", "ﬁn"]
LONG = [" ".join(random.choice(VOCABULARY) for _ in range(n)) for n in (12, 13, 20, 40, 60)]
ITEMS = [(i, t) for i, t in enumerate(LONG)] + [(10, "Who built the old mill?"), (11, "one"), (12, ""), (13, None), (14, "..."), (15, LONG[2] + " more words"), (10, "Who built the old mill?")]


def words_at(i, a, n):
    return " ".join(LONG[i].split()[a : a + n])


DOCS = [
    (1, "intro " + LONG[0] + " tail"), (2, words_at(2, 3, 12).upper()), (3, words_at(2, 3, 11)), (4, "who BUILT the óld mill"), (5, None), (6, ""), (7, "one two"),
    (8, words_at(3, 5, 6) + "<ref name=x>cited here</ref> " + words_at(3, 11, 6)), (9, words_at(3, 5, 6) + " <!-- c --> {{tl|a|{{b}}}} " + words_at(3, 11, 6)),
    (10, words_at(3, 5, 5) + " [[Target|" + words_at(3, 10, 1) + "]] ''" + words_at(3, 11, 6) + "''"), (11, words_at(3, 5, 6).replace(" ", "&nbsp;") + " &amp; " + words_at(3, 11, 6)),
    (12, "{{Infobox | note = " + words_at(4, 20, 14) + "}} rest"), (13, words_at(3, 5, 6) + " other " + words_at(3, 11, 6)), (14, words_at(4, 0, 12).replace("w", "w\u200b")),
    (15, "stra­ße " * 3), (1, "intro " + LONG[0] + " tail"), (16, "pre " * 5000 + LONG[4] + " post" * 5000),
    (17, "[https://x.example " + words_at(3, 5, 12) + "]"), (18, "<b>" + words_at(3, 5, 6) + "</b><br>" + words_at(3, 11, 6)),
]


def contained(doc, item):
    own = plain.words(item)
    w = min(12, len(own))
    if not w:
        return False
    passages = {tuple(own[i : i + w]) for i in range(len(own) - w + 1)}
    return any(tuple(r[i : i + w]) in passages for r in plain.word_runs(doc) for i in range(len(r) - w + 1))


@pytest.mark.parametrize("filter_bytes", [10**7, 16])
def test_against_brute_force(spark, filter_bytes):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, item_id string").repartition(3)
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in leaks.leaks(docs, items, filter_bytes=filter_bytes).collect()]
    assert sorted(got) == sorted({(d, i) for d, x in DOCS for i, t in ITEMS if contained(x, t)})
    assert {(1, 0), (2, 2), (2, 15), (4, 10), (7, 11), (8, 3), (9, 3), (10, 3), (11, 3), (12, 4), (14, 4), (16, 4), (17, 3), (18, 3)} <= set(got)
    assert not {(3, 2), (13, 3), (5, 12), (6, 12)} & set(got)
    assert leaks.leaks(docs.limit(0), items, filter_bytes=filter_bytes).count() == 0
    assert leaks.leaks(docs, items.limit(0), filter_bytes=filter_bytes).count() == 0


def test_windows_share_a_minimum_as_often_as_asked():
    rng, missed, n = np.random.default_rng(1), 0, 400
    for _ in range(n):
        numbers = rng.integers(0, 2**63, int(rng.integers(8, 90))).astype(np.uint64)
        chosen = leaks.signature(numbers, leaks.partition_of(numbers, 12).functions(0.05))
        at = int(rng.integers(0, len(numbers) - 7))
        missed += not np.isin(numbers[at : at + 8], chosen).any()
    assert missed < 0.05 * n  # a partition's bound is above most of its items, so fewer are missed than may be


def test_partitions():
    numbers = np.arange(30, dtype=np.uint64)
    assert leaks.partition_of(numbers, 12) == leaks.Partition(12, 8, 32) and leaks.partition_of(numbers[:8], 12).functions() == 1
    assert leaks.partition_of(numbers[:1], 3) == leaks.Partition(3, 1, 1)
    assert leaks.partition_of(np.array([1] * 8 + list(range(2, 12)), np.uint64), 12).window == 1  # a passage of one repeated word
    assert leaks.Partition(12, 8, 32).functions(1e-5) == 41
    assert len(leaks.shingles(np.zeros(3, np.uint64), 5)) == 0


def test_repeated_words(spark):
    docs = spark.createDataFrame([(1, "x " + "ha " * 13 + "y"), (2, "ha " * 11), (3, "go on " * 6)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ha " * 40), (2, "go on " * 30), (3, "a b c d e f g h " + "ha " * 12 + "i j k l m n")], "item_id long, text string")
    assert {tuple(r) for r in leaks.leaks(docs, items).collect()} == {(1, 1), (1, 3), (3, 2)}


def test_words():
    assert plain.words("It&#39;s <b>Café</b>''s'' {{x|{{y}}}}[[a|b c]] [[d]]<ref>no</ref>-<!-- no -->½") == ["it", "s", "cafes", "b", "c", "d", "1", "2"]
    assert plain.words(None) == [] and plain.words(" ​ ") == []


def test_passages_inside_what_is_passed_over_within_another(spark):
    p, q = words_at(4, 20, 14), words_at(3, 5, 12)
    texts = [
        f"<ref>{{{{cite|title={p}}}}}</ref>", f"<!-- <ref>{{{{cite|{p}}}}}</ref> {{{{x|{q}}}}} -->", f"{{{{a|<ref>{{{{b|{p}}}}}</ref>}}}}", "{{one}}", "<ref>one</ref>",
        f"<ref name='{p}'/>", f"<ref name='{words_at(3, 5, 6)}'>{words_at(3, 11, 6)}</ref>", f"{words_at(3, 5, 6)} {{{{{words_at(3, 11, 6)}}}}}",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {tuple(r) for r in leaks.leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert found == {(0, 4), (1, 4), (1, 3), (2, 4), (3, 11), (4, 11), (5, 4)}
    assert plain.word_runs("<ref>a</ref><ref name=b/>{{c}}<!--d-->") == [["d"], ["a"], ["name", "b"], ["c"]]
