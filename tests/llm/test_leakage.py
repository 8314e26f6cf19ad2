"""Leaked passages against a plain search of words."""

import random
import re
import unicodedata

from quern.llm import leakage

HIDDEN = re.compile("[​­‍﻿]")


def words(t):
    return re.findall(r"[^\W_]+", HIDDEN.sub("", t or "").casefold())


def brute(docs, items, share, n):
    out = []
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, it in items:
            x = words(it)
            hit = {p for i in range(len(x) - n + 1) if tuple(x[i : i + n]) in grams for p in range(i, i + n)}
            if hit and len(hit) >= share * len(x):
                out.append((d, k, len(hit), len(x)))
    return sorted(out, key=repr)


def data(seed):
    rng = random.Random(seed)
    vocabulary = ["der", "Straße", "STRASSE", "one", "two", "three", "é", "中文", "x1", "no_under", "a­b", "don't"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(4, 30))) for k in range(25)] + [(90, None), (91, ""), (92, "one two"), (None, text(9))]
    docs = [(d, text(60)) for d in range(20)] + [(50, None), (51, ""), (52, "   ")]
    for d in range(100, 130):
        w = rng.choice(items[:25])[1].split(" ")
        a = rng.randrange(len(w))
        part = w[a : a + rng.randint(3, 20)]
        docs.append((d, text(20) + ", " + " ​– ".join(p.upper() if rng.random() < 0.3 else p for p in part) + "\n\n" + text(5)))
    return docs + docs[-3:], [*items, items[0]]


def test_against_a_plain_search(spark):
    for seed, most in ((1, leakage.BLOCK_GRAMS), (2, 10)):  # also with the items in many blocks
        docs, items = data(seed)
        d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as item_id", "2 as words").repartition(3)
        i = spark.createDataFrame(items, "item_id bigint, text string")
        got = sorted(map(tuple, leakage.find_leaks(d, i, most=most).collect()), key=repr)
        assert got == brute(docs, [x for x in items if x[0] is not None], 0.25, 5)
        assert leakage.find_leaks(d.limit(0), i).collect() == [] and leakage.find_leaks(d, i.limit(0)).collect() == []


def test_removal(spark):
    docs = [(1, "keep this. One TWO th­ree four five six! and that", "a"), (2, "nothing here at all", "b"), (3, None, "c")]
    items = spark.createDataFrame([(7, "one two three four five six")], "item_id bigint, text string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    assert [r.doc_id for r in leakage.find_leaks(d, items).collect()] == [1]
    assert sorted(r.doc_id for r in leakage.without_documents(d, leakage.find_leaks(d, items)).collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in leakage.without_spans(d, items).collect()}
    assert cut[1].replace("­", "") == "keep this. ! and that" and cut[2] == docs[1][1] and cut[3] is None
    assert leakage.find_leaks(leakage.without_spans(d, items), items).collect() == []


def test_removal_of_decomposed_texts_and_over_blocks(spark):
    passage = "der Café-Besitzer fährt über Straßen nach Zürich"
    hidden = unicodedata.normalize("NFD", passage.upper()).replace("R", "R\u200b")
    docs = [(1, f"vorher é {hidden}, nachher"), (2, unicodedata.normalize("NFD", "é è ê") + " bleibt"), (3, None), (4, "가나 " + unicodedata.normalize("NFD", "한국 말 하나 둘 셋") + " 끝"), (5, "x a b c d e f g h i y")]
    items = spark.createDataFrame([(7, passage), (8, "한국 말 하나 둘 셋"), (9, "a b c d e f"), (10, "d e f g h i")], "item_id bigint, text string").coalesce(1)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r.doc_id for r in leakage.find_leaks(d, items).collect()} == {1, 4, 5}
    for most in (leakage.BLOCK_GRAMS, 1):
        got = {r.doc_id: r.text for r in leakage.without_spans(d, items, most=most).collect()}
        assert got == {1: "vorher é , nachher", 2: docs[1][1], 3: None, 4: "가나  끝", 5: "x  y"}


def test_positions_of_normalised_texts():
    rng = random.Random(9)
    alphabet = "aeE\u0301\u0300\u0323\u200b ßİﬁ\u0344\u1100\u1161\u11a8가한\u09c7\u09be中.\u00ad"
    for _ in range(3_000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25)))
        codes, owner, bounds = leakage._normalised(t)
        whole = leakage.code_points(unicodedata.normalize("NFC", t.casefold()))
        assert codes.tolist() == whole[~leakage.invisible_characters()[whole]].tolist() and len(owner) == len(codes) and bounds[0] == 0 and bounds[-1] == len(t)


def test_removal_queries_are_registered(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "a b one two three four five six c"), (2, "none"), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "one two three four five six")], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    run = lambda name: {r.doc_id: r.text for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert run("p9_without_spans") == {1: "a b  c", 2: "none", 3: None}
    assert run("p9_without_documents") == {2: "none", 3: None}
