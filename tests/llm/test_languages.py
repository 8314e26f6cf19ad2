"""Languages by compression: accuracy on held-out text, wrong labels, mixed documents."""

import random

import pytest

from quern.llm import languages

WORDS = {
    "en": "the device of and with which is housing pump valve drives under pressure moreover against within sensor limits cools between".split(),
    "de": "die vorrichtung der und mit welche ist gehäuse pumpe ventil treibt unter druck ferner gegen innerhalb sensor begrenzt kühlt zwischen".split(),
    "fr": "le dispositif de et avec lequel est boîtier pompe soupape entraîne sous pression ainsi contre dans capteur limite refroidit entre".split(),
    "ru": "устройство и с которое есть корпус насос клапан приводит под давлением кроме против внутри датчик ограничивает охлаждает между".split(),
}


def text(rng, language, paragraphs=4):
    return "\n\n".join(" ".join(rng.choice(WORDS[language]) for _ in range(30)).capitalize() + f" ({rng.randrange(99)})." for _ in range(paragraphs))


@pytest.fixture(scope="module")
def fitted():
    rng = random.Random(1)
    samples = {x: [text(rng, x) for _ in range(20)] + [text(rng, "en")] for x in WORDS}
    samples["nl"] = [text(rng, "de") for _ in range(6)]  # a wrong name of one language
    samples["xx"] = [text(rng, rng.choice(list(WORDS))) for _ in range(12)]  # a mixture
    return languages.fit(samples)


def test_wrong_names_and_mixtures_are_no_languages(fitted):
    assert set(fitted.contents) == set(WORDS)


def test_held_out_accuracy(fitted):
    rng = random.Random(2)
    for x in WORDS:
        for _ in range(25):
            (segment, language, confidence), *foreign = fitted.segments(text(rng, x))
            assert (segment, language, foreign) == (0, x, []) and 0 < confidence <= 1


def test_mixed_documents_and_what_does_not_count(fitted):
    rng = random.Random(3)
    mixed = "\n\n".join(["Pump P-12", text(rng, "en", 2), "\\frac{a_1}{b^2} = 17", text(rng, "fr", 1), "<math><mi>v</mi></math>", text(rng, "ru", 1), text(rng, "en", 1)])
    assert [(s, x) for s, x, _ in fitted.segments(mixed)] == [(0, "en"), (5, "fr"), (7, "ru")]
    for none in (None, "", "   ", "12 34 56", "\\alpha_{1}", "Kobe", "\n\n"):
        assert fitted.segments(none) == []
    assert fitted.segments(text(rng, "de", 400))[0][1] == "de"


def test_long_paragraphs(fitted):
    rng = random.Random(5)
    for size in (2_001, 25_000, 100_000, 1_000_000):
        for x in WORDS:
            long = " ".join(rng.choice(WORDS[x]) for _ in range(size // 4))[:size]
            pieces = languages.cut(long)
            assert b"".join(pieces) == long.encode() and max(len(c.decode()) for c in pieces) <= languages.PIECE
            assert [(s, y) for s, y, _ in fitted.segments(long)] == [(0, x)] and fitted.judge(long)[1] > 0.1
    french = " ".join(rng.choice(WORDS["fr"]) for _ in range(20_000))
    assert [(s, x) for s, x, _ in fitted.segments(text(rng, "en", 1) + "\n\n" + french + "\n\n" + text(rng, "de", 1))] == [(0, "fr"), (1, "en"), (3, "de")]


def test_signs_that_begin_no_markup_are_text(fitted):
    rng = random.Random(7)
    words = lambda x, n=14: " ".join(rng.choice(WORDS[x]) for _ in range(n))
    for plain in (f"{words('en')} x < 5 {words('en')}", f"$5 {words('en')} $6", f"{words('en')} <3 {words('en')} > 2", f"{words('en')} [[{words('en')}]]"):
        assert languages.running_text(plain) == plain and fitted.segments(plain)[0][:2] == (0, "en")
    for formula in ("$x^2 + y$", "$$\\frac{a}{b}$$", "<math><mi>v</mi></math>", "[[FORMULA-012]]", '<a href="x y">', "<mi", "$ 5 $"):
        kept = languages.running_text(f"{words('de')} {formula} {words('de')}")
        assert not any(c in kept for c in "<>[]{}^\\")
        assert fitted.segments(f"{formula}\n\n{formula} {formula}") == []
    assert languages.running_text(f"{words('de')} $$\\sum_{{k=1}}^{{35}} v_k").endswith("  ")


def test_scripts_of_no_known_language_are_rejected(fitted):
    greek = "η συσκευή του οποίου το περίβλημα και η αντλία κινεί τη βαλβίδα υπό πίεση εντός του αισθητήρα και περιορίζει την ψύξη μεταξύ των δύο πλευρών".split()
    thai = "อุปกรณ์ของตัวเรือนและปั๊มซึ่งขับเคลื่อนวาล์วภายใต้ความดันภายในเซ็นเซอร์"
    rng = random.Random(8)
    for n in (12, 60, 600, 5_000):
        assert fitted.segments(" ".join(rng.choice(greek) for _ in range(n))) == []
    assert fitted.segments(thai * 3) == []
    alone = languages.fit({"ru": [text(rng, "ru") for _ in range(20)]})
    assert [(s, x) for s, x, _ in alone.segments(text(rng, "ru"))] == [(0, "ru")] and 0 < alone.judge(text(rng, "ru", 1))[1] < 1
    assert alone.segments(" ".join(greek)) == [] and alone.segments(text(rng, "en")) == []
    mixed = text(rng, "ru", 2) + "\n\n" + " ".join(greek)
    assert [(s, x) for s, x, _ in fitted.segments(mixed)] == [(0, "ru")]


def test_a_corpus_of_short_texts(spark):
    rng = random.Random(9)
    short = lambda x: " ".join(rng.choice(WORDS[x]) for _ in range(14))[:100]
    rows = [(i, short(x), x if i % 9 else None) for i, x in enumerate(list(WORDS) * 60)]
    got = {(r.doc_id, r.segment): r.lang for r in languages.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert sum(got.get((i, 0)) == list(WORDS)[i % 4] for i, _, _ in rows) >= 0.95 * len(rows)


def test_documents_of_short_paragraphs_have_a_language(fitted):
    for x, short in (("en", "The device\n\nwith the valve\n\nunder pressure"), ("de", "Die Vorrichtung\n\n<b>mit</b> Gehäuse"), ("fr", "le dispositif\n\n12 34\n\navec boîtier"), ("ru", "давлением")):
        found = fitted.segments(short)
        assert [(s, y) for s, y, _ in found] == ([] if x == "ru" else [(0, x)]) and all(0 <= c <= languages.MARGIN for _, _, c in found)
    assert fitted.sure_segments("The device\n\nwith the valve") == []


def test_languages_of_one_document_or_of_short_documents(spark):
    rng = random.Random(6)
    samples = {x: [text(rng, x) for _ in range(20)] for x in ("en", "de")}
    assert set(languages.fit(samples | {"fr": [text(rng, "fr", 12)], "nl": [text(rng, "de", 12)]}).contents) == {"en", "de", "fr"}
    assert set(languages.fit(samples | {"fr": [" ".join(rng.choice(WORDS["fr"]) for _ in range(400))]}).contents) == {"en", "de", "fr"}
    short = lambda x: " ".join(rng.choice(WORDS[x]) for _ in range(20))
    rows = [(i, text(rng, x), x) for i, x in enumerate(["en", "de"] * 12)] + [(100 + i, short("fr"), "fr") for i in range(30)] + [(200 + i, short("de"), "de") for i in range(5)] + [(300, text(rng, "fr"), None)]
    assert all(len(t) <= 200 for i, t, _ in rows if 100 <= i < 300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    texts, counts = languages.sample(docs)
    assert counts == {"en": 12, "de": 17, "fr": 30} and {x: len(t) for x, t in texts.items()} == {"en": 12, "de": 12, "fr": 30}
    got = {(r.doc_id, r.segment): r.lang for r in languages.identify(docs).collect()}
    assert got[300, 0] == "fr" and all(got[i, 0] == "fr" for i in range(100, 130))


def test_on_spark(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, x), label) for i, (x, label) in enumerate((x, rng.choice([x, x.upper(), f" {x}-XX"])) for x in WORDS for _ in range(12))]
    rows += [(900, text(rng, "fr"), "en"), (901, text(rng, "de"), None), (902, None, "en"), (903, " ", "de"), (None, text(rng, "en"), "en"), (900, text(rng, "fr"), "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, segment int")
    got = [tuple(r)[:4] for r in languages.identify(docs).collect()]
    assert got.count((900, "en", 0, "fr")) == 2 and (901, None, 0, "de") in got and not [g for g in got if g[0] in (902, 903)]
    assert all(g[3] == g[1].strip().lower()[:2] for g in got if g[0] is not None and g[0] < 900) and len(got) == len(rows) - 2
    assert languages.identify(docs.limit(0)).collect() == []
    assert languages.identify(docs.where("lang is null")).collect() == []
