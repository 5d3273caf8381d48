import random

import numpy as np

from sparkloom.llm import truncation

R = random.Random(7)
NOUNS = [f"{a}{b}" for a in ("dock", "lamp", "reed", "mast", "rope", "sand") for b in ("er", "let", "ing", "or", "y", "ful")]
FORMS = ["The {} reads every {} before the {} is closed.", "If a {} is missing, the {} falls back to the {}.", "Nothing in the {} depends on the {} or the {}.", "Each {} writes one {} and reports its {} in bytes."]


def text(n):
    return " ".join(R.choice(FORMS).format(*R.choices(NOUNS, k=3)) for _ in range(n))


def corpus():
    rows, cut = [], set()
    for i in range(1500):
        t = text(R.randrange(3, 9))
        if i % 15 == 0:
            t = t[: R.randrange(60, len(t) - 12)].rstrip()
            if t.endswith("."):
                t = t[:-6].rstrip()
            cut.add(i)
        source = ("web", "mail")[i % 2]
        if i % 25 == 3:
            t = (t + " " + text(6))[:300] + "…" if not i % 2 else t
            if t.endswith("…"):
                if t[-2] in ". ":
                    t = t[:-3] + "…"
                cut.add(i)
        rows.append((i, t, "en" if i % 7 else None, source, "x", 1))
    rows += [(2000, None, "en", "web", "x", 1), (2001, "", "en", "web", "x", 1), (2002, " \n\t", "EN", None, "x", 1), (2003, rows[15][1], "en", None, "x", 1), (2004, text(3) + "\r\n", None, None, "x", 1), (2005, text(4000), "en", "web", "x", 1), (2006, "a" * 20_000, "en", "web", "x", 1)]
    cut.add(2003)
    return rows, cut


SCHEMA = "doc_id long, text string, lang string, source string, context string, same long"


def test_held_out_cuts_are_found(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    found = truncation.truncated(df)
    got = {r["doc_id"] for r in found.collect()} - {2006}
    hit = len(got & cut)
    assert hit / len(cut) > 0.8 and hit / max(1, len(got)) > 0.7
    assert {15, 2003} <= got or not {15, 2003} & got
    rates = {r["source"]: (r["documents"], r["truncated"]) for r in truncation.rates(df, found).collect()}
    assert set(rates) == {"web", "mail", None} and rates[None][0] == 3


def test_empty_and_blank(spark):
    assert truncation.truncated(spark.createDataFrame([], SCHEMA)).count() == 0
    assert truncation.truncated(spark.createDataFrame([(1, " ", None, None, "x", 1), (2, None, None, None, "x", 1)], SCHEMA)).count() == 0


def test_classes_do_not_depend_on_size(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    filler = [word() for _ in range(800)]
    rows = ["gamma alpha beta"] * 40 + [f"{word()} alpha {word()}" for _ in range(14)] + [" ".join(r.choices(filler, k=200)) for _ in range(120)]
    number = truncation._Numbers()

    def classes(texts):
        words, phrase = truncation.vocabulary(truncation.tokenised(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string")))
        return dict(zip(words.tolist(), phrase.tolist()))

    one, ten = classes(rows), classes(rows * 10)
    assert one[number["alpha"]] and ten[number["alpha"]]
    kept = [number[w] for w in filler if number[w] in one and number[w] in ten]
    assert len(kept) > 700 and not any(one[w] or ten[w] for w in kept)


def test_contexts_before_the_end_are_those_of_the_places():
    r = np.random.default_rng(3)
    texts = [r.integers(0, 9, n) for n in (1, 3, 40, 300)]
    for raw, depths in ((False, range(1, truncation.DEPTH + 1)), (True, truncation.RAW)):
        each, follow = truncation.contexts(texts, depths, raw)
        at = np.flatnonzero(follow == 2)
        tails = np.full((len(texts), max(depths)), truncation.PAD)
        for i, t in enumerate(texts):
            tails[i, -min(len(t), max(depths)) :] = t[-max(depths) :]
        assert (np.stack([h[at] for h in each], axis=1) == truncation.last_contexts(tails, depths, raw)).all()


def test_signs_are_weighed_by_what_the_data_tell(spark):
    r = random.Random(5)
    rows = []
    for i in range(4000):
        cut = i % 10 == 0
        rows.append((i, "s", "en", r.lognormvariate(2.5 if cut else -2.5, 1.0), r.random() < (0.4 if cut else 0.001), False, r.random() < 0.1, r.random() < (0.3 if cut else 0.01)))
    schema = "doc_id int, source string, lang string, ratio double, mark boolean, broken boolean, fence boolean, pile boolean"
    share, weights = truncation.fitted(spark.createDataFrame(rows, schema))["s", "en"]
    assert weights["mark"][0] > 4 and weights["pile"][0] > 2.5 and abs(weights["fence"][0]) < 0.5 and abs(share - 0.1) < 0.05
    assert weights["mark"][1] < 0 and truncation.fitted(spark.createDataFrame([], schema)) == {}


def test_marks_after_common_words_stay_marks(spark):
    r = random.Random(11)

    def some(n):
        return " ".join(r.choice(FORMS).format(*r.choices(NOUNS, k=3)) for _ in range(n))

    rows, cut, phrase = [], set(), set()
    for i in range(3000):
        t, source = some(4), ("snippets", "issues")[i % 2]
        if i % 2 == 0 and i % 16 == 0:
            words = some(6).split()
            t = " ".join(words[: r.randrange(25, 45)]).rstrip(".")
            t += ("...", " [truncated]")[i % 32 == 0]
            cut.add(i)
        elif i % 20 == 1:
            t += f"\n\nStill waiting for the {r.choice(NOUNS[:3])}..."
            phrase.add(i)
        rows.append((i, t, "en", source, "x", 1))
    got = {x["doc_id"] for x in truncation.truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got & cut) > 0.9 * len(cut) and len(got & phrase) < 0.1 * len(phrase)


def test_cuts_without_the_sign_of_their_source(spark, monkeypatch):
    schema = "doc_id int, source string, lang string, ratio double, mark boolean, broken boolean, fence boolean, pile boolean"
    rows = [(i, "s", "en", 50.0 if i % 10 == 0 else 0.02, False, False, False, i % 10 == 0) for i in range(4000)] + [(9000, "s", "en", 50.0, False, False, False, False)]
    monkeypatch.setattr(truncation, "scored", lambda *_: spark.createDataFrame(rows, schema))
    got = {r["doc_id"] for r in truncation.truncated(spark.createDataFrame([], SCHEMA)).collect()}
    assert got == {i for i in range(0, 4000, 10)} | {9000}
