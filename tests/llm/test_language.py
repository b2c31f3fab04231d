import random

import numpy as np
import pytest

from adjudica.llm import language

SYLLABLES = {"aa": "ba la ma na ra ta".split(), "ee": "skr vlo grü chze pfi ndö".split(), "oo": "wxo qyu jho zzu kko vvo".split()}


def text(lang, seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def prototypes(frame):
    rows = [(i, text(lang, i), lang) for i, lang in enumerate(sorted(SYLLABLES) * 20)]
    return language.learn(frame(rows + [(900, None, "aa"), (901, "1 2", "aa"), (902, "x", None), (None, "y", "ee")]))


def test_held_out_texts(frame, prototypes):
    rows = [(i, text(lang, 1000 + i), lang) for i, lang in enumerate(sorted(SYLLABLES) * 20)]
    got = {r.doc_id: r for r in language.identify(frame(rows), prototypes).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(frame, prototypes):
    rows = [(1, None), (2, ""), (3, "12 !? 3"), (4, "skr" * 200_000), (5, "b"), (None, "vlo grü"), (5, "b")]
    got = language.identify(frame(rows), prototypes).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[4].lang_pred == "ee" and by[5].lang_pred != "und"
    kept = language.keep_identified(frame(rows), prototypes)
    assert kept.columns == frame(rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "5", "None"]
    assert {r.lang for r in kept.collect() if r.doc_id == 4} == {"ee"}
    assert [r.doc_id for r in language.keep_identified(frame(rows), prototypes, wanted=["ee"]).where("doc_id = 4").collect()] == [4]
    assert language.keep_identified(frame(rows), prototypes, wanted=[]).count() == 0
    assert language.identify(frame([]), prototypes).count() == 0


def test_nothing_learned(frame):
    none = language.learn(frame([(1, "abc", None)]))
    assert none == {}
    assert language.identify(frame([(1, "abc")]), none).first().lang_pred == "und"
    assert language.keep_identified(frame([(1, "abc")]), none).count() == 0
    one = language.learn(frame([(1, "abc", "xx")]))
    assert language.identify(frame([(1, "abc")]), one).first().lang_pred == "xx"


def test_vectors_match_plain_binding():
    dims = 256
    for sample in ("ab abc", "Été, ça", "日本語 text"):
        vector = np.zeros(dims)
        for word in "".join(c if c.isalpha() else " " for c in sample.lower()).split():
            padded = [None, *word, None]
            for a, b, c in zip(padded, padded[1:], padded[2:]):
                v = [np.ones(dims, np.int8) if x is None else language.letter_vector(ord(x), dims) for x in (a, b, c)]
                vector += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        assert np.array_equal(language.text_vectors(["", sample, "x"], dims)[1], vector)


def test_each_text_is_asked_once(frame):
    prototypes = {"a": np.ones(64), "b": -np.ones(64)}
    for wanted in (None, ["a"]):
        kept = language.keep_identified(frame([(1, "abc")]), prototypes, wanted=wanted)
        assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
