from __future__ import annotations

import itertools

from noisefleet.llm import license_scan as s

APACHE = s.NOTICES["Apache-2.0"][1]


def dice(a: str, b: str) -> float:
    grams = [{x for x in zip(w, w[1:])} for w in map(s.normal_words, (a, b))]
    return 2 * len(grams[0] & grams[1]) / max(1, sum(map(len, grams)))


def found(df):
    return {(r.doc_id, r.license_id): (round(r.score, 9), r.n_units) for r in s.scan(df).collect()}


def test_notices_on_a_line_over_lines_and_as_the_text(docs):
    half = APACHE[:200] + "\n" + APACHE[200:]
    got = found(docs((1, "prose before\nReleased under the MIT License.\nprose after"), (2, "prose\n\n" + half + "\n\nmore"), (3, half), (4, "the license of a bridge")))
    assert set(got) == {(1, "MIT"), (2, "Apache-2.0"), (3, "Apache-2.0")} and all(v[0] > 0.95 for v in got.values())


def test_against_all_templates_without_pruning(docs):
    words = s.normal_words(" ".join(s.NOTICES["GPL-3.0"] + s.NOTICES["MIT"]))
    texts = [" ".join(words[i:i + n]) for i, n in itertools.product(range(0, 90, 7), (4, 5, 8, 11, 14, 30, 45))]
    want = set()
    for i, text in enumerate(texts):
        best = max(((dice(text, t), name) for name, ts in s.NOTICES.items() for t in ts), key=lambda x: x[0])
        if best[0] >= s.LEAST:
            want.add((i, best[1]))
    assert {k for k in found(docs(*enumerate(texts)))} == want and want


def test_anchors_hold_for_every_match():
    for name, grams in s.template_bigrams():
        anchors = set(s.anchor_words([(name, grams)], s.LEAST))
        spared = len(grams) - sum(not set(g.split()) & anchors for g in grams)
        assert spared >= 1


def test_awkward_rows(awkward, docs):
    assert s.scan(awkward).count() == 0 and s.scan(docs().where("false")).count() == 0
    assert found(docs((1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "released UNDER the mit license"))) == {
        (1, "MIT"): (1.0, 2), (None, "MIT"): (1.0, 1)}
