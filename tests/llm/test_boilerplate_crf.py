from __future__ import annotations

import itertools
import re

import numpy as np

from noisefleet.llm import boilerplate_crf as b


def test_decoding_against_every_labelling():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 9):
        m = b.Field(rng.normal(size=4), rng.normal(size=(2, 2)))
        x = rng.integers(0, 2, (n, 4)).astype(float)
        score = lambda y: sum(y * (x @ m.emit)) + sum(m.move[p, q] for p, q in zip(y, y[1:]))
        best = max((np.array(y) for y in itertools.product((0, 1), repeat=n)), key=score)
        assert np.isclose(score(best), score(m.decode(x)))


def test_gradient_against_differences():
    rng = np.random.default_rng(7)
    x, y, w = rng.integers(0, 2, (6, 4, 3)).astype(float), np.array([0, 1, 1, 0, 1, 0]), rng.random(6)
    theta = rng.normal(size=7)

    def likelihood(t):
        emit, move, total = t[:3], t[3:].reshape(2, 2), 0.0
        for seq, label, weight in zip(x, y, w):
            value = lambda z: sum(np.array(z) * (seq @ emit)) + sum(move[p, q] for p, q in zip(z, z[1:]))  # noqa: B023, E731
            total += weight * (value([label] * 4) - np.log(sum(np.exp(value(z)) for z in itertools.product((0, 1), repeat=4))))
        return total

    step = 1e-6 * np.eye(7)
    want = [(likelihood(theta + s) - likelihood(theta - s)) / 2e-6 for s in step]
    assert np.allclose(b._gradient(x, y, theta, w), want, atol=1e-5)


def brute_repeats(words, window=3):
    grams = [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(window)})


def test_repeated_words_against_counting():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 3, 4, 30, 120):
        words = [f"w{v}".encode() for v in rng.integers(0, 5, n)]
        assert b.repeated_words(words) == brute_repeats(words)


def test_base_counts():
    text = "a# b\n\n a# b\na# b\nété x | c"
    lines, by_line = b.split_text(text)
    words = [w for ws in by_line for w in ws]
    assert [w.decode() for w in words] == re.findall(r"[^\x20\x09-\x0D]+", text)
    assert b.base_counts(text, lines, words) == (9, 9 + 7, 4, 1, 6)


def test_field_tells_lines_apart(spark, docs):
    good = "\n".join("some plain words that make a proper sentence of prose." for _ in range(3))
    junk = "\n".join("BUY!! NOW!! CHEAP!! DEAL!! HERE!!" for _ in range(3))
    df = docs(*[(i, good if i % 2 else junk) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    model = b.train(df, labels)
    prose = "\n".join(" ".join(f"{w}{i}"[::-1].strip("0123456789") + "abcdefghi"[i] for w in "some lines say what no other line has".split()) + "." for i in range(9))
    got = {r.doc_id: r for r in b.judge(docs((1, prose), (2, prose.upper().replace(" ", "!! ")), (3, prose + "\n" + junk)), model).collect()}
    assert got[1].kept and not got[2].kept and got[1].content_share == 1.0 and 0.5 < got[3].content_share < 1


def test_awkward_rows(spark, awkward, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = b.train(awkward, none)
    got = b.judge(awkward, model).collect()
    assert len(got) == awkward.count()
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in got if r.doc_id in (2, 3, 4))
    by = {r.doc_id: r for r in got}
    assert by[10].base_failed and by[10].n_dup_lines == 39 and by[6].n_words == by[9].n_words > 100000 and by[6].kept == by[9].kept
    assert b.judge(docs().where("false"), model).count() == 0
