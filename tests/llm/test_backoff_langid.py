from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from noisefleet.llm import backoff_langid
from noisefleet.llm.common import table

SYLLABLES = {"aa": ["lo", "mi", "ka", "tu"], "bb": ["strö", "gen", "ach", "ung"], "cc": ["été", "eau", "oi", "que"]}


def corpus(n, seed=3):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        yield i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))).title() for _ in range(rng.randrange(1, 30))), lang


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, lang string, score int, lang_pred string").repartition(3)


def pieces(word, n):
    return list(word) if n == 1 else [f" {word} "[j:j + n] for j in range(len(word) + 3 - n)]


def slow(rows, text):
    """The method, without tables or caches."""
    kinds = [defaultdict(Counter) for _ in range(backoff_langid.LONGEST + 1)]
    for i, t, lang in rows:
        if i is None or lang is None or zlib.crc32(str(i).encode()) % 5 == 0:
            continue
        for w in backoff_langid.words_of(t):
            kinds[0][lang][w] += 1
            for n in range(1, backoff_langid.LONGEST + 1):
                kinds[n][lang].update(pieces(w, n))
    langs = sorted(kinds[0])

    def log(n, lang, entry):
        most = max(len(kinds[n][x]) for x in langs)
        return math.log(kinds[n][lang][entry] + backoff_langid.PLUS) - math.log(sum(kinds[n][lang].values()) + backoff_langid.PLUS * most)
    total, known = dict.fromkeys(langs, 0.0), 0
    words = backoff_langid.words_of(text)
    for w in words:
        for n, tried in [(0, [w])] + [(n, pieces(w, n)) for n in range(backoff_langid.LONGEST, 0, -1)]:
            found = [g for g in tried if any(kinds[n][x][g] for x in langs)]
            if found:
                known += 1
                for x in langs:
                    total[x] += sum(log(n, x, g) for g in found) / len(found)
                break
    if not words:
        return "und", 0.0
    odds = {x: math.exp((total[x] - max(total.values())) / known * min(known, backoff_langid.EVIDENCE)) for x in langs}
    best = max(langs, key=lambda x: odds[x])
    return best, odds[best] / sum(odds.values())


def test_like_the_plain_method(spark):
    rows = list(corpus(120)) + [(1000, "Loxx strölo zz été9mi", None), (1001, "", "aa"), (1002, None, "aa"), (1003, "12 + 34 = ²", "bb")]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in backoff_langid.predict(df, backoff_langid.train(df)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        lang, score = slow(rows, text)
        assert (got[i].lang_pred, got[i].held_out) == (lang, zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].score == pytest.approx(score, abs=1e-9)


def test_unseen_words_fall_back(spark):
    df = frame(spark, list(corpus(200)))
    model = backoff_langid.train(df)
    new = frame(spark, [(1, "lomikatulomika", None), (2, "genungachgenströ", None), (3, "queeauoiété", None), (4, "語語", None)])
    got = {r.doc_id: r for r in backoff_langid.predict(new, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["aa", "bb", "cc"]
    assert got[4].lang_pred in SYLLABLES and got[4].score == pytest.approx(1 / 3)


def test_a_small_model_still_decides(spark, monkeypatch):
    monkeypatch.setattr(backoff_langid, "ENTRIES", 60)
    rows = list(corpus(200))
    df = frame(spark, rows)
    model = backoff_langid.train(df)
    assert sum(map(len, model.at.values())) <= 100
    right = {i: lang for i, _, lang in rows}
    got = backoff_langid.predict(df, model).where("held_out").collect()
    assert sum(r.lang_pred == right[r.doc_id] for r in got) >= 0.9 * len(got)


def test_awkward_rows(awkward):
    model = backoff_langid.train(awkward)
    got = backoff_langid.predict(awkward, model).collect()
    assert len(got) == awkward.count()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {2: "und", 3: "und", 4: "und"}
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert backoff_langid.predict(awkward.limit(0), model).count() == 0
    none = backoff_langid.train(awkward.limit(0))
    assert {r.lang_pred for r in backoff_langid.predict(awkward, none).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = backoff_langid.predict(docs, backoff_langid.train(docs), ["doc_id", "lang"]).where("held_out and lang is not null and lang_pred <> 'und'")
    rows = got.collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
