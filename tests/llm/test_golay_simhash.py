from __future__ import annotations

import itertools
import random

import numpy as np
import xxhash

from noisefleet.llm import golay_simhash as g


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [words[i:i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable by links of 3 bits or fewer, by comparing all pairs."""
    root = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 3 and root[i] != root[j]:
            old, new = root[j], root[i]
            root = [new if r == old else r for r in root]
    return {i: min(p[0] for p, r in zip(prints, root) if r == root[k]) for k, (i, _) in enumerate(prints)}


def test_fingerprints():
    for t in (None, "", " ", "A b", "one", "x y z", "The cat SAT on the mat ÉTÉ the cat sat", "a b c d e\x0bf"):
        assert g.fingerprint_of(t) == plain_fingerprint(t)


def test_golay_tables_hold_every_codeword_near():
    nearest, keys = g.golay_tables()
    rng = random.Random(10)
    words = [0]
    for i in range(g.DATA):
        words += [w ^ (g.GENERATOR << i) for w in words]
    assert len(set(words)) == 4096 and all(g._syndrome_of(w) == 0 for w in words)
    for _ in range(30):
        x = rng.randrange(1 << 23)
        s = g._syndrome_of(x)
        near = sorted((x ^ w).bit_count() for w in words)
        assert (x ^ int(nearest[s]) in words) and int(nearest[s]).bit_count() == near[0] <= 3
        want = {w for w in words if (x ^ w).bit_count() <= 4} if near[0] == 3 else {min(words, key=lambda w: (x ^ w).bit_count())}
        assert {x ^ int(p) for p in keys[s]} == want


def test_linked_prints_share_a_key():
    rng = np.random.default_rng(11)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
    k = g.Keys()
    (filed, sought), (filed_y, sought_y) = k.of(x), k.of(y)
    for a, b in ((filed, sought_y), (filed_y, sought)):
        assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist()))


def test_components_against_all_pairs(spark):
    rng = random.Random(12)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):  # dense balls and chains
        p = rng.choice(prints[:3] + prints[-40:])
        for _ in range(rng.randrange(1, 6)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    prints = sorted(set(prints))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    got = {r.fp: r.root for r in g.print_components(df).collect()}
    want = plain_components([(signed(p), p) for p in prints])
    assert {p: got.get(p, p) for p in want} == want


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in g.components(links, "chain").collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_awkward_rows(awkward, docs):
    got = g.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got}
    assert by[2].fp == by[3].fp == by[4].fp == 0 and by[2].component_id == by[4].component_id == 2
    assert by[8].component_id == 1 and by[9].component_id == 6
    kept = g.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5, 6, 7, 10] or by[10].component_id == 1
    assert g.near_duplicates(docs().where("false")).count() == 0 and g.keep_one(docs().where("false")).count() == 0
    assert g.keep_one(docs((None, "a b c d"), (None, "a b c d"), (None, None))).count() == 2


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in g.near_duplicates(docs).collect()} == want


def test_keep_one_finds_every_copy_of_similarity_080_and_no_other(docs):
    rng = random.Random(8)
    rows, want = [], set()
    for i in range(0, 400, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        copy = list(words)
        for at in rng.sample(range(0, 200, 6), rng.randrange(1, 9)):
            copy[at] = "changed"
        rows += [(i, " ".join(words)), (i + 1, " ".join(copy))]
        a, b = ({tuple(w[k:k + 5]) for k in range(196)} for w in (words, copy))
        want |= {i} if len(a & b) / len(a | b) >= 0.8 else {i, i + 1}
    assert 220 < len(want) < 380 and {r.doc_id for r in g.keep_one(docs(*rows)).collect()} == want


def templated(rng, n):
    """Texts from one template, each with a few words changed to others of a small list, so that most are less than 0.8 alike."""
    base, other = [f"t{rng.randrange(10**6)}" for _ in range(150)], [f"o{i}" for i in range(12)]
    texts = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 14)):
            words[at] = rng.choice(other)
        texts.append(" ".join(words))
    return texts


def test_rare_keys_meet_every_similar_pair(spark):
    texts = templated(random.Random(3), 120)
    sets = [np.unique(g.shingle_hashes(t, 5)) for t in texts]
    nodes = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(sets)], "node bigint, size bigint, part bigint")
    rare = g.rare_keys(nodes, spark.createDataFrame(list(enumerate(texts)), "node bigint, text string"), 5, 0.8)
    by: dict = {}
    for r in rare.collect():
        by.setdefault(r.key, []).append(r)
    met = {(a.node, b.node) for rows in by.values() for a in rows for b in rows if a.node < b.node
           and min(a.tail, b.tail) >= (a.size + b.size) * 0.8 / 1.8 - 1e-6}
    want = {(i, j) for j in range(120) for i in range(j) if g.similarity_of(sets[i], sets[j]) >= 0.8}
    assert len(want) > 100 and want <= met and len(met) < 0.5 * 120 * 119 / 2


def test_keep_one_in_a_group_that_shares_most_words(docs):
    """Components of a group in which every pair shares keys, against all pairs."""
    texts = templated(random.Random(5), 250)
    sets = [np.unique(g.shingle_hashes(t, 5)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for j in range(len(texts)):
        for i in range(j):
            if g.similarity_of(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {find(i) for i in range(len(texts))}
    assert 20 < len(want) < 230
    assert {r.doc_id for r in g.keep_one(docs(*enumerate(texts))).collect()} == want


def test_texts_reach_python_in_small_batches(spark, docs, monkeypatch):
    option, seen, store = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, g.stored
    before = spark.conf.get(option)

    def watched(df, name):
        seen[name] = int(spark.conf.get(option))
        return store(df, name)
    monkeypatch.setattr(g, "stored", watched)
    one = " ".join(f"word{i}" for i in range(60))
    assert sorted(r["doc_id"] for r in g.keep_one(docs((1, one), (2, one + " more"), (3, "other"))).collect()) == [1, 3]
    # of what holds texts, both sides of a pair, or their shingles
    assert all(seen[name] <= 1000 for name in ("near-sketches", "near-shingles", "near-pairs", "near-stars", "near-links"))
    assert spark.conf.get(option) == before
