from __future__ import annotations

import difflib
import random

from noisefleet.llm import line_dedup as d

LONG = [" ".join(f"w{i}x{k}" for k in range(25)) for i in range(12)]


def texts(df):
    return {r.doc_id: (r.text, r.lines_removed) for r in d.dedup_lines(df).collect()}


def test_patience_matches_are_common_subsequences():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        got = d.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_patience_finds_all_where_lines_are_unique_and_in_order():
    rng = random.Random(2)
    for _ in range(50):
        a, b = (sorted(rng.sample(range(40), 20)) for _ in range(2))
        want = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert len(d.patience(a, b)) == len(set(a) & set(b)) >= want


def test_block_goes_from_the_later_document_only(docs):
    got = texts(docs((5, "\n".join(["own five", LONG[0], LONG[1], "end five"])), (3, "\n".join([LONG[0], "", LONG[1]])), (9, LONG[2])))
    assert got == {3: ("\n".join([LONG[0], "", LONG[1]]), 0), 5: ("own five\nend five", 2), 9: (LONG[2], 0)}


def test_short_common_lines_stay_but_count_inside_blocks(docs):
    got = texts(docs((1, "Hello.\n" + LONG[0]), (2, "Hello.\n" + LONG[0]), (3, "Hello.\nother words here")))
    assert got[2] == ("", 2) and got[3] == ("Hello.\nother words here", 0)


def test_block_first_seen_in_pieces_is_found_through_the_holder_before(docs):
    a, b = " ".join(f"a{k}" for k in range(12)), " ".join(f"b{k}" for k in range(12))
    got = texts(docs((1, a), (2, b), (3, f"{a}\n{b}"), (4, f"x\n{a}\n{b}")))
    assert got[3] == (f"{a}\n{b}", 0) and got[4] == ("x", 2)


def test_against_all_pairs(docs):
    rng = random.Random(3)
    key = lambda t: [(k, k, s, len(s.split())) for k, s in enumerate(t.split("\n"))]

    def gone(rows):
        return {i: {n for _, u in rows[:i] for n in d.common_lines(key(u), key(t))} for i, t in rows}

    # in one order everywhere: each line stays with its first holder only, as comparing all pairs has it
    some = [(i, [LONG[k] for k in sorted(rng.sample(range(12), 4))]) for i in range(40)]
    rows = [(i, "\n".join(x for k, s in enumerate(lines) for x in (f"own {i} {k}", s))) for i, lines in some]
    got, want = texts(docs(*rows)), gone(rows)
    assert {i: v[0] for i, v in got.items()} == {i: "\n".join(s for n, s in enumerate(t.split("\n")) if n not in want[i]) for i, t in rows}
    # in any order: what goes is some earlier document's, and no line is lost
    rows = [(i, "\n".join(rng.choice(LONG) if rng.random() < 0.4 else f"own {i} line {k}" for k in range(8))) for i in range(40)]
    got = texts(docs(*rows))
    for i, t in rows:
        earlier = {s for _, u in rows[:i] for s in u.split("\n")}
        assert all(s in got[i][0].split("\n") for s in t.split("\n") if s not in earlier)
    assert {s for _, t in rows for s in t.split("\n")} == {s for v in got.values() for s in v[0].split("\n") if s}


def test_awkward_rows(awkward, docs):
    got = d.dedup_lines(awkward)
    assert got.columns == [*awkward.columns, "lines_removed"] and got.count() == awkward.count()
    by = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    assert by[1].text and by[2].text is None and by[3].text == "" and by[4].text == " \n\t\n "
    assert by[6].lines_removed == 0 and by[9].text == "" and by[9].lines_removed == 6000 and by[9].n_chars == 0
    assert d.dedup_lines(docs().where("false")).count() == 0


def test_common_passage_in_very_many_documents(docs):
    got = texts(docs(*[(i, f"start {i}\n{LONG[3]}\n{LONG[4]}\nend {i}") for i in range(300)]))
    assert sum(v[1] == 2 for v in got.values()) == 299 and got[0][1] == 0


def test_passage_in_very_many_documents_whose_first_holder_has_its_lines_apart(docs):
    four = [" ".join(f"p{i}x{k}" for k in range(15)) for i in range(4)]
    rows = [(0, "\n".join(x for i, s in enumerate(four) for x in (s, f"own zero {i}")))]
    rows += [(i, "\n".join([f"start {i}", *four, f"end {i}"])) for i in range(1, 100)]
    got = texts(docs(*rows))
    assert got[0] == (rows[0][1], 0) and got[1] == (rows[1][1], 0)
    assert all(got[i] == (f"start {i}\nend {i}", 4) for i in range(2, 100))


def test_runs_against_all_pairs_with_over_64_holders(docs):
    rng = random.Random(4)
    short = [" ".join(f"s{i}x{k}" for k in range(rng.choice([3, 7, 12]))) for i in range(12)]
    key = lambda t: [(k, k, s, len(s.split())) for k, s in enumerate(t.split("\n"))]
    rows = []
    for i in range(150):
        a = rng.randrange(9)
        held = short[a:a + rng.randrange(2, 9)] if i % 3 else [x for k, s in enumerate(short) for x in (s, f"own {i} {k}")]
        rows.append((i, "\n".join([f"start {i}", *held, f"end {i}"])))
    want = {i: {n for _, u in rows[:i] for n in d.common_lines(key(u), key(t))} for i, t in rows}
    got = texts(docs(*rows))
    assert {i: v[0] for i, v in got.items()} == {i: "\n".join(s for n, s in enumerate(t.split("\n")) if n not in want[i]) for i, t in rows}


def test_a_pair_is_aligned_once(docs):
    # a second evaluation in the plan takes a second Python worker for each task
    gone = d.repeated_lines(docs((1, LONG[0]), (2, LONG[0])))
    assert gone._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.id, r.gone) for r in gone.collect()] == [(2, [0])]


def test_lists_of_lines_reach_python_in_small_batches(spark, docs, monkeypatch):
    option, seen, store = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, d.stored
    before = spark.conf.get(option)

    def watched(df, name):
        seen[name] = int(spark.conf.get(option))
        return store(df, name)
    monkeypatch.setattr(d, "stored", watched)
    assert texts(docs((1, LONG[0]), (2, LONG[0]), (3, LONG[1]))) == {1: (LONG[0], 0), 2: ("", 1), 3: (LONG[1], 0)}
    assert seen["line-runs"] <= 1000 and seen["gone-lines"] <= 1000
    assert spark.conf.get(option) == before
