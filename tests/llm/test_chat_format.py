from __future__ import annotations

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from noisefleet.llm import chat_format as c

CONTROL = c.INSTRUCT.control


def read(df):
    made = c.format_chat(df)
    return {r.conv_id: r for r in made.select("*", c.parse_chat(F.col("formatted")).alias("turns"), c.loss_text(F.col("segments")).alias("loss")).collect()}


def test_escaping_is_reversible_and_leaves_no_mark(spark):
    rng = random.Random(9)
    parts = [*CONTROL, "\\", "[", "<", "]", "INST]", "s>", " ", "a", "[\\INST]", "<\\\\/s>", "$1", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", c.escaped(F.col("t")).alias("e")).select("t", "e", c.unescaped(F.col("e")).alias("b"))
    for r in df.collect():
        assert r.b == r.t and not any(m in r.e for m in CONTROL)


def test_round_trip_and_loss(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "user", ""), (1, 3, "assistant", "<"), (2, 0, "tool [/ROLE] ", "x"), (2, 1, None, None),
            (3, 0, "assistant", "alone"), (4, 0, "system", " lead"), (4, 1, "user", "u "), (4, 2, "assistant", "[SYS] a")]
    got = read(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()} == {
        i: [(r or "", t or "") for j, _, r, t in rows if j == i] for i in (1, 2, 3, 4)}
    assert {k: r.loss for k, r in got.items()} == {1: odd + "<", 2: "", 3: "alone", 4: "[SYS] a"}
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True}
    assert all("".join(s.text for s in r.segments) == r.formatted for r in got.values())


@pytest.mark.parametrize("roles, state", [("ua", "answered"), ("sua", "answered"), ("u", "asked"), ("uu", "broken"), ("a", "broken"), ("uas", "broken"),
                                          ("uaua", "answered"), ("", "start"), ("su", "asked"), ("s", "briefed"), ("uuua", "broken")])
def test_machine(spark, roles, state):
    names = [{"u": "user", "a": "assistant", "s": "system"}[r] for r in roles]
    got = spark.range(1).select(c.end_state(F.array(*map(F.lit, names)).cast("array<string>"))).first()[0]
    assert got == state


def test_templates_that_could_be_misread_are_refused():
    for change in ({"control": ("[A]", "A]")}, {"control": ("x",)}, {"other": c.Marks("[INST] ", " </s>")}, {"other": c.Marks("[ROLE] ", "end")}):
        with pytest.raises(ValueError):
            dataclasses.replace(c.INSTRUCT, **change)


def test_awkward_rows(spark):
    rows = [(None, None, None, None, 1), (1, 1, "user", "b", 1), (1, 1, "user", "b", 1), (1, None, "user", "first", 1), (2, 0, "user", "x " * 100000, 1)]
    got = read(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns int"))
    assert [t.text for t in got[1].turns] == ["first", "b", "b"] and [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert len(got[2].turns[0].text) == 200000
    assert c.format_chat(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
