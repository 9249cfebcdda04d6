from __future__ import annotations

import pytest

PLAIN = "The quick brown fox jumps over the lazy dog and runs far away from here."
# names that operators use inside
CLASHING = ("row", "size", "id", "fp", "key", "hash", "words", "text_hash", "order", "name", "gone", "score", "root")


@pytest.fixture(scope="session")
def docs(spark):
    """A small documents table from (doc_id, text[, source]) with further columns of clashing names."""
    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *([1] * len(CLASHING))) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                     + ", ".join(f"`{c}` int" for c in CLASHING)).coalesce(2)
    return make


@pytest.fixture(scope="session")
def awkward(docs):
    """Nulls in every column, empty and blank texts, one word, a very long text, repeated rows, odd characters."""
    long_text = "\n".join(f"{PLAIN} Line {i % 997} of a long text says number {i * i}." for i in range(6000))
    return docs((1, PLAIN), (1, PLAIN), (2, None), (None, PLAIN + " More."), (3, ""), (4, " \n\t\n "), (5, "word"), (6, long_text, None),
                (7, "a\x00b ▁ c d \U0001f600"), (8, PLAIN, None), (None, None, None), (9, long_text), (10, "\n".join([PLAIN] * 40)))
