"""Language identification, words first, backing off to ever shorter character n-grams.

A known word scores by its log frequency in each language. An unseen word scores by its n-grams of the
greatest length of which any is known: the mean of their log frequencies. A text's languages compete by the
mean over its words.

Counts are taken over every learning document: batches count for themselves, and their counts are summed by
(language, word). n-grams are counted from the word counts, so text is read once. The model holds the most
frequent words and n-grams of each language, about ``ENTRIES`` in all, with their counts in every language; it alone
reaches the driver and, in a closure, the tasks.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; one of which nothing is known
gets the language with the most words, all scores being equal; equal scores go to the first language by code
point; rows of null doc_id are not held out and not learned from; with no language to learn all are ``und``;
repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefleet.llm.common import stored

# Longest n-grams; entries of the model; count added to every entry; words of a text that count as independent evidence.
LONGEST, ENTRIES, PLUS, EVIDENCE = 4, 400_000, 0.1, 10
# A run of letters without a break is read in pieces of this length; unseen words whose scores a task holds.
PIECE, HELD = 32, 300_000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]{1,%d}" % PIECE)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str | None) -> list[str]:
    """Words in lower case; none where the text has no letter."""
    words = WORD.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of a word between blanks, in order; letters by themselves stand without the blanks."""
    padded = f" {word} " if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies: ``at[n]`` maps the words (n = 0) or n-grams to their row of ``logs``, which has a column per language."""

    def __init__(self, langs: Sequence[str], words: Sequence[int], at: dict[int, dict[str, int]], logs: np.ndarray) -> None:
        self.langs, self.at, self.logs = list(langs), at, logs
        self.commonest = int(np.argmax(words)) if len(langs) else -1

    def rows_of(self, word: str) -> list[int]:
        """Rows whose mean is the word's score; none if nothing of it is known."""
        known = self.at[0].get(word)
        if known is not None:
            return [known]
        for n in range(LONGEST, 0, -1):
            found = list(filter(None, map(self.at[n].get, grams_of(word, n))))
            if found:
                return found
        return []

    def decide(self, total: np.ndarray, n: int, known: int) -> tuple[str, float]:
        """Language and probability from the sum of the scores of ``known`` of a text's ``n`` words."""
        if not n or not self.langs:
            return UNKNOWN, 0.0
        if not known:
            return self.langs[self.commonest], 1.0 / len(self.langs)
        odds = total / known * min(known, EVIDENCE)
        odds = np.exp(odds - odds.max())
        best = int(np.argmax(odds))
        return self.langs[best], float(odds[best] / odds.sum())


class Scorer:
    """Scores of the words met so far, a row each; row 0 stands for words of which nothing is known."""

    def __init__(self, model: Model) -> None:
        self.model, self.width = model, len(model.langs)
        self.start()

    def start(self) -> None:
        self.at: dict[str, int] = {}
        self.rows, self.used = np.zeros((4096, self.width)), 1

    def meet(self, words: list[str]) -> None:
        found = [self.model.rows_of(w) for w in words]
        known = [(w, f) for w, f in zip(words, found) if f]
        self.at.update((w, 0) for w, f in zip(words, found) if not f)
        if not known:
            return
        sizes = np.array([len(f) for _, f in known])
        sums = np.add.reduceat(self.model.logs[np.concatenate([f for _, f in known])], np.cumsum(sizes) - sizes)
        end = self.used + len(known)
        if end > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(end, len(self.rows)), self.width))])
        self.rows[self.used:end] = sums / sizes[:, None]
        self.at.update((w, i) for i, (w, _) in enumerate(known, self.used))
        self.used = end

    def of(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if self.width else []
        if len(self.at) > HELD:
            self.start()
        total, known = np.zeros(self.width), 0
        for start in range(0, len(words), 4096):
            part = words[start:start + 4096]
            new = [w for w in dict.fromkeys(part) if w not in self.at]
            if new:
                self.meet(new)
            at = np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))
            total += self.rows[at].sum(axis=0)
            known += int(np.count_nonzero(at))
        return self.model.decide(total, len(words), known)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all ``docs`` (text, lang)."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found: Counter[str] = Counter()
                for text in texts:
                    found.update(words_of(text))
                yield pd.DataFrame({"lang": lang, "word": list(found), "n": list(found.values())})
    return docs.select("text", "lang").mapInPandas(counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def entries(words: DataFrame) -> DataFrame:
    """(kind, lang, entry, n) of the words (kind 0) and their n-grams (kind n)."""
    def grams(n: int) -> Column:
        padded = F.concat(F.lit(" "), F.col("word"), F.lit(" ")) if n > 1 else F.col("word")
        return F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))

    kinds = [words.select(F.lit(0).alias("kind"), "lang", F.col("word").alias("entry"), "n")]
    for n in range(1, LONGEST + 1):
        # a word of one letter, between blanks, has no n-gram of more than 3
        longer = words.where(F.length("word") >= n - 2).select("lang", F.explode(grams(n)).alias("entry"), "n")
        kinds.append(longer.groupBy("lang", "entry").agg(F.sum("n").alias("n")).select(F.lit(n).alias("kind"), "lang", "entry", "n"))
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def train(docs: DataFrame) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that are not held out and have a language."""
    known = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"]))
    every = stored(entries(stored(counts(known.select(docs["text"].alias("text"), docs["lang"].alias("lang"))), "lang-words")), "lang-entries")
    # entries by how often they occur: few rows, from which the totals and the counts to cut at follow
    often = stored(every.groupBy("kind", "lang", "n").agg(F.count("*").alias("m")), "lang-often")
    totals = often.groupBy("kind", "lang").agg(F.sum(F.col("n") * F.col("m")).alias("total"), F.sum("m").alias("distinct")).toPandas()
    langs = sorted(totals["lang"].unique())
    if not langs:
        return Model([], [], {}, np.zeros((0, 0)))
    share = max(1, ENTRIES // (len(langs) * (LONGEST + 1)))
    above = F.coalesce(F.sum("m").over(Window.partitionBy("kind", "lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = often.withColumn("above", above).where((F.col("above") < share) & (F.col("above") + F.col("m") >= share)).select(
        "kind", "lang", F.col("n").alias("cut"), ((share - F.col("above")) / F.col("m")).alias("part"))
    # of equally frequent entries at the cut, those of the smallest hashes; one row a kind and language is sent
    chance = F.pmod(F.xxhash64("entry"), F.lit(1 << 30)) / F.lit(1 << 30)
    top = every.join(F.broadcast(cuts), ["kind", "lang"], "left").where(
        F.col("cut").isNull() | (F.col("n") > F.col("cut")) | (F.col("n") == F.col("cut")) & (chance < F.col("part")))
    table = every.join(top.select("kind", "entry").distinct(), ["kind", "entry"]).toPandas()
    at: dict[int, dict[str, int]] = {}
    logs, rows = [np.zeros((1, len(langs)))], 1  # row 0 is no entry's
    column = {lang: i for i, lang in enumerate(langs)}
    for kind in range(LONGEST + 1):
        total, distinct = np.zeros(len(langs)), totals.loc[totals["kind"] == kind, "distinct"].max()
        for r in totals[totals["kind"] == kind].itertuples():
            total[column[r.lang]] = r.total
        part = table[table["kind"] == kind]
        entry, names = pd.factorize(part["entry"], sort=True)
        n = np.zeros((len(names), len(langs)))
        n[entry, part["lang"].map(column).to_numpy(int)] = part["n"]
        logs.append(np.log(n + PLUS) - np.log(total + PLUS * (0 if np.isnan(distinct) else distinct)))
        at[kind] = dict(zip(names, range(rows, rows + len(names))))
        rows += len(names)
    words = [float(totals.loc[(totals["kind"] == 0) & (totals["lang"] == lang), "total"].sum()) for lang in langs]
    return Model(langs, words, at, np.concatenate(logs))


def predict(docs: DataFrame, model: Model, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` with held_out, lang_pred and score of their ``text``."""
    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.DataFrame([scorer.of(t) for t in texts], columns=["lang_pred", "score"])

    found = docs.select(*[docs[f"`{c}`"] for c in columns], held_out(docs["doc_id"]).alias("held_out"), predicted(docs["text"]).alias("__found"))
    return found.select(*[f"`{c}`" for c in columns], "held_out", "__found.lang_pred", "__found.score")
