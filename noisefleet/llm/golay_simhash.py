"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits link when 3 bits or fewer differ. Candidates come from keys that two linked
fingerprints must share:

- The fingerprint is cut into 4 blocks of 16 bits. With 3 differing bits at most, one block is equal.
- Of the other 48 bits, 46 form two segments of 23 bits. One segment has 1 differing bit or none.
- The binary Golay code of length 23 is perfect: each 23-bit word lies within 3 bits of exactly one codeword.
  A word 3 bits off its codeword has 5 more codewords at 4 bits; these 6 (or, closer in, the single one) are its
  keys. Of two words that differ in at most one bit, the codeword nearest to the one is a key of the other.

So each fingerprint is filed under 8 keys (block, its 16 bits, segment, index of the nearest codeword) and
looked up under at most 48, and each link is met in both directions. Equal fingerprints are one class before that.

Groups of thousands of near copies would meet as all pairs. They do not: first every fingerprint of a key is
compared with the key's smallest and largest one only (links of the key's size), components of these links
are formed, and then only fingerprints of different components are compared, where one of the two stands
outside the key's largest component. Links inside a component add nothing, so no component is lost.

``keep_one`` (a stage) asks for more than those 3 bits hold: exact similarity (Jaccard) of ``similarity`` or more over
sets of ``shingle``-word shingles. A fingerprint's radius misses most such pairs, so beside the components of the
fingerprints, bands of smallest hashes (min-hash) are keys, as many as leave ``MOST_MISSED`` of the pairs right at the
bound unseen, fewer above it. Every link is verified on the texts. Nodes of a key meet ``PIVOTS`` of its nodes first; what
is left unlinked there meets again only where it shares one of its rarest shingles early enough to be similar.

Defined cases: null and empty texts and texts without a word have fingerprint 0, which links like any other;
repeated rows share their class; a null doc_id belongs to a component like any other but never names it; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefleet.llm.common import stored, text_batches

MOST_BITS = 3
SHINGLE = 3
SEED = 42
# Of the stage: words a shingle, least similarity, smallest hashes a band, and the share of pairs at the bound no band holds.
NEAR_SHINGLE, SIMILARITY, BAND, MOST_MISSED = 5, 0.8, 10, 0.01
# Of the stage: nodes of a key that all its nodes are compared with first.
PIVOTS = 4
# Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
LENGTH, DATA = 23, 12


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """A hash of each word shingle, in order; of a text of fewer words one of them all, of none none."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, max(1, len(words) - shingle + 1))


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text: a bit is set if it is in over half the hashes of its word shingles."""
    return _print(shingle_hashes(text, shingle, seed))


def _print(hashes: np.ndarray) -> int:
    ones, n = np.zeros(64, np.int64), len(hashes)
    for start in range(0, n, 65536):
        part = hashes[start:start + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))
    return simhash(text)


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the pattern to the nearest codeword, and the patterns to all keys (repeats where there is one).

    Patterns of weight 3 or less have all 2048 syndromes, each once; patterns of weight 4 share the
    syndromes of weight 3, five each.
    """
    bit = np.array([_syndrome_of(1 << i) for i in range(LENGTH)])
    nearest = np.zeros(1 << (LENGTH - DATA), np.int64)
    keys: list[list[int]] = [[] for _ in nearest]
    one = [(1 << i, int(bit[i])) for i in range(LENGTH)]
    level = [(0, 0, -1)]
    for weight in range(5):
        for pattern, syndrome, _ in level:
            if weight <= 3:
                nearest[syndrome] = pattern
            if weight <= 3 or len(keys[syndrome]) and bin(int(nearest[syndrome])).count("1") == 3:
                keys[syndrome].append(pattern)
        level = [(p | q, s ^ r, i) for p, s, last in level for i, (q, r) in enumerate(one) if i > last]
    return nearest, np.array([k + [k[0]] * (6 - len(k)) for k in keys])


def _syndrome_of(word: int) -> int:
    """Remainder of a 23-bit word by the generator."""
    for i in range(LENGTH - 1, LENGTH - DATA - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - (LENGTH - DATA))
    return word


class Keys:
    """Keys of many fingerprints at once."""

    def __init__(self) -> None:
        self.nearest, self.near = golay_tables()
        low, high = 12, LENGTH - 12
        bits = np.array([_syndrome_of(1 << i) for i in range(LENGTH)])
        table = lambda n, first: np.bitwise_xor.reduce(
            np.where(np.arange(1 << n)[:, None] >> np.arange(n) & 1, bits[first:first + n], 0), axis=1)
        self.low, self.high = table(low, 0), table(high, 12)

    def of(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(filed, looked up): arrays of keys, one row per fingerprint, 8 and 48 wide, repeats as -1."""
        x = fingerprints.astype(np.uint64)
        filed, sought = [], []
        for block in range(4):
            at = np.uint64(16 * block)
            exact = (x >> at & np.uint64(0xFFFF)).astype(np.int64)
            below = x & ((np.uint64(1) << at) - np.uint64(1))
            above = x >> at >> np.uint64(16) << at
            rest = (below | above).astype(np.int64)  # the other 48 bits, closed up
            for segment in range(2):
                word = rest >> (LENGTH * segment) & ((1 << LENGTH) - 1)
                syndrome = self.low[word & 0xFFF] ^ self.high[word >> 12]
                name = ((block * 2 + segment) << 28) | (exact << 12)
                filed.append(name | (word ^ self.nearest[syndrome]) >> (LENGTH - DATA))
                near = name[:, None] | (word[:, None] ^ self.near[syndrome]) >> (LENGTH - DATA)
                near[:, 1:][near[:, 1:] == near[:, :1]] = -1
                sought.append(near)
        return np.stack(filed, axis=1), np.concatenate(sought, axis=1)


def keyed(prints: DataFrame) -> DataFrame:
    """(key, fp, filed) of distinct fingerprints ``fp``; ``filed`` marks the rows of the nearest codeword."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = Keys()
        for batch in batches:
            for start in range(0, len(batch), 20000):
                fp = batch["fp"].to_numpy(np.int64)[start:start + 20000]
                _, sought = keys.of(fp.view(np.uint64))
                key = sought.ravel()
                first = np.tile(np.arange(sought.shape[1]) % 6 == 0, len(fp))  # of each six, the nearest stands first
                keep = key >= 0
                yield pd.DataFrame({"key": key[keep], "fp": np.repeat(fp, sought.shape[1])[keep], "filed": first[keep]})
    return prints.select("fp").mapInPandas(rows, "key bigint, fp bigint, filed boolean")


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_BITS


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node that links (a, b) lead to; nodes without a link have no row.

    Star contraction: every node hands its larger neighbours to its smallest one, then its smaller ones,
    until the stars stand still. Each round is stored; nothing but two totals reaches the driver.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    total = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # now every edge leads from the larger to the smaller node
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "a", "m")
        edges = stored(small.select(F.col("x").alias("a"), F.col("m").alias("b")).where("a <> b")
                       .unionByName(small.select("a", F.col("m").alias("b"))).distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if now == total:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        total = now


def print_components(prints: DataFrame) -> DataFrame:
    """(fp, root): components of distinct fingerprints; those without a link have no row."""
    rows = keyed(prints)
    ends = rows.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    # stored apart, so that a key with very many fingerprints can be split in the join; one plan at every size
    shared = stored(rows.join(stored(ends, "golay-ends").hint("merge"), "key"), "golay-keys")
    stars = shared.where("fp <> low and filed").where(_near("fp", "low")).select(F.col("fp").alias("a"), F.col("low").alias("b")).unionByName(
        shared.where("fp <> high and fp <> low").where(_near("fp", "high")).select(F.col("fp").alias("a"), F.col("high").alias("b")))
    first = components(stars, "golay-stars")
    placed = shared.select("key", "fp", "filed").join(first.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "key", "fp", "filed", F.coalesce("root", "fp").alias("part"))
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_keys = stored(placed.join(stored(main, "golay-main"), "key"), "golay-open")
    left = open_keys.where("filed").select("key", F.col("fp").alias("a"), F.col("part").alias("pa"), (F.col("part") == F.col("main")).alias("main"))
    right = open_keys.select("key", F.col("fp").alias("b"), F.col("part").alias("pb"), (F.col("part") == F.col("main")).alias("main"))
    near = (F.col("pa") != F.col("pb")) & _near("a", "b")
    outside = left.where("not main").drop("main").join(right.drop("main"), "key").where(near).select("a", "b")
    inside = left.where("main").drop("main").join(right.where("not main").drop("main"), "key").where(near).select("a", "b")
    links = outside.unionByName(inside).unionByName(first.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components(links, "golay-links").select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of (doc_id, text): the component's smallest doc_id."""
    known = stored(docs.select("doc_id", fingerprints(docs["text"]).alias("fp")), "simhash")
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-classes")
    placed = classes.join(print_components(classes), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_print = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return known.join(by_print, "fp").select("doc_id", "fp", "component_id")


def band_keys(hashes: np.ndarray, bands: int) -> np.ndarray:
    """A key per band of the smallest hashes of a set under ``BAND`` orders each.

    The hashes are even already, so that a product and a sum in 32 bits give each order.
    """
    rng = np.random.default_rng(SEED)
    by, plus = (rng.integers(0, 1 << 32, bands * BAND, np.uint32) for _ in range(2))
    by |= np.uint32(1)
    least = np.full(bands * BAND, np.iinfo(np.uint32).max, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(x), 512):
        order = x[start:start + 512, None] * by
        order += plus
        np.minimum(least, order.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(k.tobytes(), i) for i, k in enumerate(least.reshape(bands, BAND))], np.uint64)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sets, as sorted arrays; of empty sets 1."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 1.0


def sketches(text: Column, shingle: int, bands: int) -> Column:
    """(node, size, fp, bands): a hash of the set of shingles, their number, its fingerprint, and the keys of its bands."""
    @F.pandas_udf("node bigint, size bigint, fp bigint, bands array<bigint>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            hashes = shingle_hashes(t, shingle)
            once = np.unique(hashes)
            keys = band_keys(once, bands) if len(once) else np.empty(0, np.uint64)
            out.append((np.uint64(xxhash.xxh64_intdigest(once.tobytes())).view(np.int64), len(once), np.uint64(_print(hashes)).view(np.int64), keys.view(np.int64)))
        return pd.DataFrame(out, columns=["node", "size", "fp", "bands"])
    return sketched(text)


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of pairs (a, b) of nodes those whose ``texts`` (node, text) have the similarity; each pair once."""
    @F.pandas_udf("boolean")
    def enough(left: pd.Series, right: pd.Series) -> pd.Series:
        last: dict[str, np.ndarray] = {}

        def held(t: str) -> np.ndarray:
            if t not in last:
                if len(last) > 8:
                    last.clear()
                last[t] = np.unique(shingle_hashes(t, shingle))
            return last[t]
        return pd.Series([similarity_of(held(a), held(b)) >= similarity for a, b in zip(left, right)], dtype=bool)

    once = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    side = lambda n, t: texts.select(F.col("node").alias(n), F.col("text").alias(t)).hint("merge")
    return once.join(side("a", "left"), "a").join(side("b", "right"), "b").where(enough("left", "right")).select("a", "b")


def _sized(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * similarity


def rare_keys(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(key, node, size, part, tail): the rarest shingles of ``nodes`` (node, size, part), as many as two similar sets must share one of.

    Sets of n shingles share ceil(similarity * n) of them at least, so one stands among the first n - ceil(similarity * n) + 1
    of each in any common order; here the one by number of holders. Shingles of one holder lead to nobody, but take their places.
    ``tail`` counts a node's shingles from this one on, itself included.
    """
    @F.pandas_udf("array<bigint>")
    def hashes(text: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in text])

    held = stored(texts.join(nodes.hint("merge"), "node").select("node", F.explode(hashes("text")).alias("key")), "near-shingles")
    several = stored(held.groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1"), "near-holders")
    common = stored(held.join(several.hint("merge"), "key"), "near-common")
    room = common.groupBy("node").agg(F.count("*").alias("n")).join(nodes, "node").withColumn(
        "room", F.col("n") - F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-6)) + 1).where("room > 0")
    place = F.row_number().over(Window.partitionBy("node").orderBy("holders", "key"))
    first = common.join(room.hint("merge"), "node").withColumn("place", place).where("place <= room")
    return stored(first.select("key", "node", "size", "part", (F.col("n") - F.col("place") + 1).alias("tail")), "near-rare")


def near_components(rows: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of ``rows`` (key, node, size): components of similar nodes that share a key; ``docs`` is (node, text), one per node.

    Every row of a key is compared with the key's ``PIVOTS`` first, which settles most groups. What lies in a key and outside
    its largest component then gets finer keys, its rarest shingles (``rare_keys``): sets that share a common passage but
    not enough else no longer meet, and no similar pair is lost. Similar sets are of similar size, which is asked
    before any text is fetched.
    """
    # of each key, the first nodes under some orders by hash, the same orders for all keys
    pivots = [F.min(F.struct(F.xxhash64("node", F.lit(j)).alias("at"), "node", "size")) for j in range(PIVOTS)]
    ends = rows.groupBy("key").agg(F.array(*pivots).alias("pivots"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    shared = stored(rows.join(stored(ends.drop("low", "high"), "near-ends").hint("merge"), "key"), "near-keys")
    texts = stored(docs.join(stored(shared.select("node").distinct(), "near-shared").hint("merge"), "node"), "near-texts")
    stars = shared.select("node", "size", F.explode(F.array_distinct("pivots")).alias("p")).where("node <> p.node").where(
        _sized("size", "p.size", similarity)).select(F.col("node").alias("a"), F.col("p.node").alias("b"))
    first = components(similar(stars, texts, shingle, similarity), "near-stars")
    placed = stored(shared.select("key", "node", "size").join(first, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("part")), "near-placed")
    unsettled = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    nodes = stored(placed.join(stored(unsettled, "near-unsettled").hint("merge"), "key").select("node", "size", "part").distinct(), "near-open")
    rare = rare_keys(nodes, texts, shingle, similarity)
    sizes = rare.groupBy("key", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    left = stored(rare.join(stored(main.drop("parts"), "near-main").hint("merge"), "key"), "near-left")
    side = lambda n: [F.col("node").alias(n), F.col("part").alias(f"p{n}"), F.col("size").alias(f"s{n}"), F.col("tail").alias(f"t{n}")]
    rest = left.where("part <> main").select("key", *side("a")).join(left.select("key", *side("b")), "key")
    # at their first common shingle the tails of two similar sets hold all that they share
    share = (F.col("sa") + F.col("sb")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
    rest = rest.where("pa <> pb").where(_sized("sa", "sb", similarity)).where(F.least("ta", "tb") >= share)
    links = similar(rest.select("a", "b"), texts, shingle, similarity).unionByName(first.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components(links, "near-links")


def keep_one(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component of near copies (0 < ``similarity`` <= 1 over sets of ``shingle`` words):
    the smallest doc_id (null last); of repeated rows one."""
    bands = 1 if similarity >= 1 else math.ceil(math.log(MOST_MISSED) / math.log(1 - similarity ** BAND))
    keys = [F.coalesce(docs["doc_id"].cast("bigint"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(docs["text"]).alias("text_hash")]
    # all that Python reads is stored inside
    with text_batches(docs.sparkSession):
        known = stored(docs.select(*keys, sketches(docs["text"], shingle, bands).alias("s")).select("id", "text_hash", "s.*"), "near-sketches")
        nodes = stored(known.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("k"), F.min("fp").alias("fp"), F.first("size").alias("size"),
                                                    F.first("bands").alias("bands")).select("node", "k.*", "fp", "size", "bands"), "near-nodes")
        prints = nodes.join(print_components(nodes.select("fp").distinct()).hint("merge"), "fp", "left").select(
            F.coalesce("root", "fp").alias("key"), "node", "size")
        rows = prints.unionByName(nodes.select(F.explode("bands").alias("key"), "node", "size"))
        texts = docs.select(*keys, docs["text"].alias("text")).join(nodes.select("node", "id", "text_hash").hint("merge"), ["id", "text_hash"])
        texts = texts.dropDuplicates(["node"]).select("node", "text")
        roots = near_components(rows, texts, shingle, similarity)
    placed = known.select("id", "text_hash", "node").join(roots.hint("merge"), "node", "left")
    keepers = placed.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("id", "text_hash")).alias("k")).select("k.*")
    out = docs.select(*keys, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return out.join(keepers, ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"]).select("row.*")
