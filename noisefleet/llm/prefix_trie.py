"""Prefix trie of conversations by union-find over the LCP edges of sorted neighbours.

A conversation is a sequence of turns; each distinct sequence of first turns is a node. Conversations are
sorted by their sequences. Between neighbours stands an edge, its depth the number of first turns they share
(LCP). Taken in descending depth, an edge unites the components on its two sides into a branching node of
that depth; on the way up to it each side passes the nodes that do not branch. A component's convs, children,
leaves and saved tokens merge by addition, so every node is known when its component meets a shallower edge.

Spread over tasks:

- The sort is by range, with the id as last key, so that equal conversations spread too. A task unites what
  it can and keeps the rest *contracted*: components whose outer edge lies in another task, a chain of
  strictly shallower edges towards each border. Batches inside a task, then groups of ``FAN`` neighbouring
  tasks, are joined at their borders by the same step until one forest is left.
- A conversation may be very long, so it is cut into pieces of ``PIECE`` turns. A piece is sorted under the
  hash of all turns before it, and each such hash has a trie of its own, ``PIECE`` deep: chains are short and
  no row holds a whole conversation. What lies below a trie's lowest level is added there: sums of deeper
  tries travel along one conversation that passes through them (``carried``), without rounds by depth.
- Ids are digested in ascending order from texts of many ids, joined in parallel (``digests``). SHA-256 itself
  is sequential: one task reads the joined ids of one node, as a stream.

Turns are compared by the MD5 of role and text, prefixes by hashes of 124 bits and more.

Defined cases: null role and text are empty; turns order by turn (null first), then role, then text (by their
first 64 characters, then by digest), and a repeated row is a turn of its own; rows of a null conv_id are left
out; an empty table has no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefleet.llm.common import stored

# Turns a piece, forests joined in one step, digest bytes a turn, rows of a block of running sums.
PIECE, FAN, DIGEST, BLOCK = 64, 64, 16, 4096
OPEN = 1 << 30  # depth of an edge that lies in another task

NODE = "conv_id bigint, trie bigint, local int, node_key string, parent_key string, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
COMPONENT = ("edge int, level bigint, before string, turns binary, end_key string, chars array<bigint>, top int, n bigint, conv bigint, children bigint, leaves bigint, "
             "saved bigint")
NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]
COMPONENT_NAMES = [c.split()[0] for c in COMPONENT.split(", ")]


class Component:
    """Neighbouring conversations that share ``top`` turns; the sums are of the nodes below depth ``top``."""

    __slots__ = ("level", "before", "turns", "end_key", "chars", "top", "n", "conv", "children", "leaves", "saved")

    def __init__(self, level, before, turns, end_key, chars, top, n, conv, children, leaves, saved):
        self.level, self.before, self.turns, self.end_key, self.chars, self.top = level, before, turns, end_key, chars, top
        self.n, self.conv, self.children, self.leaves, self.saved = n, conv, children, leaves, saved

    def key(self, depth: int) -> str:
        """Name of the node; a trie's root goes by the name it has at the lowest level of the trie above."""
        if DIGEST * depth == len(self.turns):
            return self.end_key
        if not depth and self.level:
            return f"{self.level}|{self.before}"
        return hashlib.md5(f"{self.level}|{self.before}|".encode() + self.turns[:DIGEST * depth]).hexdigest()

    def climb(self, depth: int, out: list[tuple]) -> None:
        """Write the nodes between ``top`` and ``depth``, and stand at ``depth``."""
        for at in range(self.top, depth, -1):
            self.leaves = self.leaves if self.children else 1
            self.saved += (self.n - 1) * int(self.chars[at - 1]) if at else 0
            # the members of the node above are the same, but where this climb ends and where a trie above goes on
            parent = self.key(at - 1) if at > 0 and (at == depth + 1 or at == 1 and self.level) else None
            out.append((self.conv, self.level, at, self.key(at) if at == self.top else None, parent, self.n,
                        self.children, self.leaves, self.saved))
            self.children = 1
        self.top = depth

    def absorb(self, other: Component) -> None:
        self.n += other.n
        self.conv = min(self.conv, other.conv)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved


def common(a: Component, b: Component) -> int:
    """Turns that two neighbours share; -1 in different tries."""
    if a.level != b.level or a.before != b.before:
        return -1
    x, y = a.turns, b.turns
    shorter = min(len(x), len(y))
    if x[:shorter] == y[:shorter]:
        return shorter // DIGEST
    return next(i for i in range(shorter // DIGEST) if x[DIGEST * i:DIGEST * i + DIGEST] != y[DIGEST * i:DIGEST * i + DIGEST])


def unite(parts: list[Component], edges: list[int], out: list[tuple], whole: bool = False) -> tuple[list[Component], list[int]]:
    """Unite neighbours in descending depth of their edges; finished nodes go to ``out``.

    ``edges[i]`` stands before ``parts[i]`` (the first is not read). Returned are the components that more rows
    at either end may still change; none if ``whole``, where nothing follows at the ends.
    """
    n = len(parts)
    border = -1 if whole else OPEN
    edges = [border, *edges[1:], border]
    leader, last = list(range(n)), list(range(n))

    def find(i: int) -> int:
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    for i in sorted(range(1, n), key=lambda i: -edges[i]):  # of equal depth, from the left
        depth = edges[i]
        if depth < 0:
            break
        left = find(i - 1)
        # a deeper edge at an outer side is one that could not be settled here
        if edges[left] > depth or edges[last[i] + 1] > depth:
            continue
        parts[left].climb(depth, out)
        parts[i].climb(depth, out)
        parts[left].absorb(parts[i])
        leader[i], last[left] = left, last[i]
    kept, between = [], []
    i = 0
    while i < n:
        before, after = edges[i], edges[last[i] + 1]
        if max(before, after) < OPEN:
            parts[i].climb(max(before, after), out)
        if max(before, after) >= 0:
            kept.append(parts[i])
            between.append(before)
        i = last[i] + 1
    return kept, between


def forests(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes finished in one task, then its contracted forest; rows come sorted."""
    kept: list[Component] = []
    edges: list[int] = []
    part = 0
    for batch in rows:
        out: list[tuple] = []
        part = int(batch["part"].iloc[0]) if len(batch) else part
        for r in batch.itertuples(index=False):
            one = Component(int(r.level), r.before, bytes(r.turns), r.end_key, r.chars, len(r.turns) // DIGEST, 1, int(r.conv_id), int(r.children),
                            int(r.leaves), int(r.saved))
            edges.append(common(kept[-1], one) if kept else -1)
            kept.append(one)
        kept, edges = unite(kept, edges, out)
        yield frame(out, [], [], part)
    yield frame([], kept, edges, part)


def frame(nodes: list[tuple], kept: list[Component], edges: list[int], part: int) -> pd.DataFrame:
    """Nodes and components as rows of one table; ``place`` is null for nodes."""
    none = [None]
    rows = [(*r, *none * (2 + len(COMPONENT_NAMES))) for r in nodes]
    rows += [(*none * len(NODE_NAMES), part, i, e, c.level, c.before, c.turns, c.end_key, list(c.chars), c.top, c.n, c.conv, c.children, c.leaves, c.saved)
             for i, (c, e) in enumerate(zip(kept, edges))]
    return pd.DataFrame(rows, columns=[*NODE_NAMES, "part", "place", *COMPONENT_NAMES], dtype=object)


def join_forests(whole: bool, fan: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Join the contracted forests of neighbouring parts at their borders."""
    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        kept, edges, out = [], [], []
        rows = rows.sort_values(["part", "place"])
        for r in rows[["place", *COMPONENT_NAMES]].itertuples(index=False):
            one = Component(int(r.level), r.before, bytes(r.turns), r.end_key, r.chars, int(r.top), int(r.n), int(r.conv), int(r.children),
                            int(r.leaves), int(r.saved))
            # the first of a part is a whole conversation, and so is the last of the part before
            edges.append(int(r.edge) if r.place else common(kept[-1], one) if kept else -1)
            kept.append(one)
        kept, edges = unite(kept, edges, out, whole)
        return frame(out, kept, edges, int(rows["part"].iloc[0]) // fan)
    return joined


def trie_nodes(pieces: DataFrame) -> DataFrame:
    """Nodes of the tries of ``pieces`` (level, before, turns, end_key, chars, conv_id, children, leaves, saved)."""
    order = ["level", "before", "turns", "conv_id"]
    ranged = pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("bigint"))
    schema = f"{NODE}, part bigint, place int, {COMPONENT}"
    found = stored(ranged.mapInPandas(forests, schema), "trie-forests")
    nodes = found.where("place is null")
    while True:
        rest = found.where("place is not null")
        most = rest.agg(F.max("part")).first()[0]
        if most is None:
            return nodes.select("*", F.expr(f"trie * {PIECE} + local").alias("depth")).select("depth", *NODE_NAMES)
        joined = rest.groupBy(F.expr(f"part div {FAN}").alias("group")).applyInPandas(join_forests(most < FAN, FAN), schema)
        found = stored(joined, "trie-joined")
        nodes = nodes.unionByName(found.where("place is null"))


def running(rows: DataFrame, by: Column, **values: Column) -> DataFrame:
    """``rows`` with sums of ``values`` over the rows of the same conv_id with smaller ``by``, in two steps of bounded windows."""
    held = rows.withColumn("__by", by).withColumn("__block", F.expr(f"__by div {BLOCK}")).select("*", *[v.alias(f"__{n}") for n, v in values.items()])
    sums = held.groupBy("conv_id", "__block").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in values])
    past = Window.partitionBy("conv_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "__block", *[F.coalesce(F.sum(f"__{n}").over(past), F.lit(0)).alias(f"__past_{n}") for n in values])
    inside = Window.partitionBy("conv_id", "__block").orderBy("__by").rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(sums, ["conv_id", "__block"])
    return out.select(*rows.columns, *[(F.col(f"__past_{n}") + F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0))).alias(n) for n in values])


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, chars, n): the place of each turn in its conversation from 0, and the conversation's number of turns.

    Rows are sorted by range, so that one conversation may lie in many tasks; per-conversation windows see one row per task.
    """
    role, text = F.coalesce(turns["role"], F.lit("")), F.coalesce(turns["text"], F.lit(""))
    order = ["conv_id", "turn", "role_head", "text_head", "turn_key", "salt"]
    said = turns.where(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].cast("bigint").alias("conv_id"), turns["turn"].alias("turn"), F.left(role, F.lit(64)).alias("role_head"),
        F.left(text, F.lit(64)).alias("text_head"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_key"),
        F.length(text).cast("bigint").alias("chars"), F.monotonically_increasing_id().alias("salt"))
    ranged = said.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.select("conv_id", "turn_key", "chars", F.monotonically_increasing_id().alias("seq")), "trie-turns")
    ranged = ranged.withColumn("part", F.shiftright("seq", 33))
    runs = ranged.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id").orderBy("part")
    past, every = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"), F.sum("n").over(every).alias("n"))
    return ranged.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("seq") - F.col("first") + F.col("before")).alias("pos"), "turn_key", "chars", "n")


def branched(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that start as the first of their ``group``: conv_id c takes the first h = crc32(c) % ``most`` turns of
    c - c % ``group``, then its own after its first h. (conv_id, pos, turn_key, chars) and (conv_id, length)."""
    own = stored(numbered(turns), "trie-numbered")
    convs = own.groupBy("conv_id").agg(F.max("n").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    convs = convs.withColumn("base", F.expr(f"conv_id - conv_id % {group}"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = stored(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-convs")
    heads = own.where(F.expr(f"conv_id % {group} = 0 and pos < {most - 1}")).select(F.col("conv_id").alias("base"), "pos", "turn_key", "chars")
    given = convs.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("pos < taken")
    # of two plain tables, so that a very long conversation can be split in the join
    rest = own.drop("n").join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    rest = rest.withColumn("pos", F.col("taken") + F.col("pos") - F.col("h"))
    keep = ["conv_id", "pos", "turn_key", "chars"]
    return rest.select(*keep).unionByName(given.select(*keep)), convs.select("conv_id", "length")


def cut(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """Pieces of ``PIECE`` turns: (conv_id, level, last, turns, chars); a conversation without turns has an empty one."""
    one = F.array_sort(F.collect_list(F.struct("pos", "turn_key", "chars")))
    cuts = sequences.groupBy("conv_id", F.expr(f"pos div {PIECE}").alias("level")).agg(one.alias("t"))
    cuts = cuts.select("conv_id", "level", F.unhex(F.array_join("t.turn_key", "")).alias("turns"), F.col("t.chars").alias("chars"))
    none = lengths.where("length = 0").select("conv_id", F.lit(0).cast("bigint").alias("level"), F.lit(b"").alias("turns"),
                                              F.array().cast("array<bigint>").alias("chars"))
    last = lengths.select("conv_id", F.expr(f"greatest(length - 1, 0) div {PIECE}").alias("last"))
    return cuts.unionByName(none).join(last, "conv_id")


def named(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``before``, a hash of all turns before them, and ``end_key``, the name of the node they end at."""
    both = lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))
    before = F.when(F.col("level") > 0, both(F.col("past_a"), F.col("past_b"))).otherwise("")
    full = F.concat_ws("|", (F.col("level") + 1).cast("string"), both(F.col("past_a") + F.col("a"), F.col("past_b") + F.col("b")))
    inside = F.md5(F.concat(F.concat_ws("|", F.col("level").cast("string"), "before", F.lit("")).cast("binary"), "turns"))
    end_key = F.when(F.octet_length("turns") == DIGEST * PIECE, full).otherwise(inside)
    return pieces.withColumn("before", before).withColumn("end_key", end_key).select("conv_id", "level", "last", "turns", "chars", "before", "end_key")


def carried(long: DataFrame) -> DataFrame:
    """``long`` pieces with what lies below each: its deeper tries' children, leaves and saved tokens, held by one piece of each node."""
    low = long.where("level > 0").select("*", (F.col("level") < F.col("last")).cast("bigint").alias("children"),
                                         F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved"))
    roots = trie_nodes(low).where("local = 0").select(
        "conv_id", F.col("trie").alias("level"), "n_children", "n_leaves", "saved_tokens")
    roots = stored(roots, "trie-roots")
    held = long.join(roots.drop("n_children"), ["conv_id", "level"], "left")
    summed = running(held, F.col("last") - F.col("level"), leaves=F.coalesce("n_leaves", F.lit(0)), saved=F.coalesce("saved_tokens", F.lit(0)))
    above = roots.select("conv_id", (F.col("level") - 1).alias("level"), F.col("n_children").alias("children"))
    return summed.join(above, ["conv_id", "level"], "left").withColumn("children", F.coalesce("children", F.lit(0))).select(
        *long.columns, "children", "leaves", "saved")


def digests(ends: DataFrame) -> DataFrame:
    """(node_key, ends_sha256): the digest of each node's conv_ids, ascending and joined by commas."""
    def join_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby("node_key", sort=False)["conv_id"].agg(
                start="first", ids=lambda x: ",".join(map(str, x))).reset_index()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sha = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch["node_key"], batch["ids"]):
                if key == at:
                    sha.update(b",")
                else:
                    if at is not None:
                        done.append((at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(done, columns=["node_key", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(at, sha.hexdigest())], columns=["node_key", "ends_sha256"])

    joined = ends.repartitionByRange("node_key", "conv_id").sortWithinPartitions("node_key", "conv_id").mapInPandas(
        join_ids, "node_key string, start bigint, ids string")
    return joined.repartition("node_key").sortWithinPartitions("node_key", "start").mapInPandas(digest, "node_key string, ends_sha256 string")


def trie(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the trie of ``sequences`` (conv_id, pos, turn_key, chars) with their ``lengths`` (conv_id, length), turnless ones included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); conv_id is a node's smallest
    member, and with the depth names it.
    """
    hashed = F.md5(F.concat(F.col("level").cast("string"), F.lit(":"), F.hex("turns")))
    half = lambda start: F.conv(F.substring(hashed, start, 15), 16, 10).cast("decimal(20,0)")
    pieces = stored(cut(sequences, lengths).withColumns({"a": half(1), "b": half(16)}), "trie-pieces")
    none, zero = F.lit(0).cast("decimal(20,0)"), F.lit(0).cast("bigint")
    rows = named(pieces.where("last = 0").withColumns({"past_a": none, "past_b": none})).withColumns({"children": zero, "leaves": zero, "saved": zero})
    long = pieces.where("last > 0")
    if not long.isEmpty():
        rows = rows.unionByName(carried(stored(named(running(long, F.col("level"), past_a=F.col("a"), past_b=F.col("b"))), "trie-long")))
    rows = stored(rows, "trie-rows")
    # the root of a lower trie is told where it is a node of the upper one
    nodes = stored(trie_nodes(rows).where("local > 0 or trie = 0"), "trie-nodes")
    parents = nodes.where("node_key is not null and n_children > 0").select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    inner = nodes.where("parent_key is null").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    tops = nodes.where("parent_key is not null").join(parents, "parent_key")
    linked = inner.unionByName(tops.select(*inner.columns))
    ends = digests(rows.where("level = last").select(F.col("end_key").alias("node_key"), "conv_id"))
    none = linked.where("node_key is null").withColumn("ends_sha256", F.lit(None).cast("string"))
    some = linked.where("node_key is not null").join(ends, "node_key", "left")
    return none.unionByName(some.select(*none.columns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
