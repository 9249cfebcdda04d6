"""SentencePiece encoding with seeded merge-dropout, and decoding.

A merge-type (BPE) model merges, again and again, the neighbouring pieces whose union has the best score, the
leftmost first. Here each candidate merge is skipped for good with probability ``dropout``, by a keyed hash of
(seed, variant, chunk, where the merge lies), so a run can be repeated exactly. Each occurrence of a chunk (a word with the
spaces before it) has a variant of its own, a hash of the seed, the document and its place in it (one of ``variants``,
2^62), so it draws for itself; with dropout 0 the result is the model's own segmentation.

A vocabulary whose pieces hold spaces only at their front never merges across chunks, so chunks are encoded by
themselves. Of the merges that make a chunk's segmentation an occurrence either skips none, then it is its own too, or some;
then the chunk is encoded without those, and so on. Each distinct (chunk, merges left out) of a batch is encoded once, which
gives every occurrence exactly what encoding it alone would. Short chunks go together as matrices, one merge per
chunk and round; long ones through an agenda (a heap of candidate merges). Both give the same pieces.

Characters outside the vocabulary become byte pieces, and so does a literal U+2581, the model's sign for space;
decoding therefore returns every text exactly.

The model file's bytes are read once, on the driver, and travel with the tasks; they are small (``MOST_BYTES``).

Defined cases: null and empty texts have no pieces and decode to empty text; a null doc_id draws like 0; repeated
rows have equal pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_BYTES = 64 << 20
DROPOUT, VARIANTS, SEED = 0.1, 1 << 62, 42
CHUNK = re.compile(" +[^ ]*")
SHORT = 48
TEXT_AT_ONCE = 1 << 21

# The mark that stands for a space, and the kinds of pieces in a model file.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2
NONE = np.iinfo(np.int32).max


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path}: a model of over {MOST_BYTES} bytes")
    return data


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit words (the finishing steps of a common shift-and-multiply generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """A merge-type model: its vocabulary and which pairs of pieces merge."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as protocol

        spec = protocol.ModelProto()
        spec.ParseFromString(model)
        n = spec.normalizer_spec
        if spec.trainer_spec.model_type != MERGE_TYPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("a merge-type model with byte pieces is needed")
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix:
            raise ValueError("a model that leaves texts as they are, but for a space in front, is needed")
        texts = [p.piece for p in spec.pieces]
        self.id = {p.piece: i for i, p in enumerate(spec.pieces) if p.type in (NORMAL, USER_DEFINED)}
        if any(MARK in t.lstrip(MARK) for t in self.id):
            raise ValueError("a vocabulary with spaces only at the front of pieces is needed")
        score = np.array([p.score for p in spec.pieces])
        # equal scores are equal ranks: then the place decides
        self.rank = np.searchsorted(np.unique(-score), -score).astype(np.int32)
        self.byte = {int(t[1:-1], 16): i for i, t in enumerate(texts) if spec.pieces[i].type == BYTE}
        self.raw = [bytes([int(t[1:-1], 16)]) if spec.pieces[i].type == BYTE else b"" if spec.pieces[i].type in (UNKNOWN, CONTROL)
                    else t.replace(MARK, " ").encode() for i, t in enumerate(texts)]
        pairs = sorted((self.id[t[:k]] * len(texts) + self.id[t[k:]], i) for t, i in self.id.items() for k in range(1, len(t))
                       if t[:k] in self.id and t[k:] in self.id)
        self.size = len(texts)
        self.pair, self.union = np.array([p for p, _ in pairs], np.int64), np.array([u for _, u in pairs], np.int32)
        self._file()
        # a character of one byte outside the vocabulary is its byte piece, which merges with nothing
        letters = {c: self.byte[c] for c in range(128)} | {ord(t): i for t, i in self.id.items() if len(t) == 1 and t != MARK} | {32: self.id[MARK]}
        self.letter = np.full(max(letters) + 2, -1, np.int32)
        self.letter[list(letters)] = list(letters.values())
        self.of_code = letters

    def _file(self) -> None:
        """Pairs in a table of slots by hash, each in the first free one from its own on."""
        self.bits = max(4, int(4 * len(self.pair)).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int64)
        self.slot_union = np.full(1 << self.bits, -1, np.int32)
        for pair, union, at in zip(self.pair.tolist(), self.union.tolist(), self._slot_of(self.pair).tolist()):
            while self.slot[at] >= 0:
                at = (at + 1) & (len(self.slot) - 1)
            self.slot[at], self.slot_union[at] = pair, union

    def _slot_of(self, pair: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def unions(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1."""
        pair = left.astype(np.int64) * self.size + right
        at = self._slot_of(pair)
        held = self.slot[at]
        union = np.where(held == pair, self.slot_union[at], -1)
        rest = np.nonzero((held != pair) & (held >= 0))[0]
        while len(rest):  # another pair has the slot: look on
            at[rest] = (at[rest] + 1) & (len(self.slot) - 1)
            held = self.slot[at[rest]]
            hit = held == pair[rest]
            union[rest[hit]] = self.slot_union[at[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        union[(left < 0) | (right < 0)] = -1
        return union

    @cached_property
    def merges(self) -> dict[int, int]:
        return dict(zip(self.pair.tolist(), self.union.tolist()))


@lru_cache(maxsize=2)
def pieces_of(model: bytes) -> Pieces:
    """One per model and worker process."""
    return Pieces(model)


def chunk_key(chunk: str, variant: int, seed: int) -> int:
    codes = np.frombuffer(chunk.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return int(_keys(codes[None, :], np.array([variant]), seed)[0])


def _keys(codes: np.ndarray, variants: np.ndarray, seed: int) -> np.ndarray:
    """A hash per row of code points (0 behind the end), variant and seed."""
    key = mixed(variants.astype(np.uint64) + (np.uint64(seed & 0xFFFFFFFF) << np.uint64(16)))
    for k in range(codes.shape[1]):
        key = np.where(codes[:, k] > 0, mixed(key ^ codes[:, k]), key)
    return key


def _place(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    return start.astype(np.uint64) << np.uint64(42) | middle.astype(np.uint64) << np.uint64(21) | end.astype(np.uint64)


def _skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the merge of [start, middle) and [middle, end) of a chunk is skipped."""
    return _skipped_at(key, _place(start, middle, end), dropout)


def _skipped_at(key: np.ndarray, place: np.ndarray, dropout: float) -> np.ndarray:
    return (mixed(key ^ mixed(place + np.uint64(1))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < dropout


def encode_long(pieces: Pieces, chunk: str, key: int, dropout: float) -> list[tuple[int, int]]:
    """(piece, start) of a chunk by an agenda of candidate merges; piece -1 is a character without one."""
    piece = [pieces.of_code.get(ord(c), -1) for c in chunk]
    n = len(piece)
    start, after, before = list(range(n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    merges, agenda = pieces.merges, []

    def offer(lefts: list[int]) -> None:
        some = [(i, after[i]) for i in lefts if i >= 0 and after[i] < n and piece[i] >= 0 and piece[after[i]] >= 0]
        some = [(i, j, u) for i, j in some if (u := merges.get(piece[i] * pieces.size + piece[j])) is not None]
        if not some:
            return
        ends = [after[j] for _, j, _ in some]
        skip = _skipped(np.full(len(some), key, np.uint64), *(np.array(v) for v in ([i for i, _, _ in some], [j for _, j, _ in some], ends)), dropout)
        for (i, j, u), e, s in zip(some, ends, skip.tolist()):
            if not s:
                heapq.heappush(agenda, (int(pieces.rank[u]), i, j, e, u))

    offer(list(range(n - 1)))
    gone = [False] * n
    while agenda:
        _, i, j, e, u = heapq.heappop(agenda)
        # stale if either side has merged since
        if gone[i] or gone[j] or after[i] != j or after[j] != e:
            continue
        piece[i], after[i], gone[j] = u, e, True
        if e < n:
            before[e] = i
        offer([before[i], i])
    return [(piece[i], start[i]) for i in range(n) if not gone[i]]


def encode_short(pieces: Pieces, codes: np.ndarray, key: np.ndarray, dropout: float, left_out: np.ndarray | None = None
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, count, places of the merges made) of chunks of one length as rows of code points. With ``left_out``
    (a row of places each, 0 for none) those merges are skipped and no others.

    Each round merges in every row what the agenda would take next. A piece stands at its first character's place and
    knows its neighbours, so that a round writes only where it merges; rows without a merge left are set aside in time.
    """
    n, width = codes.shape
    piece = pieces.letter[np.minimum(codes, len(pieces.letter) - 1)]
    gone, merges = np.zeros((n, width), bool), np.zeros(n, np.int64)
    made = np.zeros((n, max(0, width - 1)), np.uint64)

    def offers(rows: np.ndarray, left: np.ndarray, right: np.ndarray, s: np.ndarray, m: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and union of candidate merges, one per element; no rank for those that cannot be or are skipped."""
        union = pieces.unions(left, right)
        rank = np.where(union >= 0, pieces.rank[union], NONE)
        if left_out is not None:
            if left_out.shape[1]:
                some = np.nonzero(union >= 0)[0]
                place = _place(s[some], m[some], e[some])
                rank[some[(left_out[rows[some]] == place[:, None]).any(axis=1)]] = NONE
        elif dropout > 0:
            some = np.nonzero(union >= 0)[0]
            rank[some[_skipped(key[rows[some]], s[some], m[some], e[some], dropout)]] = NONE
        return rank, union

    live = np.arange(n)
    if width > 1:
        column = np.tile(np.arange(width - 1), n)
        rank, union = (x.reshape(n, width - 1) for x in offers(np.repeat(live, width - 1), piece[:, :-1].ravel(), piece[:, 1:].ravel(),
                                                               column, column + 1, column + 2))
        now, after, before = piece.copy(), np.tile(np.arange(1, width + 1, dtype=np.int16), (n, 1)), np.tile(np.arange(-1, width - 1, dtype=np.int16), (n, 1))
        dead = gone.copy()
    while width > 1 and len(live):
        at = rank.argmin(axis=1)
        row = np.nonzero(rank[np.arange(len(live)), at] < NONE)[0]
        if 2 * len(row) < len(live) or not len(row):
            ended = np.ones(len(live), bool)
            ended[row] = False
            piece[live[ended]], gone[live[ended]] = now[ended], dead[ended]
            live, now, after, before, dead, rank, union, at = (x[row] for x in (live, now, after, before, dead, rank, union, at))
            row = np.arange(len(live))
            if not len(row):
                break
        i = at[row]
        k = after[row, i].astype(np.int64)
        e = after[row, k].astype(np.int64)
        who = live[row]
        made[who, merges[who]] = _place(i, k, e)
        merges[who] += 1
        now[row, i], after[row, i], dead[row, k], rank[row, i] = union[row, i], e, True, NONE
        inner = k < width - 1
        rank[row[inner], k[inner]] = NONE
        right = np.nonzero(e < width)[0]
        before[row[right], e[right]] = i[right]
        b = before[row, i].astype(np.int64)
        left = np.nonzero(b >= 0)[0]
        # the merged piece with the one behind it, and the one before it with the merged piece
        r = np.concatenate([row[right], row[left]])
        first, second = np.concatenate([i[right], b[left]]), np.concatenate([e[right], i[left]])
        stop = np.concatenate([after[row[right], e[right]], e[left]]).astype(np.int64)
        rank[r, first], union[r, first] = offers(live[r], now[r, first], now[r, second], first, second, stop)
    where, start = np.nonzero(~gone)
    count = width - merges
    column = np.arange(len(where)) - np.repeat(count.cumsum() - count, count)
    done_piece, done_start = np.full((n, width), -1, np.int32), np.zeros((n, width), np.int32)
    done_piece[where, column], done_start[where, column] = piece[where, start], start
    return done_piece, done_start, count, made


class Spelled:
    """Ids of ``n`` chunks, one behind the other; characters without a piece are byte pieces."""

    def __init__(self, pieces: Pieces, n: int) -> None:
        self.pieces, self.flat, self.filled = pieces, [], 0
        self.begin, self.count = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def add(self, rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.flat.append(ids)
        self.begin[rows], self.count[rows] = self.filled + counts.cumsum() - counts, counts
        self.filled += len(ids)

    def add_one(self, row: int, chunk: str, found: list[tuple[int, int]]) -> None:
        ids = np.array([i for p, s in found for i in ([p] if p >= 0 else [self.pieces.byte[b] for b in chunk[s].encode()])], np.int32)
        self.add(np.array([row]), ids, np.array([len(ids)]))

    def add_short(self, rows: np.ndarray, chunks: Sequence[str], piece: np.ndarray, start: np.ndarray, counts: np.ndarray) -> None:
        within = np.arange(piece.shape[1]) < counts[:, None]
        plain = ((piece >= 0) | ~within).all(axis=1)
        self.add(rows[plain], piece[plain][within[plain]], counts[plain])
        for k in np.nonzero(~plain)[0].tolist():
            self.add_one(int(rows[k]), chunks[k], list(zip(piece[k, :counts[k]].tolist(), start[k].tolist())))

    def ids(self) -> np.ndarray:
        return np.concatenate([*self.flat, np.empty(0, np.int32)])


def _codes(chunks: Sequence[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(-1, width).astype(np.int64)


def encode_chunks(pieces: Pieces, chunks: Sequence[str], variants: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, begin, count): where the ids of each (chunk, variant) lie; each is encoded by itself."""
    length = np.fromiter(map(len, chunks), np.int64, len(chunks))
    out = Spelled(pieces, len(chunks))
    for width in np.unique(length[length <= SHORT]).tolist():
        some = np.nonzero(length == width)[0]
        here = [chunks[i] for i in some.tolist()]
        codes = _codes(here, width)
        out.add_short(some, here, *encode_short(pieces, codes, _keys(codes.astype(np.uint64), variants[some], seed), dropout)[:3])
    for i in np.nonzero(length > SHORT)[0].tolist():
        out.add_one(i, chunks[i], encode_long(pieces, chunks[i], chunk_key(chunks[i], int(variants[i]), seed), dropout))
    return out.ids(), out.begin, out.count


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions begin, begin + 1, ... of every row, ``count`` each, row after row."""
    stop = count.cumsum()
    return np.repeat(begin - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)


def encode_occurrences(pieces: Pieces, chunks: Sequence[str], code: np.ndarray, variants: np.ndarray, seed: int, dropout: float
                       ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``encode_chunks`` gives for chunk ``code`` and variant of every occurrence, with the work shared among equals."""
    length = np.fromiter(map(len, chunks), np.int64, len(chunks))
    begin, count, flat, filled = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64), [], 0
    of_length = length[code]
    for width in np.unique(length[length <= SHORT]).tolist():
        held = np.nonzero(length == width)[0]
        codes = _codes([chunks[i] for i in held.tolist()], width)
        todo = np.nonzero(of_length == width)[0]  # occurrences still without ids
        row = np.searchsorted(held, code[todo])  # the chunk of each, as a row of codes
        key = _keys(codes[row].astype(np.uint64), variants[todo], seed)
        node, first = row, np.arange(len(held))  # chunks with merges left out; of each one its chunk
        left_out = np.zeros((len(held), 0), np.uint64)
        while len(todo):
            piece, start, counts, made = encode_short(pieces, codes[first], None, 0.0, left_out)
            out = Spelled(pieces, len(first))
            out.add_short(np.arange(len(first)), [chunks[i] for i in held[first].tolist()], piece, start, counts)
            merges = width - counts
            each = merges[node]
            place = made.ravel()[_ragged(node * made.shape[1], each)]
            skip = _skipped_at(key.repeat(each), place, dropout) if dropout > 0 else np.zeros(len(place), bool)
            who = np.repeat(np.arange(len(todo)), each)[skip]
            again = np.bincount(who, minlength=len(todo))
            done = again == 0
            begin[todo[done]], count[todo[done]] = filled + out.begin[node[done]], out.count[node[done]]
            flat.append(out.ids())
            filled += out.filled
            # the others leave out what they skip; who leaves out the same is one node
            more = np.zeros((len(todo), int(again.max(initial=0))), np.uint64)
            more[who, np.arange(len(who)) - np.repeat(again.cumsum() - again, again)] = place[skip]
            todo, row, key, more, node = todo[~done], row[~done], key[~done], more[~done], node[~done]
            if len(todo):
                name = mixed(node.astype(np.uint64) + np.uint64(1))
                for k in range(more.shape[1]):
                    name = mixed(name ^ more[:, k])
                _, one, inverse = np.unique(name, return_index=True, return_inverse=True)
                left_out = np.concatenate([left_out[node[one]], more[one]], axis=1)
                first, node = row[one], inverse
    long = np.nonzero(of_length > SHORT)[0]
    out = Spelled(pieces, len(long))
    for k, i in enumerate(long.tolist()):
        chunk = chunks[code[i]]
        out.add_one(k, chunk, encode_long(pieces, chunk, chunk_key(chunk, int(variants[i]), seed), dropout))
    begin[long], count[long] = filled + out.begin, out.count
    return np.concatenate([*flat, out.ids()]), begin, count


def encode_texts(pieces: Pieces, texts: Sequence[str | None], names: np.ndarray, dropout: float = DROPOUT, variants: int = VARIANTS,
                 seed: int = SEED) -> list[np.ndarray]:
    """Ids of each text; ``names`` are the documents' numbers."""
    split = [CHUNK.findall(" " + t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = sizes.cumsum()
    if not len(ends) or not ends[-1]:
        return [np.empty(0, np.int32) for _ in texts]
    chunks = list(chain.from_iterable(split))
    distinct = list(dict.fromkeys(chunks))
    number = {c: i for i, c in enumerate(distinct)}
    code = np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks))
    del split, chunks, number
    place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    draw = mixed(mixed(names.astype(np.int64).view(np.uint64) ^ np.uint64(seed)).repeat(sizes) ^ place.astype(np.uint64))
    variant = (draw % np.uint64(variants)).astype(np.int64) if dropout > 0 else np.zeros(len(draw), np.int64)
    flat, begin, each = encode_occurrences(pieces, distinct, code, variant, seed, dropout)
    stop = each.cumsum()
    ids = flat[_ragged(begin, each)]
    bounds = np.concatenate([[0], stop])[np.concatenate([[0], ends])]
    return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def decode_ids(pieces: Pieces, ids: Sequence[int]) -> str:
    """The text of ids: the inverse of ``encode_texts`` whatever was skipped."""
    return b"".join(map(pieces.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, model: bytes, dropout: float = DROPOUT, variants: int = VARIANTS, seed: int = SEED) -> DataFrame:
    """doc_id, token_ids, n_tokens, and lossless (whether the ids decode to the text) of (doc_id, text)."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model)
        for batch in batches:
            names, texts = batch["doc_id"], batch["text"].tolist()
            numbers = names.fillna(0).to_numpy(np.int64)
            # some of the batch at a time: what is held besides it stays bounded
            load = np.fromiter((len(t or "") for t in texts), np.int64, len(texts)).cumsum() // TEXT_AT_ONCE
            cuts = [0, *(np.nonzero(np.diff(load))[0] + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                found = encode_texts(pieces, texts[a:b], numbers[a:b], dropout, variants, seed)
                same = [decode_ids(pieces, i.tolist()) == (t or "") for i, t in zip(found, texts[a:b])]
                yield pd.DataFrame({"doc_id": names[a:b], "token_ids": found, "n_tokens": [len(i) for i in found], "lossless": same})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(
        rows, "doc_id bigint, token_ids array<int>, n_tokens int, lossless boolean")


def decode(tokens: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of (doc_id, token_ids); null ids are empty text."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [decode_ids(pieces, () if i is None else i.tolist()) for i in batch["token_ids"]]})

    return tokens.select("doc_id", "token_ids").mapInPandas(rows, "doc_id bigint, text string")
