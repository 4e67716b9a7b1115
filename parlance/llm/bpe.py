"""Operator 1: byte-level BPE encoding and decoding by merge replay over the distinct pieces of a block of texts.

A task collects the distinct pieces of its block, lays them out as one array of byte tokens and keeps an inverted index
from merged token to the places where its pair stands. Merges are applied in rank order; each touches only the two
neighbours of its place. Pieces don't touch each other, so a block gives the ids that any other division would give.

Nulls count as empty texts; an empty text has no ids and decodes to no bytes. No shuffle; a task holds one block
(`BLOCK_BYTES` of input, at least one Arrow batch). A piece without blanks of any length is linear in its merges.
"""

from __future__ import annotations

import base64
import heapq
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parlance.llm.shared import append_columns, by_bytes, slices

#: Bytes of input whose distinct pieces are replayed together.
BLOCK_BYTES = 3 << 20
#: Bytes of packed ids decoded at once.
DECODE_BYTES = 2 << 20
#: Fewer places of a merge than this are worked on one by one.
FEW_PLACES = 24
_SHIFT = 20
#: Runs of white space that a cut before every single blank could divide differently from the pattern.
_AMBIGUOUS = re.compile(r" (?: |\s(?<=\s \s))")
#: Marks that the pattern takes alone after letters.
_CLOSING = frozenset(".,;:!?")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file of lines `base64 rank`; read on the driver and sent with the tasks (bounded by the vocabulary)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Replay:
    """The pair table of a vocabulary, and the replay of its merges over pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << _SHIFT | right] = rank
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is None:
                rest.append(i)
            else:
                out[i] = whole.to_bytes(4, "little")
        if rest:
            for i, ids in zip(rest, self._merge([pieces[i] for i in rest])):
                out[i] = ids
        return out

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(data)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(lengths)
        tokens = self.single[data]
        first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        nonempty = lengths > 0
        last[ends[nonempty] - 1] = True
        first[(ends - lengths)[nonempty]] = True
        after = np.where(last, -1, np.arange(1, n + 1)).astype(np.int32)
        before = np.where(first, -1, np.arange(-1, n - 1)).astype(np.int32)
        keys = tokens << _SHIFT | np.append(tokens[1:], 0)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1) if len(self.keys) else np.zeros(n, dtype=np.int64)
        found = (self.keys[at] == keys) & ~last if len(self.keys) else np.zeros(n, dtype=bool)
        pair_rank = np.where(found, self.values[at] if len(self.keys) else -1, -1)
        places = np.flatnonzero(found).astype(np.int32)
        order = places[np.argsort(pair_rank[places], kind="stable")]
        present, starts = np.unique(pair_rank[order], return_index=True)
        index = {rank: [part] for rank, part in zip(present.tolist(), np.split(order, starts[1:]))}
        later: dict[int, list[int]] = {}
        table = tuple(np.ascontiguousarray(x, dtype=np.int32) for x in (tokens, after, before, pair_rank, np.zeros(n)))
        views = tuple(map(memoryview, table))
        pair_rank = table[3]
        piece_starts = (ends - lengths)[nonempty]
        later: dict[int, list] = {}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank, []) + later.pop(rank, [])
            spots = parts[0] if len(parts) == 1 and not isinstance(parts[0], int) else np.unique(np.concatenate([np.atleast_1d(x) for x in parts]))
            spots = spots[pair_rank[spots] == rank]
            if len(spots) < FEW_PLACES:
                made = self._one_by_one(rank, spots.tolist(), views)
            else:
                made = self._together(rank, spots, table, views, piece_starts)
            for new, part in made:
                if new not in later:
                    later[new] = []
                    if new not in index:
                        heapq.heappush(heap, new)
                later[new].append(part)
        tok, dead = table[0], table[4]
        alive = dead == 0
        ids = tok[alive].astype("<u4").tobytes()
        counts = np.concatenate([[0], np.cumsum(alive)])
        bounds = counts[np.concatenate([[0], ends])] * 4
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the vocabulary has none."""
        keys = left.astype(np.int64) << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def _one_by_one(self, rank: int, spots: list[int], views) -> list[tuple[int, int]]:
        """Merge at each place, from left to right; returns (rank, place) of the new pairs."""
        tok, nxt, prv, pr, dead = views
        get, made = self.pairs.get, []
        for p in spots:
            if pr[p] != rank:
                continue
            q = nxt[p]
            behind, ahead = prv[p], nxt[q]
            tok[p], nxt[p], pr[q], dead[q] = rank, ahead, -1, 1
            right = left = None
            if ahead >= 0:
                prv[ahead] = p
                right = get(rank << _SHIFT | tok[ahead])
            pr[p] = -1 if right is None else right
            if behind >= 0:
                left = get(tok[behind] << _SHIFT | rank)
                pr[behind] = -1 if left is None else left
            if (right is not None and right < rank) or (left is not None and left < rank):
                # A vocabulary may rank a longer token before its part: then this piece goes on by itself at once.
                self._finish(p, tok, nxt, prv, pr, dead)
                continue
            if right is not None:
                made.append((right, p))
            if left is not None:
                made.append((left, behind))
        return made

    def _together(self, rank: int, spots: np.ndarray, table, views, piece_starts: np.ndarray) -> list[tuple[int, object]]:
        """The same for many places at once; pieces in which the order of merges could matter go one by one."""
        tok, nxt, prv, pr, dead = table
        # Places that overlap (aaa) form runs; from the left, every second one merges.
        linked = np.concatenate([[False], nxt[spots[:-1]] == spots[1:]])
        if linked.any():
            run_start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(spots))))
            spots = spots[(np.arange(len(spots)) - run_start) % 2 == 0]
        q = nxt[spots]
        ahead, behind = nxt[q], prv[spots]
        to_right, to_left = ahead >= 0, behind >= 0
        lower = np.zeros(len(spots), dtype=bool)
        passing = self._lookup(np.full(int(to_right.sum()), rank), tok[ahead[to_right]])
        lower[to_right] |= (passing >= 0) & (passing < rank)
        passing = self._lookup(tok[behind[to_left]], np.full(int(to_left.sum()), rank))
        lower[to_left] |= (passing >= 0) & (passing < rank)
        after_self = self.pairs.get(rank << _SHIFT | rank)
        if after_self is not None and after_self < rank:
            lower |= True
        made = []
        if lower.any():
            piece = np.searchsorted(piece_starts, spots, side="right")
            apart = np.isin(piece, piece[lower])
            made = self._one_by_one(rank, spots[apart].tolist(), views)
            spots, q, ahead, behind, to_right, to_left = (x[~apart] for x in (spots, q, ahead, behind, to_right, to_left))
        tok[spots], nxt[spots], pr[q], dead[q], pr[spots] = rank, ahead, -1, 1, -1
        prv[ahead[to_right]] = spots[to_right]
        behind = prv[spots]
        to_left = behind >= 0
        places = np.concatenate([spots[to_right], behind[to_left]])
        new = self._lookup(tok[places], tok[nxt[places]])
        pr[places] = new
        places, new = places[new >= 0], new[new >= 0]
        order = np.argsort(new, kind="stable")
        ranks, starts = np.unique(new[order], return_index=True)
        return made + list(zip(ranks.tolist(), np.split(places[order], starts[1:])))

    def _finish(self, place: int, tok, nxt, prv, pr, dead) -> None:
        """All remaining merges of the piece around `place`, lowest rank and leftmost first."""
        start = place
        while prv[start] >= 0:
            start = prv[start]
        heap, p = [], start
        while p >= 0:
            if pr[p] >= 0:
                heap.append((pr[p], p))
            p = nxt[p]
        heapq.heapify(heap)
        while heap:
            rank, p = heapq.heappop(heap)
            if pr[p] != rank:
                continue
            q = nxt[p]
            behind, ahead = prv[p], nxt[q]
            tok[p], nxt[p], pr[q], dead[q] = rank, ahead, -1, 1
            if ahead >= 0:
                prv[ahead] = p
            for left, right in ((p, ahead), (behind, p)):
                if left >= 0:
                    new = self.pairs.get(tok[left] << _SHIFT | tok[right]) if right >= 0 else None
                    pr[left] = -1 if new is None else new
                    if new is not None:
                        heapq.heappush(heap, (new, left))
        p = start
        while p >= 0:
            pr[p] = -1
            p = nxt[p]


def split_at_blanks(text: str) -> list[str] | None:
    """Parts of a text that the pattern never joins, or None where its white space needs the whole text.

    A match starts at every single blank between other characters, so what follows such a blank is split alone. The
    parts stand without their blank; the first part, which has none, is marked by a leading NUL.
    """
    if "\0" in text or _AMBIGUOUS.search(text):
        return None
    parts = text.split(" ")
    parts[0] = "\0" + parts[0]
    return parts


def split_part(part: str, pattern) -> list[bytes]:
    """The pattern's matches in one part, as bytes; plain words with or without a closing mark need no pattern."""
    if part.isalpha():
        return [b" " + part.encode()]
    if part[-1:] in _CLOSING and part[:-1].isalpha():
        return [b" " + part[:-1].encode(), part[-1].encode()]
    own = part[1:] if part[:1] == "\0" else " " + part
    return [m.encode("utf-8", "surrogatepass") for m in pattern.findall(own)]


def encode_block(texts: list[str], replay: Replay, pattern) -> list[bytes]:
    """Ids of every text; distinct parts are split, and distinct pieces merged, once."""
    number = defaultdict(count().__next__)
    places: list = []
    pieces: dict[bytes, bytes] = {}
    for text in texts:
        parts = split_at_blanks(text)
        if parts is None:
            places.append([m.encode("utf-8", "surrogatepass") for m in pattern.findall(text)])
            pieces.update(dict.fromkeys(places[-1], b""))
        else:
            places.append(np.fromiter(map(number.__getitem__, parts), dtype=np.int32, count=len(parts)))
    split = [split_part(part, pattern) for part in number]
    for own in split:
        for piece in own:
            pieces[piece] = b""
    distinct = list(pieces)
    ids = dict(zip(distinct, replay.encode(distinct)))
    packed = [ids[own[0]] if len(own) == 1 else b"".join([ids[x] for x in own]) for own in split]
    return [b"".join(map(ids.__getitem__, own) if isinstance(own, list) else map(packed.__getitem__, own.tolist())) for own in places]


def as_lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"), pa.int32()))


def decode_ids(packed: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join([tokens[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])


@lru_cache(1)
def replay_of(table: bytes) -> tuple[Replay, dict[int, bytes]]:
    """One for each Python worker: the replay of a vocabulary, and the bytes of its ids."""
    ranks = pickle.loads(table)
    return Replay(ranks), {rank: token for token, rank in ranks.items()}


def encode(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, packed: bool = True, decodes: str | None = None, drop_text: bool = False
) -> DataFrame:
    """df with `ids` (binary: little-endian unsigned 32-bit integers, or array<int> if not packed) and `n_tokens` long.

    Each match of `pattern` is encoded separately, without special tokens. Columns of these names are replaced. With
    `decoded` the ids are decoded again at once, into a binary column of that name; `decode` does so for stored ids. With
    `decodes` a boolean column says whether they decode to the text. With `drop_text` the text doesn't come back.
    """
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(ranks))
    place = df.schema.fieldNames().index(text)

    def make(batches: Iterator[pa.RecordBatch]):
        import regex

        (replay, tokens), compiled = replay_of(shared.value), regex.compile(pattern)
        for block in by_bytes(batches, BLOCK_BYTES):
            texts = [t or "" for batch in block for t in batch.column(place).to_pylist()]
            coded = encode_block(texts, replay, compiled)
            same = [decode_ids(x, tokens) == t.encode("utf-8", "surrogatepass") for x, t in zip(coded, texts)] if decodes else []
            at = 0
            for batch in block:
                own = coded[at : at + batch.num_rows]
                columns = [pa.array(own, pa.binary()) if packed else as_lists(own), pa.array([len(x) // 4 for x in own], pa.int64())]
                if decoded:
                    columns.append(pa.array([decode_ids(x, tokens) for x in own], pa.binary()))
                if decodes:
                    columns.append(pa.array(same[at : at + batch.num_rows], pa.bool_()))
                at += batch.num_rows
                yield batch, columns

    fields = [T.StructField(ids, T.BinaryType() if packed else T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType()))
    if decodes:
        fields.append(T.StructField(decodes, T.BooleanType()))
    return append_columns(df, fields, make, [text] if drop_text else [])


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with `decoded` (binary): the bytes of packed ids; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(ranks))
    place = df.schema.fieldNames().index(ids)

    def make(batches: Iterator[pa.RecordBatch]):
        _, tokens = replay_of(shared.value)
        for batch in (part for whole in batches for part in slices(whole, DECODE_BYTES)):
            out = [None if x is None else decode_ids(x, tokens) for x in batch.column(place).to_pylist()]
            yield batch, [pa.array(out, pa.binary())]

    return append_columns(df, [T.StructField(decoded, T.BinaryType())], make)


def unpack(df: DataFrame, ids: str = "ids") -> DataFrame:
    """df with packed ids as array<int>."""
    place = df.schema.fieldNames().index(ids)

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in (part for whole in batches for part in slices(whole, DECODE_BYTES)):
            yield batch, [as_lists([x or b"" for x in batch.column(place).to_pylist()])]

    return append_columns(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)
