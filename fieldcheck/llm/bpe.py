"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pieces are found without a regular expression. Every code point gets a class, contractions and the
ends of white space are marked by comparing shifted arrays, and a small automaton decides where
pieces start. Transition functions compose associatively: blocks of the text are folded to one
function each, all blocks at once, a scan over the blocks gives each one's entry state, and a second
sweep marks the starts. The byte slices between them go through a cache to pair merging; the starts
are kept, so that any piece can be decoded in place.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fieldcheck.llm.common import map_batches, query, table, texts
from fieldcheck.llm.slices import gather, hash_slices

# Classes of code points and symbols of the automaton.
LETTER, NUMBER, OTHER, SHORT2, SHORT3, CLOSED, JOINING = range(7)
# States: in a run of letters, numbers or others; one or two characters of a contraction to come;
# the next character starts a piece; a space that belongs to the next character.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_MORE, TWO_MORE, FRESH, JOINED = range(7)
STATES, SYMBOLS, BLOCK = 7, 7, 64
#: White space of Unicode, fixed by the standard: ranges with both ends.
WHITE = ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
         (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Pieces the cache holds before it is emptied: bounds a worker's memory, changes no result.
CACHE = 300_000
_LONG, _NONE = 96, 1 << 40


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point; CLOSED stands for white space."""
    table_ = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table_[c] = LETTER
        elif kind == "N":
            table_[c] = NUMBER
    for lo, hi in WHITE:
        table_[lo : hi + 1] = CLOSED
    return table_


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece starts here" by symbol and state; symbols from SYMBOLS on open a text."""
    own = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT2: ONE_MORE, SHORT3: TWO_MORE,
           CLOSED: FRESH, JOINING: JOINED}
    after = np.zeros((2 * SYMBOLS, STATES), np.intp)
    starts = np.zeros((2 * SYMBOLS, STATES), bool)
    for symbol in range(SYMBOLS):
        for state in range(STATES):
            plain = OTHER if symbol in (SHORT2, SHORT3) else symbol
            if symbol in (CLOSED, JOINING):
                after[symbol, state], starts[symbol, state] = own[symbol], True
            elif state in (ONE_MORE, TWO_MORE):
                after[symbol, state] = FRESH if state == ONE_MORE else ONE_MORE
            elif state == JOINED or state == own[plain]:
                after[symbol, state] = own[plain]
            else:
                after[symbol, state], starts[symbol, state] = own[symbol], True
        after[symbol + SYMBOLS] = own[symbol]
        starts[symbol + SYMBOLS] = True
    return after, starts


@lru_cache(maxsize=1)
def functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of transition functions, as numbers: that of each symbol, their product table
    (first function times second), and the state each one leads to from FRESH."""
    after, _ = automaton()
    known: dict[tuple[int, ...], int] = {tuple(range(STATES)): 0}
    for row in after:
        known.setdefault(tuple(row), len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for row in after:
            product = tuple(row[list(f)])
            if product not in known:
                known[product] = len(known)
                todo.append(product)
    table_ = np.array([[known[tuple(g[i] for i in f)] for g in known] for f in known], np.intp)
    return np.array([known[tuple(row)] for row in after]), table_, np.array([f[FRESH] for f in known])


def piece_starts(codes: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Marks the code points where a piece starts; `opens` marks the first code point of each text."""
    n = len(codes)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[codes]
    white = kind == CLOSED
    last = np.append(opens[1:], True)  # of its text
    follows = np.append(~white[1:], False) & ~last  # by something that isn't white space
    symbol = kind.copy()
    symbol[(codes == 32) & follows] = JOINING
    ticks = np.flatnonzero((codes == 39) & ~last)
    if len(ticks):
        one = codes[ticks + 1]
        symbol[ticks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT2
        far = (ticks + 2 < n) & ~last[ticks + 1]
        ticks, one = ticks[far], one[far]
        two = codes[ticks + 2]
        long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (two == ord("l")) & (one == ord("l"))
        symbol[ticks[long]] = SHORT3
    symbol[opens] += SYMBOLS

    of_symbol, product, from_fresh = functions()
    after, starts = (x.ravel() for x in automaton())
    blocks, wide = -(-n // BLOCK), len(product)
    flat = product.ravel()
    grid = np.full(blocks * BLOCK, CLOSED, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    whole = np.zeros(blocks, np.intp)  # the identity
    for row in grid:
        whole = flat[whole * wide + of_symbol[row]]
    step = 1  # after the scan, whole[b] is the function of all blocks up to b
    while step < blocks:
        whole = np.concatenate([whole[:step], flat[whole[:-step] * wide + whole[step:]]])
        step *= 2
    state = np.concatenate([[FRESH], from_fresh[whole[:-1]]])
    found = np.empty((BLOCK, blocks), bool)
    for j, row in enumerate(grid):
        index = row * np.intp(STATES) + state
        found[j] = starts[index]
        state = after[index]
    found = found.T.ravel()[:n]
    # White space goes on with white space before it, but for the last one before another character.
    before = np.concatenate([[False], white[:-1]]) & ~opens
    found[white & before & ~follows] = False
    return found


# --- merging ------------------------------------------------------------------------------------


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """Merges the bytes of many pieces at once; one merge a piece and round, the lowest rank first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        pairs = {
            (ranks[t[:i]] << 20) + ranks[t[i:]]: rank
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([*(pairs[k] for k in sorted(pairs)), _NONE], np.int64)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the two ids' joined bytes; _NONE if they have none."""
        key = (left << 20) + right
        at = np.searchsorted(self.keys, key)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == key
        return np.where(known, self.joined[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: neighbours of lowest rank are joined, the leftmost first, until none has a rank."""
        out: list[list[int]] = [[]] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = [whole]
            elif len(piece) > _LONG:
                out[i] = _merge_long(piece, self.ranks)
            else:
                by_width.setdefault(-(-len(piece) // 8) * 8, []).append(i)
        for width, which in by_width.items():
            ids, counts = self._together([pieces[i] for i in which], width)
            flat, at = ids.tolist(), 0
            for i, n in zip(which, counts.tolist(), strict=True):
                out[i] = flat[at : at + n]
                at += n
        return out

    def _together(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        filled = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        column = np.arange(width)
        live = column < size[:, None]
        ids = np.where(live, self.bytes[filled], -1)
        after = np.tile(column + 1, (n, 1))
        before = np.tile(column - 1, (n, 1))
        rank = np.full((n, width), _NONE)
        inner = column[:-1] + 1 < size[:, None]
        rank[:, :-1][inner] = self.pair(ids[:, :-1][inner], ids[:, 1:][inner])
        row = np.arange(n)
        while len(row):
            i = rank[row].argmin(1)
            best = rank[row, i]
            go = best < _NONE
            row, i, best = row[go], i[go], best[go]
            if not len(row):
                break
            j = after[row, i]
            k = after[row, j]
            ids[row, i], rank[row, j], live[row, j], after[row, i] = best, _NONE, False, k
            inside = k < size[row]
            rank[row, i] = _NONE
            r, a, b = row[inside], i[inside], k[inside]
            before[r, b] = a
            rank[r, a] = self.pair(ids[r, a], ids[r, b])
            h = before[row, i]
            r, a, b = row[h >= 0], h[h >= 0], i[h >= 0]
            rank[r, a] = self.pair(ids[r, a], ids[r, b])
        return ids[live], live.sum(1)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over linked neighbours: n log n for pieces of any length."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := end[i]) < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if end[i] < 0 or (j := end[i]) >= n or end[j] != stop:
            continue  # one of the two has been joined meanwhile
        end[i], end[j] = stop, -1
        if stop < n:
            before[stop] = i
        offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes with one vocabulary, batch by batch."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.merger = Merger(ranks)
        tokens = {i: t for t, i in ranks.items()}
        ordered = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(ordered), np.uint8)
        self.token_cuts = np.concatenate([[0], np.cumsum([len(t) for t in ordered])])
        digits = [b"%d," % i for i in range(len(ordered))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_cuts = np.concatenate([[0], np.cumsum([len(t) for t in digits])])
        self.cache: dict[bytes, list[int]] = {}

    def pieces(self, batch: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' UTF-8 bytes, where pieces start (and the end), and for each text its first byte and piece."""
        sizes = np.array([len(t) for t in batch], np.int64)
        ends = np.cumsum(sizes)
        whole = "".join(batch)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        opens = np.zeros(len(codes), bool)
        opens[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(piece_starts(codes, opens))
        width = np.ones(len(codes), np.int8)
        far = np.flatnonzero(codes > 0x7F)
        width[far] += 1 + (codes[far] > 0x7FF).astype(np.int8) + (codes[far] > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        bounds = np.concatenate([[0], ends])
        return whole.encode(), np.append(at[starts], at[-1]), at[bounds], np.searchsorted(starts, bounds)

    def ids_of(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; what the cache lacks is merged together."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        get = self.cache.get
        got = [get(p) for p in pieces]
        lacking = [i for i, g in enumerate(got) if g is None]
        for i, ids in zip(lacking, self.merger.merge([pieces[i] for i in lacking]), strict=True):
            got[i] = ids
            if len(pieces[i]) <= _LONG:
                self.cache[pieces[i]] = ids
        return got

    def encode(self, batch: list[str]) -> Encoded:
        """All texts' ids and piece starts in flat arrays."""
        data, cuts, text_bytes, first = self.pieces(batch)
        raw, none = np.frombuffer(data, np.uint8), np.zeros(len(batch) + 1, np.int64)
        if not len(raw):
            return Encoded(raw, none, np.zeros(0, np.int64), none, cuts, first)
        which, distinct = pd.factorize(hash_slices(raw, cuts[:-1], cuts[1:]))
        example = np.empty(len(distinct), np.int64)
        example[which[::-1]] = np.arange(len(which))[::-1]
        got = self.ids_of([data[a:b] for a, b in zip(cuts[example].tolist(), cuts[example + 1].tolist(), strict=True)])
        offsets = np.concatenate([[0], np.cumsum([len(g) for g in got])])
        ids, ends = gather(np.fromiter(chain.from_iterable(got), np.int64, offsets[-1]), offsets, which)
        if not np.array_equal(self.decode(ids)[0], raw):  # two pieces share a hash: take each piece by itself
            got = self.ids_of([data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
            ends = np.concatenate([[0], np.cumsum([len(g) for g in got])])
            ids = np.fromiter(chain.from_iterable(got), np.int64, ends[-1])
        return Encoded(raw, text_bytes, ids, ends[first], cuts, first)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and the offsets that cut them into tokens."""
        return gather(self.token_bytes, self.token_cuts, ids)

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids as decimal numbers, a comma after each, and the offsets of the numbers."""
        return gather(self.digits, self.digit_cuts, ids)


@dataclass(frozen=True)
class Encoded:
    """A batch: text i has bytes raw[texts[i]:texts[i + 1]], ids[tokens[i]:tokens[i + 1]] and the pieces that
    start at cuts[pieces[i]:pieces[i + 1]]."""

    raw: np.ndarray
    texts: np.ndarray
    ids: np.ndarray
    tokens: np.ndarray
    cuts: np.ndarray
    pieces: np.ndarray

    def id_lists(self) -> pa.Array:
        return pa.ListArray.from_arrays(self.tokens.astype(np.int32), pa.array(self.ids, pa.int32()))

    def piece_lists(self) -> pa.Array:
        """Byte offsets of each text's pieces within it."""
        counts = np.diff(self.pieces)
        inner = self.cuts[: self.pieces[-1]] - np.repeat(self.texts[:-1], counts)
        return pa.ListArray.from_arrays(self.pieces.astype(np.int32), pa.array(inner, pa.int64()))


_codecs: dict[str, Codec] = {}


def _codec(ranks) -> Codec:
    """One codec for each broadcast vocabulary and worker."""
    key = str(ranks.value[0])
    if key not in _codecs:
        _codecs[key] = Codec(dict(ranks.value[1]))
    return _codecs[key]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary for the workers: its size is that of the file, whatever the data."""
    return spark.sparkContext.broadcast((path, load_ranks(path)))


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- the operator -------------------------------------------------------------------------------


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The given rows with n_tokens, ids and piece_offsets (first byte of each piece in the text) besides.

    A null text is empty and has no ids. Null and repeated doc_ids are rows like others; other columns
    are handed on, those with the new names replaced. Special tokens are ordinary text.
    """
    ranks = vocabulary(docs.sparkSession, path)
    docs = docs.drop("n_tokens", "ids", "piece_offsets")

    def work(batch: pa.RecordBatch):
        done = _codec(ranks).encode(texts(batch.column("text")))
        added = {
            "n_tokens": pa.array(np.diff(done.tokens), pa.int64()),
            "ids": done.id_lists(),
            "piece_offsets": done.piece_lists(),
        }
        yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])

    added = "n_tokens bigint, ids array<int>, piece_offsets array<bigint>"
    fields = StructType([*docs.schema.fields, *StructType.fromDDL(added).fields])
    return map_batches(docs, work, fields)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256. Nulls as in `encode`."""
    ranks = vocabulary(docs.sparkSession, path)

    def work(batch: pa.RecordBatch):
        codec = _codec(ranks)
        done = codec.encode(texts(batch.column("text")))
        back, byte_cuts = codec.decode(done.ids)
        numbers, number_cuts = codec.decimals(done.ids)
        ids_sha, decoded_sha = [], []
        for a, b in zip(done.tokens[:-1].tolist(), done.tokens[1:].tolist(), strict=True):
            ids_sha.append(hashlib.sha256(numbers[number_cuts[a] : number_cuts[b] - (b > a)]).hexdigest())
            decoded_sha.append(hashlib.sha256(back[byte_cuts[a] : byte_cuts[b]]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(done.tokens), pa.int64()),
                pa.array(ids_sha, pa.string()),
                pa.array(decoded_sha, pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(
        docs.select("doc_id", "text"),
        work,
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_vocabulary())
