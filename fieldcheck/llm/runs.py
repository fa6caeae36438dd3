"""Periodic runs of words, found by block convolution.

At each dyadic scale B a text is cut into blocks, B words apart. The sum of squared differences between a
block and every place of the window that follows it comes from one correlation, computed by a number
theoretic transform modulo a prime: exact integers, so a place without a mismatch always sums to zero. The
distance between the block and such a place is a candidate period between B and 2 B; it seeds an extension
to both sides. A run of period q holds at least three periods, so a block of the scale q belongs to lies in
it together with its next occurrence: no run is missed. What the modulus lets through by chance is dropped
by comparing the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.llm.common import map_batches, mixed, query, table
from fieldcheck.llm.language_id import id_crc

#: Shortest run in words, and in periods.
LEAST, TIMES = 24, 3
#: The transforms' prime, 2**16 + 1, of which 3 is a generator; the extensions' prime.
PRIME, GENERATOR = 65537, 3
EXTEND_PRIME = np.uint64((1 << 31) - 1)
#: The smallest scale, which takes all periods below 16, and the longest block; longer scales just space blocks wider.
FIRST, LONGEST = 8, 1024
#: Cells of one batch of transforms: bounds the memory, however long a text is.
CELLS = 1 << 17
#: Words compared at once when runs are verified.
COMPARED = 1 << 22


# --- exact correlation --------------------------------------------------------------------------


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo the prime, between its negative and positive half; whole numbers in float64 stay exact."""
    return x - PRIME * np.rint(x * (1 / PRIME))


@cache
def _power_table(size: int, rows: int, columns: int, inverse: bool) -> np.ndarray:
    """Entry (i, j): the size-th root of unity to the power i * j."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    powers = np.array([pow(root, i, PRIME) for i in range(size)], np.float64)
    return _reduced(powers[np.outer(np.arange(rows), np.arange(columns)) % size])


def _split(size: int) -> tuple[int, int]:
    first = 1 << (size.bit_length() - 1) // 2 if size > 64 else 1
    return first, size // first


def transform(x: np.ndarray, inverse_root: bool = False) -> np.ndarray:
    """Number theoretic transform of each row; frequencies are left in the order that `back` takes."""
    rows, size = x.shape
    first, second = _split(size)
    x = x.reshape(rows, first, second)
    if first > 1:
        x = _reduced(np.matmul(_power_table(first, first, first, inverse_root), x))
        x = _reduced(x * _power_table(size, first, second, inverse_root))
    return _reduced(x @ _power_table(second, second, second, inverse_root)).reshape(rows, size)


def back(x: np.ndarray) -> np.ndarray:
    """The rows whose transforms these are."""
    rows, size = x.shape
    first, second = _split(size)
    x = _reduced(x.reshape(rows, first, second) @ _power_table(second, second, second, True))
    if first > 1:
        x = _reduced(x * _power_table(size, first, second, True))
        x = _reduced(np.matmul(_power_table(first, first, first, True), x))
    return _reduced(x.reshape(rows, size) * float(pow(size, PRIME - 2, PRIME)))


def seeds(values: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places b and distances d: the block at b and the words d further on differ by zero, squared and summed.

    d is below 2 * scale, and at least scale if that is above FIRST. By the modulus a few may not be equal.
    """
    n = len(values)
    block = min(scale, LONGEST)
    if scale == FIRST:
        start = np.arange(0, n, scale)
        window, size, lags = start + 1, 32, 2 * FIRST - 1
    else:
        window = np.arange(scale, n, block)
        start, size, lags = scale * (window // scale - 1), 2 * block, block
    fits = window + block <= n
    start, window = start[fits], window[fits]
    padded = np.concatenate([values, np.zeros(size + block)])
    squares = np.concatenate([[0], np.cumsum((padded * padded).astype(np.int64) % PRIME)])
    places, distances = [], []
    step = max(1, CELLS // size)
    for i in range(0, len(start), step):
        b, w = start[i : i + step], window[i : i + step]
        blocks = np.zeros((len(b), size))
        blocks[:, :block] = padded[b[:, None] + np.arange(block)]
        windows = padded[w[:, None] + np.arange(size)]
        both = back(_reduced(transform(blocks, inverse_root=True) * transform(windows)))[:, :lags]
        at = w[:, None] + np.arange(lags)
        own = (squares[b + block] - squares[b]).astype(np.float64)
        other = (squares[at + block] - squares[at]).astype(np.float64)
        row, lag = np.nonzero(_reduced(own[:, None] + other - 2 * both) == 0)
        places.append(b[row])
        distances.append(w[row] + lag - b[row])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b, d = np.concatenate(places), np.concatenate(distances)
    inside = b + d + block <= n
    return b[inside], d[inside]


# --- extension ----------------------------------------------------------------------------------


class _Prefixes:
    """Polynomial hashes of all stretches: equal words, equal hash; unequal ones may agree by chance."""

    def __init__(self, words: np.ndarray, salt: int) -> None:
        n = len(words)
        base = np.uint64(1_000_003 + 2 * salt)
        self.powers = np.ones(n + 1, np.uint64)
        done = 1
        while done <= n:
            take = min(done, n + 1 - done)
            factor = self.powers[done - 1] * base % EXTEND_PRIME
            self.powers[done : done + take] = self.powers[:take] * factor % EXTEND_PRIME
            done += take
        value = mixed(words.astype(np.uint64) + np.uint64(salt << 40)) % EXTEND_PRIME
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * self.powers[:n] % EXTEND_PRIME)])
        self.sums = sums % EXTEND_PRIME

    def same(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Is the stretch [a, b) like the one d further on?"""
        near = (self.sums[b] + EXTEND_PRIME - self.sums[a]) * self.powers[d] % EXTEND_PRIME
        far = (self.sums[b + d] + EXTEND_PRIME - self.sums[a + d]) % EXTEND_PRIME
        return near % EXTEND_PRIME == far


def _stretches(hashes: _Prefixes, n: int, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest stretches around the places b that repeat at distance d: starts and ends."""
    left, right = b.copy(), b.copy()
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        to = np.minimum(right + step, n - d)
        fits = (right + step == to) & hashes.same(right, to, d)
        right[fits] += step
        to = np.maximum(left - step, 0)
        fits = (left - step == to) & hashes.same(to, left, d)
        left[fits] -= step
        step >>= 1
    return left, right + d


def _exact(words: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> bool:
    """Do these stretches have these periods, and does no neighbour go on with them?"""
    inner = s > 0
    if (words[s[inner] - 1] == words[s[inner] - 1 + q[inner]]).any():
        return False
    inner = e < len(words)
    if (words[e[inner]] == words[e[inner] - q[inner]]).any():
        return False
    i = 0
    sizes = np.cumsum(e - s - q)
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + COMPARED)))
        size = (e - s - q)[i:j]
        cuts = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(s[i:j] - cuts, size)
        if (words[at] != words[at + np.repeat(q[i:j], size)]).any():
            return False
        i = j
    return True


def _of_scale(words: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that the seeds of one scale lead to: starts, ends, smallest periods found."""
    salt = 0
    while True:
        drawn = mixed(words.astype(np.uint64) + np.uint64((salt << 40) + (1 << 39)))
        values = (drawn % np.uint64(PRIME)).astype(np.float64) - PRIME // 2
        b, d = seeds(values, scale)
        s, e = _stretches(_Prefixes(words, salt), len(words), b, d)
        good = e - s >= np.maximum(LEAST, TIMES * d)
        s, e, d = s[good], e[good], d[good]
        order = np.lexsort((d, e, s))
        s, e, d = s[order], e[order], d[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        s, e, d = s[new], e[new], d[new]
        if _exact(words, s, e, d):
            return s, e, d
        salt += 1  # two different stretches had one hash: others are drawn


def find(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of all texts, words given as numbers: text, start, length, period; by text, start, period."""
    sizes = np.diff(offsets)
    found = [np.zeros((4, 0), np.int64)]
    scale = FIRST
    while (own := np.flatnonzero(sizes >= max(LEAST, TIMES * (scale if scale > FIRST else 1)))).size:
        # the texts long enough one behind the other, each closed by a number of its own
        size = sizes[own] + 1
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(begin - offsets[own], size)
        line = words[np.minimum(at, len(words) - 1)].astype(np.int64)
        line[begin + size - 1] = len(words) + np.arange(len(own))
        s, e, d = _of_scale(line, scale)
        row = np.searchsorted(begin, s, "right") - 1
        found.append(np.stack([own[row], s - begin[row], e - s, d]))
        scale *= 2
    text, start, length, period = np.concatenate(found, 1)
    order = np.lexsort((period, length, start, text))
    text, start, length, period = (x[order] for x in (text, start, length, period))
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    text, start, length, period = (x[new] for x in (text, start, length, period))
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


# --- texts --------------------------------------------------------------------------------------


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts, and the offsets that cut them into texts; null texts are empty."""
    lists = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    values = lists.values
    real = pc.not_equal(pc.binary_length(values), 0)
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return values.filter(real), kept[lists.offsets.to_numpy()].astype(np.int64)


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest length / period; ties to the smallest start, then period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


SCHEMA = (
    "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


def detect(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of each row and its text's runs, with the collapsed text in digest and, for use, in full.

    A run is a stretch of words with smallest period q, at least max(24, 3 q) words long, that no
    neighbour extends. n_runs counts them; start, length, period and exponent_milli (floor(1000 * length /
    period)) tell the run of the greatest exponent and are null without runs. runs: all of them as an
    array; collapsed: the text with every word dropped that lies in a run behind its first period, joined
    by one blank; runs_sha256, collapsed_sha256: their digests. A null or empty text has no runs and an
    empty collapsed text. Repeated rows are rows like others. `keep` must not name a result column.
    """
    fields = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["runs", "collapsed"]
    if clash := sorted({*keep} & {*names}):
        raise ValueError(f"result columns cannot be kept columns: {clash}")
    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    row = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values, offsets = split(batch.column("text"))
        codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text, start, length, period = find(codes, offsets)
        edges = np.zeros(len(codes) + 1, np.int64)
        at = offsets[text] + start
        np.add.at(edges, at + period, 1)
        np.add.at(edges, at + length, -1)
        left = np.cumsum(edges[:-1]) == 0
        cuts = np.concatenate([[0], np.cumsum(left)])[offsets]
        kept = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values.filter(pa.array(left)))
        collapsed = pc.binary_join(kept, pa.scalar(" ", pa.large_string()))
        first = np.searchsorted(text, np.arange(batch.num_rows + 1))
        triples = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
        best, lines = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            best.append((*(m := _greatest(triples[a:b])), 1000 * m[1] // m[2]) if b > a else (None,) * 4)
            lines.append("".join(f"{s},{n},{q}\n" for s, n, q in triples[a:b]))
        digest = lambda column: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in column])
        columns = [batch.column(c) for c in keep] + [pa.array(np.diff(first), pa.int64())]
        columns += [pa.array(list(c), pa.int64()) for c in zip(*best, strict=True)]
        whole = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(row))
        columns += [digest(lines), digest(collapsed.to_pylist())]
        columns += [pa.ListArray.from_arrays(pa.array(first, pa.int32()), whole), collapsed.cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    rows = docs.select(*keep, *({"text"} - {*keep}))
    return map_batches(rows, work, f"{head}, {SCHEMA}, {fields}")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten (by the crc32 of its id) goes on in a period of its own words.

    A null id counts as an empty one; a null text stays null, one without words stays as it is.
    """
    h = id_crc("doc_id")
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = docs.select("doc_id", "text", g.alias("_g"), words.alias("_w")).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    copies = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), copies))
    planted = F.concat_ws(" ", F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), F.lit(1), F.col("_n")))
    return rows.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_repeats(table(spark, sf_dir, "documents"))
    return detect(docs, ["doc_id"]).drop("runs", "collapsed")
