"""N-gram Jaccard join: all texts whose sets of word n-grams overlap enough, as connected components.

Exact, and without comparing all pairs:

* Equal sets are one from the start. Every set is ordered alike: long n-grams first, those that tasks saw
  repeatedly last. So the first few n-grams of each set (enough that two similar sets must share some) are
  rare ones.
* Tiles are (n-gram, size band): sets of a tile have nearly the same size. A first round compares each
  set with one leader only, the set it shares most tiles with, and merges what is similar. A tile's leader
  is the set with the fewest n-grams before the tile's: the one with the least text of its own.
* A second round takes from the tiles the pairs that are still in different components, passes those
  that share enough of their first n-grams and whose places and sizes allow the overlap.
* Every pair is bounded first: bits that one hashed bitmap has and the other lacks stand for n-grams the
  other set lacks, so bit counts bound the overlap from above. What remains is intersected exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.llm.common import joined_bytes, map_batches, mixed, most_frequent, query, table, written
from fieldcheck.llm.slices import hash_slices, lowered, words

#: Pairs must share this many of their first n-grams (fewer if they are small). More of them make longer beginnings, in
#: which near copies that just miss the similarity meet after all; bitmaps settle what one shared n-gram leaves.
SHARED = 1
#: Repeated n-grams kept for the order, the most frequent ones: bounds the broadcast at 16 bytes each.
#: Any choice gives the same result; n-grams left out only make longer postings.
ORDERED = 1 << 17
#: Shingles counted together in a task before those seen REPEATED times are handed on.
COUNTED = 4 << 20
REPEATED = 3
#: A posting of this many sets or more is dealt to several tasks.
SPLIT = 8192
_WEIGHTS = [np.uint64(w) for w in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                                   0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


# --- sets of n-grams ----------------------------------------------------------------------------


def shingles(column: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct word n-grams, A-Z in lower case; long n-grams come first.

    A text of fewer words has one, of all its words; one without words (or null) has none. The upper 12 bits
    are 4095 less the bytes of the n-gram's words, as long n-grams are rarer; the other 52 are a hash.
    """
    raw, offsets = joined_bytes(column)
    raw = lowered(raw)
    starts, ends, first = words(raw, offsets)
    word = hash_slices(raw, starts, ends)
    out = []
    with np.errstate(over="ignore"):
        gram = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for i in range(n):
            gram += word[i : i + len(gram)] * _WEIGHTS[i]
        upto = np.concatenate([[0], np.cumsum(ends - starts)])  # bytes of words, whatever stands between them
        size = upto[n : n + len(gram)] - upto[: len(gram)]
        gram = (np.uint64(4095) - np.minimum(size, 4095).astype(np.uint64)) << np.uint64(52) | mixed(gram) >> np.uint64(12)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                s = np.sort(gram[a : b - n + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif b > a:
                few = word[a:b] * np.array(_WEIGHTS[: b - a])
                out.append(mixed(np.array([few.sum() + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of the set: equal sets, equal names."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        y = np.bitwise_xor.reduce(mixed(s + np.uint64(0x14057B7EF767814F)))
        return int(mixed(np.array([x * _WEIGHTS[0] + y + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bits of a set; the width is the power of two that holds two bits an n-gram, 64 at least."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[s & np.uint64(width - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """The most n-grams two sets can share, by the bits that only one of their bitmaps has."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):  # folding halves gives the bitmap of half the width
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    both = int(np.bitwise_count(x & y).sum())
    return min(n_a - int(np.bitwise_count(x).sum()) + both, n_b - int(np.bitwise_count(y).sum()) + both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common entries of two sorted arrays without repeats."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0


def similar(inter: int, n_a: int, n_b: int, percent: int) -> bool:
    return 100 * inter >= percent * (n_a + n_b - inter)


def prefix_length(n: int, percent: int) -> int:
    """How many first n-grams of a set any similar set must share SHARED of (or as many as they must share)."""
    need = -(-percent * n // 100)
    return min(n, n - need + min(SHARED, need))


# --- passes over the texts ----------------------------------------------------------------------


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def profiles(docs: DataFrame, n: int) -> DataFrame:
    """A row a text: doc_id, text_id, n, sid, bits; and rows that carry only n-grams repeated within a task.

    Copies of a set within a task count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def repeated(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            grams, counts = grams[counts >= REPEATED], counts[counts >= REPEATED]
            for i in range(0, len(grams), 10_000):
                part = slice(i, i + 10_000)
                pairs = pa.StructArray.from_arrays(
                    [_long(grams[part]), pa.array(counts[part], pa.int64())], ["gram", "times"]
                )
                cells = [None, None, None, None, None]
                kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                lists = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([c], k) for c, k in zip(cells, kinds, strict=True)), lists], names
                )

        names = ["doc_id", "text_id", "n", "sid", "bits", "repeated"]
        kind = pa.int64()
        for batch in batches:
            kind = batch.column("doc_id").type
            sets = shingles(batch.column("text"), n)
            sids = [set_id(s) for s in sets]
            for sid, s in zip(sids, sets, strict=True):
                if len(s) and sid not in seen:
                    seen.add(sid)
                    held.append(s)
                    size += len(s)
            none = pa.nulls(len(sets), pa.list_(pa.struct([("gram", pa.int64()), ("times", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(sids, pa.int64()),
                    pa.array([bitmap(s) for s in sets], pa.binary()),
                    none,
                ],
                names,
            )
            if size >= COUNTED:
                yield from repeated(kind)
                seen, held, size = set(), [], 0
        if held:
            yield from repeated(kind)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(
        run,
        f"doc_id {kind}, text_id bigint, n bigint, sid bigint, bits binary, "
        "repeated array<struct<gram:bigint,times:bigint>>",
    )


def postings(docs: DataFrame, n: int, percent: int, late: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """gram, sid, n, place: the first n-grams of each set, once a task and set.

    late: n-grams that stand last in every set, ascending, and how often they occur.
    """
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, times = shared.value
        seen: set[int] = set()
        for batch in batches:
            parts: list[tuple[np.ndarray, int, int]] = []
            for s in shingles(batch.column("text"), n):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                first = prefix_length(len(s), percent)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                    common = grams[at] == s
                    head = s[~common][:first]
                    if len(head) < first:
                        rest, often = s[common], times[at[common]]
                        head = np.concatenate([head, rest[np.lexsort((rest, often))][: first - len(head)]])
                else:
                    head = s[:first]
                parts.append((head, sid, len(s)))
            if len(seen) > COUNTED:
                seen = set()
            if parts:
                sizes = np.array([len(p[0]) for p in parts])
                head = np.concatenate([p[0] for p in parts])
                place = np.arange(len(head)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                many = np.zeros(len(head), np.int64)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, head), len(grams) - 1)
                    many = np.where(grams[at] == head, times[at], 0) // SPLIT
                sid = np.repeat(np.array([p[1] for p in parts], np.int64), sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(head),
                        pa.array(sid),
                        pa.array(np.repeat(np.array([p[2] for p in parts]), sizes), pa.int32()),
                        pa.array(place, pa.int32()),
                        pa.array(np.where(many > 0, (sid >> 20) % (many + 1), -1), pa.int32()),
                    ],
                    ["gram", "sid", "n", "place", "salt"],
                )

    return docs.select("text").mapInArrow(run, "gram bigint, sid bigint, n int, place int, salt int")


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """sid, grams (sorted hashes as bytes) of the wanted rows (doc_id, text_id, sid)."""
    same = F.expr("d.text_id = w.text_id AND d.doc_id <=> w.doc_id")
    found = docs.alias("d").join(wanted.hint("shuffle_hash").alias("w"), same).select("w.sid", "d.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grams = [s.tobytes() for s in shingles(batch.column("text"), n)]
                yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(grams, pa.binary())], ["sid", "grams"])

    return found.mapInArrow(run, "sid bigint, grams binary")


# --- the join -----------------------------------------------------------------------------------


def _band(n: str | Column, percent: int, shift: float = 0.0) -> Column:
    """Size band: similar sets lie in one band or in neighbouring ones."""
    return F.floor(F.log(F.col(n) if isinstance(n, str) else n) / float(np.log(100 / percent)) + shift)


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow the overlap."""
    sides = [sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab"]
    joined = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b")

    def work(batch: pa.RecordBatch):
        c = {k: batch.column(k).to_pylist() for k in ("n_a", "n_b", "bits_a", "bits_b")}
        keep = [
            similar(min(x, y, overlap_bound(p, q, x, y)), x, y, percent)
            for x, y, p, q in zip(c["n_a"], c["n_b"], c["bits_a"], c["bits_b"], strict=True)
        ]
        yield batch.select(["a", "b"]).filter(pa.array(keep))

    return map_batches(joined, work, "a bigint, b bigint")


def _verified(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by exact intersection."""
    left = grams.select(F.col("sid").alias("a"), F.col("grams").alias("grams_a"))
    right = grams.select(F.col("sid").alias("b"), F.col("grams").alias("grams_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")

    def work(batch: pa.RecordBatch):
        keep = []
        for p, q in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
            x, y = (np.frombuffer(g.as_buffer(), np.uint64) for g in (p, q))
            keep.append(similar(overlap(x, y), len(x), len(y), percent))
        yield batch.select(["a", "b"]).filter(pa.array(keep))

    return map_batches(joined, work, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """sid, label: the smallest sid each node of the edges (a, b) reaches.

    Large-star and small-star rounds until nothing changes; each is written, and a hub's neighbours are
    only aggregated and joined, never collected.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = written(small.filter("u <> v").distinct(), "edges")
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, after)]
        if sums[0] == sums[1]:
            break
        now = after
    nodes = after.select(F.col("u").alias("sid"), F.col("v").alias("label"))
    return nodes.unionByName(nodes.select(F.col("label").alias("sid"), "label").distinct())


def _leaders(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): each set and the leader it shares most tiles with, for two layouts of the bands."""
    out = None
    for shift in (0.0, 0.5):
        cut = tiles.withColumn("cut", _band("n", percent, shift))
        order = "PARTITION BY gram, salt, cut ORDER BY place / n, sid"
        led = cut.withColumn("lead", F.expr(f"first_value(sid) OVER ({order})"))
        stars = led.filter("sid <> lead").select("sid", "lead")
        # a posting that is dealt to several tasks has a leader in each: they get a common one
        heads = led.filter("salt >= 0 AND sid = lead")
        top = heads.groupBy("gram", "cut").agg(F.min(F.struct(F.expr("place / n"), "sid")).alias("top"))
        heads = heads.join(top, ["gram", "cut"]).select("sid", F.col("top.sid").alias("lead")).filter("sid <> lead")
        best = (
            stars.unionByName(heads).groupBy("sid", "lead").count()
            .groupBy("sid").agg(F.max_by("lead", F.struct("count", "lead")).alias("lead"))
        )
        out = best if out is None else out.unionByName(best)
    return out.select(F.least("sid", "lead").alias("a"), F.greatest("sid", "lead").alias("b")).distinct()


def _meetings(tiles: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """x, y, n: sets of different components that meet in a tile and may be similar; a row a meeting, n is x's size."""
    known = tiles.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    several = known.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    open_ = known.join(several.select("gram"), "gram").withColumn("band", _band("n", percent))
    visits = open_.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    # x is the smaller one, or the one of smaller name; y comes from its own band
    both = f"ceil({percent} * (x.n + y.n) / {100 + percent})"  # what two similar sets of these sizes share
    share = f"least({SHARED}, ceil({percent} * x.n / 100))"
    meet = (
        "x.gram = y.gram AND x.band = y.band AND x.label <> y.label "
        "AND (x.n < y.n OR x.n = y.n AND x.sid < y.sid) "
        f"AND 100 * x.n >= {percent} * y.n "
        f"AND x.place < x.n - {both} + {share} AND y.place < y.n - {both} + {share} "
        f"AND {100 + percent} * (least(x.place, y.place) + 1 + least(x.n - x.place, y.n - y.place) - 1)"
        f" >= {percent} * (x.n + y.n)"
    )
    met = visits.alias("x").join(open_.alias("y"), F.expr(meet))
    return met.select(F.col("x.sid").alias("x"), F.col("y.sid").alias("y"), F.col("x.n").alias("n"))


def _remaining(tiles: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share enough first n-grams to be similar."""
    need = F.ceil(F.expr(f"{percent} * n / 100"))
    return (
        _meetings(tiles, labels, percent).groupBy("x", "y").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
        .filter(F.col("shared") >= F.least(F.lit(SHARED), need))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )


def link(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links.

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of word n-grams. A null text
    is empty; rows without words have no n-grams and link with nothing. Repeated rows stay rows. A null
    doc_id links like others but names no component; a component of such rows only has a null name. Looks
    at doc_id and text only. Sets are compared by 64-bit hashes of their n-grams.
    """
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"))
    found = written(profiles(docs, n), "sets")
    rows = found.filter("n IS NOT NULL").drop("repeated")
    times = (
        found.filter("repeated IS NOT NULL").select(F.inline("repeated"))
        .groupBy("gram").agg(F.sum("times").alias("times"))
    )
    times = most_frequent(written(times, "repeated"), "times", ORDERED)
    grams = times["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    late = (grams[order], times["times"].to_numpy(np.int64)[order])
    sets = rows.filter("n > 0").groupBy("sid").agg(F.min(F.struct("doc_id", "text_id", "n", "bits")).alias("r"))
    sets = written(sets.select("sid", "r.*"), "sets")

    # Tiles: rows whose next smaller or larger neighbour under the same n-gram has a fitting size.
    order_ = "PARTITION BY gram, salt ORDER BY n, sid"
    near = (
        f"salt >= 0 OR 100 * lag(n) OVER ({order_}) >= {percent} * n OR 100 * n >= {percent} * lead(n) OVER ({order_})"
    )
    once = postings(docs, n, percent, late).withColumn("near", F.expr(near)).filter("near").drop("near")
    tiles = written(once, "tiles")

    first = written(_bounded(_leaders(tiles, percent), sets, percent), "pairs")
    wanted = first.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    held = written(_sets_of(docs, sets.join(wanted, "sid").select("doc_id", "text_id", "sid"), n), "grams")
    edges = written(_verified(first, held, percent), "links")
    labels = written(components(edges), "labels")

    second = written(_bounded(_remaining(tiles, labels, percent), sets, percent), "pairs")
    wanted = second.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    lacking = written(wanted.join(held.select("sid").distinct(), "sid", "left_anti"), "wanted")
    if not lacking.isEmpty():
        more = sets.join(lacking, "sid").select("doc_id", "text_id", "sid")
        held = held.unionByName(written(_sets_of(docs, more, n), "grams"))
    found_edges = written(_verified(second, held, percent), "links")
    if not found_edges.isEmpty():
        labels = written(components(edges.unionByName(found_edges)), "labels")

    full = rows.filter("n > 0").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    names = full.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = full.join(names, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(none)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM s),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c
  FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (n + m - c))
, reach AS (
  WITH RECURSIVE r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a)
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT s.doc_id, len(s.s) AS n_shingles, reach.component_id FROM s JOIN reach ON s.doc_id = reach.a
"""


@query("op3_ngram_join", ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), n=4, percent=85)
