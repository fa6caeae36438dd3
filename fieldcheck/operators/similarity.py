"""Earliest similar proposal by Jaccard similarity of token sets, exact and without all-pairs work.

Two sets with Jaccard >= t share a token among their rarest |x| - ceil(t |x|) + 1 tokens, so only
sets that meet in such a token are compared, and of these only pairs whose token places leave room for
the overlap and whose sketches of 2,048 bits do not differ in more bits than the sets may differ in tokens.
What is rare is told to the tasks by a list of the most frequent tokens, so the sets are put in order where they
are read: a token is its place in that list, 4 bytes, or a hash of 64 bits. Copies of one token set are one row from
there on.
Only the earliest match is wanted: the members of a bucket first meet its earliest ones, which answers every
member of a cluster of near copies; a set goes on to the rest of its buckets only while an earlier answer could
still hide there. What is left of a bucket is cut into hash blocks, and these meet pair by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcheck.session import pinned, shuffles_removed, written

#: Members of a bucket that all others meet first; members of a block.
LEADERS, BLOCK = 8, 512
#: Tokens in the list that is broadcast, at most (6 MB).
COMMON = 1 << 19
#: Bits of a set's sketch.
SKETCH = 2048
GROUP = ["group", "set_id"]


def earliest_similar(proposals: DataFrame, threshold: float, leaders: int = LEADERS, block: int = BLOCK) -> DataFrame:
    """(seq, earlier) for proposals(seq, targets, paths array, tokens array) that have a match.

    A match shares an edit path and the target set, has a smaller seq, and a similarity of at
    least `threshold`.
    """
    with shuffles_removed(proposals.sparkSession):
        sets = written(token_sets(proposals), "sets")
        return _earliest(sets, threshold, leaders, block)


def _earliest(sets: DataFrame, threshold: float, leaders: int, block: int) -> DataFrame:
    firsts = pinned(sets.groupBy("sig").agg(F.min(F.struct("seq", "row")).alias("_m")).select("sig", F.col("_m.row").alias("set_id")))
    by_path = sets.select("seq", "targets", F.explode(F.array_distinct("paths")).alias("path"), "sig").join(firsts, "sig")
    groups = pinned(by_path.select("targets", "path").distinct().withColumn("group", F.monotonically_increasing_id()))
    by_path = pinned(by_path.join(groups, ["targets", "path"]).select("seq", *GROUP))
    first = by_path.groupBy(*GROUP).agg(F.min("seq").alias("gid"))
    sets = sets.withColumnRenamed("row", "set_id")
    best = first.join(earliest_group(first, sets, threshold, leaders, block), GROUP, "left").withColumn(
        "_low", F.least("gid", F.coalesce("other", F.col("gid")))
    )
    answers = by_path.join(best, GROUP).select(
        "seq",
        F.when(F.col("_low") < F.col("seq"), F.col("_low"))
        .when(F.col("other") < F.col("seq"), F.col("other"))
        .alias("earlier"),
    )
    return answers.groupBy("seq").agg(F.min("earlier").alias("earlier")).filter(F.col("earlier").isNotNull())


def token_sets(proposals: DataFrame) -> DataFrame:
    """The rows that have tokens, with a number, their tokens and a digest and a sketch of these.

    Tokens are `rare`, hashes of those not in the list, and behind them `common`, places in the list; both are sorted.
    """
    hashed = proposals.filter(F.size("tokens") > 0).select(
        "seq", "targets", "paths", F.array_distinct(F.transform("tokens", lambda t: F.xxhash64(t))).alias("tokens")
    )
    shared = proposals.sparkSession.sparkContext.broadcast(common_tokens(hashed))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = shared.value
        for batch in batches:
            tokens = batch.column("tokens")
            cuts = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
            flat = tokens.flatten().to_numpy()
            own = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
            at = np.searchsorted(known[:-1], flat)
            number = np.where(known[at] == flat, place[at], -1)
            order = np.lexsort((flat, number, own))
            flat, number = flat[order], number[order]
            bits = np.zeros((batch.num_rows, SKETCH), bool)
            bits[own, flat % SKETCH] = True
            listed = np.concatenate([[0], np.cumsum(number >= 0)])[cuts]
            lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            columns = {
                **{c: batch.column(c) for c in ("seq", "targets", "paths")},
                "sig": pa.array([hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]),
                "size": pa.array(np.diff(cuts), pa.int32()),
                "rare": lists(cuts - listed, flat[number < 0]),
                "common": lists(listed, number[number >= 0].astype(np.int32)),
                "sketch": lists(np.arange(batch.num_rows + 1) * (SKETCH // 64), np.packbits(bits, axis=1).view(np.int64).ravel()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kinds = dict(hashed.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("seq", "targets", "paths")) + ", sig binary, size int, rare array<bigint>, common array<int>, sketch array<bigint>"
    return hashed.mapInArrow(work, schema).withColumn("row", F.monotonically_increasing_id())


def common_tokens(hashed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, COMMON at most, sorted, and the place of each in the order of their counts.

    A histogram of the counts, 64 steps a doubling, tells the least count; only the rows wanted reach the driver.
    """
    counts = hashed.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.filter("n > 1").withColumn("step", F.floor(F.log2("n") * 64).cast("int")), "tokens")
    least, held = None, 0
    for row in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        held += row["count"]
        if held > COMMON:
            break
        least = row["step"]
    kept = counts.filter(F.col("step") >= least if least is not None else F.lit(False)).select("token", "n").toArrow()
    token, n = kept["token"].to_numpy(), kept["n"].to_numpy()
    token = token[np.lexsort((token, n))]
    order = np.argsort(token)
    # one more that stands for none, for tokens behind the last
    return np.append(token[order], 0), np.append(order, -1).astype(np.int32)


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(set_id, size, first): the rarest tokens of each set, one of which a similar set shares."""
    keep = (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).cast("int")
    return sets.select("set_id", "size", F.slice(F.concat("rare", F.col("common").cast("array<bigint>")), F.lit(1), keep).alias("first"))


def earliest_group(first: DataFrame, sets: DataFrame, threshold: float, leaders: int, block: int = BLOCK) -> DataFrame:
    """Per (group, set): the smallest gid of another similar set of the group that is smaller than its own."""
    postings = first.join(prefixes(sets, threshold), "set_id").select(
        *GROUP, "gid", "size", F.posexplode("first").alias("place", "_token")
    )
    postings = postings.withColumn("bucket", F.xxhash64("group", "_token")).drop("_token")
    bucket = Window.partitionBy("bucket")
    sorted_ = bucket.orderBy("gid", "set_id")
    ranked = postings.withColumns({"_rank": F.row_number().over(sorted_), "_next": F.lead("gid").over(sorted_)})
    behind = F.col("_rank") > leaders
    ranked = ranked.filter("_rank > 1 OR _next IS NOT NULL").withColumns({
        "_n": F.count(F.lit(1)).over(bucket),
        "_edge": F.min(F.when(behind, F.col("gid"))).over(bucket),
        "_heads": F.collect_list(F.when(~behind, F.struct("gid", "set_id", "size", "place", "group"))).over(bucket),
    })
    # a row a leader that a member meets, and one without a leader for a member that is none
    meets = F.when(behind, F.array_append("_heads", F.lit(None))).otherwise(F.col("_heads"))
    m = F.col("_m")
    fits = (m["gid"] < F.col("gid")) & (m["group"] == F.col("group")) & _room(F.col("size"), F.col("place"), m["size"], m["place"], threshold)
    dealt = ranked.select(*GROUP, "gid", "size", "place", "bucket", "_n", "_edge", F.explode(meets).alias("_m")).filter(m.isNull() | fits)
    dealt = written(
        dealt.select(
            *GROUP, m["set_id"].alias("set2"), m["gid"].alias("other"),
            *[F.when(m.isNull(), F.col(c)).alias(c) for c in ("gid", "size", "place", "bucket", "_n", "_edge")],
        ), "buckets"
    )
    ahead = dealt.filter("set2 IS NOT NULL").select(*GROUP, "set2", "other")
    near = pinned(verified(ahead.distinct(), sets, threshold))
    found = near.groupBy(*GROUP).agg(F.min("other").alias("other"))
    # A bucket is exhausted for a set once its first member that does not lead comes after the set's best answer.
    rest = dealt.filter("set2 IS NULL").drop("set2", "other")
    deep = rest.join(found, GROUP, "left").withColumn("_bound", F.least("gid", F.coalesce("other", F.col("gid")))).filter("_edge < _bound")
    reach = deep.groupBy("bucket").agg(F.max("_bound").alias("_reach"))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64("set_id"), blocks).cast("int")
    each = F.explode(F.sequence(F.lit(0), blocks - 1))
    open_ = deep.select(*GROUP, "bucket", "size", "place", F.col("_bound").alias("gid"), own.alias("_i"), each.alias("_j"))
    later = rest.join(reach, "bucket").filter("gid < _reach").select(
        "bucket", F.col("group").alias("group2"), F.col("set_id").alias("set2"), F.col("gid").alias("other"),
        F.col("size").alias("size2"), F.col("place").alias("place2"), own.alias("_j"), each.alias("_i"),
    )
    room = _room(F.col("size"), F.col("place"), F.col("size2"), F.col("place2"), threshold)
    met = open_.join(later, ["bucket", "_i", "_j"]).filter((F.col("group") == F.col("group2")) & (F.col("other") < F.col("gid")) & room)
    more = pinned(verified(met.select(*GROUP, "set2", "other").distinct(), sets, threshold))
    return near.unionByName(more).groupBy(*GROUP).agg(F.min("other").alias("other"))


def _need(a: Column, b: Column, threshold: float) -> Column:
    """Tokens that similar sets of a and b tokens share at least."""
    return F.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9)


def _room(a: Column, i: Column, b: Column, j: Column, threshold: float) -> Column:
    """Can sets of a and b tokens that share their tokens at places i and j be similar?

    `need` tokens must be shared. All sets are in one order, so two such sets share a token among the first
    size - need + 1 of either, and what they share is at most what stands before and after any common token.
    """
    need = _need(a, b, threshold)
    room = F.least(i, j) + 1 + F.least(a - i - 1, b - j - 1) >= need
    sized = (b >= a * threshold - 1e-9) & (a >= b * threshold - 1e-9)
    return sized & (i <= a - need) & (j <= b - need) & room


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (group, set_id, set2, other) that reach the threshold, for each (group, set) the one of the smallest other and maybe more.

    Only pairs whose sketches agree well enough are looked at. Of these the earliest one of each (group, set) gets its token
    sets first, and the others only where that one fails.
    """
    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("size").alias(f"size_{c}"))
    a, b = F.col("size_set_id"), F.col("size_set2")
    differ = sum(F.bit_count(F.col("sketch_set_id")[i].bitwiseXOR(F.col("sketch_set2")[i])) for i in range(SKETCH // 64))
    alike = pairs.join(side("set2"), "set2").join(side("set_id"), "set_id").filter(differ <= a + b - 2 * _need(a, b, threshold))
    alike = written(alike.select(*GROUP, "set2", "other"), "pairs")
    earliest = alike.groupBy(*GROUP).agg(F.min(F.struct("other", "set2")).alias("_m")).select(*GROUP, "_m.*")
    sure = pinned(similar(earliest, sets, threshold))
    failed = earliest.join(sure, GROUP, "left_anti").select(*GROUP, F.col("other").alias("_tried"))
    return sure.unionByName(similar(alike.join(failed, GROUP).filter("other > _tried").drop("_tried"), sets, threshold))


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose whole token sets reach the threshold.

    Sets meet once for all groups. The earlier one, which many pairs may share, joins first, while pairs are few bytes.
    """
    pairs = pairs.groupBy("set_id", "set2").agg(F.collect_list(F.struct("group", "other")).alias("_in"))
    names = ("size", "rare", "common")
    side = lambda c: sets.select(F.col("set_id").alias(c), *[F.col(n).alias(f"{n}_{c}") for n in names])
    shared = sum(F.size(F.array_intersect(f"{n}_set_id", f"{n}_set2")) for n in names[1:])
    jaccard = shared / (F.col("size_set_id") + F.col("size_set2") - shared)
    found = pairs.join(side("set2"), "set2").join(side("set_id"), "set_id").filter(jaccard >= threshold)
    return found.select("set_id", F.explode("_in").alias("_m")).select("_m.group", "set_id", "_m.other")
