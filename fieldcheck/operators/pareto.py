"""Noise-aware Pareto analysis of search nodes.

A value is better than a reference only beyond the reference's noise floor, max(absolute,
|reference| * relative). The relation is therefore neither symmetric nor transitive: fronts may get
stuck and the archive depends on the order of its nodes.

No run is ever one group. Its nodes are cut into slices of bounded size in the order that the job
needs; slices work alone on what they are sent, and rounds repeat until nothing changes. A first
round that sees its whole run is the common case, but not a special one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldcheck.operators.ordered import SLICE, exact_quantiles, numbered, ranked, running
from fieldcheck.session import pinned

#: Nodes of a slice: bounds what a task compares.
SLICE_ROWS = 4096
#: Nodes of a slice of fronts: each slice of a run is a round of jobs, which the driver has to hold.
FRONT_ROWS = 32_768
#: Pairs of nodes that are compared at once.
TILE = (128, 4096)
MERGE_ROWS = 100_000
CHUNK = 500
SALTS = 32
KEY = ["run_id", "node_id"]


@dataclass(frozen=True)
class Objective:
    name: str
    maximize: bool
    absolute: float
    relative: float

    @property
    def sign(self) -> float:
        return 1.0 if self.maximize else -1.0

    def compare(self, new: Column, old: Column) -> Column:
        """1 better, -1 worse, 0 within the noise floor of `old`."""
        gain = (new - old) * self.sign
        floor = F.greatest(F.lit(float(self.absolute)), F.abs(old) * float(self.relative))
        return F.when(gain > floor, 1).when(gain < -floor, -1).otherwise(0)


def any_sign(objectives: Sequence[Objective], new: Callable[[str], Column], old: Callable[[str], Column], sign: int) -> Column:
    return reduce(Column.__or__, [o.compare(new(o.name), old(o.name)) == sign for o in objectives])


def dominates(objectives: Sequence[Objective], new: Callable[[str], Column], old: Callable[[str], Column]) -> Column:
    return any_sign(objectives, new, old, 1) & ~any_sign(objectives, new, old, -1)


def relation(objectives: Sequence[Objective], new: Callable[[str], Column], old: Callable[[str], Column]) -> Column:
    better, worse = any_sign(objectives, new, old, 1), any_sign(objectives, new, old, -1)
    return (
        F.when(better & ~worse, "dominates")
        .when(worse & ~better, "dominated")
        .when(better & worse, "tradeoff")
        .otherwise("equivalent")
    )


def with_parent(nodes: DataFrame, objectives: Sequence[Objective]) -> DataFrame:
    parents = nodes.select(F.col("node_id").alias("parent_id"), *[F.col(o.name).alias(f"_p_{o.name}") for o in objectives])
    return nodes.filter(F.col("parent_id") != F.col("node_id")).join(parents, "parent_id")


def parent_relations(nodes: DataFrame, objectives: Sequence[Objective]) -> DataFrame:
    """Relation of every node to its parent; an equi-join, one pair per node."""
    pairs = with_parent(nodes, objectives)
    return pairs.select("node_id", "parent_id", relation(objectives, F.col, lambda n: F.col(f"_p_{n}")).alias("relation"))


def parent_changes(nodes: DataFrame, objectives: Sequence[Objective]) -> DataFrame:
    """Relative change of each objective to the parent; positive is better."""
    change = lambda o: (F.col(o.name) - F.col(f"_p_{o.name}")) / F.greatest(F.abs(f"_p_{o.name}"), F.lit(1e-12)) * o.sign
    return with_parent(nodes, objectives).select("node_id", "parent_id", *[change(o).alias(f"{o.name}_change") for o in objectives])


def sliced_runs(rows: DataFrame, order: Sequence[Column | str], size: int) -> DataFrame:
    """Adds `_slice`, which cuts the rows of each run into stretches of about `size` rows in the given order.

    Slices are range partitions, so their numbers grow with the order; pinned, so that they cannot change.
    """
    parts = max(1, -(-rows.count() // size))
    return pinned(rows.repartitionByRange(parts, "run_id", *order).withColumn(SLICE, F.spark_partition_id()))


def _values(pdf: pd.DataFrame, objectives: Sequence[Objective]) -> np.ndarray:
    return np.column_stack([pdf[o.name].to_numpy(float) * o.sign for o in objectives])


def _floors(values: np.ndarray, objectives: Sequence[Objective]) -> np.ndarray:
    absolute = np.array([o.absolute for o in objectives])
    relative = np.array([o.relative for o in objectives])
    return np.maximum(absolute, np.abs(values) * relative)


def strongest(objectives: Sequence[Objective], schema_names: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per run, the points of a partition no other point of it equals or exceeds everywhere.

    Whatever dominates a node beyond noise still does so with values at least as good, so these
    points stand in for all of them. Batches are folded one after the other; only the survivors
    are held.
    """

    def keep(v: np.ndarray) -> np.ndarray:
        order = np.lexsort(-v.T[::-1])
        kept: list[int] = []
        for i in order:
            if not kept or not (v[kept] >= v[i]).all(axis=1).any():
                kept.append(int(i))
        return np.array(kept, dtype=int)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.DataFrame] = {}
        for batch in batches:
            for run_id, part in batch.groupby("run_id", sort=False):
                both = pd.concat([held[run_id], part]) if run_id in held else part
                held[run_id] = both.iloc[keep(_values(both, objectives))]
        for part in held.values():
            yield part[list(schema_names)]

    return run


def dominators(points: DataFrame, objectives: Sequence[Objective]) -> DataFrame:
    """(run_id, members) chunks of bounded size that decide every dominance question of the run."""
    names = ["run_id", *[o.name for o in objectives]]
    slim = points.select(*names)
    local = pinned(slim.mapInPandas(strongest(objectives, names), slim.schema))
    merged = split_runs(local, names, MERGE_ROWS).repartition("run_id", "_piece").drop("_piece")
    best = pinned(merged.mapInPandas(strongest(objectives, names), slim.schema))
    return (
        split_runs(best, names, CHUNK)
        .groupBy("run_id", "_piece")
        .agg(F.collect_list(F.struct(*names[1:])).alias("members"))
        .select("run_id", "members")
    )


def split_runs(rows: DataFrame, names: Sequence[str], size: int) -> DataFrame:
    """Adds `_piece`, which cuts the rows of a run by hash into pieces of about `size` rows."""
    counted = rows.groupBy("run_id").agg(F.ceil(F.count(F.lit(1)) / size).alias("_pieces"))
    return rows.join(counted, "run_id").select(*names, F.pmod(F.xxhash64(*names), F.col("_pieces")).alias("_piece"))


def dominated_flags(points: DataFrame, objectives: Sequence[Objective]) -> DataFrame:
    """Adds `dominated` to (run_id, node_id, objectives...): some node of the run beats it beyond noise."""
    hit = F.exists("members", lambda m: dominates(objectives, lambda n: m[n], F.col))
    judged = points.join(dominators(points, objectives), "run_id").withColumn("_hit", hit)
    names = [o.name for o in objectives]
    return judged.groupBy(*KEY, *names).agg(F.max("_hit").alias("dominated"))


def first_front(points: DataFrame, objectives: Sequence[Objective]) -> DataFrame:
    return dominated_flags(points, objectives).filter(~F.col("dominated")).select(*KEY)


def _tiles(senders: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Two lists of row numbers in pieces that are compared at once."""
    for i in range(0, len(senders), TILE[0]):
        for j in range(0, len(rows), TILE[1]):
            yield senders[i : i + TILE[0]], rows[j : j + TILE[1]]


def _beats(senders: np.ndarray, values: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Which sender (row) dominates which of the values (column)."""
    better = np.zeros((len(senders), len(values)), bool)
    worse = better.copy()
    for k in range(values.shape[1]):
        gain = senders[:, k, None] - values[None, :, k]
        better |= gain > floors[None, :, k]
        worse |= gain < -floors[None, :, k]
    return better & ~worse


def _bounds(values: np.ndarray, senders: np.ndarray, front: np.ndarray, objectives: Sequence[Objective]) -> np.ndarray:
    """For each row the largest front of the senders that dominate it, 0 without any."""
    floors = _floors(values, objectives)
    out = np.zeros(len(values), np.int64)
    for some, rows in _tiles(np.arange(len(senders)), np.arange(len(values))):
        beats = _beats(senders[some], values[rows], floors[rows])
        out[rows] = np.maximum(out[rows], (beats * front[some, None]).max(0))
    return out


def _solved(objectives: Sequence[Objective]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Fronts of a slice, given the largest front that dominates each of its rows from outside.

    Rows whose dominators are all done push their front to what they dominate, each of them once. Pairs are
    compared tile by tile, first to count the dominators and again to push, and are not kept.
    """

    def run(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v, was = _values(pdf, objectives), pdf["front"].to_numpy(np.int64)
        front = np.maximum(was, pdf["_bound"].to_numpy(np.int64) + 1)
        pdf = pdf.drop(columns="_bound")
        if (front == was).all():
            return pdf
        floors = _floors(v, objectives)
        left = np.arange(len(v))
        waits = np.zeros(len(v), np.int64)
        for some, rows in _tiles(left, left):
            waits[rows] += np.count_nonzero(_beats(v[some], v[rows], floors[rows]), axis=0)
        while len(left):
            ready = waits[left] == 0
            free, left = left[ready], left[~ready]
            if not len(free):
                raise RuntimeError("no node of the rest is free of dominators: the floors do not order them")
            for some, rows in _tiles(free, left):
                beats = _beats(v[some], v[rows], floors[rows])
                front[rows] = np.maximum(front[rows], (beats * (front[some, None] + 1)).max(0))
                waits[rows] -= np.count_nonzero(beats, axis=0)
        return pdf.assign(_moved=pdf["_moved"] | bool((front != was).any()), front=front)

    return run


def _received(objectives: Sequence[Objective]) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What one slice's fronts mean for the rows of another one."""

    def run(_: tuple, senders: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        bound = _bounds(_values(rows, objectives), _values(senders, objectives), senders["front"].to_numpy(np.int64), objectives)
        return rows[KEY].assign(_bound=bound)[bound > 0]

    return run


def _height(objectives: Sequence[Objective]) -> Column:
    """Sum of the objectives, each on a scale on which its noise floor is about one: dominators stand higher, nearly always."""
    scaled = []
    for o in objectives:
        v, turn = F.abs(F.col(o.name).cast("double")), o.absolute / o.relative if o.relative else float("inf")
        near = F.least(v, F.lit(turn)) / o.absolute if o.absolute else F.lit(0.0)
        far = F.log(F.greatest(v / (turn or 1e-300), F.lit(1.0))) / o.relative if o.relative else F.lit(0.0)
        scaled.append(F.signum(F.col(o.name).cast("double")) * (near + far) * o.sign if o.absolute or o.relative else F.col(o.name) * o.sign)
    return reduce(Column.__add__, scaled)


def pareto_fronts(points: DataFrame, objectives: Sequence[Objective], slice_rows: int = FRONT_ROWS) -> DataFrame:
    """(run_id, node_id, front) with fronts numbered from 1; raises when a run makes no progress.

    A node's front is one more than the largest front of its dominators. Nodes of equal objectives have the
    same front and are one row. Slices, cut along the sum of the objectives in units of noise, solve this among
    their own rows. Then the first slice of each run whose fronts have moved sends them to the slices of its run
    that they may dominate, pair by pair, until none is left that has moved. Dominators nearly always come from
    slices before, so a slice has its final fronts when it sends them: a run of k slices takes some k rounds and
    each pair of slices meets about once. Whatever the order is, the end is the same.
    """
    names = [o.name for o in objectives]
    copies = points.select("run_id", F.col("node_id").alias("_node"), *[F.col(n).alias(f"_c_{n}") for n in names])
    single = points.groupBy("run_id", *names).agg(F.min("node_id").alias("node_id")).select(*KEY, *names)
    rows = sliced_runs(single, [_height(objectives).desc()], slice_rows)
    size = rows.count()
    schema = StructType([*rows.schema.fields]).add("front", "long").add("_moved", "boolean")
    slice_ = ["run_id", SLICE]
    solve = lambda df: pinned(df.groupBy(*slice_).applyInPandas(_solved(objectives), schema).select(*schema.names))
    none = {"front": F.lit(0).cast("long"), "_moved": F.lit(False), "_bound": F.lit(0).cast("long")}
    state = solve(rows.withColumns(none))
    boxes = rows.groupBy(*slice_).agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))])
    ways = pinned(_ways(boxes, objectives))
    while not ways.isEmpty():
        waiting = state.filter("_moved").groupBy("run_id").agg(F.min(SLICE).alias("_from"), F.max("front").alias("_f"))
        turn = pinned(waiting)
        highest = turn.agg(F.max("_f")).first()[0]
        if highest is None:
            break
        if highest > size:
            raise RuntimeError("no node of the rest is free of dominators: the floors do not order them")
        turn = turn.drop("_f")
        live = ways.join(turn, ["run_id", "_from"])
        sent = state.withColumnRenamed(SLICE, "_from").join(live, ["run_id", "_from"])
        met = state.toDF(*["_to" if c == SLICE else c for c in state.columns]).join(live.toDF(*live.columns), ["run_id", "_to"])
        pair = ["run_id", "_from", "_to"]
        bounds = (
            sent.groupBy(*pair).cogroup(met.groupBy(*pair))
            .applyInPandas(_received(objectives), single.select(*KEY).schema.add("_bound", "long"))
            .groupBy(*KEY).agg(F.max("_bound").alias("_bound"))
        )
        now = state.join(bounds, KEY, "left").join(turn, "run_id", "left")
        still = F.col("_moved") & ~F.coalesce(F.col(SLICE) == F.col("_from"), F.lit(False))
        state = solve(now.withColumns({"_moved": still, "_bound": F.coalesce("_bound", F.lit(0).cast("long"))}).drop("_from"))
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_c_{n}")) for n in names])
    found = state.select(F.col("run_id").alias("_run"), *names, "front")
    return copies.join(found, F.col("run_id").eqNullSafe(F.col("_run")) & same).select("run_id", F.col("_node").alias("node_id"), "front")


def _ways(boxes: DataFrame, objectives: Sequence[Objective]) -> DataFrame:
    """(run_id, _from, _to): slices of a run of which the first may hold dominators of the second's rows."""
    other = boxes.select("run_id", F.col(SLICE).alias("_to"), *[F.col(c).alias(f"t_{c}") for c in boxes.columns[2:]])
    both = boxes.withColumnRenamed(SLICE, "_from").join(other, "run_id").filter(F.col("_from") != F.col("_to"))
    for o in objectives:
        low, high = (F.col(f"t_lo_{o.name}"), F.col(f"t_hi_{o.name}"))
        floor = F.greatest(F.lit(float(o.absolute)), F.greatest(F.abs(low), F.abs(high)) * float(o.relative))
        both = both.filter(F.col(f"hi_{o.name}") >= low - floor if o.maximize else F.col(f"lo_{o.name}") <= high + floor)
    return both.select("run_id", "_from", "_to")


def _admissions(v: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In the order given: which rows an archive that starts empty admits, and which row evicts each (-1: none).

    Between two admissions the members stand still, so all rows that follow are tested at once.
    """
    n = len(v)
    admitted, evictor = np.zeros(n, bool), np.full(n, -1)
    inside = np.zeros(0, np.int64)
    i, step = 0, 64
    while i < n:
        part = slice(i, min(i + step, n))
        gain = v[part, None, :] - v[inside][None]
        passes = (gain > floors[inside]).any(2).all(1)
        if not passes.any():
            i, step = part.stop, min(2 * step, 4096)
            continue
        at = int(passes.argmax())
        beaten = ~(gain[at] < -floors[inside]).any(1)
        evictor[inside[beaten]] = i + at
        inside = np.append(inside[~beaten], i + at)
        admitted[i + at] = True
        i, step = i + at + 1, max(16, step // 2)
    return admitted, evictor


def _proposals(objectives: Sequence[Objective]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """What a slice's nodes would have admitted, had the run begun with them."""

    def run(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        v = _values(pdf, objectives)
        return pdf[_admissions(v, _floors(v, objectives))[0]]

    return run


def _folded(objectives: Sequence[Objective], schema_names: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Archives of the proposals, sorted by run and seq: members leave as rows when they are evicted.

    Only the members of the run at hand are held, whatever the number of proposals.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            for run_id, part in batch.groupby("run_id", sort=False):
                if held is not None and len(held) and held["run_id"].iloc[0] != run_id:
                    yield held[list(schema_names)]
                    held = None
                part = part.assign(until=np.nan, until_slice=np.nan)
                both = part if held is None else pd.concat([held, part], ignore_index=True)
                v = _values(both, objectives)
                # the members stand first, in the order of their admission, and admit each other again
                admitted, evictor = _admissions(v, _floors(v, objectives))
                gone = np.flatnonzero(admitted & (evictor >= 0))
                done = both.iloc[gone].assign(
                    until=both["seq"].to_numpy(float)[evictor[gone]], until_slice=both[SLICE].to_numpy(float)[evictor[gone]]
                )
                yield done[list(schema_names)]
                held = both.iloc[np.flatnonzero(admitted & (evictor < 0))]
        if held is not None:
            yield held[list(schema_names)]

    return run


def _overlooked(objectives: Sequence[Objective]) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Nodes of a slice that the archive of their time would have admitted, though it has not seen them."""

    def run(_: tuple, pdf: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        v, seq = _values(pdf, objectives), pdf["seq"].to_numpy()
        passes = ~np.isin(seq, members["seq"].to_numpy())
        m = _values(members, objectives)
        floors = _floors(m, objectives)
        since = np.searchsorted(seq, members["seq"].to_numpy(), "right")
        until = members["until"].to_numpy(float)
        to = np.where(np.isnan(until), len(seq), np.searchsorted(seq, np.nan_to_num(until), "right"))
        for i, (a, b) in enumerate(zip(since.tolist(), to.tolist(), strict=True)):
            passes[a:b] &= (v[a:b] - m[i] > floors[i]).any(1)
        return pdf[passes]

    return run


def pareto_archive(nodes: DataFrame, objectives: Sequence[Objective], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Which nodes of (run_id, node_id, seq, objectives...) the archive admits, and which it still holds.

    In order of `seq` a node is rejected when a member dominates it or is equivalent to it, that
    is, unless it is better than every member in some objective; an admitted node evicts the
    members it dominates. The members differ pairwise by more than the noise floor, so their
    number follows from the value ranges and not from the length of a run.

    Each slice of a run proposes the nodes that its own fold would admit. One sorted stream folds the
    proposals into members with a time of admission and one of eviction, as rows; every slice then
    tests all its nodes against the members of their time. Nodes that pass without having been proposed
    join the proposals, and the fold is repeated. When there are none, each node has been judged by the
    very members that the fold of the whole run would have had.
    """
    names = [o.name for o in objectives]
    rows = sliced_runs(nodes.select(*KEY, "seq", *names), ["seq"], slice_rows)
    by_slice = rows.groupBy("run_id", SLICE)
    last = rows.groupBy("run_id").agg(F.max(SLICE).alias("_last"))
    proposed = pinned(by_slice.applyInPandas(_proposals(objectives), rows.schema))
    schema = StructType([*rows.schema.fields]).add("until", "double").add("until_slice", "double")
    while True:
        stream = proposed.repartition("run_id").sortWithinPartitions("run_id", "seq")
        members = pinned(stream.mapInPandas(_folded(objectives, schema.names), schema))
        spans = members.join(last, "run_id").withColumn("_end", F.coalesce(F.col("until_slice").cast("int"), "_last"))
        sent = spans.withColumn(SLICE, F.explode(F.sequence(F.col(SLICE), F.col("_end")))).drop("_end", "_last")
        more = by_slice.cogroup(sent.groupBy("run_id", SLICE)).applyInPandas(_overlooked(objectives), rows.schema)
        more = pinned(more)
        if more.isEmpty():
            break
        proposed = pinned(proposed.unionByName(more))
    flags = members.select(*KEY, F.lit(True).alias("_a"), F.col("until").isNull().alias("_f"))
    no = F.lit(False)
    return rows.join(flags, KEY, "left").select(
        *KEY, F.coalesce("_a", no).alias("admitted"), F.coalesce("_f", no).alias("in_archive")
    )


def stagnation(nodes: DataFrame, count_infeasible: bool) -> DataFrame:
    """Consecutive non-admitted nodes up to each node of (run_id, node_id, seq, admitted, feasible).

    Greedy search skips infeasible nodes, archive search counts them. Both counts are running sums;
    the value at the last admission is the smallest of its island.
    """
    missed = ~F.col("admitted") if count_infeasible else ~F.col("admitted") & F.col("feasible")
    run = running(
        nodes.select(*KEY, "seq", "admitted", "feasible"),
        ["run_id"],
        ["seq"],
        {"_island": F.col("admitted").cast("long"), "_missed": missed.cast("long")},
    )
    base = run.filter("admitted").groupBy("run_id", "_island").agg(F.min("_missed").alias("_base"))
    return run.join(base, ["run_id", "_island"], "left").select(
        *KEY, "seq", (F.col("_missed") - F.coalesce("_base", F.lit(0))).alias("streak")
    )


def lexicographic_rank(points: DataFrame, objectives: Sequence[Objective]) -> DataFrame:
    """Rank per run by the objectives in priority order, then by id."""
    order = [F.col(o.name).desc() if o.maximize else F.col(o.name).asc() for o in objectives]
    return ranked(points.select(*KEY, *[o.name for o in objectives]), ["run_id"], [*order, "node_id"], "rank").select(*KEY, "rank")


def medoid(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """Node of each run nearest to the run's medians, by summed relative distance, then by id."""
    long = points.select("run_id", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["run_id"], list(names), "_name", "_value")
    med = exact_quantiles(long, ["run_id", "_name"], "_value", {"median": 0.5})
    wide = med.groupBy("run_id").agg(*[F.max(F.when(F.col("_name") == n, F.col("median"))).alias(f"_m_{n}") for n in names])
    gap = reduce(Column.__add__, [F.abs(F.col(n) - F.col(f"_m_{n}")) / F.greatest(F.abs(f"_m_{n}"), F.lit(1e-12)) for n in names])
    far = points.join(wide, "run_id").select("run_id", "node_id", F.round(gap, 12).alias("distance"))
    return far.groupBy("run_id").agg(F.min(F.struct("distance", "node_id")).alias("_b")).select("run_id", "_b.node_id", "_b.distance")


def branch_seeds(points: DataFrame, fronts: DataFrame, preferred: DataFrame, objectives: Sequence[Objective], width: int) -> DataFrame:
    """(run_id, node_id, step): the preferred node, then the farthest from all chosen, width at most.

    Distance is L1 over objectives scaled by their range in the run; ties go to the lower front,
    then to the smaller id. Every round keeps the distance to the nearest chosen node and takes one
    minimum per run.
    """
    names = [o.name for o in objectives]
    scales = points.groupBy("run_id").agg(
        *[F.greatest(F.max(n) - F.min(n), F.lit(1e-12)).alias(f"_s_{n}") for n in names]
    )
    place = F.struct((-F.col("_near")).alias("d"), "front", "node_id", *names)
    # the nodes of a run are dealt over SALTS keys, each of which gets the run's newest seed
    salted = points.join(fronts, KEY).withColumn("_salt", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    wide = salted.join(scales.select("*", every), ["run_id", "_salt"])
    open_ = pinned(wide.withColumn("_near", F.lit(float("inf"))))
    newest = preferred.select(*KEY).join(points.select(*KEY, *names), KEY)
    out = preferred.select(*KEY, F.lit(1).alias("step"))
    for step in range(2, width + 1):
        last = newest.select("run_id", F.col("node_id").alias("_c"), *[F.col(n).alias(f"_c_{n}") for n in names], every)
        gap = reduce(Column.__add__, [F.abs(F.col(n) - F.col(f"_c_{n}")) / F.col(f"_s_{n}") for n in names])
        open_ = pinned(
            open_.join(last, ["run_id", "_salt"])
            .filter(F.col("node_id") != F.col("_c"))
            .withColumn("_near", F.least("_near", gap))
            .select(*open_.columns)
        )
        newest = open_.groupBy("run_id").agg(F.min(place).alias("_b")).select("run_id", "_b.node_id", *[f"_b.{n}" for n in names])
        out = out.unionByName(newest.select(*KEY, F.lit(step).alias("step")))
    return out


# Order in which proposal focuses take turns, and the objectives of each focus.
FOCUS_TURNS = ("throughput", "footprint", "throughput", "joint")
FOCUS_TARGETS = {
    "throughput": ("consumer_samples_per_second",),
    "footprint": ("output_bytes",),
    "joint": ("consumer_samples_per_second", "output_bytes"),
}


def focus_schedule(allocation: DataFrame) -> DataFrame:
    """Weighted round robin of (run_id, throughput, footprint, joint) quotas as (iteration, focus).

    The k-th use of a focus falls on a known turn of a known cycle, and the uses before that turn
    follow from the quotas, so the place of every slot is arithmetic and needs no ordering.
    """
    quotas = F.array(*[F.struct(F.lit(n).alias("focus"), F.col(n).cast("long").alias("quota")) for n in FOCUS_TARGETS])
    slots = (
        allocation.select("run_id", *FOCUS_TARGETS, F.explode(quotas).alias("_q"))
        .filter(F.col("_q.quota") > 0)
        .select("run_id", *FOCUS_TARGETS, "_q.focus", "_q.quota")
    )
    slots = numbered(slots, F.col("quota"), "k").drop("quota")
    turns = {n: [i for i, f in enumerate(FOCUS_TURNS) if f == n] for n in FOCUS_TARGETS}
    cycle = F.lit(None).cast("long")
    turn = F.lit(None).cast("int")
    for n, at in turns.items():
        mine = F.col("focus") == n
        cycle = F.when(mine, F.floor(F.col("k") / len(at))).otherwise(cycle)
        turn = F.when(mine, F.element_at(F.array(*[F.lit(i) for i in at]), (F.col("k") % len(at) + 1).cast("int"))).otherwise(turn)
    placed = slots.withColumns({"_cycle": cycle, "_turn": turn})
    earlier = F.lit(1).cast("long")
    for n, at in turns.items():
        in_cycle = reduce(Column.__add__, [(F.lit(i) < F.col("_turn")).cast("long") for i in at])
        earlier = earlier + F.least(F.col(n).cast("long"), F.col("_cycle") * len(at) + in_cycle)
    targets = F.lit(None).cast("string")
    for n, names in FOCUS_TARGETS.items():
        targets = F.when(F.col("focus") == n, ",".join(names)).otherwise(targets)
    return placed.select("run_id", earlier.alias("iteration"), "focus", targets.alias("targets"))


def objective_cycle(iterations: DataFrame, cycle: Sequence[str]) -> DataFrame:
    """Targets of each iteration (from 1) when no quotas are given."""
    turns = F.array(*[F.lit(c) for c in cycle])
    return iterations.withColumn("targets", F.element_at(turns, (F.pmod(F.col("iteration") - 1, F.lit(len(cycle))) + 1).cast("int")))
