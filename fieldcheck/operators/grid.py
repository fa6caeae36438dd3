"""Regular grids as long tables: coordinates, blocks, patches, tensors.

Cells are (field_id, sample, y, x, value); coordinates are (axis, idx, value) with idx 0..n-1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.columns import cf_micros, cf_status, finite, longitude_360
from fieldcheck.operators.ordered import ranked


def limit_samples(cells: DataFrame, n: int) -> DataFrame:
    """Samples 0..n-1; the bound reaches the scan."""
    return cells.filter(F.col("sample") < n)


KEPT_MODES = ("none", "cf_datetime")
SORTED_MODES = ("ascending", "cf_datetime_ascending", "longitude_modulo_360")


def normalise_coordinates(coords: DataFrame) -> DataFrame:
    """New order of each axis by its `mode`; `source_idx` keeps the old position.

    none and cf_datetime keep the order, ascending, cf_datetime_ascending and longitude_modulo_360 sort; any
    other mode, and none given, is an error. Ties keep their source order. Time axes come decoded (decode_cf_time).
    """
    mode = F.col("mode")
    v = F.when(mode == "longitude_modulo_360", longitude_360(F.col("value"))).otherwise(F.col("value"))
    unknown = F.raise_error(F.concat(F.lit("unknown coordinate mode "), F.coalesce(mode, F.lit("null")))).cast("double")
    place = (
        F.when(mode.isin(*KEPT_MODES), F.col("idx").cast("double")).when(mode.isin(*SORTED_MODES), v).otherwise(unknown)
    )
    ready = coords.select("axis", F.col("idx").alias("source_idx"), v.alias("value"), place.alias("_place"))
    return ranked(ready, ["axis"], ["_place", "source_idx"], "_rank").select(
        "axis", (F.col("_rank") - 1).alias("idx"), "source_idx", "value"
    )


def validate_coordinates(coords: DataFrame, spec: DataFrame, policy: Sequence[str] = ()) -> DataFrame:
    """Checks per axis: finite, unique, strictly monotonic, constant step, declared type, fill value and metadata.

    coords(axis, idx, value[, epoch_micros]) with contiguous idx: an axis has numbers or, decoded (decode_cf),
    instants. spec(axis, monotonic, expected_step[, expected_step_seconds][, expected_dtype, expected_fill,
    metadata][, dtype, fill, attrs]): metadata and attrs map names to texts; what is declared null is not checked, fill
    values NaN are equal. Steps are exact, those in seconds are for instants alone and the others for numbers alone, else
    step_ok is false. Attributes named by `policy` count as policy_ok, not as metadata_ok. Each value meets its
    successor in an equi-join on the next index, which spreads a long axis evenly.
    """
    instant = F.col("epoch_micros") if "epoch_micros" in coords.columns else F.lit(None).cast("long")
    here = coords.select("axis", "idx", "value", instant.alias("_t"))
    after = here.select("axis", (F.col("idx") - 1).alias("idx"), F.col("value").alias("_next"), F.col("_t").alias("_tnext"))
    # either difference is null on the other kind of axis
    steps = here.join(after, ["axis", "idx"], "left").withColumns({"_d": F.col("_next") - F.col("value"), "_s": F.col("_tnext") - F.col("_t")})
    repeats = (
        here.groupBy("axis", "value", "_t")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("axis")
        .agg(F.count(F.lit(1)).alias("_distinct"))
    )
    measured = steps.groupBy("axis").agg(
        F.count(F.lit(1)).alias("length"),
        F.count_if(~finite(F.col("value")) & F.col("_t").isNull()).alias("not_finite"),
        F.bool_or(F.col("_t").isNotNull()).alias("_instants"),
        F.bool_and(F.coalesce(F.col("_d") > 0, F.col("_s") > 0)).alias("_rising"),
        F.bool_and(F.coalesce(F.col("_d") < 0, F.col("_s") < 0)).alias("_falling"),
        *[f(F.abs(c)).alias(f"{n}{c}") for c in ("_d", "_s") for f, n in ((F.min, "_min"), (F.max, "_max"))],
    )
    declared = lambda c, kind="string": F.col(c) if c in spec.columns else F.lit(None).cast(kind)
    step, seconds = F.col("expected_step"), declared("expected_step_seconds", "double")
    monotonic = F.when(F.col("monotonic") == "increasing", F.col("_rising")).when(F.col("monotonic") == "decreasing", F.col("_falling"))
    even = (F.col("_min_d") == step) & (F.col("_max_d") == step)
    timed = (F.col("_min_s") == seconds * F.lit(1e6)) & (F.col("_max_s") == seconds * F.lit(1e6))
    wrong_kind = (F.col("_instants") & step.isNotNull()) | (~F.col("_instants") & seconds.isNotNull())
    yes = lambda c: F.coalesce(c, F.lit(True))

    fill, wanted_fill = F.lower(declared("fill")), F.lower(declared("expected_fill"))
    attrs, metadata = declared("attrs", "map<string,string>"), declared("metadata", "map<string,string>")
    off = F.filter(F.map_entries(metadata), lambda e: ~F.coalesce(F.element_at(attrs, e["key"]) == e["value"], F.lit(False)))
    ours = lambda e: e["key"].isin(*policy) if policy else F.lit(False)
    return (
        measured.join(repeats, "axis")
        .join(spec, "axis", "left")
        .select(
            "axis",
            "length",
            "not_finite",
            (F.col("length") - F.col("_distinct")).alias("duplicates"),
            yes(monotonic).alias("monotonic_ok"),
            (yes(even) & yes(timed) & ~wrong_kind).alias("step_ok"),
            yes(declared("expected_dtype").isNull() | declared("dtype").eqNullSafe(declared("expected_dtype"))).alias("dtype_ok"),
            yes(wanted_fill.isNull() | fill.eqNullSafe(wanted_fill)).alias("fill_ok"),
            yes(F.size(F.filter(off, lambda e: ~ours(e))) <= 0).alias("metadata_ok"),
            yes(F.size(F.filter(off, ours)) <= 0).alias("policy_ok"),
        )
    )


#: A date, or a date and a time, as ISO 8601 writes them.
ISO_TIME = r"^\s*\d{4}-\d{2}(-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?)?)?\s*$"


def iso_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO text, UTC where it names no zone; null where it is none."""
    plain = F.regexp_replace(F.trim(text), r"([T ]\d{2})$", "$1:00")
    return F.when(text.rlike(ISO_TIME), F.unix_micros(F.try_to_timestamp(F.replace(plain, F.lit("T"), F.lit(" ")))))


def decode_cf(times: DataFrame) -> DataFrame:
    """times(value, units, calendar[, iso][, native], ...) plus status and epoch_micros.

    One of three holds a time: `native`, a timestamp; `iso`, a text; or a number with its units. A text that is
    no ISO time is text_unsupported. Units and calendar matter to numbers alone.
    """
    native = F.col("native") if "native" in times.columns else F.lit(None).cast("timestamp")
    iso = F.col("iso") if "iso" in times.columns else F.lit(None).cast("string")
    text = iso_micros(iso)
    status = (
        F.when(native.isNotNull(), "decoded")
        .when(text.isNotNull(), "decoded")
        .when(iso.isNotNull(), "text_unsupported")
        .otherwise(cf_status(F.col("units"), F.col("calendar")))
    )
    numeric = F.when(native.isNull() & iso.isNull(), cf_micros(F.col("value"), F.col("units")))
    micros = F.when(F.col("status") == "decoded", F.coalesce(F.unix_micros(native), text, numeric))
    return times.withColumn("status", status).withColumn("epoch_micros", micros)


def pick_cf_coordinate(arrays: DataFrame) -> DataFrame:
    """The CF time coordinate on the sample dimension of every store.

    arrays(store, path, dims, dtype, units, standard_name, declared). The declared coordinate
    stays when it is a CF time itself or no other is; several others are an error, and so is a declared
    one that does not lie on the sample dimension.
    """
    units = F.coalesce("units", F.lit("")).rlike(r"(?i)^\s*(seconds|minutes|hours|days)\s+since\s+.+")
    named = (F.col("dtype") == "string") & (F.lower(F.coalesce("standard_name", F.lit(""))) == "time")
    cf = (F.col("dtype") == "datetime") | units | named
    other = cf & ~F.col("declared") & (F.col("dims") == "sample")
    found = arrays.groupBy("store").agg(
        F.max(F.when(F.col("declared"), F.col("path"))).alias("_own"),
        F.count_if(F.col("declared") & cf).alias("_own_cf"),
        F.count_if(F.col("declared") & ~F.col("dims").eqNullSafe("sample")).alias("_astray"),
        F.count_if(other).alias("candidates"),
        F.min(F.when(other, F.col("path"))).alias("_other"),
    )
    auxiliary = (F.col("_own_cf") == 0) & (F.col("candidates") == 1)
    many = (F.col("_own_cf") == 0) & (F.col("candidates") > 1)
    return found.select(
        "store",
        "candidates",
        F.when(F.col("_astray") > 0, "not_on_sample").when(many, "ambiguous").when(auxiliary, F.col("_other")).otherwise(F.col("_own")).alias("coordinate"),
    )


def reindex(cells: DataFrame, orders: DataFrame) -> DataFrame:
    """Physical to logical indices. orders(axis, source_idx, idx) of normalised axes.

    The order tables are joined without a hint: Spark broadcasts them below its size limit and
    shuffles otherwise.
    """
    out = cells
    for axis in ("sample", "y", "x"):
        step = orders.filter(F.col("axis") == axis).select(
            F.col("source_idx").alias(axis), F.col("idx").alias("_new")
        )
        out = out.join(step, axis, "left").withColumn(axis, F.coalesce("_new", axis)).drop("_new")
    return out.select(*cells.columns)


AXES = ("sample", "y", "x")
#: An axis is halved at most once for each bit of its length.
HALVINGS = 63 * len(AXES)


def block_widths(shapes: DataFrame, max_elements: int) -> DataFrame:
    """shapes with sample_width, y_width, x_width: the block of a grid with the lengths sample, y, x.

    The longest axis (the first of equals) is halved, rounded up, while a block has more than
    max_elements cells. A fold over column expressions; rows are grids.
    """

    def halved(w: Column, _: Column) -> Column:
        cells = w["sample"].cast("double") * w["y"] * w["x"]
        longest = F.greatest(*(w[a] for a in AXES))
        turn = F.array_position(F.array(*(w[a] for a in AXES)), longest)
        shorter = lambda i, a: F.when(turn == i + 1, F.ceil(w[a] / 2)).otherwise(w[a]).cast("long").alias(a)
        return F.when(cells > max(1, max_elements), F.struct(*(shorter(i, a) for i, a in enumerate(AXES)))).otherwise(w)

    start = F.struct(*(F.col(a).cast("long").alias(a) for a in AXES))
    folded = shapes.withColumn("_w", F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halved))
    return folded.withColumns({f"{a}_width": F.col("_w")[a] for a in AXES}).drop("_w")


def block_ids(cells: DataFrame, widths: DataFrame) -> DataFrame:
    """Complete, non-overlapping block number per axis; widths is the one row of this grid's block_widths."""
    width = lambda a: widths.select(f"{a}_width").scalar()
    return cells.withColumns({f"{a}_block": F.floor(F.col(a) / width(a)) for a in AXES})


def grid_sizes(cells: DataFrame) -> DataFrame:
    """One row with the length of each axis, from the largest index."""
    return cells.agg(*[(F.max(a) + 1).alias(a) for a in ("sample", "y", "x")])


def seeded(key: Column, seed: int, bound: Column, salt: str) -> Column:
    """Repeatable draw in 0..bound-1: the first 60 bits of an MD5, which other engines can draw too."""
    text = F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % bound


def patches(cells: DataFrame, height: int, width: int, size: int, mode: str, seed: int, chunk: int | None = None) -> DataFrame:
    """One square window per sample, drawn from its index, with window-relative y and x.

    `chunk_aligned` starts on a chunk corner; `misaligned` starts anywhere but on one.
    """
    if size > height or size > width:
        raise ValueError("patch exceeds the grid")
    s = F.col("sample")
    if mode == "chunk_aligned":
        if chunk != size:
            raise ValueError("aligned patches need size = chunk")
        top = seeded(s, seed, F.lit((height - size) // chunk + 1), "top") * chunk
        left = seeded(s, seed, F.lit((width - size) // chunk + 1), "left") * chunk
    elif mode == "misaligned":
        t = seeded(s, seed, F.lit(height - size + 1), "top")
        le = seeded(s, seed, F.lit(width - size + 1), "left")
        if chunk:
            corner = (t % chunk == 0) & (le % chunk == 0)
            left = F.when(corner & (le < width - size), le + 1).otherwise(le)
            top = F.when(corner & (le >= width - size) & (t < height - size), t + 1).otherwise(t)
        else:
            top, left = t, le
    else:
        raise ValueError(f"unknown patch mode {mode!r}")
    placed = cells.withColumns({"top": top, "left": left})
    inside = (
        (F.col("y") >= F.col("top"))
        & (F.col("y") < F.col("top") + size)
        & (F.col("x") >= F.col("left"))
        & (F.col("x") < F.col("left") + size)
    )
    return placed.filter(inside).withColumns({"y": F.col("y") - F.col("top"), "x": F.col("x") - F.col("left")})


def shape_report(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """Axis lengths and cell count per channel against expected(field_id, samples, height, width)."""
    seen = cells.groupBy("field_id").agg(
        (F.max("sample") + 1).alias("n_sample"),
        (F.max("y") + 1).alias("n_y"),
        (F.max("x") + 1).alias("n_x"),
        F.count(F.lit(1)).alias("cells"),
    )
    full = F.col("cells") == F.col("n_sample") * F.col("n_y") * F.col("n_x")
    same = (
        (F.col("n_sample") == F.col("samples")) & (F.col("n_y") == F.col("height")) & (F.col("n_x") == F.col("width"))
    )
    return seen.join(expected, "field_id", "full_outer").select(
        "field_id",
        "n_sample",
        "n_y",
        "n_x",
        "cells",
        F.coalesce(full, F.lit(False)).alias("complete"),
        F.coalesce(same, F.lit(False)).alias("as_expected"),
    )


def integrity(cells: DataFrame) -> DataFrame:
    """Reads every cell; per channel the cells, present values and finite values."""
    return cells.groupBy("field_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count("value").alias("values"),
        F.count_if(finite(F.col("value"))).alias("finite_values"),
    )


def logical_bytes(cells: DataFrame, cell_bytes: int = 4, coordinate_bytes: int = 8) -> DataFrame:
    """Uncompressed bytes of cells plus the three coordinates."""
    n = cells.agg(
        F.count(F.lit(1)).alias("cells"),
        *[(F.max(a) + 1).alias(f"n_{a}") for a in ("sample", "y", "x")],
    )
    coords = (F.col("n_sample") + F.col("n_y") + F.col("n_x")) * coordinate_bytes
    return n.select("cells", coords.alias("coordinate_bytes"), (F.col("cells") * cell_bytes + coords).alias("total_bytes"))


MIN_BLOCK_ROWS = 16
FLOAT_BYTES = 4


def rows_per_block(height: Column, width: Column, target_bytes: int = 1536 * 1024) -> Column:
    """How many grid rows fit target_bytes of float32: MIN_BLOCK_ROWS or more, never above the height.

    A grid without columns is one block.
    """
    fitting = F.when(width > 0, F.floor(F.lit(target_bytes) / (width * FLOAT_BYTES)))
    return F.greatest(F.lit(1), F.least(height, F.greatest(F.lit(MIN_BLOCK_ROWS), F.coalesce(fitting, height))))


def grid_blocks(cells: DataFrame, rows_per_block: Column) -> DataFrame:
    """One row per (field, sample, y range) with its cells in y, x order.

    A block holds rows_per_block x width cells, a size fixed by the layout, not by the data.
    """
    return (
        cells.groupBy("field_id", "sample", F.floor(F.col("y") / rows_per_block).alias("y_block"))
        .agg(
            F.min("y").alias("y0"),
            (F.max("y") - F.min("y") + 1).alias("height"),
            (F.max("x") + 1).alias("width"),
            F.sort_array(F.collect_list(F.struct("y", "x", F.col("value").cast("float").alias("v")))).alias("_c"),
        )
        .select(
            "field_id", "sample", "y_block", "y0", "height", "width", F.transform("_c", lambda c: c["v"]).alias("cells")
        )
    )


BLOCK_CELLS = 1 << 16


def tensor_pack(cells: DataFrame, channels: Sequence[str], block_cells: int = BLOCK_CELLS) -> DataFrame:
    """One [C, H, W] float32 tensor per sample, channels in the given order, as blocks of fixed size.

    A row is (sample, c, h, w, block, first, cells, filled, data): `data` holds the little-endian float32 of
    the places first, first + 1, .. of the tensor in (c, y, x) order, NaN where there is no cell or no value;
    `cells` counts the cells met and `filled` the places they take; a block without any cell is no row. Cells are sorted by place and written
    into one block at a time, so a task holds a block, however large the tensor is. A sample whose channels
    differ in height or width ends the job, as its tensor has no shape; a channel it lacks altogether lowers `c`.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("field_id")) - 1
    known = cells.filter(F.col("field_id").isin(*channels)).withColumn("_c", order)
    shapes = known.groupBy("sample", "_c").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    one = shapes.groupBy("sample").agg(
        F.count(F.lit(1)).alias("c"), F.max("h").alias("h"), F.max("w").alias("w"),
        ((F.min("h") < F.max("h")) | (F.min("w") < F.max("w"))).alias("_mixed"),
    )
    refusal = F.raise_error(F.concat(F.lit("channels of unequal shape in sample "), F.col("sample").cast("string")))
    one = one.withColumn("h", F.when(F.col("_mixed"), refusal.cast("int")).otherwise(F.col("h"))).drop("_mixed")
    place = (F.col("_c") * F.col("h") + F.col("y")) * F.col("w") + F.col("x")
    placed = known.join(one, "sample").select(
        "sample", "c", "h", "w", F.floor(place / block_cells).alias("block"), place.alias("place"),
        F.col("value").cast("float").alias("v"),
    )
    key = ["sample", "block"]
    kind = cells.schema["sample"].dataType.simpleString()
    count, height, width = (one.schema[n].dataType.simpleString() for n in ("c", "h", "w"))
    schema = (
        f"sample {kind}, c {count}, h {height}, w {width}, block bigint, first bigint, cells bigint, filled bigint, data binary"
    )
    return placed.repartition(*key).sortWithinPartitions(*key, "place").mapInArrow(_assembled(len(channels), block_cells), schema)


def _assembled(channels: int, block_cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted cells to blocks, each handed on as soon as the next one begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict | None = None
        data = known = np.zeros(0)

        def done() -> pa.RecordBatch:
            head["filled"] = int(known.sum())
            return pa.RecordBatch.from_pylist([head | {"data": data.astype("<f4").tobytes()}], schema=out)

        out: pa.Schema | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or pa.schema(
                [batch.schema.field(n) for n in ("sample", "c", "h", "w", "block")]
                + [(n, pa.int64()) for n in ("first", "cells", "filled")] + [("data", pa.binary())]
            )
            sample, block = batch.column("sample"), batch.column("block").to_numpy()
            codes = sample.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            place, value = batch.column("place").to_numpy(), batch.column("v").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(codes) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                names = {n: batch.column(n)[a].as_py() for n in ("sample", "c", "h", "w", "block")}
                if head is None or any(head[n] != v for n, v in names.items()):
                    if head is not None:
                        yield done()
                    first = names["block"] * block_cells
                    size = min(block_cells, channels * names["h"] * names["w"] - first)
                    head = names | {"first": first, "cells": 0}
                    data, known = np.full(size, np.nan, np.float32), np.zeros(size, bool)
                data[place[a:b] - head["first"]] = value[a:b]
                known[place[a:b] - head["first"]] = True
                head["cells"] += b - a
        if head is not None:
            yield done()

    return run


def tensor_check(blocks: DataFrame, c: int, h: int, w: int) -> DataFrame:
    """Whether each tensor has the declared shape and each of its places one cell."""
    whole = blocks.groupBy("sample", "c", "h", "w").agg(F.sum("cells").alias("cells"), F.sum("filled").alias("filled"))
    shape = (F.col("c") == c) & (F.col("h") == h) & (F.col("w") == w)
    full = (F.col("cells") == c * h * w) & (F.col("filled") == c * h * w)
    return whole.select("sample", "c", "h", "w", "cells", (shape & full).alias("accepted"))


def tensor_reduce(blocks: DataFrame) -> DataFrame:
    """First element and full sum of each tensor; a block is summed where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x.as_py(), "<f4") for x in batch.column("data")]
            first = [float(p[0]) if n == 0 else None for p, n in zip(parts, batch.column("first").to_pylist(), strict=True)]
            total = [float(p.sum(dtype=np.float64)) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sample"), pa.array(first, pa.float64()), pa.array(total, pa.float64())],
                ["sample", "marker", "total"],
            )

    kind = blocks.schema["sample"].dataType.simpleString()
    sums = blocks.select("sample", "first", "data").mapInArrow(run, f"sample {kind}, marker double, total double")
    return sums.groupBy("sample").agg(F.max("marker").alias("marker"), F.sum("total").alias("total"))


def tensor_values(blocks: DataFrame) -> DataFrame:
    """The blocks with their data as an array of floats, for readers without numpy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(x.as_py(), "<f4") for x in batch.column("data")]
            cuts = np.cumsum([0, *map(len, data)])
            flat = np.concatenate([*data, np.zeros(0, "<f4")])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.float32()))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([lists if n == "data" else batch.column(n) for n in names], names)

    fields = ", ".join(f"{n} {'array<float>' if n == 'data' else t}" for n, t in blocks.dtypes)
    return blocks.mapInArrow(run, fields)


def sample_order(samples: DataFrame, seed: int) -> DataFrame:
    """One seeded permutation of the samples, the same for every pass over them."""
    keyed = samples.select("sample", F.md5(F.concat_ws(":", F.col("sample").cast("string"), F.lit(str(seed)))).alias("_h"))
    return ranked(keyed, [], ["_h", "sample"], "_rank").select(
        "sample", (F.col("_rank") - 1).alias("position")
    )
