"""Benchmark decontamination: pigeonhole pieces, verified by Myers' bit-parallel edit distance.

A test item may differ from a passage by as many edits as its budget allows. Cut into budget + 1 pieces,
it has at least one piece that such a passage holds unchanged. All pieces of a block of items are looked
up at once; around each hit the whole item is compared with the document.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldcheck.llm.common import map_batches, query, table, texts

#: Edits allowed, as a share of the item's characters.
RATE = 0.08
#: Items with fewer characters say too little to prove a leak; they are not searched.
LEAST = 24
#: Characters of items in one block: bounds what is broadcast and what a worker holds.
BLOCK_CHARS = 1 << 20
HIT = "struct<item_id:bigint,distance:int>"


def normal(text: str) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 pieces of nearly the same size: offset and text."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_distance(item: str, text: str, masks: dict[str, int] | None = None) -> int:
    """Fewest edits that turn the item into some part of the text."""
    masks = bit_masks(item) if masks is None else masks
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)
    best = score
    for c in text:
        equal = masks.get(c, 0)
        x = equal | minus
        d = ((plus + (x & plus)) ^ plus) | x
        up = minus | (full & ~(d | plus))
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up <<= 1  # the text may start anywhere: no cost in the first row
        down <<= 1
        plus = (down | ~(d | up)) & full
        minus = up & d & full
    return best


def bit_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(no, text, int(len(text) * rate), bit_masks(text)) for no, text in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, budget, _) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                where.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[dict]:
        """Items within their budget of some part of the text, with the fewest edits found."""
        text = normal(text)
        starts: dict[int, list[int]] = {}  # where an item would start, if its piece stood at its place
        for end, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                starts.setdefault(i, []).append(end + 1 - size - offset)
        found = []
        for i, places in starts.items():
            no, item, budget, masks = self.items[i]
            best = budget + 1
            for lo, hi in _merged(sorted(places), budget):
                part = text[max(0, lo - budget) : hi + len(item) + budget]
                best = min(best, best_distance(item, part, masks))
            if best <= budget:
                found.append({"item_id": no, "distance": best})
        return sorted(found, key=lambda f: f["item_id"])


def _merged(places: list[int], near: int) -> Iterator[tuple[int, int]]:
    """First and last of the places that lie close together: their windows are searched as one."""
    lo = hi = places[0]
    for p in places[1:]:
        if p - hi > 2 * near:
            yield lo, hi
            lo = p
        hi = p
    yield lo, hi


_matchers: OrderedDict[str, Matcher] = OrderedDict()


def _matcher(block) -> Matcher:
    key, items, rate = block.value
    if key not in _matchers:
        _matchers[key] = Matcher(items, rate)
        if len(_matchers) > 4:  # a worker that goes through many blocks keeps the last ones
            _matchers.popitem(last=False)
    return _matchers[key]


def blocks(items: DataFrame, least: int = LEAST) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (item_id, normalised text), each of about BLOCK_CHARS at most or one item."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if len(text) < least:
            continue
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def mark(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The given rows with `leaks`, an array of (item_id, distance): the items each text holds.

    Null or empty texts hold nothing, items without id or text and those under `least` characters are not
    searched; without items every array is empty. Items of one id are searched each, the id may then be
    listed more than once. Whole texts are searched, every row of `docs` stays, other columns are handed on;
    a column `leaks` is replaced. Items come to the workers block by block, of bounded size each.
    """
    spark = docs.sparkSession
    docs = docs.drop("leaks").withColumn("leaks", F.array().cast(f"array<{HIT}>"))
    for n, block in enumerate(blocks(items, least)):
        shared = spark.sparkContext.broadcast((f"{id(docs)}-{n}-{hash(tuple(block))}-{rate}", block, rate))
        docs = _marked(docs, shared)
    return docs


def _marked(docs: DataFrame, shared) -> DataFrame:
    at = docs.columns.index("leaks")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))

    def work(batch: pa.RecordBatch):
        matcher = _matcher(shared)
        found = [
            old + matcher.find(text)
            for old, text in zip(batch.column(at).to_pylist(), texts(batch.column("text")), strict=True)
        ]
        columns = batch.columns
        columns[at] = pa.array(found, kind)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_batches(docs, work, StructType(docs.schema.fields))


@query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("bigint").alias("n_items"),
        F.array_distinct(F.col("leaks.item_id")).alias("item_ids"),
        F.array_min(F.col("leaks.distance")).alias("least_distance"),
    )
