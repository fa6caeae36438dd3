"""Language model scoring: a gated recurrent network over words, next to exact corpus counts.

Counts of all training words are a table; the most frequent ones, a bounded number, also go to the workers.
The network reads and predicts entries, with a softmax that is factored into classes of them: every frequent
word is an entry of its own, the other counted words share one a band of frequency, and one stands for the rest.
Inside a band the exact counts tell a word's share. The network is trained in numpy by truncated
backpropagation: every task trains a copy once on all of its training texts, and the copies are averaged by the
words they saw (so weights depend on how the texts are dealt over tasks). Texts lie in many lanes side by
side, cut window by window. Scoring carries the state across windows, so a text counts as a whole.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.llm.common import joined_bytes, mixed, most_frequent, query, table, written
from fieldcheck.llm.language_id import id_crc
from fieldcheck.llm.slices import hash_slices, lowered, words

#: Words counted in the workers (16 bytes each); the others' counts are joined. They have an entry of their own or a band.
HEAD = 1 << 17
#: Classes of the softmax, entries in each. The first class holds entry 0, for words beyond the head, and the bands.
CLASSES, IN_CLASS = 32, 32
HIDDEN = 16
TRAIN_LANES, TRAIN_WINDOW, RATE = 256, 16, 0.02
#: Tokens that make a step: where few lanes go on, their windows wait for more.
STEP = 2048
LANES, WINDOW = 256, 64
#: Tasks' copies of a block of weights are averaged in this many groups before they meet.
GROUPS = 16
#: Tokens a task scores, trains on or counts together: bounds its memory.
HELD = 2 << 20
BLOCK = 4096
END = int(mixed(np.array([0x454E44], np.uint64))[0])


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, each text's end behind them, and the offsets of the texts."""
    raw, offsets = joined_bytes(column)
    raw = lowered(raw)
    starts, ends, first = words(raw, offsets)
    n = len(column)
    out = np.full(len(starts) + n, END, np.uint64)
    row = np.repeat(np.arange(n), np.diff(first))
    out[np.arange(len(starts)) + row] = hash_slices(raw, starts, ends)
    return out, first + np.arange(n + 1)


# --- counts -------------------------------------------------------------------------------------


def counted(docs: DataFrame) -> DataFrame:
    """word, n: how often each token occurs in the texts; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def sums() -> Iterator[pa.RecordBatch]:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(word), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word[part].view(np.int64)), pa.array(n[part], pa.int64())], ["word", "n"]
                )

        for batch in batches:
            if batch.num_rows:
                held.append(tokens(batch.column("text"))[0])
                size += len(held[-1])
            if size >= HELD:
                yield from sums()
                held, size = [], 0
        if held:
            yield from sums()

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """The most frequent training words, by hash, with their counts and places in the short list."""

    words: np.ndarray
    counts: np.ndarray
    place: np.ndarray  # entry of each word
    listed: np.ndarray  # count of each entry's words; 0 for entry 0
    kinds: np.ndarray  # number of each entry's words
    total: int
    distinct: int

    def share(self, count: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 of each word's part of its entry, 0 for entry 0, whose words are shared out by the joined counts."""
        whole = self.listed[place] + 0.5 * self.kinds[place]
        return np.where(place > 0, np.log10(np.maximum(count, 0) + 0.5) - np.log10(np.maximum(whole, 0.5)), 0.0)

    def look_up(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and entry of each token; -1 and 0 where the head lacks it."""
        if not len(self.words):
            return np.full(len(found), -1), np.zeros(len(found), np.int32)
        at = np.minimum(np.searchsorted(self.words, found), len(self.words) - 1)
        known = self.words[at] == found
        return np.where(known, self.counts[at], -1), np.where(known, self.place[at], 0)

    @property
    def other_total(self) -> int:
        return self.total - int(self.listed.sum())

    @property
    def other_distinct(self) -> int:
        return self.distinct - int(self.kinds.sum())


def head_of(counts: DataFrame) -> Head:
    """At most HEAD rows, a histogram and two sums reach the driver."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts, "n", HEAD).sort_values(["n", "word"], ascending=[False, True])
    word, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    size = CLASSES * IN_CLASS
    place = IN_CLASS + np.arange(len(n), dtype=np.int32)
    bands = 1 + np.minimum(np.log2(n).astype(np.int32), IN_CLASS - 2)  # an octave of counts each
    place = np.where(place < size, place, bands).astype(np.int32)
    listed, kinds = (np.bincount(place, w, size).astype(np.int64) for w in (n, None))
    order = np.argsort(word)
    return Head(word[order], n[order], place[order], listed, kinds, int(total["n"]), int(total["v"]))


# --- the network --------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.negative(x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, shifted only if it has to be, its exponentials, and their sum in each row; x is used up."""
    if max(x.max(), -x.min()) > 60:  # else nothing runs out of the range of single precision
        x = x - x.max(1, keepdims=True)
    e = np.exp(x)
    return x, e, e @ np.ones(x.shape[1], x.dtype)


class Network:
    """Gated recurrent units with a class-factored softmax over the entries.

    inputs: each word's share of the three gates; state, bias: the state's share. Tokens come as arrays
    (steps, lanes); `fresh` marks a text's first token, before which the state is zero.
    """

    NAMES = ("inputs", "state", "bias", "classes", "class_bias", "words", "word_bias")

    def __init__(self, listed: np.ndarray, others: int, hidden: int = HIDDEN, dtype: type = np.float32) -> None:
        draw = np.random.default_rng(7)
        size = len(listed)
        self.hidden = hidden
        n = listed.astype(np.float64)
        n[0] = others
        n += 0.5
        mass = n.reshape(CLASSES, -1).sum(1)
        self.inputs = draw.normal(0, 0.1, (size, 3 * hidden)).astype(dtype)
        self.state = draw.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(dtype)
        self.bias = np.zeros(3 * hidden, dtype)
        self.classes = np.zeros((hidden, CLASSES), dtype)
        self.class_bias = np.log(mass / mass.sum()).astype(dtype)
        self.words = np.zeros((CLASSES, hidden, size // CLASSES), dtype)
        self.word_bias = np.log(n.reshape(CLASSES, -1) / mass[:, None]).astype(dtype)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(old.dtype))
            at += old.size
        return self

    def run(self, h: np.ndarray, token: np.ndarray, fresh: np.ndarray, keep: bool = False):
        """States before each token (steps, lanes, hidden), the state at the end, and what backward() needs."""
        hidden = self.hidden
        before = np.empty((*token.shape, hidden), h.dtype)
        gates = self.inputs[token]
        live = (~fresh).astype(h.dtype)[..., None]
        kept = []
        for t in range(len(token)):
            h = h * live[t]
            before[t] = h
            own = h @ self.state + self.bias
            zr = _sigmoid(gates[t, :, : 2 * hidden] + own[:, : 2 * hidden])
            z, r = zr[:, :hidden], zr[:, hidden:]
            new = np.tanh(gates[t, :, 2 * hidden :] + r * own[:, 2 * hidden :])
            if keep:
                kept.append((z, r, new, own[:, 2 * hidden :]))
            h = new + z * (h - new)
        return before, h, (live, kept)

    def log_chance(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural log probability of each token, by the state before it; flat arrays."""
        wide = self.words.shape[2]
        order, cuts = _by_class(token // wide)
        before, token = before[order], token[order]
        x, _, total = _exponentials(before @ self.classes + self.class_bias)
        logs = x[np.arange(len(token)), token // wide] - np.log(total)
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[c], cuts[c + 1]
            x, _, total = _exponentials(before[a:b] @ self.words[c] + self.word_bias[c])
            logs[a:b] += x[np.arange(b - a), token[a:b] - c * wide] - np.log(total)
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def gradients(self, h: np.ndarray, token: np.ndarray, fresh: np.ndarray, real: np.ndarray):
        """Loss over the real tokens of a window, its gradients, and the state to go on with."""
        before, end, (live, kept) = self.run(h, token, fresh, keep=True)
        hidden, wide = self.hidden, self.words.shape[2]
        grads = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        pick = np.flatnonzero(real.ravel())
        order, cuts = _by_class(token.ravel()[pick] // wide)
        pick = pick[order]  # class by class
        states, target = before.reshape(-1, hidden)[pick], token.ravel()[pick]
        x, d, total = _exponentials(states @ self.classes + self.class_bias)
        row, group = np.arange(len(pick)), target // wide
        loss = float((np.log(total) - x[row, group]).sum(dtype=np.float64))
        d /= total[:, None]
        d[row, group] -= 1
        grads["classes"], grads["class_bias"] = states.T @ d, d.sum(0)
        back = d @ self.classes.T
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            own = states[cuts[c] : cuts[c + 1]]
            x, d, total = _exponentials(own @ self.words[c] + self.word_bias[c])
            row, inner = np.arange(len(own)), target[cuts[c] : cuts[c + 1]] - c * wide
            loss += float((np.log(total) - x[row, inner]).sum(dtype=np.float64))
            d /= total[:, None]
            d[row, inner] -= 1
            grads["words"][c], grads["word_bias"][c] = own.T @ d, d.sum(0)
            back[cuts[c] : cuts[c + 1]] += d @ self.words[c].T
        out = np.zeros((token.size, hidden), h.dtype)
        out[pick] = back
        out = out.reshape(before.shape)
        # of each step: what the gates take from the inputs, and from the state
        d_in = np.empty((*token.shape, 3 * hidden), h.dtype)
        d_own = np.empty_like(d_in)
        d_h = np.zeros_like(h)
        turned = np.ascontiguousarray(self.state.T)
        for t in range(len(token) - 1, -1, -1):
            z, r, new, own = kept[t]
            d_z, d_r, d_new = (d_in[t, :, i * hidden : (i + 1) * hidden] for i in range(3))
            np.multiply(d_h * (1 - z), 1 - new * new, out=d_new)
            np.multiply(d_h * (before[t] - new), z * (1 - z), out=d_z)
            np.multiply(d_new * own, r * (1 - r), out=d_r)
            d_own[t, :, : 2 * hidden] = d_in[t, :, : 2 * hidden]
            np.multiply(d_new, r, out=d_own[t, :, 2 * hidden :])
            d_h *= z
            d_h += d_own[t] @ turned
            d_h += out[t]
            d_h *= live[t]
        flat = d_own.reshape(-1, 3 * hidden)
        grads["state"], grads["bias"] = before.reshape(-1, hidden).T @ flat, flat.sum(0)
        # each entry's rows are summed where they lie side by side
        seen = token.ravel()
        order = np.argsort(seen.astype(np.uint16 if len(self.inputs) <= 1 << 16 else seen.dtype), kind="stable")
        first = np.flatnonzero(np.diff(seen[order], prepend=-1))
        sums = np.cumsum(d_in.reshape(-1, 3 * hidden)[order], 0, dtype=np.float64)
        last = np.append(first[1:], len(order)) - 1
        grads["inputs"][seen[order][first]] = np.diff(sums[last], axis=0, prepend=0)
        return loss, grads, end


def _by_class(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts the rows of each class side by side, and where each class begins."""
    order = np.argsort(group.astype(np.uint16), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(group, minlength=CLASSES))])


class Trainer:
    """Adam steps over windows; the state goes on from window to window, gradients do not."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.first = {k: np.zeros_like(getattr(network, k)) for k in network.NAMES}
        self.second = {k: np.zeros_like(getattr(network, k)) for k in network.NAMES}
        self.waiting = {k: np.zeros_like(getattr(network, k)) for k in network.NAMES}
        self.steps = self.waits = 0

    def train(self, texts: list[np.ndarray]) -> None:
        laid = Lanes(texts, TRAIN_LANES)
        h = np.zeros((laid.count, self.network.hidden), np.float32)
        for token, fresh, real, _ in laid.windows(TRAIN_WINDOW):
            _, grads, h = self.network.gradients(h[: token.shape[1]], token, fresh, real)
            for k, g in grads.items():
                self.waiting[k] += g
            self.waits += int(real.sum())
            if self.waits >= STEP:
                self.step()

    def step(self) -> None:
        """Takes what has gathered; a part of a step moves the weights by that part."""
        if not self.waits:
            return
        self.steps += 1
        rate = RATE * min(1.0, self.waits / STEP)
        for k, g in self.waiting.items():
            g = np.clip(g / self.waits, -1, 1)
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            m, v = self.first[k] / (1 - 0.9**self.steps), self.second[k] / (1 - 0.99**self.steps)
            getattr(self.network, k)[...] -= rate * m / (np.sqrt(v) + 1e-8)
            self.waiting[k][...] = 0
        self.waits = 0


class Lanes:
    """Texts one behind the other in lanes of about equal length, the longest first; lanes by falling length."""

    def __init__(self, texts: list[np.ndarray], most: int) -> None:
        self.count = max(1, min(most, len(texts)))
        heap = [(0, i) for i in range(self.count)]
        held: list[list[int]] = [[] for _ in range(self.count)]
        for i in np.argsort([-len(t) for t in texts], kind="stable").tolist():
            size, lane = heap[0]
            held[lane].append(i)
            heapq.heapreplace(heap, (size + len(texts[i]), lane))
        filled = np.zeros(self.count, np.int64)
        for size, lane in heap:
            filled[lane] = size
        by_length = np.argsort(-filled, kind="stable")
        self.filled = filled[by_length]
        self.base = np.cumsum(self.filled) - self.filled
        order = [i for lane in by_length.tolist() for i in held[lane]]
        self.line = np.concatenate([np.zeros(0, np.int32), *[texts[i] for i in order]])
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        starts = np.cumsum(sizes) - sizes
        self.start = np.zeros(len(texts), np.int64)
        self.start[order] = starts
        self.fresh = np.zeros(len(self.line) + 1, bool)
        self.fresh[starts] = True

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """token, fresh, real and place in `line`, (steps, lanes) each; lanes that have ended drop out."""
        for t in range(0, int(self.filled[0]), size):
            width = int(np.searchsorted(-self.filled, -t))
            step = np.arange(t, min(t + size, int(self.filled[0])))[:, None]
            real = step < self.filled[:width]
            at = np.where(real, self.base[:width] + step, 0)
            yield self.line[at], self.fresh[at] & real, real, at


def log_likelihoods(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each text's entries, state carried from window to window."""
    laid = Lanes(texts, LANES)
    sums = np.zeros(len(laid.line) + 1)
    h = np.zeros((laid.count, network.hidden), np.float32)
    for token, fresh, real, at in laid.windows(WINDOW):
        before, h, _ = network.run(h[: token.shape[1]], token, fresh)
        flat = network.log_chance(before.reshape(-1, network.hidden), token.ravel())
        sums[at[real] + 1] = flat.reshape(token.shape)[real]
    np.cumsum(sums, out=sums)
    sizes = np.array([len(t) for t in texts], np.int64)
    return sums[laid.start + sizes] - sums[laid.start]


def train(docs: DataFrame, head: Head) -> Network:
    """A network averaged from the copies that the tasks train; blocks of its weights are averaged apart.

    A null text is its end alone; repeated texts are trained on as often as they stand there. Without texts
    the network stays at the counts.
    """
    network = Network(head.listed, head.other_total)
    shared = docs.sparkSession.sparkContext.broadcast((head, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, start = shared.value
        trainer = Trainer(Network(head.listed, head.other_total).load(start.flat()))
        held: list[np.ndarray] = []
        size = seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            found, offsets = tokens(batch.column("text"))
            place = head.look_up(found)[1]
            held += [place[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            size += len(found)
            seen += len(found)
            if size >= HELD:
                trainer.train(held)
                held, size = [], 0
        if held:
            trainer.train(held)
        trainer.step()
        if seen:
            flat = trainer.network.flat()
            blocks = [flat[i : i + BLOCK].tolist() for i in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(blocks)), pa.int32()),
                    pa.array([seen] * len(blocks), pa.int64()),
                    pa.array(blocks, pa.list_(pa.float32())),
                ],
                ["block", "seen", "weights"],
            )

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                block, seen = batch.column("block")[row].as_py(), batch.column("seen")[row].as_py()
                weights = batch.column("weights")[row].values.to_numpy().astype(np.float64) * seen
                n, old = sums.get(block, (0, 0.0))
                sums[block] = (n + seen, old + weights)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sums), pa.int32()),
                    pa.array([n for n, _ in sums.values()], pa.int64()),
                    pa.array([(w / n).tolist() for n, w in sums.values()], pa.list_(pa.float32())),
                ],
                ["block", "seen", "weights"],
            )

    kind = "block int, seen bigint, weights array<float>"
    copies = docs.select("text").mapInArrow(run, kind)
    some = copies.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).repartition("block", "part").drop("part")
    averaged = some.mapInArrow(mean, kind).repartition("block").mapInArrow(mean, kind).toPandas()
    if not len(averaged):
        return network
    flat = np.concatenate([np.asarray(w) for w in averaged.sort_values("block")["weights"]])
    return Network(head.listed, head.other_total).load(flat)


# --- scores -------------------------------------------------------------------------------------


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Not to be learned from: crc32 of the id as text is 1 modulo 5; a null id counts as an empty text."""
    return id_crc(doc_id) % 5 == 1


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    base_score: by the counts of the training tokens alone; score: the network's log10 probability of the
    text and its end. A null text is empty and has one token, its end. Null and repeated doc_ids are rows
    like others; an empty training table knows no token. Other columns are not looked at.
    """
    spark = docs.sparkSession
    counts = written(counted(training), "counts")
    head = head_of(counts)
    network = train(training, head)
    shared = spark.sparkContext.broadcast((head, network))
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "row", "n_tokens", "known", "logs", "others", "other_logs", "network", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, network = shared.value
        first = int.from_bytes(os.urandom(8), "little", signed=True) >> 2  # rows are named once, then written
        number = 0
        held: list[tuple] = []
        size = 0

        def scored() -> Iterator[pa.RecordBatch]:
            nonlocal number
            places = [p for _, _, texts in held for p, *_ in texts]
            logs = log_likelihoods(network, places)
            at = 0
            for ids, rare, texts in held:
                n = len(texts)
                columns = list(zip(*((len(p), *rest) for p, *rest in texts), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(range(first + number, first + number + n), pa.int64()),
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.float64()),
                        pa.array(columns[3], pa.int64()),
                        pa.array(columns[4], pa.float64()),
                        pa.array(logs[at : at + n] / np.log(10)),
                        rare,
                    ],
                    names,
                )
                at += n
                number += n

        for batch in batches:
            if not batch.num_rows:
                continue
            found, offsets = tokens(batch.column("text"))
            count, place = head.look_up(found)
            known = count >= 0
            cuts = offsets[:-1]
            log = np.where(known, np.log10(np.maximum(count, 0) + 0.5), 0.0)
            share = head.share(count, place)
            sums = [
                np.add.reduceat(x, cuts)
                for x in (known.astype(np.int64), log, (place == 0).astype(np.int64), share)
            ]
            # copied: a slice would hold the whole batch's tokens
            texts = [
                (place[a:b].copy(), int(sums[0][i]), float(sums[1][i]), int(sums[2][i]), float(sums[3][i]))
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))
            ]
            lacking = np.flatnonzero(~known)
            rare_cuts = np.searchsorted(lacking, offsets)
            rare = pa.ListArray.from_arrays(
                pa.array(rare_cuts, pa.int32()), pa.array(found[lacking].view(np.int64), pa.int64())
            )
            held.append((batch.column("doc_id"), rare, texts))
            size += len(found)
            if size >= HELD:
                yield from scored()
                held, size = [], 0
        if held:
            yield from scored()

    schema = (
        f"doc_id {kind}, row bigint, n_tokens bigint, known bigint, logs double, others bigint, other_logs double, "
        "network double, rare array<bigint>"
    )
    found = written(docs.select("doc_id", "text").mapInArrow(run, schema), "scores")

    # Words that the head lacks: their counts are joined, and summed again for each text.
    rare = found.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    rare = (
        rare.join(counts, "word", "left").groupBy("row")
        .agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"),
             F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = float(np.log10(head.total + 0.5 * (head.distinct + 1)))
    other = float(np.log10(head.other_total + 0.5 * (head.other_distinct + 1)))
    return found.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + zero("rare_known")).alias("n_known"),
        F.lit(head.total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + zero("rare_logs") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("network") + F.col("other_logs") + zero("rare_logs") - F.col("others") * other).alias("score"),
    )


@query("op7_lm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, docs.filter(~held_out()))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
