"""Language identification by interpolated Kneser-Ney models over characters.

One model a language, all in sorted hash arrays that hold a row for each n-gram and a column for each
language. A text gets the language whose model has the lowest cross-entropy per character; what no
model explains is rejected by a threshold that is calibrated on labelled texts the models have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.llm.bpe import LETTER, classes
from fieldcheck.llm.common import map_batches, mixed, query, table

#: Characters of an n-gram.
ORDER = 4
#: Labelled texts a language is learned from, and those that calibrate its threshold (expected numbers: rows are
#: chosen by a hash of text, so the sample is the same wherever the rows lie).
FIT, CALIBRATE = 1500, 500
#: A text is rejected if its cross-entropy lies this far above that of all calibrating texts of its language:
#: a share of the way to a uniform choice among the known characters.
MARGIN = 0.5
UNKNOWN = "und"
_BLANK = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- characters ---------------------------------------------------------------------------------


def letters(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, other characters as one blank after a letter, and the row of each."""
    low = [t.lower() for t in batch]
    codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    letter = classes()[codes] == LETTER
    after = np.zeros(len(codes), bool)
    after[1:] = letter[:-1] & (row[1:] == row[:-1])
    keep = letter | after
    return np.where(letter, codes, _BLANK)[keep].astype(np.uint32), row[keep]


def windows(codes: np.ndarray, row: np.ndarray, order: int) -> np.ndarray:
    """For each character itself and the order - 1 before it, nearest first; before a text stand blanks."""
    out = np.full((order, len(codes)), _BLANK, np.uint32)
    out[0] = codes
    for k in range(1, order):
        same = row[k:] == row[:-k]
        out[k, k:][same] = codes[:-k][same]
    return out


def hashes(grams: np.ndarray) -> list[np.ndarray]:
    """Hash of each window's first 0, 1, .. order characters (nearest first)."""
    out = [np.zeros(grams.shape[1], np.uint64)]
    with np.errstate(over="ignore"):
        for codes in grams:
            out.append(mixed((out[-1] + codes + np.uint64(1)) * _STEP))
    return out


# --- models -------------------------------------------------------------------------------------


@dataclass
class Models:
    """Kneser-Ney models of all languages.

    keys[n], share[n]: n-grams' hashes in order, and for each language the discounted share of the last
    character among those that follow the context. contexts[n], rest[n]: the contexts of n-grams, and the
    share that is left to the order below. The last rows stand for what is unknown.
    """

    languages: list[str]
    keys: list[np.ndarray]
    share: list[np.ndarray]
    contexts: list[np.ndarray]
    rest: list[np.ndarray]
    alphabet: int
    limit: np.ndarray
    scale: float = 1.0

    def log_shares(self, grams: np.ndarray) -> np.ndarray:
        """Natural log probability of each window's newest character: a row a window, a column a language."""
        whole, context = hashes(grams), hashes(grams[1:])
        p = np.full((grams.shape[1], len(self.languages)), 1 / self.alphabet)
        for n in range(1, len(grams) + 1):
            p = p * self.rest[n][_found(self.contexts[n], context[n - 1])]
            p += self.share[n][_found(self.keys[n], whole[n])]
        return np.log(p)

    def entropies(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text (row) in each language, and the texts' numbers of letters."""
        codes, row = letters(batch)
        sums = np.zeros((len(batch), len(self.languages)))
        if not len(codes):
            return sums, np.zeros(len(batch), np.int64)
        grams = windows(codes, row, ORDER)
        which, distinct = pd.factorize(hashes(grams)[-1])
        example = np.empty(len(distinct), np.int64)
        example[which[::-1]] = np.arange(len(which))[::-1]
        logs = self.log_shares(grams[:, example])
        for i in range(len(self.languages)):
            sums[:, i] = -np.bincount(row, logs[:, i][which], len(batch))
        size = np.bincount(row, minlength=len(batch))
        solid = np.bincount(row, codes != _BLANK, len(batch)).astype(np.int64)
        return sums / np.maximum(size, 1)[:, None], solid


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted hashes; the last row where a hash is unknown."""
    at = np.searchsorted(keys, wanted)
    known = keys[np.minimum(at, len(keys) - 1)] == wanted if len(keys) else np.zeros(len(wanted), bool)
    return np.where(known, at, len(keys))


def learn(counts: pd.DataFrame) -> Models:
    """Models from counts of windows: columns lang, gram (nearest character first), n."""
    languages = sorted(counts["lang"].unique())
    parts: list[list[tuple]] = [[] for _ in range(ORDER + 1)]
    alphabet = len({c for g in counts["gram"] for c in g}) + 1
    for column, (_, own) in enumerate(counts.groupby("lang", sort=True)):
        grams = np.array([[ord(c) for c in g] for g in own["gram"]], np.uint32).reshape(-1, ORDER).T
        n = own["n"].to_numpy(np.float64)
        for order in range(ORDER, 0, -1):
            whole, context = hashes(grams)[order], hashes(grams[1:])[order - 1]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and ones + 2 * twos else 0.5
            ids, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, n)
            cut = np.minimum(n, discount)
            parts[order].append((column, whole, (n - cut) / total[inverse], ids, np.bincount(inverse, cut) / total))
            # The order below counts in how many contexts an n-gram occurs, not how often.
            if order > 1:
                _, first, below = np.unique(hashes(grams)[order - 1], return_index=True, return_inverse=True)
                n = np.bincount(below).astype(np.float64)
                grams = grams[: order - 1, first]
    models = Models(languages, [], [], [], [], alphabet, np.full(len(languages), np.inf))
    for part in parts:
        for keys, values, pick, unknown in (
            (models.keys, models.share, (1, 2), 0.0),
            (models.contexts, models.rest, (3, 4), 1.0),
        ):
            known = np.unique(np.concatenate([p[pick[0]] for p in part])) if part else np.zeros(0, np.uint64)
            value = np.full((len(known) + 1, len(languages)), unknown)
            for p in part:
                value[np.searchsorted(known, p[pick[0]]), p[0]] = p[pick[1]]
            keys.append(known)
            values.append(value)
    return models


def calibrate(models: Models, entropies: np.ndarray, size: np.ndarray, truth: np.ndarray) -> None:
    """Sets each language's rejection limit and the scale that turns differences into a score.

    truth: the labelled language of each calibrating text. Texts whose best language is another one tell
    nothing about their label's limit.
    """
    best = entropies.argmin(1)
    uniform = np.log(models.alphabet)
    right = (best == truth) & (size > 0)
    for i in range(len(models.languages)):
        own = entropies[right & (best == i), i]
        top = own.max() if len(own) else uniform
        models.limit[i] = top + MARGIN * max(0.0, uniform - top)
    # One scale for all: the sharpest that calls the calibrating texts likely, found on a coarse grid.
    if right.any() and len(models.languages) > 1:
        losses = []
        for scale in (grid := 2.0 ** np.arange(-2, 8)):
            p = _scores(entropies, scale)[np.arange(len(truth)), truth]
            losses.append(-np.log(np.maximum(p, 1e-12)).mean())
        models.scale = float(grid[int(np.argmin(losses))])


def _scores(entropies: np.ndarray, scale: float) -> np.ndarray:
    x = -scale * (entropies - entropies.min(1, keepdims=True))
    e = np.exp(x)
    return e / e.sum(1, keepdims=True)


# --- on Spark -----------------------------------------------------------------------------------


def id_crc(doc_id: str | Column = "doc_id") -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Not to be learned from: crc32 of the id as text is 1 modulo 3; a null id counts as an empty text."""
    return id_crc(doc_id) % 3 == 1


def train(docs: DataFrame) -> Models | None:
    """Models of the languages in `docs` (text, lang); rows without text or lang teach nothing.

    None if no row is left. About FIT + CALIBRATE texts a language are used, chosen by a hash of the text.
    """
    usable = docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.coalesce(
        *(F.when(F.col("lang") == k, F.lit(min(1.0, (FIT + CALIBRATE) / n))) for k, n in sorted(sizes.items()))
    )
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / (1 << 20)
    part = F.pmod(F.xxhash64("text", F.lit("part")), F.lit(FIT + CALIBRATE)) < CALIBRATE
    chosen = usable.filter(draw < share).withColumn("apart", part)
    counts = _counts(chosen.filter(~F.col("apart"))).toPandas()
    if not len(counts):
        counts = _counts(chosen).toPandas()
    if not len(counts):
        return None
    models = learn(counts)
    seen = _evaluated(chosen.filter("apart"), models).toPandas()
    if len(seen):
        known = seen["lang"].isin(models.languages)
        seen = seen[known]
        truth = np.array([models.languages.index(x) for x in seen["lang"]], np.int64)
        if len(seen):
            calibrate(models, np.array(seen["entropies"].tolist()), seen["size"].to_numpy(), truth)
    return models


def _counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all given texts; summed in each batch before they are shuffled."""

    def work(batch: pa.RecordBatch):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in np.unique(langs.astype(str)):
            own = [t for t, k in zip(batch.column("text").to_pylist(), langs, strict=True) if k == lang]
            codes, row = letters(own)
            if not len(codes):
                continue
            grams, n = np.unique(windows(codes, row, ORDER), axis=1, return_counts=True)
            text = ["".join(map(chr, g)) for g in grams.T.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(text)), pa.array(text), pa.array(n, pa.int64())], ["lang", "gram", "n"]
            )

    return (
        map_batches(docs.select("text", "lang"), work, "lang string, gram string, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


def _evaluated(docs: DataFrame, models: Models) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def work(batch: pa.RecordBatch):
        entropies, size = shared.value.entropies([t or "" for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(list(entropies), pa.list_(pa.float64())), pa.array(size, pa.int64())],
            ["lang", "entropies", "size"],
        )

    return map_batches(docs.select("text", "lang"), work, "lang string, entropies array<double>, size bigint")


def predict(docs: DataFrame, models: Models | None, keep: list[str]) -> DataFrame:
    """The columns `keep` with lang_pred, score, entropy and rejected.

    Looks at text only. A null text or one without letters, and every text if there are no models, is
    `und` with score 0 and is rejected. `rejected` also marks texts that the best model explains worse than
    its limit; they keep their language. Ties go to the language first in order. Whole texts are read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)
    added = ["lang_pred", "score", "entropy", "rejected"]
    docs = docs.select(*keep, F.col("text").alias("_read"))

    def work(batch: pa.RecordBatch):
        models = shared.value
        batch_texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
        lang: list[str] = [UNKNOWN] * len(batch_texts)
        score, entropy = np.zeros(len(batch_texts)), np.zeros(len(batch_texts))
        rejected = np.ones(len(batch_texts), bool)
        if models is not None:
            entropies, size = models.entropies(batch_texts)
            best = entropies.argmin(1)
            rows = np.flatnonzero(size)
            for i in rows:
                lang[i] = models.languages[best[i]]
            score[rows] = _scores(entropies, models.scale)[rows, best[rows]]
            entropy[rows] = entropies[rows, best[rows]]
            rejected[rows] = entropy[rows] > models.limit[best[rows]]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(lang), pa.array(score), pa.array(entropy), pa.array(rejected)],
            [*batch.schema.names[:-1], *added],
        )

    schema = docs.drop("_read").schema
    for name, kind in zip(added, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return map_batches(docs, work, schema)


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = train(docs.filter(~held_out()))
    found = predict(docs, models, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")
