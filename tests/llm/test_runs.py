"""Periodic runs: transforms against plain sums, runs against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hard_rows import HARD

from fieldcheck.llm import runs
from fieldcheck.llm.common import table

SMALL = "/root/testdata/sf0.001"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words: list) -> list[tuple[int, int, int]]:
    """All runs: for each period in turn, the longest stretches that keep it and no smaller one."""
    codes: dict = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in words])
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        misses = np.flatnonzero(np.concatenate([[True], x[:-q] != x[q:], [True]]))
        sizes = np.diff(misses) - 1
        for i in np.flatnonzero(sizes + q >= max(24, 3 * q)).tolist():
            found.setdefault((int(misses[i]), int(misses[i] + sizes[i] + q)), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(words: list[str]) -> tuple:
    found = sorted(brute(words), key=lambda r: (r[0], r[2]))
    drop = set()
    for s, n, q in found:
        drop.update(range(s + q, s + n))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    milli = 1000 * best[1] // best[2] if found else None
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (len(found), *best, milli, *digests)


@pytest.mark.parametrize("size", [16, 32, 128, 2048])
def test_transform_correlates_exactly(size):
    draw = np.random.default_rng(size)
    a, w = (draw.integers(-32768, 32769, (3, size)).astype(float) for _ in range(2))
    got = runs.back(runs._reduced(runs.transform(a, inverse_root=True) * runs.transform(w))).astype(int) % runs.PRIME
    for i in range(3):
        x, y = a[i].astype(int).tolist(), w[i].astype(int).tolist()
        for lag in (0, 1, size // 2, size - 1):
            assert got[i, lag] == sum(x[j] * y[(j + lag) % size] for j in range(size)) % runs.PRIME


def random_texts(seed: int) -> list[list[int]]:
    draw = random.Random(seed)
    out = []
    for _ in range(60):
        words = []
        for _ in range(draw.randint(0, 6)):
            kind = draw.random()
            part = [draw.randint(0, draw.choice([1, 2, 5, 1000])) for _ in range(draw.randint(1, 90))]
            words += part * draw.randint(2, 6) + part[: draw.randint(0, len(part))] if kind < 0.6 else part
        out.append(words)
    return [*out, [], [7] * 23, [7] * 24, [7] * 1000, [1, 2] * 500 + [1, 1] * 300, list(range(400)) * 3]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("longest", [16, 1024])
def test_runs_against_brute_force(monkeypatch, seed, longest):
    """Also with blocks far shorter than the scale, as for periods above a thousand."""
    monkeypatch.setattr(runs, "LONGEST", longest)
    texts = random_texts(seed)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    found = defaultdict(list)
    for i, s, n, q in zip(*runs.find(np.array(sum(texts, []), np.int64), offsets), strict=True):
        found[int(i)].append((int(s), int(n), int(q)))
    for i, words in enumerate(texts):
        assert sorted(found[i]) == brute(words), i


def test_chance_agreements_are_found_out(monkeypatch):
    """With a tiny prime for the extensions many unequal stretches agree; the words decide all the same."""
    monkeypatch.setattr(runs, "EXTEND_PRIME", np.uint64(10007))
    words = np.array(([1, 2, 3] * 20 + list(range(50, 90))) * 3, np.int64)
    text, s, n, q = runs.find(words, np.array([0, len(words)]))
    assert list(zip(s.tolist(), n.tolist(), q.tolist())) == brute(words.tolist())


def planted(doc_id, text: str | None) -> list[str]:
    words = _WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def check(rows, source: list[tuple]) -> None:
    want = sorted([(str(i), *expected(planted(i, t))) for i, t in source], key=str)
    have = sorted([(str(r["doc_id"]), *[r[c.split()[0]] for c in runs.SCHEMA.split(", ")]) for r in rows], key=str)
    assert have == want


def test_query_against_brute_force(spark):
    source = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    rows = runs.op11(spark, SMALL).collect()
    assert sum(r["n_runs"] > 0 for r in rows) > 10
    check(rows, source)


def test_hard_rows_and_kept_columns(docs):
    cycle = " ".join(f"w{i}" for i in range(40))
    more = [(90, f"{cycle}\v{cycle}\f{cycle}\r\n tail", "en"), (12, "é " * 30 + " x y", None)]
    frame = docs(HARD + more)
    check(runs.detect(runs.with_repeats(frame), ["doc_id"]).collect(), [(i, t) for i, t, _ in HARD + more])
    kept = runs.detect(frame, ["doc_id", "lang", "spans"]).filter("doc_id = 90").first()
    assert kept["lang"] == "en" and kept["spans"] == "y" and kept["collapsed"] == f"{cycle} tail"
    assert [tuple(r) for r in kept["runs"]] == [(0, 120, 40)]
    with pytest.raises(ValueError, match="period"):
        runs.detect(frame.withColumnRenamed("n", "period"), ["period"])
    assert runs.detect(docs([]), ["doc_id"]).count() == 0
