from __future__ import annotations

import numpy as np
import pytest

from fieldcheck.operators import similarity
from fieldcheck.operators.similarity import earliest_similar


def brute(rows, t):
    out = {}
    for seq, targets, paths, tokens in rows:
        for s2, t2, p2, k2 in rows:
            a, b = set(tokens), set(k2)
            if s2 < seq and t2 == targets and set(paths) & set(p2) and a and b and len(a & b) / len(a | b) >= t:
                out[seq] = min(out.get(seq, s2), s2)
    return out


@pytest.mark.parametrize("leaders, block", [(1, 512), (4, 7), (1, 5)])
@pytest.mark.parametrize("threshold", [0.5, 0.72, 1.0])
def test_matches_brute_force_with_a_hot_cluster(spark, threshold, leaders, block):
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(60)])
    base = list(rng.choice(words, 18, replace=False))
    rows = []
    for seq in range(120):
        if seq % 3 == 0:  # near and exact copies of one text
            tokens = base[: 18 - seq % 4] + list(rng.choice(words, seq % 5))
        else:
            tokens = list(rng.choice(words, rng.integers(0, 14)))
        paths = list(rng.choice(["p1", "p2", "p3"], 2, replace=False))
        rows.append((seq, str(rng.choice(["x", "y"])), [str(p) for p in paths], [str(w) for w in dict.fromkeys(tokens)]))
    df = spark.createDataFrame(rows, "seq long, targets string, paths array<string>, tokens array<string>")
    got = {r["seq"]: r["earlier"] for r in earliest_similar(df, threshold, leaders, block).collect()}
    assert got == brute(rows, threshold)


def test_nothing_kept_holds_token_texts(spark, monkeypatch):
    """Checkpoints of whole token sets, uncompressed, were most of the disk; a row that comes twice is one set."""
    kept = []
    real = similarity.pinned
    monkeypatch.setattr(similarity, "pinned", lambda df: kept.append(df.dtypes) or real(df))
    words = [f"word{i}" for i in range(20)]
    data = [(1, "t", ["p"], words), (2, "t", ["p"], words[:19]), (2, "t", ["p"], words[:19]), (3, "t", ["p"], words[10:]), (4, "u", ["p"], words)]
    df = spark.createDataFrame(data, "seq long, targets string, paths array<string>, tokens array<string>")
    assert {(r["seq"], r["earlier"]) for r in earliest_similar(df, 0.72).collect()} == {(2, 1)}
    assert kept and all(kind != "array<string>" for types in kept for name, kind in types if name != "paths")


def test_a_pair_is_looked_at_in_few_rows(spark, monkeypatch):
    """Whole token sets travel only for pairs whose sketches agree, the earliest of a set first; nothing kept is wider than its sets."""
    asked = []
    real = similarity.similar
    monkeypatch.setattr(similarity, "similar", lambda pairs, sets, t: asked.append(pairs.count()) or real(pairs, sets, t))
    near = [[f"word{i}" for i in range(100)] + [f"own{n}"] for n in range(12)]  # a cluster
    far = [[f"rare{n}", "rare"] + [f"text{n}_{i}" for i in range(100)] for n in range(12)]  # one rare token in common
    data = [(n, "t", ["p"], words) for n, words in enumerate(near + far)]
    df = spark.createDataFrame(data, "seq long, targets string, paths array<string>, tokens array<string>")
    assert {(r["seq"], r["earlier"]) for r in earliest_similar(df, 0.72).collect()} == {(n, 0) for n in range(1, 12)}
    assert asked[0] == 11 and not any(asked[1:])


def test_hashed_and_listed_tokens_are_the_same_sets(spark, monkeypatch):
    """Without a list of frequent tokens, and with one that holds some of them."""
    data = [(n, "t", ["p"], [f"w{(n * 7 + i * i) % 23}" for i in range(12)]) for n in range(60)]
    rows = [(s, t, p, list(dict.fromkeys(k))) for s, t, p, k in data]
    df = spark.createDataFrame(rows, "seq long, targets string, paths array<string>, tokens array<string>")
    for common in (0, 11, 1 << 19):
        monkeypatch.setattr(similarity, "COMMON", common)
        assert {r["seq"]: r["earlier"] for r in earliest_similar(df, 0.5).collect()} == brute(rows, 0.5)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
