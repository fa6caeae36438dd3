"""N-gram join, language ID, licences, quality, language model, WARC and the pipeline: brute force and hard rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hard_rows import HARD
from pyspark.sql import functions as F

import corpus_pipeline
from fieldcheck.llm import decontam, language_id, license_index, lm, quality_rules, tile_join, warc
from fieldcheck.llm.common import scratch, table

SMALL = "/root/testdata/sf0.001"
_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- n-gram join


def shingle_set(text: str | None, n: int) -> frozenset:
    w = _SPACE.findall(lower(text))
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute_components(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    sets = [shingle_set(t, n) for _, t, _ in rows]
    name = list(range(len(rows)))

    def root(i: int) -> int:
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                name[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, *_), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_join_against_brute_force(docs, n, percent):
    draw = random.Random(n)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = draw.choices(vocabulary, k=60)
    rows: list[tuple] = []
    for g in range(14):
        base = draw.choices(vocabulary, k=draw.choice([3, 6, 20, 80, 150]))
        if g % 3 == 0:
            base = passage + base
        for _ in range(draw.randrange(1, 9)):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + len(copy) // 12)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append((len(rows) + 10, draw.choice([" ", "\n"]).join(copy).upper(), None))
    rows += [(500 + i, " ".join(passage + draw.choices(vocabulary, k=draw.randrange(9))), None) for i in range(25)]
    rows += [*HARD, (7, "One two\tTHREE", None), (8, "one  two three ", None), (None, rows[0][1], None)]
    draw.shuffle(rows)
    got = tile_join.link(docs(rows).repartition(5), n, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_components(rows, n, percent), key=repr)


def test_join_of_nothing(docs):
    assert tile_join.link(docs([])).count() == 0
    assert [tuple(r) for r in tile_join.link(docs([(1, None, None)])).collect()] == [(1, 0, 1)]


def test_join_does_not_depend_on_order(docs, monkeypatch):
    """Repeated n-grams, their postings' split and the leaders only change the work."""
    rows = [(i, " ".join(f"w{(i // 6) * 7 + k + (k == 30 + i % 6)}" for k in range(60)), None) for i in range(36)]
    want = sorted(brute_components(rows, 4, 85))
    monkeypatch.setattr(tile_join, "SPLIT", 2)
    monkeypatch.setattr(tile_join, "REPEATED", 2)
    assert sorted(map(tuple, tile_join.link(docs(rows).repartition(3), 4, 85).collect())) == want
    monkeypatch.setattr(tile_join, "ORDERED", 1)
    assert sorted(map(tuple, tile_join.link(docs(rows).repartition(3), 4, 85).collect())) == want


def test_bound_and_overlap():
    draw = np.random.default_rng(5)
    for _ in range(300):
        a, b = (np.unique(draw.integers(0, 400, draw.integers(1, 300)).astype(np.uint64)) for _ in "ab")
        true = len(np.intersect1d(a, b))
        assert tile_join.overlap(a, b) == true
        assert tile_join.overlap_bound(tile_join.bitmap(a), tile_join.bitmap(b), len(a), len(b)) >= true


# --- language ID


def test_chances_sum_to_one():
    import pandas as pd

    rows = []
    for lang, text in (("x", "abab cab bac aab abc"), ("y", "zz yz zy yyz xyz")):
        grams, n = np.unique(language_id.windows(*language_id.letters([text] * 3), language_id.ORDER), axis=1, return_counts=True)
        rows.append(pd.DataFrame({"lang": lang, "gram": ["".join(map(chr, g)) for g in grams.T.tolist()], "n": n}))
    models = language_id.learn(pd.concat(rows))
    alphabet = sorted({c for r in rows for g in r["gram"] for c in g} | {"q"})  # q stands for what is unknown
    for context in ("aba", "zyz", "qqq", " aa"):
        grams = np.array([[ord(c), *map(ord, context)] for c in alphabet], np.uint32).T
        assert np.allclose(np.exp(models.log_shares(grams)).sum(0), 1)


def test_language_of_held_out_texts(spark, docs):
    docs([])
    rows = table(spark, SMALL.replace("0.001", "0.01"), "documents")
    models = language_id.train(rows.filter(~language_id.held_out()))
    found = language_id.predict(rows.filter(language_id.held_out()), models, ["doc_id", "lang"])
    right, all_, gone = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert right / all_ > 0.97 and gone <= 0.01 * all_
    noise = docs([(1, "xqzj vwkx qqjz zxvq jkqx wvzx qjxz kkqv", "en"), (2, "12 !?", "en"), *HARD])
    got = {(r["doc_id"], r["text"]): r for r in language_id.predict(noise, models, ["doc_id", "text"]).collect()}
    assert len(got) == len(HARD) + 1  # two rows repeat
    assert got[1, "xqzj vwkx qqjz zxvq jkqx wvzx qjxz kkqv"]["rejected"]
    for key in ((2, "12 !?"), (2, None), (3, ""), (4, " \n\t "), (None, None)):
        assert (got[key]["lang_pred"], got[key]["score"], got[key]["rejected"]) == ("und", 0.0, True)


def test_language_without_labels(docs):
    models = language_id.train(docs([(1, "text", None), (2, None, "en")]))
    assert models is None
    assert {r["lang_pred"] for r in language_id.predict(docs(HARD), models, ["doc_id"]).collect()} == {"und"}
    one = language_id.train(docs([(1, "some text", "en")]))
    assert language_id.predict(docs([(2, "text", None)]), one, ["doc_id"]).first()["lang_pred"] == "en"
    assert language_id.predict(docs([]), one, ["doc_id"]).count() == 0


# --- licences


def test_licences_against_brute_force(docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    rows = [
        (1, f"x {mit} y", None), (2, "General PUBLIC license. CC BY cc-by, all rights reserved", None),
        (3, "Licensed under the Apache License, Version 2.0", None), (4, "license version 2 0", None),
        (5, "licensed under cc by nc", None), (6, "all rights all rights reserved cc by cc", None),
        (7, "of this software permission is hereby granted free of charge", None), (8, "lİcense by Kc cc", None),
        (9, ("gnu general public license " * 3000), None), *HARD,
    ]
    got = {(r["doc_id"], r["text"]): r for r in license_index.scan(docs(rows), keep=("doc_id", "text")).collect()}
    for i, t, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        want = sorted(
            (p.label, s)
            for p in license_index.TEMPLATES
            if p.base
            for s in range(len(w))
            if w[s : s + len(p.words)] == p.words
        )
        r = got[i, t]
        assert r["n_words"] == len(w)
        assert sorted((h["label"], h["start"]) for h in r["hits"] if h["base"]) == want
    labels = {i: sorted({h["label"] for h in got[i, t]["hits"]}) for i, t, _ in rows[:9]}
    assert labels[1] == ["mit"] and labels[3] == ["apache-2.0"] and labels[4] == [] and labels[5] == ["cc-by", "cc-by-nc"]
    assert all(0 < h["score"] <= 1 for r in got.values() for h in r["hits"])
    assert license_index.scan(docs([])).count() == 0


# --- quality rules


def brute_features(text: str | None) -> tuple:
    text = text or ""
    w = _SPACE.findall(text)
    lines = [x for x in text.split("\n") if _SPACE.search(x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


def test_features_against_brute_force(docs):
    draw = random.Random(6)
    texts = ["".join(draw.choices(["a", "b", "é ", " ", "\n", "a b a\n", "#", "\x0b", "\x1c"], k=draw.randrange(80))) for _ in range(200)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + HARD
    got = quality_rules.features(docs(rows), ("doc_id",)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *brute_features(t)) for i, t, _ in rows), key=repr)


def test_binomial_tail(spark):
    cases = [(10, 0), (500, 1), (3000, 12), (100_000, 900), (2_000_000, 19_000), (100, 5)]
    rows = spark.createDataFrame(cases, "n bigint, x bigint")
    got = {(r["n"], r["x"]): r["p"] for r in rows.withColumn("p", quality_rules.binomial_tail(F.col("n"), F.col("x"), 0.01)).collect()}
    for n, x in cases:
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(0.01) + (n - k) * math.log(0.99) for k in range(x + 1)]
        want = sum(map(math.exp, logs)) if x < n * 0.01 else 1.0
        assert got[n, x] == pytest.approx(want, rel=1e-6)


def test_judgement(spark, docs):
    draw = random.Random(7)
    prose = lambda: " ".join("".join(draw.choices("abcdefghij", k=draw.randrange(3, 8))) for _ in range(70))
    rows = [(i, prose(), "en") for i in range(3000)] + [(5000 + i, "### " * 20 + prose(), "en") for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)] + [(None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(rows), labels, risk=0.01).collect()}
    assert sum(not got[i]["kept"] for i in range(3000)) <= 0.01 * len(quality_rules.RULES) * 3000
    assert not any(got[5000 + i]["kept"] for i in range(5)) and "symbols" in got[5000]["failed"]
    none = quality_rules.judge(docs([*rows[:20], *HARD]), labels.limit(0)).collect()
    assert len(none) == 20 + len(HARD) and all(r["kept"] != r["base_failed"] for r in none)
    assert quality_rules.judge(docs([]), labels).count() == 0


def test_judgement_at_the_production_risk(spark, docs):
    """One stratum: 3,451 good texts without a hit prove a cutoff, 3,450 prove none."""
    draw = random.Random(8)
    prose = lambda: " ".join("".join(draw.choices("abcdefghij", k=draw.randrange(3, 8))) for _ in range(60))
    rows = docs([(i, prose(), "en") for i in range(3451)] + [(5000, "### " * 20 + prose(), "en")])
    for n, kept in ((3451, False), (3450, True)):
        labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id bigint, quality int, toxic int")
        got = {r["doc_id"]: r for r in quality_rules.judge(rows, labels).collect()}
        assert got[5000]["kept"] == kept and ("symbols" in got[5000]["failed"]) != kept
        assert sum(not got[i]["kept"] for i in range(3451)) <= quality_rules.RISK * len(quality_rules.RULES) * 3451


# --- language model


def test_gradients(monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 3)
    net = lm.Network(np.array([0, 5, 4, 3, 2, 1]), 3, hidden=4, dtype=np.float64)
    draw = np.random.default_rng(0)
    for k in net.NAMES:
        getattr(net, k)[...] += draw.normal(0, 0.3, getattr(net, k).shape)
    token, fresh, real = draw.integers(0, 6, (5, 3)), np.zeros((5, 3), bool), np.ones((5, 3), bool)
    fresh[0], fresh[2, 1], real[4, 2] = True, True, False
    start = np.zeros((3, 4))
    _, grads, _ = net.gradients(start, token, fresh, real)
    for k in net.NAMES:
        p = getattr(net, k)
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 9)]:
            old, losses = p[at], []
            for d in (1e-5, -1e-5):
                p[at] = old + d
                losses.append(net.gradients(start, token, fresh, real)[0])
            p[at] = old
            assert grads[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-6)


def test_state_is_carried_and_chances_sum_to_one():
    draw = np.random.default_rng(1)
    net = lm.Network(draw.integers(1, 50, lm.CLASSES * lm.IN_CLASS), 9)
    for k in net.NAMES:
        getattr(net, k)[...] += draw.normal(0, 0.2, getattr(net, k).shape)
    texts = [draw.integers(0, 1024, n).astype(np.int32) for n in (1, 5, 300, 64, 65, 2)]
    got = lm.log_likelihoods(net, texts)
    for text, have in zip(texts, got, strict=True):
        h, total = np.zeros((1, net.hidden), np.float32), 0.0
        for t, token in enumerate(text):
            fresh = np.array([[t == 0]])
            before, h, _ = net.run(h, np.array([[token]]), fresh)
            total += net.log_chance(before[0], np.array([token]))[0]
        assert have == pytest.approx(total, rel=1e-4)
    state = np.repeat(draw.normal(0, 1, (1, net.hidden)), 1024, 0).astype(np.float32)
    assert np.exp(net.log_chance(state, np.arange(1024))).sum() == pytest.approx(1, rel=1e-4)


@pytest.mark.parametrize("head", [lm.HEAD, 40])
def test_scores_against_brute_force(spark, docs, monkeypatch, head):
    """Whatever the workers' share of the words, the counts and base scores are the same."""
    monkeypatch.setattr(lm, "HEAD", head)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, SMALL, "documents").limit(60).collect()] + HARD
    docs_ = docs(rows)
    got = lm.score(docs_, docs_.filter(~lm.held_out())).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts: Counter = Counter()
    for i, t, _ in rows:
        if not out(i):
            counts.update([*_SPACE.findall(lower(t)), None])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        own = [*_SPACE.findall(lower(t)), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
        want.append((i, len(own), sum(counts[w] > 0 for w in own), total, base))
    assert len(got) == len(want)
    for have, (i, n, known, total, base) in zip(
        sorted(got, key=lambda r: (repr(r["doc_id"]), r["base_score"])), sorted(want, key=lambda r: (repr(r[0]), r[4])), strict=True
    ):
        assert (have["doc_id"], have["n_tokens"], have["n_known"], have["train_tokens"]) == (i, n, known, total)
        assert have["base_score"] == pytest.approx(base, rel=1e-9)
        assert have["score"] < 0 and math.isfinite(have["score"])


def test_network_beats_the_counts_on_held_out_texts(spark, docs):
    docs([])
    rows = table(spark, SMALL.replace("0.001", "0.01"), "documents")
    got = lm.score(rows.filter(lm.held_out()), rows.filter(~lm.held_out())).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_every_training_text_trains_the_network(docs):
    """Each text has a word of its own; a word that no task has trained on keeps its first weights."""
    rows = docs([(i, f"own{i} " * 150, None) for i in range(96)])
    head = lm.head_of(lm.counted(rows))
    first, after = lm.Network(head.listed, head.other_total), lm.train(rows.repartition(2), head)
    moved = np.abs(after.inputs - first.inputs).max(1) > 0
    own = head.place[head.words != lm.END]
    assert len(own) == 96 and moved[own].all()


def test_words_share_their_entries(docs, monkeypatch):
    """10,000 words: each has an entry of its own, a band or the rest, and within one the shares add up to one."""
    monkeypatch.setattr(lm, "HEAD", 6000)
    rows = docs([(i, " ".join(f"w{j}" for j in range(10_000) if i % (1 + j // 50) == 0), None) for i in range(400)])
    counts = {r["word"]: r["n"] for r in lm.counted(rows).collect()}
    head = lm.head_of(lm.counted(rows))
    assert len(counts) == 10_001 and 3000 < len(head.words) <= 6000
    assert set(head.counts) == {counts[int(w)] for w in head.words.view(np.int64)} and (head.place > 0).all()
    shares = 10 ** head.share(head.counts, head.place)
    sums = np.bincount(head.place, shares, len(head.listed))
    bands = np.flatnonzero(head.kinds > 1)
    assert len(bands) and (bands < lm.IN_CLASS).all() and (head.kinds <= 1)[lm.IN_CLASS :].all()
    assert sums[head.kinds > 0] == pytest.approx(1, rel=1e-9)
    rest = [n for w, n in counts.items() if w not in set(head.words.view(np.int64).tolist())]
    assert (head.other_total, head.other_distinct) == (sum(rest), len(rest))


def test_lanes_hold_one_window_at_a_time():
    """A text of a million words beside 300 short ones: no array of its length for every lane."""
    draw = np.random.default_rng(2)
    texts = [draw.integers(0, 1024, n).astype(np.int32) for n in [1_000_000, *draw.integers(1, 9, 300)]]
    laid = lm.Lanes(texts, 256)
    assert len(laid.line) == sum(map(len, texts))
    seen = np.zeros(len(laid.line), int)
    for token, fresh, real, at in laid.windows(64):
        assert token.size <= 64 * 256
        np.add.at(seen, at[real], 1)
        assert (token[real] == laid.line[at[real]]).all() and not fresh[~real].any()
    assert (seen == 1).all()
    assert all((laid.line[s : s + len(t)] == t).all() and laid.fresh[s] for s, t in zip(laid.start, texts, strict=True))
    net = lm.Network(np.ones(1024, np.int64), 5)
    short = lm.log_likelihoods(net, texts[1:])
    assert lm.log_likelihoods(net, [texts[0][:70_000], *texts[1:]])[1:] == pytest.approx(short, rel=1e-4)


def test_scores_without_training(docs):
    table_ = docs(HARD)
    got = lm.score(table_, table_.limit(0)).collect()
    assert len(got) == len(HARD) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert lm.score(table_.limit(0), table_).count() == 0


# --- WARC


def test_archives_round_trip(spark, docs, monkeypatch):
    docs([])
    monkeypatch.setattr(warc, "PIECE", 512)
    draw = random.Random(8)
    big = "".join(chr(draw.randrange(32, 0x2FFF)) for _ in range(40_000))
    rows = [(1, "http://a\r\nX: y", "x" * 200), (2, None, "x" * 200), (3, "u", "short"), (4, "u", "short"), (5, "u", None),
            (6, "u", big), (7, "u", big), (7, "u", big), (None, "u", big), (8, "u", ""), (9, "u", "é" * 50), (10, "u", "é" * 50),
            (None, None, "y" * 300), (None, None, "y" * 300)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, digest string")
    for parts, size in ((1, 300), (4, 1 << 20)):
        archives = warc.write_archives(warc.with_originals(pages).repartition(parts), scratch(spark, "warc"))
        got = warc.read_archives(archives, size, payloads=True).collect()
        assert len(got) == len(rows)
        firsts = {big: 6, "x" * 200: 1, "é" * 50: 9}
        want = []
        for i, _, html in rows:
            first = firsts.get(html)
            copy = first is not None and i != first
            data = (html or "").encode()
            want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if copy else "response", first if copy else None, None if copy else data))
        have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
        assert sorted(have, key=repr) == sorted(want, key=repr)
    assert warc.read_archives(warc.write_archives(warc.with_originals(pages.limit(0)), scratch(spark, "warc"))).count() == 0


class Bytes(str):
    """A text whose bytes are given: for payloads that are no text."""

    def __new__(cls, data: bytes):
        self = super().__new__(cls, "x")
        self.data = data
        return self

    def encode(self, *_):
        return self.data


def page(i: int, html: str, url: str = "u") -> dict:
    data = html.encode()
    return {"page_id": i, "url": url, "html": html, "digest": hashlib.sha256(data).hexdigest(), "revisit": False, "refers_to": None}


def all_ranges(path, size: int, step: int) -> list[int]:
    return [r["page_id"] for lo in range(0, size, step) for r in warc.read_range(str(path), lo, min(lo + step, size), size)]


def test_false_magic_is_no_record(tmp_path, monkeypatch):
    """Members that do not compress hold what looks like members; ranges may start anywhere in them."""
    monkeypatch.setattr(warc.zlib, "compressobj", lambda level, *rest, make=zlib.compressobj: make(0, *rest))
    inner = b"junk" + warc.MAGIC + b"no member" + zlib.compress(b"plain", wbits=31) + zlib.compress(b"WARC", wbits=31)
    data = b"".join(warc.record(page(i, Bytes(inner * 3))) for i in range(4))
    assert data.count(warc.MAGIC) == 4 * 10
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    for step in (7, 50, 333, len(data)):
        assert all_ranges(path, len(data), step) == [0, 1, 2, 3]


@pytest.mark.parametrize("at", ["magic", "deflate", "head", "payload", "end"])
def test_damage_is_an_error_wherever_it_is(tmp_path, at):
    records = [warc.record(page(i, f"{i}" * 300)) for i in range(3)]
    broken = bytearray(records[1])
    place = {"magic": 1, "deflate": 10, "head": 14, "payload": len(broken) - 20, "end": len(broken) - 1}[at]
    broken[place] ^= 0x55
    path = tmp_path / "a.warc.gz"
    for order in ([records[0], bytes(broken), records[2]], [bytes(broken), records[2]], [records[0], bytes(broken)]):
        data = b"".join(order)
        path.write_bytes(data)
        for step in (40, 200, len(data)):
            with pytest.raises((ValueError, zlib.error)):
                all_ranges(path, len(data), step)
    path.write_bytes(records[0] + records[1][:100])
    with pytest.raises((ValueError, zlib.error)):
        all_ranges(path, len(records[0]) + 100, 64)


def test_long_urls_and_many_tasks(spark, docs):
    docs([])
    draw = random.Random(4)
    rows = [(i, "http://x/" + "".join(draw.choices("abcdef0123456789", k=70_000 if i % 3 == 1 else 9)), "y" * i) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    archives = warc.write_archives(warc.with_originals(pages).repartition(1), scratch(spark, "warc"))
    found = warc.read_archives(archives, 20_000)
    assert sorted((r["page_id"], r["url"]) for r in found.collect()) == [r[:2] for r in rows]
    tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert found.rdd.getNumPartitions() > 10 and tasks > 5
    with pytest.raises(ValueError, match="whole number"):
        warc.with_originals(pages.selectExpr("url AS page_id", "url", "html"))


# --- the pipeline


def test_pipeline_against_brute_force(spark, docs):
    docs([])
    source = table(spark, SMALL, "documents")
    rows = {r["doc_id"]: r for r in source.collect()}
    assert len(corpus_pipeline.STAGES) == 5
    step, kept = source, dict(rows)
    items = [decontam.normal(r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SMALL)
        got = {r["doc_id"]: r for r in step.collect()}
        assert len(got) == step.count()
        if name == "languages":
            want = {i for i, r in kept.items() if re.search(r"[^\W\d_]", r["text"] or "")}
            assert want - set(got) == set()
        elif name == "near_copies":
            groups = brute_components([(i, r["text"], None) for i, r in kept.items()], 5, 80)
            assert set(got) == {c for _, _, c in groups}
        elif name == "benchmark_leaks":
            exact = {i for i, r in kept.items() if any(x in decontam.normal(r["text"]) for x in items)}
            assert exact and set(kept) - set(got) == exact
        elif name == "secrets":
            assert set(got) == set(kept)
            assert not any(re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|password=\w{8}", r["text"]) for r in got.values())
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        else:
            assert set(got) == set(kept) and all(len(r["ids"]) == r["n_tokens"] for r in got.values())
        if name != "tokens":
            assert step.columns == corpus_pipeline.COLUMNS
        kept = got


def test_stages_take_hard_rows(spark, docs):
    table_ = docs([*HARD, (1, "a short text with some words in it", "en")]).select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, table_, SMALL).count()
        assert stage(spark, table_.limit(0), SMALL).count() == 0
