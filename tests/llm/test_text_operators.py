"""Chat formatting, BPE, secrets, decontamination: brute force, round trips and hard rows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from hard_rows import HARD

from fieldcheck.llm import bpe, chat_format, decontam, secret_ledger
from fieldcheck.llm.common import scratch



# --- chat formatting


def test_template_language():
    render = chat_format.compiled(
        "{% set a = 'x' ~ (1 + 2) %}{{ a }}{% for m in ms %}{% if loop.first %}<{% elif m.n > 1 and not loop.last %}|"
        "{% else %}>{% endif %}{{ m['t'] | trim | upper }}{% generation %}{{ m.t | length }}{% endgeneration %}{% endfor %}"
    )
    text, spans = render({"ms": [{"t": " a ", "n": 0}, {"t": "b", "n": 2}, {"t": "c", "n": 2}]})
    assert text == "x3<A3|B1>C1"
    assert [text[a:b] for a, b in spans] == ["3", "1", "1"]


def test_constants_are_folded():
    tree = chat_format.fold(chat_format.parse("a{{ 'b' | upper }}{% if 1 == 2 %}x{% else %}c{% endif %}d"))
    assert [(p.kind, p.value) for p in tree.parts] == [("text", "aBcd")]


@pytest.mark.parametrize(
    "bad", ["{{ x.__class__ }}", "{{ f() }}", "{% for x %}", "{% if a %}", "{{ a | eval }}", "{% endfor %}", "{{ 'a }}"]
)
def test_sandbox(bad):
    with pytest.raises(chat_format.TemplateError):
        chat_format.compiled(bad)


def test_escapes_are_reversible():
    draw = random.Random(1)
    parts = [*chat_format.CONTROLS, "\\", "<", "/s>", "[", "INST]", "x", "\n", "|>"]
    for _ in range(3000):
        turns = [
            {"role": draw.choice(["user", "assistant", "system", "tool", "", "</s>"]),
             "text": "".join(draw.choices(parts, k=draw.randrange(8)))}
            for _ in range(draw.randrange(5))
        ]
        text, spans = chat_format.compiled(chat_format.TEMPLATE)({"messages": turns})
        assert list(chat_format.read_back(text)) == [(t["role"], t["text"]) for t in turns]
        loss = [t["text"] for t in turns if t["role"] == "assistant"]
        assert [chat_format.unescape(text[a:b]) for a, b in spans] == loss


def test_chat_rows(spark, docs):
    docs([])
    kind = "conv_id bigint, turn bigint, role string, text string, formatted string"
    rows = [(1, 1, "assistant", None, "x"), (1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (None, None, None, "t", "x")]
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(spark.createDataFrame(rows, kind))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nuser\nhi\nassistant\n\n").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\nt\n").hexdigest()
    assert chat_format.digests(chat_format.format_chats(spark.createDataFrame([], kind))).count() == 0


# --- byte-level BPE


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(bpe.public_vocabulary())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(reference):
    codec = bpe.Codec(bpe.load_ranks(bpe.public_vocabulary()))
    draw = random.Random(2)
    letters = list("aZé9 \n\t'sdmtlevr!?.  '日 　 😀́²½ \x1c​\x85")
    for _ in range(400):
        batch = ["".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(9)]
        done = codec.encode(batch)
        assert done.id_lists().to_pylist() == [reference.encode_ordinary(t) for t in batch]
        raw = codec.decode(done.ids)[0].tobytes()
        assert raw == "".join(batch).encode()
        for text, cuts in zip(batch, done.piece_lists().to_pylist(), strict=True):
            pieces = re.findall(r"\S", text)  # every piece starts inside the text, in order
            assert cuts == sorted(set(cuts)) and (not text or cuts[0] == 0) and len(cuts) <= len(text.encode())
            assert len(cuts) >= (1 if pieces else 0)
    long = ["a" * 3000, "ab" * 2000, "".join(draw.choices("abcdefgh", k=3000)), " " * 999 + "x", "日本" * 300]
    assert codec.encode(long).id_lists().to_pylist() == [reference.encode_ordinary(t) for t in long]


def test_bpe_rows(docs, reference):
    table = docs(HARD)
    got = bpe.round_trip(table, bpe.public_vocabulary()).collect()
    want = []
    for i, t, _ in HARD:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    full = bpe.encode(table, bpe.public_vocabulary())
    assert full.columns[: len(table.columns)] == table.columns and full.count() == len(HARD)
    assert bpe.encode(table.limit(0), bpe.public_vocabulary()).count() == 0


# --- secrets


def brute_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for no, (kind, pattern, group, least) in enumerate(
        [
            ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
            ("access", r"AKIA[A-Z0-9]+", 0, 16),
            ("hex", r"[0-9a-f]+", 0, 32),
        ]
    ):
        out += [(m.start(), no, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [(a, b, k) for a, _, b, k in sorted(out)]


SECRETS = [
    (1, "é password = 'hunter2hunter2' and TOKEN:abcdefgh1", "en"),
    (2, "AKIA" + "Z" * 12 + " secret=" + "0123456789abcdef" * 2, "en"),
    (3, "api_key=short api-key=longenough1 paſſword=longenough1 toKen=longenough1", "en"),
    (4, "é password = 'hunter2hunter2' and TOKEN:abcdefgh1", "en"),
    (5, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "z" * 36, None),
    (6, "f" * 31 + " " + "f" * 32, None),
]


def test_secrets_against_brute_force(spark, docs):
    table = docs(SECRETS + HARD)
    from pyspark.sql import functions as F

    versions = table.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text")
    ledger = secret_ledger.BlobLedger(spark, scratch(spark, "ledger"))
    ledger.update(versions)
    got = [(r["path"], r["blob"], r["spans"]) for r in ledger.report(versions).collect()]
    assert len(got) == len(SECRETS + HARD)
    texts = {hashlib.sha256((t or "").encode()).digest(): t or "" for _, t, _ in SECRETS + HARD}
    for _, blob, spans in got:
        base = [(s["start"], s["end"], s["kind"]) for s in spans if s["kind"] in secret_ledger.BASE]
        assert base == brute_spans(texts[bytes(blob)])
    five = next(s for p, _, s in got if p == 5)
    assert {s["kind"] for s in five} == {"pem", "github"}
    clean = {r["doc_id"]: r["text"] for r in ledger.redact(docs(SECRETS)).collect()}
    assert clean[1] == "é [assign]' and [assign]" and clean[2] == "[access] [assign]" and clean[4] == clean[1]
    assert clean[3].startswith("api_key=short") and clean[6] == "f" * 31 + " [hex]"


def test_no_byte_of_a_private_key_is_left(spark, docs):
    """With its END line or without, in lines, escaped or in one line; the text around it stays."""
    from pyspark.sql import functions as F

    body = ["MIIEpAIBAAKCAQEA" + c * 48 for c in "QRST"] + ["Zz9+/w=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines = "\n".join([begin, *body])
    cases = [
        (f"before {lines}\n{end} behind it", "before [pem] behind it"),
        (f"{lines}\n{end}\nand {lines}\n{end}", "[pem]\nand [pem]"),
        (f"{lines}\n-----END EC PRIVATE KEY-----", "[pem]\n-----END EC PRIVATE KEY-----"),
        (f"{lines}\nbehind the key", "[pem]\nbehind the key"),
        (lines, "[pem]"),
        (" ".join([begin, *body]) + " behind the key", "[pem] behind the key"),
        (r"\n".join([begin, *body, end]) + '", x', '[pem]", x'),
        ("\r\n".join([begin, "Proc-Type: 4,ENCRYPTED", "", *body, end]), "[pem]"),
        (f"a file with {begin} is a key\n{lines}\n{end}", "a file with [pem] is a key\n[pem]"),
    ]
    table = docs([(i, t, None) for i, (t, _) in enumerate(cases)])
    ledger = secret_ledger.BlobLedger(spark, scratch(spark, "ledger"))
    ledger.update(table.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"))
    clean = {r["doc_id"]: r["text"] for r in ledger.redact(table).collect()}
    assert [clean[i] for i in range(len(cases))] == [want for _, want in cases]


def test_ledger_scans_only_what_is_new(spark, docs):
    from pyspark.sql import functions as F

    docs([])
    versions = lambda rows: spark.createDataFrame(rows, "path string, version int, text string")
    folder, one = scratch(spark, "ledger"), secret_ledger.RULES[:1]
    ledger = secret_ledger.BlobLedger(spark, folder, one)
    first = [("a", 1, "token=abcdefgh1"), ("a", 2, "clean"), ("b", 1, "token=abcdefgh1")]
    ledger.update(versions(first))
    assert ledger.scans().count() == 2
    later = [*first, ("c", 1, "clean"), ("c", 2, "secret=abcdefgh1")]
    assert ledger.unseen(secret_ledger.addressed(versions(later)).drop("text")).count() == 1
    ledger.update(versions(later))
    assert ledger.scans().count() == 3
    wider = secret_ledger.BlobLedger(spark, folder, secret_ledger.RULES[:2])
    lacking = wider.unseen(secret_ledger.addressed(versions(later)).drop("text"))
    assert {tuple(r["lacking"]) for r in lacking.collect()} == {(secret_ledger.RULES[1].key,)}
    wider.update(versions(later))
    assert wider.unseen(secret_ledger.addressed(versions(later)).drop("text")).count() == 0
    found = wider.report(versions(later)).withColumn("n", F.size("spans"))
    assert {(r["path"], r["version"]): r["n"] for r in found.collect()} == {
        ("a", 1): 1, ("a", 2): 0, ("b", 1): 1, ("c", 1): 0, ("c", 2): 1,
    }


# --- decontamination


def brute_distance(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (a != b)))
        row = now
    return min(row)


def test_bit_parallel_distance():
    draw = random.Random(3)
    for _ in range(800):
        item = "".join(draw.choices("abc", k=draw.randrange(1, 14)))
        text = "".join(draw.choices("abc", k=draw.randrange(30)))
        assert decontam.best_distance(item, text) == brute_distance(item, text)


def test_decontamination_against_brute_force(spark, docs):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefg", k=draw.randrange(1, 7)))
    items = [(i, " ".join(word() for _ in range(draw.randrange(8, 20)))) for i in range(12)]
    rows = []
    for i in range(60):
        _, passage = items[i % 12]
        for _ in range(draw.randrange(0, 9)):
            at = draw.randrange(len(passage))
            passage = passage[:at] + draw.choice(["", "x", "yz"]) + passage[at + 1 :]
        filler = [" ".join(word() for _ in range(25)) for _ in range(2)]
        rows.append((i, f"{filler[0]}\n {passage.upper()}  {filler[1]}", "en"))
    bench = spark.createDataFrame([*items, (90, None), (None, "x" * 40), (91, "tiny")], "item_id bigint, text string")
    marked = decontam.mark(docs(rows + HARD), bench)
    got = {(r["doc_id"], r["text"]): {x["item_id"]: x["distance"] for x in r["leaks"]} for r in marked.collect()}
    hits = 0
    for i, t, _ in rows:
        want = {}
        for no, item in items:
            if (d := brute_distance(decontam.normal(item), decontam.normal(t))) <= int(len(item) * decontam.RATE):
                want[no] = d
        assert got[i, t] == want
        hits += len(want)
    assert 10 < hits < 60
    assert marked.count() == len(rows + HARD)
    none = decontam.mark(docs(HARD), bench.limit(0))
    assert {tuple(r["leaks"]) for r in none.collect()} == {()}
