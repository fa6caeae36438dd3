"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a table in a folder of
the user's, has a row for each blob and the rule versions it has been scanned with. An update scans
only the (blob, rule version) pairs that the ledger lacks, each blob once however many paths hold it;
a report joins the findings back to all paths.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.llm.common import map_batches, query, scratch, table, texts


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches; those whose group is shorter than `least` are dropped.

    `needs`: every match contains one of these lower-case words, so other texts need no search.
    """

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    needs: tuple[str, ...] = field(default=(), compare=False)

    @property
    def key(self) -> str:
        """Kind and version; the version changes with whatever decides the matches."""
        decides = f"{self.pattern}\0{self.least}\0{self.group}"
        return f"{self.kind}@{hashlib.sha256(decides.encode()).hexdigest()[:12]}"


#: Base kinds first, in the order in which spans with one start are listed; then the kinds added here.
RULES = (
    Rule(
        "assign",
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=8,
        group=2,
        needs=("password", "passwd", "secret", "token", "api_key", "apikey"),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, needs=("akia",)),
    Rule("hex", r"[0-9a-f]+", least=32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("private key-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40, needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=20, needs=("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", needs=("eyj",)),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39, needs=("aiza",)),
)
#: A private key as a whole: to the END line of its label, with no other key between. Without that line, what looks
#: like the body: lines of base64 alone, runs of 24 characters or more, and one shorter run behind these.
_GAP = r"(?:\s|\\[nr])"
_PEM = (
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----"
    r"(?:[^-]*(?:-(?!----(?:BEGIN|END) )[^-]*)*-----END \1PRIVATE KEY-----"
    rf"|(?:{_GAP}+(?:Proc-Type|DEK-Info|Comment|Version):[^\n]*)*"
    rf"(?:{_GAP}*(?:[A-Za-z0-9+/]{{24,}}=*|(?<=\n)[\x20\t]*[A-Za-z0-9+/]+=*(?=[\x20\t\r]*(?:\n|\Z))))*"
    rf"(?:(?<=[A-Za-z0-9+/]{{24}}){_GAP}+[A-Za-z0-9+/]+=*(?!\S))?)"
)
#: The rules by which texts are redacted. RULES, which op2_secret_scan lists, show a private key by its header, as its SQL does.
WHOLE = tuple(Rule(r.kind, _PEM, needs=r.needs) if r.kind == "pem" else r for r in RULES)
BASE = ("assign", "access", "hex")
SPAN = "struct<kind:string,start:bigint,end:bigint>"

_HEX_RUN = b"h" * 32
_HEX = bytes(0x68 if chr(c) in "0123456789abcdef" else 0x2E for c in range(256))


class Scanner:
    """All rules over one text."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r, re.compile(r.pattern)) for r in rules]

    def spans(self, text: str, keys: set[str]) -> list[dict]:
        """Matches of the rules with these keys; starts and ends in code points."""
        low = text.lower()
        found = []
        for rule, pattern in self.rules:
            if rule.key not in keys or rule.needs and not any(w in low for w in rule.needs):
                continue
            if rule.pattern == "[0-9a-f]+" and _HEX_RUN not in text.encode("latin-1", "replace").translate(_HEX):
                continue  # the longest run of such characters is too short
            for m in pattern.finditer(text):
                if len(m[rule.group]) >= rule.least:
                    found.append({"kind": rule.kind, "start": m.start(), "end": m.end()})
        return found


class BlobLedger:
    """A ledger kept in `folder`, which all executors must reach."""

    def __init__(self, spark: SparkSession, folder: str, rules: tuple[Rule, ...] = WHOLE) -> None:
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules

    def scans(self) -> DataFrame:
        """blob, rules (keys it has been scanned with), spans with their rule's key: one row a blob and update."""
        schema = "blob binary, rules array<string>, spans array<struct<rule:string,kind:string,start:bigint,end:bigint>>"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/scans")
        except AnalysisException:  # nothing has been scanned yet
            return self.spark.createDataFrame([], schema)

    def unseen(self, versions: DataFrame) -> DataFrame:
        """blob, the smallest version that holds it (path, version), and the rules it lacks; no rows for the rest."""
        keys = F.array(*(F.lit(r.key) for r in self.rules))
        blobs = versions.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("first"))
        known = self.scans().groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("known"))
        lacking = F.array_except(keys, F.coalesce("known", F.array().cast("array<string>")))
        return (
            blobs.join(known, "blob", "left")
            .select("blob", "first.path", "first.version", lacking.alias("lacking"))
            .filter(F.size("lacking") > 0)
        )

    def update(self, versions: DataFrame) -> None:
        """Scans what is new in `versions` (path, version, text) and appends it to the ledger.

        A null text is an empty blob; null paths and versions are values like others. Repeated rows and
        copies are scanned once. Rows are matched on path, version and blob, so two texts under one name
        are two blobs.
        """
        held = addressed(versions)
        todo = self.unseen(held.drop("text")).hint("shuffle_hash")
        same = F.expr("h.blob = t.blob AND h.path <=> t.path AND h.version <=> t.version")
        fresh = held.alias("h").join(todo.alias("t"), same).select("t.blob", "h.text", "t.lacking")
        rules = self.rules

        def work(batch: pa.RecordBatch):
            scanner = Scanner(rules)
            keys = {r.kind: r.key for r in rules}
            spans = [
                [{"rule": keys[s["kind"]], **s} for s in scanner.spans(text, set(lacking))]
                for text, lacking in zip(texts(batch.column("text")), batch.column("lacking").to_pylist(), strict=True)
            ]
            kind = pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), batch.column("lacking"), pa.array(spans, pa.list_(kind))],
                ["blob", "rules", "spans"],
            )

        schema = "blob binary, rules array<string>, spans array<struct<rule:string,kind:string,start:bigint,end:bigint>>"
        map_batches(fresh, work, schema).write.mode("append").parquet(f"{self.folder}/scans")

    def report(self, versions: DataFrame) -> DataFrame:
        """path, version, blob, spans of the ledger's current rules, sorted by start, then kind as listed.

        One row for each row of `versions`, whose blobs must have been scanned.
        """
        keys = F.array(*(F.lit(r.key) for r in self.rules))
        kinds = F.array(*(F.lit(r.kind) for r in self.rules))
        ordered = F.array_sort(
            F.array_distinct(
                F.transform(
                    F.filter(F.flatten(F.collect_list("spans")), lambda s: F.array_contains(keys, s["rule"])),
                    lambda s: F.struct(s["start"], F.array_position(kinds, s["kind"]).alias("no"), s["end"], s["kind"]),
                )
            )
        )
        found = (
            self.scans()
            .groupBy("blob")
            .agg(F.transform(ordered, lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("spans"))
        )
        return addressed(versions).drop("text").join(found, "blob", "left").select("path", "version", "blob", "spans")

    def redact(self, docs: DataFrame) -> DataFrame:
        """The rows of docs with the ledger's spans in `text` replaced by [kind]; texts that hold none stay as they are.

        The texts must have been scanned. Only blobs with findings are looked for, so texts go through one
        shuffle by their address; AQE splits that of a frequent text.
        """
        keys = F.array(*(F.lit(r.key) for r in self.rules))
        hits = F.filter("spans", lambda s: F.array_contains(keys, s["rule"]))
        listed = self.scans().select("blob", F.inline(hits)).groupBy("blob").agg(F.collect_set(F.struct("start", "end", "kind")).alias("s"))
        found = listed.select("blob", F.array_sort("s").alias("spans"))
        columns = docs.columns
        held = docs.withColumn("blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
        text = F.when(F.col("f.spans").isNull(), F.col("h.text")).otherwise(redacted(F.col("h.text"), F.col("f.spans")))
        joined = held.alias("h").join(found.hint("shuffle_hash").alias("f"), F.expr("h.blob = f.blob"), "left")
        return joined.select(*(text.alias(c) if c == "text" else F.col(f"h.{c}") for c in columns))


def addressed(versions: DataFrame) -> DataFrame:
    """path, version, text with nulls emptied, and the blob's address."""
    text = F.coalesce("text", F.lit(""))
    return versions.select("path", "version", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; where spans overlap, one mark stands for all of them.

    Spans must be sorted by start.
    """
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(
            F.concat(
                acc["out"],
                F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                F.concat(F.lit("["), s["kind"], F.lit("]")),
            ).alias("out"),
            s["end"].alias("at"),
        ),
    ).otherwise(F.struct(acc["out"], F.greatest(acc["at"], s["end"]).alias("at")))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, rest)).otherwise(text)


def _sql_spans(kind: str, no: int, pattern: str, least: int, group: int) -> str:
    """Spans of one kind in DuckDB: the pieces between matches and the matches give the starts."""
    return f"""SELECT doc_id, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'start':
      CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
      'no': {no}, 'kind': '{kind}', 'size': length(m[i]), 'key': length(k[i])}}), lambda s: s.key >= {least})) AS s
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS k,
      string_split_regex(t, '{pattern}') AS g FROM texts)"""


def _oracle() -> str:
    any_case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    assign = (
        "(" + "|".join([*(any_case(w) for w in ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")])
        + """)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    )
    parts = []
    for no, r in enumerate(RULES):
        # runs that are too short anyway need not be listed
        pattern = {"assign": assign, "hex": "[0-9a-f]{32,}"}.get(r.kind, r.pattern)
        parts.append(_sql_spans(r.kind, no, pattern, r.least, r.group))
    spans = "\n    UNION ALL ".join(parts)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({spans}),
rows AS (SELECT doc_id, s.no AS no, s.kind AS kind, s.start AS pos,
  s.kind || ':' || s.start || ':' || (s.start + s.size) AS span FROM spans)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY pos, no) FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY pos, no), '') AS spans
FROM documents d LEFT JOIN rows r ON d.doc_id = r.doc_id GROUP BY d.doc_id
"""


@query("op2_secret_scan", _oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text")
    ledger = BlobLedger(spark, scratch(spark, "ledger"), RULES)
    ledger.update(versions)
    return findings(ledger.report(versions)).withColumnRenamed("path", "doc_id")


def findings(report: DataFrame) -> DataFrame:
    """Counts, digest and listing of a report's spans."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return report.select(
        "path", *(of(k) for k in BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans")
    )
