"""Secret, path, token and bundle queries over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions import columns, text
from fieldcheck.operators import bundles, provenance, similarity
from fieldcheck.plans.registry import Tables, query

KNOWN = ("hunter2value", "second-secret")
SECRET_SQL = text.ASSIGNED_SECRET.replace("'", "''")


@query(
    "secret_scan",
    f"""WITH s AS (SELECT path, text FROM texts UNION ALL SELECT replace(path, '.bin', CASE WHEN length(path) % 2 = 0 THEN '/.zattrs' ELSE '/.zindex' END), text FROM texts WHERE suffix(path, '.bin'))
        SELECT path, CASE WHEN NOT regexp_matches(path, '(\\.(txt|json|toml)|/\\.zattrs)$') THEN 'not_scanned' WHEN contains(text, 'hunter2value') OR contains(text, 'second-secret') THEN 'known_environment_secret'
          WHEN contains(text, '-----BEGIN PRIVATE KEY-----') THEN 'private_key_material' WHEN regexp_matches(text, '{SECRET_SQL}') THEN 'assigned_secret_like_value' ELSE 'clean' END AS reason FROM s""",
)
def secret_scan(t: Tables) -> DataFrame:
    """All texts; those of binary names also as store metadata, some under a name that is not scanned."""
    texts, path = t.texts(), F.col("path")
    name = F.when(F.length(path) % 2 == 0, "/.zattrs").otherwise("/.zindex")
    stores = texts.filter(path.endswith(".bin")).withColumn("path", F.replace(path, F.lit(".bin"), name))
    reason = F.when(~text.is_scanned(path), "not_scanned").otherwise(text.secret_reason(F.col("text"), KNOWN))
    return texts.unionByName(stores).select("path", reason.alias("reason"))


WORDS = ("hunter2value", "hunter2", "password", "the", " que ")


@query(
    "redact",
    """WITH s AS (SELECT path, text, replace(replace(replace(replace(replace(text, 'hunter2value', '<redacted>'), 'password', '<redacted>'), 'hunter2', '<redacted>'), ' que ', '<redacted>'), 'the', '<redacted>') AS r FROM texts)
       SELECT path, md5(r) AS redacted_md5, CAST((length(text) - length(replace(text, 'hunter2value', ''))) / 12
          + (length(replace(text, 'hunter2value', '<redacted>')) - length(replace(replace(text, 'hunter2value', '<redacted>'), 'password', ''))) / 8
          + (length(replace(replace(text, 'hunter2value', '#'), 'password', '#')) - length(replace(replace(replace(text, 'hunter2value', '#'), 'password', '#'), 'hunter2', ''))) / 7
          + (length(text) - length(replace(text, ' que ', ''))) / 5
          + (length(replace(text, ' que ', '<redacted>')) - length(replace(replace(text, ' que ', '<redacted>'), 'the', ''))) / 3 AS BIGINT) AS replacements FROM s""",
)
def redact(t: Tables) -> DataFrame:
    body = F.col("text")
    return t.texts().select(
        "path", F.md5(text.redacted(body, WORDS)).alias("redacted_md5"), text.redaction_count(body, WORDS).cast("long").alias("replacements")
    )


STOPS = ", ".join(f"'{w}'" for w in columns.STOP_WORDS)
TOKENS_SQL = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 2 AND w NOT IN ({STOPS})))"


@query(
    "tokens",
    f"""SELECT doc_id, CAST(len(k) AS INTEGER) AS n_tokens, md5(array_to_string(list_sort(k), ',')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS_SQL} AS k FROM documents)""",
)
def tokens(t: Tables) -> DataFrame:
    k = columns.meaningful_tokens(F.col("text"))
    return t.read("documents").select("doc_id", k.alias("_k")).select(
        "doc_id", F.size("_k").alias("n_tokens"), F.md5(F.array_join(F.sort_array("_k"), ",")).alias("tokens_md5")
    )


NEAR = 0.72


@query(
    "near_dup",
    f"""WITH p AS (SELECT doc_id, lang, [source, 'len' || (n_chars // 500)] AS paths, {TOKENS_SQL} AS k FROM documents)
        SELECT b.doc_id, min(a.doc_id) AS earlier_id FROM p a JOIN p b ON a.lang = b.lang AND a.doc_id < b.doc_id AND list_has_any(a.paths, b.paths)
          AND len(a.k) > 0 AND len(b.k) > 0 AND len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) >= {NEAR} GROUP BY 1""",
)
def near_dup(t: Tables) -> DataFrame:
    """Documents as proposals: language as target set, source and length class as edit paths."""
    length_class = F.concat(F.lit("len"), F.floor(F.col("n_chars") / 500))
    proposals = t.read("documents").select(
        F.col("doc_id").alias("seq"),
        F.col("lang").alias("targets"),
        F.array("source", length_class).alias("paths"),
        columns.meaningful_tokens(F.col("text")).alias("tokens"),
    )
    out = similarity.earliest_similar(proposals, NEAR)
    return out.select(F.col("seq").alias("doc_id"), F.col("earlier").alias("earlier_id"))


@query(
    "slug",
    """SELECT page_id, CASE WHEN s = '' THEN 'dataset' ELSE s END AS slug, CASE WHEN g <> '' THEN g END AS tag FROM (SELECT page_id,
         regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s, regexp_replace(regexp_replace(lower(html), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS g FROM pages)""",
)
def slug(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", columns.slug(F.col("url")).alias("slug"), columns.tag(F.col("html")).alias("tag"))


LOG_SQL = """'run ' || o_orderkey || ' ' || CASE o_orderpriority WHEN '1-URGENT' THEN 'HTTP Error 502: Bad Gateway' WHEN '2-HIGH' THEN 'ModuleNotFoundError: No module named pytest.mark' WHEN '3-MEDIUM' THEN 'OSError: Permission denied'
   WHEN '4-NOT SPECIFIED' THEN 'numpy.dtype size changed' ELSE 'Shared public output policy hash mismatch' END || CASE o_orderstatus WHEN 'F' THEN ' connection reset' ELSE '' END"""


@query(
    "classify_failure",
    f"""WITH l AS (SELECT o_orderkey, lower({LOG_SQL}) AS t, o_totalprice > 100000 AS launched, o_totalprice > 400000 AS timed_out, o_custkey < 700 AS py FROM orders)
        SELECT o_orderkey, CASE WHEN NOT launched AND NOT timed_out AND contains(t, 'permission denied') THEN 'harness' WHEN contains(t, 'no module named pytest') AND py THEN 'environment'
          WHEN contains(t, 'numpy.dtype size changed') THEN 'environment' WHEN contains(t, 'bad gateway') OR contains(t, 'connection reset') THEN 'provider' WHEN contains(t, 'policy hash mismatch') THEN 'policy' ELSE 'candidate' END AS origin FROM l""",
)
def classify_failure(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    origin = text.failure_class(F.expr(LOG_SQL), price > 100000, price > 400000, F.col("o_custkey") < 700)
    return t.read("orders").select("o_orderkey", origin.alias("origin"))


@query(
    "safe_path",
    """WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '^https?:/', '') WHEN 1 THEN '' WHEN 2 THEN 'a/../' || url WHEN 3 THEN url || '/..x' ELSE regexp_replace(url, '^https?://', '') END AS path FROM pages)
       SELECT page_id, path, path <> '' AND NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AS safe FROM p""",
)
def safe_path(t: Tables) -> DataFrame:
    url, turn = F.col("url"), F.col("page_id") % 5
    path = (
        F.when(turn == 0, F.regexp_replace(url, "^https?:/", ""))
        .when(turn == 1, "")
        .when(turn == 2, F.concat(F.lit("a/../"), url))
        .when(turn == 3, F.concat(url, F.lit("/..x")))
        .otherwise(F.regexp_replace(url, "^https?://", ""))
    )
    return t.read("pages").select("page_id", path.alias("path")).withColumn("safe", columns.safe_path(F.col("path")))


FILE_MAX, TOTAL_MAX = 3000, 60000


@query(
    "budget_pack",
    f"""WITH c AS (SELECT source, doc_id, n_chars, least(n_chars, {FILE_MAX}) AS cut, sum(least(n_chars, {FILE_MAX})) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents),
        i AS (SELECT source, doc_id, n_chars, CAST(greatest(least(cut, {TOTAL_MAX} - (upto - cut)), 0) AS BIGINT) AS included FROM c)
        SELECT *, CASE WHEN included = 0 THEN 'excluded' WHEN included < n_chars THEN 'truncated' ELSE 'whole' END AS state FROM i""",
)
def budget_pack(t: Tables) -> DataFrame:
    return bundles.budget_pack(t.read("documents"), ["source"], ["doc_id"], FILE_MAX, TOTAL_MAX)


@query(
    "budget_lines",
    f"""WITH s AS (SELECT source, doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
        c AS (SELECT *, least(n_chars, {FILE_MAX}) AS cut, sum(least(n_chars, {FILE_MAX})) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM s),
        r AS (SELECT *, CAST(greatest(least(cut, {TOTAL_MAX} - (upto - cut)), 0) AS BIGINT) AS room FROM c),
        i AS (SELECT source, n_chars, CASE WHEN room > 0 AND room < cut THEN greatest(room - length(string_split(left(text, room), chr(10))[-1]) - 1, 0) ELSE room END AS included FROM r)
        SELECT source, count(*) AS files, count(*) FILTER (included > 0) AS included_files, count(*) FILTER (included > 0 AND included < n_chars) AS truncated_files, count(*) FILTER (included = 0) AS excluded_files,
          CAST(sum(n_chars) AS BIGINT) AS total_chars, CAST(sum(included) AS BIGINT) AS included_chars FROM i GROUP BY 1""",
)
def budget_lines(t: Tables) -> DataFrame:
    """What of each source's texts a reviewer gets, ending at a line's end."""
    docs = t.read("documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = docs.withColumn("n_chars", F.length("text"))
    return bundles.pack_coverage(bundles.budget_pack(sized, ["source"], ["doc_id"], FILE_MAX, TOTAL_MAX, "text"), ["source"])


LOG_STOPS = ", ".join(f"'{w}'" for w in bundles.LOG_STOP_WORDS)


@query(
    "failure_relevance",
    f"""WITH l AS (SELECT conv_id, arg_min(text, turn) AS log FROM conversations GROUP BY 1),
        k AS (SELECT conv_id, log, list_distinct(list_filter([lower(w) FOR w IN regexp_extract_all(log, '[A-Za-z_][A-Za-z0-9_]{{3,}}')], lambda w: w NOT IN ({LOG_STOPS}))) AS terms FROM l),
        f AS (SELECT conv_id AS run_id, 'turn/' || turn || CASE role WHEN 'assistant' THEN '.py' ELSE '.md' END AS path, text FROM conversations),
        s AS (SELECT run_id, path, len(list_filter(terms, lambda w: contains(lower(text), w))) AS relevance FROM f JOIN k ON run_id = conv_id)
        SELECT run_id, path, false AS referenced, CAST(relevance AS INTEGER) AS relevance, row_number() OVER (PARTITION BY run_id ORDER BY relevance DESC, suffix(path, '.py') DESC, path) AS rank FROM s""",
)
def failure_relevance(t: Tables) -> DataFrame:
    v = t.read("conversations")
    logs = v.groupBy(F.col("conv_id").alias("run_id")).agg(F.min_by("text", "turn").alias("log"))
    suffix = F.when(F.col("role") == "assistant", ".py").otherwise(".md")
    files = v.select(F.col("conv_id").alias("run_id"), F.concat(F.lit("turn/"), "turn", suffix).alias("path"), "text")
    return bundles.failure_relevance(files, logs)


@query(
    "citation_bounds",
    """WITH c AS (SELECT conv_id * 1000 + turn AS citation_id, 'doc/' || (conv_id * 7) AS path, length(text) // 20 AS line_end, turn AS score FROM conversations),
       f AS (SELECT 'doc/' || doc_id AS path, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents),
       j AS (SELECT citation_id, c.path, CASE WHEN line_count IS NULL THEN 'unknown_file' WHEN line_end > line_count THEN 'beyond_end' WHEN score > 4 THEN 'score_above_cap' END AS problem FROM c LEFT JOIN f ON c.path = f.path)
       SELECT * FROM j WHERE problem IS NOT NULL""",
)
def citation_bounds(t: Tables) -> DataFrame:
    citations = t.read("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("citation_id"),
        F.concat(F.lit("doc/"), F.col("conv_id") * 7).alias("path"),
        F.floor(F.length("text") / 20).alias("line_end"),
        F.col("turn").alias("score"),
    )
    files = t.read("documents").select(
        F.concat(F.lit("doc/"), "doc_id").alias("path"), (F.regexp_count("text", F.lit("\n")) + 1).alias("line_count")
    )
    return provenance.citation_problems(citations, files, 4)
