"""One query per operator over its whole table, and the SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import ann, decontaminate, language, mixing, ngram_join, quality_gam, secret_scan, simhash, token_alignment, token_counts, url_lists, warc_zip, whitening
from shelfline.llm.common import table
from shelfline.sources.storage import scratch_path

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        LLM_QUERIES[name] = build
        if sql:
            LLM_SQL[name] = sql
        return build

    return register


@query(
    "op2_decontamination",
    sql=r"""
    WITH split AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ),
    item AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark
    ),
    item_window AS (
        SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS gram
        FROM (SELECT item_id, w[i:i + 9] AS win
              FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0))
    ),
    lens AS (SELECT DISTINCT n FROM item_window),
    doc_window AS (
        SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, lens WHERE len(w) >= n)
    ),
    hit AS (SELECT doc_id, i, d.n, item_id FROM doc_window d JOIN item_window USING (n, gram)),
    covered AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
    ),
    listed AS (
        SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
    )
    SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM split s LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
)
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op4_simhash")
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, folder, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _secret_kind(order: int, kind: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {order} AS ord, '{kind}' AS kind, regexp_extract_all(t, '{quoted}') AS m,
               regexp_extract_all(t, '{quoted}', 1) AS v, string_split_regex(t, '{quoted}') AS p FROM d"""


@query(
    "op6_secret_scan",
    sql=f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    k AS (
        {_secret_kind(0, "assign", ASSIGN)}
        UNION ALL {_secret_kind(1, "access", "(AKIA[A-Z0-9]+)")}
        UNION ALL {_secret_kind(2, "hex", "([0-9a-f]{24,})")}
        UNION ALL {_secret_kind(3, "live", "([A-Za-z0-9+/_=-]{20,})")}
    ),
    one AS (
        SELECT doc_id, source, ord, kind, i, length(p[i]) AS gap, length(m[i]) AS size, v[i] AS value
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)
    ),
    placed AS (
        SELECT *, CAST(sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM one
    ),
    valid AS (
        SELECT doc_id, source, ord, kind, e - size AS s, e, value FROM placed
        WHERE length(value) >= CASE kind WHEN 'assign' THEN 6 WHEN 'hex' THEN 24 ELSE 20 END
          AND (kind <> 'live' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
               AND len(list_distinct(string_split(value, ''))) >= 10))
    ),
    held AS (SELECT value, count(DISTINCT source) + CAST(bool_or(source IS NULL) AS INTEGER) >= 5 AS example FROM valid GROUP BY value),
    kept AS (
        SELECT a.*, example FROM valid a JOIN held USING (value)
        WHERE kind <> 'live' OR (NOT example AND NOT EXISTS (
            SELECT 1 FROM valid b WHERE b.doc_id = a.doc_id AND b.kind <> 'live' AND b.s < a.e AND b.e > a.s))
    ),
    total AS (
        SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
               count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE NOT example) AS n_live,
               count(*) FILTER (WHERE example) AS n_example, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (WHERE kind <> 'live') AS base
        FROM kept GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
           coalesce(n_example, 0) AS n_example
    FROM documents LEFT JOIN total USING (doc_id)
    """,
)
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_example"
    )


@query("op7_source_mixing")
def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op1_nearest_neighbours")
def op1_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@query(
    "op3_warc_packages",
    sql="""
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
        FROM pages
    ),
    o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN original <> page_id THEN original END AS refers_to
    FROM p LEFT JOIN o USING (payload_digest)
    """,
)
def op3_warc_packages(spark: SparkSession, folder: str) -> DataFrame:
    packages = scratch_path(spark, "packages")
    warc_zip.write_packages(table(spark, folder, "pages"), packages)
    read = warc_zip.read_packages(spark, packages, payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_quality")
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_gam.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op9_url_lists",
    sql="""
    WITH page AS (
        SELECT page_id, url, timestamp '2024-01-01 00:00:00' + to_seconds((page_id * 7919) % 2592000) AS fetched,
               nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
               regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
        FROM pages
    ),
    part AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS steps FROM page),
    entry AS (
        SELECT e.ts AS moment, e.event_id AS seq, 'c' || (e.user_id % 3) AS category,
               CASE e.event_type WHEN 'signup' THEN 'domain' WHEN 'purchase' THEN 'prefix' ELSE 'host' END AS kind,
               CASE e.event_type
                   WHEN 'signup' THEN array_to_string(list_slice(p.labels, greatest(len(p.labels) - 2, 1), len(p.labels)), '.')
                   WHEN 'purchase' THEN p.host || '/' || p.steps[2]
                   ELSE p.host END AS key,
               CASE WHEN e.event_type = 'error' THEN 'remove' ELSE 'add' END AS action
        FROM events e JOIN part p ON p.page_id = e.event_id % (SELECT max(page_id) + 1 FROM pages)
    ),
    -- the state a moment ends with, valid until the next one at which the list names the key
    listed AS (SELECT kind, key, category, moment, arg_max(action, seq) AS action FROM entry WHERE key IS NOT NULL GROUP BY ALL),
    cell AS (
        SELECT kind, key, category, action, moment AS since,
               lead(moment) OVER (PARTITION BY kind, key, category ORDER BY moment) AS until
        FROM listed
    ),
    answer AS (
        SELECT page_id, 'host' AS kind, host AS key FROM part WHERE host IS NOT NULL
        UNION
        SELECT page_id, 'domain', array_to_string(list_slice(labels, i, len(labels)), '.')
        FROM (SELECT page_id, labels, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM part WHERE host IS NOT NULL)
        UNION
        SELECT page_id, 'prefix', host || '/' || array_to_string(list_slice(kept, 1, i), '/')
        FROM (SELECT page_id, host, kept, unnest(range(1, len(kept) + 1)) AS i
              FROM (SELECT page_id, host, regexp_extract_all(path, '[^/]+') AS kept FROM part WHERE host IS NOT NULL))
    ),
    rule AS (
        SELECT DISTINCT a.page_id, a.kind || ':' || a.key || ':' || c.category AS name
        FROM answer a JOIN part USING (page_id) JOIN cell c
          ON c.kind = a.kind AND c.key = a.key AND c.action = 'add' AND c.since <= fetched AND (c.until IS NULL OR fetched < c.until)
    ),
    found AS (SELECT page_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM rule GROUP BY page_id)
    SELECT page_id, CAST(epoch(fetched) AS BIGINT) AS fetched_at, host, CAST(coalesce(n, 0) AS BIGINT) AS n_active,
           coalesce(names, '') AS rules, coalesce(n, 0) > 0 AS blocked
    FROM part LEFT JOIN found USING (page_id)
    """,
)
def op9_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    judged = url_lists.evaluate(url_lists.captures_of(pages), url_lists.entries_of(table(spark, folder, "events"), pages))
    return judged.select(
        "page_id", F.unix_timestamp("fetched").alias("fetched_at"), "host", "n_active", F.array_join("rules", ",").alias("rules"), "blocked"
    )


@query("op10_language")
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query(
    "op11_ngram_join",
    sql=r"""
    WITH RECURSIVE split AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ),
    gram AS (
        SELECT DISTINCT doc_id, len(w[i:i + 4]) AS width, array_to_string(w[i:i + 4], ' ') AS gram
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)
    ),
    total AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap
        FROM gram a JOIN gram b USING (width, gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL
    ),
    link AS (
        SELECT a, b FROM shared JOIN total x ON x.doc_id = a JOIN total y ON y.doc_id = b
        WHERE 100 * overlap >= 80 * (x.n + y.n - overlap)
    ),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents
        UNION SELECT link.b, reach.other FROM reach JOIN link ON reach.doc_id = link.a
    ),
    least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
    FROM documents JOIN least USING (doc_id) LEFT JOIN total USING (doc_id)
    """,
)
def op11_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.similarity_classes(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.token_alignment(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(table(spark, folder, "embeddings"))
    return white.withColumnRenamed("id", "vec_id")
