"""Logical tables over the stored parquet tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> (stored tables it reads, SELECT). ``{digest}`` is the engine's SHA-256 of a text.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "file_inventory": (
        ("documents",),
        """SELECT doc_id, 'w' || CAST(doc_id % 2 AS STRING) AS workspace, source AS server,
             '/' || lang || '/' || source || '/d' || CAST(doc_id % 10 AS STRING) || '/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 3 = 0 THEN '.TXT' ELSE '.csv' END AS path,
             CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars * (1 + doc_id % 7 * 400) END AS size_bytes, {digest} AS content_hash,
             CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 900 END AS age_days, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 500 + doc_id % 5 END AS uid,
             CASE doc_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'orphan_disk' ELSE 'observed' END AS status,
             doc_id % 6 = 0 AS is_canonical, doc_id AS first_seen
           FROM documents""",
    ),
    "legacy_index": (
        ("documents", "labels"),
        """SELECT d.doc_id AS legacy_key, d.source AS server,
             '/' || d.lang || '/' || d.source || '/d' || CAST(d.doc_id % 10 AS STRING) || '/' || CAST(CASE WHEN d.doc_id % 17 = 0 THEN -d.doc_id - 1 ELSE d.doc_id END AS STRING) || CASE WHEN d.doc_id % 13 = 0 THEN '' WHEN d.doc_id % 3 = 0 THEN '.TXT' ELSE '.csv' END AS path,
             CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 10 = 1 THEN d.n_chars + 1 ELSE d.n_chars * (1 + d.doc_id % 7 * 400) END AS legacy_size
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "catalogue": (
        ("documents", "labels"),
        """SELECT d.doc_id AS entry_id, 'entry ' || CAST(d.doc_id AS STRING) AS name, CASE WHEN d.doc_id % 8 = 0 THEN NULL ELSE d.source END AS category, d.lang AS mime,
             'file_' || CAST(d.doc_id AS STRING) || '.csv' AS filename, d.n_chars AS size_bytes, l.quality, l.toxic,
             TIMESTAMP '2024-01-01 00:00:00' + d.doc_id % 1000 * INTERVAL '1' HOUR AS created_at,
             CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE 1 + d.doc_id % 4 END AS n_columns
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "metrics": (("events",), "SELECT event_id, ts, user_id AS process_id, event_type AS key, value FROM events"),
    "requests": (
        ("events",),
        """SELECT event_id AS request_id, event_type AS model, user_id, ts AS started_at, value / 20 AS seconds,
             CASE event_id % 5 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'upstream_error' WHEN 2 THEN 'unmetered' ELSE 'completed' END AS status,
             event_id % 300 AS prompt_tokens, event_id % 70 AS completion_tokens FROM events""",
    ),
    "runs": (
        ("orders",),
        """SELECT o_orderkey AS run_id, o_orderpriority AS template, o_custkey AS user_id, o_orderdate AS created_at,
             CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END AS status,
             o_orderkey % 10 <> 3 AS result_ok, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 5000 END AS duration_ms FROM orders""",
    ),
    "steps": (
        ("lineitem",),
        """SELECT l_orderkey AS run_id, 'n' || CAST(l_linenumber AS STRING) AS node, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'completed' ELSE 'running' END AS status,
             CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_quantity * 10 AS BIGINT) END AS ms, l_partkey AS sequence FROM lineitem""",
    ),
    "messages": (("conversations",), "SELECT conv_id, turn, role, text FROM conversations"),
    "causal_events": (
        ("events",),
        """SELECT 'n' || CAST(user_id % 20 AS STRING) AS net, event_id AS seq, event_type AS name,
             CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 THEN 'TokenCreated' ELSE 'TransitionFired' END AS kind FROM events""",
    ),
    "causal_tokens": (
        ("events",),
        """SELECT 'n' || CAST(user_id % 20 AS STRING) AS net, event_id AS seq, 't' || CAST(event_id AS STRING) AS token, 'produced' AS role,
             CASE WHEN event_id % 17 = 0 THEN 'sig_' || event_type ELSE event_type END AS place, props AS data FROM events
           UNION ALL SELECT 'n' || CAST(user_id % 20 AS STRING), event_id, 't' || CAST(event_id - 1 - event_id % 5 AS STRING), 'consumed', event_type, CAST(NULL AS STRING)
           FROM events WHERE event_id > 10 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0""",
    ),
    "causal_cross": (
        ("events",),
        """SELECT 'k' || CAST(a.event_id AS STRING) AS signal_key, 'n' || CAST(b.user_id % 20 AS STRING) AS egress_net, b.event_id AS egress_seq, 'n' || CAST(a.user_id % 20 AS STRING) AS ingress_net, a.event_id AS ingress_seq
           FROM events a JOIN events b ON b.event_id = a.event_id - 7 WHERE a.event_id % 11 = 0""",
    ),
    "causal_signals": (
        ("events",),
        """SELECT 's' || CAST(a.event_id AS STRING) AS signal_key, 'n' || CAST(b.user_id % 20 AS STRING) AS egress_net, b.event_id AS egress_seq, 'n' || CAST(a.user_id % 20 AS STRING) AS ingress_net, a.event_id AS ingress_seq
           FROM events a JOIN events b ON b.event_id = a.event_id - 9 WHERE a.event_id % 13 = 0""",
    ),
    "causal_tags": (("events",), "SELECT 't' || CAST(event_id AS STRING) AS token, 'p' || CAST(user_id % 40 AS STRING) AS process FROM events"),
    "triggers": (("events",), "SELECT user_id % 50 AS key, event_id AS seq, CASE WHEN event_type IN ('purchase', 'error') THEN 'done' ELSE 'fire' END AS kind, 'p' || CAST(event_id AS STRING) AS payload FROM events"),
    "arcs": (
        ("lineitem",),
        """SELECT DISTINCT 'n' || CAST(l_partkey AS STRING) AS place, 't' || CAST(l_suppkey AS STRING) AS transition, 'x' || CAST(l_linenumber % 3 AS STRING) AS port,
             CASE WHEN l_linenumber % 2 = 0 THEN 'in' ELSE 'out' END AS direction, 1 + l_orderkey % 2 AS weight FROM lineitem WHERE l_partkey % 5 <> 0""",
    ),
    "entries": (
        ("events",),
        """SELECT event_id AS entry_id, CASE WHEN event_id % 4 = 0 THEN 'p' || CAST(user_id % 40 AS STRING) END AS process_id,
             CASE WHEN event_id % 4 = 1 THEN 'p' || CAST(user_id % 40 AS STRING) || ':step' WHEN event_id % 4 = 2 THEN 'p' || CAST(user_id % 40 AS STRING) END AS job_id,
             CASE WHEN event_id % 11 = 0 THEN 'k' || CAST(event_id AS STRING) END AS signal_key, 'h' || CAST(event_id % 500 AS STRING) AS content_hash,
             event_type AS category, ts AS created_at FROM events""",
    ),
    "producers": (("events",), "SELECT 'h' || CAST(event_id % 500 AS STRING) AS content_hash, CASE WHEN event_id % 2 = 0 THEN 'p' || CAST(user_id % 40 AS STRING) END AS process_id, 'n' || CAST(user_id % 20 AS STRING) AS source_net FROM events WHERE event_id % 97 = 0"),
    "processes": (("events",), "SELECT DISTINCT 'p' || CAST(user_id % 40 AS STRING) AS process_id, 'n' || CAST(user_id % 20 AS STRING) AS net_id FROM events"),
    "tokens": (("events",), "SELECT event_id AS seq, event_type AS place, user_id % 50 AS k, value, ts FROM events"),
}

#: Stands for now() wherever a query is relative to it.
NOW = "2026-06-10 12:00:00"


def view(spark: SparkSession, sf_dir: str, name: str, read: Callable[[SparkSession, str, str], DataFrame] | None = None) -> DataFrame:
    """A logical table as a DataFrame; no temporary view stays behind. ``read`` may bring its tables as streams."""
    tables, sql = VIEWS[name]
    frames = {t: read(spark, sf_dir, t) if read else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    text = sql.replace("{digest}", "sha2(text, 256)")
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **frames)


def with_views(sql: str) -> str:
    """DuckDB text: the logical tables that ``sql`` names, in front of it."""
    used = [n for n in VIEWS if n in sql]
    ctes = ", ".join(f"v_{n} AS ({VIEWS[n][1].replace('{digest}', 'sha256(text)')})" for n in used if f"v_{n}" in sql)
    if not ctes:
        return sql
    recursive = sql.startswith("WITH RECURSIVE ")
    if recursive:
        return f"WITH RECURSIVE {ctes}, {sql[len('WITH RECURSIVE '):]}"
    if sql.startswith("WITH "):
        return f"WITH {ctes}, {sql[5:]}"
    return f"WITH {ctes} {sql}"
