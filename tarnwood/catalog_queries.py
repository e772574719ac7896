"""All registered queries outside the training-data subpackage, each with its DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwood.functions import dsl
from tarnwood.functions.expressions import AGES, LATENCY_BOUNDS, SIZE_CLASSES, bucket_start, epoch_seconds, human_bytes
from tarnwood.operators import dataflow, inventory, profiling, projections, provenance, ranking, rollup
from tarnwood.sources.files import format_of
from tarnwood.streaming import folds
from tarnwood.views import NOW, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(made: Query) -> Query:
        QUERIES[name] = made
        if sql:
            ORACLE_SQL[name] = with_views(" ".join(sql.split()))
        return made

    return add


def columns(sql: str) -> list[str]:
    """The columns of a select list that Spark and its twin share; commas inside brackets don't part them."""
    return [c for c in re.split(r",\s(?![^()]*\))", " ".join(sql.split())) if c]


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- query language


def _ask(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = view(spark, sf_dir, "catalogue")
        meta = {
            "col": F.transform(F.sequence(F.lit(1), F.coalesce("n_columns", F.lit(1))), lambda i: F.concat(F.lit("c"), i.cast("string"))), "pii": F.when(F.col("toxic") == 1, F.array(F.lit("email"))).otherwise(F.array().cast("array<string>")),
            "attr": F.create_map(F.lit("lang"), F.col("mime")), "format": F.lit("CSV"), "schema": F.concat(F.lit("s"), F.coalesce(F.col("n_columns"), F.lit(1)).cast("string")),
        }
        found = dsl.parse(text)
        test = dsl.compile_query(found, rows.schema, datetime.fromisoformat(NOW), ("name", "filename"), {"invoice": ["s2", "s3"]}, meta)
        return rows.where(test).select("entry_id", "size_bytes")

    return run


_DSL = {
    "dsl_filter_numeric": ("quality:1 size_bytes>=2000 size_bytes<9000.5", "quality = 1 AND size_bytes >= 2000 AND size_bytes < 9000.5"),
    "dsl_filter_bytes_suffix": ("size_bytes>=1.5k size_bytes<10kb", "size_bytes >= 1536 AND size_bytes < 10240"),
    "dsl_filter_relative_date": ("created_at>-880d created_at<2024-02-01", "created_at > TIMESTAMP '2024-01-12 12:00:00' AND created_at < TIMESTAMP '2024-02-01 00:00:00'"),
    "dsl_text_ops": ("filename^FILE_1 filename$5.csv name~y_1", "filename ILIKE 'FILE_1%' AND filename ILIKE '%5.csv' AND name ILIKE '%y_1%'"),
    "dsl_in_list": ("category:src1,src2,src3 mime!:fr,de", "category IN ('src1','src2','src3') AND mime NOT IN ('fr','de')"),
    "dsl_null_ops": ("category:null n_columns:*", "category IS NULL AND n_columns IS NOT NULL"),
    "dsl_not_equal": ("category!=src0", "category <> 'src0'"),
    "dsl_free_text": ('"entry 1" 7', "(name ILIKE '%entry 1%' OR filename ILIKE '%entry 1%') AND (name ILIKE '%7%' OR filename ILIKE '%7%')"),
    "dsl_containment": ("col:c3 attr:lang=en format:csv pii:email", "COALESCE(n_columns, 1) >= 3 AND mime = 'en' AND toxic = 1"),
    "dsl_datatype": ("datatype:invoice", "COALESCE(n_columns, 1) IN (2, 3)"),
    "dsl_unknown_datatype": ("datatype:nothing size_bytes>0", "1 = 0"),
}
for _name, (_text, _where) in _DSL.items():
    query(_name, f"SELECT entry_id, size_bytes FROM v_catalogue WHERE {_where}")(_ask(_text))


# ---------------------------------------------------------------- catalogue


@query("catalogue_page", "SELECT entry_id, category FROM v_catalogue ORDER BY category DESC NULLS LAST, entry_id LIMIT 50 OFFSET 100")
def catalogue_page(spark, sf_dir):
    return inventory.page(view(spark, sf_dir, "catalogue"), [F.desc_nulls_last("category"), F.col("entry_id")], 2, 50).select("entry_id", "category")


@query("catalogue_stats", "SELECT COALESCE(category, 'uncategorized') AS category, COUNT(*) AS n, CAST(SUM(size_bytes) AS BIGINT) AS bytes, CAST(MAX(epoch(created_at)) AS BIGINT) AS newest FROM v_catalogue GROUP BY 1")
def catalogue_stats(spark, sf_dir):
    rows = view(spark, sf_dir, "catalogue")
    return rows.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.max(epoch_seconds(F.col("created_at"))).alias("newest"))


@query("distinct_values", "SELECT DISTINCT category FROM v_catalogue WHERE category IS NOT NULL")
def distinct_values(spark, sf_dir):
    return view(spark, sf_dir, "catalogue").select("category").where("category is not null").distinct()


@query("facet_plain", "SELECT COALESCE(category, 'uncategorized') AS key, COUNT(*) AS n, CAST(COALESCE(SUM(size_bytes), 0) AS BIGINT) AS bytes FROM v_catalogue GROUP BY 1")
def facet_plain(spark, sf_dir):
    return inventory.facets(view(spark, sf_dir, "catalogue"), F.col("category"), "uncategorized")


_NAMES = "transform(sequence(1, n_columns), i -> concat('c', cast(i as string)))"


@query("facet_array_element", "SELECT 'c' || CAST(i AS STRING) AS key, COUNT(*) AS n, CAST(SUM(size_bytes) AS BIGINT) AS bytes FROM (SELECT size_bytes, UNNEST(range(1, n_columns + 1)) AS i FROM v_catalogue WHERE n_columns IS NOT NULL) GROUP BY 1")
def facet_array_element(spark, sf_dir):
    return inventory.facet_elements(view(spark, sf_dir, "catalogue"), F.expr(_NAMES))


@query("facet_distinct_per_row", "SELECT 'k' || CAST(i AS STRING) AS key, COUNT(*) AS n, CAST(SUM(size_bytes) AS BIGINT) AS bytes FROM (SELECT DISTINCT entry_id, size_bytes, i % 2 AS i FROM (SELECT entry_id, size_bytes, UNNEST(range(1, n_columns + 1)) AS i FROM v_catalogue WHERE n_columns IS NOT NULL)) GROUP BY 1")
def facet_distinct_per_row(spark, sf_dir):
    return inventory.facet_elements(view(spark, sf_dir, "catalogue"), F.expr("transform(sequence(1, n_columns), i -> concat('k', cast(i % 2 as string)))"), True)


# ---------------------------------------------------------------- inventory


def _case(value: str, rungs, top: str, sign: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'unknown' " + " ".join(f"WHEN {value} {sign} {b} THEN '{k}'" for k, b in rungs) + f" ELSE '{top}' END"


_EXT = r"NULLIF(lower(regexp_extract(path, '\.([A-Za-z0-9_~#-]{1,16})$', 1)), '')"
_DIMS = {
    "server": "server", "extension": f"COALESCE({_EXT}, 'none')", "size_class": _case("size_bytes", SIZE_CLASSES, ">=4G", "<"),
    "age": _case("age_days", AGES, ">2y", "<="), "owner": "COALESCE(CAST(uid AS STRING), 'unknown')", "status": "status",
}


def _breakdown(by: str):
    return lambda spark, sf_dir: inventory.breakdown(view(spark, sf_dir, "file_inventory"), by)


for _by, _sql in _DIMS.items():
    query(f"breakdown_{_by}", f"SELECT {_sql} AS key, COUNT(*) AS n_files, CAST(COALESCE(SUM(size_bytes), 0) AS BIGINT) AS bytes FROM v_file_inventory GROUP BY 1")(_breakdown(_by))


@query("breakdown_directory", "SELECT array_to_string(string_split(substr(path, 5), '/')[1:2], '/') AS key, COUNT(*) AS n_files, CAST(COALESCE(SUM(size_bytes), 0) AS BIGINT) AS bytes, bool_and(len(string_split(substr(path, 5), '/')) <= 2) AS is_leaf FROM v_file_inventory WHERE starts_with(path, '/en/') GROUP BY 1")
def breakdown_directory(spark, sf_dir):
    return inventory.breakdown(view(spark, sf_dir, "file_inventory"), "directory", 2, "en")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter text, compiled to a column, in front of a directory breakdown."""
    files = view(spark, sf_dir, "file_inventory")
    test = dsl.compile_query(dsl.parse("size_bytes>=1k path$.csv"), files.schema, datetime.fromisoformat(NOW))
    return inventory.breakdown(files.where(test), "directory", 2)


query("filtered_breakdown", "SELECT array_to_string(string_split(ltrim(path, '/'), '/')[1:2], '/') AS key, COUNT(*) AS n_files, CAST(COALESCE(SUM(size_bytes), 0) AS BIGINT) AS bytes, bool_and(len(string_split(ltrim(path, '/'), '/')) <= 2) AS is_leaf FROM v_file_inventory WHERE size_bytes >= 1024 AND path ILIKE '%.csv' GROUP BY 1")(flagship)


@query("breakdown_totals", "SELECT COUNT(*) AS n_files, CAST(SUM(size_bytes) AS BIGINT) AS bytes FROM v_file_inventory")
def breakdown_totals(spark, sf_dir):
    return view(spark, sf_dir, "file_inventory").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"))


@query("snapshot_capture", f"SELECT workspace, server, d.dim, CASE d.dim WHEN 'total' THEN '' WHEN 'extension' THEN {_DIMS['extension']} WHEN 'top_dir' THEN split_part(ltrim(path, '/'), '/', 1) ELSE status END AS key, COUNT(*) AS n_files, CAST(COALESCE(SUM(size_bytes), 0) AS BIGINT) AS bytes FROM v_file_inventory, (SELECT UNNEST(['total', 'extension', 'top_dir', 'status']) AS dim) d GROUP BY 1, 2, 3, 4")
def snapshot_capture(spark, sf_dir):
    return inventory.snapshot(view(spark, sf_dir, "file_inventory"))


@query("growth_latest_per_bucket", "SELECT bucket, key, value FROM (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS bucket, key, value, row_number() OVER (PARTITION BY CAST(floor(epoch(ts) / 86400) AS BIGINT), key ORDER BY ts DESC, event_id DESC) AS r FROM v_metrics) WHERE r = 1")
def growth_latest_per_bucket(spark, sf_dir):
    rows = view(spark, sf_dir, "metrics").withColumn("bucket", bucket_start(F.col("ts"), 86400))
    return inventory.latest_per(rows, ["bucket", "key"], [F.desc("ts"), F.desc("event_id")]).select("bucket", "key", "value")


_RECONCILED = "(SELECT o.*, l.legacy_key, l.legacy_size, CASE WHEN l.legacy_key IS NULL THEN 'orphan_disk' WHEN l.legacy_size = o.size_bytes THEN 'verified' ELSE 'mismatch' END AS verdict FROM v_file_inventory o LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY server, path ORDER BY legacy_key) AS r FROM v_legacy_index) WHERE r = 1) l ON o.server = l.server AND o.path = l.path)"


@query("reconcile_classify", f"SELECT doc_id, verdict FROM {_RECONCILED}")
def reconcile_classify(spark, sf_dir):
    return inventory.reconcile(view(spark, sf_dir, "file_inventory"), view(spark, sf_dir, "legacy_index")).select("doc_id", "verdict")


@query("reconcile_counts", f"SELECT server, verdict, COUNT(*) AS n FROM {_RECONCILED} GROUP BY 1, 2")
def reconcile_counts(spark, sf_dir):
    return inventory.reconcile(view(spark, sf_dir, "file_inventory"), view(spark, sf_dir, "legacy_index")).groupBy("server", "verdict").agg(F.count("*").alias("n"))


@query("orphan_db", "SELECT legacy_key FROM v_legacy_index l WHERE NOT EXISTS (SELECT 1 FROM v_file_inventory o WHERE o.server = l.server AND o.path = l.path)")
def orphan_db(spark, sf_dir):
    return view(spark, sf_dir, "legacy_index").join(view(spark, sf_dir, "file_inventory"), ["server", "path"], "left_anti").select("legacy_key")


@query("inventory_upsert", "SELECT COALESCE(n.server, o.server) AS server, COALESCE(n.path, o.path) AS path, CASE WHEN n.path IS NOT NULL THEN n.size_bytes ELSE o.legacy_size END AS size, COALESCE(n.uid, o.legacy_key) AS owner FROM v_legacy_index o FULL JOIN v_file_inventory n ON o.server = n.server AND o.path = n.path")
def inventory_upsert(spark, sf_dir):
    old = view(spark, sf_dir, "legacy_index").select("server", "path", F.col("legacy_size").alias("size"), F.col("legacy_key").alias("owner"))
    new = view(spark, sf_dir, "file_inventory").select("server", "path", F.col("size_bytes").alias("size"), F.col("uid").alias("owner"))
    return inventory.upsert(old, new, ["server", "path"], {"size": "new", "owner": "fill"})


@query("duplicate_groups", "SELECT content_hash, server, path, COUNT(*) OVER w AS n_copies, bool_or(is_canonical) OVER w AS has_canonical FROM v_file_inventory WHERE content_hash IS NOT NULL WINDOW w AS (PARTITION BY content_hash) QUALIFY COUNT(*) OVER w > 1")
def duplicate_groups(spark, sf_dir):
    return inventory.duplicate_groups(view(spark, sf_dir, "file_inventory"))


@query("mark_canonical", "SELECT doc_id, r = 1 AS now_canonical FROM (SELECT *, COUNT(*) OVER (PARTITION BY content_hash) AS n, row_number() OVER (PARTITION BY content_hash ORDER BY server, path) AS r FROM v_file_inventory) WHERE n > 1 AND (r = 1) <> is_canonical")
def mark_canonical(spark, sf_dir):
    return inventory.canonical_changes(view(spark, sf_dir, "file_inventory")).select("doc_id", "now_canonical")


@query("uncatalogued", "SELECT doc_id FROM v_file_inventory o WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = o.doc_id)")
def uncatalogued(spark, sf_dir):
    return view(spark, sf_dir, "file_inventory").join(stored(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("retire_eligible", "SELECT doc_id FROM v_file_inventory o WHERE server = 'src2' AND EXISTS (SELECT 1 FROM v_file_inventory c WHERE c.content_hash = o.content_hash AND c.server <> 'src2' AND c.status = 'verified')")
def retire_eligible(spark, sf_dir):
    return inventory.retire_eligible(view(spark, sf_dir, "file_inventory"), "src2").select("doc_id")


@query("dedup_import", "SELECT content_hash, arg_min(path, (age_days IS NULL, COALESCE(age_days, 0), path)) AS path, MAX(size_bytes) AS size_bytes, MIN(first_seen) AS first_seen, COUNT(*) AS n FROM v_file_inventory GROUP BY 1")
def dedup_import(spark, sf_dir):
    return inventory.import_duplicates(view(spark, sf_dir, "file_inventory"))


@query("status_flags", "SELECT o.doc_id, EXISTS (SELECT 1 FROM v_file_inventory c WHERE c.content_hash = o.content_hash AND c.server <> o.server) AS elsewhere FROM v_file_inventory o")
def status_flags(spark, sf_dir):
    files = view(spark, sf_dir, "file_inventory")
    held = files.groupBy("content_hash").agg(F.count_distinct("server").alias("servers"))
    return files.join(held, "content_hash").select("doc_id", (F.col("servers") > 1).alias("elsewhere"))


@query("format_detect", "SELECT format, COUNT(*) AS n FROM (SELECT CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'csv' THEN 'csv' WHEN 'txt' THEN 'txt' END AS format FROM v_file_inventory) GROUP BY 1")
def format_detect(spark, sf_dir):
    return view(spark, sf_dir, "file_inventory").groupBy(format_of(F.col("path")).alias("format")).agg(F.count("*").alias("n"))


@query("display_sizes", "SELECT entry_id, CASE WHEN size_bytes >= 1073741824 THEN printf('%.1f GB', round(size_bytes / 1073741824.0, 1)) WHEN size_bytes >= 1048576 THEN printf('%.1f MB', round(size_bytes / 1048576.0, 1)) WHEN size_bytes >= 1024 THEN printf('%.1f KB', round(size_bytes / 1024.0, 1)) ELSE printf('%d B', size_bytes) END AS shown FROM (SELECT entry_id, size_bytes * 977 AS size_bytes FROM v_catalogue)")
def display_sizes(spark, sf_dir):
    return view(spark, sf_dir, "catalogue").select("entry_id", human_bytes(F.col("size_bytes") * 977).alias("shown"))


# ---------------------------------------------------------------- rollups and series

_OUTCOME = "CASE WHEN status = 'completed' AND NOT result_ok THEN 'failure' WHEN status = 'completed' THEN 'success' WHEN status = 'failed' THEN 'failure' END"


@query("run_rollup", f"SELECT template, outcome, CAST(floor(epoch(created_at) / 3600) AS BIGINT) * 3600 AS bucket, COUNT(*) AS n_runs, CAST(COALESCE(SUM(duration_ms), 0) AS BIGINT) AS sum_ms, COUNT(duration_ms) AS n_ms FROM (SELECT *, {_OUTCOME} AS outcome FROM v_runs) WHERE outcome IS NOT NULL GROUP BY 1, 2, 3")
def run_rollup(spark, sf_dir):
    return rollup.run_rollup(view(spark, sf_dir, "runs"))


@query("run_timeseries", f"SELECT template, CAST(floor(epoch(created_at) / 604800) AS BIGINT) * 604800 AS bucket, COUNT(*) FILTER (WHERE outcome = 'success') AS n_success, COUNT(*) FILTER (WHERE outcome = 'failure') AS n_failure, round(SUM(duration_ms) / NULLIF(COUNT(duration_ms), 0), 6) AS mean_ms FROM (SELECT *, {_OUTCOME} AS outcome FROM v_runs) WHERE outcome IS NOT NULL GROUP BY 1, 2")
def run_timeseries(spark, sf_dir):
    return rollup.run_series(rollup.run_rollup(view(spark, sf_dir, "runs")), 604800).withColumn("mean_ms", F.round("mean_ms", 6))


@query("user_rollup", "SELECT template, user_id, COUNT(*) AS n, CAST(MIN(epoch(created_at)) AS BIGINT) AS first_run, CAST(MAX(epoch(created_at)) AS BIGINT) AS last_run FROM v_runs GROUP BY 1, 2")
def user_rollup(spark, sf_dir):
    return rollup.rollup_users(view(spark, sf_dir, "runs"))


_NODES = "(SELECT node, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'failed') AS n_failed, CAST(COALESCE(SUM(ms), 0) AS BIGINT) AS sum_ms, COUNT(ms) AS n_ms FROM v_steps WHERE status IN ('completed', 'failed') GROUP BY 1)"


@query("node_rollup", f"SELECT * FROM {_NODES}")
def node_rollup(spark, sf_dir):
    return rollup.node_rollup(view(spark, sf_dir, "steps"))


@query("node_hotspots", f"SELECT node, kind, n_failed FROM (SELECT node, n_failed, 'slow' AS kind FROM {_NODES} ORDER BY sum_ms / n_ms DESC, node LIMIT 5) UNION ALL SELECT node, kind, n_failed FROM (SELECT node, n_failed, 'failing' AS kind FROM {_NODES} WHERE n_failed > 0 ORDER BY n_failed DESC, node LIMIT 5)")
def node_hotspots(spark, sf_dir):
    return rollup.hotspots(rollup.node_rollup(view(spark, sf_dir, "steps"))).select("node", "kind", "n_failed")


@query("duration_percentiles", "SELECT template, COUNT(duration_ms) AS n, round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.95), 4) AS p95 FROM v_runs WHERE status IN ('completed', 'failed') GROUP BY 1")
def duration_percentiles(spark, sf_dir):
    runs = view(spark, sf_dir, "runs").where(F.col("status").isin("completed", "failed"))
    return rollup.percentiles(runs, "duration_ms", ["template"]).withColumns({c: F.round(c, 4) for c in ("p50", "p95")})


@query("distinct_users", "SELECT template, COUNT(DISTINCT user_id) AS users FROM v_runs GROUP BY 1")
def distinct_users(spark, sf_dir):
    return view(spark, sf_dir, "runs").groupBy("template").agg(F.count_distinct("user_id").alias("users"))


@query("process_stats", "SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'running') AS active, COUNT(*) FILTER (WHERE status = 'completed') AS completed, COUNT(*) FILTER (WHERE status = 'failed') AS failed FROM v_runs")
def process_stats(spark, sf_dir):
    is_ = lambda s: F.count_if(F.col("status") == s)
    return view(spark, sf_dir, "runs").agg(F.count("*").alias("total"), is_("running").alias("active"), is_("completed").alias("completed"), is_("failed").alias("failed"))


@query("metric_summary", "SELECT key, COUNT(*) AS n, MIN(value) AS low, MAX(value) AS high, round(AVG(value), 6) AS mean, arg_max(value, (ts, event_id)) AS last FROM v_metrics GROUP BY 1")
def metric_summary(spark, sf_dir):
    return rollup.metric_summary(view(spark, sf_dir, "metrics")).withColumn("mean", F.round("mean", 6))


@query("metric_series_bucketed", "SELECT key, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS bucket, round(AVG(value), 6) AS mean, COUNT(*) AS n FROM v_metrics WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2")
def metric_series_bucketed(spark, sf_dir):
    return rollup.metric_series(view(spark, sf_dir, "metrics"), 21600, "2024-01-05", "2024-01-20").withColumn("mean", F.round("mean", 6))


@query("inference_timeseries", "SELECT model, CAST(floor(epoch(started_at) / 86400) AS BIGINT) * 86400 AS bucket, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'completed') AS n_completed, COUNT(*) FILTER (WHERE status = 'upstream_error') AS n_errors, CAST(SUM(prompt_tokens + completion_tokens) AS BIGINT) AS n_tokens, round(quantile_cont(seconds, 0.5) FILTER (WHERE status = 'completed'), 8) AS p50, round(quantile_cont(seconds, 0.95) FILTER (WHERE status = 'completed'), 8) AS p95 FROM v_requests GROUP BY 1, 2")
def inference_timeseries(spark, sf_dir):
    return rollup.request_series(view(spark, sf_dir, "requests"), 86400).withColumns({c: F.round(c, 8) for c in ("p50", "p95")})


@query("status_counters", "SELECT model, COUNT(*) FILTER (WHERE status = 'completed') AS completed, COUNT(*) FILTER (WHERE status = 'unmetered') AS unmetered, COUNT(*) FILTER (WHERE status = 'cancelled') AS cancelled, COUNT(*) FILTER (WHERE status = 'upstream_error') AS upstream_error, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(SUM(completion_tokens) AS BIGINT) AS completion_tokens FROM v_requests GROUP BY 1")
def status_counters(spark, sf_dir):
    return rollup.status_counters(view(spark, sf_dir, "requests"))


@query("latency_histogram", f"SELECT model, le, COUNT(*) FILTER (WHERE seconds <= le) AS cumulative, COUNT(*) AS n FROM v_requests, (SELECT UNNEST([{', '.join(f'{b}::DOUBLE' for b in LATENCY_BOUNDS)}]) AS le) GROUP BY 1, 2")
def latency_histogram(spark, sf_dir):
    return rollup.latency_histogram(view(spark, sf_dir, "requests")).select("model", "le", "cumulative", "n")


@query("log_tail", "SELECT conv_id, turn, role FROM v_messages WHERE role = 'user' AND text ILIKE '%the%' ORDER BY conv_id DESC, turn DESC LIMIT 50")
def log_tail(spark, sf_dir):
    rows = view(spark, sf_dir, "messages").where((F.col("role") == "user") & F.col("text").ilike("%the%"))
    return rows.orderBy(F.desc("conv_id"), F.desc("turn")).limit(50).select("conv_id", "turn", "role")


@query("log_minimum_level", "SELECT role, COUNT(*) AS n FROM v_messages WHERE CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END >= 1 GROUP BY 1")
def log_minimum_level(spark, sf_dir):
    level = F.create_map(F.lit("system"), F.lit(0), F.lit("user"), F.lit(1), F.lit("assistant"), F.lit(2))
    return view(spark, sf_dir, "messages").where(F.coalesce(F.try_element_at(level, "role"), F.lit(2)) >= 1).groupBy("role").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- provenance


def _links(spark, sf_dir) -> DataFrame:
    turns = view(spark, sf_dir, "messages").select("conv_id", "turn")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"))
    node = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.join(before, ["conv_id", "turn"]).select(node.alias("node"), F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("cause"))


_LINKS = "links AS (SELECT CAST(a.conv_id AS STRING) || ':' || CAST(a.turn AS STRING) AS node, CAST(a.conv_id AS STRING) || ':' || CAST(a.turn - 1 AS STRING) AS cause FROM v_messages a JOIN v_messages b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"
_BACK = f"WITH RECURSIVE {_LINKS}, back(root, node, depth) AS (SELECT node, node, 0 FROM links UNION ALL SELECT b.root, l.cause, b.depth + 1 FROM back b JOIN links l ON b.node = l.node)"


@query("provenance_ancestry", f"{_BACK} SELECT root, node, MIN(depth) AS depth FROM back GROUP BY 1, 2")
def provenance_ancestry(spark, sf_dir):
    links = _links(spark, sf_dir)
    roots = links.select(F.col("node").alias("root"), "node")
    return provenance.reached(links, roots)


@query("provenance_edges", f"{_BACK} SELECT DISTINCT x.root, l.node, l.cause FROM back x JOIN links l ON x.node = l.node JOIN back y ON y.root = x.root AND y.node = l.cause")
def provenance_edges(spark, sf_dir):
    links = _links(spark, sf_dir)
    roots = links.select(F.col("node").alias("root"), "node")
    return provenance.edges_within(links, provenance.reached(links, roots))


@query("tag_propagation", f"WITH RECURSIVE {_LINKS}, fwd(node, tag, depth) AS (SELECT CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING), CAST(conv_id AS STRING), 0 FROM v_messages WHERE role = 'system' UNION SELECT l.node, f.tag, f.depth + 1 FROM fwd f JOIN links l ON l.cause = f.node WHERE f.depth < 3) SELECT DISTINCT node, tag FROM fwd")
def tag_propagation(spark, sf_dir):
    links = _links(spark, sf_dir)
    tags = view(spark, sf_dir, "messages").where("role = 'system'").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node"), F.col("conv_id").cast("string").alias("tag"))
    return provenance.propagate_tags(links, tags, 3)


@query("lineage_members", "SELECT DISTINCT doc_id FROM (SELECT doc_id FROM v_file_inventory WHERE status = 'verified' AND server = 'src1' UNION ALL SELECT doc_id FROM labels WHERE toxic = 1)")
def lineage_members(spark, sf_dir):
    files = view(spark, sf_dir, "file_inventory").where("status = 'verified' and server = 'src1'")
    return inventory.any_of(files, stored(spark, sf_dir, "labels").where("toxic = 1"), on="doc_id")


@query("lineage_steps", "SELECT step, CASE WHEN step LIKE 's-%' THEN CAST(substr(step, 3) AS INT) END AS iteration, COUNT(*) AS n, MIN(entry_id) AS first_seen FROM (SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN 's-' || CAST(entry_id % 4 AS STRING) WHEN entry_id % 3 = 1 THEN mime ELSE 'unknown' END AS step FROM v_catalogue) GROUP BY 1, 2")
def lineage_steps(spark, sf_dir):
    rows = view(spark, sf_dir, "catalogue").selectExpr("entry_id", "case when entry_id % 3 = 0 then concat('s-', entry_id % 4) end as process_step", "case when entry_id % 3 = 1 then concat('net/', mime) end as job")
    return provenance.lineage_steps(rows)


# ---------------------------------------------------------------- dataflow


def _place(spark, sf_dir, name: str) -> DataFrame:
    return view(spark, sf_dir, "tokens").where(F.col("place") == name)


@query("join_correlated_fifo", "SELECT a.k, a.seq, b.seq AS other_seq FROM (SELECT k, seq, row_number() OVER (PARTITION BY k ORDER BY seq) AS r FROM v_tokens WHERE place = 'view') a JOIN (SELECT k, seq, row_number() OVER (PARTITION BY k ORDER BY seq) AS r FROM v_tokens WHERE place = 'click') b ON a.k = b.k AND a.r = b.r")
def join_correlated_fifo(spark, sf_dir):
    left, right = (_place(spark, sf_dir, p).select("k", "seq") for p in ("view", "click"))
    return dataflow.fifo_join(left, right, "k")


@query("join_theta_first", "SELECT a.seq AS l_seq, MIN(b.seq) AS r_seq FROM v_tokens a JOIN v_tokens b ON a.k = b.k AND b.value > a.value WHERE a.place = 'signup' AND b.place = 'purchase' GROUP BY 1")
def join_theta_first(spark, sf_dir):
    left = _place(spark, sf_dir, "signup").select(F.col("seq").alias("l_seq"), "k", "value")
    right = _place(spark, sf_dir, "purchase").select(F.col("seq").alias("r_seq"), "k", "value")
    return dataflow.first_above(left, right, "k", "value", "l_seq", "r_seq")


@query("latest_read_join", "SELECT seq, (SELECT arg_max(value, seq) FROM v_tokens WHERE place = 'signup') AS latest FROM v_tokens WHERE place = 'error'")
def latest_read_join(spark, sf_dir):
    return dataflow.latest_read(_place(spark, sf_dir, "error"), _place(spark, sf_dir, "signup"), "value").select("seq", "latest")


@query("and_join", "SELECT a.k, a.n AS n_view, b.n AS n_click FROM (SELECT k, COUNT(*) AS n FROM v_tokens WHERE place = 'view' GROUP BY 1) a JOIN (SELECT k, COUNT(*) AS n FROM v_tokens WHERE place = 'click' GROUP BY 1) b ON a.k = b.k")
def and_join(spark, sf_dir):
    return dataflow.and_join([_place(spark, sf_dir, p).groupBy("k").agg(F.count("*").alias(f"n_{p}")) for p in ("view", "click")], "k")


@query("xor_join", "SELECT seq, k FROM v_tokens WHERE place IN ('view', 'error')")
def xor_join(spark, sf_dir):
    return dataflow.xor_join([_place(spark, sf_dir, p).select("seq", "k") for p in ("view", "error")])


@query("timer_race", "SELECT a.seq, CASE WHEN b.t IS NOT NULL AND b.t < epoch(a.ts) + 3600 * 24 THEN 'body' ELSE 'timeout' END AS winner FROM v_tokens a LEFT JOIN (SELECT k, MIN(epoch(ts)) AS t FROM v_tokens WHERE place = 'purchase' GROUP BY 1) b ON a.k = b.k WHERE a.place = 'signup'")
def timer_race(spark, sf_dir):
    scheduled = _place(spark, sf_dir, "signup").select("seq", "k", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts").alias("at"), F.lit(86400 * 1000000).alias("limit"))
    done = _place(spark, sf_dir, "purchase").select("k", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts").alias("done_at"))
    return dataflow.timer_race(scheduled, done, "k").select("seq", "winner")


@query("gather_barrier", "SELECT k, COUNT(*) AS n, array_to_string(list(CAST(idx AS STRING) ORDER BY idx, v), ',') AS vals FROM (SELECT k, seq % 1000 AS idx, seq AS v, k % 7 * 4 AS expected, row_number() OVER (PARTITION BY k ORDER BY seq) AS r FROM v_tokens WHERE place = 'view') WHERE r <= expected GROUP BY k, expected HAVING COUNT(*) = expected")
def gather_barrier(spark, sf_dir):
    results = _place(spark, sf_dir, "view").select("k", "seq", (F.col("seq") % 1000).alias("idx"), F.col("seq").alias("v"))
    needed = results.select("k").distinct().withColumn("expected", F.col("k") % 7 * 4)
    return dataflow.gather(results, needed, "k", "idx", "v", "seq").select("k", "n", F.array_join(F.transform("vals", lambda v: (v % 1000).cast("string")), ",").alias("vals"))


@query("drain_batches", "SELECT k, CAST(floor((r - 1) / 8) AS BIGINT) AS batch, COUNT(*) AS n, array_to_string(list_sort(list(seq)), ',') AS seqs FROM (SELECT k, seq, row_number() OVER (PARTITION BY k ORDER BY seq) AS r FROM v_tokens WHERE place = 'click') GROUP BY 1, 2")
def drain_batches(spark, sf_dir):
    return dataflow.drain(_place(spark, sf_dir, "click"), "k", 8).withColumn("seqs", F.array_join(F.col("seqs").cast("array<string>"), ","))


@query("scatter", "SELECT seq, i AS idx, seq + i AS item FROM (SELECT seq, UNNEST(range(0, k % 4)) AS i FROM v_tokens WHERE place = 'signup')")
def scatter(spark, sf_dir):
    tokens = _place(spark, sf_dir, "signup").withColumn("items", F.expr("transform(filter(sequence(0, 3), i -> i < k % 4), i -> seq + i)"))
    return dataflow.scatter(tokens.select("seq", "items"), "items").withColumn("idx", F.col("idx").cast("long"))


@query("map_reduce", "SELECT seq, CAST(COALESCE(list_sum(list_transform(range(0, k % 5), lambda i: i * i)), 0) AS BIGINT) AS result FROM v_tokens WHERE place = 'signup'")
def map_reduce(spark, sf_dir):
    tokens = _place(spark, sf_dir, "signup").select("seq", F.expr("filter(sequence(0L, 4L), i -> i < k % 5)").alias("items"))
    return dataflow.map_reduce(tokens, "items", lambda i: i * i, F.lit(0).cast("long"), lambda a, b: a + b).select("seq", "result")


@query("loop_fold", "SELECT seq, LEAST(k, 6) AS n, CAST(LEAST(k, 6) * (LEAST(k, 6) + 1) / 2 AS BIGINT) AS acc FROM v_tokens WHERE place = 'error'")
def loop_fold(spark, sf_dir):
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("acc"), F.col("k").alias("k"))
    out = dataflow.loop(_place(spark, sf_dir, "error"), start, "if(s.n < s.k, named_struct('n', s.n + 1, 'acc', s.acc + s.n + 1, 'k', s.k), s)", 5)
    return out.select("seq", F.col("_s.n").alias("n"), F.col("_s.acc").alias("acc"))


@query("decision_route", "SELECT branch, COUNT(*) AS n FROM (SELECT CASE WHEN value > 90 THEN 'high' WHEN k % 2 = 0 THEN 'even' ELSE 'rest' END AS branch FROM v_tokens) GROUP BY 1")
def decision_route(spark, sf_dir):
    routed = dataflow.decide(view(spark, sf_dir, "tokens"), [("high", F.col("value") > 90), ("even", F.col("k") % 2 == 0)], "rest")
    return routed.groupBy("branch").agg(F.count("*").alias("n"))


@query("enabled_transitions", "SELECT transition FROM (SELECT 't' || CAST(w AS STRING) AS transition, bool_and(n >= w) AS ok FROM (SELECT place, COUNT(*) AS n FROM v_tokens GROUP BY 1), (SELECT UNNEST([1, 200, 1000000]) AS w) GROUP BY 1) WHERE ok")
def enabled_transitions(spark, sf_dir):
    tokens = view(spark, sf_dir, "tokens")
    needs = tokens.select("place").distinct().select("place", F.explode(F.array(F.lit(1), F.lit(200), F.lit(1000000))).alias("weight")).withColumn("transition", F.concat(F.lit("t"), F.col("weight").cast("string")))
    return dataflow.enabled(tokens, needs)


# ---------------------------------------------------------------- event folds


@query("marking_projection", "SELECT place, COUNT(*) AS n FROM v_tokens t WHERE NOT EXISTS (SELECT 1 FROM v_tokens c WHERE c.place = 'click' AND c.k * 7 = t.seq) GROUP BY 1")
def marking_projection(spark, sf_dir):
    tokens = view(spark, sf_dir, "tokens").withColumn("token_id", F.col("seq"))
    used = tokens.where("place = 'click'").select((F.col("k") * 7).alias("token_id"))
    return projections.marking(tokens, used).groupBy("place").agg(F.count("*").alias("n"))


@query("guarded_upsert", "SELECT process_id, key, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY process_id, key ORDER BY event_id DESC) AS r FROM v_metrics) WHERE r = 1")
def guarded_upsert(spark, sf_dir):
    rows = view(spark, sf_dir, "metrics").select("process_id", "key", "event_id", "value")
    return projections.guarded_upsert(rows.union(rows.where("event_id % 3 = 0")), ["process_id", "key"], "event_id")


STEP_EVENTS = """process_id as run_id, case when event_id % 97 = 0 then null else concat('n', event_id % 3) end as node, event_id as sequence, event_id % 7 as token, ts,
    case when event_id % 97 = 0 then case when event_id % 2 = 0 then 'run_failed' else 'run_end' end when key = 'error' then 'fail' when key = 'purchase' then 'output' when key = 'view' then 'enter' when key = 'click' then 'fire' else 'other' end as kind"""


STEP_SQL = f"""WITH ev AS (SELECT {STEP_EVENTS} FROM v_metrics),
    k AS (SELECT * FROM ev WHERE node IS NOT NULL AND kind <> 'other' QUALIFY kind <> 'enter' OR row_number() OVER (PARTITION BY run_id, node, kind, token ORDER BY sequence) = 1),
    c AS (SELECT *, COUNT(*) FILTER (WHERE kind = 'enter') OVER w AS entered, first_value(kind) OVER w AS f FROM k WINDOW w AS (PARTITION BY run_id, node ORDER BY sequence ROWS UNBOUNDED PRECEDING)),
    st AS (SELECT run_id, node, CAST(CASE WHEN entered = 0 THEN 0 ELSE entered - 1 + CASE WHEN f IN ('fire', 'output') THEN 1 ELSE 0 END END AS BIGINT) AS iteration, arg_min(ts, sequence) AS started_at,
        COALESCE(arg_max(ts, sequence) FILTER (WHERE kind = 'fail'), arg_max(ts, sequence) FILTER (WHERE kind = 'output')) AS done_at, COALESCE(MAX(sequence) FILTER (WHERE kind <> 'enter'), 0) AS last_sequence,
        CASE WHEN bool_or(kind = 'fail') THEN 'failed' WHEN bool_or(kind = 'output') THEN 'completed' WHEN bool_or(kind = 'fire') THEN 'running' ELSE 'pending' END AS s FROM c GROUP BY 1, 2, 3),
    e AS (SELECT run_id, CASE WHEN arg_min(kind, sequence) = 'run_failed' THEN 'failed' ELSE 'skipped' END AS end_state, arg_min(ts, sequence) AS end_at FROM ev WHERE node IS NULL GROUP BY 1),
    n AS (SELECT DISTINCT run_id, 'n' || CAST(i AS STRING) AS node FROM e, range(5) t(i))
    SELECT run_id, node, iteration, CASE WHEN s IN ('pending', 'running') THEN COALESCE(end_state, s) ELSE s END AS state, started_at, CASE WHEN s IN ('pending', 'running') THEN end_at ELSE done_at END AS completed_at, last_sequence FROM st LEFT JOIN e USING (run_id)"""


@query("step_execution_fold", STEP_SQL + """ UNION ALL SELECT run_id, node, 0, 'skipped', NULL, NULL, 0 FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.run_id = n.run_id AND k.node = n.node)""")
def step_execution_fold(spark, sf_dir):
    """Runs of five nodes of which events reach three."""
    events = view(spark, sf_dir, "metrics").selectExpr(*columns(STEP_EVENTS))
    nodes = events.select("run_id").distinct().select("run_id", F.explode(F.array(*(F.lit(f"n{k}") for k in range(5)))).alias("node"))
    return projections.step_executions(events).unionByName(projections.unreached(events, nodes))


_GRANT_EVENTS = """case when key = 'purchase' and event_id % 2 = 0 then null else concat('g', process_id) end as grant_id, case when key in ('view', 'purchase') then event_id % 40 end as alloc_id, event_id as sequence,
    case key when 'view' then 'acquire' when 'purchase' then 'release' else 'account' end as kind, case when key = 'error' and event_id % 3 = 0 then 'failed' when key = 'signup' and event_id % 5 = 0 then 'timed_out' when key = 'click' and event_id % 11 = 0 then 'completed' else 'running' end as job_status,
    case when event_id % 4 > 0 then event_id % 10 end as cpu_seconds, ts"""


@query("allocation_fold", f"""WITH ev AS (SELECT {_GRANT_EVENTS} FROM v_metrics),
    held AS (SELECT grant_id, alloc_id, sequence AS a, lead(sequence) OVER (PARTITION BY grant_id ORDER BY sequence) AS b FROM ev WHERE kind = 'acquire'),
    k AS (SELECT * FROM ev WHERE grant_id IS NOT NULL UNION ALL SELECT MIN(h.grant_id), any_value(r.alloc_id), r.sequence, 'release', any_value(r.job_status), any_value(r.cpu_seconds), any_value(r.ts) FROM ev r JOIN held h ON r.alloc_id = h.alloc_id AND r.sequence > h.a AND (h.b IS NULL OR r.sequence < h.b) WHERE r.grant_id IS NULL GROUP BY r.sequence),
    o AS (SELECT *, CASE WHEN kind = 'account' THEN CASE job_status WHEN 'failed' THEN 'failed' WHEN 'timed_out' THEN 'expired' WHEN 'completed' THEN 'released' END END AS fin, MIN(sequence) FILTER (WHERE kind <> 'account') OVER (PARTITION BY grant_id) AS opened FROM k)
    SELECT grant_id, COALESCE(arg_max(fin, sequence) FILTER (WHERE fin IS NOT NULL), CASE WHEN bool_or(kind = 'release') THEN 'released' END, 'held') AS state, arg_max(alloc_id, sequence) FILTER (WHERE kind = 'acquire') AS alloc_id, arg_min(ts, sequence) FILTER (WHERE kind = 'acquire') AS acquired_at,
    COALESCE(arg_max(ts, sequence) FILTER (WHERE kind = 'release'), arg_min(ts, sequence) FILTER (WHERE fin IS NOT NULL)) AS released_at, arg_max(cpu_seconds, sequence) FILTER (WHERE kind = 'account' AND cpu_seconds IS NOT NULL) AS cpu_seconds, arg_max(job_status, sequence) FILTER (WHERE fin = 'failed') AS last_error, MAX(sequence) AS last_sequence
    FROM o WHERE kind <> 'account' OR sequence > opened GROUP BY 1""")
def allocation_fold(spark, sf_dir):
    """Grants by process; every other release knows only the allocation."""
    events = view(spark, sf_dir, "metrics").selectExpr(*columns(_GRANT_EVENTS)).withColumnRenamed("grant_id", "grant")
    return projections.allocations(events).withColumnRenamed("grant", "grant_id")


@query("hash_chain_check", """WITH log AS (SELECT event_id, event_id // 8 AS net, event_id % 8 AS seq, event_id % 97 = 5 OR event_id % 101 = 3 AS bad_hash, event_id % 89 = 7 AS bad_link FROM v_metrics WHERE event_id % 83 <> 11),
    seen AS (SELECT *, lag(seq) OVER o AS before, lag(bad_hash) OVER o AS bad_hash_before FROM log WINDOW o AS (PARTITION BY net ORDER BY seq))
    SELECT event_id FROM seen WHERE bad_hash OR bad_link OR before <> seq - 1 OR bad_hash_before""")
def hash_chain_check(spark, sf_dir):
    """Chains of eight events with wrong and missing hashes, wrong links and gaps."""
    rows = view(spark, sf_dir, "metrics").selectExpr("event_id", "event_id div 8 as net", "event_id % 8 as sequence", "key as body")
    events = F.array_sort(F.collect_list(F.struct("sequence", "event_id", "body")))
    # Each event's hash covers that of the event before it.
    chained = """aggregate(events, cast(array() as array<struct<event_id: bigint, sequence: bigint, body: string, previous_hash: string, hash: string>>), (a, e) ->
        concat(a, array(named_struct('event_id', e.event_id, 'sequence', e.sequence, 'body', e.body, 'previous_hash', if(size(a) = 0, null, element_at(a, -1).hash),
        'hash', sha2(concat_ws('|', cast(net as string), cast(e.sequence as string), e.body, if(size(a) = 0, '', element_at(a, -1).hash)), 256)))))"""
    log = rows.groupBy("net").agg(events.alias("events")).select("net", F.explode(F.expr(chained)).alias("e")).select("net", "e.*")
    hurt = F.when(F.col("event_id") % 97 == 5, "broken").when(F.col("event_id") % 101 != 3, F.col("hash"))
    log = log.withColumns({"hash": hurt, "previous_hash": F.when(F.col("event_id") % 89 == 7, "elsewhere").otherwise(F.col("previous_hash"))})
    return projections.chain_breaks(log.where("event_id % 83 <> 11")).select("event_id")


@query("fold_batch", "SELECT CAST(process_id AS STRING) AS key, round(SUM(value), 4) AS total, COUNT(*) AS n, MAX(event_id) AS last_seq FROM v_metrics GROUP BY 1")
def fold_batch(spark, sf_dir):
    events = view(spark, sf_dir, "metrics").selectExpr("cast(process_id as string) as key", "event_id as seq", "value")
    return folds.fold_batch(events.union(events.where("seq % 5 = 0"))).withColumn("total", F.round("total", 4))


@query("subscription_match", "SELECT entry_id, 'big' AS subscription FROM v_catalogue WHERE size_bytes >= 5120 UNION ALL SELECT entry_id, 'english' FROM v_catalogue WHERE mime = 'en'")
def subscription_match(spark, sf_dir):
    rows = view(spark, sf_dir, "catalogue")
    saved = {"big": "size_bytes>=5k", "english": "mime:en"}
    return folds.subscriptions(rows, {k: (lambda df, t=t: dsl.compile_query(dsl.parse(t), df.schema, datetime.fromisoformat(NOW))) for k, t in saved.items()})


# ---------------------------------------------------------------- profiling


def _text_cells(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "metrics").selectExpr("cast(event_id as string) as a", "cast(round(value) as string) as b", "if(event_id % 2 = 0, 'true', 'false') as c", "if(event_id % 10 = 0, '', key) as d", "concat('u', event_id % 50, '@x.org') as e")


@query("column_stats", "SELECT 'value' AS \"column\", COUNT(*) AS n_rows, 0::BIGINT AS n_null, COUNT(DISTINCT k) AS n_distinct, MIN(k)::DOUBLE AS low, MAX(k)::DOUBLE AS high, round(AVG(k), 6) AS mean FROM (SELECT k FROM v_tokens) UNION ALL SELECT 'place', COUNT(*), COUNT(*) FILTER (WHERE place = 'view'), COUNT(DISTINCT place) FILTER (WHERE place <> 'view'), NULL, NULL, NULL FROM v_tokens")
def column_stats(spark, sf_dir):
    rows = view(spark, sf_dir, "tokens").selectExpr("k as value", "if(place = 'view', '', place) as place")
    return profiling.column_statistics(rows).withColumn("mean", F.round("mean", 6))


@query("quality_report", "SELECT 'place' AS \"column\", round(1 - a.e / a.n, 6) AS completeness, round(LEAST(1.0, a.d / (a.n - a.e)), 6) AS distinctness FROM (SELECT COUNT(*)::DOUBLE AS n, (COUNT(*) FILTER (WHERE place = 'view'))::DOUBLE AS e, (COUNT(DISTINCT place) FILTER (WHERE place <> 'view'))::DOUBLE AS d FROM v_tokens) a")
def quality_report(spark, sf_dir):
    rows = view(spark, sf_dir, "tokens").selectExpr("if(place = 'view', '', place) as place")
    return profiling.column_quality(profiling.column_statistics(rows)).select("column", *(F.round(c, 6).alias(c) for c in ("completeness", "distinctness")))


@query("topk_values", "SELECT key AS value, COUNT(*) AS n FROM v_metrics GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def topk_values(spark, sf_dir):
    return profiling.top_values(view(spark, sf_dir, "metrics"), "key", 3)


@query("infer_csv_types", "SELECT UNNEST(['a', 'b', 'c', 'd', 'e']) AS \"column\", UNNEST(['int64', 'float64', 'bool', 'string', 'string']) AS type, UNNEST([false, false, false, true, false]) AS nullable")
def infer_csv_types(spark, sf_dir):
    return profiling.infer_types(_text_cells(spark, sf_dir))


@query("pattern_classify", "SELECT 'e' AS \"column\", 'email' AS category, COUNT(*) AS n FROM v_metrics")
def pattern_classify(spark, sf_dir):
    return profiling.classify_patterns(_text_cells(spark, sf_dir).select("d", "e"), 0.95).select("column", "category", "n")


@query("semantic_classify", """WITH s AS (SELECT MIN(k) AS low, MAX(k) AS high FROM v_tokens)
    SELECT 'age' AS "column", category, confidence FROM s, (VALUES ('age', 0.9::DOUBLE, 0, 150), ('unix_timestamp', 0.6::DOUBLE, 0, 8589934592)) r(category, confidence, least, most) WHERE low >= least AND high <= most
    UNION ALL SELECT 'rate', category, confidence FROM (VALUES ('percentage', 0.9::DOUBLE, 0, 100), ('latitude', 0.6::DOUBLE, -90, 90), ('longitude', 0.6::DOUBLE, -180, 180)) r(category, confidence, least, most) WHERE 99.5 BETWEEN least AND most""")
def semantic_classify(spark, sf_dir):
    rows = view(spark, sf_dir, "tokens").selectExpr("k as age", "99.5D as rate")
    found = profiling.classify_semantic(profiling.column_statistics(rows), {"age": "int", "rate": "float"})
    return found.select("column", "category", F.col("confidence").cast("double").alias("confidence"))


@query("schema_diff", "SELECT * FROM (VALUES ('seq', 'removed'), ('ts', 'type'), ('extra', 'added')) t(\"column\", change)")
def schema_diff(spark, sf_dir):
    old = view(spark, sf_dir, "tokens")
    new = old.drop("seq").withColumns({"ts": F.col("ts").cast("string"), "extra": F.col("k") + 1})
    return profiling.schema_diff(profiling.columns_of(old), profiling.columns_of(new)).select("column", "change")


@query("duplicate_files", "SELECT content_hash, COUNT(*) AS n, MIN(path) AS first_path FROM v_file_inventory GROUP BY 1 HAVING COUNT(*) >= 2")
def duplicate_files(spark, sf_dir):
    return view(spark, sf_dir, "file_inventory").groupBy("content_hash").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n >= 2")


@query("assertions", "SELECT COUNT(*) FILTER (WHERE regexp_matches(key, '^e')) AS e_keys, COUNT(*) FILTER (WHERE value > 50) AS high, COUNT(*) FILTER (WHERE contains(key, 'i')) AS with_i FROM v_metrics")
def assertions(spark, sf_dir):
    a = lambda c, op, x: F.count_if(profiling.assertion(F.col(c).cast("string"), op, x))
    return view(spark, sf_dir, "metrics").agg(a("key", "matches", "^e").alias("e_keys"), a("value", "gt", 50).alias("high"), a("key", "contains", "i").alias("with_i"))


# ---------------------------------------------------------------- ranking


@query("stratified_sample", "SELECT doc_id, stratum FROM (SELECT doc_id, server AS stratum, row_number() OVER (PARTITION BY server ORDER BY doc_id) AS turn FROM v_file_inventory) ORDER BY turn, stratum LIMIT 30")
def stratified_sample(spark, sf_dir):
    return ranking.stratified(view(spark, sf_dir, "file_inventory"), F.col("server"), F.col("doc_id"), 30).select("doc_id", "stratum")


def _folders(spark, sf_dir):
    files = view(spark, sf_dir, "file_inventory")
    return files.select(F.regexp_extract("path", "^(/[^/]+)", 1).alias("folder")).distinct().union(files.select(F.regexp_extract("path", "^(/[^/]+/[^/]+)", 1)).distinct())


_FOLDERS = "(SELECT DISTINCT regexp_extract(path, '^(/[^/]+)', 1) AS folder FROM v_file_inventory UNION ALL SELECT DISTINCT regexp_extract(path, '^(/[^/]+/[^/]+)', 1) FROM v_file_inventory)"


@query("ancestor_chain", f"SELECT h.home, array_to_string(list(f.folder ORDER BY length(f.folder) DESC), ';') AS folders FROM (SELECT DISTINCT path AS home FROM v_file_inventory) h JOIN {_FOLDERS} f ON h.home = f.folder OR starts_with(h.home, f.folder || '/') GROUP BY 1")
def ancestor_chain(spark, sf_dir):
    homes = view(spark, sf_dir, "file_inventory").select(F.col("path").alias("home")).distinct()
    return ranking.ancestor_folders(_folders(spark, sf_dir), homes).withColumn("folders", F.array_join("folders", ";"))


@query("grant_resolution", f"SELECT p.path, arg_max(f.folder, (f.n, f.folder)) AS role, MAX(f.n) AS depth FROM (SELECT DISTINCT path FROM v_file_inventory) p JOIN (SELECT folder, len(string_split(folder, '/')) AS n FROM {_FOLDERS}) f ON p.path = f.folder OR starts_with(p.path, f.folder || '/') GROUP BY 1")
def grant_resolution(spark, sf_dir):
    grants = _folders(spark, sf_dir).withColumns({"rank": F.size(F.split("folder", "/")), "role": F.col("folder")})
    paths = view(spark, sf_dir, "file_inventory").select("path").distinct()
    return ranking.best_grant(grants, paths).select("path", "role", F.col("rank").cast("long").alias("depth"))


@query("route_ranking", "SELECT endpoint, access_id FROM (SELECT s_nationkey AS endpoint, s_suppkey AS access_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 DESC, s_suppkey % 4, s_acctbal > 0 DESC, s_suppkey) AS r FROM (SELECT *, s_suppkey % 4 AS m FROM supplier) WHERE s_suppkey % 4 < 3) WHERE r = 1")
def route_ranking(spark, sf_dir):
    access = stored(spark, sf_dir, "supplier").selectExpr("s_nationkey as endpoint", "s_suppkey as access_id", "s_suppkey % 3 as priority", "case s_suppkey % 4 when 0 then 'local' when 1 then 'mount' else 'http' end as method", "s_acctbal > 0 as verified", "s_suppkey % 4 < 3 as routable")
    return ranking.routes(access).select("endpoint", "access_id")


@query("placement_topn", "SELECT base, host, rank FROM (SELECT s_nationkey AS base, s_suppkey AS host, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier WHERE s_acctbal >= 100) WHERE rank <= 1 + base % 3")
def placement_topn(spark, sf_dir):
    hosts = stored(spark, sf_dir, "supplier").selectExpr("s_nationkey as base", "s_suppkey as host", "s_acctbal as headroom")
    demand = stored(spark, sf_dir, "nation").selectExpr("n_nationkey as base", "1 + n_nationkey % 3 as need", "100 as least")
    return ranking.place(demand, hosts).select("base", "host", F.col("rank").cast("long").alias("rank"))


@query("least_loaded", "SELECT s_nationkey AS model, arg_max(s_suppkey, (s_suppkey % 11, -s_suppkey)) AS replica, MAX(s_suppkey % 11) AS free FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def least_loaded(spark, sf_dir):
    rows = stored(spark, sf_dir, "supplier").selectExpr("s_nationkey as model", "s_suppkey as replica", "s_suppkey % 11 as free", "s_acctbal > 0 as live", "'z' as zone")
    return ranking.least_loaded(rows)


@query("prefer_own_row", "SELECT key, owner, doc_id FROM (SELECT status AS key, server AS owner, doc_id, row_number() OVER (PARTITION BY status ORDER BY (server = 'src5') DESC, server, doc_id) AS r FROM v_file_inventory) WHERE r = 1")
def prefer_own_row(spark, sf_dir):
    files = view(spark, sf_dir, "file_inventory").selectExpr("status as key", "server as owner", "doc_id")
    first = files.groupBy("key", "owner").agg(F.min("doc_id").alias("doc_id"))
    return ranking.prefer_own(first, ["key"], "owner", "src5")


@query("family_filter", "SELECT run_id FROM v_runs WHERE template IN (SELECT template FROM v_runs WHERE run_id = (SELECT MIN(run_id) FROM v_runs))")
def family_filter(spark, sf_dir):
    runs = view(spark, sf_dir, "runs")
    root = runs.agg(F.min_by("template", "run_id").alias("template"))
    return runs.join(F.broadcast(root), "template", "left_semi").select("run_id")


@query("left_join_chain", "SELECT n.n_name, r.r_name, COUNT(s.s_suppkey) AS suppliers, round(COALESCE(SUM(s.s_acctbal), 0), 2) AS balance FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY 1, 2")
def left_join_chain(spark, sf_dir):
    n, r, s = (stored(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    held = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"), F.sum("s_acctbal").alias("balance"))
    rows = n.join(r, n.n_regionkey == r.r_regionkey, "left").join(held, "n_nationkey", "left")
    return rows.select("n_name", "r_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.round(F.coalesce("balance", F.lit(0.0)), 2).alias("balance"))
