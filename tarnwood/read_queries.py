"""Queries that read the catalogue and the inventory, and steps of flows, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwood.catalog_queries import query
from tarnwood.operators import flows, reading
from tarnwood.views import view


@query("tenant_scan", "SELECT doc_id, path, status FROM v_file_inventory WHERE workspace = 'w1' AND status <> 'observed'")
def tenant_scan(spark, sf_dir):
    rows = reading.tenant(view(spark, sf_dir, "file_inventory"), "w1")
    return rows.where("status <> 'observed'").select("doc_id", "path", "status")


@query("optional_filter", "SELECT doc_id FROM v_file_inventory WHERE (server = 'src1' OR 'src1' IS NULL) AND (NULL IS NULL OR status = NULL)")
def optional_filter(spark, sf_dir):
    return view(spark, sf_dir, "file_inventory").where(reading.given(server="src1", status=None)).select("doc_id")


@query("pluck_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k.deeper[2]') AS deeper FROM events")
def pluck_path(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", reading.pluck(F.col("props"), "$.k", "bigint").alias("k"), reading.pluck(F.col("props"), "$.k.deeper[2]").alias("deeper"))


@query("page_envelope", "SELECT entry_id, (SELECT COUNT(*) FROM v_catalogue) AS total, (SELECT COUNT(*) FROM v_catalogue) > 150 AS has_next FROM v_catalogue ORDER BY size_bytes DESC, entry_id LIMIT 50 OFFSET 100")
def page_envelope(spark, sf_dir):
    rows, total, more = reading.with_page(view(spark, sf_dir, "catalogue").select("entry_id", "size_bytes"), [F.desc("size_bytes"), F.col("entry_id")], 2, 50)
    return rows.select("entry_id", F.lit(total).cast("long").alias("total"), F.lit(more).alias("has_next"))


def _described(spark, sf_dir):
    """Catalogue rows with the metadata that a probe of the file leaves."""
    n = F.col("entry_id")
    text = lambda mod, before: F.concat(F.lit(before), (n % mod).cast("string"))
    classes = F.array(F.struct(F.array(F.struct(F.lit("email").alias("category")), F.struct(text(2, "c").alias("category"))).alias("classifications")), F.struct(F.array(F.struct(F.lit("email").alias("category"))).alias("classifications")))
    rest = F.to_json(F.struct(F.struct(text(7, "d").alias("digest")).alias("schema_fingerprint"), F.array(F.lit("a"), text(3, "b")).alias("column_names"), classes.alias("columns")))
    form = F.when(n % 3 == 0, '{"format":{"unknown":"fasta"},').when(n % 3 == 1, '{"format":"csv",').otherwise('{"format":null,')
    rows = view(spark, sf_dir, "catalogue").withColumns({"mime_type": F.col("mime"), "source_net": F.when(n % 3 != 0, text(5, "n")), "process_step": F.when(n % 4 == 0, F.lit("fit"))})
    return rows.withColumn("meta", F.when(n % 10 != 9, F.concat(form, F.substr(rest, F.lit(2)))))


_FACETS = """WITH rows AS (SELECT *, entry_id % 10 <> 9 AS probed FROM v_catalogue), pairs AS (
    SELECT 'format' AS dim, CASE WHEN probed AND entry_id % 3 = 0 THEN 'fasta' WHEN probed AND entry_id % 3 = 1 THEN 'csv' ELSE 'unknown' END AS key, size_bytes FROM rows
    UNION ALL SELECT 'category', COALESCE(category, 'uncategorized'), size_bytes FROM rows UNION ALL SELECT 'mime_type', COALESCE(mime, 'unknown'), size_bytes FROM rows
    UNION ALL SELECT 'source_net', CASE WHEN entry_id % 3 <> 0 THEN 'n' || CAST(entry_id % 5 AS STRING) ELSE 'none' END, size_bytes FROM rows
    UNION ALL SELECT 'process_step', CASE WHEN entry_id % 4 = 0 THEN 'fit' ELSE 'none' END, size_bytes FROM rows
    UNION ALL SELECT 'schema', CASE WHEN probed THEN 'd' || CAST(entry_id % 7 AS STRING) ELSE 'none' END, size_bytes FROM rows
    UNION ALL SELECT 'column', unnest(['a', 'b' || CAST(entry_id % 3 AS STRING)]), size_bytes FROM rows WHERE probed
    UNION ALL SELECT 'classification', unnest(['email', 'c' || CAST(entry_id % 2 AS STRING)]), size_bytes FROM rows WHERE probed),
    sums AS (SELECT dim, key, COUNT(*) AS n, CAST(SUM(size_bytes) AS BIGINT) AS bytes FROM pairs GROUP BY 1, 2)"""


@query("facet_dimensions", f"{_FACETS} SELECT * FROM sums")
def facet_dimensions(spark, sf_dir):
    return reading.all_facets(_described(spark, sf_dir), "meta")


@query("facet_largest", f"{_FACETS} SELECT dim, key, n, bytes FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, key) AS r FROM sums) WHERE r <= 3")
def facet_largest(spark, sf_dir):
    return reading.all_facets(_described(spark, sf_dir), "meta", most=3)


_LINEAGE = """WITH sent AS (SELECT DISTINCT c.signal_key, g.process AS process_id FROM v_causal_cross c JOIN v_causal_tokens t ON t.net = c.egress_net AND t.seq = c.egress_seq JOIN v_causal_tags g ON g.token = t.token),
    made AS (SELECT content_hash, process_id FROM v_producers WHERE process_id IS NOT NULL UNION SELECT p.content_hash, q.process_id FROM v_producers p JOIN v_processes q ON q.net_id = p.source_net),
    members AS (SELECT process_id, entry_id FROM v_entries WHERE process_id IS NOT NULL UNION SELECT q.process_id, e.entry_id FROM v_entries e JOIN v_processes q ON starts_with(e.job_id, q.process_id || ':')
    UNION SELECT s.process_id, e.entry_id FROM v_entries e JOIN sent s ON s.signal_key = e.signal_key UNION SELECT m.process_id, e.entry_id FROM v_entries e JOIN made m ON m.content_hash = e.content_hash)"""


def _members(spark, sf_dir):
    names = ("entries", "causal_cross", "causal_tokens", "causal_tags", "producers", "processes")
    return reading.lineages(*(view(spark, sf_dir, n) for n in names))


@query("lineage_paths", f"{_LINEAGE} SELECT process_id, entry_id FROM members")
def lineage_paths(spark, sf_dir):
    return _members(spark, sf_dir)


@query("lineage_filtered", f"{_LINEAGE} SELECT entry_id, category FROM v_entries WHERE entry_id IN (SELECT entry_id FROM members WHERE process_id = 'p7') AND category IN ('click', 'purchase') AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-02-20' ORDER BY created_at, entry_id LIMIT 400")
def lineage_filtered(spark, sf_dir):
    rows = reading.lineage(view(spark, sf_dir, "entries"), _members(spark, sf_dir), "p7", ["click", "purchase"], "2024-01-03", "2024-02-20", 400)
    return rows.select("entry_id", "category")


@query("stats_by_net", "SELECT mime AS net, COUNT(*) AS n, CAST(SUM(size_bytes) AS BIGINT) AS bytes, MIN(created_at) AS first_at, MAX(created_at) AS last_at FROM v_catalogue GROUP BY 1")
def stats_by_net(spark, sf_dir):
    return reading.net_statistics(view(spark, sf_dir, "catalogue").withColumnRenamed("mime", "net"), "net", "created_at")


@query("inventory_stats", "SELECT 'total' AS dim, '' AS key, COUNT(*) AS n FROM v_file_inventory UNION ALL SELECT 'status', status, COUNT(*) FROM v_file_inventory GROUP BY status UNION ALL SELECT 'server', server, COUNT(*) FROM v_file_inventory GROUP BY server")
def inventory_stats(spark, sf_dir):
    return reading.inventory_statistics(view(spark, sf_dir, "file_inventory"))


_CLASSIFIED = """WITH observed AS (SELECT server, path, size_bytes AS size, CASE doc_id % 3 WHEN 0 THEN content_hash WHEN 1 THEN ' ' END AS hash, 1 AS ord FROM v_file_inventory UNION ALL SELECT server, path, size_bytes - 1, NULL, 0 FROM v_file_inventory WHERE doc_id % 4 = 0),
    last AS (SELECT server, path, arg_max(struct_pack(size := size, hash := hash), ord) AS o FROM observed GROUP BY 1, 2),
    first AS (SELECT server, path, arg_min(struct_pack(size := legacy_size, hash := 'l' || CAST(legacy_key AS STRING)), legacy_key) AS l FROM v_legacy_index GROUP BY 1, 2),
    classified AS (SELECT a.server, a.path, a.o.size AS size, COALESCE(NULLIF(trim(a.o.hash), ''), b.l.hash) AS content_hash, CASE WHEN b.path IS NULL THEN 'orphan_disk' WHEN b.l.size = a.o.size THEN 'verified' ELSE 'mismatch' END AS status,
    CASE WHEN b.path IS NOT NULL AND b.l.size IS DISTINCT FROM a.o.size THEN b.l.size END AS legacy_size FROM last a LEFT JOIN first b ON a.server = b.server AND a.path = b.path)"""


def _classified(spark, sf_dir):
    files = view(spark, sf_dir, "file_inventory")
    late = files.selectExpr("server", "path", "size_bytes as size", "case doc_id % 3 when 0 then content_hash when 1 then ' ' end as hash", "1 as ord")
    early = files.where("doc_id % 4 = 0").selectExpr("server", "path", "size_bytes - 1 as size", "cast(null as string) as hash", "0 as ord")
    legacy = view(spark, sf_dir, "legacy_index").withColumn("legacy_hash", F.concat(F.lit("l"), F.col("legacy_key").cast("string")))
    return reading.classified(late.union(early), legacy)


@query("reconcile_observed", f"{_CLASSIFIED} SELECT * FROM classified")
def reconcile_observed(spark, sf_dir):
    return _classified(spark, sf_dir)


@query("reconcile_summary", f"{_CLASSIFIED} SELECT server, status, COUNT(*) AS n FROM classified GROUP BY 1, 2")
def reconcile_summary(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("server", "status").agg(F.count("*").alias("n"))


@query("reconcile_orphans", f"{_CLASSIFIED} SELECT server, path FROM classified WHERE status = 'orphan_disk' ORDER BY path, server LIMIT 20 OFFSET 20")
def reconcile_orphans(spark, sf_dir):
    orphans = _classified(spark, sf_dir).where("status = 'orphan_disk'").select("server", "path")
    return reading.with_page(orphans, [F.col("path"), F.col("server")], 1, 20)[0]


@query("version_join", "SELECT l.l_orderkey, l.l_linenumber, t.title FROM lineitem l JOIN (SELECT p_partkey AS id, v.version, p_name || ' v' || CAST(v.version AS STRING) AS title FROM part, (VALUES (0), (1)) v(version)) t ON t.id = l.l_partkey AND t.version = l.l_linenumber % 3")
def version_join(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "l_partkey as id", "cast(l_linenumber % 3 as int) as version")
    parts = flows.split(spark.read.parquet(f"{sf_dir}/part.parquet"), [0, 1], "version")
    return items.join(parts.selectExpr("p_partkey as id", "version", "concat(p_name, ' v', version) as title"), ["id", "version"]).select("l_orderkey", "l_linenumber", "title")


_ORDINAL = "WITH items AS (SELECT k, unnest([place, 'all', place]) AS name, unnest([value, value + 1, value + 2]) AS v, unnest([1, 2, 3]) AS ord, seq FROM v_tokens)"


def _ordinal(spark, sf_dir):
    rows = view(spark, sf_dir, "tokens").select("k", "seq", F.array("place", F.lit("all"), "place").alias("name"), F.array("value", F.col("value") + 1, F.col("value") + 2).alias("v"))
    return reading.with_ordinality(rows, "name", "v")


@query("ordinality_last", f"{_ORDINAL} SELECT seq, name, arg_max(v, ord) AS v FROM items GROUP BY 1, 2")
def ordinality_last(spark, sf_dir):
    return _ordinal(spark, sf_dir).groupBy("seq", "name").agg(F.max_by("v", "ord").alias("v"))


@query("ordinality_first", f"{_ORDINAL} SELECT k, name, arg_min(v, (seq, ord)) AS v FROM items GROUP BY 1, 2")
def ordinality_first(spark, sf_dir):
    return _ordinal(spark, sf_dir).groupBy("k", "name").agg(F.min_by("v", F.struct("seq", "ord")).alias("v"))


_FILES = "WITH files AS (SELECT server, path, size_bytes, content_hash, doc_id AS ord FROM v_file_inventory), known AS (SELECT DISTINCT content_hash FROM v_file_inventory WHERE doc_id % 5 = 0)"


def _registered(spark, sf_dir):
    files = view(spark, sf_dir, "file_inventory")
    return reading.register(files.where("doc_id % 5 = 0").select("content_hash").distinct(), files.withColumn("ord", F.col("doc_id")))


@query("register_contents", f"{_FILES} SELECT content_hash, arg_min(path, ord) AS name, arg_min(struct_pack(s := size_bytes), ord).s AS size_bytes FROM files WHERE content_hash NOT IN (SELECT content_hash FROM known) GROUP BY 1")
def register_contents(spark, sf_dir):
    return _registered(spark, sf_dir)[0]


@query("register_copies", f"{_FILES} SELECT server, path, arg_max(content_hash, ord) AS content_hash FROM files GROUP BY 1, 2")
def register_copies(spark, sf_dir):
    return _registered(spark, sf_dir)[1]


@query("parallel_split", "SELECT seq, b.branch FROM v_tokens, (VALUES ('left'), ('right'), ('log')) b(branch)")
def parallel_split(spark, sf_dir):
    return flows.split(view(spark, sf_dir, "tokens").select("seq"), ["left", "right", "log"])


@query("subflow_call", "SELECT seq, place, round(value * 2 + k, 4) AS score FROM v_tokens WHERE value * 2 > 20")
def subflow_call(spark, sf_dir):
    child = lambda rows: rows.where("doubled > 20").selectExpr("seq", "round(doubled + own, 4) as score")
    return flows.call(view(spark, sf_dir, "tokens").select("seq", "place", "value", "k"), child, "seq", {"doubled": "value * 2", "own": "k"}).select("seq", "place", "score")


@query("end_mapping", "SELECT run_id, status = 'completed' AND result_ok AS ok, duration_ms / 1000.0::DOUBLE AS seconds, CASE WHEN status = 'failed' THEN template || ': failed' END AS failure FROM v_runs WHERE status <> 'running'")
def end_mapping(spark, sf_dir):
    ended = view(spark, sf_dir, "runs").where("status <> 'running'")
    return flows.mapped(ended, {"ok": "status = 'completed' and result_ok", "seconds": "duration_ms / 1000d", "failure": "if(status = 'failed', concat(template, ': failed'), null)"}, "run_id")


@query("trigger_payload", "SELECT seq, 'fired by ' || payload AS reason, key * 10 AS channel FROM v_triggers WHERE kind = 'fire'")
def trigger_payload(spark, sf_dir):
    return flows.mapped(view(spark, sf_dir, "triggers").where("kind = 'fire'"), {"reason": "concat('fired by ', payload)", "channel": "key * 10"}, "seq")


@query("channel_each", "SELECT seq, k, value FROM v_tokens WHERE place = 'view'")
def channel_each(spark, sf_dir):
    kind = F.when(F.col("place") == "view", "item").when(F.col("place") == "click", "open").otherwise("close")
    return flows.each_item(view(spark, sf_dir, "tokens").withColumn("kind", kind)).select("seq", "k", "value")


@query("channel_latest", "SELECT place, MAX(ts) AS ts, arg_max(value, (ts, value)) AS value FROM v_tokens GROUP BY 1")
def channel_latest(spark, sf_dir):
    return flows.latest_value(view(spark, sf_dir, "tokens"), "place", "ts", "value")


@query("workflow_lookup", "SELECT t.seq, c.entry_id FROM v_tokens t LEFT JOIN (SELECT category, MAX(entry_id) AS entry_id FROM v_catalogue GROUP BY 1) c ON c.category = 'src' || CAST(t.k AS STRING)")
def workflow_lookup(spark, sf_dir):
    tokens = view(spark, sf_dir, "tokens").withColumn("category", F.concat(F.lit("src"), F.col("k").cast("string")))
    return flows.looked_up(tokens, view(spark, sf_dir, "catalogue").select("category", "entry_id"), "category", "entry_id").select("seq", "found.entry_id")
