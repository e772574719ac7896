"""Queries over causes, nets, trigger policies, schedules and metadata documents; they join the same registry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnwood.catalog_queries import query, stored, view
from tarnwood.functions import cron, dsl, metadata
from tarnwood.operators import causality, inventory, nets, profiling, provenance
from tarnwood.sources import metric_results
from tarnwood.streaming import policies
from tarnwood.views import NOW

# ---------------------------------------------------------------- causes

_CAUSES = """lk AS (
    SELECT u.net, u.seq, 'token' AS path, m.net AS cause_net, m.seq AS cause_seq FROM v_causal_tokens u JOIN v_causal_tokens m ON m.token = u.token AND m.role = 'produced' WHERE u.role = 'consumed'
    UNION SELECT ingress_net, ingress_seq, 'bridge', egress_net, egress_seq FROM v_causal_cross
    UNION SELECT ingress_net, ingress_seq, 'signal', egress_net, egress_seq FROM v_causal_signals
    UNION SELECT a.net, a.seq, 'process', a.net, MAX(b.seq) FROM v_causal_events a JOIN v_causal_tags p ON p.token = 't' || a.seq JOIN v_causal_tags q ON q.process = p.process JOIN v_causal_tokens b ON b.token = q.token AND b.role = 'produced' AND b.net = a.net AND b.seq < a.seq
      JOIN v_causal_events e ON e.seq = b.seq WHERE a.kind = 'TokenCreated' AND a.seq NOT IN (SELECT ingress_seq FROM v_causal_cross) AND a.seq NOT IN (SELECT ingress_seq FROM v_causal_signals) AND NOT (e.kind = 'TokenCreated' AND b.place LIKE 'sig_%') GROUP BY a.net, a.seq)"""


def _causes(spark, sf_dir):
    return causality.cause_links(*(view(spark, sf_dir, f"causal_{n}") for n in ("events", "tokens", "cross", "signals", "tags")))


@query("cause_links", f"WITH {_CAUSES} SELECT net, seq, path, cause_net, cause_seq FROM lk")
def cause_links(spark, sf_dir):
    return _causes(spark, sf_dir)


@query("cause_ancestry", f"""WITH RECURSIVE {_CAUSES}, back(root, seq, depth) AS (SELECT seq, seq, 0 FROM v_causal_events WHERE name = 'signup' UNION SELECT b.root, k.cause_seq, b.depth + 1 FROM back b JOIN lk k ON k.seq = b.seq WHERE b.depth < 3)
    SELECT a.net || ':' || CAST(b.root AS STRING) AS root, c.net || ':' || CAST(b.seq AS STRING) AS node, MIN(b.depth) AS depth FROM back b JOIN v_causal_events a ON a.seq = b.root JOIN v_causal_events c ON c.seq = b.seq GROUP BY 1, 2""")
def cause_ancestry(spark, sf_dir):
    links = _causes(spark, sf_dir).select(causality.node(F.col("net"), F.col("seq")).alias("node"), causality.node(F.col("cause_net"), F.col("cause_seq")).alias("cause")).distinct()
    roots = view(spark, sf_dir, "causal_events").where("name = 'signup'").select(causality.node(F.col("net"), F.col("seq")).alias("node"))
    return provenance.reached(links, roots.select(F.col("node").alias("root"), "node"), 3)


@query("event_token_details", "SELECT t.net, t.seq, t.token, t.role, t.place, COALESCE(t.data, p.data) AS data FROM v_causal_tokens t LEFT JOIN v_causal_tokens p ON p.token = t.token AND p.role = 'produced'")
def event_token_details(spark, sf_dir):
    return causality.token_details(view(spark, sf_dir, "causal_tokens"))


@query("event_signal_keys", "SELECT e.net, e.seq, COALESCE(c.signal_key, s.signal_key, CASE WHEN e.seq % 3 = 0 THEN 'r' || CAST(e.seq AS STRING) END) AS signal_key FROM v_causal_events e LEFT JOIN v_causal_cross c ON c.egress_seq = e.seq LEFT JOIN v_causal_signals s ON s.egress_seq = e.seq")
def event_signal_keys(spark, sf_dir):
    own = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("r"), F.col("seq").cast("string")))
    return causality.signal_keys(*(view(spark, sf_dir, f"causal_{n}") for n in ("events", "cross", "signals")), own)


@query("signal_process", "SELECT c.signal_key, MIN(g.process) AS process FROM v_causal_cross c JOIN v_causal_tokens t ON t.seq = c.egress_seq AND t.role = 'consumed' JOIN v_causal_tags g ON g.token = t.token GROUP BY 1")
def signal_process(spark, sf_dir):
    return causality.process_of_signal(*(view(spark, sf_dir, f"causal_{n}") for n in ("cross", "tokens", "tags")))


@query("artifact_tokens", """SELECT a.entry_id AS artifact, e.net, 't' || CAST(e.seq AS STRING) AS token FROM v_catalogue a JOIN v_causal_events e ON e.seq = a.entry_id WHERE a.entry_id % 3 = 0
    UNION ALL SELECT a.entry_id, c.egress_net, 't' || CAST(c.egress_seq AS STRING) FROM v_catalogue a JOIN v_causal_cross c ON c.signal_key = 'k' || CAST(a.entry_id * 11 AS STRING) WHERE a.entry_id % 3 <> 0""")
def artifact_tokens(spark, sf_dir):
    entries = view(spark, sf_dir, "catalogue").selectExpr("entry_id as artifact", "if(entry_id % 3 = 0, entry_id, null) as source_seq", "concat('k', entry_id * 11) as signal_key")
    nets_of = view(spark, sf_dir, "causal_events").select("net", F.col("seq").alias("source_seq"))
    return causality.artifact_tokens(entries.join(nets_of, "source_seq", "left"), view(spark, sf_dir, "causal_tokens"), view(spark, sf_dir, "causal_cross"))


@query("first_produced_token", "SELECT net, place, arg_min(token, seq) AS token, arg_min(data, seq) AS data FROM v_causal_tokens WHERE role = 'produced' GROUP BY 1, 2")
def first_produced_token(spark, sf_dir):
    return causality.first_produced(view(spark, sf_dir, "causal_tokens"))


# ---------------------------------------------------------------- nets


@query("transition_selection", """SELECT net, transition FROM (SELECT *, row_number() OVER (PARTITION BY net ORDER BY enabled_at, n_inputs DESC, priority DESC NULLS LAST, transition) AS r FROM
    (SELECT k AS net, 't' || place || CAST(seq % 3 AS STRING) AS transition, MIN(seq) // 300 AS enabled_at, 1 + MIN(seq) % 2 AS n_inputs, CASE WHEN MIN(seq) % 3 = 0 THEN NULL ELSE CAST(MIN(seq) % 4 AS DOUBLE) END AS priority FROM v_tokens GROUP BY 1, 2)) WHERE r = 1""")
def transition_selection(spark, sf_dir):
    ready = view(spark, sf_dir, "tokens").groupBy(F.col("k").alias("net"), F.expr("concat('t', place, seq % 3)").alias("transition")).agg(F.min("seq").alias("s"))
    return nets.select_transition(ready.selectExpr("net", "transition", "s div 300 as enabled_at", "1 + s % 2 as n_inputs", "if(s % 3 = 0, null, cast(s % 4 as double)) as priority"))


@query("join_three_guarded", """SELECT a.seq AS a_seq, MIN({'b': b.seq, 'c': c.seq}).b AS b_seq, MIN({'b': b.seq, 'c': c.seq}).c AS c_seq FROM v_tokens a JOIN v_tokens b ON b.seq // 20 = a.seq // 20 JOIN v_tokens c ON c.seq // 20 = a.seq // 20
    WHERE a.place = 'view' AND b.place = 'click' AND c.place = 'error' AND a.value < c.value AND b.k <> c.k GROUP BY 1""")
def join_three_guarded(spark, sf_dir):
    rows = view(spark, sf_dir, "tokens")
    a, b, c = (rows.where(F.col("place") == p).selectExpr(f"seq as {n}_seq", f"value as {n}_value", f"k as {n}_k", f"cast(seq div 20 as {t}) as {n}_key") for p, n, t in (("view", "a", "long"), ("click", "b", "double"), ("error", "c", "int")))
    return nets.guarded_join(a, [(b, "b_key"), (c, "c_key")], "a_key", F.expr("a_value < c_value and b_k <> c_k"), ["a_seq", "b_seq", "c_seq"])


_KINDS = "CASE p_partkey % 7 WHEN 0 THEN 'signal' WHEN 1 THEN 'bridge_in' WHEN 2 THEN 'bridge_out' WHEN 3 THEN 'bridge_reply' WHEN 4 THEN 'terminal' WHEN 5 THEN 'sink' ELSE 'internal' END"


@query("output_routes", f"""SELECT destination, COUNT(*) AS n FROM (SELECT CASE WHEN p.p_partkey IS NULL OR l.l_quantity >= 45 THEN 'error' WHEN p.p_partkey % 7 = 5 THEN 'discard' WHEN p.p_partkey % 7 = 2 THEN CASE WHEN p.p_partkey % 4 = 0 THEN 'error' ELSE 'net' || CAST(p.p_partkey % 4 AS STRING) END
    WHEN p.p_partkey % 7 = 3 THEN CASE WHEN l.l_orderkey % 2 = 0 THEN 'error' ELSE 'caller' || CAST(l.l_orderkey % 5 AS STRING) END ELSE CAST(l.l_partkey AS STRING) END AS destination
    FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_partkey % 10 <> 9) GROUP BY 1""")
def output_routes(spark, sf_dir):
    places = stored(spark, sf_dir, "part").where("p_partkey % 10 <> 9").selectExpr("cast(p_partkey as string) as place", f"{_KINDS} as kind", "if(p_partkey % 4 = 0, null, concat('net', p_partkey % 4)) as target")
    tokens = stored(spark, sf_dir, "lineitem").selectExpr("cast(l_partkey as string) as place", "l_quantity", "if(l_orderkey % 2 = 0, null, concat('caller', l_orderkey % 5)) as reply_to")
    return nets.route_outputs(tokens, places, F.col("l_quantity") < 45).groupBy("destination").agg(F.count("*").alias("n"))


@query("terminal_results", """SELECT net, token, COALESCE(json_extract_string(data, '$.exit_code'), data) AS result FROM (SELECT net, seq, token, CASE WHEN seq % 2 = 0 THEN '{"exit_code":' || CAST(seq % 3 AS STRING) || '}' ELSE data END AS data, row_number() OVER (PARTITION BY net ORDER BY seq) AS r FROM v_causal_tokens WHERE role = 'produced' AND place IN ('error', 'purchase')) WHERE r = 1""")
def terminal_results(spark, sf_dir):
    tokens = view(spark, sf_dir, "causal_tokens").where("role = 'produced'").selectExpr("net", "seq", "token", "place", """if(seq % 2 = 0, concat('{"exit_code":', seq % 3, '}'), data) as body""")
    places = tokens.select("place").distinct().withColumn("kind", F.when(F.col("place").isin("error", "purchase"), "terminal").otherwise("internal"))
    return nets.terminal_results(tokens, places)


@query("topology_issues", f"""WITH pl AS (SELECT 'n' || CAST(p_partkey AS STRING) AS place, {_KINDS} AS kind FROM part),
    po AS (SELECT 't' || CAST(s_suppkey AS STRING) AS transition, 'x' || CAST(i AS STRING) AS port, d AS direction, s_suppkey % 2 = 0 AS single, s_suppkey % 3 = 0 AS optional FROM supplier, (SELECT UNNEST([0, 1, 2, 3]) AS i), (SELECT UNNEST(['in', 'out']) AS d)),
    iss AS (SELECT 'place:' || place AS element, CASE WHEN kind IN ('signal', 'bridge_in') THEN 'UNUSED_SIGNAL' ELSE 'UNREACHABLE' END AS code, 'warning' AS level FROM pl
      WHERE (kind IN ('internal', 'bridge_out', 'terminal', 'sink') AND place NOT IN (SELECT place FROM v_arcs WHERE direction = 'out')) OR (kind IN ('signal', 'bridge_in') AND place NOT IN (SELECT place FROM v_arcs WHERE direction = 'in'))
    UNION ALL SELECT transition || ':' || port, CASE WHEN direction = 'in' THEN 'DISCONNECTED_INPUT' ELSE 'DISCONNECTED_OUTPUT' END, CASE WHEN direction = 'in' THEN 'error' ELSE 'warning' END FROM po
      WHERE (direction = 'in' OR NOT optional) AND NOT EXISTS (SELECT 1 FROM v_arcs a WHERE a.transition = po.transition AND a.port = po.port AND a.direction = po.direction)
    UNION ALL SELECT po.transition || ':' || po.port, 'CARDINALITY_MISMATCH', 'error' FROM po JOIN v_arcs a ON a.transition = po.transition AND a.port = po.port AND a.direction = po.direction WHERE po.single AND po.direction = 'in' AND a.weight > 1)
    SELECT element, code, level, COUNT(*) AS n FROM iss GROUP BY 1, 2, 3""")
def topology_issues(spark, sf_dir):
    places = stored(spark, sf_dir, "part").selectExpr("concat('n', p_partkey) as place", f"{_KINDS} as kind")
    ports = stored(spark, sf_dir, "supplier").selectExpr("concat('t', s_suppkey) as transition", "explode(array('x0', 'x1', 'x2', 'x3')) as port", "s_suppkey % 2 = 0 as single", "s_suppkey % 3 = 0 as optional").selectExpr("*", "explode(array('in', 'out')) as direction")
    return nets.topology_issues(places, view(spark, sf_dir, "arcs"), ports).groupBy("element", "code", "level").agg(F.count("*").alias("n"))


@query("graph_shape", """WITH n AS (SELECT o_custkey AS graph, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, CASE o_orderkey % 5 WHEN 0 THEN 'sub_workflow' WHEN 1 THEN 'loop' ELSE 'step' END AS kind FROM orders)
    SELECT graph, COUNT(*) AS n_nodes, COUNT(*) FILTER (WHERE kind = 'sub_workflow') AS n_sub, bool_or(kind = 'loop') AS has_loops, MAX((r - 1) % 4) AS depth, COUNT(*) FILTER (WHERE r % 2 = 0) AS n_edges FROM n GROUP BY 1""")
def graph_shape(spark, sf_dir):
    rows = stored(spark, sf_dir, "orders").selectExpr("o_custkey as graph", "o_orderkey as node", "case o_orderkey % 5 when 0 then 'sub_workflow' when 1 then 'loop' else 'step' end as kind", "row_number() over (partition by o_custkey order by o_orderkey) as r", "lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before")
    nodes = rows.selectExpr("graph", "node", "kind", "if((r - 1) % 4 = 0, null, before) as parent")
    return nets.graph_shape(spark, nodes, rows.where("r % 2 = 0").select("graph")).drop("kinds")


@query("delayed_tokens", "SELECT seq, epoch_us(ts) // 1000 + GREATEST(0, (k - 5) * 1000) AS due FROM v_tokens")
def delayed_tokens(spark, sf_dir):
    rows = view(spark, sf_dir, "tokens").withColumn("at", F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")))
    return nets.delayed(rows, "at", (F.col("k") - 5) * 1000).select("seq", "due")


# ---------------------------------------------------------------- triggers and schedules


@query("trigger_skip", "SELECT key, seq, payload AS started FROM (SELECT *, lag(kind) OVER (PARTITION BY key ORDER BY seq) AS b FROM v_triggers) WHERE kind = 'fire' AND b IS DISTINCT FROM 'fire'")
def trigger_skip(spark, sf_dir):
    return policies.started(view(spark, sf_dir, "triggers"), "skip")


@query("trigger_queue", """WITH s AS (SELECT *, SUM(CASE kind WHEN 'fire' THEN 1 ELSE -1 END) OVER (PARTITION BY key ORDER BY seq) AS t FROM v_triggers), h AS (SELECT *, t - LEAST(0, MIN(t) OVER (PARTITION BY key ORDER BY seq)) AS x FROM s),
    b AS (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM h WHERE (kind = 'fire' AND x = 1) OR (kind = 'done' AND x >= 1)), f AS (SELECT key, payload, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM v_triggers WHERE kind = 'fire')
    SELECT b.key, b.seq, f.payload AS started FROM b JOIN f ON f.key = b.key AND f.n = b.n""")
def trigger_queue(spark, sf_dir):
    return policies.started(view(spark, sf_dir, "triggers"), "queue")


@query("cron_fires", "SELECT CAST(epoch(t) AS BIGINT) AS at FROM (SELECT UNNEST(range(TIMESTAMP '2024-02-26', TIMESTAMP '2024-03-05', INTERVAL 15 MINUTE)) AS t) WHERE hour(t) BETWEEN 8 AND 17 AND dayofweek(t) BETWEEN 1 AND 5")
def cron_fires(spark, sf_dir):
    made = cron.fire_times(spark, "*/15 8-17 * * Mon-Fri", datetime(2024, 2, 25, 23, 59, 59), datetime(2024, 3, 4, 23, 59, 59))
    return made.select(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("at")).alias("at"))


@query("cron_matches", "SELECT seq FROM v_tokens WHERE second(ts) % 20 = 0 AND hour(ts) IN (1, 13) AND month(ts) <= 6")
def cron_matches(spark, sf_dir):
    return view(spark, sf_dir, "tokens").where(cron.cron_matches(F.col("ts"), "*/20 * 1,13 * Jan-Jun *")).select("seq")


# ---------------------------------------------------------------- documents of metadata


@query("dsl_meta_fields", "SELECT entry_id FROM v_catalogue WHERE mime = 'en' AND size_bytes > 300 AND n_columns >= 2 AND entry_id % 3 <> 1 AND entry_id % 2 = 0")
def dsl_meta_fields(spark, sf_dir):
    rows = view(spark, sf_dir, "catalogue").selectExpr(
        "entry_id", "to_json(named_struct('format', mime, 'num_rows', size_bytes, 'encrypted', entry_id % 3 = 1, 'format_specific', named_struct('details', named_struct('width', n_columns)))) as fm", "to_json(map('kind', concat('o', entry_id % 2))) as um",
    )
    asked = dsl.parse("meta.format:en meta.num_rows>300 meta.width>=2 meta.encrypted!=true umeta.kind:o0")
    test = dsl.compile_query(asked, rows.schema, datetime.fromisoformat(NOW), virtual=metadata.metadata_fields(F.col("fm")), open_keys={"umeta.": lambda k: metadata.open_field(F.col("um"), k)})
    return rows.where(test).select("entry_id")


@query("saved_query_backfill", "SELECT entry_id FROM v_catalogue WHERE size_bytes >= 1024 AND mime = 'en' ORDER BY created_at, entry_id LIMIT 1000")
def saved_query_backfill(spark, sf_dir):
    rows = view(spark, sf_dir, "catalogue")
    test = dsl.compile_query(dsl.parse("size_bytes>=1k mime:en"), rows.schema, datetime.fromisoformat(NOW))
    return inventory.backfill(rows, test, "created_at", "entry_id").select("entry_id")


@query("query_membership", "SELECT entry_id, COALESCE(size_bytes >= 1024 AND mime = 'en', FALSE) AS member FROM v_catalogue")
def query_membership(spark, sf_dir):
    rows = view(spark, sf_dir, "catalogue")
    test = dsl.compile_query(dsl.parse("size_bytes>=1k mime:en"), rows.schema, datetime.fromisoformat(NOW))
    return rows.select("entry_id", F.coalesce(test, F.lit(False)).alias("member"))


@query("pinned_assets", "SELECT entry_id FROM v_catalogue WHERE entry_id % 4 = 2 OR entry_id % 5 = 2")
def pinned_assets(spark, sf_dir):
    pins = F.expr("""concat('{"a":{"asset_id":"x', entry_id % 4, '"},"b":{"asset_id":"x', entry_id % 5, '","version":3}}')""")
    return view(spark, sf_dir, "catalogue").where(metadata.asset_pinned(pins, "x2")).select("entry_id")


@query("details_fields", """SELECT entry_id, 'total' AS label, CASE WHEN size_bytes < 1024 THEN CAST(size_bytes AS STRING) || ' B' ELSE printf('%.1f KB', size_bytes / 1024.0) END AS value, NULL AS unit FROM v_catalogue
    UNION ALL SELECT entry_id, 'sample rate', '44100', 'Hz' FROM v_catalogue UNION ALL SELECT entry_id, 'tags', 'a, ' || mime, NULL FROM v_catalogue""")
def details_fields(spark, sf_dir):
    rows = view(spark, sf_dir, "catalogue").selectExpr("entry_id", """concat('{"total_bytes":', size_bytes, ',"audio":{"sample_rate":44100,"note":null},"tags":["a","', mime, '"],"parts":[{"n":1}]}') as details""")
    return rows.select("entry_id", F.inline(metadata.details_view("details").getField("fields")))


@query("json_types", """SELECT * FROM (VALUES ('a', 'float64', false), ('b', 'string', true), ('c', 'list<int64>', true), ('d', 'struct<x:bool>', false), ('k', 'int64', true)) t("column", "type", nullable)""")
def json_types(spark, sf_dir):
    text = F.expr("""concat('{"a":', if(event_id % 2 = 0, '1', '1.5'), ',"b":', if(event_id % 2 = 0, 'null', '7'), if(event_id % 3 = 0, ',"c":[1,"z"]', ''), ',"d":{"x":true},"k":', if(event_id % 7 = 3, 'null', get_json_object(props, '$.k')), '}')""")
    return profiling.infer_json_types(stored(spark, sf_dir, "events").select("event_id", text.alias("doc")), "doc", "event_id")


_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("parquet_statistics", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_null, CAST(MIN({c}) AS DOUBLE) AS low, CAST(MAX({c}) AS DOUBLE) AS high FROM lineitem" for c in _NUMBERS))
def parquet_statistics(spark, sf_dir):
    return profiling.parquet_statistics(spark, f"{sf_dir}/lineitem.parquet")


@query("metric_samples", """SELECT event_id, event_type AS series, 10.5::DOUBLE AS ts, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 2.5::DOUBLE END AS value FROM events WHERE event_id % 4 < 3 AND event_id % 4 <> 2
    UNION ALL SELECT event_id, event_type, 11.0, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 2.5::DOUBLE END FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, NULL, 10.5, NULL FROM events WHERE event_id % 4 = 2""")
def metric_samples(spark, sf_dir):
    rows = stored(spark, sf_dir, "events").selectExpr("event_id", "event_type", "case event_id % 4 when 0 then 'vector' when 1 then 'matrix' when 2 then 'scalar' else 'streams' end as kind", "if(event_id % 2 = 0, '+Inf', '2.5') as v")
    texts = rows.withColumn("result", F.expr("""case kind when 'vector' then concat('[{"metric":{"type":"', event_type, '"},"value":[10.5,"', v, '"]}]') when 'matrix' then concat('[{"metric":{"type":"', event_type, '"},"values":[[10.5,"', v, '"],[11,"', v, '"]]}]') else concat('[10.5,"', v, '"]') end"""))
    return metric_results.flat_samples(texts).select("event_id", F.try_element_at("labels", F.lit("type")).alias("series"), "ts", "value")


# ---------------------------------------------------------------- moving and typing files


@query("migration_rows", "SELECT doc_id, path FROM v_file_inventory WHERE server = 'src1' AND is_canonical AND doc_id % 4 = 2")
def migration_rows(spark, sf_dir):
    files = view(spark, sf_dir, "file_inventory").withColumn("migration_target", F.expr("if(doc_id % 4 = 2, 'archive', null)"))
    return inventory.migration_rows(files, "src1", target="archive").select("doc_id", "path")


@query("data_type_list", """SELECT r_regionkey AS type_id, r_name AS name, COALESCE((SELECT array_to_string(list('s' || CAST(n_nationkey AS STRING) ORDER BY n_name), ',') FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey <> 2), '') AS digests,
    (SELECT COUNT(*) FROM v_catalogue c JOIN nation n ON n.n_nationkey = c.n_columns AND n.n_nationkey <> 2 WHERE n.n_regionkey = r_regionkey) AS n_entries FROM region""")
def data_type_list(spark, sf_dir):
    types = stored(spark, sf_dir, "region").selectExpr("r_regionkey as type_id", "r_name as name")
    digests = stored(spark, sf_dir, "nation").selectExpr("concat('s', n_nationkey) as digest", "n_regionkey as type_id", "n_name as attached")
    held = inventory.attach(digests.where("type_id <> 1"), digests.where("type_id <= 1"), digests.where("digest = 's2'").select("digest"))
    held = inventory.attach(held, digests.limit(0), digests.where("digest = 's2'").select("digest"))
    entries = view(spark, sf_dir, "catalogue").selectExpr("concat('s', n_columns) as digest")
    return inventory.data_types(types, held, entries).withColumn("digests", F.array_join("digests", ","))
