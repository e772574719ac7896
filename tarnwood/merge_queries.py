"""Queries over merges, request parameters and small dataflow parts; they join the same registry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tarnwood.catalog_queries import _NODES, query, stored, view
from tarnwood.functions import dsl, params
from tarnwood.operators import inventory, merging, rollup
from tarnwood.views import NOW


@query("bracket_params", "SELECT entry_id, size_bytes FROM v_catalogue WHERE size_bytes >= 500 AND category IN ('src1', 'src2') AND mime <> 'fr' ORDER BY size_bytes DESC NULLS LAST, entry_id LIMIT 20 OFFSET 20")
def bracket_params(spark, sf_dir):
    asked = params.parse_params("filter[sizeBytes][gte]=500&filter[category][in]=src1,src2&filter[mime][ne]=fr&filter[mime][near]=x&sort=-sizeBytes&page=1&size=20")
    rows = view(spark, sf_dir, "catalogue")
    kept = rows.where(dsl.compile_query(asked.query, rows.schema, datetime.fromisoformat(NOW)))
    return inventory.page(kept, params.sort_columns(asked.sort, ("size_bytes", "created_at"), "entry_id"), asked.page, asked.size).select("entry_id", "size_bytes")


@query("metadata_upgrade", """SELECT entry_id, CASE WHEN entry_id % 4 = 0 THEN CASE WHEN entry_id % 3 = 0 THEN NULL ELSE mime END WHEN entry_id % 4 = 1 AND entry_id % 3 <> 0 THEN mime ELSE 'old' END AS format FROM v_catalogue""")
def metadata_upgrade(spark, sf_dir):
    rows = view(spark, sf_dir, "catalogue")
    old = F.when(F.col("entry_id") % 4 == 0, "{}").when(F.col("entry_id") % 4 == 1, '{"format":{"unknown":"x"},"note":"old"}').otherwise('{"format":"old","note":"old"}')
    new = F.when(F.col("entry_id") % 3 == 0, "{}").otherwise(F.concat(F.lit('{"format":"'), "mime", F.lit('"}')))
    made = rows.select("entry_id", merging.upgraded(old, new, F.get_json_object(new, "$.format").isNotNull()).alias("m"))
    shown = F.when(F.get_json_object("m", "$.note").isNotNull(), "old").otherwise(F.get_json_object("m", "$.format"))
    return made.select("entry_id", shown.alias("format"))


@query("last_wins_object", """SELECT process_id, array_to_string(list(key || '=' || CAST(event_id AS STRING) ORDER BY key), ';') AS object FROM (SELECT process_id, key, arg_max(event_id, (event_id % 5 = 0, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 40 END, event_id)) AS event_id FROM v_metrics GROUP BY 1, 2) GROUP BY 1""")
def last_wins_object(spark, sf_dir):
    rows = view(spark, sf_dir, "metrics").selectExpr("process_id", "key", "event_id", "if(event_id % 5 = 0, null, event_id % 40) as done_at")
    made = merging.last_wins_object(rows, ["process_id"], "key", "event_id", "done_at")
    return made.select("process_id", F.array_join(F.transform(F.map_entries("object"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("object"))


@query("metering_upsert", "SELECT request_id, arg_min(model, d) AS model, arg_max(status, d) AS status, arg_max(tokens, d) AS tokens FROM (SELECT request_id % 700 AS request_id, request_id AS d, model, status, prompt_tokens AS tokens FROM v_requests) GROUP BY 1")
def metering_upsert(spark, sf_dir):
    rows = view(spark, sf_dir, "requests").selectExpr("request_id % 700 as request_id", "request_id as d", "model", "status", "prompt_tokens as tokens")
    return merging.metering(rows, "request_id", "d", ["model"], ["status", "tokens"])


@query("endpoint_verdicts", """SELECT server AS endpoint, COUNT(*) AS sampled, COUNT(*) FILTER (WHERE doc_id % 19 <> 0 AND h = doc_id % 50) AS passed, COUNT(*) FILTER (WHERE doc_id % 19 <> 0 AND h <> doc_id % 50) AS mismatched, COUNT(*) FILTER (WHERE doc_id % 19 = 0) AS missing,
    CASE WHEN COUNT(*) FILTER (WHERE doc_id % 19 <> 0 AND h <> doc_id % 50 AND doc_id % 23 = 0 AND h <> 7) > 0 THEN 'conflict' WHEN COUNT(*) FILTER (WHERE doc_id % 19 <> 0 AND h <> doc_id % 50) > 0 THEN 'mismatch' ELSE 'verified' END AS verdict
    FROM (SELECT server, doc_id, CASE WHEN doc_id % 31 = 0 THEN doc_id % 11 ELSE doc_id % 50 END AS h FROM v_file_inventory) GROUP BY 1""")
def endpoint_verdicts(spark, sf_dir):
    files = view(spark, sf_dir, "file_inventory")
    seen = files.selectExpr("server as endpoint", "path", "if(doc_id % 19 = 0, null, if(doc_id % 31 = 0, doc_id % 11, doc_id % 50)) as hash", "doc_id % 50 as expected")
    return merging.endpoint_verdicts(seen, files.where("doc_id % 23 = 0").select("path", F.lit(7).cast("long").alias("sibling_hash")))


_FIELDS = {"k": "$.k", "a": "$.deep.a", "b": "$.deep.b", "c": "$.deep.c"}


@query("merge_patch", f"""SELECT event_id, {', '.join(f"json_extract_string(doc, '{v}') AS {k}" for k, v in _FIELDS.items())} FROM (SELECT event_id, json_merge_patch('{{"k":0,"deep":{{"a":1,"b":2}}}}', CASE WHEN event_id % 2 = 0 THEN '{{"deep":{{"b":null,"c":[1]}}}}' ELSE props END) AS doc FROM events)""")
def merge_patch(spark, sf_dir):
    rows = stored(spark, sf_dir, "events")
    new = F.when(F.col("event_id") % 2 == 0, '{"deep":{"b":null,"c":[1]}}').otherwise(F.col("props"))
    made = rows.select("event_id", merging.merge_patch(F.lit('{"k":0,"deep":{"a":1,"b":2}}'), new).alias("doc"))
    return made.select("event_id", *(F.get_json_object("doc", v).alias(k) for k, v in _FIELDS.items()))


@query("reply_routes", "SELECT k, MIN(route) AS route FROM (SELECT k, CASE WHEN seq % 3 = 0 THEN NULL WHEN k < 25 THEN k % 4 ELSE seq % 4 END AS route FROM v_tokens) GROUP BY 1 HAVING COUNT(DISTINCT route) <= 1")
def reply_routes(spark, sf_dir):
    rows = view(spark, sf_dir, "tokens").selectExpr("k", "case when seq % 3 = 0 then null when k < 25 then k % 4 else seq % 4 end as route")
    return merging.reply_routes(rows, "k", "route")


@query("channel_gather", """SELECT k, expected, COALESCE(array_to_string(list(seq ORDER BY seq) FILTER (WHERE r <= expected), ','), '') AS vals FROM
    (SELECT k, seq, row_number() OVER (PARTITION BY k ORDER BY seq) AS r, COUNT(*) OVER (PARTITION BY k) AS n, k % 6 * 3 AS expected FROM v_tokens WHERE place = 'view') WHERE n >= expected GROUP BY 1, 2""")
def channel_gather(spark, sf_dir):
    items = view(spark, sf_dir, "tokens").where("place = 'view'").selectExpr("k", "'item' as kind", "seq as idx", "seq as value")
    closes = items.select("k").distinct().selectExpr("k", "'close' as kind", "0L as idx", "k % 6 * 3 as value")
    got = merging.channel_gather(items.union(closes), "k", "kind", "idx", "value")
    return got.select("k", "expected", F.array_join(F.col("vals").cast("array<string>"), ",").alias("vals"))


@query("presence_expired", "SELECT process_id, MAX(event_id) AS last_seen FROM v_metrics GROUP BY 1 HAVING MAX(event_id) < 10000 - 100")
def presence_expired(spark, sf_dir):
    return merging.expired(view(spark, sf_dir, "metrics"), "process_id", "event_id", 10000, 100)


_NODE_SUMS = ["n", "n_failed", "sum_ms", "n_ms"]


@query("rollup_merge", f"SELECT * FROM {_NODES}")
def rollup_merge(spark, sf_dir):
    steps = view(spark, sf_dir, "steps")
    old, new = (rollup.node_rollup(steps.where(F.col("run_id") % 2 == k)) for k in (0, 1))
    return rollup.merge_rollup(old, new, ["node"], _NODE_SUMS)


@query("rollup_refresh", f"SELECT * FROM {_NODES}")
def rollup_refresh(spark, sf_dir):
    steps = view(spark, sf_dir, "steps")
    stale = rollup.node_rollup(steps).withColumn("n", F.when(F.col("node").isin("n1", "n2"), F.lit(0)).otherwise(F.col("n")).cast("long"))
    return merging.refreshed(stale, steps, steps.where(F.col("node").isin("n1", "n2")), ["node"], rollup.node_rollup)


@query("composite_membership", "SELECT seq FROM v_tokens t WHERE place <> 'click' AND EXISTS (SELECT 1 FROM v_tokens c WHERE c.place = 'click' AND c.k = t.k AND c.seq = t.seq + 1)")
def composite_membership(spark, sf_dir):
    tokens = view(spark, sf_dir, "tokens")
    wanted = tokens.where("place = 'click'").select("k", (F.col("seq") - 1).alias("seq"))
    return tokens.where("place <> 'click'").join(wanted, ["k", "seq"], "left_semi").select("seq")


@query("live_tail", "SELECT seq, place FROM v_tokens WHERE seq > 100 ORDER BY seq DESC LIMIT 200")
def live_tail(spark, sf_dir):
    return view(spark, sf_dir, "tokens").where("seq > 100").orderBy(F.desc("seq")).limit(200).select("seq", "place")


@query("served_models", "SELECT DISTINCT 'm' || CAST(i AS STRING) AS model FROM (SELECT UNNEST(range(s_suppkey % 4, s_suppkey % 7)) AS i FROM supplier WHERE s_acctbal > 0)")
def served_models(spark, sf_dir):
    live = stored(spark, sf_dir, "supplier").where("s_acctbal > 0")
    models = F.expr("transform(filter(sequence(0L, 6L), i -> i >= s_suppkey % 4 and i < s_suppkey % 7), i -> concat('m', i))")
    return live.select(F.explode(models).alias("model")).distinct()
