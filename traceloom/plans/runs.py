"""Queries over event logs, budgets, backlogs, items and chat context."""

from pyspark.sql import functions as F

from ..operators import documents as dc
from ..operators import gates
from ..operators import items as it
from ..operators import runs as rn
from .catalog import query
from .lens import CLAIM_ID, duck, frame, table

EVENTS = "SELECT user_id AS stream_id, event_id, ts, event_type, value, props, CAST(substring(props, 7, length(props) - 7) AS BIGINT) AS amount FROM {events}"
ORDER = "PARTITION BY stream_id ORDER BY ts, event_id"
SEQ_SQL = f"SELECT *, row_number() OVER ({ORDER}) AS seq FROM ({duck(EVENTS)})"


def events(spark, sf):
    return frame(spark, sf, EVENTS)


@query("event_seq", f"SELECT stream_id, event_id, seq FROM ({SEQ_SQL})")
def event_seq(spark, sf):
    return rn.with_sequence(events(spark, sf)).select("stream_id", "event_id", "seq")


@query(
    "event_retention",
    f"SELECT stream_id, event_id, seq FROM ({SEQ_SQL}) QUALIFY max(seq) OVER (PARTITION BY stream_id) - seq < 40",
)
def event_retention(spark, sf):
    return rn.retained(rn.with_sequence(events(spark, sf)), 40).select("stream_id", "event_id", "seq")


@query(
    "event_page",
    f"SELECT event_id, seq FROM ({SEQ_SQL}) WHERE stream_id = 8 AND seq > 5 ORDER BY seq LIMIT 20",
)
def event_page(spark, sf):
    own = events(spark, sf).where("stream_id = 8")
    return rn.event_page(rn.with_sequence(own), 8, 5, 20).select("event_id", "seq")


@query(
    "event_gaps",
    f"WITH s AS (SELECT stream_id, seq FROM ({SEQ_SQL}) WHERE event_type <> 'signup') SELECT stream_id, seq FROM s WHERE seq > 1 AND NOT EXISTS (SELECT 1 FROM s p WHERE p.stream_id = s.stream_id AND p.seq = s.seq - 1)",
)
def event_gaps(spark, sf):
    return rn.gaps(rn.with_sequence(events(spark, sf)).where("event_type <> 'signup'"))


@query(
    "snapshot_required",
    f"""WITH s AS (SELECT stream_id, seq FROM ({SEQ_SQL}) QUALIFY max(seq) OVER (PARTITION BY stream_id) - seq < 40), c AS (SELECT DISTINCT user_id AS stream_id, user_id % 90 AS after FROM events),
 j AS (SELECT c.stream_id, c.after, (SELECT min(seq) FROM s WHERE s.stream_id = c.stream_id AND s.seq > c.after) AS nxt, (SELECT max(seq) FROM s WHERE s.stream_id = c.stream_id) AS head FROM c)
SELECT stream_id, after, coalesce(nxt - 1, head) AS resume_at FROM j WHERE after > head OR nxt > after + 1""",
)
def snapshot_required(spark, sf):
    rows = rn.retained(rn.with_sequence(events(spark, sf)), 40)
    cursors = events(spark, sf).select("stream_id", (F.col("stream_id") % 90).alias("after")).distinct()
    return rn.snapshot_required(cursors, rows)


@query(
    "current_graph_from_events",
    f"""SELECT stream_id AS graph_id, CASE WHEN event_type IN ('click', 'view') THEN 'node' ELSE 'edge' END AS what, amount AS entity_id, arg_max(value, seq) AS payload, max(seq) AS seq
FROM ({SEQ_SQL}) WHERE event_type <> 'error' GROUP BY ALL""",
)
def current_graph_from_events(spark, sf):
    rows = rn.with_sequence(events(spark, sf)).select(
        F.col("stream_id").alias("graph_id"),
        F.when(F.col("event_type") == "click", "node.added")
        .when(F.col("event_type") == "view", "node.updated")
        .when(F.col("event_type") == "error", "run.status")
        .otherwise("edge.added")
        .alias("type"),
        F.col("amount").alias("entity_id"),
        F.col("value").alias("payload"),
        "seq",
    )
    return rn.current_state(rows)


@query(
    "live_counters",
    f"SELECT stream_id AS run_id, event_type AS type, arg_max(amount, seq) AS payload FROM ({SEQ_SQL}) GROUP BY ALL",
)
def live_counters(spark, sf):
    rows = rn.with_sequence(events(spark, sf)).select(
        F.col("stream_id").alias("run_id"), F.col("event_type").alias("type"), F.col("amount").alias("payload"), "seq"
    )
    return rn.live_counters(rows)


@query(
    "budget_cut",
    f"""WITH u AS (SELECT stream_id, sum(amount) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS used FROM ({duck(EVENTS)}))
SELECT stream_id, count(*) FILTER (used <= 1500) AS fitted, CAST(coalesce(max(used) FILTER (used <= 1500), 0) AS BIGINT) AS used, bool_or(used > 1500) AS bound FROM u GROUP BY ALL""",
)
def budget_cut(spark, sf):
    return rn.binding_limits(rn.budget_cut(events(spark, sf), 1500))


@query(
    "event_seq_one_hour",
    """WITH e AS (SELECT user_id % 3 AS stream_id, event_id, epoch_us(ts::TIMESTAMP) % 3600000000 AS inside FROM events)
SELECT stream_id, event_id, row_number() OVER (PARTITION BY stream_id ORDER BY inside, event_id) AS seq FROM e""",
)
def event_seq_one_hour(spark, sf):
    """A few streams whose events all lie in one hour: cut into slices of equally many events."""
    inside = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(3_600_000_000))
    rows = events(spark, sf).select((F.col("stream_id") % 3).alias("stream_id"), "event_id", F.timestamp_micros(inside).alias("ts"))
    return rn.with_sequence(rows, hot_rows=1000).select("stream_id", "event_id", "seq")


@query(
    "budget_limits",
    f"""WITH u AS (SELECT stream_id, ts, event_id, sum(amount) OVER w AS a, sum(floor(value)::BIGINT) OVER w AS v, count(*) OVER w AS n FROM ({duck(EVENTS)}) WINDOW w AS ({ORDER} ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT *, a <= 1500 AND v <= 2000 AND n <= 12 AS fits, array_to_string(list_filter([CASE WHEN a > 1500 THEN 'amount' END, CASE WHEN v > 2000 THEN 'spent' END, CASE WHEN n > 12 THEN 'calls' END], lambda x: x IS NOT NULL), ',') AS o FROM u)
SELECT stream_id, count(*) FILTER (fits) AS fitted, CAST(coalesce(max(a) FILTER (fits), 0) AS BIGINT) AS used_amount, CAST(coalesce(max(v) FILTER (fits), 0) AS BIGINT) AS used_spent,
 CAST(coalesce(max(n) FILTER (fits), 0) AS BIGINT) AS used_calls, bool_or(NOT fits) AS bound, arg_min(o, (ts, event_id)) FILTER (NOT fits) AS bound_by FROM f GROUP BY ALL""",
)
def budget_limits(spark, sf):
    """Three limits at once, and which of them stopped a stream."""
    rows = events(spark, sf).withColumn("spent", F.floor("value").cast("long")).withColumn("calls", F.lit(1))
    out = rn.binding_limits(rn.budget_cut(rows, {"amount": 1500, "spent": 2000, "calls": 12}))
    return out.withColumn("bound_by", F.array_join("bound_by", ","))


@query(
    "context_budget",
    f"SELECT stream_id, event_id FROM ({duck(EVENTS)}) QUALIFY sum(length(props)) OVER (PARTITION BY stream_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) <= 300",
)
def context_budget(spark, sf):
    return rn.newest_within(events(spark, sf), 300, F.length("props"), ["stream_id"]).select("stream_id", "event_id")


STREAK_SQL = f"""WITH i AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS island FROM ({duck(EVENTS)})),
 s AS (SELECT *, count(*) FILTER (COND) OVER (PARTITION BY stream_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)"""


@query(
    "stagnation",
    STREAK_SQL.replace("COND", "event_type <> 'purchase'") + " SELECT stream_id, max(streak) AS longest, count(*) FILTER (streak = 2) AS pauses FROM s GROUP BY ALL",
)
def stagnation(spark, sf):
    found = F.col("event_type") == "purchase"
    rows = rn.since_reset(events(spark, sf), ~found, found)
    return rows.groupBy("stream_id").agg(
        F.max("streak").alias("longest"), F.count_if(F.col("streak") == 2).alias("pauses")
    )


@query(
    "provider_outage",
    STREAK_SQL.replace("COND", "event_type = 'error'") + " SELECT stream_id, arg_min(event_id, (ts, event_id)) AS event_id FROM s WHERE streak >= 5 GROUP BY ALL",
)
def provider_outage(spark, sf):
    rows = rn.since_reset(events(spark, sf), F.col("event_type") == "error", F.col("event_type") == "purchase")
    return rn.first_reaching(rows, 5).select("stream_id", "event_id")


PENDING = """SELECT o_orderkey AS node_id, o_custkey % 40 AS graph_id, o_custkey % 2 = 0 AS branch_busy, o_orderkey % 3 AS attempts, o_custkey % 17 AS spend, o_custkey % 4 AS done, o_orderkey % 5 AS depth,
 CASE WHEN o_orderkey % 4 = 0 THEN 'facility' ELSE 'component' END AS kind, o_orderkey % 2 AS unanswered, o_orderpriority AS label FROM {orders}"""


@query(
    "frontier_rank",
    f"""SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY branch_busy, attempts, spend / (1 + done)::DOUBLE, depth, kind = 'facility', unanswered DESC, label, node_id) AS rank FROM ({duck(PENDING)}) QUALIFY rank <= 25""",
)
def frontier_rank(spark, sf):
    out = rn.frontier(frame(spark, sf, PENDING), ["graph_id"], 25)
    return out.select("graph_id", "node_id", F.col("rank").cast("long").alias("rank"))


@query("frontier_counts", f"SELECT graph_id, depth, count(*) AS pending FROM ({duck(PENDING)}) GROUP BY ALL")
def frontier_counts(spark, sf):
    return rn.frontier_counts(frame(spark, sf, PENDING))


TASKS = "SELECT user_id % 5 AS run_id, user_id AS target_id, concat('r', CAST(event_id % 4 AS STRING)) AS relation, CASE WHEN event_type = 'view' THEN 'other' ELSE 'task.planned' END AS type FROM {events}"
ATTEMPTS_SQL = f"""p AS (SELECT run_id, target_id, relation, count(*) AS times FROM ({duck(TASKS)}) WHERE type = 'task.planned' GROUP BY ALL),
 a AS (SELECT *, CAST(sum(times) OVER (PARTITION BY run_id, target_id) AS BIGINT) AS attempts FROM p)"""


@query("attempts_from_events", f"WITH {ATTEMPTS_SQL} SELECT * FROM a")
def attempts_from_events(spark, sf):
    return rn.attempts(frame(spark, sf, TASKS))


@query(
    "retry_adjustment",
    f"""WITH {ATTEMPTS_SQL}, b AS (SELECT run_id, target_id, sum(CASE WHEN relation IN ('r1', 'r2') THEN times ELSE 0 END) AS back FROM a GROUP BY ALL)
SELECT run_id, target_id, relation, times, CAST(greatest(0, attempts - back) AS BIGINT) AS attempts FROM a JOIN b USING (run_id, target_id) WHERE relation NOT IN ('r1', 'r2')""",
)
def retry_adjustment(spark, sf):
    return rn.retried(rn.attempts(frame(spark, sf, TASKS)), ["r1", "r2"])


@query(
    "branch_rollup",
    "SELECT user_id % 5 AS run_id, event_type AS branch, CAST(sum(event_id % 9) AS BIGINT) AS spend, count(*) AS done, sum(event_id % 9)::DOUBLE / (1 + count(*)) AS fairness FROM events GROUP BY ALL",
)
def branch_rollup(spark, sf):
    tasks = frame(spark, sf, "SELECT user_id % 5 AS run_id, event_type AS branch, event_id % 9 AS documents FROM {events}")
    return rn.branch_rollup(tasks)


@query(
    "run_cost",
    """SELECT user_id AS run_id, CAST(sum(event_id) AS BIGINT) AS input_tokens, CAST(sum(event_id % 100) AS BIGINT) AS output_tokens, count(*) AS searches,
 CAST(ceil(sum(event_id) * 40.0::DOUBLE / 1e6::DOUBLE + sum(event_id % 100) * 160.0::DOUBLE / 1e6::DOUBLE + count(*) * 0.8::DOUBLE) AS BIGINT) AS cost_minor FROM events GROUP BY ALL""",
)
def run_cost(spark, sf):
    usage = frame(
        spark, sf, "SELECT user_id AS run_id, event_id AS input_tokens, event_id % 100 AS output_tokens, CAST(1 AS BIGINT) AS searches FROM {events}"
    )
    return rn.run_costs(usage, 40.0, 160.0, 0.8)


@query(
    "open_questions",
    """WITH q AS (SELECT user_id AS run_id, props AS question, min(event_id) AS pos FROM events GROUP BY ALL) SELECT run_id, question, pos FROM q""",
)
def open_questions(spark, sf):
    rows = frame(spark, sf, "SELECT user_id AS run_id, props AS question, event_id AS pos FROM {events}")
    return rn.open_questions(rows)


@query(
    "history_tail",
    "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
)
def history_tail(spark, sf):
    return rn.history_tail(table(spark, sf, "conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "turn", "role")


REQUESTS = "SELECT 'w' AS workspace, CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat(CAST(user_id AS STRING), '-', CAST(event_id % 20 AS STRING)) END AS key, event_type AS fingerprint, ts AS made_at, event_id AS request_id FROM {events}"


@query(
    "idempotency_conflicts",
    f"""SELECT request_id, CASE WHEN key IS NULL OR row_number() OVER w = 1 THEN 'created' WHEN fingerprint = first_value(fingerprint) OVER w THEN 'replayed' ELSE 'conflict' END AS outcome
FROM ({duck(REQUESTS)}) WINDOW w AS (PARTITION BY key ORDER BY made_at, request_id)""",
)
def idempotency_conflicts(spark, sf):
    return rn.idempotency(frame(spark, sf, REQUESTS).withColumnRenamed("made_at", "at")).select("request_id", "outcome")


@query(
    "lease_expiry",
    "SELECT event_id AS job_id, 'partial' AS status, 'worker_interrupted' AS stop_reason FROM events WHERE event_type IN ('click', 'view') AND event_id < 4000",
)
def lease_expiry(spark, sf):
    jobs = frame(
        spark, sf, "SELECT event_id AS job_id, CASE WHEN event_type IN ('click', 'view') THEN 'running' ELSE 'completed' END AS status, event_id AS lease_until FROM {events}"
    )
    return rn.expired_leases(jobs, 4000).select("job_id", "status", "stop_reason")


@query(
    "failure_class",
    """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN NULL WHEN event_id % 11 = 0 THEN 'Research Provider Unavailable' WHEN event_id % 4 = 0 THEN 'Research Provider Timed Out' WHEN event_id % 4 = 1 THEN 'Research Sources Unavailable' END AS title FROM events""",
)
def failure_class(spark, sf):
    rows = frame(
        spark, sf,
        """SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'completed' END AS status,
 CASE event_id % 4 WHEN 0 THEN 'provider_timeout' WHEN 1 THEN 'source_unavailable' WHEN 2 THEN 'max_nodes' END AS stop_reason,
 CASE WHEN event_id % 11 = 0 THEN array('x', 'Research Provider failed or returned invalid data.') ELSE array('y') END AS open_questions FROM {events}""",
    )
    return rows.select("event_id", gates.failure_class("status", "stop_reason", "open_questions").alias("title"))


@query(
    "query_dedup",
    """WITH q AS (SELECT user_id AS run_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type || ' ' END AS query, event_id % 3 AS source_rank, event_id AS pos FROM events),
 f AS (SELECT run_id, trim(lower(query)) AS query_key, min((source_rank, pos)) AS o FROM q GROUP BY ALL)
SELECT run_id, query_key, row_number() OVER (PARTITION BY run_id ORDER BY o) AS rank FROM f QUALIFY rank <= 3""",
)
def query_dedup(spark, sf):
    from ..functions.text import native_label_key

    rows = frame(
        spark, sf,
        "SELECT user_id AS run_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE concat(event_type, ' ') END AS query, event_id % 3 AS source_rank, event_id AS pos FROM {events}",
    )
    out = dc.distinct_queries(rows, ["run_id"], 3, native_label_key)
    return out.select("run_id", "query_key", F.col("rank").cast("long").alias("rank"))


@query(
    "evidence_ids",
    "SELECT user_id AS run_id, event_id AS pos, upper(substring(event_type, 1, 1)) || row_number() OVER (PARTITION BY user_id, upper(substring(event_type, 1, 1)) ORDER BY event_id) AS id FROM events",
)
def evidence_ids(spark, sf):
    rows = frame(spark, sf, "SELECT user_id AS run_id, event_id AS pos, upper(substring(event_type, 1, 1)) AS prefix FROM {events}")
    return dc.evidence_ids(rows, hot_rows=500).select("run_id", "pos", "id")


@query(
    "seed_urls",
    "WITH u AS (SELECT page_id % 6 AS run_id, url, min(page_id) AS pos FROM pages GROUP BY ALL) SELECT run_id, url, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS rank FROM u QUALIFY rank <= 10",
)
def seed_urls(spark, sf):
    rows = frame(spark, sf, "SELECT page_id % 6 AS run_id, url, page_id AS pos FROM {pages}")
    return dc.seed_urls(rows, ["run_id"]).select("run_id", "url", F.col("rank").cast("long").alias("rank"))


# every order is an estimate; its line items are composed rows naming parts
RAW = f"""SELECT l_orderkey AS request_id, concat(CAST(l_linenumber AS STRING), {CLAIM_ID}) AS ordinal, CASE WHEN l_linenumber % 2 = 0 THEN upper(split_part(p_name, ' ', 2)) ELSE concat(' ', split_part(p_name, ' ', 2)) END AS name,
 'component' AS category, CASE WHEN l_quantity > 25 THEN l_quantity END AS quantity, CASE WHEN l_tax > 0.04 THEN 'ea' END AS unit, CASE WHEN l_discount > 0.05 THEN p_type END AS material, p_brand AS manufacturer, CAST(NULL AS STRING) AS part_number, CAST(NULL AS STRING) AS notes,
 CASE WHEN l_suppkey % 2 = 0 THEN 'Widget' WHEN l_suppkey % 3 = 0 THEN 'bolt ' END AS parent_name, l_suppkey % 5 AS e, l_suppkey % 3 AS s, l_suppkey % 4 = 0 AS general_knowledge, CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""
REGISTRY = """SELECT o_orderkey AS request_id, concat('E', CAST(o_orderkey % 5 AS STRING)) AS evidence_id, 'web_page' AS ref_type, 'w' AS ref FROM {orders}
UNION ALL SELECT o_orderkey, concat('S', CAST(o_orderkey % 3 AS STRING)), 'search_snippet', 's' FROM {orders}"""
ITEMS_SQL = f"""r AS (SELECT *, trim(lower(name)) AS name_key, e = request_id % 5 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = request_id) AS web, s = request_id % 3 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = request_id) AS snip FROM ({duck(RAW)})),
 k AS (SELECT request_id, name_key, min(ordinal) AS first FROM r GROUP BY ALL),
 x AS (SELECT r.*, k.first, CASE WHEN web THEN 'evidenced' WHEN snip THEN 'inferred' ELSE 'guessed' END AS basis, CASE WHEN web THEN 0 WHEN snip THEN 1 ELSE 2 END AS rk FROM r JOIN k USING (request_id, name_key)),
 y AS (SELECT * REPLACE (CASE WHEN basis = 'guessed' AND confidence = 'high' THEN 'medium' ELSE confidence END AS confidence) FROM x),
 i AS (SELECT request_id, name_key, min(first) AS first, trim(arg_min(name, ordinal)) AS name, arg_min(basis, (rk, ordinal)) AS basis, arg_min(confidence, (rk, ordinal)) AS confidence,
  arg_min(quantity, ordinal) FILTER (quantity IS NOT NULL) AS quantity, arg_min(unit, ordinal) FILTER (unit IS NOT NULL) AS unit, arg_min(material, ordinal) FILTER (material IS NOT NULL) AS material,
  trim(lower(arg_min(coalesce(parent_name, ''), ordinal))) AS pk,
  CAST(max(CASE WHEN web THEN 1 ELSE 0 END) + max(CASE WHEN snip THEN 1 ELSE 0 END) + max(CASE WHEN NOT web AND NOT snip THEN 1 ELSE 0 END) + max(CASE WHEN (web OR snip) AND general_knowledge THEN 1 ELSE 0 END) AS BIGINT) AS sources FROM y GROUP BY ALL)"""


def raw_items(spark, sf):
    # joins by request and name, or by request and citation, leave the rows where their request is
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows = frame(spark, sf, RAW.replace("split_part(p_name, ' ', 2)", "element_at(split(p_name, ' '), 2)"))
    ids = F.array(F.concat(F.lit("E"), F.col("e").cast("string")), F.concat(F.lit("S"), F.col("s").cast("string")))
    return rows.withColumn("evidence_ids", ids)


@query(
    "item_projection",
    f"""WITH {ITEMS_SQL} SELECT i.request_id, i.name_key, i.first, i.name, i.basis, i.confidence, i.quantity, i.unit, i.material, p.name_key AS parent_key, i.sources
FROM i LEFT JOIN i p ON i.request_id = p.request_id AND i.pk = p.name_key AND p.name_key <> i.name_key""",
)
def item_projection(spark, sf):
    items, sources, _ = it.project_items(raw_items(spark, sf), frame(spark, sf, REGISTRY), by_request=True)
    counts = sources.groupBy("request_id", "name_key").agg(F.count("*").alias("sources"))
    out = items.join(counts, ["request_id", "name_key"])
    return out.select(
        "request_id", "name_key", "first", "name", "basis", "confidence", "quantity", "unit", "material", "parent_key", "sources"
    )


@query(
    "unknown_evidence",
    f"""WITH {ITEMS_SQL} SELECT request_id, 'E' || e AS evidence_id, count(*) AS n FROM x WHERE NOT web GROUP BY ALL UNION ALL SELECT request_id, 'S' || s, count(*) FROM x WHERE NOT snip GROUP BY ALL""",
)
def unknown_evidence(spark, sf):
    _, _, unknown = it.project_items(raw_items(spark, sf), frame(spark, sf, REGISTRY), by_request=True)
    return unknown.groupBy("request_id", "evidence_id").agg(F.count("*").alias("n"))


@query(
    "fallback_items",
    f"""WITH e AS (SELECT *, trim(lower(name)) AS name_key, CASE WHEN e = 1 THEN 'web_page' ELSE 'image_analysis' END AS ref_type, concat('ref', s) AS ref FROM ({duck(RAW)})),
 k AS (SELECT request_id, name_key, min(ordinal) AS first FROM e GROUP BY ALL)
SELECT request_id, name_key, min(first) AS first, arg_min(name, ordinal) AS name, arg_min(manufacturer, ordinal) AS manufacturer, CASE WHEN bool_or(ref_type = 'web_page') THEN 'evidenced' ELSE 'inferred' END AS basis,
 CASE WHEN bool_or(ref_type = 'web_page') THEN 'medium' ELSE 'low' END AS confidence, count(DISTINCT ref) AS sources FROM e JOIN k USING (request_id, name_key) GROUP BY ALL""",
)
def fallback_items(spark, sf):
    rows = raw_items(spark, sf)
    rows = rows.withColumn("ref_type", F.when(F.col("e") == 1, "web_page").otherwise("image_analysis"))
    rows = rows.withColumn("ref", F.concat(F.lit("ref"), F.col("s").cast("string")))
    out = it.fallback_items(rows)
    return out.select("request_id", "name_key", "first", "name", "manufacturer", "basis", "confidence", "sources")


CHAT_NODES = """SELECT p_brand AS graph_id, concat('pt:', CAST(p_partkey AS STRING)) AS id, concat(p_name, ' ', lower(p_type)) AS label, 'root' AS root_id FROM {part}
UNION ALL SELECT DISTINCT p_brand, 'root', p_brand, 'root' FROM {part}"""
CHAT_ASK = "SELECT 'chat ' || p_brand AS request_id, p_brand AS graph_id, concat('pt:', CAST(max(p_partkey) AS STRING)) AS chosen FROM {part} GROUP BY p_brand"


@query(
    "chat_context",
    f"""WITH n AS ({duck(CHAT_NODES)}), q AS ({duck(CHAT_ASK)}),
 s AS (SELECT q.request_id, n.id, n.id = q.chosen AS selected, length(list_intersect(list_distinct(regexp_extract_all(lower(n.label), '[a-z0-9_]{{3,}}')), ['red', 'bolt', 'promo'])) AS overlap FROM q JOIN n USING (graph_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY selected DESC, overlap DESC, id = 'root' DESC, id) AS rank FROM s QUALIFY rank <= 80)
SELECT 'node' AS what, request_id, id, rank FROM r
UNION ALL SELECT * FROM (SELECT 'edge', request_id, 'e' || id, row_number() OVER (PARTITION BY request_id ORDER BY selected DESC, 'e' || id) AS k
 FROM r WHERE id <> 'root' AND request_id IN (SELECT request_id FROM r WHERE id = 'root')) WHERE k <= 60""",
)
def chat_context(spark, sf):
    nodes, ask = frame(spark, sf, CHAT_NODES), frame(spark, sf, CHAT_ASK)
    requests = ask.select("request_id", "graph_id")
    focus = ask.select("request_id", F.col("chosen").alias("id"))
    words = requests.select(
        "request_id", F.explode(F.array(F.lit("red"), F.lit("bolt"), F.lit("promo"))).alias("word")
    )
    shown = rn.chat_nodes(nodes, requests, focus, words)
    edges = nodes.where("id <> 'root'").select(
        "graph_id",
        F.concat(F.lit("e"), "id").alias("edge_id"),
        F.col("id").alias("source_node_id"),
        F.lit("root").alias("target_node_id"),
    )
    none = requests.where("false").select("request_id", F.lit("").alias("edge_id"))
    lines = rn.chat_edges(edges, shown, none)
    rank = F.col("rank").cast("long").alias("rank")
    return shown.select(F.lit("node").alias("what"), "request_id", "id", rank).union(
        lines.select(F.lit("edge"), "request_id", "edge_id", rank)
    )
