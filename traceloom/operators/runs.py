"""Run bookkeeping: event logs, budgets, stagnation, backlogs, usage and chat context."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import values
from .running import HOT_ROWS, spread_totals, top_per_key


# ---------------------------------------------------------------- event log
def with_sequence(events: DataFrame, stream="stream_id", at="ts", tie="event_id", hot_rows=HOT_ROWS) -> DataFrame:
    """Gapless sequence number per stream; a busy stream is spread over slices of equally many events."""
    return spread_totals(events, [stream], [at, tie], at, {"seq": F.lit(1)}, hot_rows=hot_rows)


def retained(events: DataFrame, keep=5000, stream="stream_id") -> DataFrame:
    """The last `keep` events of each stream, by sequence number."""
    head = events.groupBy(stream).agg(F.max("seq").alias("head"))
    return events.join(head, stream).where(F.col("head") - F.col("seq") < keep).drop("head")


def event_page(events: DataFrame, stream_id, after=0, limit=200, stream="stream_id") -> DataFrame:
    return events.where((F.col(stream) == stream_id) & (F.col("seq") > after)).orderBy("seq").limit(limit)


def gaps(events: DataFrame, stream="stream_id") -> DataFrame:
    """Events whose predecessor is missing. The predecessor is looked up by an equi join, so a long
    stream is not walked in one task."""
    previous = events.select(stream, (F.col("seq") + 1).alias("seq"))
    return events.where("seq > 1").select(stream, "seq").join(previous, [stream, "seq"], "left_anti")


def snapshot_required(cursors: DataFrame, events: DataFrame, stream="stream_id") -> DataFrame:
    """Cursors that cannot be resumed: the next event is not the next number, or the cursor is past
    the head. `cursors` has the stream and `after`."""
    head = events.groupBy(stream).agg(F.max("seq").alias("head"))
    following = (
        events.select(stream, "seq").join(cursors, stream).where("seq > after").groupBy(stream, "after").agg(F.min("seq").alias("next"))
    )
    rows = cursors.join(head, stream, "left").join(following, [stream, "after"], "left")
    beyond = F.col("after") > F.coalesce("head", F.lit(0))
    broken = beyond | (F.col("next") > F.col("after") + 1)
    resume = F.when(F.col("next").isNotNull(), F.col("next") - 1).otherwise(F.coalesce("head", F.lit(0)))
    return rows.where(F.coalesce(broken, F.lit(False))).select(stream, "after", resume.alias("resume_at"))


def current_state(events: DataFrame, entity="entity_id") -> DataFrame:
    """Latest payload per entity from added and updated events."""
    kept = events.where(F.col("type").rlike(r"^(node|edge)\.(added|updated)$"))
    return kept.groupBy("graph_id", F.substring_index("type", ".", 1).alias("what"), entity).agg(
        F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq")
    )


def live_counters(events: DataFrame, run="run_id") -> DataFrame:
    """Latest progress, usage and frontier payload per run."""
    return events.groupBy(run, "type").agg(F.max_by("payload", "seq").alias("payload"))


def idempotency(requests: DataFrame, key="key") -> DataFrame:
    """Outcome of each keyed request: the first creates, the same body replays, another conflicts."""
    first = requests.where(F.col(key).isNotNull()).groupBy("workspace", key).agg(
        F.min(F.struct("at", "request_id")).alias("first_at"),
        F.min_by("fingerprint", F.struct("at", "request_id")).alias("first_print"),
    )
    rows = requests.join(first, ["workspace", key], "left")
    made = F.col(key).isNull() | (F.struct("at", "request_id") == F.col("first_at"))
    outcome = F.when(made, "created").when(F.col("fingerprint") == F.col("first_print"), "replayed").otherwise("conflict")
    return rows.withColumn("outcome", outcome).drop("first_at", "first_print")


def expired_leases(jobs: DataFrame, now) -> DataFrame:
    """Running jobs whose lease has passed, ended as interrupted with their evidence kept."""
    lost = (F.col("status") == "running") & (F.coalesce("lease_until", F.lit(0)) < now)
    return jobs.where(lost).withColumn("status", F.lit("partial")).withColumn("stop_reason", F.lit("worker_interrupted"))


def unfinished_results(jobs: DataFrame, wanted: DataFrame, results: DataFrame) -> DataFrame:
    """Results an interrupted job never produced, filled in as unresolved."""
    left = wanted.join(jobs.select("job_id"), "job_id", "left_semi").join(
        results.select("job_id", "node_id", "kind"), ["job_id", "node_id", "kind"], "left_anti"
    )
    return left.select("job_id", "node_id", "kind", F.lit("unresolved").alias("outcome"), F.lit("worker_interrupted").alias("reason"))


# ---------------------------------------------------------------- budgets and runs of failures
def budget_cut(charges: DataFrame, limits, amount="amount", stream="stream_id", at="ts", tie="event_id", hot_rows=HOT_ROWS) -> DataFrame:
    """Charges with the running use and whether they fit. Amounts are not negative, so the running
    sum first exceeds a limit exactly at the charge that stops the run.

    `limits` is one limit of `amount`, or a dict of amount column to limit: then each has its own
    used_COLUMN, and `over` names the limits that a charge exceeds.
    """
    if not isinstance(limits, dict):
        rows = spread_totals(charges, [stream], [at, tie], at, {"used": F.col(amount)}, hot_rows=hot_rows)
        return rows.withColumn("fits", F.col("used") <= limits)
    rows = spread_totals(charges, [stream], [at, tie], at, {f"used_{c}": F.col(c) for c in limits}, hot_rows=hot_rows)
    over = F.array(*[F.when(F.col(f"used_{c}") > limit, F.lit(c)) for c, limit in limits.items()])
    return rows.withColumn("over", F.array_compact(over)).withColumn("fits", F.size("over") == 0)


def binding_limits(cut: DataFrame, stream="stream_id", at="ts", tie="event_id") -> DataFrame:
    """Per stream: charges that fit, what they used, and whether a limit bound; with several limits
    also which ones stopped the run, at its first charge that does not fit."""
    used = [c for c in cut.columns if c == "used" or c.startswith("used_")]
    several = [F.min_by("over", F.when(~F.col("fits"), F.struct(at, tie))).alias("bound_by")] if "over" in cut.columns else []
    return cut.groupBy(stream).agg(
        F.count_if("fits").alias("fitted"),
        *[F.coalesce(F.max(F.when(F.col("fits"), F.col(c))), F.lit(0)).alias(c) for c in used],
        F.bool_or(~F.col("fits")).alias("bound"),
        *several,
    )


def newest_within(rows: DataFrame, limit, size, by, at="ts", tie="event_id", hot_rows=HOT_ROWS) -> DataFrame:
    """The newest rows of each key whose sizes sum to at most `limit`."""
    order = [F.col(at).desc(), F.col(tie).desc()]
    summed = spread_totals(rows, list(by), order, at, {"size_so_far": size}, descending=True, hot_rows=hot_rows)
    return summed.where(F.col("size_so_far") <= limit)


def since_reset(events: DataFrame, counts, resets, stream="stream_id", at="ts", tie="event_id", hot_rows=HOT_ROWS) -> DataFrame:
    """Add `streak`: counted rows since the last reset, other rows leaving it unchanged."""
    rows = spread_totals(
        events, [stream], [at, tie], at,
        {"__island": F.when(resets, 1).otherwise(0), "__count": F.when(counts, 1).otherwise(0)}, hot_rows=hot_rows,
    )
    start = rows.where("__island > 0").groupBy(stream, "__island").agg(F.min("__count").alias("__base"))
    rows = rows.join(start, [stream, "__island"], "left")
    return rows.withColumn("streak", F.col("__count") - F.coalesce("__base", F.lit(0))).drop("__island", "__count", "__base")


def first_reaching(rows: DataFrame, limit, stream="stream_id", at="ts", tie="event_id") -> DataFrame:
    """First row of each stream whose streak reaches the limit."""
    hit = rows.where(F.col("streak") >= limit)
    return hit.groupBy(stream).agg(F.min_by(tie, F.struct(at, tie)).alias(tie), F.min(at).alias(at))


# ---------------------------------------------------------------- backlogs
def frontier(pending: DataFrame, by, k) -> DataFrame:
    """Next `k` tasks per key: free branches, fewer attempts, fairness, depth, parts before makers,
    more unanswered questions, label."""
    order = [
        "branch_busy",
        "attempts",
        F.col("spend") / (1 + F.col("done")),
        "depth",
        F.col("kind").isin(*model.NON_DEPENDENCY_KINDS),
        F.col("unanswered").desc(),
        "label",
        "node_id",
    ]
    return top_per_key(pending, list(by), order, k)


def frontier_counts(pending: DataFrame, by=("graph_id",)) -> DataFrame:
    return pending.groupBy(*by, "depth").agg(F.count("*").alias("pending"))


def attempts(events: DataFrame) -> DataFrame:
    """Tasks planned per target and relation, with the target's total."""
    planned = events.where(F.col("type") == "task.planned")
    pairs = planned.groupBy("run_id", "target_id", "relation").agg(F.count("*").alias("times"))
    totals = pairs.groupBy("run_id", "target_id").agg(F.sum("times").alias("attempts"))
    return pairs.join(totals, ["run_id", "target_id"])


def retried(tried: DataFrame, relations) -> DataFrame:
    """Attempts left when the given relations are asked again, and the relations still counted."""
    again = F.col("relation").isin(*relations)
    back = tried.groupBy("run_id", "target_id").agg(F.sum(F.when(again, F.col("times")).otherwise(0)).alias("back"))
    return (
        tried.join(back, ["run_id", "target_id"])
        .withColumn("attempts", F.greatest(F.lit(0), F.col("attempts") - F.col("back")))
        .where(~again)
        .drop("back")
    )


def branch_rollup(tasks: DataFrame, by=("run_id",)) -> DataFrame:
    """Documents spent and tasks done per branch, with the fairness that orders the backlog."""
    rows = tasks.groupBy(*by, "branch").agg(F.sum("documents").alias("spend"), F.count("*").alias("done"))
    return rows.withColumn("fairness", F.col("spend").cast("double") / (1 + F.col("done")))


def run_costs(usage: DataFrame, rate_in, rate_out, rate_search, by=("run_id",)) -> DataFrame:
    total = usage.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "searches")]
    )
    rates = [F.lit(r).cast("double") for r in (rate_in, rate_out, rate_search)]
    return total.withColumn("cost_minor", values.cost_minor("input_tokens", "output_tokens", "searches", *rates))


def open_questions(questions: DataFrame, by=("run_id",), k=None) -> DataFrame:
    """The distinct questions per run with the place of their first asking; ranked if `k` is given."""
    first = questions.groupBy(*by, "question").agg(F.min("pos").alias("pos"))
    return first if k is None else top_per_key(first, list(by), ["pos"], k)


def history_tail(turns: DataFrame, by, order, k) -> DataFrame:
    """The last `k` rows per key."""
    return top_per_key(turns, list(by), [F.col(c).desc() for c in order], k)


# ---------------------------------------------------------------- chat context
def selection_faults(selected: DataFrame, known: DataFrame) -> DataFrame:
    """Selected or cited ids that are not in the graph revision."""
    return selected.join(known.select("id"), "id", "left_anti")


def chat_nodes(nodes: DataFrame, requests: DataFrame, focus: DataFrame, words: DataFrame, k=80) -> DataFrame:
    """The `k` nodes of each request's graph to show: selected first, then by words shared with the
    message, then the root.

    `requests` has request_id, graph_id; `focus` request_id, id; `words` request_id, word. Words are
    matched by an equi join, not by comparing every message with every label.
    """
    tokens = nodes.select("graph_id", "id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("label"), F.lit(r"(\w{3,})"), 1))).alias("word"))
    shared = tokens.join(requests.join(words.distinct(), "request_id"), ["graph_id", "word"]).groupBy("request_id", "id").agg(F.count("*").alias("overlap"))
    chosen = focus.distinct().withColumn("selected", F.lit(True))
    rows = nodes.join(requests, "graph_id").join(shared, ["request_id", "id"], "left").join(chosen, ["request_id", "id"], "left")
    rows = rows.withColumn("overlap", F.coalesce("overlap", F.lit(0))).withColumn("selected", F.coalesce("selected", F.lit(False)))
    order = [F.col("selected").desc(), F.col("overlap").desc(), (F.col("id") == F.col("root_id")).desc(), "id"]
    return top_per_key(rows, ["request_id"], order, k)


def chat_edges(edges: DataFrame, shown: DataFrame, selected: DataFrame, k=60) -> DataFrame:
    """The `k` edges between shown nodes: selected ones, then those touching the focus.

    `selected` has request_id and edge_id.
    """
    source = shown.select("request_id", "graph_id", F.col("id").alias("source_node_id"), F.col("selected").alias("s"))
    target = shown.select("request_id", "graph_id", F.col("id").alias("target_node_id"), F.col("selected").alias("t"))
    rows = edges.join(source, ["graph_id", "source_node_id"]).join(target, ["request_id", "graph_id", "target_node_id"])
    chosen = selected.distinct().withColumn("picked", F.lit(True))
    rows = rows.join(chosen, ["request_id", "edge_id"], "left").withColumn("picked", F.coalesce("picked", F.lit(False)))
    return top_per_key(rows, ["request_id"], [F.col("picked").desc(), (F.col("s") | F.col("t")).desc(), "edge_id"], k)


def chat_evidence(edge_claims: DataFrame, evidence: DataFrame, shown: DataFrame, claims=3, quotes=2) -> DataFrame:
    """First claims of each shown edge and first quotes of each claim."""
    kept = edge_claims.join(shown.select("edge_id").distinct(), "edge_id", "left_semi")
    kept = top_per_key(kept, ["edge_id"], ["ord", "claim_id"], claims, "claim_rank")
    rows = kept.join(evidence, "claim_id")
    return top_per_key(rows, ["edge_id", "claim_id"], ["evidence_id"], quotes, "quote_rank")
