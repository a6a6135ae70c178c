"""Shortest-path levels, neighbourhoods and parent chains over edge tables.

A walk is a driver loop of equi joins. Each level is written to the shared folder, so lineage stays
short and a lost executor costs one level; only a yes/no answer returns to the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..session import materialize


def levels(edges: DataFrame, roots: DataFrame, max_level=None, by=(), carry=(), stored=False) -> DataFrame:
    """Shortest number of hops from the roots, walking each edge from target to source.

    `roots` has `id` and the `by` columns (such as graph_id); `carry` columns of the roots travel
    with the walk, the smallest value winning when parents at the same level differ. Edges are written
    for the walk unless they are `stored`, a table read as it is.
    """
    by, carry = list(by), list(carry)
    links = edges.select(*by, F.col("target_node_id").alias("id"), F.col("source_node_id").alias("child"))
    links = links.where("id is not null and child is not null")
    links = links if stored else materialize(links)
    frontier = materialize(roots.select(*by, "id", *carry).distinct())
    seen = frontier.withColumn("tier", F.lit(0))
    level = 0
    while max_level is None or level < max_level:
        level += 1
        reached = frontier.join(links, by + ["id"]).groupBy(*by, F.col("child").alias("id"))
        reached = (
            reached.agg(*[F.min(c).alias(c) for c in carry]) if carry else reached.agg(F.lit(1).alias("__x")).drop("__x")
        )
        frontier = materialize(reached.join(seen.select(*by, "id"), by + ["id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("tier", F.lit(level)))
        if level % 16 == 0:
            seen = materialize(seen)  # a deep graph must not become a union of a thousand reads
    return seen


def dependency_edges(edges):
    return edges.where(F.col("predicate").isin(*model.DEPENDENCY_PREDICATES))


def tiers(nodes: DataFrame, edges: DataFrame, roots: DataFrame, by=(), stored=False) -> DataFrame:
    """Every node with its tier from the root product; NULL when no dependency path reaches it."""
    found = levels(dependency_edges(edges), roots, by=by, stored=stored)
    return nodes.join(found, list(by) + ["id"], "left")


def tier_view(nodes: DataFrame, edges: DataFrame, tier_max: int):
    """Nodes up to a tier and the edges between them.

    A shortest path to a kept node only passes through nodes of lower tiers, which are kept too, so
    the tiers inside the view equal the tiers given and need no second walk.
    """
    kept = nodes.where(F.col("tier") <= tier_max)
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_semi")
    inside = inside.join(ids.withColumnRenamed("id", "target_node_id"), "target_node_id", "left_semi")
    return kept, inside


def graph_stats(nodes: DataFrame, edges: DataFrame, by=()) -> DataFrame:
    """Node count, edge count, largest tier and edges per support label, one row per label and graph.

    `by` are the columns that tell graphs apart. A graph without edges is one row with no label and
    0 edges; edges of a graph without nodes count too.
    """
    by = list(by)
    keys = by or ["__k"]
    one = [] if by else [F.lit(1).alias("__k")]
    count = nodes.select("*", *one).groupBy(*keys).agg(
        F.count("*").alias("node_count"), F.coalesce(F.max("tier"), F.lit(0)).alias("max_tier"))
    labels = edges.select("*", *one).groupBy(*keys, "support_label").agg(F.count("*").alias("edges"))
    total = labels.groupBy(*keys).agg(F.sum("edges").alias("edge_count"))
    rows = count.join(total, keys, "full").join(labels, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(*by, "support_label", zero("edges"), zero("node_count"), zero("max_tier"), zero("edge_count"))


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total edges per node."""
    ends = F.array(
        F.struct(F.col("source_node_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("target_node_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )
    return (
        edges.select(F.explode(ends).alias("e"))
        .groupBy(F.col("e.id").alias("id"))
        .agg(F.sum("e.i").alias("in_edges"), F.sum("e.o").alias("out_edges"))
    )


def _ends(edges):
    """(id, neighbour_id) of every edge, either direction."""
    ends = F.array(
        F.struct(F.col("source_node_id").alias("id"), F.col("target_node_id").alias("neighbour_id")),
        F.struct(F.col("target_node_id").alias("id"), F.col("source_node_id").alias("neighbour_id")),
    )
    return edges.select(F.explode(ends).alias("e")).select("e.*")


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct 1-hop neighbours of every node, either direction."""
    return _ends(edges).distinct()


def node_detail(nodes, edges, claims) -> DataFrame:
    """Each node with the number of in-edges, out-edges and claims that touch it."""
    touched = claims.select(F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("id"))
    touched = touched.groupBy("id").agg(F.count("*").alias("claims"))
    detail = nodes.join(degrees(edges), "id", "left").join(touched, "id", "left")
    return detail.fillna(0, ["in_edges", "out_edges", "claims"])


def edge_detail(edges, edge_claims, claims, claim_keys) -> DataFrame:
    """Claims of each edge with the number of claims that contradict it."""
    opposed = claims.groupBy(*claim_keys).agg(F.count_if(F.col("support_type") == "contradicts").alias("against"))
    rows = edge_claims.join(claims, "claim_id").join(opposed, list(claim_keys))
    return edges.join(rows, "edge_id")


def research_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Scheduling depth: a part's tier; for a maker or site one more than its nearest tiered
    neighbour; none for places. `nearest_id` is that neighbour."""
    tiered = nodes.where("tier is not null").select(F.col("id").alias("neighbour_id"), F.col("tier").alias("__t"))
    around = _ends(edges).where("id <> neighbour_id").join(tiered, "neighbour_id")  # a least neighbour needs no distinct ones
    near = around.groupBy("id").agg(F.min(F.struct("__t", "neighbour_id")).alias("n"))
    part = F.col("kind").isin("product", "component", "material")
    return nodes.join(near, "id", "left").select(
        *nodes.columns,
        F.when(part, F.col("tier"))
        .when(F.col("kind") == "geography", F.lit(None))
        .otherwise(F.col("n.__t") + 1)
        .cast("int")
        .alias("depth"),
        F.when(~part & (F.col("kind") != "geography"), F.col("n.neighbour_id")).alias("nearest_id"),
    )


def branches(nodes, edges, roots) -> DataFrame:
    """Branch of each reached node: its tier-1 ancestor, or itself at tier 1; the root is `root`."""
    links = dependency_edges(edges)
    first = links.join(
        roots.select(F.col("id").alias("target_node_id")), "target_node_id", "left_semi"
    ).select(F.col("source_node_id").alias("id"), F.col("source_node_id").alias("branch_id"))
    below = links.join(roots.select(F.col("id").alias("source_node_id")), "source_node_id", "left_anti")
    walked = levels(below, first.distinct(), carry=["branch_id"])
    return walked.select("id", "branch_id").union(roots.select("id", F.lit("root")))


def unanswered_relations(nodes, edges, attempted=None) -> DataFrame:
    """Relation types of each node with no directly supported inbound edge, minus those already
    sought (`attempted` has id and relation)."""
    wanted = model.lookup(
        F.col("kind"), {k: ",".join(v) for k, v in model.RELATIONS_BY_KIND.items()}
    )
    rows = nodes.select("id", F.explode(F.split(wanted, ",")).alias("relation"))
    answers = {}
    for relation, predicates in model.ANSWERING_PREDICATES.items():
        for predicate in predicates:
            answers.setdefault(predicate, []).append(relation)
    answered = model.lookup(F.col("predicate"), {p: ",".join(r) for p, r in answers.items()})
    supported = (
        edges.where(F.col("support_label") == "directly_supported")
        .select(F.col("target_node_id").alias("id"), F.explode(F.split(answered, ",")).alias("relation"))
        .distinct()
    )
    left = rows.join(supported, ["id", "relation"], "left_anti")
    return left if attempted is None else left.join(attempted, ["id", "relation"], "left_anti")


def parent_faults(items: DataFrame, id_col="id", parent_col="parent_id") -> DataFrame:
    """Items whose parent chain reaches a missing item (`dangling`) or never ends (`cycle`).

    Pointer doubling: after k rounds a pointer has moved 2^k parents. A chain that ends keeps
    losing members every round, so the loop stops at the first round that loses none.
    """
    links = materialize(items.select(F.col(id_col).alias("id"), F.col(parent_col).alias("ptr")))
    known = links.select(F.col("id").alias("ptr"), F.lit(True).alias("known"))
    # items without a parent stay out of the join, too: their NULL keys would all meet in one task
    state = links.where("ptr is not null").join(known, "ptr", "left").select(
        "id",
        F.when(F.col("known"), F.col("ptr")).alias("ptr"),
        F.col("known").isNull().alias("dangling"),
    ).unionByName(links.where("ptr is null").withColumn("dangling", F.lit(False)))
    state = materialize(state)
    open_rows = state.where("ptr is not null").count()
    while open_rows:
        step = state.select(
            F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("dangling").alias("lost")
        )
        # finished pointers stay out of the join: their NULL keys would all meet in one task
        moved = state.where("ptr is not null").join(step, "ptr").select(
            "id", F.col("next").alias("ptr"), (F.col("dangling") | F.col("lost")).alias("dangling")
        )
        state = materialize(state.where("ptr is null").unionByName(moved))
        now = state.where("ptr is not null").count()
        if now == open_rows:
            break
        open_rows = now
    fault = F.when(F.col("ptr").isNotNull(), "cycle").when(F.col("dangling"), "dangling")
    return state.select("id", fault.alias("fault")).where("fault is not null")


# ---------------------------------------------------------------- bill of materials
def bom_edges(edges: DataFrame, nodes: DataFrame, root_id) -> DataFrame:
    """Edges a bill of materials may use: product scope on this root anywhere, generic scope only
    below the product, parts and materials only."""
    kind = lambda name: nodes.select(F.col("id").alias(f"{name}_node_id"), F.col("kind").alias(f"{name}_kind"))
    rows = edges.where(F.col("predicate").isin("PART_OF", "INPUT_TO"))
    rows = rows.join(kind("source"), "source_node_id").join(kind("target"), "target_node_id")
    own = (F.col("scope_type") == "product") & (
        F.coalesce("scope_product_id", F.lit("")) == F.lit(root_id)
    )
    generic = (F.col("scope_type") == "generic") & (F.col("target_kind") != "product")
    return rows.where(
        F.col("source_kind").isin("component", "material")
        & F.col("target_kind").isin("product", "component", "material")
        & (own | generic)
    )


def bom_view(edges: DataFrame, nodes: DataFrame, root_id) -> DataFrame:
    """Bill-of-materials rows with the shortest eligible depth, unknown quantities kept NULL."""
    eligible = materialize(bom_edges(edges, nodes, root_id))
    root = nodes.where(F.col("id") == root_id).select("id")
    depth = levels(eligible, root)
    parents = depth.select(F.col("id").alias("target_node_id"))
    own = depth.select(F.col("id").alias("source_node_id"), "tier")
    names = nodes.select(F.col("id").alias("source_node_id"), F.col("label").alias("name"))
    rows = (
        eligible.join(parents, "target_node_id", "left_semi")
        .join(own, "source_node_id")
        .join(names, "source_node_id")
    )
    quantity_label = F.when(
        F.col("quantity").isNotNull(),
        F.when(F.col("operational_provenance"), "user_asserted").otherwise(F.col("support_label")),
    )
    return rows.select(
        F.col("source_node_id").alias("node_id"),
        "name",
        F.col("source_kind").alias("kind"),
        F.col("tier").cast("int").alias("tier"),
        F.col("target_node_id").alias("parent_node_id"),
        "edge_id",
        "quantity",
        "unit",
        quantity_label.alias("quantity_support_label"),
        "support_label",
        "scope_type",
    )


def bom_order(rows):
    return rows.orderBy("tier", "name", "edge_id")


def bom_coverage(rows: DataFrame) -> DataFrame:
    """Percentage of rows directly supported; 0 for an empty bill."""
    share = F.avg((F.col("support_label") == "directly_supported").cast("double")) * 100
    return rows.agg(F.count("*").alias("rows"), F.coalesce(share, F.lit(0.0)).alias("coverage_pct"))


def bom_filter(rows, kind=None, text=None):
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if text:
        rows = rows.where(F.contains(F.lower("name"), F.lit(text.lower())))
    return rows


def node_search(nodes, edges, text, kind=None, root_id=None) -> DataFrame:
    """Nodes whose label, aliases or identifiers contain the text, the root, and the neighbours of
    the matches; `hit` tells a match from a neighbour."""
    words = F.lower(F.concat_ws(" ", "label", F.col("aliases"), F.map_values("external_ids")))
    match = F.contains(words, F.lit(text.lower()))
    if kind:
        match = match & (F.col("kind") == kind)
    if root_id is not None:
        match = match | (F.col("id") == root_id)
    hits = nodes.where(match).select("id")
    around = neighbours(edges).join(hits, "id", "left_semi").select(F.col("neighbour_id").alias("id"))
    ids = (
        hits.select("id", F.lit(True).alias("hit"))
        .union(around.select("id", F.lit(False)))
        .groupBy("id")
        .agg(F.bool_or("hit").alias("hit"))
    )
    return nodes.join(ids, "id")
