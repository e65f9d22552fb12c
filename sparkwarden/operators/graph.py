"""Code-graph operators over two tables, nodes and relations.

Traversals are batched: many roots travel together, keyed by ``(repo_name, root_id)``, and every
level is an equi-join of a frontier with an edge list.  No result is brought to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwarden.functions import fixed_values as fv
from sparkwarden.functions import paths as px
from sparkwarden.session import reliable_checkpoint

WIDTH = 1  # prefixes of a level, as a multiple of the paths asked for; a start, never a cut
EDGE_KEY = ("repo_name", "from_id", "relation_type", "to_id", "step")


class Subgraph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame

    def stats(self) -> DataFrame:
        """Per root: node and edge counts."""
        keys = ["repo_name", "root_id"]
        n = self.nodes.groupBy(*keys).agg(F.count("*").alias("total_nodes"))
        e = self.edges.groupBy(*keys).agg(F.count("*").alias("total_edges"))
        return n.join(e, keys, "left").fillna(0, ["total_edges"])


def contains_ci(column: str, needle: str, raw_like: bool = False) -> Column:
    """Case-insensitive substring; ``raw_like`` keeps % and _ of the needle as wildcards."""
    if raw_like:
        return F.ilike(F.col(column), F.lit(f"%{needle}%"))
    return F.lower(F.col(column)).contains(needle.lower())


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order: a top-k per task, not a global sort."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page_after(df: DataFrame, order: Sequence[str], after: Sequence, limit: int) -> DataFrame:
    """Keyset page for deep paging: the first ``limit`` rows behind the given key, so no offset rows are carried.

    ``order`` is a total order; ``after`` may give its first columns only and is then behind all rows that share them.
    """
    beyond = F.lit(False)
    for i, name in enumerate(order[:len(after)]):
        equal = F.lit(True)
        for j in range(i):
            equal = equal & (F.col(order[j]) == F.lit(after[j]))
        beyond = beyond | (equal & (F.col(name) > F.lit(after[i])))
    return page(df.filter(beyond), list(order), limit)


def select_nodes(nodes: DataFrame, repo: str, label: str | None = None, file_path: str | None = None,
                 limit: int = 10_000, offset: int = 0, raw_like: bool = False) -> DataFrame:
    out = nodes.filter(F.col("repo_name") == repo)
    if label:
        out = out.filter(F.col("label") == label)
    if file_path:
        out = out.filter(contains_ci("file_path", file_path, raw_like))
    return page(out, ["label", "name", "id"], limit, offset)


def select_relations(edges: DataFrame, repo: str, relation_type: str | None = None,
                     from_id: str | None = None, to_id: str | None = None,
                     limit: int = 500, offset: int = 0) -> DataFrame:
    out = edges.filter(F.col("repo_name") == repo)
    for name, value in (("relation_type", relation_type), ("from_id", from_id), ("to_id", to_id)):
        if value:
            out = out.filter(F.col(name) == value)
    return page(out, ["relation_type", "from_id", "to_id", "step"], limit, offset)


def edges_touching(edges: DataFrame, ids: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Edges with either end in ``ids`` (repo_name, id).

    An OR over two columns cannot be hashed, so the ends are looked up one after the other: all
    edges whose source is listed, and of those whose target is listed the ones whose source is not.  The ids
    are written first, so that few of them are sent to the edges instead of shuffling these.
    """
    wanted = edges.filter(~F.col("relation_type").isin(*exclude)) if exclude else edges
    listed = reliable_checkpoint(ids.select("repo_name", "id").distinct())
    by_from, by_to = listed.withColumnRenamed("id", "from_id"), listed.withColumnRenamed("id", "to_id")
    outgoing = wanted.join(by_from, ["repo_name", "from_id"], "left_semi")
    incoming = wanted.join(by_to, ["repo_name", "to_id"], "left_semi").join(by_from, ["repo_name", "from_id"], "left_anti")
    return outgoing.unionByName(incoming.select(*outgoing.columns))


def nodes_by_ids(nodes: DataFrame, ids: DataFrame, exclude_labels: Sequence[str] = (),
                 file_path: str | None = None, include_content: bool = False) -> DataFrame:
    out = nodes if include_content or "content" not in nodes.columns else nodes.drop("content")
    if exclude_labels:
        out = out.filter(~F.col("label").isin(*exclude_labels))
    if file_path:
        out = out.filter(F.col("file_path") == file_path)
    return out.join(ids.select("repo_name", "id").distinct(), ["repo_name", "id"], "left_semi")


def exclude_noise(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.col("label").isin(*fv.NOISE_LABELS))


def exclude_meta_relations(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("relation_type").isin(*fv.META_RELATIONS))


def resolve_file_nodes(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``node_id`` to ``files`` (repo_name, file_path): the exact File identifier when it
    exists, else a File node with that path, else NULL; blank paths resolve to NULL."""
    asked = files.withColumn("__id", F.concat(F.lit("File:"), F.col("file_path")))
    exact = nodes.select("repo_name", F.col("id").alias("__id"), F.col("id").alias("__exact")).distinct()
    by_path = nodes.filter(F.col("label") == "File").groupBy("repo_name", "file_path").agg(
        F.min("id").alias("__by_path"))
    blank = F.trim(F.coalesce(F.col("file_path"), F.lit(""))) == ""
    return (
        asked.join(exact, ["repo_name", "__id"], "left").join(by_path, ["repo_name", "file_path"], "left")
        .withColumn("node_id", F.when(~blank, F.coalesce("__exact", "__by_path")))
        .select(*files.columns, "node_id")
    )


def node_content(nodes: DataFrame, repo: str, node_id: str) -> DataFrame:
    return nodes.filter((F.col("repo_name") == repo) & (F.col("id") == node_id)).select(
        "repo_name", "id", "content")


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def group_members(nodes: DataFrame, edges: DataFrame, label: str = "Process",
                  relation: str = "STEP_IN_PROCESS") -> DataFrame:
    """Long form of processes or communities: one row per member with its step and position.

    ``Community`` goes with ``MEMBER_OF``.  The long form stays whole for a group of any size.
    """
    groups = nodes.filter(F.col("label") == label).select(
        "repo_name", F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    members = edges.filter(F.col("relation_type") == relation).select(
        "repo_name", F.col("to_id").alias("group_id"), F.col("from_id").alias("member_id"), "step")
    return groups.join(members, ["repo_name", "group_id"], "left")


def group_sizes(nodes: DataFrame, edges: DataFrame, label: str = "Process",
                relation: str = "STEP_IN_PROCESS") -> DataFrame:
    return group_members(nodes, edges, label, relation).groupBy(
        "repo_name", "group_id", "group_name").agg(
        F.count("member_id").alias("members"),
        F.min(F.struct("step", "member_id")).getField("member_id").alias("first_member"))


def full_graph(nodes: DataFrame, edges: DataFrame, repo: str,
               excluded_labels: Sequence[str] | None = None,
               excluded_relations: Sequence[str] | None = None,
               limit: int = 5000, offset: int = 0) -> Subgraph:
    """A page of nodes with the edges it induces; an empty list excludes nothing."""
    labels = fv.NOISE_LABELS if excluded_labels is None else excluded_labels
    kinds = fv.META_RELATIONS if excluded_relations is None else excluded_relations
    kept = nodes.filter(F.col("repo_name") == repo)
    if labels:
        kept = kept.filter(~F.col("label").isin(*labels))
    chosen = page(kept, ["label", "name", "id"], limit, offset).withColumn(
        "display_name", px.display_name("name"))
    links = edges.filter(F.col("repo_name") == repo)
    if kinds:
        links = links.filter(~F.col("relation_type").isin(*kinds))
    ids = chosen.select("repo_name", "id")
    links = links.join(ids.withColumnRenamed("id", "from_id"), ["repo_name", "from_id"], "left_semi")
    links = links.join(ids.withColumnRenamed("id", "to_id"), ["repo_name", "to_id"], "left_semi")
    return Subgraph(chosen, links)


def _mirrored(edges: DataFrame) -> DataFrame:
    there = edges.select("repo_name", F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    back = edges.select("repo_name", F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return there.unionByName(back)


def neighbourhood(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 1,
                  same_file: bool = True, include_variables: bool = False,
                  include_meta_relations: bool = False, include_content: bool = False) -> Subgraph:
    """Undirected neighbourhood of every root in ``roots`` (repo_name, root_id).

    Depth is held to 1..3.  Only kept nodes expand.  An edge belongs to the result when both ends
    are kept and at least one of them lies above the last level.  The visited nodes are
    checkpointed, because nodes, edges and everything built on them read the same set.
    """
    depth = max(1, min(depth, 3))
    links = edges if include_meta_relations else exclude_meta_relations(edges)
    noise = [x for x in fv.NOISE_LABELS if not (include_variables and x == "Variable")]
    # Contents stay behind; the small columns of a node travel with it.
    facts = (nodes.drop("content") if "content" in nodes.columns else nodes).withColumnRenamed("id", "node_id")
    fields = [c for c in facts.columns if c not in ("repo_name", "node_id")]

    start = (
        roots.select("repo_name", F.col("root_id").alias("node_id")).distinct()
        .join(facts, ["repo_name", "node_id"])
        .select("repo_name", F.col("node_id").alias("root_id"), "node_id", *fields,
                F.nullif("file_path", F.lit("")).alias("root_path"),
                F.col("label").isin(*fv.CONTAINER_LABELS).alias("root_is_container"),
                F.lit(0).alias("level"))
    )
    # Frontiers are written before they meet the edges or nodes: a small one is then sent to them instead of shuffling all of them.
    start = reliable_checkpoint(start)
    around = _mirrored(links)
    keep = ~F.col("label").isin(*noise)
    if same_file:
        keep = keep & (F.col("root_is_container") | ~F.col("label").isin(*fv.CONTAINER_LABELS))
        keep = keep & (F.col("root_path").isNull() | (F.col("file_path") == F.col("root_path")))
    keys = ["repo_name", "root_id", "node_id"]

    levels = [start]
    for level in range(1, depth + 1):
        # Neighbours of one level can only lie on that level or on the two beside it, so two
        # levels are enough to tell new nodes from visited ones.
        seen = levels[-1].select(*keys)
        if len(levels) > 1:
            seen = seen.unionByName(levels[-2].select(*keys))
        reached = (
            levels[-1].select("repo_name", "root_id", F.col("node_id").alias("src"), "root_path", "root_is_container")
            .join(around, ["repo_name", "src"])
            .select("repo_name", "root_id", F.col("dst").alias("node_id"), "root_path", "root_is_container")
            .distinct()
            .join(seen, keys, "left_anti")
        )
        found = reliable_checkpoint(reached).join(facts, ["repo_name", "node_id"]).filter(keep).select(
            *keys, *fields, "root_path", "root_is_container", F.lit(level).alias("level"))
        # The next level and the result both read this one.
        levels.append(reliable_checkpoint(found) if level < depth else found)
    visited = levels[0]
    for part in levels[1:]:
        visited = visited.unionByName(part)
    visited = reliable_checkpoint(visited.drop("root_path", "root_is_container"))

    named = visited.withColumn("display_name", px.display_name("name"))
    if include_content and "content" in nodes.columns:
        named = named.join(nodes.select("repo_name", F.col("id").alias("node_id"), "content"),
                           ["repo_name", "node_id"], "left")
    # Edges are looked up from the inner nodes only: a hub on the last level, which many roots may
    # share, never meets its own edges.  They come from their own tables, whose size is known, not from that of all levels.
    inner = levels[0].select("repo_name", "root_id", "node_id")
    for part in levels[1:-1]:
        inner = inner.unionByName(part.select("repo_name", "root_id", "node_id"))
    outer = visited.filter(F.col("level") == depth).select("repo_name", "root_id", "node_id")
    every = visited.select("repo_name", "root_id", "node_id")

    def between(first: DataFrame, end: str, second: DataFrame, other: str) -> DataFrame:
        return links.join(first.withColumnRenamed("node_id", end), ["repo_name", end]).join(
            second.withColumnRenamed("node_id", other), ["repo_name", "root_id", other]).select(
            *links.columns, "root_id")

    inside = between(inner, "from_id", every, "to_id").unionByName(between(inner, "to_id", outer, "from_id"))
    return Subgraph(named, inside)


def _calls_behind(calls: DataFrame, targets: DataFrame, max_depth: int) -> DataFrame:
    """The calls that walks of at most ``max_depth`` steps back from the targets can take.

    The nodes of each step are written before they meet the calls, so few of them shuffle nothing else.
    """
    level = reliable_checkpoint(targets.select("repo_name", F.col("target_id").alias("node")).distinct())
    seen, found = level, None
    for depth in range(1, max_depth + 1):
        part = reliable_checkpoint(calls.join(level, ["repo_name", "node"], "left_semi"))
        found = part if found is None else found.unionByName(part)
        if depth == max_depth:
            break
        level = reliable_checkpoint(part.select("repo_name", F.col("caller").alias("node")).distinct().join(seen, ["repo_name", "node"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return found


def _walk_heights(calls: DataFrame, max_depth: int) -> DataFrame:
    """(repo_name, node, height): the longest backward walk from each node that has a caller, at most ``max_depth`` steps."""
    level = reliable_checkpoint(calls.select("repo_name", "node").distinct())
    found = level.withColumn("height", F.lit(1))
    for height in range(2, max_depth + 1):
        level = reliable_checkpoint(calls.join(level.withColumnRenamed("node", "caller"), ["repo_name", "caller"], "left_semi").select("repo_name", "node").distinct())
        if level.isEmpty():
            break
        found = found.unionByName(level.withColumn("height", F.lit(height)))
    return found.groupBy("repo_name", "node").agg(F.max("height").alias("height"))


def _nearest(calls: DataFrame, cap: int, count: int) -> DataFrame:
    """The calls of the first ``count`` callers of each node, those of the greatest height (``cap`` at most) first, with the caller's ``place``."""
    order = W.partitionBy("repo_name", "node").orderBy(F.desc(F.least(F.col("height"), F.lit(cap))), "caller")
    return calls.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= count)


def _first_step(calls: DataFrame, targets: DataFrame, *kept: str) -> DataFrame:
    return targets.select("repo_name", F.col("target_id"), F.col("target_id").alias("node")).distinct().join(calls, ["repo_name", "node"]).select(
        "repo_name", "target_id", F.col("caller").alias("node"), F.lit(1).alias("depth"), F.array("target_id", "caller").alias("path"), *kept)


def _longer(calls: DataFrame, level: DataFrame, *kept: str) -> DataFrame:
    return level.join(calls, ["repo_name", "node"]).filter(~F.array_contains("path", F.col("caller"))).select(
        "repo_name", "target_id", F.col("caller").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("caller")).alias("path"), *kept)


def _next_step(calls: DataFrame, level: DataFrame, depth: int, width: int) -> DataFrame:
    """The prefixes one call longer that can be among the first ``width + 1`` of their target.

    Prefixes stand in the order of their reach, then path.  A prefix goes on to its full reach with each of its ``branches``, but for those it holds already (a node of
    its path each), and these longer prefixes come before all that go on from the prefixes behind it.  So with ``before`` of them only so many callers more are asked.
    """
    room = width + 1 - F.col("before")
    onward = level.filter((F.col("reach") > depth) & (room > 0)).select("repo_name", "target_id", "node", "depth", "path", (room + depth + 1).alias("room"))
    longer = _longer(calls.filter(F.col("place") <= width + depth + 2), onward, "height", "branches", "place", "room")
    return longer.filter(F.col("place") <= F.col("room")).drop("place", "room")


def _deepest_paths(calls: DataFrame, targets: DataFrame, max_depth: int, top: int, width: int) -> DataFrame:
    """The ``top`` deepest paths of each target, ties by the path, with their rank.

    A level keeps ``width`` prefixes per target, those of the greatest reach first: their depth plus the longest walk that goes on from their end
    (``height``, which a call holds of its caller).  The first prefix left out bounds all others.  A target is settled when none of these bounds comes before its last result;
    the others are walked again with a wider level, so the result is exact.  Without cycles every prefix kept goes as far as it reaches, and ``top`` of them settle a target.
    Callers that cannot enter a level are never joined: of a node the first ``width + 1`` and as many as a path may hold, fewer where prefixes before it fill the level.
    """
    left, results = targets.select("repo_name", "target_id").distinct(), None
    highest = calls.agg(F.max("height")).first()[0]
    while True:
        count = width + max_depth + 2
        near = reliable_checkpoint(_nearest(calls, max_depth - 1, count))
        # callers (of those kept) with which a path through a node goes on to its full reach
        first = F.max(F.struct(F.least(F.col("height"), F.lit(max_depth - 1)).alias("h"), "place")).getField("place")
        wide = reliable_checkpoint(near.groupBy("repo_name", F.col("node").alias("caller")).agg(first.alias("branches")))
        branched = lambda part: reliable_checkpoint(part.join(wide, ["repo_name", "caller"], "left").fillna(0, ["branches"]))
        steps = branched(near)
        level, found, out = _first_step(steps.filter(F.col("place") <= width + 1), left, "height", "branches"), None, None
        for depth in range(1, max_depth + 1):
            reach = F.col("depth") + F.least(F.col("height"), F.lit(max_depth) - F.col("depth"))
            order = W.partitionBy("repo_name", "target_id").orderBy(F.desc("reach"), "path")
            level = level.withColumn("reach", reach).drop("height").withColumns({"__r": F.row_number().over(order), "__alike": F.rank().over(order)}).filter(F.col("__r") <= width + 1)
            # Equal prefixes (of repeated calls) go on to equal paths, so they count once and not for each other.
            sure = F.greatest(F.col("branches") - depth - 1, F.lit(0))
            so_far = F.sum(F.when(F.col("__r") == F.col("__alike"), sure).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
            level = reliable_checkpoint(level.withColumn("before", so_far - sure).drop("branches", "__alike"))
            if level.isEmpty():
                break
            kept, cut = level.filter(F.col("__r") <= width), level.filter(F.col("__r") > width).select("repo_name", "target_id", "reach", "path")
            found = kept if found is None else found.unionByName(kept)
            out = cut if out is None else out.unionByName(cut)
            if depth < max_depth and max_depth - depth - 1 < highest:  # near the last level heights are cut, which changes the order of the callers
                steps = branched(_nearest(calls, max_depth - depth - 1, count))
            level = _next_step(steps, kept, depth, width)
        if found is None:
            found, out = level, level.select("repo_name", "target_id", "reach", "path")
        order = W.partitionBy("repo_name", "target_id").orderBy(F.desc("depth"), "path")
        best = reliable_checkpoint(found.select("repo_name", "target_id", "depth", "path").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
        last = best.filter(F.col("rank") == top).select("repo_name", "target_id", F.col("depth").alias("depth_k"), F.col("path").alias("path_k"))
        before = F.col("depth_k").isNull() | (F.col("reach") > F.col("depth_k")) | ((F.col("reach") == F.col("depth_k")) & (F.col("path") < F.col("path_k")))
        again = reliable_checkpoint(out.join(last, ["repo_name", "target_id"], "left").filter(before).select("repo_name", "target_id").distinct())
        if again.isEmpty():
            return best if results is None else results.unionByName(best)
        settled = best.join(again, ["repo_name", "target_id"], "left_anti")
        results = settled if results is None else results.unionByName(settled)
        left, width = again, width * 8


def call_paths(edges: DataFrame, targets: DataFrame, max_depth: int = 10,
               exclude_nodes: Sequence[str] = (), top: int | None = 10,
               relations: Sequence[str] = fv.PATH_RELATIONS) -> DataFrame:
    """Backward paths into every target of ``targets`` (repo_name, target_id).

    Every prefix is a row.  ``path`` runs from the target to the farthest caller and never visits
    a node twice.  With ``top`` the deepest paths of each target remain, ties ordered by the path, and
    only prefixes that can still be among them are walked.  Without it all simple paths are walked.  Each level
    is written, so the plan stays small and the walk stops at the first empty level, whatever the depth.
    """
    wanted = edges.filter(F.col("relation_type").isin(*relations))
    if exclude_nodes:
        banned = list(exclude_nodes)
        wanted = wanted.filter(~F.col("from_id").isin(*banned) & ~F.col("to_id").isin(*banned))
    calls = wanted.select("repo_name", F.col("from_id").alias("caller"), F.col("to_id").alias("node"))
    shown = ("repo_name", "target_id", "depth", "path", F.array_join(F.reverse("path"), " -> ").alias("call_path"))
    if top is not None:
        calls = _calls_behind(calls, targets, max_depth)
        heights = _walk_heights(calls, max_depth).withColumnRenamed("node", "caller")
        calls = reliable_checkpoint(calls.join(heights, ["repo_name", "caller"], "left").fillna(0, ["height"]))
        return _deepest_paths(calls, targets, max_depth, top, WIDTH * top).select(*shown, "rank")
    level, found = _first_step(calls, targets), None
    for depth in range(1, max_depth + 1):
        level = reliable_checkpoint(level)
        found = level if found is None else found.unionByName(level)
        if depth == max_depth or level.isEmpty():
            break
        level = _longer(calls, level)
    return (level if found is None else found).select(*shown)


def path_contents(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Distinct nodes on the paths of each target, with their content block."""
    on_path = paths.select("repo_name", "target_id", F.explode("path").alias("id")).distinct()
    block = F.concat(F.lit("\n--- Node: "), F.col("id"), F.lit(" ---\n"),
                     F.coalesce(F.col("content"), F.lit("None")), F.lit("\n"))
    return on_path.join(nodes.select("repo_name", "id", "content"), ["repo_name", "id"]).select(
        "repo_name", "target_id", "id", block.alias("block"))


def callers(edges: DataFrame, ids: DataFrame | None = None, limit: int | None = None,
            relations: Sequence[str] = fv.CALLER_RELATIONS) -> DataFrame:
    """Edges of type CALLS or IMPORTS that arrive at each node; the type is filtered first.

    All of them, or the first ``limit`` of each node (50 in the reference).
    """
    return _adjacent(edges, ids, "to_id", "from_id", "caller_id", limit, relations)


def callees(edges: DataFrame, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    return _adjacent(edges, ids, "from_id", "to_id", "callee_id", limit, fv.CALLER_RELATIONS)


def _adjacent(edges, ids, key, other, name, limit, relations):
    out = edges.filter(F.col("relation_type").isin(*relations)).select(
        "repo_name", F.col(key).alias("node_id"), F.col(other).alias(name),
        F.col("relation_type").alias("relation"), "step")
    if ids is not None:
        out = out.join(ids.select("repo_name", "node_id").distinct(), ["repo_name", "node_id"], "left_semi")
    if limit is not None:
        order = W.partitionBy("repo_name", "node_id").orderBy("relation", name, "step")
        out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("rank")
    return out


def impact_radius(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The callers of each node: one row per node and caller, with the number of its CALLS edges (``edges``), of all that arrive
    at the node (``call_edges``) and of the node's distinct callers.

    The list stays long, so a node of any number of callers is spread.  Of ``nodes``, those that nobody calls have one row
    without a caller and with zeros.  Edges are counted per caller first, so those of one caller add up before they meet.
    """
    listed = callers(edges, relations=("CALLS",)).groupBy("repo_name", "node_id", "caller_id").agg(F.count("*").alias("edges"))
    totals = listed.groupBy("repo_name", "node_id").agg(
        F.sum("edges").alias("call_edges"), F.count("*").alias("distinct_callers"))
    out = listed.join(totals, ["repo_name", "node_id"])
    if nodes is None:
        return out
    zero = F.lit(0).cast("long")
    asked = nodes.select("repo_name", F.col("id").alias("node_id")).distinct()
    uncalled = asked.join(totals.select("repo_name", "node_id"), ["repo_name", "node_id"], "left_anti").select(
        "repo_name", "node_id", F.lit(None).cast("string").alias("caller_id"), zero.alias("edges"), zero.alias("call_edges"), zero.alias("distinct_callers"))
    return out.unionByName(uncalled)


def forward_chains(edges: DataFrame, nodes: DataFrame, starts: DataFrame, max_depth: int = 4) -> DataFrame:
    """Forward CALLS chains as display names, from each start to a sink or past ``max_depth``.

    Chains with the same names are one chain.  Self-calls do not count; longer cycles run until
    the depth cuts them.
    """
    calls = edges.filter((F.col("relation_type") == "CALLS") & (F.col("from_id") != F.col("to_id"))).select(
        "repo_name", F.col("from_id").alias("node"), F.col("to_id").alias("callee"))
    names = nodes.select("repo_name", F.col("id").alias("callee"), F.col("name").alias("callee_name"))
    named = calls.join(names, ["repo_name", "callee"], "left").withColumn(
        "callee_name", F.coalesce("callee_name", "callee")).distinct()
    live = (
        starts.select("repo_name", "start_id").distinct()
        .join(nodes.select("repo_name", F.col("id").alias("start_id"), "name"), ["repo_name", "start_id"], "left")
        .select("repo_name", "start_id", F.col("start_id").alias("node"),
                F.array(F.coalesce("name", "start_id")).alias("chain"))
    )
    # A chain grows while it has at most ``max_depth`` names.  The left join lets chains that end
    # at a sink stay in the same table, so no level is computed twice.
    for _ in range(max_depth):
        grown = live.join(named, ["repo_name", "node"], "left")
        more = F.col("callee").isNotNull()
        live = grown.select(
            "repo_name", "start_id", F.col("callee").alias("node"),
            F.when(more, F.concat("chain", F.array("callee_name"))).otherwise(F.col("chain")).alias("chain"),
        ).groupBy("repo_name", "start_id", "chain").agg(F.min("node").alias("node"))
    return live.filter(F.size("chain") > 1).select(
        "repo_name", "start_id", F.array_join("chain", " -> ").alias("chain_text"),
        F.size("chain").alias("length"))
