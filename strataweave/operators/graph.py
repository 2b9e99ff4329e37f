"""Graph operators over nodes (id, ..) and edges (src, rel_type, dst, ..): audits, paths, hierarchies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import rules
from .flags import literal_map


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "id", "left_anti")


def classify_orphans(nodes: DataFrame, edges: DataFrame, episodic: Sequence[str], knowledge: Sequence[str]) -> DataFrame:
    has = lambda labels: F.arrays_overlap("labels", F.array(*map(F.lit, labels)))
    return orphans(nodes, edges).withColumn("orphan_class", F.when(has(episodic), "episodic").when(has(knowledge), "knowledge").otherwise("unclassified"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose source or target is missing, with ``side``."""
    known = nodes.select("id")
    return edges.join(known.toDF("src"), "src", "left_anti").select("src", "rel_type", "dst", F.lit("source").alias("side")).union(
        edges.join(known.toDF("dst"), "dst", "left_anti").select("src", "rel_type", "dst", F.lit("target").alias("side")))


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges joined to both end nodes; columns come as src_<c> and dst_<c>."""
    for side in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
    return edges


#: Ids of a step that are sent to every task, so that edges are read and not shuffled: some 100 bytes each.
SENT_IDS = 300_000


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, sent: int = SENT_IDS) -> DataFrame:
    """(id, distance) of what is within ``depth`` undirected steps of the start ids; one join a step on what is new.

    Each step is written and counted. Up to ``sent`` new ids are broadcast, which leaves edges where they are; more are joined by a shuffle.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("a", "b")
    seen = fresh = start.select("id", F.lit(0).alias("distance")).distinct()
    for step in range(1, depth + 1):
        few = lambda df: F.broadcast(df) if df.limit(sent + 1).count() <= sent else df
        near = both.join(few(fresh.select(F.col("id").alias("a"))), "a").select(F.col("b").alias("id")).distinct()
        fresh = materialize(near.join(few(seen.select("id")), "id", "left_anti").withColumn("distance", F.lit(step)), "neighbourhood")
        seen = seen.union(fresh)
    return seen


def neighbourhood_paths(edges: DataFrame, start: DataFrame, depth: int, sent: int = SENT_IDS // 4) -> DataFrame:
    """(id, distance, paths) of what is within ``depth`` undirected steps of the start ids: the shortest way, and the relationship types of all ways there (joined by commas, sorted), on which no edge comes twice.

    Steps are written and counted as in ``neighbourhood``. Ways are kept with their edges until the last step, of which ends and types alone are left, so that work grows with the ways of ``depth`` - 1 steps.
    """
    edge = F.struct("src", "rel_type", "dst")
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type", edge.alias("edge"))
    both = out.union(edges.filter("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel_type", edge.alias("edge")))
    now = start.select(F.col("id").alias("a"), F.array().cast("array<string>").alias("path"), F.filter(F.array(F.lit(None).cast(out.schema["edge"].dataType)), lambda x: F.lit(False)).alias("used")).distinct()
    every = now.select("a", "path")
    for step in range(1, depth + 1):
        few = F.broadcast(now) if now.limit(sent + 1).count() <= sent else now
        further = both.join(few, "a").filter(~F.array_contains("used", F.col("edge")))
        used = [F.array_append("used", F.col("edge")).alias("used")] * (step < depth)
        now = materialize(further.select(F.col("b").alias("a"), F.array_append("path", F.col("rel_type")).alias("path"), *used).distinct(), "ways")
        every = every.union(now.select("a", "path"))
    return every.groupBy(F.col("a").alias("id")).agg(F.min(F.size("path")).alias("distance"), F.array_sort(F.collect_set(F.array_join("path", ","))).alias("paths"))


def path_frequency(edges: DataFrame) -> DataFrame:
    """(depth, n): directed paths of one to three different edges, of distinct (src, dst).

    Paths are counted, not made: by degrees at their middle, less those that use an edge twice (loops, and an edge after its reverse).
    """
    e = materialize(edges.select("src", "dst").distinct(), "paths")
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outs"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("ins"))
    degree = materialize(out.join(into, "id", "full").fillna(0), "paths-degrees")
    loops = e.filter("src = dst").select(F.col("src").alias("id")).join(degree, "id").agg(F.count("*").alias("loops"), F.coalesce(F.sum(F.col("ins") + F.col("outs")), F.lit(0)).alias("at_loops"))
    two = degree.agg(F.coalesce(F.sum(F.col("ins") * F.col("outs")), F.lit(0)).alias("two"))
    around = e.join(degree.select(F.col("id").alias("src"), "ins"), "src").join(degree.select(F.col("id").alias("dst"), "outs"), "dst").agg(F.coalesce(F.sum(F.col("ins") * F.col("outs")), F.lit(0)).alias("three"))
    turned = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").agg(F.count("*").alias("turned"))
    one = e.agg(F.count("*").alias("one")).join(two, F.lit(True)).join(around, F.lit(True)).join(loops, F.lit(True)).join(turned, F.lit(True))  # a row each
    counts = (F.col("one"), F.col("two") - F.col("loops"), F.col("three") - F.col("at_loops") - F.col("turned") + 2 * F.col("loops"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("depth"), n.alias("n")) for k, n in enumerate(counts, 1)))).alias("p")).select("p.*")


def inverse_edges(edges: DataFrame, inverses=rules.INVERSES) -> DataFrame:
    """Edges and, for types with an inverse, the edges turned round."""
    inverse = F.element_at(literal_map(inverses), F.col("rel_type"))
    turned = edges.withColumn("inverse", inverse).filter("inverse is not null").select(F.col("dst").alias("src"), F.col("inverse").alias("rel_type"), F.col("src").alias("dst"))
    return edges.select("src", "rel_type", "dst").union(turned)


def transitive_suggestions(edges: DataFrame, types: Sequence[str] = rules.TRANSITIVE) -> DataFrame:
    """a -> c for a -> b -> c of one transitive type, where no such edge exists."""
    e = edges.filter(F.col("rel_type").isin(*types)).select("src", "rel_type", "dst")
    two = e.alias("x").join(e.alias("y"), (F.col("x.dst") == F.col("y.src")) & (F.col("x.rel_type") == F.col("y.rel_type")))
    return two.select(F.col("x.src").alias("src"), F.col("x.rel_type").alias("rel_type"), F.col("y.dst").alias("dst")).filter("src <> dst").distinct().join(e, ["src", "rel_type", "dst"], "left_anti")


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) joined by directed paths, by semi-naive steps; each step is written."""
    e = edges.select("src", "dst").distinct()
    known = fresh = materialize(e, "closure")
    while fresh.limit(1).count():
        step = fresh.join(e.toDF("dst", "next"), "dst").select("src", F.col("next").alias("dst")).distinct()
        fresh = materialize(step.join(known, ["src", "dst"], "left_anti"), "closure")
        known = known.union(fresh)
    return known


def _jumps(links: DataFrame) -> DataFrame:
    """node, to, far of the nodes with exactly one parent: the first ancestor that has none or several, and how far it is; no row on or below a cycle of single parents.

    By pointer doubling: after a round a pointer spans twice as many links, so rounds are the logarithm of the longest chain. Each node is one row a round at most.
    """
    single = links.groupBy("child").agg(F.min("parent").alias("to"), F.count("*").alias("_n")).filter("_n = 1").select(F.col("child").alias("node"), "to", F.lit(1).cast("long").alias("far"))
    further = single.select(F.col("node").alias("to"), F.lit(True).alias("open"))
    now = materialize(single.join(further, "to", "left").select("node", "to", "far", F.coalesce("open", F.lit(False)).alias("open")), "jumps")
    for _ in range(now.count().bit_length() + 1):
        following = now.select(F.col("node").alias("to"), F.col("to").alias("_next"), F.col("far").alias("_more"), F.col("open").alias("_open"))
        moved = now.filter("open").join(following, "to").select("node", F.col("_next").alias("to"), (F.col("far") + F.col("_more")).alias("far"), F.col("_open").alias("open"))
        now = materialize(now.filter("not open").unionByName(moved), "jumps")
        if now.filter("open").isEmpty():
            break
    return now.filter("not open").drop("open")


def hierarchy_depth(tree: DataFrame) -> DataFrame:
    """(node, depth, cyclic): longest path to a root (a node without parent); what never resolves lies on or below a cycle.

    Chains of single parents are spanned by doubling first. What is left are nodes with several parents, each settled once all that it hangs from are: a round a level of such nodes, however long the chains between
    them are. Rows with a null end are left out.
    """
    links = materialize(tree.select("child", "parent").dropna().distinct(), "tree")
    nodes = links.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    roots = nodes.join(links.select(F.col("child").alias("node")), "node", "left_anti")
    jumps = _jumps(links)
    several = links.groupBy("child").agg(F.count("*").alias("parents")).filter("parents > 1")
    up = links.join(several, "child").join(jumps.select(F.col("node").alias("parent"), F.col("to").alias("_to"), "far"), "parent", "left")
    alone = links.groupBy("child").agg(F.count("*").alias("_k")).filter("_k = 1").select(F.col("child").alias("parent"), F.lit(True).alias("_single"))
    # A single parent without a jump leads into a cycle: what hangs from it never settles.
    up = up.join(alone, "parent", "left").select("child", "parents", F.when(F.col("_to").isNotNull(), F.col("_to")).when(F.col("_single").isNull(), F.col("parent")).alias("to"), (1 + F.coalesce("far", F.lit(0))).alias("far"))
    up = materialize(up, "branches")
    done = materialize(roots.withColumn("depth", F.lit(0).cast("long")), "depths")
    while True:
        met = up.join(done.select(F.col("node").alias("to"), "depth"), "to").groupBy("child", "parents").agg(F.count("*").alias("k"), F.max(F.col("depth") + F.col("far")).alias("depth"))
        fresh = materialize(met.filter("k = parents").select(F.col("child").alias("node"), "depth").join(done, "node", "left_anti"), "depths")
        if fresh.isEmpty():
            break
        done = done.unionByName(fresh)
    along = jumps.join(done.select(F.col("node").alias("to"), "depth"), "to").select("node", (F.col("depth") + F.col("far")).alias("depth"))
    return nodes.join(done.unionByName(along), "node", "left").select("node", F.col("depth").cast("int").alias("depth"), F.col("depth").isNull().alias("cyclic"))


def cycles(tree: DataFrame, most: int | None = None) -> DataFrame:
    """Directed cycles, once each, as paths from their least node: all of them, or the first ``most`` by length, then name.

    Only nodes that settle in ``hierarchy_depth`` neither upwards nor downwards are kept: those on cycles or between them. Paths grow a link a round, so with ``most`` the work ends at the length that completes the
    number; without it, dense cyclic parts have very many cycles, all of which are listed.
    """
    e = materialize(tree.select("child", "parent").dropna().distinct(), "cyclic")
    for turned in (False, True):
        a, b = ("parent", "child") if turned else ("child", "parent")
        loose = hierarchy_depth(e.select(F.col(a).alias("child"), F.col(b).alias("parent"))).filter("cyclic").select("node")
        e = materialize(e.join(loose.toDF("child"), "child", "left_semi").join(loose.toDF("parent"), "parent", "left_semi"), "cyclic")
    paths = e.filter("parent >= child").select(F.array("child").alias("path"), F.col("parent").alias("end"))
    found, count = [], 0
    while True:
        found.append(materialize(paths.filter("end = path[0]").select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("_n")), "cycles"))
        if most is not None and (count := count + found[-1].limit(most).count()) >= most:
            break
        grown = paths.filter("end > path[0] and not array_contains(path, end)").join(e, F.col("end") == F.col("child"))
        paths = materialize(grown.select(F.array_append("path", F.col("end")).alias("path"), F.col("parent").alias("end")), "cycle-paths")
        if paths.isEmpty():
            break
    every = reduce(DataFrame.unionByName, found)
    return (every if most is None else every.orderBy("_n", "cycle").limit(most)).select("cycle")


def graph_totals(nodes: DataFrame, edges: DataFrame, bands=rules.SEVERITY_BANDS) -> DataFrame:
    """One row: entities, relationships, orphans, orphan_rate, severity."""
    one = nodes.agg(F.count("*").alias("entities")).join(edges.agg(F.count("*").alias("relationships")), F.lit(True)).join(orphans(nodes, edges).agg(F.count("*").alias("orphans")), F.lit(True))
    rate = F.try_divide("orphans", "entities")
    return one.withColumn("orphan_rate", F.round(rate, 6)).withColumn("severity", banded(rate, bands, "low"))


def banded(value: Column, bands: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first band whose limit the value reaches."""
    out = None
    for limit, name in bands:
        out = F.when(value >= limit, name) if out is None else out.when(value >= limit, name)
    return out.otherwise(otherwise)


def subgraph_stats(nodes: DataFrame, edges: DataFrame, document: Sequence[str]) -> DataFrame:
    """subgraph (document or knowledge), nodes, average degree, isolated."""
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    joined = nodes.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    part = F.when(F.arrays_overlap("labels", F.array(*map(F.lit, document))), "document").otherwise("knowledge")
    return joined.groupBy(part.alias("subgraph")).agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 6).alias("average_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))


def cross_reference_validity(edges: DataFrame, nodes: DataFrame, allowed=rules.EDGE_RULES) -> DataFrame:
    """Edges with ``valid``: some rule of their type allows one label of each end (* for any, also for an end without a node); unknown types pass."""
    table = edges.sparkSession.createDataFrame(list(allowed), "rel_type string, from_class string, to_class string")
    labels = nodes.select("id", "labels")
    ends = edges.select("src", "rel_type", "dst").join(labels.toDF("src", "src_labels"), "src", "left").join(labels.toDF("dst", "dst_labels"), "dst", "left")
    fits = lambda rule, own: (F.col(rule) == "*") | F.coalesce(F.array_contains(own, F.col(rule)), F.lit(False))
    joined = ends.join(F.broadcast(table), "rel_type", "left")
    valid = F.when(F.col("from_class").isNull(), True).otherwise(fits("from_class", "src_labels") & fits("to_class", "dst_labels"))
    return joined.groupBy("src", "rel_type", "dst").agg(F.max(valid).alias("valid"))


def layer_inversions(edges: DataFrame, nodes: DataFrame, layers: Sequence[str] = rules.LAYERS) -> DataFrame:
    """Edges whose source layer ranks above the target's."""
    rank = F.array_position(F.array(*map(F.lit, layers)), F.col("layer"))
    return with_ends(edges, nodes.filter("layer is not null").withColumn("rank", rank), "layer", "rank").filter("src_rank > dst_rank")


def node_detail(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """One row a neighbour of the node: direction, rel_type, other, other_name."""
    out = edges.filter(F.col("src") == node_id).select(F.lit("out").alias("direction"), "rel_type", F.col("dst").alias("other"))
    into = edges.filter(F.col("dst") == node_id).select(F.lit("in").alias("direction"), "rel_type", F.col("src").alias("other"))
    return out.union(into).join(nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other", "left")


def graph_slice(nodes: DataFrame, edges: DataFrame, limit: int, layer: str | None = None) -> DataFrame:
    """The first nodes by id (of one layer) with their outgoing edges."""
    chosen = (nodes.filter(F.col("layer") == layer) if layer else nodes).orderBy("id").limit(limit)
    return chosen.select("id", "name").join(edges.select(F.col("src").alias("id"), "rel_type", "dst"), "id", "left")
