"""Closures, types, versions and label resolution on graphs."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import written as _written


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", reflexive: bool = False) -> DataFrame:
    """(node, ancestor, depth): smallest number of edges from node to ancestor; cycles end.

    A frontier of new pairs is joined to the edges until none is new. Each round's pairs are written to shared storage
    once, and only those not reached before go on.
    """
    e = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("child is not null and parent is not null").distinct()
    found = frontier = _written(e.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "closure")
    for depth in itertools.count(2):
        step = frontier.join(e.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("node", F.col("parent").alias("ancestor")).distinct()
        frontier = _written(step.join(found, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if depth % 25 == 0:  # one folder again, as plans grow with the rounds
            found = _written(found, "closure")
    if reflexive:
        nodes = e.select(F.col("child").alias("node")).unionByName(e.select(F.col("parent").alias("node"))).distinct()
        found = found.where("node <> ancestor").unionByName(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))
    return found


def reachable(edges: DataFrame, roots: DataFrame, root: str = "root", source: str = "child", target: str = "parent", reflexive: bool = True) -> DataFrame:
    """(root, node, depth): what each root reaches along the edges, with the smallest number of edges.

    Only the asked roots' frontier goes from round to round: it is joined to the edges, what was reached before is left
    out, and the rest is written. So what is written grows with the answer, not with the closure of all nodes; cycles end
    as their nodes are reached once. reflexive: a root reaches itself at depth 0.
    """
    e = edges.select(F.col(source).alias("node"), F.col(target).alias("next")).where("node is not null and next is not null")
    start = roots.select(F.col(root).alias("root")).where("root is not null").distinct()
    found = frontier = _written(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "reached")
    for depth in itertools.count(1):
        step = frontier.select("root", "node").join(e, "node").select("root", F.col("next").alias("node")).distinct()
        frontier = _written(step.join(found.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if depth % 25 == 0:  # one folder again, as plans grow with the rounds
            found = _written(found, "reached")
    return found if reflexive else found.where("depth > 0")


def instances_of(types: DataFrame, edges: DataFrame, cls: str) -> DataFrame:
    """Nodes whose type is the class or one below it, going down from the class alone (G7). types: (node, type); edges: (child, parent)."""
    asked = edges.sparkSession.createDataFrame([(cls,)], "root string")
    below = reachable(edges, asked, source="parent", target="child").select(F.col("node").alias("type"))
    return types.join(below, "type", "left_semi").select("node").distinct()


def evidence_of(edges: DataFrame, roots: DataFrame, types: DataFrame | None = None, classes: DataFrame | None = None, cls: str | None = None, transitive: bool = True, hide: DataFrame | None = None) -> DataFrame:
    """(root, evidence): evidence_tree() of the asked roots alone (G11). edges: child (the node) to parent (its evidence); classes: class edges (child, parent) for cls."""
    if transitive:
        below = reachable(edges, roots, reflexive=False).select("root", F.col("node").alias("evidence"))
    else:
        below = roots.select(F.col("root").alias("child")).distinct().join(edges, "child").select(F.col("child").alias("root"), F.col("parent").alias("evidence")).distinct()
    if cls is not None:
        below = below.join(instances_of(types, classes, cls).withColumnRenamed("node", "evidence"), "evidence", "left_semi")
    if hide is not None:
        below = below.join(hide, "evidence", "left_anti")
    return below.select("root", "evidence")


def path_with_inverse_end(edges: DataFrame, inverse: DataFrame) -> DataFrame:
    """e* then at most one inverse step v: (node, reached) (G4). inverse has (s, o) rows; the step goes from o to s."""
    reach = closure(edges, reflexive=True).select("node", F.col("ancestor").alias("reached"))
    back = reach.join(inverse.select(F.col("o").alias("reached"), F.col("s").alias("to")), "reached").select("node", F.col("to").alias("reached"))
    return reach.unionByName(back).distinct()


def inferred_types(types: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(node, type) with all superclasses (G5). types: (node, type); ancestors: a closure."""
    up = types.join(ancestors.select(F.col("node").alias("type"), "ancestor"), "type").select("node", F.col("ancestor").alias("type"))
    return types.select("node", "type").unionByName(up).distinct()


def dispatch(types: DataFrame, mapping: list[tuple[str, str]], default: str) -> DataFrame:
    """(node, target): the first mapping in list order whose type the node has."""
    rank = F.create_map(*[F.lit(x) for i, (t, _) in enumerate(mapping) for x in (t, i)])
    first = types.groupBy("node").agg(F.min(F.try_element_at(rank, F.col("type"))).alias("i"))
    targets = F.array(*[F.lit(t) for _, t in mapping])
    return first.select("node", F.when(F.col("i").isNull(), default).otherwise(F.try_element_at(targets, F.col("i") + 1)).alias("target"))


def instances_under(types: DataFrame, ancestors: DataFrame, cls: str) -> DataFrame:
    """Nodes whose type is the class or one below it."""
    below = ancestors.where(F.col("ancestor") == cls).select(F.col("node").alias("type"))
    return types.where(F.col("type") == cls).unionByName(types.join(below, "type", "left_semi").select(*types.columns)).select("node").distinct()


def resolve_label(nodes: DataFrame, labels: DataFrame, matches: DataFrame, key: str = "node") -> DataFrame:
    """Nodes with their label, or that of the smallest node that exactly matches them (G9). labels (node, label); matches (s, o): s matches o."""
    own = labels.groupBy("node").agg(F.min("label").alias("own"))
    via = matches.join(labels, matches["s"] == labels["node"]).groupBy(F.col("o").alias("node")).agg(F.min_by("label", "s").alias("via"))
    return nodes.join(own.withColumnRenamed("node", key), key, "left").join(via.withColumnRenamed("node", key), key, "left").select(*nodes.columns, F.coalesce("own", "via").alias("label"))


def current_versions(versions: DataFrame, invalidated: DataFrame) -> DataFrame:
    """Versions (version, record) that nothing invalidated."""
    return versions.join(invalidated, "version", "left_anti")


def siblings(versions: DataFrame) -> DataFrame:
    """Pairs of different versions of one record."""
    other = versions.select("record", F.col("version").alias("sibling"))
    return versions.join(other, "record").where("version <> sibling").select("version", "sibling")


def evidence_tree(edges: DataFrame, types: DataFrame, ancestors: DataFrame, cls: str | None = None, transitive: bool = True, hide: DataFrame | None = None) -> DataFrame:
    """(node, evidence): evidence items below each node, all or direct ones, of a class, without hidden items."""
    below = closure(edges).select("node", F.col("ancestor").alias("evidence")) if transitive else edges.select(F.col("child").alias("node"), F.col("parent").alias("evidence")).distinct()
    if cls is not None:
        below = below.join(instances_under(types, ancestors, cls).withColumnRenamed("node", "evidence"), "evidence", "left_semi")
    if hide is not None:
        below = below.join(hide, "evidence", "left_anti")
    return below.select("node", "evidence")
