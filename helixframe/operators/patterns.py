"""Triple patterns and hybrid resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """One pattern: terms that start with ? are variables and become columns, others are constants (None: unbound, dropped)."""
    df, out = triples, []
    seen: dict[str, str] = {}
    for name, term in (("s", s), ("p", p), ("o", o)):
        if term is None:
            continue
        if not term.startswith("?"):
            df = df.where(F.col(name) == term)
        elif term in seen:
            df = df.where(F.col(name) == F.col(seen[term]))
        else:
            seen[term] = name
            out.append(F.col(name).alias(term[1:]))
    return df.select(*out) if out else df.select(F.lit(1).alias("_one"))


def join_shared(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns with equal names (J2); without any, each row meets each row of a side that must be one row."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("patterns share no variable")
    return left.join(right, shared, how)


def bgp(triples: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Conjunction of patterns: a chain of equi-joins on shared variables, in the given order."""
    return reduce(join_shared, [scan(triples, *x) for x in patterns])


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return join_shared(left, right, "left")


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return join_shared(left, right, "left_semi")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return join_shared(left, right, "left_anti")


def ask(df: DataFrame) -> DataFrame:
    """One row, one boolean: are there rows?"""
    return df.limit(1).agg((F.count("*") > 0).alias("answer"))


#: Rows of a key whose pairs are dealt over several tasks.
_MANY = 4096


def theta_self_join(df: DataFrame, on: list[str], differ: list[str]) -> DataFrame:
    """Pairs of rows equal in `on` and different in every column of `differ`; the other row's columns get the suffix _2.

    The pairs of a key with very many rows are dealt over tasks: its rows are cut into parts, and each part meets all.
    """
    parts = df.groupBy(*on).count().where(F.col("count") > _MANY).select(*on, F.least(F.ceil(F.col("count") / (_MANY / 4)), F.lit(256)).cast("int").alias("_parts"))
    last = F.coalesce("_parts", F.lit(1)) - 1
    dealt = df.join(parts, on, "left")
    own = dealt.withColumn("_part", F.pmod(F.xxhash64(*differ), last + 1).cast("int")).drop("_parts")
    # few rows make many pairs: a number of partitions that isn't lowered by their size
    own = own.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on, "_part")
    other = dealt.withColumn("_part", F.explode(F.sequence(F.lit(0), last)))
    other = other.select("_part", *[F.col(c) if c in on else F.col(c).alias(f"{c}_2") for c in df.columns])
    return own.join(other, [*on, "_part"]).where(reduce(lambda a, b: a & b, [F.col(c) != F.col(f"{c}_2") for c in differ])).drop("_part")


def hybrid(objects: DataFrame, triples: DataFrame, key: str, attributes: dict[str, str]) -> DataFrame:
    """Objects with graph values behind them: an object's own value first, else the smallest graph value."""
    facts = triples.where(F.col("p").isin(*attributes.values())).groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(f"_{c}") for c, p in attributes.items()])
    joined = objects.join(facts, objects[key] == facts["s"], "left").drop("s")
    for c in attributes:
        joined = joined.withColumn(c, F.coalesce(c, f"_{c}") if c in objects.columns else F.col(f"_{c}"))
    return joined.drop(*[f"_{c}" for c in attributes])


def values(nodes: DataFrame, triples: DataFrame, predicates: list[str], inverse: bool = False, key: str = "node", out: str = "value") -> DataFrame:
    """All values of nodes over any of the predicates, forward or inverse."""
    near, far = ("o", "s") if inverse else ("s", "o")
    facts = triples.where(F.col("p").isin(*predicates)).select(F.col(near).alias(key), F.col(far).alias(out))
    return nodes.join(facts, key).distinct()


def first_value(nodes: DataFrame, triples: DataFrame, predicates: list[str], inverse: bool = False, key: str = "node", out: str = "value") -> DataFrame:
    """The smallest value of each node, by the first predicate that has one; null if none has."""
    near, far = ("o", "s") if inverse else ("s", "o")
    facts = triples.where(F.col("p").isin(*predicates)).groupBy(F.col(near).alias(key)).agg(*[F.min(F.when(F.col("p") == p, F.col(far))).alias(f"_{i}") for i, p in enumerate(predicates)])
    return nodes.join(facts, key, "left").select(*nodes.columns, F.coalesce(*[F.col(f"_{i}") for i in range(len(predicates))]).alias(out))


def subjects_of(nodes: DataFrame, triples: DataFrame, predicates: list[str], key: str = "node") -> DataFrame:
    """Everything that refers to a node by one of the predicates."""
    return values(nodes, triples, predicates, inverse=True, key=key, out="subject")


def lookup_join(df: DataFrame, mapping: DataFrame, on: str, target: str, max_bytes: int = 1 << 26) -> DataFrame:
    """Left join to an identifier map; sent to every task while it takes at most max_bytes, shuffled beyond that."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in (on, target)), F.lit(64).cast("long"))
    small = (mapping.agg(F.sum(size)).first()[0] or 0) <= max_bytes
    one = mapping.groupBy(on).agg(F.min(target).alias(target))
    return df.join(F.broadcast(one) if small else one, on, "left")


def nested(parents: DataFrame, children: DataFrame, on: str, name: str) -> DataFrame:
    """Parents with an array of their children's structs, sorted; empty if they have none."""
    fields = [c for c in children.columns if c != on]
    lists = children.groupBy(on).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    joined = parents.join(lists, on, "left")
    kind = dict(lists.dtypes)[name]
    return joined.withColumn(name, F.coalesce(name, F.array().cast(kind)))


def is_blank(kind: Column | str = "o_kind") -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind) == "bnode"
