"""Mix sources to target weights: budgets down a tree of domains, languages and sources, then a prefix of each leaf."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmill.llm.common import saved, whole_text

LEVELS = ("domain", "lang", "source")
#: Hex digits of the shuffle order that make a bucket: a leaf is cut in 16**3 buckets to find where its prefix ends.
BUCKET_DIGITS = 3


def tokens(text: str = "text") -> Column:
    """Words of the whole text, parted by ASCII white space."""
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _looked_up(table: Mapping, key: Column, default) -> Column:
    if not table:
        return F.lit(default)
    literal = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))
    return F.coalesce(F.element_at(literal, key), F.lit(default))


def _children(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """``budget`` of each child of ``nodes(*parents, node, capacity, weight, parent_budget)``.

    A parent's budget is parted by weight; a child never gets more than its capacity, and what it cannot take goes to
    its siblings by their weights. In the order of capacity over weight the full children come first: a child is
    full if, with all before it full, its part of what is left is no less than its capacity. Whole numbers throughout;
    a part is rounded down.
    """
    part = Window.partitionBy(*parents)
    order = part.orderBy(F.col("capacity") / F.col("weight"), "node")
    number = "decimal(20,0)"
    return (
        nodes.withColumn("before", F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn(
            "full",
            F.col("capacity").cast(number) * F.col("open").cast("decimal(10,0)")
            + F.col("before").cast(number) * F.col("weight").cast("decimal(10,0)")
            <= F.col("parent_budget").cast(number) * F.col("weight").cast("decimal(10,0)"),
        )
        .withColumn("left", F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(part))
        .withColumn("shares", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(part))
        .withColumn(
            "budget",
            F.when(F.col("full"), F.col("capacity")).otherwise(
                F.expr("cast(left as decimal(20,0)) * cast(weight as decimal(10,0)) div shares")
            ),
        )
        .select(*parents, "node", F.col("budget").cast("long").alias("budget"))
    )


def allocate(leaves: DataFrame, weights: Mapping[str, int], budget: int) -> DataFrame:
    """``domain, lang, source, tokens, budget`` of ``leaves(domain, lang, source, tokens, capacity)``.

    ``weights`` gives whole numbers to paths (``"web"``, ``"web/en"``, ``"web/en/news"``); a path that is not listed
    weighs 1, one that weighs 0 gets nothing. Each level parts its parent's budget by capacity below it, so a shortage
    is made up among siblings first and reaches the level above only when all of them are exhausted. There is a row
    per leaf, not per document; windows hold the children of one node.
    """
    parents = None
    for depth, level in enumerate(LEVELS):
        above = list(LEVELS[:depth])
        path = F.concat_ws("/", *above, level)
        nodes = leaves.groupBy(*above, level).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _looked_up(weights, path, 1).cast("long")).filter("weight > 0")
        nodes = nodes.join(parents, above) if above else nodes.withColumn("parent_budget", F.lit(budget).cast("long"))
        given = _children(nodes.withColumnRenamed(level, "node"), above)
        parents = given.select(*above, F.col("node").alias(level), F.col("budget").alias("parent_budget"))
    return leaves.join(parents.withColumnRenamed("parent_budget", "budget"), list(LEVELS), "left").select(
        *LEVELS, "tokens", F.coalesce("budget", F.lit(0).cast("long")).alias("budget")
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str, int],
    domains: Mapping[str, str],
    share: tuple[int, int] = (1, 2),
    epochs: int = 1,
    seed: int = 11,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key, domain, lang, source, tokens, copies`` for every row of ``docs``: how often the mixture has it.

    The budget is ``share`` of all tokens. A leaf may be read ``epochs`` times; its budget is that many whole epochs
    as fit, and of the next one a prefix: rows in the order of a hash of seed, epoch and key, up to and with the one
    in which the budget ends. The prefix is found by sums per hash bucket; only the bucket in which it ends is sorted,
    so a leaf with a third of all rows is never in one task.

    Domains come from ``domains`` by source, else ``other``. Null languages are ``und``, null sources ``unknown``.
    Rows without tokens cost nothing and are taken with their place in the order; a leaf without any token gives none.
    Rows with a null key count with an empty one. Repeated rows are counted and chosen each. Other columns are
    ignored; an empty table gives an empty result.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit("unknown"))
    rows = saved(
        docs.select(
            F.col(f"`{key}`").alias("key"),
            _looked_up(domains, source, "other").alias("domain"),
            F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
            source.alias("source"),
            tokens(text).alias("tokens"),
        )
    )
    leaves = saved(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).withColumn("capacity", F.col("tokens") * epochs))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = allocate(leaves, weights, total * share[0] // share[1]).filter("tokens > 0")
    plan = saved(
        budgets.select(
            *LEVELS, F.expr("budget div tokens").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest")
        )
    )
    parts = F.concat_ws(":", F.lit(seed), "whole", F.coalesce(F.col("key").cast("string"), F.lit("")))
    order = F.md5(parts.cast("binary"))
    placed = saved(
        rows.join(plan, list(LEVELS), "left")
        .withColumn("order", order)
        .withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    )
    leaf = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.filter("rest > 0").groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("size"), F.max("rest").alias("end"))
    buckets = buckets.withColumn("start", F.coalesce(F.sum("size").over(leaf), F.lit(0))).filter("start < end")
    buckets = buckets.select(*LEVELS, "bucket", "start", (F.col("start") + F.col("size") > F.col("end")).alias("ends_here"))
    reached = placed.join(buckets, [*LEVELS, "bucket"], "left")
    # only the rows of the one bucket per leaf in which its prefix ends are put in order
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("order", "key", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = reached.filter("ends_here").withColumn(
        "taken", F.col("start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)) < F.col("rest")
    )
    others = reached.filter("ends_here is null or not ends_here").withColumn("taken", F.col("start").isNotNull())
    copies = F.coalesce("whole", F.lit(0)) + F.col("taken").cast("long")
    return last.unionByName(others).select(F.col("key").alias(key), *LEVELS, "tokens", copies.cast("int").alias("copies"))


def repeated(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as its key's ``copies`` say; ``docs`` has each key once."""
    times = mixed.filter("copies > 0").select(key, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(key)
    return docs.join(times, key).select(*(f"`{c}`" for c in docs.columns))
