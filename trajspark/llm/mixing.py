"""Mixing of sources to target weights by hierarchical budgeting, in DataFrame operations only.

Documents are leaves of a tree of levels, such as domain, language and source. A budget of
tokens goes down the tree by the weights of the nodes. A node never gets more than its
leaves can give in ``max_epochs`` passes; what it cannot take goes to its siblings by their
weights, and only if they cannot take it either does it stay with the parent, whose own
siblings had it first. Every leaf then gives whole epochs, and of one more epoch the
longest prefix, in an order by seeded digests, that fits the rest.

The prefix of a leaf is found from token sums of 4096 digest ranges; only documents of the
one range where it ends are ordered. No leaf, however large, is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajspark.llm.tables import set_aside, written

MAX_EPOCHS = 2
SEED = 11
RANGES = 4096
BROADCAST_LEAVES = 100_000


def word_count(text: str = "text") -> Column:
    """Tokens of a document: its words."""
    words = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(words, "")).cast("bigint")


def _digest(epoch: Column, seed: int) -> Column:
    """60 bits from the seed, the epoch and the document."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name)
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def _range(digest: Column) -> Column:
    return F.shiftright(digest, 48).cast("int")


def shares(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget) -> DataFrame:
    """``leaves`` (levels and ``room``) with ``target``, the tokens that each gets of ``budget``.

    ``weights`` has whole numbers by level and value; 1 where nothing is said.
    """
    out = leaves.withColumn("target", F.lit(budget).cast("bigint"))
    for depth, level in enumerate(levels):
        above, here = list(levels[:depth]), list(levels[: depth + 1])
        known = weights.get(level, {})
        pairs = [F.lit(x) for item in known.items() for x in item]
        weight = F.coalesce(F.create_map(*pairs)[F.col(level)], F.lit(1)) if pairs else F.lit(1)
        nodes = out.groupBy(*here).agg(F.sum("room").alias("room"), F.first("target").alias("given"))
        nodes = nodes.withColumn("w", weight.cast("bigint"))
        family = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        order = family.orderBy(F.col("room") / F.col("w"), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        onward = order.rowsBetween(0, Window.unboundedFollowing)
        taken = F.coalesce(F.sum("room").over(before), F.lit(0))
        # full: with all smaller ones full, the level of the rest still reaches its room
        full = F.col("room") * F.sum("w").over(onward) <= (F.col("given") - taken) * F.col("w")
        nodes = nodes.withColumn("full", full)
        left = F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(family), F.lit(0))
        others = F.sum(F.when(~F.col("full"), F.col("w"))).over(family)
        share = F.when(F.col("full"), F.col("room")).otherwise(F.expr("left * w div others"))
        nodes = nodes.withColumn("left", left).withColumn("others", others).withColumn("share", share)
        out = out.drop("target").join(nodes.select(*here, F.col("share").alias("target")), here)
    return out


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    budget_percent: int = 100,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The documents of the mixture: the columns of ``docs``, ``n_tokens`` and ``epoch`` (from 0).

    ``levels`` names the levels of the tree from the root down, as expressions on ``docs``; a
    null counts as an empty string. The budget is ``budget_percent`` per cent of all tokens.
    A document of epoch e has been given e times before.

    A text without words, or null, has no tokens and is taken where its place in the order
    is within the prefix. Rows that repeat are ordered and given each. Columns of ``docs`` named
    ``n_tokens`` or ``epoch`` are replaced. An empty table gives an empty mixture.
    """
    leaf = {f"_leaf{i}": F.coalesce(c.cast("string"), F.lit("")) for i, c in enumerate(levels.values())}
    keys = list(leaf)
    names = docs.columns
    rows, back = set_aside(docs.select("*", *[c.alias(n) for n, c in leaf.items()]), "doc_id", "text", *keys)
    back = [c for name, c in zip(names, back) if name.lower() not in ("n_tokens", "epoch")]
    kept = rows.columns[: len(names)]
    sums = written(
        rows.select(*keys, "doc_id", word_count().alias("t"))
        .select(*keys, "doc_id", "t", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])).alias("e"))
        .groupBy(*keys, "e", _range(_digest(F.col("e"), seed)).alias("r"))
        .agg(F.sum("t").alias("t")),
        "sums",
    )
    whole = sums.filter("e = 0").groupBy(*keys).agg(F.sum("t").alias("tokens"))
    total = whole.agg(F.sum("tokens")).first()[0] or 0
    by_key = {key: weights.get(name, {}) for key, name in zip(keys, levels)}
    roomy = whole.withColumn("room", F.col("tokens") * max_epochs)
    # no more than all leaves can give
    budget = min(total * budget_percent // 100, total * max_epochs)
    plan = shares(roomy, keys, by_key, budget)
    full = F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(F.lit(0))
    plan = plan.select(*keys, full.cast("int").alias("full"), (F.col("target") - full * F.col("tokens")).alias("rest"))
    # where the prefix of the last epoch ends
    upto = F.sum("t").over(Window.partitionBy(*keys).orderBy("r"))
    reach = sums.join(plan.withColumnRenamed("full", "e"), [*keys, "e"]).withColumn("upto", upto)
    ends = (
        reach.filter("upto > rest")
        .groupBy(*keys)
        .agg(F.min(F.struct("r", (F.col("upto") - F.col("t")).alias("before"))).alias("end"))
        .select(*keys, F.col("end.r").alias("end_range"), F.col("end.before").alias("before"))
    )
    plan = written(plan.join(ends, keys, "left"), "plan")
    small = plan.count() <= BROADCAST_LEAVES
    planned = rows.join(F.broadcast(plan) if small else plan, keys)
    last = F.when(F.col("full") < max_epochs, _range(_digest(F.col("full"), seed)))
    planned = planned.withColumn("_range", last)
    within = F.coalesce(F.col("_range") < F.coalesce("end_range", F.lit(RANGES)), F.lit(False))
    copies = F.col("full") + within.cast("int")
    given = planned.withColumn("_copies", copies).filter("_copies > 0")
    given = given.select(*kept, word_count().alias("n_tokens"), F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("epoch"))
    edge = planned.filter("_range = end_range").withColumn("n_tokens", word_count())
    place = Window.partitionBy(*keys).orderBy(_digest(F.col("full"), seed), "doc_id", "n_tokens", F.xxhash64("text"))
    upto = F.sum("n_tokens").over(place.rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("_upto", upto).filter("before + _upto <= rest")
    out = given.union(edge.select(*kept, "n_tokens", F.col("full").alias("epoch")))
    return out.select(*back, "n_tokens", "epoch")

