"""A table of many subscription filters against topics, without a cross join.

The filters form a trie over topic levels, held as a table: every prefix of a
filter, cut at a level border, is a node. A topic walks down that table. At each
level it has at most three ways on (the level itself, ``+``, or ``#`` as the
end), and an equality join with the nodes keeps those that some filter goes on
with, so a topic only ever carries prefixes that exist. The walk is one join per
level of the deepest filter, over distinct topics, not over messages.

Short prefixes and wildcard nodes are met by nearly every topic. The join key
therefore carries a salt of the topic, and the nodes are repeated per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16  # parts that the topics of one node, or the messages of one topic, are spread over

_WAY = "array<struct<node: string, open: boolean>>"


def invalid_reason(pattern: Column | str) -> Column:
    """Why a filter is no valid one (``#`` before the end, a wildcard that shares its level, NULL), or NULL."""
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    levels = F.split(p, "/")
    shared = F.exists(levels, lambda x: x.rlike("[+#]") & (F.length(x) > 1))
    early = F.exists(F.slice(levels, 1, F.size(levels) - 1), lambda x: x == "#")
    return F.when(p.isNull(), "missing").when(shared, "wildcard_shares_level").when(early, "hash_before_end")


def _salts(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt")


def nodes(filters: DataFrame) -> DataFrame:
    """Distinct trie nodes of the filters in column ``filter``: their prefixes of 1, 2, ... levels."""
    levels = F.split("filter", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(levels)), lambda n: F.array_join(F.slice(levels, F.lit(1), n), "/"))
    return filters.select(F.explode(prefix).alias("node")).distinct()


def _ways(depth: int) -> Column:
    """Nodes of one level more that a topic may reach: ``open`` ones go on, the others are complete filters."""
    level = F.get("levels", F.lit(depth))
    last = F.size("levels") == depth + 1
    under = (lambda x: x) if depth == 0 else (lambda x: F.concat(F.col("node"), F.lit("/"), x))
    # A wildcard cannot be part of a published topic's literal match; a topic of the system space meets no leading wildcard.
    plain = F.when(level.isin("+", "#"), F.array().cast("array<string>")).otherwise(F.array(under(level)))
    some = F.array(under(F.lit("+")))
    end = F.array(under(F.lit("#")))
    if depth == 0:
        hidden = F.startswith("topic", F.lit("$"))
        some = F.when(hidden, F.array().cast("array<string>")).otherwise(some)
        end = F.when(hidden, F.array().cast("array<string>")).otherwise(end)
    children = F.concat(plain, some)
    # At the topic's last level a child is complete, and so is "everything below it", which takes in the level itself.
    complete = F.concat(end, F.when(last, F.concat(children, F.transform(children, lambda x: F.concat(x, F.lit("/#"))))).otherwise(F.array().cast("array<string>")))
    onward = F.when(last, F.array().cast("array<string>")).otherwise(children)
    way = lambda nodes_, open_: F.transform(nodes_, lambda x: F.struct(x.alias("node"), F.lit(open_).alias("open")))
    return F.concat(way(onward, True), way(complete, False)).cast(_WAY)


def matching_filters(topics: DataFrame, filters: DataFrame, salts: int = SALTS) -> DataFrame:
    """(topic, filter): every distinct topic with each distinct valid filter that matches it.

    Invalid filters (``invalid_reason``) and NULL topics match nothing. The
    only driver action counts the levels of the deepest filter.
    """
    valid = filters.where(invalid_reason("filter").isNull()).select("filter").distinct()
    depth = valid.agg(F.max(F.size(F.split("filter", "/")))).first()[0] or 0
    trie = nodes(valid).select("node", _salts(salts))
    walk = topics.select("topic").where("topic IS NOT NULL").distinct().select(
        "topic", F.split("topic", "/").alias("levels"), F.pmod(F.xxhash64("topic"), F.lit(salts)).cast("int").alias("salt"),
        F.lit(None).cast("string").alias("node"), F.lit(True).alias("open"))
    for d in range(depth):
        here = F.array(F.struct("node", "open")).cast(_WAY)
        walk = walk.select("topic", "levels", "salt", F.inline(F.when(F.col("open"), _ways(d)).otherwise(here)))
        walk = walk.join(trie, ["salt", "node"], "left_semi")
    ends = walk.where(~F.col("open")).select("topic", "salt", F.col("node").alias("filter"))
    return ends.join(valid.select("filter", _salts(salts)), ["salt", "filter"], "left_semi").select("topic", "filter")


def deliveries(messages: DataFrame, subscriptions: DataFrame, salts: int = SALTS) -> DataFrame:
    """Each message (all its columns) once for every ``subscription_id`` one of whose filters matches its topic.

    Two subscriptions with one filter both get the message; a subscription
    whose filters overlap, or are repeated, gets it once. Messages of a hot topic are spread by a salt
    over their own row, against the topic's subscriptions repeated per salt.
    """
    pairs = matching_filters(messages, subscriptions, salts)
    wanted = subscriptions.select("subscription_id", "filter").distinct()
    spread = wanted.select("*", _salts(salts)).join(
        pairs.withColumn("salt", F.pmod(F.xxhash64("topic"), F.lit(salts)).cast("int")), ["salt", "filter"])
    per_topic = spread.select("topic", "subscription_id").distinct().select("*", _salts(salts))
    dealt = messages.withColumn("salt", F.pmod(F.xxhash64(*messages.columns), F.lit(salts)).cast("int"))
    return dealt.join(per_topic, ["topic", "salt"]).select(*[dealt[c] for c in messages.columns], "subscription_id")
