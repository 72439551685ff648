"""MQTT subscription filters (``+``, ``#``) against a level-by-level matcher on random topics."""

import random

from pyspark.sql import functions as F

from buoyline.functions.topics import topic_matches


def _matches(topic: str, pattern: str) -> bool:
    t, p = topic.split("/"), pattern.split("/")
    if topic.startswith("$") and p[0] in ("+", "#"):
        return False
    for i, level in enumerate(p):
        if level == "#":
            return True  # the parent level and everything below
        if i >= len(t):
            return False
        if level != "+" and level != t[i]:
            return False
    return len(t) == len(p)


def test_filters_match_reference_rules(spark):
    rnd = random.Random(5)
    words = ["ws", "hub1", "hub2", "S1", "a", "", "$SYS", "measurement"]
    topics = sorted({"/".join(rnd.choice(words) for _ in range(rnd.randrange(1, 6))) for _ in range(300)})
    patterns = ["#", "+", "ws/#", "ws/+/+/#", "ws/hub1/+/#", "+/+/S1/measurement", "ws/+", "ws/hub1",
                "+/#", "ws/+/S1", "$SYS/#", "a/+/+"]
    df = spark.createDataFrame([(t,) for t in topics], "topic string")
    got = df.select("topic", *[topic_matches("topic", p).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    bad = [(r["topic"], p) for r in got for i, p in enumerate(patterns) if r[f"p{i}"] != _matches(r["topic"], p)]
    assert not bad, bad[:10]
