import json
import random

from pyspark.sql import functions as F

from strandline.operators.completions import normalized


def plain(value):
    if isinstance(value, list):
        return "".join(map(plain, value))
    if isinstance(value, dict):
        value = value.get("content", "")
    return value if isinstance(value, str) else {None: "None", True: "True", False: "False"}[value] if value is None or isinstance(value, bool) else json.dumps(value, separators=(",", ":"))


def nested(rng, depth=0):
    kind = rng.randrange(8)
    text = rng.choice(["", "a", "b c", "é\n", "[x]"])
    if kind < 2:
        return text
    if kind == 2:
        return rng.choice([None, True, False, 7, -2])
    if kind < 5:
        return rng.choice([{"content": text}, {"role": "user"}, {"content": None, "x": 1}, {"content": 5}, {"content": [1, "y"]}, {"content": {"z": [2]}}])
    return [nested(rng, depth + 1) for _ in range(rng.randrange(4 if depth < 6 else 1))]


def test_nested_completions_equal_a_recursive_reading(spark):
    rng = random.Random(6)
    values = [nested(rng) for _ in range(400)] + [[[[[[[["deep"]]]]]]], [], [[]], [[], ["a", []]]]
    frame = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, None)], "i int, t string").withColumn("c", F.parse_json("t"))
    got = {r["i"]: r["completion"] for r in normalized(frame, "c").collect()}
    assert got.pop(-1) is None
    assert got == {i: plain(v) for i, v in enumerate(values)}
