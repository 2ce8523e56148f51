"""Metadata built anew: normal form of known fields, unknown keys of any kind kept, building twice."""

import json

from pyspark.sql import functions as F

from recallium.functions import metadata as M

ROWS = [
    ('{"tier":"odd","access_count":"12","confidence":1.7,"mine":{"a":[1,null,"x"]},"flag":false,"nothing":null,"l0_abstract":"  tea "}', "{}"),
    ('{"access_count":3,"mine":1}', '{"access_count":4,"mine":[2],"tier":"core"}'),
    ("not json", '{"state":"pending"}'), (None, "{}"), ("[1]", "{}"),
]


def test_building(spark):
    df = spark.createDataFrame([(i, *r, "likes tea", "preference", 5) for i, r in enumerate(ROWS)], "i int, raw string, patch string, text string, category string, ts long")
    build = lambda raw, patch: M.built(raw, patch, F.col("text"), F.col("category"), F.col("ts"))
    once = df.withColumn("one", build(F.col("raw"), F.col("patch")))
    got = {r["i"]: (json.loads(r["one"]), json.loads(r["two"])) for r in once.withColumn("two", build(F.col("one"), F.lit("{}"))).collect()}
    assert all(one == two for one, two in got.values())
    a, b, c = got[0][0], got[1][0], got[2][0]
    assert (a["tier"], a["access_count"], a["confidence"], a["l0_abstract"], a["memory_category"]) == ("working", 12, 1.0, "tea", "preferences")
    assert a["mine"] == {"a": [1, None, "x"]} and a["flag"] is False and "nothing" in a and "legacy" not in a
    assert (b["access_count"], b["mine"], b["tier"]) == (4, [2], "core") and c["state"] == "pending"
    assert got[3][0] == got[4][0] and got[3][0]["valid_from"] == 5
