"""Windows, keys, decoding, running and final sums."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.functions import keys
from tidewheel.functions.codec import decode
from tidewheel.operators import aggregate as A
from tidewheel.operators import orders as O
from tidewheel.schemas import ENRICHED, ORDER
from tidewheel.sources.generators import sample_orders


def starts(spark, pairs):
    out = []
    for ts, size in pairs:
        out.append(spark.createDataFrame([(ts,)], "normTs bigint").select(keys.window_start("normTs", size).alias("w")).first().w)
    return out


def test_window_start(spark):
    pairs = [(1694500010, 300), (1005, 0), (1005, -1), (-1, 300), (-301, 300)]
    assert starts(spark, pairs) == [1694499900, 900, 900, 0, -300]


def test_output_key(spark):
    df = spark.createDataFrame([("A", "p1", 1694499900)], "storeId string, productId string, windowStart bigint")
    assert df.select(keys.output_key().alias("k")).first().k == "A#p1#1694499900"


def enriched(spark, rows):
    df = spark.createDataFrame(rows, "off bigint, storeId string, productId string, price bigint, qty bigint, normTs bigint")
    return df.withColumns({"orderId": F.lit("o"), "ts": F.col("normTs"), "validated": F.lit(True)})


def test_running_output(spark):
    df = enriched(spark, [(1, "A", "p1", 1000, 2, 1000), (2, "A", "p1", 500, 1, 1001)])
    got = A.running(df, "off", 300, F.lit(111)).orderBy("off").select("seq", "sumAmount", "sumQty", "updatedAt").collect()
    assert [tuple(r) for r in got] == [(1, 2000, 2, 111), (2, 2500, 3, 111)]


def test_windows_split_keys(spark):
    got = A.running(enriched(spark, [(1, "A", "p1", 1, 1, 0), (2, "A", "p1", 1, 1, 600)]), "off", 300).select("key", "seq").collect()
    assert sorted(map(tuple, got)) == [("A#p1#0", 1), ("A#p1#600", 1)]


def test_sample_state(spark):
    got = {r.key: (r.sumAmount, r.sumQty, r.lastSeq) for r in A.final(sample_orders(spark), 300).collect()}
    assert got == {"A#p1#1694499900": (30000, 3, 2), "A#p2#1694499900": (15000, 3, 1)}


def test_sign_in_names_does_not_merge_groups(spark):
    df = enriched(spark, [(1, "A#b", "c", 1, 1, 0), (2, "A", "b#c", 1, 1, 0)])
    assert A.final(df, 300).count() == 2


def test_decode_matrix(spark):
    full = {"orderId": "o1", "productId": "p", "price": 5, "qty": 2, "storeId": "A", "ts": 7}
    good = [json.dumps(full), '{"orderId":"o2"}', json.dumps(full | {"orderId": "o3", "more": 1}), '{"orderId":"o4","price":null}']
    bad = ["{bad", '{"price":"abc"}', '{"price":1.5}', '{"price":1e3}', "[]", "", None]
    df = spark.createDataFrame([(v,) for v in good + bad], "value string")
    got = {r.orderId: r for r in decode(df, ORDER).collect()}
    assert set(got) == {"o1", "o2", "o3", "o4"}
    assert tuple(got["o2"]) == ("o2", "", 0, 0, "", 0) and got["o4"].price == 0 and got["o1"].price == 5
    assert decode(df.limit(0), ENRICHED).count() == 0


def test_partitioning_does_not_matter(spark):
    rows = [(i, "AB"[i % 2], f"p{i % 3}", i, 1, i * 7) for i in range(500)]
    frames = [A.final(enriched(spark, rows).repartition(n), 100).select("key", "sumAmount", "lastSeq") for n in (1, 7)]
    assert sorted(map(tuple, frames[0].collect())) == sorted(map(tuple, frames[1].collect()))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 900), st.integers(1, 9)), min_size=1, max_size=30))
def test_running_ends_in_final(spark, items):
    df = enriched(spark, [(i, f"s{s}", "p", q * 10, q, t) for i, (s, t, q) in enumerate(items)])
    last = {}
    for r in A.running(df, "off", 300).orderBy("off").collect():
        last[r.key] = (r.sumAmount, r.sumQty, r.seq)
    assert last == {r.key: (r.sumAmount, r.sumQty, r.lastSeq) for r in A.final(df, 300).collect()}
