"""Components of the whole graph of order lines, against brute force."""

from granary import queries


def brute(pairs):
    root = {x: x for p in pairs for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {x: top(x) for x in root}


def test_all_order_lines_are_edges(spark, tmp_path):
    orders = [(o, 1 + o * 7 % 40) for o in range(60)]
    # Quantities and discounts of which few or none are 50 and 0.1.
    items = [(o, 1 + (o * o + k) % 45, float(1 + (o + k) % 50), (o + k) % 11 / 100) for o in range(60) for k in range(o % 3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    customer = dict(orders)
    want = brute([(customer[o], s + 10_000_000) for o, s, _, _ in items])
    got = {r.node: r.root for r in queries.connected_components(spark, str(tmp_path)).collect()}
    assert got == want and len(set(want.values())) > 1
