"""Graphs as JSON texts, one for each node and edge."""

from assay.sources import metadata


def test_graph_is_written_in_short_rows_and_read_in_order(spark):
    nodes = spark.createDataFrame([(f"t{i}", f"T{i}", "gold", "table") for i in range(40)], "external_id string, label string, layer string, node_type string")
    pairs = [("t0", f"t{i}") for i in range(1, 40)] + [("t1", "t2"), ("t", "z"), ("t 0", "a")]
    edges = spark.createDataFrame([(a, b, "FEEDS") for a, b in pairs], "source string, target string, edge_type string").repartition(4)
    text = metadata.write_graph(nodes, edges)
    assert max(len(r["graph"]) for r in text.collect()) < 200
    read_nodes, read_edges = metadata.read_graph(text, "graph")
    assert sorted(map(tuple, read_nodes.collect())) == sorted(map(tuple, nodes.collect()))
    assert [(r["source"], r["target"]) for r in read_edges.orderBy("rank").collect()] == sorted(pairs)
