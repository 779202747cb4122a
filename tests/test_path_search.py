"""What the path searches write and put in order."""

from assay.operators import graph

EDGE = "source string, target string"
PAIRS = [("r", f"m{i}") for i in range(5)] + [(f"m{i}", f"l{i}_{j}") for i in range(5) for j in range(40)] + [("m0", "unlisted")]


def tables(spark):
    nodes = spark.createDataFrame([(n,) for n in sorted({n for p in PAIRS for n in p} - {"unlisted"}) + ["alone"]], "external_id string")
    return nodes, spark.createDataFrame(PAIRS + PAIRS[:7], EDGE)


def expected():
    return sorted([("alone",), *[("r", f"m{i}", f"l{i}_{j}") for i in range(5) for j in range(40)]])


def test_last_steps_of_paths_are_not_written(spark, monkeypatch):
    written, stage = [], graph.staged_table

    def counted(df):
        out = stage(df)
        written.append(out.count() if "path" in out.columns else 0)
        return out

    monkeypatch.setattr(graph, "staged_table", counted)
    found = sorted(tuple(r.path) for r in graph.paths(*tables(spark)).collect())
    assert found == expected() and sum(written) <= 8


def test_only_edges_of_visited_nodes_are_put_in_order(spark, monkeypatch):
    ordered, before = [], graph._before

    def counted(df, keys, *rest):
        ordered.append(df.count() if keys == ["source"] else 0)
        return before(df, keys, *rest)

    monkeypatch.setattr(graph, "_before", counted)
    found = sorted((r.no, tuple(r.path)) for r in graph.numbered_paths(*tables(spark), 3, 10).collect())
    assert found == [(i, p) for i, p in enumerate(expected())][3:13] and sum(ordered) <= 5 + 40
