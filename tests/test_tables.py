"""The engine over DataFrames: storage, reopening, slices, graphs, streams, pages."""

import json
import re

import pytest

from millrace.operators.definition import Style, executor, query
from millrace.operators.engine import Engine, SetResult
from millrace.plans import graph_frames, page
from millrace.sources.values import TableRef
from millrace.streaming import bridge
from pyspark.sql import functions as F


@query
class Rows:
    name: str


@query
class Grouped:
    name: str


@query(method="slice_of", spread=True)
class OneSlice:
    name: str
    k: int


@query
class Total:
    name: str


def program():
    made = []

    @executor(Grouped, style=Style.FIREWALL, program=made)
    def grouped(key, ctx):
        return ctx.query(Rows(key.name)).groupBy("k").agg(F.sum("v").alias("v"))

    @executor(OneSlice, style=Style.PROJECTION, program=made)
    def one(key, ctx):
        return ctx.slice(Grouped(key.name), "k", key.k)

    @executor(Total, program=made)
    def total(key, ctx):
        return sum(r.v for k in (1, 2) for r in ctx.slice_of(key.name, k).collect())

    return made


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, v long")


def test_slices_shield_their_readers(spark, engine):
    made = program()
    engine.register(*made)
    grouped, one, total = made
    with engine.session() as s:
        s.set_input(Rows("a"), frame(spark, [(1, 10), (2, 20), (3, 30)]))
    assert engine.query(Total("a")) == 30
    with engine.session() as s:
        assert s.set_input(Rows("a"), frame(spark, [(2, 20), (1, 4), (1, 6), (3, 99)])) is SetResult.UPDATED
    assert engine.query(Total("a")) == 30
    assert (grouped.runs, one.runs, total.runs) == (2, 4, 1)
    with engine.session() as s:
        s.set_input(Rows("a"), frame(spark, [(1, 10)]))
    assert engine.query(Total("a")) == 10
    assert total.runs == 2


def test_reopen(spark, tmp_path):
    path = str(tmp_path / "state")
    with Engine(spark, path) as e:
        e.register(*program())
        with e.session() as s:
            s.set_input(Rows("a"), frame(spark, [(1, 1), (2, 2)]))
        assert e.query(Total("a")) == 3
        with e.session() as s:
            s.set_input(Rows("a"), frame(spark, [(1, 1), (2, 5)]))
        epoch, marks, dirty = e.epoch, e.dirtied_edges(), set(e.graph.dirty)
    made = program()
    with Engine(spark, path) as e:
        assert (e.epoch, e.dirtied_edges(), e.graph.dirty) == (epoch, marks, dirty)
        e.register(*made)
        assert e.query(Total("a")) == 6
        assert made[0].runs == 1
        assert e.query(Grouped("a")).count() == 2
        assert made[0].runs == 1
        kept = len(e.graph.nodes)
        assert e.prune(Grouped("a"))[0] == kept - 2
        assert e.query(Total("a")) == 6
    with pytest.raises(ValueError):
        Engine(spark, path, seed=5)


def test_equal_results_share_files(spark, engine):
    with engine.session() as s:
        s.set_input(Rows("a"), frame(spark, [(1, 1), (2, 2)]))
        s.set_input(Rows("b"), frame(spark, [(2, 2), (1, 1)]))
    assert len({n.value.path for n in engine.graph.nodes.values()}) == 1


def test_table_references_see_changed_files(spark, engine, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, [(1, 1)]).write.parquet(path)
    with engine.session() as s:
        assert s.set_input(Rows("t"), TableRef(path)) is SetResult.FRESH
    with engine.session() as s:
        assert s.set_input(Rows("t"), TableRef(path)) is SetResult.UNCHANGED
        assert s.set_input(Rows("t"), TableRef(path, where="k > 1", columns=("v",))) is SetResult.UPDATED
    assert engine.query(Rows("t")).columns == ["v"]
    frame(spark, [(2, 2)]).write.mode("append").parquet(path)
    with engine.session() as s:
        assert s.set_input(Rows("t"), TableRef(path)) is SetResult.UPDATED
    assert engine.query(Rows("t")).count() == 2


def test_page(spark, engine):
    engine.register(*program())
    with engine.session() as s:
        s.set_input(Rows("</script>é" * 40), frame(spark, [(1, 1)]))
    engine.query(Total("</script>é" * 40))
    text = page.render(engine, Total("</script>é" * 40), "<b>")
    assert text.count("</script>") == 1 and "&lt;b&gt;" in text
    data = json.loads(re.search(r"const G = (.*), by", text)[1].replace("<\\/", "</"))
    assert {n["kind"] for n in data["nodes"]} == {"input", "firewall", "projection", "normal"}
    assert len(data["links"]) == 5 and all(len(n["label"]) <= 60 for n in data["nodes"])
    assert "const G" in page.render(Engine(spark, "/tmp/none", durable=False))
    assert page.shorten("é" * 80) == "é" * 57 + "..."


def test_snapshot_frames(spark, engine):
    engine.register(*program())
    with engine.session() as s:
        s.set_input(Rows("a"), frame(spark, [(1, 1)]))
    engine.query(Total("a"))
    nodes, edges = graph_frames.snapshot(engine, Total("a"))
    assert {(r.kind, r.depth) for r in nodes.collect()} == {("normal", 0), ("projection", 1), ("firewall", 2), ("input", 3)}
    assert edges.where("is_dirty").count() == 0 and edges.count() == 5
    with engine.session() as s:
        s.set_input(Rows("a"), frame(spark, [(1, 2)]))
    assert graph_frames.snapshot(engine)[1].where("is_dirty").count() == 1


def test_graph_joins(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "b"), ("c", "d"), ("y", "x")], "caller string, callee string")
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    marks = graph_frames.dirty_closure(edges, one("d"))
    assert {(r.caller, r.callee) for r in marks.collect()} == {("c", "d"), ("b", "c"), ("a", "b"), ("x", "b"), ("c", "a"), ("y", "x")}
    stopped = graph_frames.dirty_closure(edges, one("d"), one("b"))
    assert {(r.caller, r.callee) for r in stopped.collect()} == {("c", "d"), ("b", "c")}
    walls = graph_frames.firewall_sets(edges, one("c", "x"))
    assert {tuple(r) for r in walls.collect()} == {("b", "c"), ("a", "c"), ("x", "c"), ("c", "c"), ("y", "x")}
    assert dict(map(tuple, graph_frames.breadth_first(edges, one("y")).collect())) == {"y": 0, "x": 1, "b": 2, "c": 3, "a": 4, "d": 4}


def test_graph_joins_by_kinds(spark):
    """A table of edges is read once, in the step that meets its kind, and others never; results are those of the graph without kinds."""
    rows = {
        ("l", "o"): [("l1", "o1"), ("l2", "o1"), ("l3", "o2"), ("l4", None)],
        ("o", "c"): [("o1", "c1"), ("o2", "c2"), ("o2", "c2")],
        ("o", "n"): [("o2", "n1")],
        ("c", "n"): [("c1", "n1"), ("c2", "n2")],
        ("n", "o"): [("n2", "o1")],
        ("x", "y"): [("x1", "y1")],
    }
    schema = "caller string, callee string"
    read = {k: spark.sparkContext.accumulator(0) for k in rows}

    def counted(k):
        count = read[k]

        def look(row):
            count.add(1)
            return row

        return spark.createDataFrame(spark.sparkContext.parallelize(rows[k], 1).map(look), schema)

    kinds, plain = {k: counted(k) for k in rows}, spark.createDataFrame([e for r in rows.values() for e in r], schema)
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    got = lambda df: sorted(map(str, df.collect()))
    down = graph_frames.breadth_first({k: v for k, v in kinds.items() if k != ("n", "o")}, {"l": one("l1", "l3", "l3")})
    assert sorted(map(tuple, down.collect())) == [("c1", 2), ("c2", 2), ("l1", 0), ("l3", 0), ("n1", 2), ("n2", 3), ("o1", 1), ("o2", 1)]
    assert {k: a.value for k, a in read.items()} == {("l", "o"): 4, ("o", "c"): 3, ("o", "n"): 1, ("c", "n"): 2, ("n", "o"): 0, ("x", "y"): 0}
    assert got(graph_frames.breadth_first(kinds, {"l": one("l1", "l3"), "x": one("x1")})) == got(graph_frames.breadth_first(plain, one("l1", "l3", "x1")))
    assert got(graph_frames.dirty_closure(kinds, {"n": one("n2")})) == got(graph_frames.dirty_closure(plain, one("n2")))
    assert got(graph_frames.dirty_closure(kinds, {"n": one("n2")}, {"o": one("o2")})) == got(graph_frames.dirty_closure(plain, one("n2"), one("o2")))
    assert got(graph_frames.firewall_sets(kinds, {"c": one("c1"), "n": one("n1")})) == got(graph_frames.firewall_sets(plain, one("c1", "n1")))
    assert got(graph_frames.dirty_closure(kinds, {"z": one("z1")})) == got(graph_frames.firewall_sets(kinds, {"z": one("z1")})) == []
    with pytest.raises(TypeError):
        graph_frames.breadth_first(kinds, one("l1"))


def test_stream_batches_are_folded_once(spark, engine):
    fold = lambda old, batch: batch if old is None else old.unionByName(batch)
    handle = bridge.into_sessions(engine, Rows("s"), fold, "s")
    for n, rows in [(0, [(1, 1)]), (1, [(2, 2)]), (1, [(2, 2)]), (2, [(3, 3)])]:
        handle(frame(spark, rows), n)
    assert engine.query(Rows("s")).count() == 3


def test_impure_executors_are_found(spark, engine):
    Noise = query(type("Noise", (), {}), name="Noise")
    engine.register(*program(), executor(Noise)(lambda key, ctx: ctx.query(Rows("a")).withColumn("r", F.rand())))
    with engine.session() as s:
        s.set_input(Rows("a"), frame(spark, [(1, 1), (2, 2)]))
    assert all(engine.recheck(k) for k in (Rows("a"), Grouped("a"), OneSlice("a", 1), Total("a")))
    assert not engine.recheck(Noise())
