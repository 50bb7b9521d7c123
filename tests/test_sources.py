import socket
import threading

from pyspark.sql import functions as F

from tidemark.operators.agg import count_of, sum_of
from tidemark.plans.session import Session
from tidemark.sources import documents, graphs, keyed
from tidemark.streaming import streams


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_pairs_ignore_further_fields(spark, tmp_path):
    path = write(tmp_path / "kv", "1\x1fasdf", "2\x1fb\x1fmore", "3")
    assert sorted(map(tuple, keyed.read_pairs(spark, path, 2).collect())) == [("1", "asdf"), ("2", "b"), ("3", None)]


def test_partitions_change_no_result(spark, tmp_path):
    pairs = spark.createDataFrame([(str(i), f"v{i}") for i in range(8)], "key string, value string")
    for n in (1, 2, 4):
        keyed.write_pairs(pairs, str(tmp_path / f"p{n}"), n)
        assert sorted(map(tuple, keyed.read_pairs(spark, str(tmp_path / f"p{n}")).collect())) == sorted(map(tuple, pairs.collect()))


def test_update_trace_last_put_wins(spark, tmp_path):
    s = Session(spark)
    t = s.create_table("t", "key", spark.createDataFrame([("1", "a"), ("2", "b")], "key string, value string"))
    t.put_all(keyed.read_updates(spark, write(tmp_path / "u", "1\x1fx", "9\x1fy", "1\x1fz")))
    s.propagate()
    assert sorted(map(tuple, t.df().collect())) == [("1", "z"), ("2", "b"), ("9", "y")]


def test_log_in_both_forms(spark, tmp_path):
    path = write(tmp_path / "log", "generated (1,5)", "---", "adding (2,a,b)", "removing (1,5)", "---", "updating,41,3.7", "removing,91,31")
    got = [tuple(r)[1:] for r in keyed.read_oplog(spark, path).orderBy("seq").collect()]
    assert got == [(0, "generated", "1", "5"), (1, "adding", "2", "a,b"), (1, "removing", "1", "5"), (2, "updating", "41", "3.7"), (2, "removing", "91", "31")]


def test_graph_files(spark, tmp_path):
    path = write(tmp_path / "g", "# comment", "3\t7", "3\t7", "7\t9", "---", "add\t3\t9", "remove\t7\t9")
    edges, ops = graphs.read_graph_trace(spark, path)
    assert sorted(map(tuple, edges.collect())) == [(3, 7), (3, 7), (7, 9)]
    assert [tuple(r)[1:] for r in ops.orderBy("seq").collect()] == [("add", 3, 9), ("remove", 7, 9)]


def test_generators_repeat(spark):
    assert graphs.random_ints(spark, 50, 1).collect() == graphs.random_ints(spark, 50, 1).collect()
    assert graphs.random_ints(spark, 50, 1).select("key").distinct().count() == 50
    degree = graphs.random_edges(spark, 200, 1).count() / 200
    assert 10 < degree < 20
    assert all(1 <= len(r.value.split()) <= 10 for r in graphs.random_texts(spark, 40, 2).collect())


def test_pages(spark):
    d = spark.createDataFrame([('<page><title>A</title><x/><text xml:space="preserve">one\ntwo</text></page><page><title>B</title><text>three</text></page>',)], "value string")
    assert sorted(map(tuple, documents.wiki_pages(d).collect())) == [("A", "one two"), ("B", "three")]


def test_graphs_side_by_side(spark):
    s = Session(spark)
    t = s.create_table("t", "key", spark.createDataFrame([(1, 2), (2, 3)], "key int, value int"))
    f = s.frame(t)
    a, b = s.run_all(f.reduce(sum_of("n", "value")), f.filter("value > 2"))
    t.put(3, value=4)
    s.propagate()
    assert [tuple(r) for r in a.collect()] == [(9,)] and len(b.collect()) == 2


def test_stream_with_removals(spark, tmp_path):
    s = Session(spark)
    t = s.create_table("t", "key", spark.createDataFrame([], "key long, value long"))
    counts = s.run(s.frame(t).reduce_by_key("value", count_of("n")))
    for i, rows in enumerate([[(1, 5, "put"), (2, 5, "put")], [(1, None, "remove"), (3, 6, "put")]]):
        spark.createDataFrame(rows, "key long, value long, op string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.follow(s, t, streams.read_files(spark, str(tmp_path / "in"), "key long, value long, op string", 10))
    assert dict(map(tuple, counts.collect())) == {5: 1, 6: 1}


def test_generated_updates_and_traces(spark, tmp_path):
    edges = graphs.random_edges(spark, 60, 1).distinct()
    ops = graphs.edge_updates(edges, 60, 4)
    assert {r.op for r in ops.collect()} == {"add", "remove"} and ops.filter("op = 'remove'").join(edges, ["src", "dst"], "left_anti").count() == 0
    graphs.write_graph_trace(edges, ops, str(tmp_path / "trace"))
    back, changes = graphs.read_graph_trace(spark, str(tmp_path / "trace"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, edges.collect()))
    assert sorted(tuple(r)[1:] for r in changes.collect()) == sorted(map(tuple, ops.collect()))
    texts = graphs.random_texts(spark, 60, 2)
    assert graphs.text_updates(texts, 3).collect() == graphs.text_updates(texts, 3).collect()
    assert {r.op for r in graphs.text_updates(texts, 3).collect()} == {"update", "remove"}
    keys = graphs.random_ints(spark, 60, 1).select("key")
    assert {(r.op, r.value is None) for r in graphs.seeded_updates(keys, 1, 9).collect()} == {("update", False), ("remove", True)}


def test_update_folder_is_replayed_in_order(spark, tmp_path):
    s = Session(spark)
    t = s.create_table("t", "key", spark.createDataFrame([("1", "a")], "key string, value string"))
    pairs = spark.createDataFrame([(str(i % 4), f"v{i}", i) for i in range(25)], "key string, value string, _seq long")
    keyed.split_updates(pairs, str(tmp_path), 2, 13)
    assert [p.rsplit("/", 1)[1] for p in keyed.update_paths(spark, str(tmp_path))] == [f"2-{i}" for i in range(13)]
    assert keyed.replay(s, t, str(tmp_path)) == 13
    assert dict(map(tuple, t.df().collect())) == {"0": "v24", "1": "v21", "2": "v22", "3": "v23"}


def test_log_in_many_parts(spark, tmp_path):
    lines, want, batch = [], [], 0
    for i in range(400):
        lines.append("---" if i % 7 == 6 else f"adding ({i},v{i})")
        if i % 7 == 6:
            batch += 1
        else:
            want.append((i + 1, batch, "adding", str(i), f"v{i}"))
    path = write(tmp_path / "log", *lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        d = keyed.read_oplog(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        assert [tuple(r) for r in d.orderBy("seq").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_socket_stream_of_edges(spark):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        for _ in range(2):  # the source may connect once to learn the schema
            try:
                peer, _ = server.accept()
                peer.sendall(b"1\t2\n1\t3\n2\t3\n")
            except OSError:
                return

    threading.Thread(target=serve, daemon=True).start()
    seen = []
    edges = streams.read_socket(spark, "127.0.0.1", server.getsockname()[1])
    q = edges.writeStream.foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).start()
    try:
        for _ in range(200):
            if len(seen) >= 3:
                break
            q.awaitTermination(0.1)
    finally:
        q.stop()
        server.close()
    assert sorted(seen) == [(1, 2), (1, 3), (2, 3)]


def test_pages_keep_marks(spark):
    d = spark.createDataFrame([("1", "a < b & c > d &amp; &lt;"), ("2", "")], "k string, t string")
    page = F.concat(F.lit("<page><title>"), F.col("k"), F.lit("</title><text>"), documents.escaped(F.col("t")), F.lit("</text></page>"))
    assert sorted(map(tuple, documents.wiki_pages(d.select(page.alias("value"))).collect())) == [("1", "a < b & c > d &amp; &lt;"), ("2", "")]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    import pytest

    from tidemark import runtime

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session_:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError):
        runtime.scratch_dir(Session_())
