import json
import os
import signal
import time
import urllib.error
import urllib.request

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidefold import queries as q
from tidefold.config import CommitMode, ExecutionConfig, PlanningConfig, ShardingConfig, SortColumn, Strategy
from tidefold.errors import CommitError, CommunicationError, ConfigError, ConflictError, ExecutionError, PlanningError, ResourceExhausted, SchemaError, SerializationError, StorageError, TimeoutExceeded
from tidefold.functions.ids import time_ordered_id
from tidefold.functions.metrics import COUNTERS, Metrics, least_greatest_average, space_savings
from tidefold.functions.retry import COMMIT, Backoff, retried
from tidefold.functions.storage import filesystem_conf, use_filesystem
from tidefold.operators import merge
from tidefold.operators.packing import pack
from tidefold.plans.anchors import Anchor, MemoryAnchors, StoredAnchors
from tidefold.plans.cache import FILE_BYTES, ManifestCache
from tidefold.plans.coordination import Client, Registry
from tidefold.plans.files import File, Group, Result, SizeEstimator, Task, partition_values, sort_order, sort_order_json, validate
from tidefold.plans.health import HealthServer
from tidefold.plans.log import shards
from tidefold.plans.table import Table
from tidefold.plans.worker import Worker
from tidefold.sources.catalog import Catalog
from tidefold.sources.store import Store

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", [f.__name__ for f in q.QUERIES])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(q.SQL[name])
    df = q.queries()[name](spark, SF)
    cols = sorted(want.columns)
    assert cols == sorted(df.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted(want.project(", ".join(f'"{c}"' for c in cols)).fetchall(), key=str)


def test_sorted_order(spark):
    rows = [(r.event_type, r.event_id) for r in q.mor_sorted(spark, SF).collect()]
    assert rows == sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: r[0], reverse=True)


def test_shuffle_join_is_never_a_broadcast(spark):
    plan = q.mor_shuffle_join(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Broadcast" not in plan


def test_packing():
    items = [30, 40, 50, 20, 10]
    assert pack(items, 100) == [1, 0, 0, 1, 1]
    assert pack(items, 100, 10) == [1, 0, 0, 1, 0]
    assert pack([150], 100) == [0]


def test_retry_and_metrics():
    assert [Backoff(4, 100).delay_ms(k) for k in range(4)] == [100, 200, 400, 800]
    assert Backoff(9, 1000, 10, 5000).delay_ms(5) == 5000
    assert COMMIT.delay_ms(0, lambda: 1.0) == 62 and Backoff(1, 100, jitter=0.5, cap_ms=120).delay_ms(0, lambda: 1.0) == 120
    calls, slept = [], []

    def work(error, good=3):
        calls.append(1)
        if len(calls) < good:
            raise error("no")
        return 7

    assert retried(lambda: work(ConflictError), Backoff(2), slept.append) == 7 and len(calls) == 3 and slept == [0.1, 0.2]
    for error, n in ((SerializationError, 1), (StorageError, 3)):
        calls.clear()
        with pytest.raises(error):
            retried(lambda: work(error, 9), Backoff(2), lambda s: None)
        assert len(calls) == n
    assert (ResourceExhausted.delay_ms, ConflictError.delay_ms) == (5000, 50)
    assert str(PlanningError("x").with_context("t")) == "t: x"
    m = Metrics()
    assert m.success_rate == 1.0 and m.compression_ratio == 1.0 and m.average_task_us == 0 and len(COUNTERS) == 17
    m.add("tasks_completed", 9)
    m.add("tasks_failed")
    with m.timed("total_execution_time_us"):
        time.sleep(0.01)
    assert m.success_rate == 0.9 and "tidefold_tasks_failed 1" in m.prometheus() and m.average_task_us > 1000
    with pytest.raises(KeyError):
        m.add("nothing")
    assert space_savings(1000, 800) == pytest.approx(0.2) and space_savings(0, 5) == 0.0
    assert least_greatest_average([]) == (0, 0, 0) and least_greatest_average([1, 2, 6]) == (1, 6, 3)
    assert filesystem_conf("s3://b/x", endpoint="http://h:9000")["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert filesystem_conf("gs://b/x", service_account_file="k") and filesystem_conf("abfss://c@a/x", account="a", account_key="k") and filesystem_conf("/x") == {}
    ids = [time_ordered_id() for _ in range(3)]
    assert len(set(ids)) == 3 and all(i[14] == "7" and i[19] in "89ab" for i in ids)


def rows(spark, n, start=0):
    """The key fixture: numbers, and 216 characters each."""
    return spark.range(start, n).select("id", F.concat(F.lit("value_"), F.lpad(F.lower(F.hex("id")), 16, "0"), F.lit("_" + "x" * 200)).alias("value"))


def test_compaction_round_trip(spark, tmp_path):
    data = rows(spark, 100_000)
    t = Table.create(spark, str(tmp_path / "t"), data.schema)
    t.append(data.where("id < 50000").repartition(2))
    t.append(data.where("id >= 50000").repartition(2))
    t.append(spark.createDataFrame([(25_000,), (25_000,), (None,)], "id long").coalesce(1), "equality_deletes", [1])
    f = next(x for x in t.state().files if x.content == "data")
    t.append(spark.createDataFrame([("file:" + f.path, 0), (f.path, 1)], "file_path string, pos long").coalesce(1), "position_deletes")
    assert t.read().count() == 99_997
    assert t.read(version=2).count() == 100_000
    both = t.plan(Strategy.FILES_WITH_DELETES, PlanningConfig(bin_pack_bytes=None, min_delete_file_count_threshold=2))
    assert [[x.path for x in g.data] for g in both] == [[f.path]] and both[0].input_files == 3 and both[0].input_bytes > both[0].total_bytes
    before = sorted(r.id for r in t.read().collect())
    done = t.compact(Strategy.FULL, PlanningConfig(), ExecutionConfig(sort_columns=(SortColumn("id", True),), compression="uncompressed"))
    assert (done.files_removed, done.files_added, done.tasks_committed, done.errors) == (4, 1, 1, ())
    (only,) = t.state().files
    assert only.size > 5 << 20 and only.rows == 99_997
    assert sorted(r.id for r in t.read().collect()) == before
    stale = t.tasks(t.plan(Strategy.FULL))
    result = t.execute(stale[0])
    t.compact()
    with pytest.raises(CommitError, match="no longer live"):
        t.commit([result], t.version)
    assert t.metrics.average_task_us > 0 and t.metrics.get("commits_failed") == 1


@pytest.mark.parametrize("deletes, left", [([(25_000, 10)], 999), ([(25_000, 1)], 1000), ([(25_000, 0)], 1000), ([(25_000, 10)] * 2, 999), ([], 1000), ([(None, 10)], 1000)])
def test_equality_deletes_by_sequence(spark, deletes, left):
    data = rows(spark, 25_500, 24_500).withColumn("seq", F.lit(1).cast("long"))
    gone = spark.createDataFrame(deletes, "id long, seq long")
    assert merge.merge_on_read(data, ["id", "value"], equality=[(["id"], gone)]).count() == left


def test_names_with_dots_and_quotes(spark):
    data = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "`a.b` long, `c`` d` string").withColumn("seq", F.lit(1).cast("long"))
    keys, gone = merge.inline_equality(spark, {"a.b": "long", "c` d": "string"}, [(1, "x"), (2, "q")], 5)
    got = merge.merge_on_read(data, ["a.b", "c` d"], equality=[(keys, gone)], sort=[SortColumn("a.b", True)])
    assert [tuple(r) for r in got.collect()] == [(3, "z"), (2, "y")] and got.columns == ["a.b", "c` d"]


def test_hidden_columns_do_not_clash(spark, tmp_path):
    """A path that scans URL-encode, and columns named like hidden ones; large deletes are joined by a shuffle."""
    data = spark.range(1000).selectExpr("id as seq", "id % 7 as pos", "concat('p', id) as file_path")
    t = Table.create(spark, str(tmp_path / "a table + 50%"), data.schema)
    t.append(data.coalesce(1))
    t.append(data.coalesce(1))
    t.append(spark.createDataFrame([(3,), (4,)], "seq long"), "equality_deletes", [1])
    first = min(f.path for f in t.state().files if f.content == "data")
    t.append(spark.createDataFrame([(first, 0), (first, 10)], "file_path string, pos long"), "position_deletes")
    for limit in (64 << 20, 0):
        df = t.read(config=ExecutionConfig(broadcast_delete_bytes=limit))
        assert df.columns == data.columns and df.count() == 2000 - 4 - 2
        if not limit:
            assert "BroadcastHashJoin" not in df.drop("x")._jdf.queryExecution().executedPlan().toString().split("LeftAnti")[0]


def test_scan_computes_hidden_columns_only_where_needed(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), spark.range(1).schema)
    t.append(spark.range(100))
    plan = t.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "_metadata" not in plan and "Join" not in plan
    assert {(r.column, r.nulls, r.least) for r in t.statistics().orderBy("file_path").limit(1).collect()} == {("id", 0, "0")}
    assert t.footer_statistics().selectExpr("sum(rows)").first()[0] == 100


def test_one_relation_for_each_key_set(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), spark.range(1).withColumn("k", F.lit(1)).schema)
    t.append(spark.range(100).withColumn("k", F.col("id").cast("int") % 5).coalesce(1))
    for k in range(6):
        t.append(spark.createDataFrame([(k,)], "id long").coalesce(1), "equality_deletes", [1])
    t.append(spark.createDataFrame([(1, 4)], "id long, k int").select(F.lit(4).alias("k")), "equality_deletes", [2])
    df = t.read()
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 3 and df.count() == 75


def test_partitions_deletes_and_sort_order(spark, tmp_path):
    """Groups are of one partition, deletes stay with theirs, and a table's sort order holds in the outputs."""
    data = spark.range(300).selectExpr("id", "case when id % 3 = 0 then 'a/b=c' when id % 3 = 1 then null else 'x y' end as p", "id div 100 as n")
    t = Table.create(spark, str(tmp_path / "t"), data.schema, partition_by=["p"], sort_by=[SortColumn("id", True)])
    t.append(data.where("id < 200").repartition(2))
    t.append(data.where("id >= 200").coalesce(1))
    files = [f for f in t.state().files]
    assert {f.partition for f in files} == {("a/b=c",), (None,), ("x y",)}
    t.append(spark.createDataFrame([(files[0].path, 0)], "file_path string, pos long"), "position_deletes")
    t.append(spark.createDataFrame([("x y", 2)], "p string, n long"), "equality_deletes", [2, 3])
    assert [f.partition for f in t.state().files if f.content == "equality_deletes"] == [("x y",)]
    groups = t.plan(Strategy.FILES_WITH_DELETES)
    assert {g.partition for g in groups} == {files[0].partition, ("x y",)}
    assert next(f for f in t.state().files if f.content == "position_deletes").targets == (files[0].path,)
    want = sorted(map(tuple, t.read().collect()), key=str)
    done = t.compact(Strategy.FULL, execution=ExecutionConfig(max_rows_per_file=40))
    assert done.tasks_committed == 3 and sorted(map(tuple, t.read().collect()), key=str) == want
    assert all(f.rows <= 40 for f in t.state().files) and {f.content for f in t.state().files} == {"data"}
    for f in t.state().files:
        ids = [r.id for r in spark.read.parquet(f.path).collect()]
        assert ids == sorted(ids, reverse=True)
    assert partition_values(File("", 0, 0, 0, partition=("7",)), data.schema, ["n"]) == {"n": 7}
    with pytest.raises(SchemaError):
        partition_values(File("", 0, 0, 0, partition=("7",)), StructType([StructField("b", BinaryType())]), ["b"])
    assert sort_order(sort_order_json([SortColumn("id", True)])) == (SortColumn("id", True),) and sort_order_json([]) is None


def test_rewrites_use_the_executors(spark, tmp_path):
    """The scan has as many tasks as the plan asks for, however few files come out."""
    t = Table.create(spark, str(tmp_path / "t"), rows(spark, 1).schema)
    t.append(rows(spark, 40_000).repartition(4))
    t.append(spark.createDataFrame([(7,)], "id long"), "equality_deletes", [1])
    (task,) = t.tasks(t.plan(Strategy.FULL), PlanningConfig(min_size_per_partition=1000, max_parallelism=4))
    assert (task.executors, task.outputs) == (4, 1)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rewrite", "x")
    result = t.execute(task)
    spark.sparkContext.setJobGroup("", "")
    widths = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("rewrite") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert result.status == "Success" and len(result.added) == 1 and result.rows_out == 39_999 and max(widths) >= 4


def test_failures_are_reported(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), spark.range(1).schema)
    for k in range(3):
        t.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
    os.unlink(t.state().files[0].path)
    single = PlanningConfig(bin_pack_bytes=1)
    with pytest.raises(ExecutionError, match="nothing is committed"):
        t.compact(planning=single, execution=ExecutionConfig(all_or_nothing=True))
    assert t.version == 3
    done = t.compact(planning=single)
    assert (done.tasks_committed, done.tasks_failed) == (2, 1) and "Failed" in done.errors[0]
    assert t.metrics.get("tasks_failed") == 2


def test_deletes_between_plan_and_commit(spark, tmp_path):
    """Later equality deletes still aim at the new files; later position deletes of an input stop the commit."""
    t = Table.create(spark, str(tmp_path / "t"), spark.range(1).schema)
    t.append(spark.range(10).coalesce(1))
    t.append(spark.range(10, 20).coalesce(1))
    one, two = (t.execute(x) for x in t.tasks(t.plan(Strategy.FULL, PlanningConfig(bin_pack_bytes=1))))
    t.append(spark.createDataFrame([(3,), (13,)], "id long").coalesce(1), "equality_deletes", [1])
    t.append(spark.createDataFrame([(two.removed[0].path, 0)], "file_path string, pos long").coalesce(1), "position_deletes")
    want = sorted(r.id for r in t.read().collect())
    with pytest.raises(CommitError, match="position deletes"):
        t.commit([one, two], t.version)
    assert t.commit([one], t.version).tasks_committed == 1
    assert sorted(r.id for r in t.read().collect()) == want and len(want) == 17


def test_log_checkpoints_and_expiry(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), spark.range(1).schema)
    for k in range(11):
        t.append(spark.range(k, k + 1).coalesce(1))
    assert os.path.exists(f"{t.path}/_log/{10:020d}.checkpoint/_SUCCESS")
    assert sorted(r.id for r in t.read().collect()) == list(range(11)) and t.read(version=4).count() == 4
    change = json.loads(t.store.read(f"{t.path}/_log/{11:020d}.json"))
    assert len(change["add"]) == 1 and change["remove"] == []  # a commit writes what it changes
    t.compact()
    assert t.expire(1, older_than_s=-60) == 11 and t.log.versions() == [12]
    assert t.read().count() == 11 and len(list(t.store.list(f"{t.path}/data"))) == 1
    with pytest.raises(PlanningError):
        t.read(version=4)
    with pytest.raises(ConfigError):
        Table.create(spark, t.path, spark.range(1).schema)
    assert [list(x) for x in shards(list("abcdef"), ShardingConfig(3, 2))] == [list("abc"), list("def")] and shards([], ShardingConfig()) == []


def test_stores(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create(f"{tmp_path}/a/x", b"1")
    with pytest.raises(ConflictError):
        store.create(f"{tmp_path}/a/x", b"2")
    assert store.read(f"{tmp_path}/a/x") == b"1" and [f.path for f in store.list(str(tmp_path))] == [f"{tmp_path}/a/x"]
    with pytest.raises(ConfigError):
        Store(spark, "s3a://bucket/t")
    kept = {}
    hooked = Store(spark, "s3a://bucket/t", lambda p, d: kept.setdefault(p, d) is d)
    hooked.create("s3a://bucket/t/x", b"1")
    use_filesystem(spark, "s3a://bucket/t", endpoint="http://h:9000", access_key="k", secret_key="s")
    assert spark.sparkContext._jsc.hadoopConfiguration().get("fs.s3a.endpoint") == "http://h:9000"
    with pytest.raises(ConflictError):
        hooked.create("s3a://bucket/t/x", b"2")


def test_table_by_a_path_that_only_hadoop_reads(spark, tmp_path):
    """viewfs onto the local disk: listing, reading and exclusive creation go through Hadoop's file systems."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.own.link./t", f"file://{tmp_path}")
    t = Table.create(spark, "viewfs://own/t/one", spark.range(1).schema)
    t.append(spark.range(10).coalesce(1))
    t.append(spark.range(10, 20).coalesce(1))
    assert t.compact().files_removed == 2 and sorted(r.id for r in t.read().collect()) == list(range(20))
    with pytest.raises(ConflictError):
        t.log.append(t.version, {})


def test_catalog_cache_and_anchors(spark, tmp_path):
    now = [0.0]
    cache = ManifestCache(max_bytes=6 * FILE_BYTES, ttl_seconds=10, clock=lambda: now[0])
    c = Catalog(spark, str(tmp_path), cache)
    t = c.create_table("ns", "b", spark.range(1).schema)
    c.create_table("ns", "a", spark.range(1).schema)
    assert c.list_tables("ns") == ["a", "b"] and c.list_tables("none") == []
    t.append(spark.range(10).repartition(2))
    for at, hits in ((0.0, 0), (5.0, 1), (11.0, 1)):
        now[0] = at
        cache.hits = 0 if at == 0.0 else cache.hits
        if at == 0.0:
            cache.forget(t.path)
        assert len(c.load("ns.b").state().files) == 2 and cache.hits == hits
    for v in range(9):
        cache.get("x", v, lambda: (None, [1]))
    assert cache.used_bytes <= 6 * FILE_BYTES
    for wrong in ("ns.nope", "b"):
        with pytest.raises(PlanningError):
            c.load(wrong)
    with pytest.raises(ConfigError):
        c.load_table("..", "b")
    for anchors in (MemoryAnchors(), StoredAnchors(Store(spark, str(tmp_path / "anchors")))):
        done = frozenset(f.path for f in t.state().files[:1])
        anchors.put(Anchor(t.path, 2, done))
        anchors.put(Anchor(t.path, 1))
        assert anchors.get(t.path) == Anchor(t.path, 2, done)
        assert [[f.path for f in g.data] for g in t.plan(Strategy.FULL, processed=anchors.get(t.path).processed)] == [[f.path for f in t.state().files if f.path not in done]]
        anchors.delete(t.path)
        assert anchors.get(t.path) is None
    assert t.compact(anchors=anchors).files_removed == 2 and t.compact(anchors=anchors).files_removed == 0
    t.append(spark.range(5).coalesce(1))
    assert t.compact(anchors=anchors).files_removed == 1


def test_worker(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), spark.range(1).schema)
    for _ in range(3):
        t.append(spark.range(1000).coalesce(1))
    w = Worker(t, capacity=1)
    files = t.state().files
    one, two = t.tasks([Group(tuple(files[:2])), Group(tuple(files[2:]))])
    assert Task.from_json(one.to_json()) == one
    with pytest.raises(SerializationError):
        Task.from_json("{}")
    task = w.submit_json(one.to_json())
    with pytest.raises(ResourceExhausted):
        w.submit(two)
    result = w.result(task)
    assert w.status(task) == "Success" and result.rows_out == 2000 and result.elapsed_ms > 0 and not w.cancel(task)
    assert json.loads(result.outputs)[0].keys() == {"path", "size", "count", "partition"}
    stopped = w.submit(two)
    with pytest.raises(TimeoutExceeded):
        w.result(stopped, 0.0)
    assert w.cancel(stopped) and w.result(stopped).status == "Cancelled" and w.status(stopped) == "Cancelled"
    dry = t.commit([result, w.result(stopped)], t.version, CommitMode.NONE)
    assert (dry.files_removed, dry.tasks_committed, dry.tasks_failed) == (2, 0, 1) and len(t.state().files) == 3
    assert w.drain() and not w.ready
    with pytest.raises(ConfigError):
        t.commit([result], t.version, CommitMode.WORKER)
    for bad in (Result("x", "Failed"), Result("x", "Success", rows_out=3)):
        with pytest.raises(CommitError):
            validate(bad)
    with pytest.raises(CommitError):
        validate(result, "{")
    assert t.commit([result, w.result(stopped)], t.version).tasks_committed == 1 and t.read().count() == 3000


def test_health_signals_and_coordination(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), spark.range(1).schema)
    w = Worker(t, 2)
    server = HealthServer(w)

    def get(at):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.port}{at}") as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, ""

    assert get("/healthz") == (200, "OK") and get("/health/ready") == (200, "OK") and get("/nothing")[0] == 404
    assert json.loads(get("/health")[1])["capacity"] == 2 and "tidefold_tasks_started 0" in get("/metrics")[1]
    now = [0.0]
    registry = Registry(30, lambda: now[0])
    client = Client(registry, w, "one", every_s=0.05)
    assert registry.available() == ["one"]
    with pytest.raises(CommunicationError):
        registry.heartbeat("two", ())
    registry.cancel("some task")
    assert client.beat() == []
    client.close()
    now[0] = 100.0
    assert registry.available() == []
    before = {s: signal.getsignal(s) for s in (signal.SIGTERM, signal.SIGINT)}
    try:
        w.drain_on_signals(1.0)
        os.kill(os.getpid(), signal.SIGTERM)
        for _ in range(40):
            if not w.ready:
                break
            time.sleep(0.05)
        assert get("/readyz")[0] == 503 and get("/health/live")[0] == 200
    finally:
        for s, h in before.items():
            signal.signal(s, h)
        server.close()


def test_sizes():
    e = SizeEstimator(0.2)
    assert e.rows_a_file(1000, None) == 0 and e.rows_a_file(1000, 7) == 7
    e.seed([File("", 1000, 10, 1)])
    assert e.rows_a_file(1000, None) == 10
    e.finished([File("", 500, 10, 1)])
    assert e.bytes_a_row == pytest.approx(0.2 * 50 + 0.8 * 100) and e.rows_a_file(900, 500) == 10


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
