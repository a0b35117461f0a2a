"""Queries over the synthetic tables for each operator, with SQL for the same results.

Events stand for the rows of files of 1,000 rows each (file number, position, sequence); orders for data files of a
manifest and line items for their delete files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.config import ExecutionConfig, PlanningConfig, SortColumn, Strategy
from tidefold.operators import merge, packing, selection
from tidefold.plans.anchors import MemoryAnchors
from tidefold.plans.table import Table
from tidefold.sources.scratch import fresh_dir

CONFIG = PlanningConfig(small_file_threshold_bytes=150_000, min_delete_file_count_threshold=5, min_size_per_partition=4_000_000, target_file_size_bytes=16_000_000)
COLS = ["event_id", "user_id", "event_type"]


def _events(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select(*COLS)
    return e.select("*", F.expr("event_id div 1000").alias("file_no"), (F.col("event_id") % 1000).alias("pos"), (F.expr("event_id div 1000") + 1).alias("seq"))


def _pos(e: DataFrame) -> DataFrame:
    return e.where("event_id % 7 = 0").select("file_no", "pos")


def _eq(e: DataFrame) -> DataFrame:
    return e.where("event_id % 7 = 0").select("event_id", (F.col("event_id") % 3 + 5).alias("seq"))


def _users(e: DataFrame) -> DataFrame:
    return e.where("event_id % 11 = 0").select("user_id", F.lit(4).cast("long").alias("seq"))


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("part"), F.floor("o_totalprice").alias("size"))


def _deletes(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "position_deletes").otherwise("equality_deletes")
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", kind.alias("content"))


E_SQL = "e AS (SELECT event_id, user_id, event_type, event_id // 1000 AS file_no, event_id % 1000 AS pos, event_id // 1000 + 1 AS seq FROM events)"
M_SQL = "m AS (SELECT o_orderkey, o_orderstatus, o_orderpriority AS part, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)"
D_SQL = "d AS (SELECT l_orderkey AS o_orderkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'position_deletes' ELSE 'equality_deletes' END AS content FROM lineitem)"
NO_POS = "NOT EXISTS (SELECT 1 FROM e p WHERE p.event_id % 7 = 0 AND p.file_no = e.file_no AND p.pos = e.pos)"
NO_EQ = "NOT EXISTS (SELECT 1 FROM e x WHERE x.event_id % 7 = 0 AND x.event_id = e.event_id AND e.seq < x.event_id % 3 + 5)"
NO_USER = "NOT EXISTS (SELECT 1 FROM e x WHERE x.event_id % 11 = 0 AND x.user_id = e.user_id AND e.seq < 4)"


def _mor(where: str) -> str:
    return f"WITH {E_SQL} SELECT event_id, user_id, event_type FROM e WHERE {where}"


def mor_no_deletes(s, d):
    return merge.merge_on_read(_events(s, d), COLS)


def mor_position_delete(s, d):
    e = _events(s, d)
    return merge.merge_on_read(e, COLS, _pos(e), position_keys=("file_no", "pos"))


def mor_equality_delete(s, d):
    e = _events(s, d)
    return merge.merge_on_read(e, COLS, equality=[(["event_id"], _eq(e))])


def mor_equality_seq_boundary(s, d):
    e = _events(s, d)
    return merge.merge_on_read(e, COLS, equality=[(["event_id"], e.select("event_id", "seq"))])


def mor_equality_composite(s, d):
    items = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 10).alias("seq"))
    return merge.merge_on_read(items, ["l_orderkey", "l_linenumber", "l_partkey"], equality=[(["l_orderkey", "l_linenumber"], items.where("l_partkey % 5 = 0").select("l_orderkey", "l_linenumber", F.lit(6).cast("long").alias("seq")))])


def mor_equality_multi_file(s, d):
    e = _events(s, d)
    return merge.merge_on_read(e, COLS, equality=[(["event_id"], _eq(e)), (["user_id"], _users(e)), (["event_id"], _eq(e))])


def mor_position_and_equality(s, d):
    e = _events(s, d)
    return merge.merge_on_read(e, COLS, _pos(e), [(["event_id"], _eq(e)), (["user_id"], _users(e))], position_keys=("file_no", "pos"))


def _nulls(s, d, null_safe):
    e = _events(s, d).withColumn("k", F.when(F.col("user_id") % 50 != 0, F.col("user_id")))
    return merge.merge_on_read(e, COLS, equality=[(["k"], e.where("event_id % 100 = 0").select("k", F.lit(6).cast("long").alias("seq")))], null_safe=null_safe)


def mor_null_keys_strict(s, d):
    return _nulls(s, d, False)


def mor_null_keys_nullsafe(s, d):
    return _nulls(s, d, True)


def mor_inline_deletes(s, d):
    """Equality deletes of two sequences and position deletes, all given as rows."""
    late, early = (merge.inline_equality(s, {"event_id": "long"}, rows, seq) for rows, seq in (([(3,), (70,), (71,)], 9), ([(500,), (2500,)], 2)))
    positions = merge.inline_positions(s, {0: [11, 12], 1: [0, 999]}, "file_no", "pos", "long")
    return merge.merge_on_read(_events(s, d), COLS, positions, [late, early], position_keys=("file_no", "pos"))


def mor_shuffle_join(s, d):
    e = _events(s, d)
    return merge.merge_on_read(e, COLS, equality=[(["event_id"], _eq(e))], shuffle=True)


def mor_sorted(s, d):
    e = _events(s, d)
    return merge.merge_on_read(e, COLS, equality=[(["event_id"], _eq(e))], sort=[SortColumn("event_type", True), SortColumn("event_id")])


def select_small_files(s, d):
    return selection.select_files(_manifest(s, d), Strategy.SMALL_FILES, CONFIG).select("o_orderkey", "size")


def select_full(s, d):
    return selection.select_files(_manifest(s, d), Strategy.FULL, CONFIG).select("o_orderkey", "size")


def select_files_with_deletes(s, d):
    m = selection.with_delete_counts(_manifest(s, d), _deletes(s, d), "o_orderkey")
    return selection.select_files(m, Strategy.FILES_WITH_DELETES, CONFIG).select("o_orderkey", "n_deletes")


def group_single(s, d):
    return selection.group_sizes(_manifest(s, d).withColumn("grp", F.lit(0)), "grp")


def group_sizes(s, d):
    return selection.group_sizes(_manifest(s, d), "part")


def group_bin_pack(s, d):
    return packing.bin_pack(_manifest(s, d), "part", "o_orderkey", "size", 1_000_000)


def dedup_delete_files(s, d):
    return selection.dedup_deletes(_deletes(s, d), "o_orderkey", "l_suppkey")


def file_deletes(s, d):
    return selection.file_deletes(_manifest(s, d).select("o_orderkey"), _deletes(s, d), "o_orderkey", "l_suppkey")


def input_totals(s, d):
    """Bytes and files of data and deletes together; a delete file's size is its supplier's number."""
    data = _manifest(s, d).select("part", "o_orderkey", "size")
    deletes = selection.dedup_deletes(_deletes(s, d), "o_orderkey", "l_suppkey").join(data.select("o_orderkey", "part"), "o_orderkey")
    return selection.input_totals(data.select("part", "size").union(deletes.select("part", F.col("l_suppkey").alias("size"))), "part")


def _groups(s, d):
    """Groups of ten orders' numbers each."""
    m = selection.with_delete_counts(_manifest(s, d), _deletes(s, d), "o_orderkey").withColumn("grp", F.col("o_orderkey") % 500)
    return m.groupBy("grp").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_bytes"), F.sum("n_deletes").cast("long").alias("n_deletes"), F.count(F.when(F.col("size") <= CONFIG.small_file_threshold_bytes, 1)).alias("n_small"))


def group_threshold(s, d):
    return selection.by_threshold(_groups(s, d), PlanningConfig(max_file_count_per_partition=30, small_file_threshold_bytes=230_000, max_delete_ratio=4.1)).select("grp", "n_files")


def partition_scores(s, d):
    scored = selection.partition_scores(_groups(s, d).withColumn("hours", F.col("grp") % 48))
    return scored.select("grp", *(F.round(F.col(c) * 1000).cast("long").alias(c) for c in ("fragment_ratio", "score")))


def plan_parallelism(s, d):
    g = group_sizes(s, d)
    return g.select("part", selection.executor_parallelism(F.col("total_bytes"), F.col("n_files"), CONFIG).alias("executors"), selection.output_parallelism(F.col("total_bytes"), CONFIG).alias("outputs"))


def incremental_plan(s, d):
    m = _manifest(s, d)
    return selection.unprocessed(m, m.where("o_orderkey % 3 = 0"), "o_orderkey").select("o_orderkey", "size")


def _results(s, d):
    """Orders as results of tasks: the status letter tells how they ended."""
    status = F.when(F.col("o_orderstatus") == "F", "Success").when(F.col("o_orderstatus") == "O", "Failed").otherwise("Cancelled")
    half = F.expr("size div 2")
    return _manifest(s, d).select(status.alias("status"), F.lit(1).alias("files_removed"), F.expr("cast(o_orderkey % 2 as bigint)").alias("files_added"), F.col("size").alias("bytes_removed"), half.alias("bytes_added"), F.col("size").alias("time_us"), F.col("size").alias("bytes_read"), half.alias("bytes_written"))


def commit_summary(s, d):
    return selection.commit_totals(_results(s, d))


def dry_run_summary(s, d):
    return selection.commit_totals(_results(s, d), dry_run=True)


def task_metrics(s, d):
    return selection.task_totals(_results(s, d))


def compaction_row_conservation(s, d):
    e = _events(s, d)
    live = mor_position_and_equality(s, d)
    counts = e.agg(F.count("*").alias("rows_in")).crossJoin(live.agg(F.count("*").alias("rows_out")))  # one row each
    return counts.select("rows_in", (F.col("rows_in") - F.col("rows_out")).alias("rows_deleted"), "rows_out")


def _table(s, d, sort_by=()):
    """Events as a table of real files by event type: even numbers, then deletes of rows of every seventh by place and
    of the users of every hundredth by key, then odd numbers, which no delete hits."""
    e = s.read.parquet(f"{d}/events.parquet").select(*COLS, "value")
    t = Table.create(s, fresh_dir(s, "events"), e.schema, partition_by=["event_type"], sort_by=sort_by)
    t.append(e.where("event_id % 2 = 0"))
    places = s.read.parquet(*(f.path for f in t.state().files)).where("event_id % 7 = 0")
    t.append(places.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos")).coalesce(1), "position_deletes")
    t.append(e.where("event_id % 100 = 0").select("user_id").coalesce(1), "equality_deletes", [2])
    t.append(e.where("event_id % 2 = 1"))
    return t


def table_merge_on_read(s, d):
    return _table(s, d).read().select(*COLS)


def table_snapshot(s, d):
    return _table(s, d).read(version=2).select(*COLS)


def table_compaction(s, d):
    """What is read after all files of every partition were rewritten as one and committed."""
    t = _table(s, d, [SortColumn("event_id")])
    t.compact(Strategy.FULL, PlanningConfig(), ExecutionConfig())
    return t.read().select(*COLS)


def table_compaction_files(s, d):
    """Live files after a rewrite of all, and those before, of each partition."""
    t = _table(s, d)
    t.compact(Strategy.FULL, PlanningConfig(bin_pack_bytes=None))
    live = t.manifest().groupBy(F.col("partition")[0].alias("event_type"), "content")
    return live.agg(F.count("*").alias("n_files"), F.sum("rows").alias("n_rows"), F.sum("n_deletes").alias("n_deletes"))


def table_incremental_compaction(s, d):
    """Rows of the files that a second planning finds: those that the first rewrite has not made."""
    t, anchors = _table(s, d), MemoryAnchors()
    t.compact(Strategy.FULL, anchors=anchors)
    t.append(s.read.parquet(f"{d}/events.parquet").select(*COLS, "value").where("event_id % 5 = 0"))
    groups = t.plan(Strategy.FULL, processed=anchors.get(t.path).processed)
    return s.createDataFrame([(g.partition[0], sum(f.rows for f in g.data)) for g in groups], "event_type string, n_rows long")


def table_renamed_key(s, d):
    """The key of the deletes and of all files has another name since."""
    t = _table(s, d)
    t.rename_column("user_id", "customer")
    t.append(s.read.parquet(f"{d}/events.parquet").where("event_id % 150 = 0").select(F.col("user_id").alias("customer")), "equality_deletes", [2])
    return t.read().select("event_id", "customer", "event_type")


def table_column_statistics(s, d):
    """Nulls and bounds of each partition's whole-number columns, from the manifest."""
    t = _table(s, d)
    t.compact(Strategy.FULL)
    part = t.manifest().select(F.col("path").alias("file_path"), F.col("partition")[0].alias("event_type"))
    kept = t.statistics().where("column in ('event_id', 'user_id')").join(part, "file_path")
    return kept.groupBy("event_type", "column").agg(F.sum("nulls").alias("nulls"), F.min(F.col("least").cast("long")).alias("least"), F.max(F.col("greatest").cast("long")).alias("greatest"))


QUERIES = [mor_no_deletes, mor_position_delete, mor_equality_delete, mor_equality_seq_boundary, mor_equality_composite, mor_equality_multi_file, mor_position_and_equality, mor_null_keys_strict, mor_null_keys_nullsafe, mor_inline_deletes, mor_shuffle_join, mor_sorted, select_small_files, select_full, select_files_with_deletes, group_single, group_sizes, group_bin_pack, group_threshold, partition_scores, dedup_delete_files, file_deletes, input_totals, plan_parallelism, incremental_plan, commit_summary, dry_run_summary, task_metrics, compaction_row_conservation, table_merge_on_read, table_snapshot, table_compaction, table_compaction_files, table_incremental_compaction, table_renamed_key, table_column_statistics]

_G_SQL = "dc AS (SELECT o_orderkey, count(*) AS n FROM d GROUP BY 1), g AS (SELECT o_orderkey % 500 AS grp, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_deletes, count(*) FILTER (size <= 150000) AS n_small FROM m LEFT JOIN dc USING (o_orderkey) GROUP BY 1)"
_LIVE = "(event_id % 2 = 1 OR (event_id % 7 <> 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 100 = 0)))"
_K = "CASE WHEN {0}.user_id % 50 <> 0 THEN {0}.user_id END".format
_NULLS = "NOT EXISTS (SELECT 1 FROM e x WHERE x.event_id % 100 = 0 AND {} {} {} AND e.seq < 6)"
_SUM = "SELECT count(*) AS files_removed, CAST(coalesce(sum(o_orderkey % 2), 0) AS BIGINT) AS files_added, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_removed, CAST(coalesce(sum(size // 2), 0) AS BIGINT) AS bytes_added, CAST({} AS BIGINT) AS tasks_committed FROM m WHERE o_orderstatus = 'F'"
SQL = {
    "mor_no_deletes": _mor("true"),
    "mor_position_delete": _mor(NO_POS),
    "mor_equality_delete": _mor(NO_EQ),
    "mor_equality_seq_boundary": _mor("NOT EXISTS (SELECT 1 FROM e x WHERE x.event_id = e.event_id AND e.seq < x.seq)"),
    "mor_equality_composite": "WITH e AS (SELECT *, l_suppkey % 10 AS seq FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.l_partkey % 5 = 0 AND x.l_orderkey = e.l_orderkey AND x.l_linenumber = e.l_linenumber AND e.seq < 6)",
    "mor_equality_multi_file": _mor(f"{NO_EQ} AND {NO_USER}"),
    "mor_position_and_equality": _mor(f"{NO_POS} AND {NO_EQ} AND {NO_USER}"),
    "mor_null_keys_strict": _mor(_NULLS.format(_K("x"), "=", _K("e"))),
    "mor_null_keys_nullsafe": _mor(_NULLS.format(_K("x"), "IS NOT DISTINCT FROM", _K("e"))),
    "mor_inline_deletes": _mor("NOT EXISTS (SELECT 1 FROM (VALUES (3, 9), (70, 9), (71, 9), (500, 2), (2500, 2)) v(k, q) WHERE v.k = e.event_id AND e.seq < v.q) AND NOT (file_no = 0 AND pos IN (11, 12)) AND NOT (file_no = 1 AND pos IN (0, 999))"),
    "mor_shuffle_join": _mor(NO_EQ),
    "mor_sorted": _mor(NO_EQ),
    "select_small_files": f"WITH {M_SQL} SELECT o_orderkey, size FROM m WHERE size <= 150000",
    "select_full": f"WITH {M_SQL} SELECT o_orderkey, size FROM m",
    "select_files_with_deletes": f"WITH {M_SQL}, {D_SQL} SELECT o_orderkey, count(*) AS n_deletes FROM m JOIN d USING (o_orderkey) GROUP BY o_orderkey HAVING count(*) >= 5",
    "group_single": f"WITH {M_SQL} SELECT 0 AS grp, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) AS n_files FROM m",
    "group_sizes": f"WITH {M_SQL} SELECT part, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) AS n_files FROM m GROUP BY part",
    "group_bin_pack": f"WITH RECURSIVE {M_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY size DESC, o_orderkey) AS rn FROM m), p AS (SELECT part, o_orderkey, size, rn, CAST(0 AS BIGINT) AS bin, size AS load FROM r WHERE rn = 1 UNION ALL SELECT r.part, r.o_orderkey, r.size, r.rn, CASE WHEN p.load + r.size <= 1000000 THEN p.bin ELSE p.bin + 1 END, CASE WHEN p.load + r.size <= 1000000 THEN p.load + r.size ELSE r.size END FROM p JOIN r ON r.part = p.part AND r.rn = p.rn + 1) SELECT part, o_orderkey, size, bin FROM p",
    "dedup_delete_files": f"WITH {D_SQL} SELECT DISTINCT o_orderkey, content, l_suppkey FROM d",
    "file_deletes": f"WITH {M_SQL}, {D_SQL}, u AS (SELECT DISTINCT o_orderkey, l_suppkey, content FROM d) SELECT m.o_orderkey, count(CASE WHEN content = 'position_deletes' THEN 1 END) AS n_position, count(CASE WHEN content = 'equality_deletes' THEN 1 END) AS n_equality FROM m LEFT JOIN u USING (o_orderkey) GROUP BY m.o_orderkey",
    "plan_parallelism": f"WITH {M_SQL}, g AS (SELECT part, sum(size) AS t, count(*) AS n FROM m GROUP BY part) SELECT part, CAST(greatest(1, least(16, greatest(ceil(t / 4000000.0), ceil(n / 100.0)))) AS BIGINT) AS executors, CAST(greatest(1, least(16, ceil(t / 16000000.0))) AS BIGINT) AS outputs FROM g",
    "incremental_plan": f"WITH {M_SQL} SELECT o_orderkey, size FROM m WHERE o_orderkey % 3 <> 0",
    "commit_summary": f"WITH {M_SQL} " + _SUM.format("count(*)"),
    "dry_run_summary": f"WITH {M_SQL} " + _SUM.format("0"),
    "task_metrics": f"WITH {M_SQL}, a AS (SELECT count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS completed, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS failed, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN size END) AS BIGINT) AS us, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN size // 2 END) AS BIGINT) AS w, CAST(sum(size) AS BIGINT) AS r FROM m) SELECT completed, failed, CAST(CASE WHEN completed + failed = 0 THEN 1000 ELSE completed * 1000 // (completed + failed) END AS BIGINT) AS success_per_mille, CAST(CASE WHEN completed = 0 THEN 0 ELSE us // completed END AS BIGINT) AS average_us, CAST(CASE WHEN r = 0 THEN 1000 ELSE w * 1000 // r END AS BIGINT) AS written_per_mille FROM a",
    "input_totals": f"WITH {M_SQL}, {D_SQL}, u AS (SELECT DISTINCT o_orderkey, content, l_suppkey FROM d), b AS (SELECT part, size FROM m UNION ALL SELECT part, l_suppkey FROM u JOIN m USING (o_orderkey)) SELECT part, CAST(sum(size) AS BIGINT) AS input_bytes, count(*) AS input_files FROM b GROUP BY part",
    "group_threshold": f"WITH {M_SQL}, {D_SQL}, {_G_SQL} SELECT grp, n_files FROM g WHERE n_files > 30 OR total_bytes // n_files < 230000 OR n_deletes > CAST(4.1 AS DOUBLE) * n_files",
    "partition_scores": f"WITH {M_SQL}, {D_SQL}, {_G_SQL}, f AS (SELECT grp, CAST(n_deletes AS DOUBLE) / greatest(n_files, 1) AS r, least(CAST(n_files AS DOUBLE) / 100, CAST(1 AS DOUBLE)) * CAST(0.3 AS DOUBLE) + CAST(n_deletes AS DOUBLE) / greatest(n_files, 1) * CAST(0.3 AS DOUBLE) + least(CAST(grp % 48 AS DOUBLE) / 24, CAST(1 AS DOUBLE)) * CAST(0.2 AS DOUBLE) + CAST(n_small AS DOUBLE) / greatest(n_files, 1) * CAST(0.2 AS DOUBLE) AS s FROM g) SELECT grp, CAST(round(r * 1000) AS BIGINT) AS fragment_ratio, CAST(round(s * 1000) AS BIGINT) AS score FROM f",
    "table_merge_on_read": f"SELECT event_id, user_id, event_type FROM events WHERE {_LIVE}",
    "table_snapshot": "SELECT event_id, user_id, event_type FROM events WHERE event_id % 2 = 0 AND event_id % 7 <> 0",
    "table_compaction": f"SELECT event_id, user_id, event_type FROM events WHERE {_LIVE}",
    "table_compaction_files": f"SELECT event_type, 'data' AS content, CAST(1 AS BIGINT) AS n_files, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_deletes FROM events WHERE {_LIVE} GROUP BY event_type",
    "table_incremental_compaction": "SELECT event_type, count(*) AS n_rows FROM events WHERE event_id % 5 = 0 GROUP BY event_type",
    "table_renamed_key": f"SELECT event_id, user_id AS customer, event_type FROM events WHERE {_LIVE} AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 150 = 0)",
    "table_column_statistics": f"WITH l AS (SELECT * FROM events WHERE {_LIVE}) SELECT event_type, 'event_id' AS \"column\", count(*) - count(event_id) AS nulls, min(event_id) AS least, max(event_id) AS greatest FROM l GROUP BY 1 UNION ALL SELECT event_type, 'user_id', count(*) - count(user_id), min(user_id), max(user_id) FROM l GROUP BY 1",
    "compaction_row_conservation": f"WITH {E_SQL}, l AS (SELECT count(*) AS n FROM e WHERE {NO_POS} AND {NO_EQ} AND {NO_USER}), t AS (SELECT count(*) AS n FROM e) SELECT t.n AS rows_in, t.n - l.n AS rows_deleted, l.n AS rows_out FROM t, l",
}


def queries():
    return {f.__name__: f for f in QUERIES}
