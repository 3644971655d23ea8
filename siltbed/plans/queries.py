"""A query for each operator over the test tables, and SQL for the same rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import keys
from siltbed.functions.merge import APPEND
from siltbed.operators import dml, maps, resolve, scan, stats
from siltbed.plans import oplog
from siltbed.sources.store import Store
from siltbed.streaming import upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Parts of the SQL: the log, its levels, and its resolved rows.
OPS = """ops AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') || '/' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS k,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v, event_id AS seq, event_type = 'error' AS del, event_type, user_id FROM events),
lev AS (SELECT *, CASE WHEN seq * 10 >= 9 * (SELECT max(seq) FROM ops) THEN 0 WHEN seq * 10 >= 6 * (SELECT max(seq) FROM ops) THEN 1 ELSE 2 END AS level FROM ops),
res AS (SELECT k, v, seq, del FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM ops) WHERE n = 1),
reslev AS (SELECT k, v, seq, del, level FROM (SELECT *, row_number() OVER (PARTITION BY level, k ORDER BY seq DESC) AS n FROM lev) WHERE n = 1)"""
LIVE = f"WITH {OPS} SELECT k, v, seq FROM res WHERE NOT del"
RECORDS = "records AS (SELECT source AS map, lpad(CAST(doc_id AS VARCHAR), 10, '0') AS k, lang AS v FROM documents)"
REQUESTS = f"""{RECORDS}, requests AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'none' ELSE 'src' || CAST((doc_id + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) % 20 AS VARCHAR) END AS map,
  lpad(CAST(doc_id AS VARCHAR), 10, '0') AS k, 'q' || CAST(quality AS VARCHAR) AS v FROM labels),
looked AS (SELECT q.map, q.k, q.v, r.v AS stored, r.k IS NOT NULL AS hit, q.map IN (SELECT map FROM records) AS there FROM requests q LEFT JOIN records r ON r.map = q.map AND r.k = q.k)"""


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# -- scans


@query(LIVE)
def kv_resolve(spark, sf_dir):
    return resolve.live(oplog.ops(spark, sf_dir)).orderBy("k")


@query(f"WITH {OPS} SELECT k, v FROM res WHERE NOT del")
def kv_scan_all(spark, sf_dir):
    return scan.ordered(resolve.live(oplog.ops(spark, sf_dir)).select("k", "v"))


@query(f"WITH {OPS} SELECT k, v FROM res WHERE NOT del AND k >= '00000100'")
def kv_scan_from(spark, sf_dir):
    return scan.ordered(resolve.live(scan.bounded(oplog.ops(spark, sf_dir), start="00000100")).select("k", "v"))


@query(f"WITH {OPS} SELECT k, v, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS rank FROM res WHERE NOT del AND k >= '00000010' AND k < '00000050' ORDER BY k LIMIT 25")
def kv_range_scan_limit(spark, sf_dir):
    from pyspark.sql import Window

    rows = scan.ordered(resolve.live(scan.bounded(oplog.ops(spark, sf_dir), start="00000010", end="00000050")).select("k", "v"), limit=25)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("k")))


@query(f"WITH {OPS} SELECT k, v, seq, del AS is_delete FROM res")
def kv_scan_tombstones(spark, sf_dir):
    return scan.ordered(resolve.resolve(oplog.ops(spark, sf_dir)))


@query(f"WITH {OPS} SELECT (SELECT min(k) FROM res WHERE NOT del) AS min_key, (SELECT max(k) FROM res WHERE NOT del) AS max_key, (SELECT count(*) FROM res WHERE NOT del) AS n")
def kv_min_max_key(spark, sf_dir):
    return scan.min_max(resolve.live(oplog.ops(spark, sf_dir)))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id >= 10 AND conv_id < 40 AND turn >= 1")
def kv_composite_prefix(spark, sf_dir):
    """Rows with keys of a conversation's and a turn's number, in the range of the first and filtered by the second."""
    rows = oplog.table(spark, sf_dir, "conversations").withColumn("k", F.concat(keys.integer_key(F.col("conv_id")), keys.integer_key(F.col("turn"))))
    low, high = ((n).to_bytes(8, "big") for n in (10, 40))
    picked = rows.filter((F.col("k") >= F.lit(low)) & (F.col("k") < F.lit(high)) & (F.col("turn") >= 1))
    return picked.orderBy("k").select("conv_id", "turn", "role", "text")


# -- lookups

KEY = "00000042/17"


@query(f"WITH {OPS} SELECT k, v, seq, CAST(level AS INTEGER) AS level FROM (SELECT *, row_number() OVER (ORDER BY level, seq DESC) AS n FROM lev WHERE k IN (SELECT min(k) FROM ops WHERE k >= '{KEY}')) WHERE n = 1 AND NOT del")
def kv_get_first(spark, sf_dir):
    rows = oplog.ops(spark, sf_dir)
    key = rows.filter(F.col("k") >= KEY).agg(F.min("k")).first()[0]
    return scan.get_first(oplog.with_level(rows, oplog.last_seq(rows)), key)


@query(f"WITH {OPS} SELECT k, string_agg(CAST(seq AS VARCHAR), '' ORDER BY seq) AS s, max(seq) AS seq FROM ops o WHERE k IN (SELECT min(k) FROM ops WHERE k >= '{KEY}') AND seq > COALESCE((SELECT max(seq) FROM ops d WHERE d.k = o.k AND d.del), -1) GROUP BY k")
def kv_get_merge(spark, sf_dir):
    rows = oplog.ops(spark, sf_dir)
    key = rows.filter(F.col("k") >= KEY).agg(F.min("k")).first()[0]
    return scan.get(rows.select("k", F.col("seq").cast("string").alias("s"), "seq", "is_delete"), key, merge=APPEND)


@query(f"""WITH {OPS}, asked AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '/' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS k FROM customer)
SELECT a.c_custkey, a.k, r.v, r.seq, r.k IS NOT NULL AS found FROM asked a LEFT JOIN (SELECT * FROM res WHERE NOT del) r ON r.k = a.k""")
def kv_find_batch(spark, sf_dir):
    asked = oplog.table(spark, sf_dir, "customer").select("c_custkey", oplog.spread_key("c_custkey", "c_custkey").alias("k"))
    return scan.find(oplog.ops(spark, sf_dir), asked).select("c_custkey", "k", "v", "seq", "found")


# -- folds and levels


@query(f"WITH {OPS} SELECT k, string_agg(CAST(seq AS VARCHAR), '' ORDER BY seq) AS s, max(seq) AS seq FROM ops o WHERE seq > COALESCE((SELECT max(seq) FROM ops d WHERE d.k = o.k AND d.del), -1) GROUP BY k")
def kv_append_fold(spark, sf_dir):
    rows = oplog.ops(spark, sf_dir).select("k", F.col("seq").cast("string").alias("s"), "seq", "is_delete")
    return resolve.live(rows, merge=APPEND)


@query(LIVE)
def kv_scan_levels(spark, sf_dir):
    parts = [resolve.resolve(df) for df in oplog.levels(spark, sf_dir)]
    return resolve.by_precedence(parts).filter(~F.col("is_delete")).select("k", "v", "seq")


@query(f"""WITH {OPS}, n AS (SELECT * FROM reslev WHERE level = 0), o AS (SELECT * FROM reslev WHERE level = 1)
SELECT COALESCE(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v, COALESCE(n.seq, o.seq) AS seq, COALESCE(n.del, o.del) AS is_delete FROM n FULL OUTER JOIN o ON n.k = o.k""")
def kv_merge_c0_c1(spark, sf_dir):
    new, old, _ = oplog.levels(spark, sf_dir)
    return resolve.merged(old, new)


@query(f"""WITH {OPS}, n AS (SELECT * FROM reslev WHERE level = 1), o AS (SELECT * FROM reslev WHERE level = 2)
SELECT k, v, seq FROM (SELECT COALESCE(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v, COALESCE(n.seq, o.seq) AS seq, COALESCE(n.del, o.del) AS del FROM n FULL OUTER JOIN o ON n.k = o.k) WHERE NOT del""")
def kv_merge_c1_c2(spark, sf_dir):
    _, new, old = oplog.levels(spark, sf_dir)
    return resolve.merged(old, new, drop_deletes=True).select("k", "v", "seq")


@query(f"WITH {OPS} SELECT k, seq FROM reslev a WHERE level = 0 AND del AND k NOT IN (SELECT k FROM reslev WHERE level > 0)")
def kv_compact_purge(spark, sf_dir):
    new, *below = (resolve.resolve(df) for df in oplog.levels(spark, sf_dir))
    return resolve.purgeable(new, below).select("k", "seq")


@query(f"WITH {OPS} SELECT k, v, seq FROM res WHERE NOT del AND seq >= (SELECT max(seq) FROM ops) - 2000")
def kv_ttl(spark, sf_dir):
    rows = oplog.ops(spark, sf_dir)
    return resolve.unexpired(resolve.resolve(rows), oplog.last_seq(rows), 2000).filter(~F.col("is_delete")).drop("is_delete")


@query(f"WITH {OPS} SELECT k, seq, v FROM lev a WHERE level = 0 AND NOT EXISTS (SELECT 1 FROM reslev b WHERE b.level = 0 AND b.k = a.k AND b.seq = a.seq)")
def kv_collect_garbage(spark, sf_dir):
    new, *_ = oplog.levels(spark, sf_dir)
    return dml.collect_garbage(new, resolve.resolve(new)).select("k", "seq", "v")


# -- writes


@query(LIVE)
def kv_upsert(spark, sf_dir):
    new, middle, old = oplog.levels(spark, sf_dir)
    state = dml.upsert(resolve.resolve(old), middle)
    return dml.upsert(state, new).filter(~F.col("is_delete")).drop("is_delete")


@query(LIVE)
def kv_bulk_insert(spark, sf_dir):
    return dml.bulk_insert(oplog.levels(spark, sf_dir)).filter(~F.col("is_delete")).drop("is_delete")


@query(LIVE)
def kv_log_replay(spark, sf_dir):
    """What was durable, and the whole log read again with its newest part twice."""
    new, middle, old = oplog.levels(spark, sf_dir)
    durable = oplog.last_seq(old)
    log = old.unionByName(middle).unionByName(new).unionByName(new)
    return dml.replay(log, resolve.resolve(old), durable).filter(~F.col("is_delete")).drop("is_delete")


@query("SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS k, value AS v, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1")
def kv_test_and_set_absent(spark, sf_dir):
    """All events claim their user's key of an empty table."""
    asks = oplog.table(spark, sf_dir, "events").select(F.lpad(F.col("user_id").cast("string"), 8, "0").alias("k"), F.col("value").alias("v"), F.col("event_id").alias("seq"))
    empty = asks.limit(0).withColumn("is_delete", F.lit(False))
    return dml.test_and_set_absent(empty, asks)


@query(f"WITH {OPS} SELECT a.k, a.seq, a.v AS expected FROM reslev a JOIN res r ON r.k = a.k WHERE a.level = 2 AND NOT a.del AND NOT r.del AND a.v = r.v")
def kv_test_and_set_match(spark, sf_dir):
    """Writers that saw the oldest level ask to replace the values they saw."""
    old = oplog.levels(spark, sf_dir)[2]
    asks = resolve.live(old).select("k", "seq", F.col("v").alias("expected"))
    return dml.test_and_set_match(oplog.ops(spark, sf_dir), asks)


@query(f"WITH {OPS} SELECT k, CAST(NULL AS DOUBLE) AS v, (SELECT max(seq) FROM ops) + 1 AS seq, TRUE AS is_delete FROM res WHERE NOT del")
def kv_drop_database(spark, sf_dir):
    rows = oplog.ops(spark, sf_dir)
    return dml.drop_all(rows, oplog.last_seq(rows) + 1)


@query("SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def kv_copy_database(spark, sf_dir):
    """A full scan written to another store, and what arrived there."""
    rows = oplog.table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("k"), "source", "text", F.col("doc_id").alias("seq"), F.lit(False).alias("is_delete"))
    store = Store.create(spark, fresh_folder(spark, "copy"))
    store.insert(rows)
    return store.live().groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query(LIVE)
def kv_flush_equiv(spark, sf_dir):
    """Three batches in a store, flushed after two of them and compacted to the bottom: the read is the log's state."""
    store = Store.create(spark, fresh_folder(spark, "flush"))
    new, middle, old = oplog.levels(spark, sf_dir)
    store.insert(old)
    store.insert(middle)
    store.flush()
    store.insert(new)
    store.compact(0)
    store.compact(1)
    return Store.open(spark, store.path).live().select("k", "v", "seq")


@query(f"WITH {OPS} SELECT k, v FROM res WHERE NOT del AND k >= '00000050' AND k <= '00000090'")
def kv_store_scan(spark, sf_dir):
    """A range of a store's keys over two levels of runs."""
    store = Store.create(spark, fresh_folder(spark, "scan"))
    new, middle, old = oplog.levels(spark, sf_dir)
    store.insert(old)
    store.compact(0)
    store.insert(middle)
    store.insert(new)
    return Store.open(spark, store.path).scan("00000050", "00000090", end_included=True).select("k", "v")


@query(f"WITH {OPS} SELECT k, v, seq FROM res WHERE NOT del AND seq >= (SELECT max(seq) FROM ops) - 2000")
def kv_store_ttl(spark, sf_dir):
    """A store whose rows expire, compacted in part: expired rows neither show nor uncover what is older."""
    store = Store.create(spark, fresh_folder(spark, "ttl"), expiry=2000)
    new, middle, old = oplog.levels(spark, sf_dir)
    store.insert(old)
    store.compact(0)
    store.compact(1)
    store.insert(middle)
    store.insert(new)
    store.compact(0)
    return Store.open(spark, store.path).live().select("k", "v", "seq")


@query(LIVE)
def kv_store_late_ops(spark, sf_dir):
    """Batches that come in the wrong order, one of them twice."""
    store = Store.create(spark, fresh_folder(spark, "late"))
    new, middle, old = oplog.levels(spark, sf_dir)
    for part in (new, old, middle, old):
        store.insert(part)
    store.compact(0)
    return Store.open(spark, store.path).live().select("k", "v", "seq")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster shares checkpoints; on a single machine, where none is named, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="siltbed-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


# -- statistics


@query(f"""WITH {OPS}, live AS (SELECT k, row_number() OVER (ORDER BY k) AS i, count(*) OVER () AS n FROM res WHERE NOT del),
s AS (SELECT *, CASE WHEN n > 10 THEN n // 9 + 1 ELSE 1 END AS stride FROM live)
SELECT k, CAST(i AS BIGINT) AS i, CAST(stride AS BIGINT) AS stride FROM s WHERE (i - 1) % stride = 0 OR i = n""")
def kv_histogram(spark, sf_dir):
    return stats.histogram(resolve.live(oplog.ops(spark, sf_dir)), 10)


@query("""SELECT source, count(*) AS n, CAST(sum(8 + 10 + strlen(text)) AS BIGINT) AS bytes,
greatest(CAST(sum(18 + strlen(text)) + 220 * count(*) AS DOUBLE), 1.04 * CAST(sum(18 + strlen(text)) AS DOUBLE)) AS memory_bytes FROM documents GROUP BY source""")
def kv_space_usage(spark, sf_dir):
    rows = oplog.table(spark, sf_dir, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("k"), "text")
    return stats.space_usage(rows, keys.row_bytes(F.col("k"), F.col("text")), "source")


@query(f"WITH {OPS} SELECT level, count(*) AS ops, count(DISTINCT k) AS keys, CAST(sum(CAST(del AS BIGINT)) AS BIGINT) AS tombstones FROM lev GROUP BY level")
def kv_merge_stats(spark, sf_dir):
    rows = oplog.ops(spark, sf_dir)
    return stats.level_stats(oplog.with_level(rows, oplog.last_seq(rows)))


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def kv_request_stats(spark, sf_dir):
    return stats.request_stats(oplog.table(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT o_custkey, o_orderkey, cents, avg(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS mean FROM c""")
def kv_running_mean(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    return stats.running_mean(oplog.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", cents), "o_custkey", "o_orderkey", "cents")


@query("""WITH m AS (SELECT event_type, epoch_us(ts) AS us, min(value) AS x FROM events GROUP BY 1, 2),
g AS (SELECT *, lag(us) OVER (PARTITION BY event_type ORDER BY us) AS b, max(us) OVER (PARTITION BY event_type) AS e FROM m)
SELECT event_type, round(sum((CASE WHEN b IS NULL THEN 1.0 ELSE 1 - exp(-(us - b) / 6e7) END) * x * exp((us - e) / 6e7)), 6) AS rate FROM g GROUP BY event_type""")
def kv_decayed_rate(spark, sf_dir):
    samples = oplog.table(spark, sf_dir, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), "value")
    return stats.decayed(samples, "event_type", "s", "value").withColumn("rate", F.round("rate", 6))


@query(f"WITH {OPS} SELECT level, k, seq FROM (SELECT *, lag(k) OVER (PARTITION BY level ORDER BY seq) AS b FROM lev) WHERE b >= k")
def kv_order_check(spark, sf_dir):
    """Arrival isn't in key order; the check finds each place."""
    rows = oplog.ops(spark, sf_dir)
    return resolve.out_of_order(oplog.with_level(rows, oplog.last_seq(rows)), "k", "level").select("level", "k", "seq")


# -- named maps


@query("SELECT DISTINCT source AS name FROM documents")
def map_list(spark, sf_dir):
    return maps.list_maps(oplog.catalogue(spark, sf_dir))


@query("SELECT max(CAST(substr(source, 4) AS BIGINT)) + 4 AS next_id FROM documents")
def map_next_id(spark, sf_dir):
    return maps.next_id(oplog.catalogue(spark, sf_dir))


@query("SELECT n.name, CASE WHEN n.name IN (SELECT source FROM documents) THEN 'MapExists' ELSE 'Success' END AS response_code FROM (SELECT DISTINCT 'src' || CAST(n_nationkey AS VARCHAR) AS name FROM nation) n")
def map_add(spark, sf_dir):
    names = oplog.table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("name"))
    return maps.add_maps(oplog.catalogue(spark, sf_dir), names)


@query(f"WITH {RECORDS} SELECT map, count(*) AS n FROM records WHERE map <> 'src3' GROUP BY map")
def map_drop(spark, sf_dir):
    return maps.drop_map(oplog.records(spark, sf_dir), "src3").groupBy("map").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT name, CAST((SELECT max(CAST(substr(source, 4) AS BIGINT)) + 3 FROM documents) + row_number() OVER (ORDER BY name) AS BIGINT) AS id
FROM (SELECT DISTINCT 'src' || CAST(n_nationkey AS VARCHAR) AS name FROM nation) WHERE name NOT IN (SELECT source FROM documents)""")
def map_add_ids(spark, sf_dir):
    names = oplog.table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("name"))
    return maps.new_maps(oplog.catalogue(spark, sf_dir), names)


@query(f"""WITH {RECORDS}, asked AS (SELECT DISTINCT 'src' || CAST(n_nationkey AS VARCHAR) AS name FROM nation WHERE n_nationkey % 4 = 1)
SELECT map, k, v FROM records WHERE map NOT IN (SELECT name FROM asked)""")
def map_drop_records(spark, sf_dir):
    """The records that are left when some maps, of which some don't exist, have been dropped."""
    names = oplog.table(spark, sf_dir, "nation").filter("n_nationkey % 4 = 1").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("name"))
    records = oplog.records(spark, sf_dir)
    return maps.after_writes(records, maps.dropped_records(records, maps.drop_maps(oplog.catalogue(spark, sf_dir), names)))


@query("SELECT DISTINCT 'src' || CAST(n_nationkey AS VARCHAR) AS name, CASE WHEN 'src' || CAST(n_nationkey AS VARCHAR) IN (SELECT source FROM documents) THEN 'Success' ELSE 'MapNotFound' END AS response_code FROM nation")
def map_drop_codes(spark, sf_dir):
    names = oplog.table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("name"))
    return maps.drop_maps(oplog.catalogue(spark, sf_dir), names)


@query(f"WITH {REQUESTS} SELECT map, k, stored AS v, CASE WHEN NOT there THEN 'MapNotFound' WHEN NOT hit THEN 'RecordNotFound' ELSE 'Success' END AS response_code FROM looked")
def map_get(spark, sf_dir):
    return maps.get(*_maps(spark, sf_dir))


@query(f"WITH {REQUESTS} SELECT map, k, v, CASE WHEN NOT there THEN 'MapNotFound' ELSE 'Success' END AS response_code FROM looked")
def map_put(spark, sf_dir):
    return maps.put(*_maps(spark, sf_dir))


@query(f"WITH {REQUESTS} SELECT map, k, v, CASE WHEN NOT there THEN 'MapNotFound' WHEN hit THEN 'RecordExists' ELSE 'Success' END AS response_code FROM looked")
def map_insert(spark, sf_dir):
    return maps.insert(*_maps(spark, sf_dir))


@query(f"WITH {REQUESTS} SELECT map, k, v, CASE WHEN NOT there THEN 'MapNotFound' WHEN NOT hit THEN 'RecordNotFound' ELSE 'Success' END AS response_code FROM looked")
def map_update(spark, sf_dir):
    return maps.update(*_maps(spark, sf_dir))


@query(f"WITH {REQUESTS} SELECT map, k, v FROM records r WHERE NOT EXISTS (SELECT 1 FROM looked q WHERE q.hit AND q.map = r.map AND q.k = r.k)")
def map_remove(spark, sf_dir):
    """The records that are left after requests to remove."""
    catalogue, records, requests = _maps(spark, sf_dir)
    done = maps.remove(catalogue, records, requests).withColumn("v", F.lit(None).cast("string"))
    return maps.after_writes(records, done)


@query(f"WITH {RECORDS} SELECT map, k, v FROM records WHERE map = 'src0' AND k > '0000000000' AND k <= '0000000500'")
def map_scan_incl_excl(spark, sf_dir):
    return maps.scan(oplog.records(spark, sf_dir), "src0", "0000000000", "0000000500", start_included=False, end_included=True)


@query(f"WITH {RECORDS} SELECT map, k, v FROM records WHERE map = 'src1' ORDER BY k DESC LIMIT 10")
def map_scan_desc(spark, sf_dir):
    return maps.scan(oplog.records(spark, sf_dir), "src1", max_records=10, descending=True)


@query(f"WITH {RECORDS}, s AS (SELECT *, sum(strlen(k) + strlen(v)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) - strlen(k) - strlen(v) AS before FROM records WHERE map = 'src2') SELECT map, k, v FROM s WHERE before < 200")
def map_scan_max_bytes(spark, sf_dir):
    return maps.scan(oplog.records(spark, sf_dir), "src2", max_bytes=200)


def _maps(spark, sf_dir):
    return oplog.catalogue(spark, sf_dir), oplog.records(spark, sf_dir), oplog.requests(spark, sf_dir)


# -- streams


@query(LIVE)
def stream_upsert(spark, sf_dir):
    """The events as a stream into a store; what the store holds when the stream has been read."""
    store = Store.create(spark, fresh_folder(spark, "stream"))
    upsert.into_store(oplog.from_events(_stream(spark, sf_dir)), store.path, fresh_folder(spark, "offsets")).awaitTermination()
    return Store.open(spark, store.path).live().select("k", "v", "seq")


@query(LIVE)
def stream_live_state(spark, sf_dir):
    """The newest state that the stateful operator gives for each key."""
    name = f"state_{uuid.uuid4().hex}"
    out = fresh_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.parquet(f"{out}/{number}")

    changes = upsert.live_state(oplog.from_events(_stream(spark, sf_dir)))
    upsert.on_changes(changes, write, fresh_folder(spark, "offsets")).awaitTermination()
    return resolve.live(spark.read.parquet(f"{out}/*"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = oplog.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
