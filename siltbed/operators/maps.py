"""Named maps of records: records(map, k, v) with a catalogue(name, id); requests give a response code each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.operators.scan import bounded, within_bytes

# Response codes.
SUCCESS, MAP_EXISTS, MAP_NOT_FOUND = "Success", "MapExists", "MapNotFound"
RECORD_EXISTS, RECORD_NOT_FOUND, SCAN_ENDED = "RecordExists", "RecordNotFound", "ScanEnded"
#: A new catalogue's first map has this id.
FIRST_ID = 3


def list_maps(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("name").orderBy("name")


def next_id(catalogue: DataFrame) -> DataFrame:
    """One more than any id that was given; ids aren't used again."""
    return catalogue.agg(F.coalesce(F.max("id") + 1, F.lit(FIRST_ID)).cast("long").alias("next_id"))


def add_maps(catalogue: DataFrame, names: DataFrame) -> DataFrame:
    """name, response_code of each request."""
    there = catalogue.select("name", F.lit(True).alias("_there"))
    return names.join(there, "name", "left").select("name", F.when(F.col("_there"), MAP_EXISTS).otherwise(SUCCESS).alias("response_code"))


def new_maps(catalogue: DataFrame, names: DataFrame) -> DataFrame:
    """name, id of the maps that requests add, each once: ids go on from next_id() in order of the names."""
    fresh = names.select("name").distinct().join(catalogue.select("name"), "name", "left_anti")
    given = next_id(catalogue).first()[0]
    return fresh.select("name", (F.row_number().over(Window.orderBy("name")) + F.lit(given - 1)).cast("long").alias("id"))


def drop_map(records: DataFrame, name: str) -> DataFrame:
    """The records that stay."""
    return records.filter(F.col("map") != name)


def drop_maps(catalogue: DataFrame, names: DataFrame) -> DataFrame:
    """name, response_code of each request to drop a map."""
    there = catalogue.select("name", F.lit(True).alias("_there"))
    return names.join(there, "name", "left").select("name", F.when(F.col("_there"), SUCCESS).otherwise(MAP_NOT_FOUND).alias("response_code"))


def dropped_records(records: DataFrame, dropped: DataFrame) -> DataFrame:
    """A null value, which removes, for each record of the maps that drop_maps() has dropped: map, k, v, response_code."""
    gone = dropped.filter(F.col("response_code") == SUCCESS).select(F.col("name").alias("map")).distinct()
    return records.join(gone, "map", "left_semi").select("map", "k", F.lit(None).cast(records.schema["v"].dataType).alias("v"), F.lit(SUCCESS).alias("response_code"))


def _looked_up(catalogue: DataFrame, records: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(map, k, ...) with _map, _hit and _v. Catalogue and records are joined by key, requests keep their rows."""
    maps = catalogue.select(F.col("name").alias("map"), F.lit(True).alias("_map"))
    stored = records.select("map", "k", F.col("v").alias("_v"), F.lit(True).alias("_hit"))
    return requests.join(maps, "map", "left").join(stored, ["map", "k"], "left")


def get(catalogue: DataFrame, records: DataFrame, requests: DataFrame) -> DataFrame:
    code = F.when(F.col("_map").isNull(), MAP_NOT_FOUND).when(F.col("_hit").isNull(), RECORD_NOT_FOUND).otherwise(SUCCESS)
    return _looked_up(catalogue, records, requests).select("map", "k", F.col("_v").alias("v"), code.alias("response_code"))


def _written(found: DataFrame, ok, refused: str) -> DataFrame:
    code = F.when(F.col("_map").isNull(), MAP_NOT_FOUND).when(ok, SUCCESS).otherwise(refused)
    return found.withColumn("response_code", code).drop("_map", "_hit", "_v")


def put(catalogue: DataFrame, records: DataFrame, requests: DataFrame) -> DataFrame:
    return _written(_looked_up(catalogue, records, requests), F.lit(True), "")


def insert(catalogue: DataFrame, records: DataFrame, requests: DataFrame, blind: bool = False) -> DataFrame:
    return _written(_looked_up(catalogue, records, requests), F.col("_hit").isNull() | F.lit(blind), RECORD_EXISTS)


def update(catalogue: DataFrame, records: DataFrame, requests: DataFrame, blind: bool = False) -> DataFrame:
    return _written(_looked_up(catalogue, records, requests), F.col("_hit").isNotNull() | F.lit(blind), RECORD_NOT_FOUND)


def remove(catalogue: DataFrame, records: DataFrame, requests: DataFrame) -> DataFrame:
    return _written(_looked_up(catalogue, records, requests), F.col("_hit").isNotNull(), RECORD_NOT_FOUND)


def after_writes(records: DataFrame, done: DataFrame) -> DataFrame:
    """Records after the requests that succeeded: done(map, k, v, response_code); a null v removes."""
    ok = done.filter(F.col("response_code") == SUCCESS).select("map", "k", "v", F.lit(1).alias("_new"))
    rows = records.select("map", "k", "v", F.lit(0).alias("_new")).unionByName(ok)
    return rows.groupBy("map", "k").agg(F.max_by("v", "_new").alias("v")).filter(F.col("v").isNotNull())


def scan(records: DataFrame, name: str, start="", end="", start_included=True, end_included=False, max_records=0, max_bytes=0, descending=False) -> DataFrame:
    """Records of one map in key order; an empty end is the map's end. The map's name prunes partitions where records are partitioned by it."""
    rows = bounded(records.filter(F.col("map") == name), "k", start, end, start_included, end_included)
    size = F.octet_length("k") + F.octet_length("v")
    return within_bytes(rows, size, "k", max_records, max_bytes, descending)


def scan_code(catalogue: DataFrame, scanned: DataFrame, name: str, max_records: int = 0, max_bytes: int = 0) -> str:
    """How a scan ended: MapNotFound, Success if a limit may have cut it, ScanEnded at the end of its range."""
    if not catalogue.filter(F.col("name") == name).limit(1).count():
        return MAP_NOT_FOUND
    n, size = scanned.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("k") + F.octet_length("v")), F.lit(0))).first()
    return SUCCESS if (max_records and n >= max_records) or (max_bytes and size >= max_bytes) else SCAN_ENDED
