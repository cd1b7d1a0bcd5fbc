"""Queries over the session-log data source: floors that reach the reader, numbers of lines over ranges, logs that grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import connector
from .registry import DAY, NOW, query
from .source_queries import _READ, _claude_line, _files

_FLOOR = NOW - 20 * DAY


@query(_READ + f""", numbered as (select *, row_number() over (partition by user_id order by event_id) as line from ev)
select own as native_id, ms as timestamp_ms, case event_type when 'error' then 'error' else 'message' end as record_type, '/p/' || (user_id % 16) as project_path, line from numbered
where event_id % 50 <> 0 and event_id % 51 <> 0 and event_type in ('view', 'click', 'error') and ms > {_FLOOR}""")
def connector_records(spark, d):
    """SRC-01: records of a store above a floor, in their own lines, from files read by ranges of bytes."""
    folder = _files(spark, d, "connector", _claude_line)
    rec = connector.records(spark, "claude", folder, _FLOOR, glob="*.txt", splitBytes=1 << 15)
    return rec.select("native_id", "timestamp_ms", "record_type", "project_path", "line")


@query(_READ + """, n as (select user_id, count(*) as lines, count(*) filter (where event_id % 50 <> 0 and event_id % 51 <> 0) as stamped, max(ms) filter (where event_id % 50 <> 0 and event_id % 51 <> 0) as last_ms from ev group by 1)
select 'user_id=' || user_id as file, lines, stamped, last_ms from n""")
def connector_files(spark, d):
    """SRC-01, SRC-07: each file's lines, stamped lines and newest stamp, counted over its ranges."""
    rows = connector.log(spark, _files(spark, d, "connector", _claude_line), "source_file string, stamp_ms bigint", glob="*.txt", splitBytes=1 << 15)
    return rows.groupBy(F.regexp_extract("source_file", "user_id=[0-9]+", 0).alias("file")).agg(F.count("*").alias("lines"), F.count("stamp_ms").alias("stamped"), F.max("stamp_ms").alias("last_ms"))
