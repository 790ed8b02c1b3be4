"""Queries over sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as X
from ..operators import dml
from ..sources import scans
from ..sources import tables as T


@query("sc02_cameras", "select camera_id, location, status, direction from cameras order by camera_id")
def cameras(spark, sf):
    return T.cameras(spark, sf).orderBy("camera_id")


@query("sc03_active_cameras", "select camera_id, location from cameras where status = 1")
def active(spark, sf):
    return T.cameras(spark, sf).filter("status = 1").select("camera_id", "location").orderBy("camera_id")


@query("sc05_settings")
def settings(spark, sf):
    return dml.settings_map(T.cameras(spark, sf).selectExpr("location as key", "direction as value"))


@query("sc06_row_counts", "select 'cameras' as name, count(*) as n from cameras union all select 'detections', count(*) from detections union all select 'plates', count(*) from plates")
def row_counts(spark, sf):
    return scans.row_counts(cameras=T.cameras(spark, sf), detections=T.detections(spark, sf), plates=T.plates(spark, sf))


@query("sc07_point_lookup", "select camera_id, direction from cameras where camera_id = 7")
def point_lookup(spark, sf):
    return T.cameras(spark, sf).filter("camera_id = 7").select("camera_id", "direction")


@query("sc08_columns")
def columns(spark, sf):
    return scans.columns(T.detections(spark, sf))


@query("sc11_stream_urls", "select camera_id, case when camera_id % 3 = 0 then concat('rtsp://cam', camera_id, '/live') when camera_id % 3 = 1 then concat('rtsp://10.0.0.', camera_id) else cast(camera_id as varchar) end as url from cameras")
def stream_urls(spark, sf):
    raw = F.expr("case when camera_id % 3 = 0 then concat(' RTSP://cam', camera_id, '/live ') when camera_id % 3 = 1 then concat('10.0.0.', camera_id) else cast(camera_id as string) end")
    return T.cameras(spark, sf).select("camera_id", X.stream_url(raw).alias("url"))


@query("sc14_demo_events")
def demo_events(spark, sf):
    return scans.demo_events(spark, 10_000)
