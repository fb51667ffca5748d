"""Timetable feeds: CSV tables in a folder or ZIP, as typed DataFrames.

Everything is read as strings, headers are trimmed and a byte-order mark dropped; known columns are then cast, values that
don't fit become null. Unknown columns stay strings, missing ones are left out.
"""

from __future__ import annotations

import shutil
import tempfile
import urllib.request
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.fixpoint import shared_folder
from railyard.functions.scalar import WEEKDAYS
from railyard.operators import services

#: Types of the feed's columns that aren't strings.
TYPES = {
    "stops": {"stop_lat": "double", "stop_lon": "double", "location_type": "int", "wheelchair_boarding": "int"},
    "routes": {"route_type": "int", "route_sort_order": "int"},
    "trips": {"direction_id": "int", "wheelchair_accessible": "int", "bikes_allowed": "int"},
    "stop_times": {"stop_sequence": "int", "pickup_type": "int", "drop_off_type": "int", "shape_dist_traveled": "double"},
    "calendar": dict.fromkeys(WEEKDAYS, "int"),
    "calendar_dates": {"exception_type": "int"},
    "shapes": {"shape_pt_lat": "double", "shape_pt_lon": "double", "shape_pt_sequence": "int", "shape_dist_traveled": "double"},
    "transfers": {"transfer_type": "int", "min_transfer_time": "int"},
}
TABLES = ("agency", "stops", "routes", "trips", "stop_times", "calendar", "calendar_dates", "shapes", "transfers", "feed_info")
REQUIRED = ("stops", "routes", "trips", "stop_times")


def scan(spark: SparkSession, path: str, table: str = "", types: dict | None = None, comment: str | None = None) -> DataFrame:
    """One CSV file, columns pruned by whoever selects from it."""
    reader = spark.read.option("header", True).option("multiLine", False).option("escape", '"').option("encoding", "UTF-8")
    if comment:
        reader = reader.option("comment", comment)
    raw = reader.csv(path)
    names = [c.replace("\ufeff", "").strip() for c in raw.columns]
    raw = raw.toDF(*names)
    kinds = types if types is not None else TYPES.get(table, {})
    # only the empty string is missing
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    return raw.select(*(F.trim(text(c)).try_cast(kinds[c]).alias(c) if c in kinds else text(c).alias(c) for c in names))


@dataclass
class Feed:
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def has_rows(self, name: str) -> bool:
        return name in self.tables and not self.tables[name].isEmpty()

    def summary(self) -> dict[str, int]:
        return {name: df.count() for name, df in self.tables.items()}

    def info(self) -> dict:
        """First row of feed_info."""
        rows = self.tables["feed_info"].limit(1).collect() if "feed_info" in self.tables else []
        return rows[0].asDict() if rows else {}

    def views(self, prefix: str = "") -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(f"{prefix}{name}")


def download(url: str, cache: str, force: bool = False, timeout: int = 60) -> str:
    """Fetches a ZIP to the cache folder unless it is there; the path."""
    target = Path(cache) / (url.rstrip("/").rpartition("/")[2] or "feed.zip")
    target.parent.mkdir(parents=True, exist_ok=True)
    if force or not target.exists():
        part = target.with_suffix(".part")
        with urllib.request.urlopen(url, timeout=timeout) as source, open(part, "wb") as out:  # noqa: S310
            shutil.copyfileobj(source, out)
        part.rename(target)
    return str(target)


def store(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for any path that Spark can read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def unpack(spark: SparkSession, path: str, folder: str | None = None) -> str:
    """Copies the tables of a ZIP, which may be in any store, to a folder that all executors see: by default below the shared folder."""
    files, zipped = store(spark, path)
    if not files.exists(zipped):
        raise FileNotFoundError(path)
    folder = folder or f"{shared_folder(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    with tempfile.TemporaryDirectory() as here:  # on the driver alone, which opens the ZIP
        local = Path(here) / "feed.zip"
        files.copyToLocalFile(False, zipped, spark._jvm.org.apache.hadoop.fs.Path(str(local)), True)
        with zipfile.ZipFile(local) as z:
            for name in z.namelist():
                if name.endswith(".txt") and "/" not in name:
                    z.extract(name, here)
                    out, target = store(spark, f"{folder}/{name}")
                    out.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"{here}/{name}"), target)
    return folder


def load(spark: SparkSession, path: str, files: tuple[str, ...] | None = None, weekday: str | None = None, date: str | None = None, staging: str | None = None) -> Feed:
    """A feed from a ZIP or folder, for the services of a weekday or date if one is given.

    ValueError if a required table is missing, if there is no calendar to filter by, or if weekday and date disagree.
    """
    own = services.check_filters(weekday, date)
    where, target = store(spark, path)
    if not where.exists(target):
        raise FileNotFoundError(path)
    folder = path if where.getFileStatus(target).isDirectory() else unpack(spark, path, staging)
    where, target = store(spark, folder)
    there = {x.getPath().getName().removesuffix(".txt") for x in where.listStatus(target) if x.getPath().getName().endswith(".txt")}
    wanted = set(files or TABLES) | set(REQUIRED)
    if missing := [t for t in REQUIRED if t not in there]:
        raise ValueError(f"the feed has no {', '.join(missing)}")
    feed = Feed({t: scan(spark, f"{folder}/{t}.txt", t) for t in TABLES if t in there and (t in wanted or t.startswith("calendar"))})
    return restrict(feed, own if date is None else None, date) if own else feed


def restrict(feed: Feed, weekday: str | None = None, date: str | None = None) -> Feed:
    """Trips and stop times of the services that run."""
    regular, exceptions = feed.has_rows("calendar"), feed.has_rows("calendar_dates")
    if not regular and not exceptions:
        raise ValueError("the feed has neither calendar nor calendar_dates")
    spark = feed["trips"].sparkSession
    empty_exceptions = spark.createDataFrame([], "service_id string, date string, exception_type int")
    empty_calendar = spark.createDataFrame([], "service_id string, start_date string, end_date string, " + ", ".join(f"{d} int" for d in WEEKDAYS))
    cal = feed["calendar"] if regular else empty_calendar
    exc = feed["calendar_dates"] if exceptions else empty_exceptions
    if date is not None:
        active = services.on_date(cal, exc, date)
    elif regular:
        active = services.on_weekday(cal, exc, weekday)
    else:
        active = services.added_on_weekday(exc, weekday)
    trips, visits = services.restrict(feed["trips"], feed["stop_times"], active)
    return Feed(feed.tables | {"trips": trips, "stop_times": visits})


def cells(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Population cells (lon, lat, pop) with people, from Parquet (rasters are converted beforehand), inside a box (west, south, east, north)."""
    df = spark.read.parquet(path).select("lon", "lat", "pop").filter("pop > 0")
    return df if box is None else df.filter((F.col("lon") >= box[0]) & (F.col("lon") <= box[2]) & (F.col("lat") >= box[1]) & (F.col("lat") <= box[3]))


def districts(spark: SparkSession, path: str, expected: int | None = None, name: str | None = None, project: Callable | None = None) -> DataFrame:
    """Corners (polygon, ring, k, px, py[, name]) of all rings, holes among them, of the Polygons and MultiPolygons in a GeoJSON file; polygon is the place of the feature in it.

    name: a property that names the polygon. project(lat, lon): gives (x, y) for degrees, as scalar.project() and
    scalar.hungarian_grid() do. ValueError unless there are as many polygons as expected.
    """
    kind = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
    text = spark.read.option("wholetext", True).text(path)
    own = text.select(F.posexplode(F.from_json("value", kind)["features"]).alias("polygon", "f"))
    own = own.filter(F.col("f.geometry.type").isin("Polygon", "MultiPolygon"))
    if expected is not None and (n := own.count()) != expected:
        raise ValueError(f"{n} districts, not {expected}")
    parts = "array<array<array<array<double>>>>"
    shapes = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", parts[6:-1]))).otherwise(F.from_json("f.geometry.coordinates", parts))
    named = [F.col("f.properties").getItem(name).alias("name")] if name else []
    rings = own.select("polygon", *named, F.posexplode(F.flatten(shapes)).alias("ring", "points"))
    corners = rings.select("polygon", "ring", *(["name"] if name else []), F.posexplode("points").alias("k", "p"))
    x, y = F.col("p").getItem(0), F.col("p").getItem(1)
    px, py = project(y, x) if project else (x, y)
    return corners.select("polygon", "ring", "k", px.alias("px"), py.alias("py"), *(["name"] if name else []))


def optional_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A hand-made CSV with comment lines; None if it isn't there."""
    files, target = store(spark, f"{folder.rstrip('/')}/{name}.csv")
    return scan(spark, target.toString(), types={}, comment="#") if files.exists(target) else None


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
