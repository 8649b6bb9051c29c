"""Descriptions of services: layer documents, tile-map resources, quadkey metadata, hosted assets, HTTP."""

from __future__ import annotations

import gzip
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import sniff_ext, strip_html
from tilewright.settings import Settings
from tilewright.sources.shared import written

TIMEOUT_S = 10.0
_LAYER = "name string, tiles array<string>, version string, maxzoom int, projection string, attribution string, available array<array<struct<startX: long, startY: long, endX: long, endY: long>>>"
_QUAD = "resourceSets array<struct<resources: array<struct<imageUrl: string, imageUrlSubdomains: array<string>, zoomMin: int, zoomMax: int>>>>"
_ASSET = "type string, url string, accessToken string, externalType string, options struct<url: string, key: string, mapStyle: string>, attributions array<struct<html: string>>"


def layer(docs: DataFrame) -> DataFrame:
    """Layer documents (base_url, doc) to their tile URL template, deepest level (19 if unsaid) and rectangles."""
    d = F.from_json("doc", _LAYER)
    path = F.replace(F.coalesce(F.element_at(d["tiles"], 1), F.lit("{z}/{x}/{y}.terrain?v={version}")), F.lit("{version}"), F.coalesce(d["version"], F.lit("1.0.0")))
    return docs.select("base_url", F.when(path.rlike("^https?://"), path).otherwise(F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/"), path)).alias("template"), F.coalesce(d["maxzoom"], F.lit(19)).alias("max_zoom"), d["available"].alias("available"))


def tile_map(docs: DataFrame) -> DataFrame:
    """Tile-map XML (base_url, doc) to extension, mercator or not, and zoom range; a mercator map's last level is left out."""
    orders = F.transform(F.expr("xpath(doc, '//TileSet/@order')"), lambda v: v.cast("int"))
    srs = F.expr("coalesce(xpath_string(doc, '//SRS'), '')")
    rows = docs.select("base_url", F.expr("xpath_string(doc, '//TileFormat/@extension')").alias("extension"), srs.rlike("3857|900913").alias("mercator"), F.array_min(orders).alias("min_zoom"), F.array_max(orders).alias("last"))
    return rows.select("base_url", "extension", "mercator", "min_zoom", F.when(F.col("mercator"), F.greatest(F.col("last") - 1, F.lit(0))).otherwise(F.col("last")).alias("max_zoom"), "last")


def quadkey_service(docs: DataFrame) -> DataFrame:
    """Quadkey metadata (doc) to template, subdomains and zoom range (from 1 on)."""
    r = F.from_json("doc", _QUAD)["resourceSets"][0]["resources"][0]
    return docs.select(r["imageUrl"].alias("template"), r["imageUrlSubdomains"].alias("subdomains"), F.greatest(r["zoomMin"], F.lit(1)).alias("min_zoom"), r["zoomMax"].alias("max_zoom"))


def hosted_asset(docs: DataFrame) -> DataFrame:
    """Endpoint documents (doc) to url, token, kind and attributions without tags; blank ones are dropped."""
    d = F.from_json("doc", _ASSET)
    external = F.nullif(d["externalType"], F.lit(""))
    url = F.regexp_replace(F.when(external.isNotNull(), F.coalesce(d["options"]["url"], F.lit(""))).otherwise(d["url"]), "/+$", "")
    credits = F.filter(F.transform(F.coalesce(d["attributions"], F.array()), lambda a: strip_html(F.coalesce(a["html"], F.lit("")))), lambda t: t != "")
    return docs.select(d["type"].alias("type"), url.alias("url"), F.when(external.isNull(), d["accessToken"]).alias("token"), external.alias("external"), d["options"]["key"].alias("key"), credits.alias("attributions"))


def terrain_asset(docs: DataFrame) -> DataFrame:
    """hosted_asset() with an error for what can't be streamed as terrain: other kinds, and what others host."""
    found = hosted_asset(docs)
    other = F.concat(F.lit("an asset of type "), F.coalesce(F.nullif("type", F.lit("")), F.lit("?")), F.lit(" is no terrain"))
    error = F.when(F.col("external").isNotNull(), F.concat(F.lit("hosted elsewhere: "), "external")).when(F.coalesce("type", F.lit("")) != "TERRAIN", other)
    return found.withColumn("error", error)


def tileset_root(url: Column, hosted: Column, external_key: Column) -> Column:
    """Where a hosted tree begins: the key appended unless there is one, /tileset.json unless a document is named."""
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    full = F.when(F.lower(path).endswith(".json"), url).otherwise(F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/tileset.json"), rest))
    mark = F.when(F.contains(full, F.lit("?")), "&").otherwise("?")
    keyed = F.when(external_key.isNotNull() & ~F.contains(full, F.lit("key=")), F.concat(full, mark, F.lit("key="), external_key)).otherwise(full)
    return F.when(hosted, keyed).otherwise(url)


def http_get(url: str, headers: dict[str, str] | None = None) -> tuple[str, bytes | None]:
    """(outcome, body): ok, dead (404), http (another status) or conn (no answer)."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=TIMEOUT_S) as answer:
            body = answer.read()
            packed = "gzip" in (answer.headers.get("Content-Encoding") or "").lower()
    except urllib.error.HTTPError as e:
        return ("dead" if e.code == 404 else "unauthorized" if e.code == 401 else "http"), None
    except OSError:
        return "conn", None
    if packed or body[:2] == b"\x1f\x8b":
        try:
            body = gzip.decompress(body)
        except OSError:
            pass
    return "ok", body


def fetch(urls: DataFrame, headers: dict[str, str] | None = None, refresh: Callable[[], dict[str, str]] | None = None, get: Callable = http_get) -> DataFrame:
    """(url, outcome, content) of distinct urls; new headers are asked for once a task after a 401."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fresh = dict(headers or {}), refresh is None
        for batch in batches:
            rows = []
            for url in batch["url"].to_pylist():
                outcome, body = get(url, now)
                if outcome == "unauthorized" and not fresh:
                    now, fresh = refresh(), True
                    outcome, body = get(url, now)
                rows.append((url, "http" if outcome == "unauthorized" else outcome, body))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True)], names=["url", "outcome", "content"])

    return urls.select("url").distinct().mapInArrow(run, "url string, outcome string, content binary")


def read_through(wanted: DataFrame, cache: DataFrame, **how) -> DataFrame:
    """(url, outcome, content): from the cache (url, content) where it has them, fetched otherwise."""
    have = wanted.select("url").distinct().join(cache.select("url", "content"), "url").select("url", F.lit("ok").alias("outcome"), "content")
    return have.unionByName(fetch(wanted.select("url").join(cache.select("url"), "url", "left_anti"), **how))


def cached(wanted: DataFrame, path: str, **how) -> DataFrame:
    """read_through() a cache table (url, content) at a path; what was fetched is put into it."""
    spark = wanted.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    cache = spark.read.schema("url string, content binary").parquet(path) if there else spark.createDataFrame([], "url string, content binary")
    got = written(read_through(wanted, cache, **how), "read")
    new = got.where("outcome = 'ok'").join(cache.select("url"), "url", "left_anti").select("url", "content")
    new.write.mode("append").parquet(path)
    return got


def fetch_images(wanted: DataFrame, cache: DataFrame, **how) -> DataFrame:
    """(url, outcome, ext, content) of image tiles; an answer that is no image means that there is none."""
    got = read_through(wanted, cache, **how).withColumn("ext", sniff_ext(F.col("content")))
    none = (F.col("outcome") == "ok") & (F.col("ext") == ".bin")
    return got.select("url", F.when(none, "dead").otherwise(F.col("outcome")).alias("outcome"), F.when((F.col("outcome") == "ok") & ~none, F.col("ext")).alias("ext"), F.when(~none, F.col("content")).alias("content"))


@dataclass(frozen=True)
class Connected:
    """What a session reads: its terrain and imagery (null: none), and what went wrong on the way."""

    terrain: Any = None
    imagery: Any = None
    note: str = ""


def _twice(connect: Callable[[], Any]) -> Any:
    try:
        return connect()
    except Exception:
        return connect()


def connect_sources(settings: Settings, terrain: dict[str, Callable[[], Any]], imagery: dict[str, Callable[[], Any]]) -> Connected:
    """Connects the sources that the settings choose; terrain and imagery: what to call for `url` and `asset`.

    Each is tried once more if it fails.  Terrain that can't be reached is an error, imagery is done
    without, which the note says; terrain `none` connects nothing.
    """
    if "asset" in (settings.terrain_source, settings.imagery_source) and not settings.token:
        raise ValueError("hosted assets need a token")
    if settings.terrain_source == "none":
        return Connected(note="no terrain")
    ground = _twice(terrain[settings.terrain_source])
    if settings.imagery_source == "none":
        return Connected(ground)
    try:
        return Connected(ground, _twice(imagery[settings.imagery_source]))
    except Exception as e:
        return Connected(ground, note=f"imagery off: {e}")


def fetch_json(wanted: DataFrame, cache: DataFrame, **how) -> DataFrame:
    """(url, name, outcome, doc): documents from the cache or fetched; what isn't JSON is an http error and not to be kept.

    name is the content's place in a cache, the hash of its url.
    """
    got = read_through(wanted, cache, **how).withColumn("doc", F.decode("content", "UTF-8"))
    valid = F.try_parse_json("doc").isNotNull()
    return got.select("url", F.sha1("url").alias("name"), F.when((F.col("outcome") == "ok") & ~F.coalesce(valid, F.lit(False)), "http").otherwise(F.col("outcome")).alias("outcome"), F.when(valid, F.col("doc")).alias("doc"))
