"""Map services and versioned assets as Python data sources: a partition for each area or asset, read within tasks."""
from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .elevation import Fetch, by_post, by_query

AGENT = "pathloom"


def area_query(relations: list[int], ways: list[int] = (), timeout: int = 180) -> str:
    """The query text for all ways in the areas of some relations and closed ways, with the boundaries and all nodes. The text is fixed by the service."""
    found = [("rel", "area", f"rel({i})", k) for k, i in enumerate(relations)] + [("boundaryWay", "boundaryWayArea", f"way({i})", k) for k, i in enumerate(ways)]
    named = "\n".join(f"{source}->.{one}{k};\n.{one}{k} map_to_area->.{area}{k};" for one, area, source, k in found)
    members = {"rel": "  way(r.rel{0});\n", "boundaryWay": ""}
    wanted = "\n".join(f"  .{one}{k};\n{members[one].format(k)}  way(area.{area}{k});" for one, area, _, k in found)
    return f"[out:json][timeout:{timeout}];\n{named}\n(\n{wanted}\n);\n(._;>;);\nout body;"


def posted(url: str, query: str, timeout: float, tries: int, pause: float, wait=time.sleep) -> str:
    """The JSON text that a service answers to a form with ``data``. A failed or broken answer is asked for again, ``tries`` times in all, ``pause`` seconds apart."""
    body, last = urllib.parse.urlencode({"data": query}).encode(), None
    for n in range(tries):
        if n:
            wait(pause)
        request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/x-www-form-urlencoded; charset=utf-8", "User-Agent": AGENT}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                text = answer.read().decode()
            json.loads(text)
            return text
        except (OSError, ValueError) as e:  # time-outs, refused connections, bad statuses, and text that is no JSON
            last = e
    raise RuntimeError(f"no answer after {tries} tries") from last


class Area(InputPartition):
    def __init__(self, area: str, query: str):
        self.area, self.query = area, query


class MapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.how = options["url"], {"timeout": float(options.get("timeout", 180)), "tries": int(options.get("tries", 3)), "pause": float(options.get("pause", 10))}
        self.areas = [Area(a["area"], area_query(a.get("relations", []), a.get("ways", []), int(self.how["timeout"]))) for a in json.loads(options["areas"])]

    def partitions(self) -> list[Area]:
        return self.areas

    def read(self, partition: Area) -> Iterator[tuple]:
        yield partition.area, posted(self.url, partition.query, **self.how)


class MapSource(DataSource):
    """Format ``map_service``: (area, text), the raw elements of each area. Options: url, areas (JSON list of area, relations, ways), tries, pause, timeout."""

    @classmethod
    def name(cls) -> str:
        return "map_service"

    def schema(self) -> str:
        return "area string, text string"

    def reader(self, schema) -> MapReader:
        return MapReader(self.options)


def got(url: str, timeout: float = 60) -> str:
    """The text at an address; a bad status raises with the asset's name."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
            return answer.read().decode()
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"failed to load {urllib.parse.urlsplit(url).path.rsplit('/', 1)[-1]}: {e.code}") from e


def versioned(manifest_url: str, path: str, version: str) -> str:
    """The address of an asset beside its manifest, with its version as ``v``; other parameters of the path stay."""
    parts = urllib.parse.urlsplit(urllib.parse.urljoin(manifest_url, path))
    kept = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if k != "v"]
    return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode([*kept, ("v", version)])))


class Asset(InputPartition):
    def __init__(self, owner: str, kind: str, url: str):
        self.owner, self.kind, self.url = owner, kind, url


def assets_of(manifest: dict, url: str) -> list[Asset]:
    """What a manifest leads to: the two networks of each area, by its own paths and versions or else those of the planner; or an editor's network and policy."""
    if "editor" in manifest:
        meta, editor = manifest["meta"], manifest["editor"]
        return [Asset("editor", "network", versioned(url, editor["network_path"], editor["network_version"])), Asset("editor", "policy", versioned(url, meta["route_policy_path"], meta["route_policy_digest"]))]
    out = []
    for area in manifest.get("areas", []):
        for kind, prefix in (("network", ""), ("background", "background_")):
            path, version = (area.get(f"{prefix}network_{x}") or manifest["planner"][f"{prefix}network_{x}"] for x in ("path", "version"))
            out.append(Asset(area["id"], kind, versioned(url, path, version)))
    return out


class ManifestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.timeout = options["url"], float(options.get("timeout", 60))

    def partitions(self) -> list[Asset]:
        return [Asset("", "manifest", self.url), *assets_of(json.loads(got(self.url, self.timeout)), self.url)]

    def read(self, partition: Asset) -> Iterator[tuple]:
        yield partition.owner, partition.kind, partition.url, got(partition.url, self.timeout)


class ManifestSource(DataSource):
    """Format ``manifest_assets``: (owner, kind, url, text) of a manifest and of all assets it leads to, each read in a task of its own. Options: url, timeout."""

    @classmethod
    def name(cls) -> str:
        return "manifest_assets"

    def schema(self) -> str:
        return "owner string, kind string, url string, text string"

    def reader(self, schema) -> ManifestReader:
        return ManifestReader(self.options)


def map_areas(spark: SparkSession, url: str, areas: list[dict], **how) -> DataFrame:
    spark.dataSource.register(MapSource)
    return spark.read.format("map_service").options(url=url, areas=json.dumps(areas), **{k: str(v) for k, v in how.items()}).load()


def manifest_assets(spark: SparkSession, url: str, **how) -> DataFrame:
    spark.dataSource.register(ManifestSource)
    return spark.read.format("manifest_assets").options(url=url, **{k: str(v) for k, v in how.items()}).load()


def provider(name: str, url: str, **how) -> Fetch:
    """The elevation service of a name: ``query`` takes points in the address, ``post`` as JSON."""
    kinds = {"query": by_query, "post": by_post}
    if name not in kinds:
        raise ValueError(f"unknown elevation provider {name}: {', '.join(sorted(kinds))}")
    return kinds[name](url, **how)
