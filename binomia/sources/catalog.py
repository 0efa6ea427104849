"""Catalogue of checklists and attribute tables: folders by name and version, JSON beside the data."""

from __future__ import annotations

import json
import os
import re
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from binomia.operators.delta import apply_delta, diff_versions
from binomia.sources.files import Files

ENV = "BINOMIA_DATA_DIR"
CONF = "spark.binomia.dataDir"


def data_dir(spark: SparkSession) -> str:
    """Setting or environment; in local mode alone else a folder of the user."""
    root = spark.conf.get(CONF, None) or os.environ.get(ENV)
    if not root and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"set {CONF} to a folder that all executors share")
    return root or os.path.expanduser("~/.local/share/binomia")


def parse_meta(text: str) -> dict[str, str]:
    """``k=v`` lines; download_date and build_date name the same thing."""
    out = dict(line.split("=", 1) for line in text.splitlines() if "=" in line)
    for one, two in (("build_date", "download_date"), ("download_date", "build_date")):
        if two in out:
            out.setdefault(one, out[two])
    return out


def format_version(name: str, meta: dict) -> str:
    date = meta.get("build_date") or meta.get("download_date")
    return f"{name}:{meta.get('version', 'unknown')}" + (f" ({date})" if date else "")


def version_key(version: str) -> tuple:
    """Sorts versions by their parts: runs of digits as numbers, the rest as text; a number comes before text, a prefix before what goes on."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall(r"\d+|[^\W\d_]+", str(version)))


@dataclass(frozen=True)
class Source:
    """Where an attribute table comes from when it isn't installed: each may be missing or fail.

    ``newest`` names the newest version (None: unknown), ``fetch`` and ``build`` give a table
    of a version, ``in_memory`` one that serves this session only.
    """

    newest: Callable[[], str | None] | None = None
    fetch: Callable[[str], DataFrame] | None = None
    build: Callable[[], DataFrame] | None = None
    in_memory: Callable[[], DataFrame] | None = None


#: What sources may raise: anything of Spark, of files and of wrong values.
FAILURES = (PySparkException, OSError, ValueError, KeyError, RuntimeError)


@dataclass
class Catalog:
    """``<root>/<kind>/<name>/<version>/data.parquet`` and ``meta.json``; kinds: backbone, enrichment, register, coverage."""

    spark: SparkSession
    root: str | None = None
    local: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    #: Versions that this session has looked up, by kind and name: asked for once, then pinned.
    pinned: dict[tuple[str, str], str] = field(default_factory=dict)
    _asked: set[tuple[str, str]] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.root = self.root or data_dir(self.spark)
        self.files = Files(self.spark)

    def _at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def versions(self, kind: str, name: str) -> list[str]:
        """Installed versions, oldest first by :func:`version_key`."""
        have = self.files.names(self._at(kind, name))
        return sorted((v for v in have if not v.startswith(".") and self.files.exists(self._at(kind, name, v, "meta.json"))), key=lambda v: (version_key(v), v))

    def installed(self, kind: str) -> list[str]:
        return [n for n in self.files.names(self._at(kind)) if self.versions(kind, n)]

    def path(self, kind: str, name: str, version: str = "latest") -> str:
        """A pinned version, or the newest; a version that isn't there is an error."""
        have = self.versions(kind, name)
        version = self.pinned.get((kind, name), version) if version == "latest" else version
        pick = have[-1] if version == "latest" and have and "latest" not in have else version
        if pick not in have:
            raise FileNotFoundError(f"{kind} {name} {version} is not installed; there are {', '.join(have) or 'none'}")
        return self._at(kind, name, pick)

    def meta(self, kind: str, name: str, version: str = "latest") -> dict:
        return json.loads(self.files.read(f"{self.path(kind, name, version)}/meta.json"))

    def enrichments(self) -> DataFrame:
        """``name, version, n_rows, static, trait_cols, source_url`` of every enrichment at hand, newest versions."""
        rows = []
        for name in sorted({*self.installed("enrichment"), *(n for k, n in self.local if k == "enrichment")}):
            there = name in self.installed("enrichment")
            meta = self.meta("enrichment", name) if there else {}
            cols = meta.get("trait_cols") or [c for c in self.table("enrichment", name).columns if c not in ("canonical_name", "accepted_name", "genus", "src_ord")]
            rows.append((name, meta.get("version"), meta.get("n_rows"), bool(meta.get("static")), ", ".join(cols), meta.get("source_url")))
        return self.spark.createDataFrame(rows, "name string, version string, n_rows long, static boolean, trait_cols string, source_url string")

    def register(self, kind: str, name: str, df: DataFrame) -> None:
        """Use a table at hand under a name, for this session."""
        self.local[kind, name] = df

    def table(self, kind: str, name: str, version: str = "latest") -> DataFrame:
        if (kind, name) in self.local:
            return self.local[kind, name]
        return self.spark.read.parquet(self.path(kind, name, version) + "/data.parquet")

    def install(self, kind: str, name: str, df: DataFrame, version: str, meta: dict | None = None) -> str:
        """Write a table and its sidecar; the folder appears under its name only when complete."""
        final = self._at(kind, name, version)
        if self.files.exists(final):
            raise FileExistsError(final)
        part = self._at(kind, name, f".{version}-{uuid.uuid4().hex}")
        df.write.parquet(f"{part}/data.parquet")
        rows = self.spark.read.parquet(f"{part}/data.parquet").count()
        self.files.write(f"{part}/meta.json", json.dumps({"name": name, "version": version, "n_rows": rows} | (meta or {})))
        self.files.move(part, final)
        return final

    def install_delta(self, kind: str, name: str, delta: DataFrame, version: str, base: str = "latest", meta: dict | None = None, key: str = "taxon_id") -> str:
        """Install the version that ``delta`` (:func:`binomia.operators.delta.diff_versions`) makes of ``base``; its sidecar names the base."""
        base = self.path(kind, name, base).rpartition("/")[2]
        new = apply_delta(self.table(kind, name, base), delta, key)
        return self.install(kind, name, new, version, {"base": base} | (meta or {}))

    def delta(self, kind: str, name: str, old: str, new: str = "latest", key: str = "taxon_id") -> DataFrame:
        """What turns one installed version into another."""
        return diff_versions(self.table(kind, name, old), self.table(kind, name, new), key)

    def ensure(self, kind: str, name: str, source: Source = Source()) -> DataFrame | None:
        """A table by the first rung that holds, from the newest version to none at all.

        Once a session the source is asked for its newest version, and a newer one is
        installed; if that fails a warning says so and the installed one serves. The version
        then stays pinned for the session. Without an installed version: fetched, built, or an
        in-memory table with a warning, which isn't installed. None where no rung holds:
        enrichment with it gives null columns (:func:`binomia.operators.enrich.enrich`).
        """
        at = (kind, name)
        if at in self.local:
            return self.local[at]
        have = self.versions(kind, name)
        if at not in self._asked:
            self._asked.add(at)
            if have and source.newest is not None:
                try:
                    newest = source.newest()
                    if newest is not None and source.fetch is not None and is_outdated(self.meta(kind, name), {"version": newest, **{k: v for k, v in self.meta(kind, name).items() if k == "static"}}):
                        self.install(kind, name, source.fetch(newest), newest)
                        have = self.versions(kind, name)
                except FAILURES as e:
                    warnings.warn(f"{kind} {name} could not be updated ({e}): the installed version serves", stacklevel=2)
        if not have:
            have = self._obtained(kind, name, source)
        if have:
            self.pinned.setdefault(at, have[-1])
            return self.table(kind, name)
        if source.in_memory is not None:
            try:
                self.local[at] = source.in_memory()
            except FAILURES as e:
                warnings.warn(f"{kind} {name} is not available: {e}", stacklevel=2)
                return None
            warnings.warn(f"{kind} {name}: a table in memory serves this session and is not installed", stacklevel=2)
            return self.local[at]
        return None

    def _obtained(self, kind: str, name: str, source: Source) -> list[str]:
        """Installs what can be fetched, else built."""
        try:
            newest = source.newest() if source.newest is not None else None
            if newest is not None and source.fetch is not None:
                self.install(kind, name, source.fetch(newest), newest)
        except FAILURES as e:
            warnings.warn(f"{kind} {name} could not be fetched: {e}", stacklevel=3)
        if not self.versions(kind, name) and source.build is not None:
            try:
                self.install(kind, name, source.build(), "built")
            except FAILURES as e:
                warnings.warn(f"{kind} {name} could not be built: {e}", stacklevel=3)
        return self.versions(kind, name)

    def clear(self) -> None:
        self.local.clear()
        self.pinned.clear()
        self._asked.clear()
        self.spark.catalog.clearCache()

    def remove(self, kind: str, name: str, version: str) -> None:
        self.files.delete(self.path(kind, name, version))


def resolve_manifest_entry(manifest: dict, name: str, kind: str = "backbones") -> dict | None:
    """An entry of either manifest layout: by kind, or flat."""
    return (manifest.get(kind) or {}).get(name) or (manifest.get(name) if isinstance(manifest.get(name), dict) else None)


def is_outdated(installed: dict, entry: dict | None) -> bool:
    """A newer version is known; static tables never are outdated."""
    return bool(entry) and not entry.get("static") and version_key(entry.get("version")) > version_key(installed.get("version"))
