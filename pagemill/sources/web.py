"""Sources of raw pages: saved pages of any file system, a Python data source over a mounted folder, and engine settings
from the environment."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a page that are read; the rest is cut off.
MAX_BYTES = 10 * 1024 * 1024


def saved_pages(spark: SparkSession, path: str, base: str = "file:///") -> DataFrame:
    """(url, html, status_code) of the pages saved below ``path``, on any file system that Spark reads: files are listed and
    read by Spark's own source. URLs are ``base`` and the path below; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{html,htm,xhtml,HTML,HTM,XHTML}").load(path)
    root = path.rstrip("/").split("://")[-1].lstrip("/") + "/"
    below = F.substring_index("path", root, -1)
    text = F.make_valid_utf8(F.substring("content", 1, MAX_BYTES).cast("string"))
    return files.select(F.concat(F.lit(base.rstrip("/") + "/"), below).alias("url"), text.alias("html"), F.lit(200).alias("status_code"))


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.base = options.get("base", "file:///")
        self.per_part = int(options.get("filesPerPartition", "256"))

    def partitions(self) -> list[_Part]:
        paths = sorted(os.path.join(d, f) for d, _, names in os.walk(self.root) for f in names if f.lower().endswith((".html", ".htm", ".xhtml")))
        return [_Part(paths[k : k + self.per_part]) for k in range(0, len(paths), self.per_part)] or [_Part([])]

    def read(self, part: _Part) -> Iterator[tuple]:
        for path in part.paths:
            with open(path, "rb") as f:
                body = f.read(MAX_BYTES)
            url = self.base.rstrip("/") + "/" + os.path.relpath(path, self.root).replace(os.sep, "/")
            yield url, body.decode("utf-8", "replace"), 200


class SavedPages(DataSource):
    """``spark.read.format("saved_pages").option("path", folder).option("base", "https://host")``: (url, html,
    status_code) of the pages saved below a folder that is mounted on all machines, by relative path; elsewhere
    :func:`saved_pages` reads them."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "url string, html string, status_code int"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


_DURATION = re.compile(r"(\d+(?:\.\d*)?)(ns|us|µs|ms|s|m|h)")
_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(text: str) -> float | None:
    """A duration such as ``1m30s``; None if it is none."""
    if not text or "".join(m.group() for m in _DURATION.finditer(text)) != text:
        return None
    return sum(float(n) * _SECONDS[u] for n, u in _DURATION.findall(text))


@dataclass
class Settings:
    """Engine settings with their defaults (fixed values); durations in seconds."""

    host: str = "0.0.0.0"
    port: int = 8080
    mode: str = "release"
    headless: bool = True
    max_pages: int = 10
    proxy: str = ""
    no_sandbox: bool = False
    browser_bin: str = ""
    default_timeout: float = 30.0
    max_timeout: float = 120.0
    nav_timeout: float = 15.0
    blocked_resources: tuple[str, ...] = ("Image", "Stylesheet", "Font", "Media")
    auth_enabled: bool = True
    api_keys: tuple[str, ...] = ()
    rate_rps: float = 5.0
    rate_burst: int = 10
    cache_max_entries: int = 1000
    log_level: str = "info"
    log_format: str = "json"
    multi_engine: bool = True
    escalation_delays: tuple[float, ...] = (0.0, 2.0, 5.0)
    http_timeout: float = 5.0
    min_pages: int = 3
    hard_max_pages: int = 20
    mem_threshold: float = 0.9
    scale_step: float = 0.05

    @classmethod
    def load(cls, env: dict[str, str] | None = None, prefix: str = "PAGEMILL_") -> Settings:
        """Settings from variables named as the fields, in upper case with a prefix; what is unset or cannot be read
        keeps its default."""
        env = dict(os.environ) if env is None else env
        out = cls()
        for f in fields(cls):
            raw, now = env.get(prefix + f.name.upper(), ""), getattr(out, f.name)
            if not raw:
                continue
            items = [x.strip() for x in raw.split(",") if x.strip()]
            try:
                if isinstance(now, bool):
                    value = {"1": True, "t": True, "true": True, "0": False, "f": False, "false": False}[raw.lower()]
                elif isinstance(now, tuple):
                    value = tuple(items) if f.name != "escalation_delays" else tuple(d for x in items if (d := seconds(x)) is not None) or now
                elif f.name.endswith("timeout"):
                    value = seconds(raw)
                else:
                    value = type(now)(raw)
            except (KeyError, ValueError):
                continue
            if value is not None:
                setattr(out, f.name, value)
        return out
