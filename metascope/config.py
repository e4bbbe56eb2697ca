"""Configurations: from a registry, from settings, or from both, without global state."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from metascope.sources.exports import read_registry


def config_key(value: str) -> str:
    """Lower case, other characters than letters and digits as one underscore; `default` if nothing is left."""
    return re.sub("[^a-z0-9]+", "_", value.strip().lower()).strip("_") or "default"


#: Names under which an embedding provider is known (fixed values).
PROVIDERS = {"local": "local", "fastembed": "local", "openai": "openai"}


def provider(settings: Mapping[str, str]) -> str:
    name = settings.get("EMBEDDING_PROVIDER", "local").strip().lower()
    if name not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {name!r}: {', '.join(PROVIDERS)}")
    return PROVIDERS[name]


def model_suffix(settings: Mapping[str, str]) -> str:
    model = settings.get("EMBEDDING_MODEL", "intfloat/multilingual-e5-large")
    if provider(settings) == "openai":
        return "openai"
    known = {"e5-large": "e5_large", "MiniLM": "minilm"}
    return next((s for part, s in known.items() if part in model), "") or re.sub("[^a-z0-9]", "_", model.split("/")[-1].lower()) or "default"


@dataclass(frozen=True)
class RuntimeConfig:
    config_id: str
    config_name: str
    export_path: str
    config_profile: str = "generic"
    platform_version: str = ""
    collection_name: str = ""
    cache_file: str = ""
    graph_cache_file: str = ""
    config_kind: str = "configuration"
    base_config_id: str = ""
    description: str = ""
    is_default: bool = False


def _place(path: str, folder: Path) -> str:
    return path if Path(path).is_absolute() else str((folder / path).resolve())


def registered(text: str, folder: str | Path = ".", settings: Mapping[str, str] | None = None) -> list[RuntimeConfig]:
    """The configurations of a registry's JSON; items without an export path are left out. Relative paths start at `folder`."""
    settings, folder, out = settings or {}, Path(folder), []
    suffix = model_suffix(settings)
    for item in read_registry(text):
        get = lambda *names, default="": next((str(item[n]).strip() for n in names if item.get(n)), default)  # noqa: B023, E731
        name, path = get("config_name", "name"), get("export_path")
        if not path:
            continue
        ident = config_key(get("config_id") or name)
        base = get("base_config_id", "extends")
        out.append(RuntimeConfig(
            ident, name or ident, _place(path, folder), get("config_profile", default=settings.get("CONFIG_PROFILE", "generic").strip() or "generic"), get("platform_version", default=settings.get("PLATFORM_VERSION", "").strip()),
            get("collection_name", default=f"code_{ident}_{suffix}"), _place(get("index_cache_file", default=f"indexing_cache_{ident}_{suffix}.json"), folder), _place(get("graph_cache_file", default=f"graph_cache_{ident}.json"), folder),
            get("config_kind", "kind", default="configuration").lower(), config_key(base) if base else "", get("description"), bool(item.get("default")),
        ))
    return out


def resolve(configs: list[RuntimeConfig], settings: Mapping[str, str] | None = None, requested: str | None = None) -> RuntimeConfig:
    """The requested configuration, or the one that the settings name (ACTIVE_CONFIG_ID, CONFIG_ID, CONFIG_NAME), else
    the default one, else the first; without a registry one made of the settings."""
    s = settings or {}
    key = config_key(next((x for x in (requested, s.get("ACTIVE_CONFIG_ID"), s.get("CONFIG_ID"), s.get("CONFIG_NAME")) if x), ""))
    if configs:
        return next((c for c in configs if c.config_id == key), None) or next((c for c in configs if c.is_default), configs[0])
    name = s.get("CONFIG_NAME", "default")
    ident, suffix, base = config_key(s.get("CONFIG_ID", name)), model_suffix(s), s.get("BASE_CONFIG_ID", "").strip()
    return RuntimeConfig(
        ident, name, s.get("EXPORT_PATH", "export"), s.get("CONFIG_PROFILE", "generic"), s.get("PLATFORM_VERSION", ""), s.get("COLLECTION_NAME", f"code_{ident}_{suffix}"), s.get("INDEX_CACHE_FILE", f"indexing_cache_{ident}_{suffix}.json"),
        s.get("GRAPH_CACHE_FILE", f"graph_cache_{ident}.json"), s.get("CONFIG_KIND", "configuration").strip().lower() or "configuration", config_key(base) if base else "", "", True,
    )


def config_table(spark: SparkSession, configs: list[RuntimeConfig]) -> DataFrame:
    """The registry as a table."""
    schema = ", ".join(f"{f.name} {'boolean' if f.name == 'is_default' else 'string'}" for f in fields(RuntimeConfig))
    return spark.createDataFrame([tuple(getattr(c, f.name) for f in fields(RuntimeConfig)) for c in configs], schema)
