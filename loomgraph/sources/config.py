"""Configurations, scanner registry and judgment files: small things that the driver reads."""

from __future__ import annotations

import importlib
import json
import os
from collections import Counter
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.sources import declarative as D
from loomgraph.sources import parsed as P
from loomgraph.sources.detect import detect_scanners, infer_scanners

Scanner = Callable[..., DataFrame]
SCANNERS: dict[str, Scanner] = {
    "graphql": P.scan_graphql,
    "http": P.scan_http,
    "fastapi": P.scan_fastapi,
    "kafka": D.scan_kafka,
    "frontend_graphql": P.scan_frontend_graphql,
    "frontend_rest": P.scan_frontend_rest,
    "backend_clients": P.scan_backend_clients,
    "ts_http_outbound": P.scan_ts_outbound,
    "cube": P.scan_cubes,
}


class ConfigError(ValueError):
    """A configuration or judgment file that can't be used."""


def register_scanner(name: str, scanner: Scanner) -> None:
    """Adds a scanner: (files, **options) to scanned nodes."""
    SCANNERS[name] = scanner


def resolve_scanner(entry: str | Mapping[str, Any]) -> Callable[[DataFrame], DataFrame]:
    """A scanner with its options bound, by registered name or as ``module:Class`` with the options for its constructor.

    Such a class has ``scan(service, path, text)``, which yields the nodes of one file; keys that start with _ are comments.
    """
    name = entry if isinstance(entry, str) else entry.get("type")
    options = {} if isinstance(entry, str) else {k: v for k, v in entry.items() if k != "type" and not k.startswith("_")}
    if name in SCANNERS:
        return lambda files: SCANNERS[name](files, **options)
    if not name or ":" not in name:
        raise ConfigError(f"there is no scanner {name!r}, only {', '.join(sorted(SCANNERS))}")
    module, _, cls = name.partition(":")
    try:
        built = getattr(importlib.import_module(module), cls)(**options)
    except (ImportError, AttributeError, TypeError) as e:
        raise ConfigError(f"scanner {name!r} can't be made: {e}") from e
    return lambda files: P.parse_files(files, built.scan).drop("seq")


def load_config(path: str) -> dict[str, Any]:
    """The configuration with names and absolute paths filled in; a repo without scanners has None, which ``fill_scanners`` makes a list."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    base = os.path.dirname(os.path.abspath(path))
    repos = [normalize_repo(r, base) for r in config.get("repos") or []]
    return config | {"repos": repos}


def normalize_repo(entry: Any, base: str) -> dict[str, Any]:
    if not isinstance(entry, dict):
        raise ConfigError("not an object")
    if not isinstance(entry.get("path"), str) or not entry["path"]:
        raise ConfigError("`path` is missing or no text")
    path = entry["path"] if "://" in entry["path"] else os.path.normpath(os.path.join(base, os.path.expanduser(entry["path"])))
    return entry | {"path": path, "name": entry.get("name") or os.path.basename(path.rstrip("/")), "scanners": entry.get("scanners") or None}


def fill_scanners(config: Mapping[str, Any], files: DataFrame) -> dict[str, Any]:
    """The configuration with scanners for the repos that name none: those that manifests and build files speak for, or else what the sources hold.

    ``files`` has (service, relative, text).  Both are asked of all such repos at once; a repo may be left with none.
    """
    open_ = [r["name"] for r in config["repos"] if not r.get("scanners")]
    if not open_:
        return dict(config)
    listed = files.where(F.col("service").isin(open_)).select("service", F.col("relative").alias("path"), "text")
    found: dict[str, list[str]] = {}
    for look in (infer_scanners, detect_scanners):  # the latter counts more
        found |= {r["service"]: list(r["scanners"]) for r in look(listed).collect() if r["scanners"]}
    return config | {"repos": [r if r.get("scanners") else r | {"scanners": found.get(r["name"], [])} for r in config["repos"]]}


def bff_services(config: Mapping[str, Any]) -> set[str] | None:
    """Services that serve frontends: those named, or else those with a GraphQL scanner; None if none is known."""
    if config.get("bff_services"):
        return set(config["bff_services"])
    kinds = {r["name"]: {s if isinstance(s, str) else s.get("type") for s in r.get("scanners") or []} for r in config["repos"]}
    return {name for name, k in kinds.items() if "graphql" in k} or None


def validate_config(config: Any, base: str = ".") -> tuple[list[str], list[str]]:
    """What keeps a configuration from being used, and what is only odd.  Classes by dotted path are accepted, as scanning accepts them."""
    repos = config.get("repos") if isinstance(config, dict) else None
    if not isinstance(repos, list) or not repos:
        return ["no repos: `repos` must list at least one"], []
    errors, warnings = [], []
    seen: Counter[str] = Counter()
    for number, entry in enumerate(repos):
        wrong, odd, name = _repo_problems(entry, base)
        seen[name] += bool(name)
        if name and seen[name] == 2:
            wrong.append("another repo has this name")
        label = f"repo {number}" + (f" ({name})" if name else "")
        errors += [f"{label}: {x}" for x in wrong]
        warnings += [f"{label}: {x}" for x in odd]
    return errors, warnings


def _repo_problems(entry: Any, base: str) -> tuple[list[str], list[str], str]:
    try:
        repo = normalize_repo(entry, base)
    except ConfigError as e:
        return [str(e)], [], ""
    wrong = [] if "://" in repo["path"] or os.path.isdir(repo["path"]) else [f"no folder at {repo['path']}"]
    scanners = entry.get("scanners")
    if scanners is not None and not isinstance(scanners, list):
        wrong.append("`scanners` is no list")
    elif scanners == []:
        return wrong, ["`scanners` is empty, so they are looked for"], repo["name"]
    for n, s in enumerate(scanners if isinstance(scanners, list) else []):
        wrong += [f"scanner {n}: {x}" for x in _scanner_errors(s)]
    return wrong, [], repo["name"]


#: Options that must be objects.
_MAPS = {"backend_clients": ["client_target_map"], "frontend_rest": ["base_class_service"], "ts_http_outbound": ["settings_key_map", "url_prefix_map", "client_name_map"]}


def _scanner_errors(entry: Any) -> list[str]:
    if not isinstance(entry, str | dict):
        return ["neither a name nor an object"]
    name = entry if isinstance(entry, str) else entry.get("type")
    if not name:
        return ["has no `type`"]
    if name not in SCANNERS and ":" not in name:
        return [f"there is no scanner {name!r}, only {', '.join(sorted(SCANNERS))}"]
    given = {} if isinstance(entry, str) else entry
    return [f"`{o}` is no object" for o in _MAPS.get(name, []) if not isinstance(given.get(o, {}), dict)]


def load_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Judgments of a JSON-lines file as (judgment_id, hint, expected_node_ids, match, k); blank and # lines are passed over.

    A judgment file is read by people; it is checked line by line before Spark sees it.
    """
    rows = []
    with open(path, encoding="utf-8") as f:
        for n, line in enumerate(f, 1):
            if line.strip() and not line.lstrip().startswith("#"):
                try:
                    rows.append((n, *_judgment(json.loads(line))))
                except ValueError as e:
                    raise ConfigError(f"{path}:{n}: {e}") from e
    if not rows:
        raise ConfigError(f"{path}: no judgments found")
    wanted = "judgment_id bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.JUDGMENT)
    return spark.createDataFrame(rows, wanted)


def _judgment(item: Any) -> tuple:
    if not isinstance(item, dict):
        raise ConfigError("expected a JSON object")
    hint, expected, match, k = item.get("hint"), item.get("expected_node_ids"), item.get("match", "any"), item.get("k")
    expected = [expected] if isinstance(expected, str) else expected
    if not isinstance(hint, str) or not hint.strip():
        raise ConfigError("'hint' must be a non-empty string")
    if not isinstance(expected, list) or not expected or not all(isinstance(x, str) and x for x in expected):
        raise ConfigError("'expected_node_ids' must be a non-empty list of strings")
    if match not in ("any", "all"):
        raise ConfigError("'match' must be 'any' or 'all'")
    if k is not None and (not str(k).isdigit() or int(k) < 1):
        raise ConfigError("'k' must be an integer of at least 1")
    return hint.strip(), expected, match, None if k is None else int(k)
