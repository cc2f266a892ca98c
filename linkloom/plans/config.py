"""Links to and from YAML and JSON files."""

from __future__ import annotations

import json
from typing import Any

import yaml

from .base import Configurable, Link


def _is_yaml(path: str) -> bool:
    if path.endswith((".yaml", ".yml")):
        return True
    if path.endswith(".json"):
        return False
    raise ValueError(f"{path}: the extension must be .yaml, .yml or .json")


def save_as_yaml(data: dict[str, Any], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(data, f, sort_keys=False, allow_unicode=True)


def save_as_json(data: dict[str, Any], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2, ensure_ascii=False)


def save_dict(data: dict[str, Any], path: str = "Output.yaml") -> None:
    (save_as_yaml if _is_yaml(path) else save_as_json)(data, path)


def save_chain(link: Configurable, path: str, defaults: bool = True, version: bool = True, log_level: bool = True) -> None:
    save_dict(link.get_params(defaults, version, log_level), path)


def load_yaml(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def load_json(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_dict(path: str) -> dict[str, Any]:
    return (load_yaml if _is_yaml(path) else load_json)(path)


def load_chain(path: str) -> Link:
    params = load_dict(path)
    if not isinstance(params, dict) or "__class__" not in params:
        raise ValueError(f"{path} describes no link: __class__ is missing")
    return Configurable.from_params(params)
