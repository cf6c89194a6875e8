"""Components by the names that configurations use."""

from __future__ import annotations

import dataclasses
import re

COMPONENTS: dict[str, type] = {}


def component(name: str):
    """Registers a dataclass under the @type of configurations; its fields are that component's options."""

    def put(cls: type) -> type:
        cls.type_name = name
        COMPONENTS[name] = cls
        return cls

    return put


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name).lower()


def build(config):
    """The object that a parsed JSON configuration describes: a dict with @type is a component, a list a list."""
    if isinstance(config, list):
        return [build(x) for x in config]
    if not isinstance(config, dict):
        return config
    if "@type" not in config:
        return dict(config)
    name = config["@type"].rsplit("/", 1)[-1].rsplit("#", 1)[-1]
    if name not in COMPONENTS:
        raise ValueError(f"unknown component: {name}")
    cls = COMPONENTS[name]
    kinds = {f.name: str(f.type) for f in dataclasses.fields(cls)}
    options = {}
    for key, value in config.items():
        if key.startswith("@"):
            continue
        field = _snake(key)
        if field not in kinds:
            raise ValueError(f"{name} has no option {key}")
        value = build(value)
        if kinds[field].startswith("bool") and isinstance(value, str):
            value = value.lower() == "true"
        if not kinds[field].startswith(("list", "dict")) and isinstance(value, list) and len(value) == 1:
            value = value[0]
        if kinds[field].startswith("list") and not isinstance(value, list):
            value = [value]
        options[field] = value
    return cls(**options)
