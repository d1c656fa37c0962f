"""YAML text to values and back, with the core scalar rules (``true``/``false`` only, no dates)."""

from __future__ import annotations

import math
import re
from typing import Any

import yaml


class YamlError(ValueError):
    pass


class _Loader(yaml.SafeLoader):
    pass


# Scalar forms of YAML 1.2's core schema.
_Loader.yaml_implicit_resolvers = {}
for _tag, _form, _first in (
    ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
    ("null", r"~|null|Null|NULL|", "~nN\0"),
    ("int", r"[-+]?[0-9][0-9_]*|0o[0-7]+|0x[0-9a-fA-F]+|0b[01]+", "-+0123456789"),
    ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", "-+0123456789."),
    ("merge", r"<<", "<"),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(f"(?:{_form})\\Z"), list(_first) if _tag != "null" else ["~", "n", "N", ""])


def _int(loader: _Loader, node: yaml.ScalarNode) -> int:
    s = node.value.replace("_", "")
    sign, s = (-1, s[1:]) if s[:1] == "-" else (1, s.lstrip("+"))
    out = sign * (int(s[2:], {"0o": 8, "0x": 16, "0b": 2}[s[:2]]) if s[:2] in ("0o", "0x", "0b") else int(s))
    if not -(2**63) <= out < 2**63:
        raise YamlError(f"integer {node.value} doesn't fit into 64 bits")
    return out


def _key(value: Any) -> str:
    if isinstance(value, list | dict):
        raise YamlError("keys must be scalars")
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _mapping(loader: _Loader, node: yaml.MappingNode) -> dict[str, Any]:
    """Explicit keys win over merged ones, earlier merges over later; a key twice is an error; keys become text."""
    own: dict[str, Any] = {}
    merged: dict[str, Any] = {}
    for k, v in node.value:
        value = loader.construct_object(v, deep=True)
        if k.tag == "tag:yaml.org,2002:merge":
            for part in value if isinstance(value, list) else [value]:
                if not isinstance(part, dict):
                    raise YamlError("only mappings can be merged")
                for name, x in part.items():
                    merged.setdefault(name, x)
            continue
        name = _key(loader.construct_object(k, deep=True))
        if name in own:
            raise YamlError(f"key {name!r} twice")
        own[name] = value
    return {**{k: v for k, v in merged.items() if k not in own}, **own}


_Loader.add_constructor("tag:yaml.org,2002:int", _int)
_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)
_Loader.add_constructor("tag:yaml.org,2002:merge", lambda loader, node: "<<")


def decode_all(data: str | bytes) -> list[Any]:
    try:
        return list(yaml.load_all(data, Loader=_Loader))  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise YamlError(str(e)) from None
    except RecursionError:
        raise YamlError("an alias holds itself or nesting is too deep") from None


def decode(data: str | bytes) -> Any:
    """One document; empty input and more than one are errors."""
    if not (data if isinstance(data, str) else data.decode()).strip():
        raise YamlError("no document")
    found = decode_all(data)
    if len(found) != 1:
        raise YamlError(f"expected one document, got {len(found)}")
    return found[0]


class _Dumper(yaml.SafeDumper):
    def ignore_aliases(self, data: Any) -> bool:
        return True


# texts that either rule set would read as something else are quoted
_Dumper.yaml_implicit_resolvers = {c: [*yaml.SafeDumper.yaml_implicit_resolvers.get(c, ()), *_Loader.yaml_implicit_resolvers.get(c, ())] for c in {*yaml.SafeDumper.yaml_implicit_resolvers, *_Loader.yaml_implicit_resolvers}}


def encode(value: Any) -> str:
    """Text that :func:`decode` reads back as the same value; keys sorted."""
    if isinstance(value, float) and not math.isfinite(value):
        return {math.inf: ".inf\n", -math.inf: "-.inf\n"}.get(value, ".nan\n")
    out = yaml.dump(value, Dumper=_Dumper, allow_unicode=True, default_flow_style=False, sort_keys=True)
    return out.removesuffix("...\n")
