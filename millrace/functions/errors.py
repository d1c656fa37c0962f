"""Errors and option checks that all entry points share."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any


class NotSupported(Exception):
    """An operation that needs a live browser, a network peer or a library that isn't here; it is never imitated."""


class NotFound(LookupError):
    """A selector, sheet, entry or handle that doesn't exist."""


class HandleClosed(RuntimeError):
    """Use of a closed, finished or stale handle."""


def checked_options(given: Mapping[str, Any] | None, defaults: Mapping[str, Any], what: str) -> dict[str, Any]:
    """``given`` over ``defaults``; unknown names are an error."""
    unknown = sorted(set(given or {}) - set(defaults))
    if unknown:
        raise ValueError(f"{what}: unknown option {', '.join(unknown)}")
    return {**defaults, **(given or {})}
