"""The registry of the library's own queries; importing the modules below fills it."""

from __future__ import annotations

from . import Registry

REGISTRY = Registry()

from . import catalogue, conversations, models, search, sessions, trees  # noqa: E402, F401
