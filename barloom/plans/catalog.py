"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib
import pkgutil

import barloom.plans as plans
from barloom.plans.registry import REGISTRY

_SKIP = {"registry", "sqlkit", "catalog"}


def load() -> dict:
    for m in pkgutil.iter_modules(plans.__path__):
        if m.name not in _SKIP:
            importlib.import_module(f"barloom.plans.{m.name}")
    return REGISTRY
