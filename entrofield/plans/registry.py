"""All registered queries and oracles of the reference operators."""

from . import fields, functions, meshes, models, programs, trees  # noqa: F401
from .common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
