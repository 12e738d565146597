"""Registry of file formats: which extractor describes a file, by its suffix."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import SparkSession

from tabshift.plans.envelope import SCHEMA_VERSION, envelope


class Format(NamedTuple):
    """extract(spark, path, **options) gives an envelope of schema_version."""

    name: str
    suffix: str
    extract: Callable[..., dict]
    schema_version: str = SCHEMA_VERSION

    def supports(self, path: str) -> bool:
        return path.rpartition("/")[2].lower().endswith(self.suffix) and len(path.rpartition("/")[2]) > len(self.suffix)


FORMATS: dict[str, Format] = {}


def register(found: Format) -> Format:
    """Add a format, or replace the one of that name."""
    if not found.suffix.startswith("."):
        raise ValueError(f"a suffix begins with a dot, not {found.suffix!r}")
    FORMATS[found.name] = found
    return found


register(Format("csv", ".csv", envelope))


def format_of(path: str) -> Format:
    """The format last registered of those that support the path."""
    for found in reversed(FORMATS.values()):
        if found.supports(path):
            return found
    raise ValueError(f"no format for {path!r} (known: {', '.join(sorted(FORMATS))})")


def extract(spark: SparkSession, path: str, **options: Any) -> dict:
    return format_of(path).extract(spark, path, **options)
