"""What a user adds to the library's types, fields and analyzers, held by a session: another session of the same driver does not see it."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import SparkSession

_KEY = "passplane.registrations"
_HELD: dict[str, dict[str, dict[str, Any]]] = {}


def added(spark: SparkSession, kind: str) -> dict[str, Any]:
    """The session's additions of a kind by name, to read and to change. They are known by a setting of the session, which new sessions do not take over."""
    key = spark.conf.get(_KEY, None)
    if not key:
        key = uuid.uuid4().hex
        spark.conf.set(_KEY, key)
    return _HELD.setdefault(key, {}).setdefault(kind, {})


def add(spark: SparkSession | None, kind: str, known: dict[str, Any], name: str, value: object) -> None:
    """Adds a name to a session (the active one, if none is given); a known name is refused."""
    spark = spark or SparkSession.active()
    own = added(spark, kind)
    if name in known or name in own:
        raise ValueError(f"{name} is known already")
    own[name] = value
