"""The record that freezes a policy before it is measured on the test split: one small JSON object, read on the driver."""

from __future__ import annotations

import json
import re
from datetime import datetime
from typing import Any

from pyspark.sql import SparkSession

from .files import exists

KEYS = frozenset({"frozen", "commitSha", "frozenAt", "notes"})


def load(spark: SparkSession, path: str) -> dict[str, Any]:
    """The record at path; where there is none, the policy isn't frozen."""
    if not exists(spark, path):
        return {"frozen": False, "commitSha": None, "frozenAt": None, "notes": "no record"}
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def _is_time(value: Any) -> bool:
    try:
        return bool(value) and datetime.fromisoformat(value) is not None
    except (TypeError, ValueError):
        return False


def errors(record: dict[str, Any]) -> list[str]:
    """What is wrong with a record; a policy that isn't frozen needs neither commit nor time."""
    found = []
    if set(record) - KEYS:
        found.append(f"unknown keys: {sorted(set(record) - KEYS)}")
    if not isinstance(record.get("frozen"), bool):
        found.append("frozen is no boolean")
    elif record["frozen"]:
        sha = record.get("commitSha")
        if not (isinstance(sha, str) and re.fullmatch("[0-9a-f]{40}", sha)):
            found.append("commitSha is not 40 lowercase hexadecimal digits")
        if not _is_time(record.get("frozenAt")):
            found.append("frozenAt is no ISO-8601 time")
    return found


def require(record: dict[str, Any]) -> None:
    """Raises unless the record freezes the policy; to be called before the test split is read."""
    if record.get("frozen") is not True:
        raise RuntimeError("the policy is not frozen, so the test split stays unread")
    if errors(record):
        raise RuntimeError("the freeze record is invalid: " + "; ".join(errors(record)))
