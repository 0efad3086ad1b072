"""Uniform responses, errors and budgets of the tools."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

#: Error codes and whether a call may be repeated.
ERRORS = {"INVALID_INPUT": False, "NOT_FOUND": False, "NOT_CONFIGURED": False, "AUTH_FAILED": False, "RATE_LIMITED": True, "BUDGET_EXCEEDED": False, "FETCH_FAILED": True, "PARSE_FAILED": False, "TIMEOUT": True, "INTERNAL": False}


class ToolError(Exception):
    def __init__(self, code: str, message: str, remedy: str = "") -> None:
        super().__init__(message)
        self.code, self.remedy, self.retryable = code, remedy, ERRORS[code]


@dataclass
class Envelope:
    """A tool's answer: frames stay lazy until ``to_json`` takes their first ``cap`` rows."""

    ok: bool
    data: dict[str, DataFrame | object] = field(default_factory=dict)
    summary: str = ""
    actions: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    error: dict | None = None
    started: float = field(default_factory=time.time)

    def to_json(self, cap: int = 100, spill_to: str | None = None) -> str:
        """JSON with at most ``cap`` rows a frame; longer ones are written whole to ``spill_to`` first, and the answer says where."""
        out, meta = {}, {"took_ms": round((time.time() - self.started) * 1000)}
        for name, x in {**self.data, **({"actions": self.actions} if self.actions is not None else {})}.items():
            if isinstance(x, DataFrame):
                rows, more = spill(x, cap, f"{spill_to}/{name}" if spill_to else None)
                out[name] = rows
                if more:
                    meta[name] = more
            else:
                out[name] = x
        return json.dumps({"ok": self.ok, "data": out, "summary": self.summary, "warnings": self.warnings, "error": self.error, "meta": meta}, ensure_ascii=False)


def spill(df: DataFrame, cap: int, path: str | None) -> tuple[list, dict | None]:
    """The first ``cap`` rows, and where all of them are if there are more."""
    head = [json.loads(r.j) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).limit(cap + 1).collect()]
    if len(head) <= cap:
        return head, None
    if path:
        df.write.mode("overwrite").json(path)
    return head[:cap], {"truncated": True, "returned": cap, "artifact": path}


@dataclass
class Budget:
    """Units that providers may cost: None is unlimited; zero, negative and NaN allow nothing."""

    limit: float | None = None
    spent: float = 0.0

    def reserve(self, units: float) -> None:
        if self.limit is not None and not (self.limit > 0 and self.spent + units <= self.limit):
            raise ToolError("BUDGET_EXCEEDED", f"{units} units are more than the budget leaves.", "Raise the budget or ask for less.")
        self.spent += units


def split_failed(results: DataFrame, what: str = "lookup") -> tuple[DataFrame, list[str]]:
    """Rows of ``results(..., error)`` without an error, and a warning that says how many failed; if all did, their first error is raised."""
    n, failed, first = results.agg(F.count("*"), F.count("error"), F.min("error")).first()
    if n and failed == n:
        raise ToolError("FETCH_FAILED", first, "Try again later.")
    good = results.where("error is null").drop("error")
    return good, [f"{failed} of {n} {what}s failed, first: {first}. Totals are a floor."] if failed else []
