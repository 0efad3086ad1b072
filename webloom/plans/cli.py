"""Command line for the tools: ``python -m webloom.plans.cli NAME --argument value ... --inputs FOLDER --store FOLDER``.

``--inputs`` is a folder of Parquet tables by the names of ``Context.inputs``.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Mapping
from pathlib import Path

from webloom.plans import tools
from webloom.plans.envelope import Budget, ToolError
from webloom.plans.store import Store


def coerce(value: str, default: object) -> object:
    """A value from the command line, typed as JSON where it is JSON; text for arguments whose default is text, and a list of one
    for arguments whose default is a list."""
    if isinstance(default, str):
        return value
    try:
        got = json.loads(value)
    except ValueError:
        got = value
    return [got] if isinstance(default, (list, tuple)) and not isinstance(got, list) else got


def parse(argv: list[str], defaults: Mapping[str, object]) -> dict[str, object]:
    """Arguments ``--name value``, ``--name=value`` and bare ``--flag``; a name given again makes a list.  Unknown names are refused,
    with the nearest known one."""
    out: dict[str, object] = {}
    k = 0
    while k < len(argv):
        if not argv[k].startswith("--"):
            raise ToolError("INVALID_INPUT", f"{argv[k]!r} is no argument.", "Arguments start with --.")
        name, sep, value = argv[k][2:].partition("=")
        name, k = name.replace("-", "_"), k + 1
        if name not in defaults:
            near = [d for d in defaults if d.startswith(name) or name.startswith(d) or d.rstrip("s") == name.rstrip("s")]
            raise ToolError("INVALID_INPUT", f"There is no argument --{name}.", f"Did you mean --{near[0]}?" if near else f"Arguments: {', '.join(defaults)}.")
        if not sep and (k == len(argv) or argv[k].startswith("--")):
            got: object = True
        else:
            if not sep:
                value, k = argv[k], k + 1
            got = coerce(value, defaults[name])
        if name in out:
            before = out[name] if isinstance(out[name], list) else [out[name]]
            got = before + (got if isinstance(got, list) else [got])
        out[name] = got
    return out


def settings(env: Mapping[str, str], dotenv: str | None = None) -> dict[str, object]:
    """Settings from the environment, and for names that it lacks from a .env text: store, budget, rows inline and year."""
    own = dict(env)
    for line in (dotenv or "").splitlines():
        name, sep, value = line.strip().removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if sep and not name.startswith("#") and name not in own:
            own[name] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    number = lambda name, default: int(own[name]) if own.get(name, "").isdigit() and int(own[name]) > 0 else default
    budget = own.get("WEBLOOM_BUDGET")
    return {"store": own.get("WEBLOOM_STORE", "webloom-store"), "budget": float(budget) if budget else None, "rows": number("WEBLOOM_MAX_INLINE_ROWS", 100), "year": number("WEBLOOM_YEAR", 2026)}


def main(argv: list[str]) -> int:
    if not argv or argv[0] in ("list", "--help"):
        print("\n".join(f"{t.name:28} {t.about}" for t in tools.TOOLS.values()))
        return 0
    name, rest = argv[0], argv[1:]
    if name == "describe":
        found = tools.TOOLS.get(rest[0]) if rest else None
        print(json.dumps({"name": found.name, "about": found.about, "arguments": found.defaults}, default=str) if found else "There is no such tool.")
        return 0 if found else 1
    if name not in tools.TOOLS:
        print(f"There is no tool {name!r}.", file=sys.stderr)
        return 1
    dotenv = Path(".env")
    own = settings(os.environ, dotenv.read_text() if dotenv.exists() else None)
    try:
        args = parse(rest, {**tools.TOOLS[name].defaults, "inputs": "", "store": ""})
    except ToolError as e:
        print(f"{e} {e.remedy}", file=sys.stderr)
        return 1
    from webloom.session import session

    spark = session()
    folder = str(args.pop("inputs", ""))
    store = Store(spark, str(args.pop("store", "") or own["store"]))
    inputs = {p.name.removesuffix(".parquet"): spark.read.parquet(str(p)) for p in sorted(Path(folder).glob("*"))} if folder else {}
    answer = tools.call(tools.Context(spark, store, inputs, Budget(own["budget"]), own["year"]), name, **args)
    print(answer.to_json(own["rows"]))
    return 0 if answer.ok else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
