"""Command line over ``MemoryStore``: one table of commands makes the parser, the dispatch and the completions."""

from __future__ import annotations

import argparse
import json
import re
import sys
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import SparkSession

from lorekeep import lexicon as X
from lorekeep.api import MemoryStore
from lorekeep.plans.table import ConflictError

KIND = ("--kind", {"choices": X.KINDS})
SCOPE, TAGS = ("--scope", {}), ("--tags", {"nargs": "*"})
ID = ("--id", {"required": True})
NUMBERS = [("--importance", {"type": float}), ("--certainty", {"type": float})]


def _limit(n):
    return ("--limit", {"type": int, "default": n})


#: name: (arguments, what to call).
COMMANDS = {
    "init": ([], lambda s, a: {"path": s.table.path, **s.table.manifest()}),
    "remember": (
        [("--scope", {"required": True}), ("--kind", {"required": True, "choices": X.KINDS}), ("--title", {"required": True}), ("--content", {"required": True}), ("--summary", {"default": ""}), TAGS, ("--source", {"default": ""}), *NUMBERS],
        lambda s, a: s.remember(**_given(a, "scope", "kind", "title", "content", "summary", "tags", "source", "importance", "certainty")),
    ),
    "ingest": (
        [SCOPE, ("--text", {}), ("--file", {}), ("--source", {}), KIND, TAGS, ("--max-items", {"type": int, "default": X.SEGMENTS}), *NUMBERS, ("--dry-run", {"action": "store_true"}), ("--interactive", {"action": "store_true"})],
        lambda s, a: _ingest(s, a),
    ),
    "search": ([("query", {}), SCOPE, KIND, TAGS, _limit(5)], lambda s, a: s.search(a.query, a.limit, a.scope, a.kind, a.tags or ())),
    "context": ([("query", {}), SCOPE, KIND, TAGS, _limit(5), ("--budget-chars", {"type": int, "default": 1200})], lambda s, a: s.context(a.query, a.budget_chars, a.limit, a.scope, a.kind, a.tags or ())),
    "wake-up": ([SCOPE, _limit(6), ("--budget-chars", {"type": int, "default": 800})], lambda s, a: s.wake_up(a.budget_chars, a.limit, a.scope)),
    "list": ([SCOPE, KIND, TAGS, _limit(20), ("--include-archived", {"action": "store_true"})], lambda s, a: s.list(scope=a.scope, kind=a.kind, tags=a.tags or (), limit=a.limit, include_archived=a.include_archived)),
    "show": ([ID], lambda s, a: _there(s.get(a.id), a.id)),
    "update": ([ID, SCOPE, KIND, ("--title", {}), ("--content", {}), ("--summary", {}), TAGS, ("--source", {}), *NUMBERS], lambda s, a: s.update(a.id, **_given(a, "scope", "kind", "title", "content", "summary", "tags", "source", "importance", "certainty"))),
    "delete": ([ID], lambda s, a: _there(s.delete(a.id), a.id)),
    "forget": ([ID], lambda s, a: _there(s.archive(a.id), a.id)),
    "restore": ([ID], lambda s, a: _there(s.restore(a.id), a.id)),
    "revise": ([ID, ("--supersedes", {"required": True})], lambda s, a: s.revise(a.id, a.supersedes)),
    "decay": (
        [("--dry-run", {"action": "store_true"}), ("--min-age-days", {"type": int, "default": X.DECAY_AGE_DAYS}), ("--max-access", {"type": int, "default": X.DECAY_ACCESS}), ("--threshold", {"type": float, "default": X.DECAY_THRESHOLD}), SCOPE],
        lambda s, a: [r.asDict() for r in s.decay(a.dry_run, min_age_days=a.min_age_days, max_access=a.max_access, threshold=a.threshold, scope=a.scope).collect()],
    ),
    "export": ([SCOPE, KIND, TAGS, ("--limit", {"type": int}), ("--format", {"choices": ("json", "jsonl"), "default": "json"}), ("--output", {})], lambda s, a: _export(s, a)),
    "import": ([("--file", {"required": True}), ("--format", {"choices": ("json", "jsonl")})], lambda s, a: s.import_file(a.file, a.format)),
    "verify": ([("--repair", {"action": "store_true"})], lambda s, a: s.verify(a.repair)),
    "completion": ([("shell", {"choices": ("bash", "powershell")})], None),
    "serve-tools": ([], None),
    "stats": ([("--since", {})], lambda s, a: s.stats(parse_since(a.since) if a.since else None)),
}


class NotFound(LookupError):
    pass


def _there(value, id):
    if not value:
        raise NotFound(f"no such memory: {id}")
    return value


def _given(a, *names) -> dict:
    return {n: v for n in names if (v := getattr(a, n)) is not None}


def _asked(what: str, given: str | None) -> str:
    return input(f"{what} [{given}]: " if given else f"{what}: ").strip() or given or ""


def _typed() -> str:
    """Lines up to the end of the input."""
    print("Text (end with Ctrl-D):", file=sys.stderr)
    lines = []
    try:
        while True:
            lines.append(input())
    except EOFError:
        return "\n".join(lines)


def _ingest_by_dialogue(store, a):
    """Asks for what is missing, shows what would be stored, and stores it once that is confirmed."""
    if a.text is not None or a.file is not None or a.dry_run:
        raise ValueError("--interactive goes with none of --text, --file and --dry-run")
    if not (scope := _asked("Scope", a.scope)):
        raise ValueError("scope is required")
    source, tags = _asked("Source", a.source), _asked("Tags", " ".join(a.tags or ())).split()
    if not (text := _typed()).strip():
        raise ValueError("no text was given")
    given = (text, scope, source, tags, a.max_items, a.kind, a.importance, a.certainty)
    found = store.preview_ingest(*given)
    if not found:
        raise ValueError("the text holds nothing to remember")
    print(show(found, False))
    if not input(f"Store these {len(found)}? [y/N]: ").strip().lower().startswith("y"):
        return "Nothing was stored."
    return store.ingest(*given)


def _ingest(store, a):
    if a.interactive:
        return _ingest_by_dialogue(store, a)
    if not a.scope:
        raise ValueError("give a --scope")
    if (a.text is None) == (a.file is None):
        raise ValueError("give either --text or --file")
    text, source = a.text, a.source or ""
    if a.file is not None:
        with open(a.file, encoding="utf-8-sig") as f:
            text, source = f.read(), a.source or a.file
    call = store.preview_ingest if a.dry_run else store.ingest
    return call(text, a.scope, source, a.tags or (), a.max_items, a.kind, a.importance, a.certainty)


def _export(store, a):
    wanted = {"scope": a.scope, "kind": a.kind, "tags": a.tags or (), "limit": a.limit}
    if a.format == "jsonl" and a.output:
        store.export_jsonl(a.output, **wanted)
        return {"output": a.output}
    text = store.export_json(**wanted)
    if a.format == "jsonl":
        text = "".join(json.dumps(m, ensure_ascii=False) + "\n" for m in json.loads(text)["memories"])
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
        return {"output": a.output}
    return text


def parse_since(value: str, now: datetime | None = None) -> datetime:
    """``7d`` or an ISO time, as naive UTC."""
    value = value.strip()
    if m := re.fullmatch(r"(\d+)d", value):
        return (now or datetime.now(timezone.utc).replace(tzinfo=None)) - timedelta(days=int(m[1]))
    try:
        t = datetime.fromisoformat(value)
    except ValueError:
        raise ValueError(f"--since must be like '7d' or an ISO timestamp, got {value!r}") from None
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lorekeep")
    parser.add_argument("--table", default="lorekeep-table", help="path of the table")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (arguments, _) in COMMANDS.items():
        sub = commands.add_parser(name)
        for flag, more in arguments:
            sub.add_argument(flag, **more)
        sub.add_argument("--json", action="store_true")
    return parser


def completion(shell: str) -> str:
    flags = {name: " ".join(f for f, _ in arguments if f.startswith("--")) + " --json" for name, (arguments, _) in COMMANDS.items()}
    if shell == "bash":
        cases = "\n".join(f"    {n}) words='{f.strip()}' ;;" for n, f in flags.items())
        return f"""_lorekeep() {{
  local words='{" ".join(flags)}'
  case "${{COMP_WORDS[1]}}" in
{cases}
  esac
  COMPREPLY=($(compgen -W "$words" -- "${{COMP_WORDS[COMP_CWORD]}}"))
}}
complete -F _lorekeep lorekeep
"""
    rows = "\n".join(f"    '{n}' = '{f.strip()}'.Split(' ')" for n, f in flags.items())
    return f"""$lorekeep = @{{
{rows}
}}
Register-ArgumentCompleter -Native -CommandName lorekeep -ScriptBlock {{
    param($word, $ast)
    $parts = $ast.CommandElements | ForEach-Object {{ "$_" }}
    $words = if ($parts.Count -gt 1 -and $lorekeep.ContainsKey($parts[1])) {{ $lorekeep[$parts[1]] }} else {{ $lorekeep.Keys }}
    $words | Where-Object {{ $_ -like "$word*" }}
}}
"""


def _plain(x):
    return x.isoformat() if isinstance(x, (datetime, date)) else str(x)


def show(result, as_json: bool) -> str:
    if isinstance(result, str):
        return result
    if as_json:
        return json.dumps(result, ensure_ascii=False, default=_plain)
    if isinstance(result, dict) and "rendered" in result:
        return result["rendered"]
    rows = result if isinstance(result, list) else [result]
    return "\n".join(_line(r) for r in rows) or "nothing found"


def _line(r) -> str:
    """A result to read: memories and candidates as a line or two, others field by field."""
    if not isinstance(r, dict):
        return str(r)
    if isinstance(r.get("items"), list) and "stored" in r:
        return "\n".join([f"{r['stored']} stored: {r['created']} new, {r['updated']} merged", *map(_line, r["items"])])
    if {"stems_mismatches", "healthy"} <= r.keys():
        wrong = ", ".join(f"{r[k]} {k.replace('_', ' ')}" for k in ("stems_mismatches", "fingerprint_mismatches", "index_mismatches"))
        return f"{'healthy' if r['healthy'] else 'not healthy'}, version {r['version']}: {wrong}" + (f", {r['repaired']} repaired" if r.get("repaired") else "")
    if "action" in r:
        return f"{r['action']}: [{r['kind']}/{r['scope']}] {r['title']} ({r['id']})"
    if {"retention", "age_days"} <= r.keys():
        return f"[{r['kind']}] {r['title']} ({r['id']}): retention {r['retention']}, {r['age_days']:.0f} days old"
    if {"kind", "title"} <= r.keys():
        score = f"{r['score']:.4f} " if "score" in r else ""
        state = " (archived)" if r.get("archived_at") else " (superseded)" if r.get("superseded_by") else ""
        head = f"{score}[{r['kind']}{'/' + r['scope'] if r.get('scope') else ''}] {r['title']}{state}" + (f" ({r['id']})" if r.get("id") else "")
        text = r.get("excerpt") or r.get("summary")
        return f"{head}\n    {text}" if text else head
    return "\n".join(f"{k}: {v}" for k, v in r.items())


def main(argv=None, spark: SparkSession | None = None) -> int:
    a = build_parser().parse_args(argv)
    if a.command == "completion":
        print(completion(a.shell))
        return 0
    spark = spark or SparkSession.builder.appName("lorekeep").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        with MemoryStore(spark, a.table) as store:
            if a.command == "serve-tools":
                from lorekeep.tools import serve

                serve(store, sys.stdin, sys.stdout)
                return 0
            result = COMMANDS[a.command][1](store, a)
    except (NotFound, KeyError, ValueError, ConflictError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(show(result, a.json))
    return int(a.command == "verify" and not result["healthy"])


if __name__ == "__main__":
    sys.exit(main())
