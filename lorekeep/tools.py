"""Eight tools for agents, served over the Model Context Protocol on standard input and output.

One table describes the tools: their parameters make the schema that a client
sees, the check of a call's arguments, and the call. Errors of a tool come back
as its text, so that the caller can mend the call.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from lorekeep import lexicon as X
from lorekeep.cli import _plain, parse_since

PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")
FORMATS = ("markdown", "json")


@dataclass(frozen=True)
class Parameter:
    """A flat parameter: its JSON type, bounds (of the number, or of the text's length) and default."""

    says: str
    type: str = "string"
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()
    default: object = None
    required: bool = False

    def schema(self) -> dict:
        kind = {"type": "array", "items": {"type": "string"}} if self.type == "array" else {"type": self.type}
        low, high = ("minLength", "maxLength") if self.type == "string" else ("minimum", "maximum")
        bounds = {k: v for k, v in ((low, self.least), (high, self.most)) if v is not None}
        more = {**({"enum": list(self.choices)} if self.choices else {}), **({"default": self.default} if self.default is not None else {})}
        return {**kind, **bounds, **more, "description": self.says}

    def problem(self, value) -> str | None:
        kinds = {"string": str, "integer": int, "number": (int, float), "array": (list, tuple)}[self.type]
        if not isinstance(value, kinds) or isinstance(value, bool):
            return f"must be of type {self.type}"
        if self.type == "array" and not all(isinstance(x, str) for x in value):
            return "must hold texts"
        if self.choices and value not in self.choices:
            return f"must be one of {', '.join(self.choices)}"
        size = len(value) if self.type == "string" else value if self.type != "array" else 0
        if (self.least is not None and size < self.least) or (self.most is not None and size > self.most):
            what = "characters " if self.type == "string" else ""
            return f"must be between {self.least or 0} and {self.most} {what}".rstrip()
        return None


def _number(says: str, least, most, default) -> Parameter:
    return Parameter(says, "integer" if isinstance(default, int) else "number", least, most, default=default)


_SCOPE = Parameter("Namespace of the memory, such as project.alpha.", least=1, most=200, required=True)
_IN_SCOPE = Parameter("Only this scope.", most=200)
_KIND = Parameter("Only this kind.", choices=X.KINDS)
_TAGS = Parameter("Only memories with all of these tags.", "array")
_FORMAT = Parameter("markdown to read, json to compute with.", choices=FORMATS, default="markdown")
_SOURCE = Parameter("Where it comes from.", most=200, default="")


@dataclass(frozen=True)
class Tool:
    says: str
    reads: bool
    parameters: dict[str, Parameter]
    run: object  # (store, arguments) -> result

    def schema(self, name: str) -> dict:
        flat = {"type": "object", "properties": {k: p.schema() for k, p in self.parameters.items()}, "additionalProperties": False}
        if needed := [k for k, p in self.parameters.items() if p.required]:
            flat["required"] = needed
        marks = {"title": name.replace("_", " ").capitalize(), "readOnlyHint": self.reads, "destructiveHint": False, "idempotentHint": True, "openWorldHint": False}
        return {"name": name, "description": self.says, "inputSchema": flat, "annotations": marks}


def _forget(store, a):
    if not store.archive(a["memory_id"]):
        raise LookupError(f"no such memory: {a['memory_id']}")
    return {"archived": a["memory_id"]}


TOOLS = {
    "memory_remember": Tool(
        "Stores one memory; one that says the same as a stored one is merged into it.",
        False,
        {
            "scope": _SCOPE,
            "kind": Parameter("What kind of memory it is.", choices=X.KINDS, required=True),
            "title": Parameter("A short headline.", least=1, most=200, required=True),
            "content": Parameter("The whole text.", least=1, most=10_000, required=True),
            "summary": Parameter("One line; made from the text if empty.", most=500, default=""),
            "tags": Parameter("Tags to filter by.", "array"),
            "source": _SOURCE,
            "importance": _number("From 0 to 1.", 0.0, 1.0, 0.5),
            "certainty": _number("From 0 to 1.", 0.0, 1.0, 0.7),
        },
        lambda s, a: s.remember(**a),
    ),
    "memory_ingest": Tool(
        "Splits notes into memories and stores them.",
        False,
        {
            "text": Parameter("The notes.", least=1, most=50_000, required=True),
            "scope": _SCOPE,
            "source": _SOURCE,
            "tags": Parameter("Tags of every memory.", "array"),
            "max_items": _number("Memories at most.", 1, 100, X.SEGMENTS),
            "kind": Parameter("The kind of all of them; guessed for each if left out.", choices=X.KINDS),
        },
        lambda s, a: s.ingest(**a),
    ),
    "memory_forget": Tool("Archives a memory; it can be restored.", False, {"memory_id": Parameter("The memory's id.", least=1, most=64, required=True)}, _forget),
    "memory_search": Tool(
        "Ranked search.",
        True,
        {"query": Parameter("What to look for.", least=1, most=500, required=True), "limit": _number("Results at most.", 1, 50, 5), "scope": _IN_SCOPE, "kind": _KIND, "tags": _TAGS, "response_format": _FORMAT},
        lambda s, a: s.search(**a),
    ),
    "memory_build_context": Tool(
        "A context pack within a budget of characters.",
        True,
        {"query": Parameter("What the agent is about to do.", least=1, most=500, required=True), "budget_chars": _number("Characters at most.", 100, 20_000, 1200), "limit": _number("Memories at most.", 1, 50, 5), "scope": _IN_SCOPE, "kind": _KIND, "tags": _TAGS},
        lambda s, a: s.context(a.pop("query"), a.pop("budget_chars"), **a)["rendered"],
    ),
    "memory_wake_up": Tool(
        "The hottest memories as a pack, to start a session with.",
        True,
        {"budget_chars": _number("Characters at most.", 100, 20_000, 800), "limit": _number("Memories at most.", 1, 50, 6), "scope": _IN_SCOPE},
        lambda s, a: s.wake_up(a.pop("budget_chars"), **a)["rendered"],
    ),
    "memory_list": Tool("The latest memories.", True, {"scope": _IN_SCOPE, "kind": _KIND, "tags": _TAGS, "limit": _number("Results at most.", 1, 100, 20), "response_format": _FORMAT}, lambda s, a: s.list(**a)),
    "memory_stats": Tool(
        "Counts by kind and scope.",
        True,
        {"since": Parameter("Also what changed since then: 7d, or an ISO date.", most=40), "response_format": _FORMAT},
        lambda s, a: s.stats(parse_since(a["since"]) if a.get("since") else None),
    ),
}


def checked(name: str, arguments: dict) -> dict:
    """The arguments with defaults; ValueError names what is wrong."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    known = TOOLS[name].parameters
    given = {k: v for k, v in arguments.items() if v is not None}
    for k, v in given.items():
        if k not in known:
            raise ValueError(f"unknown argument: {k}")
        if (what := known[k].problem(v)) is not None:
            raise ValueError(f"{k} {what}")
    for k, p in known.items():
        if p.required and k not in given:
            raise ValueError(f"{k} is missing")
    return {**{k: p.default for k, p in known.items() if p.default is not None}, **given}


def markdown(result) -> str:
    rows = result if isinstance(result, list) else [result]
    return "\n".join("- " + "; ".join(f"**{k}** {v}" for k, v in r.items()) for r in rows) or "No memories found."


def call(store, name: str, arguments: dict) -> tuple[str, bool]:
    """(the tool's text, whether it is an error)."""
    try:
        a = checked(name, arguments)
        how = a.pop("response_format", "json")
        result = TOOLS[name].run(store, a)
    except Exception as e:  # the caller is a model: it gets the reason as text
        return f"Error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", True
    if isinstance(result, str):
        return result, False
    return (markdown(result) if how == "markdown" else json.dumps(result, ensure_ascii=False, default=_plain)), False


class ProtocolError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def answer(store, method: str, params: dict) -> dict:
    """The result of one request of the protocol."""
    if method == "initialize":
        asked = params.get("protocolVersion")
        return {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "lorekeep", "version": "0.1.0"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [t.schema(n) for n, t in TOOLS.items()]}
    if method == "tools/call":
        if params.get("name") not in TOOLS:
            raise ProtocolError(-32602, f"unknown tool: {params.get('name')}")
        text, wrong = call(store, params["name"], params.get("arguments") or {})
        return {"content": [{"type": "text", "text": text}], "isError": wrong}
    raise ProtocolError(-32601, f"unknown method: {method}")


def serve(store, lines, out) -> None:
    """JSON-RPC 2.0 messages, one a line; notifications get no answer."""

    def send(id, **body) -> None:
        out.write(json.dumps({"jsonrpc": "2.0", "id": id, **body}, ensure_ascii=False) + "\n")
        out.flush()

    for line in lines:
        if not line.strip():
            continue
        try:
            m = json.loads(line)
        except ValueError:
            send(None, error={"code": -32700, "message": "no JSON"})
            continue
        if not isinstance(m, dict) or not isinstance(m.get("method"), str):
            send(m.get("id") if isinstance(m, dict) else None, error={"code": -32600, "message": "no request"})
            continue
        if "id" not in m:
            continue
        try:
            send(m["id"], result=answer(store, m["method"], m.get("params") or {}))
        except ProtocolError as e:
            send(m["id"], error={"code": e.code, "message": str(e)})
