"""Read-only tools over a store, and a loopback HTTP explorer of the same results."""

from __future__ import annotations

import json
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

# The explorer's address, greatest port.
HOST, DEFAULT_PORT, MAX_PORT = "127.0.0.1", 8765, 65535


def _rows(df) -> list[dict]:
    """Rows of a bounded result as JSON values."""
    return [json.loads(x) for x in df.toJSON().collect()]


class Tools:
    """Six read-only operations for an assistant; every result is bounded by its limit or by one key."""

    NAMES = ("search_knowledge", "get_entity", "get_evidence", "traverse_graph", "list_entity_types", "ingestion_status")

    def __init__(self, engine) -> None:
        self.engine = engine

    def search_knowledge(self, query: str, type_keys: list[str] | None = None, limit: int = 20) -> dict:
        return {"results": _rows(self.engine.search(query, type_keys=tuple(type_keys or ()), limit=limit))}

    def get_entity(self, entity_id: str) -> dict:
        found = _rows(self.engine.entity(entity_id))
        if not found:
            raise ValueError(f"unknown entity: {entity_id}")
        return found[0]

    def get_evidence(self, evidence_id: str) -> dict:
        found = _rows(self.engine.evidence(evidence_id))
        if not found:
            raise ValueError(f"unknown evidence: {evidence_id}")
        return found[0]

    def traverse_graph(self, entity_id: str, max_depth: int = 2, limit: int = 100) -> dict:
        return {"neighbors": _rows(self.engine.traverse(entity_id, depth=max_depth, limit=limit))}

    def list_entity_types(self) -> dict:
        return {"types": _rows(self.engine.entity_types())}

    def ingestion_status(self) -> dict:
        return json.loads(json.dumps(self.engine.status(), default=str))

    def call(self, name: str, **arguments) -> dict:
        """One tool by its name; an unknown name is an error."""
        if name not in self.NAMES:
            raise ValueError(f"unknown tool: {name}")
        return getattr(self, name)(**arguments)


PAGE = """<!doctype html><meta charset="utf-8"><title>notewarp</title><h1>Graph</h1><ul id="n"></ul><pre id="d"></pre>
<script>
fetch('/api/graph').then(r => r.json()).then(g => g.nodes.forEach(n => {
  const li = document.createElement('li'); li.textContent = n.name + ' (' + n.type + ')';
  li.onclick = () => fetch('/api/entity?id=' + encodeURIComponent(n.id)).then(r => r.json()).then(e => document.getElementById('d').textContent = JSON.stringify(e, null, 2));
  document.getElementById('n').append(li);
}));
</script>
"""


def answer(tools: Tools, target: str) -> tuple[int, str, bytes]:
    """(status, content type, body) of a GET: `/`, `/api/graph`, `/api/entity?id=`, `/api/panel?id=`."""

    def as_json(value: dict, status: int = HTTPStatus.OK) -> tuple[int, str, bytes]:
        return int(status), "application/json", json.dumps(value, separators=(",", ":"), default=str).encode()

    url = urlsplit(target)
    ids = parse_qs(url.query).get("id", [])
    if url.path == "/":
        return 200, "text/html; charset=utf-8", PAGE.encode()
    try:
        if url.path == "/api/graph":
            nodes, edges = tools.engine.overview()
            shown = _rows(nodes)
            return as_json({"nodes": [{k: v for k, v in n.items() if k != "truncated"} for n in shown], "edges": _rows(edges), "truncated": bool(shown and shown[0]["truncated"])})
        if url.path in ("/api/entity", "/api/panel"):
            if len(ids) != 1 or not ids[0]:
                return as_json({"error": "one id is needed"}, HTTPStatus.BAD_REQUEST)
            if url.path == "/api/panel":
                return as_json({"relations": _rows(tools.engine.panel(ids[0]))})
            try:
                return as_json(tools.get_entity(ids[0]))
            except ValueError as error:
                return as_json({"error": str(error)}, HTTPStatus.NOT_FOUND)
    except Exception:  # noqa: BLE001 - details stay on the server
        return as_json({"error": "the request failed"}, HTTPStatus.INTERNAL_SERVER_ERROR)
    return as_json({"error": "not found"}, HTTPStatus.NOT_FOUND)


def explorer(engine, port: int = DEFAULT_PORT) -> ThreadingHTTPServer:
    """A server on the loopback address, not started; port 0 takes any free one."""
    if not 0 <= port <= MAX_PORT:
        raise ValueError(f"the port must be 0 to {MAX_PORT}")
    tools = Tools(engine)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, kind, body = answer(tools, self.path)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_args) -> None:
            """Quiet."""

    return ThreadingHTTPServer((HOST, port), Handler)
