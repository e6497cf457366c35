import json
import threading
import urllib.error
import urllib.request

import pytest

from notewarp import settings
from notewarp.install import install
from notewarp.operators.extraction import json_schema
from notewarp.serve import Tools, answer, explorer
from notewarp.sources.completion import Completion, CompletionError, token_usage


class FakeEngine:
    """Answers like the engine, from a session's small tables."""

    def __init__(self, spark) -> None:
        self.spark = spark

    def overview(self):
        return self.spark.createDataFrame([("a", "A", "person", False)], "id string, name string, type string, truncated boolean"), self.spark.createDataFrame([("a", "r", "a", "e")], "source string, relation string, target string, evidence_id string")

    def entity(self, key):
        return self.spark.createDataFrame([("a", "A")], "entity_id string, canonical_name string").filter(f"entity_id = '{key}'")

    def panel(self, key):
        raise RuntimeError("secret")

    def status(self):
        return {"pending": 1, "watermark": None}


def test_tools_and_answers(spark):
    tools = Tools(FakeEngine(spark))
    assert tools.call("get_entity", entity_id="a") == {"entity_id": "a", "canonical_name": "A"} and tools.call("ingestion_status") == {"pending": 1, "watermark": None}
    for bad in (("get_entity", {"entity_id": "zz"}), ("drop_everything", {})):
        with pytest.raises(ValueError):
            tools.call(bad[0], **bad[1])
    status = lambda target: answer(tools, target)[0]
    assert [status(t) for t in ("/", "/api/graph", "/api/entity?id=a", "/api/entity?id=b", "/api/entity", "/x", "/api/panel?id=a")] == [200, 200, 200, 404, 400, 404, 500]
    assert json.loads(answer(tools, "/api/graph")[2]) == {"nodes": [{"id": "a", "name": "A", "type": "person"}], "edges": [{"source": "a", "relation": "r", "target": "a", "evidence_id": "e"}], "truncated": False}
    assert b"secret" not in answer(tools, "/api/panel?id=a")[2]


def test_explorer_serves_the_loopback_address(spark):
    with pytest.raises(ValueError):
        explorer(FakeEngine(spark), 70_000)
    server = explorer(FakeEngine(spark), 0)
    assert server.server_address[0] == "127.0.0.1"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    with urllib.request.urlopen(f"{at}/api/entity?id=a") as got:
        assert json.loads(got.read())["canonical_name"] == "A" and got.headers["Content-Type"] == "application/json"
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{at}/nothing")
    server.shutdown()
    server.server_close()


def test_settings():
    got = settings.load(None, {"GEMINI_API_KEY": "k", "XDG_DATA_HOME": "/d"})
    assert (got.provider, got.model, got.base_url, got.model_key, got.store) == ("gemini", settings.GEMINI_MODEL, settings.GEMINI_URL, "k", "/d/notewarp/store")
    assert settings.load("s", {"NOTEWARP_PROVIDER": "OpenAI", "GEMINI_API_KEY": "k"}).provider == "openai" and settings.load("s", {"NOTEWARP_BASE_URL": "http://x", "GEMINI_API_KEY": "k"}).provider == "custom"
    for bad in ({"NOTEWARP_PROVIDER": "x"}, {"NOTEWARP_MAX_INPUT_TOKENS": "0"}, {"NOTEWARP_MAX_INPUT_TOKENS": "many"}):
        with pytest.raises(ValueError):
            settings.load("s", bad)
    with pytest.raises(ValueError, match="NOTEWARP_SOURCE_KEY and NOTEWARP_MODEL"):
        settings.load("s", {}).remote()
    assert settings.load("s", {"NOTEWARP_SOURCE_KEY": "a", "NOTEWARP_MODEL": "m", "NOTEWARP_MODEL_KEY": ""}).remote().model_key is None


def test_completion_client():
    sent = []

    def send(status, body):
        return lambda url, headers, data, timeout: sent.append((url, headers, json.loads(data), timeout)) or (status, body)

    ok = json.dumps({"choices": [{"message": {"content": "{}"}}], "usage": {"prompt_tokens": 5, "prompt_tokens_details": {"cached_tokens": 2}}}).encode()
    client = Completion("m", "http://x/v1/", "key", send=send(200, ok))
    assert client("T {evidence}", "[1]", "{}") == ("{}", {"input_tokens": 5, "output_tokens": 0, "cached_input_tokens": 2, "reasoning_tokens": 0})
    url, headers, body, timeout = sent[0]
    assert url == "http://x/v1/chat/completions" and headers["Authorization"] == "Bearer key" and body["temperature"] == 0 and timeout == 120.0
    assert "T {evidence}" in body["messages"][0]["content"] and "[1]" in body["messages"][0]["content"]
    assert token_usage(None) == dict.fromkeys(["input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens"], 0)

    def fails(client):
        with pytest.raises(CompletionError) as error:
            client("t", "[]", "{}")
        return error.value.kind

    def broken(*_):
        raise OSError("down")

    assert fails(Completion("m", "u", send=broken)) == "transport" and fails(Completion("m", "u", send=send(503, b""))) == "status" and fails(Completion("m", "u", send=send(200, b"{}"))) == "contract"
    assert fails(Completion("m", "u", send=send(200, b'{"choices": [{"message": {"content": null}}]}'))) == "empty" and fails(Completion("m", "u", max_input_tokens=3, send=send(200, ok))) == "budget"
    with pytest.raises(ValueError):
        Completion("", "u")


def test_the_json_schema_is_closed():
    def closed(node):
        if node.get("type") == "object":
            assert node["additionalProperties"] is False and node["required"] == list(node["properties"])
            for child in node["properties"].values():
                closed(child)
        if node.get("type") == "array":
            closed(node["items"])

    closed(json_schema())
    assert json_schema()["required"] == ["ontology", "entities", "relations"]


def test_install(tmp_path):
    where = install(tmp_path)
    assert (where / "SKILL.md").exists()
    with pytest.raises(FileExistsError):
        install(tmp_path)
    assert install(tmp_path, force=True) == where
