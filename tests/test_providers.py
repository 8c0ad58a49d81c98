"""Remote models against a server of this process."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tests.conftest import rows
from weftmark.config import Config
from weftmark.plans import pipeline
from weftmark.plans.providers import LexicalScorer, RemoteJudge, RemoteRewriter, RemoteScorer, ThresholdJudge, chat, chosen_models, token_sums, verdict

CHUNKS = "doc_file string, heading string, chunk_index int, hash string, content string"


@pytest.fixture
def server():
    """Re-ranks by whether a document names a word of the query, and fails where it is told to."""
    state = {"open": 0, "most": 0, "calls": [], "lock": threading.Lock(), "wait": 0.0, "answer": None, "reject": None}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with state["lock"]:
                state["open"] += 1
                state["most"] = max(state["most"], state["open"])
                state["calls"].append(body)
            time.sleep(state["wait"])
            code, got = 200, None
            if state["reject"] and state["reject"](body):
                code, got = 400, {}
            elif "query" in body:
                got = {"results": [{"index": i, "relevance_score": 0.9 if "alpha" in body["query"] and "alpha" in d else 0.2} for i, d in enumerate(body["documents"])], "usage": {"total_tokens": 150}}
            else:
                text = state["answer"](body["messages"][-1]["content"])
                got = {"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 100, "completion_tokens": 7}}
            with state["lock"]:
                state["open"] -= 1
            data = json.dumps(got).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{s.server_port}/"
    yield state
    s.shutdown()


def files(spark, n=6):
    data = [(f"f{i}.py", "text", [f"def alpha{i}()" if i % 2 else f"def beta{i}()"], None) for i in range(n)]
    return spark.createDataFrame(data, "file_path string, text string, signatures array<string>, variables array<string>")


def test_a_run_with_models_sums_tokens_and_asks_once(spark, server):
    server["answer"] = lambda user: json.dumps({"is_match": "alpha1" in user, "reasoning": "it defines alpha1"})
    chunks = spark.createDataFrame([("d", "H", 0, "h", "about alpha"), ("d", "Other", 0, "o", "about nothing")], CHUNKS)
    cfg = Config(rerank_batch_size=4, max_concurrent=8)
    got = pipeline.analyze(chunks, files(spark), None, cfg, RemoteScorer(server["url"]), RemoteJudge(server["url"]))
    calls = len(server["calls"])
    assert rows(got.rows, "heading", "files") == [("H", ["f1.py"]), ("Other", [])]
    scored = [c for c in server["calls"] if "query" in c]
    assert token_sums(got.answers, "tokens") == {"tokens": 150 * len(scored)} and len(scored) in (2, 4)
    judged = [c for c in server["calls"] if "messages" in c]
    assert len(judged) == 3 and token_sums(got.classifications, "input_tokens", "output_tokens") == {"input_tokens": 300, "output_tokens": 21}
    assert rows(got.classifications.where("is_match"), "target_id", "reasoning") == [("file:f1.py", "it defines alpha1")]
    pipeline.analysis_report(got).collect()
    [x.collect() for x in pipeline.eval_rows(got)]
    assert len(server["calls"]) == calls  # what was answered is stored


def test_a_failed_request_loses_no_link(spark, server):
    """The section of which one batch failed is paired with every file, the other only with those scored."""
    chunks = spark.createDataFrame([("d", "H", 0, "h", "about alpha"), ("d", "Lost", 0, "o", "alpha, too")], CHUNKS)
    server["reject"] = lambda body: "query" in body and "Lost" in body["query"] and any("f1.py" in d for d in body["documents"])
    server["answer"] = lambda user: "FALSE. no"
    got = pipeline.analyze(chunks, files(spark), None, Config(rerank_batch_size=2), RemoteScorer(server["url"]), RemoteJudge(server["url"]))
    assert [r for r in rows(got.answers.where("error IS NOT NULL"), "heading", "file_path", "score")] == [("Lost", None, None)]
    pairs = {}
    for r in got.pairs.collect():
        pairs.setdefault(r["heading"], set()).add(r["file_path"])
    assert pairs == {"H": {"f1.py", "f3.py", "f5.py"}, "Lost": {f"f{i}.py" for i in range(6)}}


def test_requests_at_once_are_bounded(spark, server):
    server["answer"], server["wait"] = lambda user: "TRUE", 0.05
    pairs = spark.range(40).selectExpr("'d' AS doc_file", "'H' AS heading", "CAST(id AS int) AS chunk_index", "'c' AS content", "CONCAT('f', id) AS file_path", "CAST(NULL AS array<string>) AS signatures", "CAST(NULL AS array<string>) AS variables")
    for most in (1, 3, 12):
        server["most"] = 0
        got = RemoteJudge(server["url"]).judge(pairs, Config(max_concurrent=most))
        assert got.where("is_match AND status = 'ok'").count() == 40
        assert server["most"] <= most and (most == 1 or server["most"] > 1)


def test_servers_that_know_neither_temperature_nor_schema(server):
    server["answer"] = lambda user: "TRUE because"
    server["reject"] = lambda body: "temperature" in body or "response_format" in body
    cfg = Config(temperature=0.5)
    assert chat(server["url"], cfg, "s", "u", schema={"type": "object"}) == ("TRUE because", 100, 7)
    with pytest.raises(OSError):
        chat(server["url"], Config(drop_params=False), "s", "u")
    assert "temperature" in server["calls"][0] and "temperature" not in server["calls"][1]


def test_verdicts():
    assert verdict('{"is_match": true, "reasoning": "x"}') == (True, "x") and verdict("FALSE - y") == (False, "y") and verdict("**true**") == (True, "")
    for bad in ("", "perhaps", "trueish", '{"is_match": 1}'):
        with pytest.raises(ValueError):
            verdict(bad)


def test_rewriting_with_a_model(spark, server):
    server["answer"] = lambda user: "new text"
    df = spark.createDataFrame([("d", "H", "old", "diff", None, None)], "doc_file string, heading string, content string, diff_context string, code_context string, explicit string")
    got = RemoteRewriter(server["url"]).rewrite(df, Config())
    assert rows(got, "new_text", "error", "input_tokens") == [("new text", None, 100)]
    server["reject"] = lambda body: True
    assert got.first()["error"].startswith("HTTPError") and got.first()["new_text"] is None


def test_models_by_settings(tmp_path, monkeypatch):
    assert tuple(map(type, chosen_models(Config())))[:2] == (LexicalScorer, ThresholdJudge)
    (tmp_path / "config.yaml").write_text("rerank_url: http://r\nleast_score: 0.4\n")
    monkeypatch.setenv("LLM_URL", "http://m")
    assert chosen_models(Config.load(tmp_path)) == (RemoteScorer("http://r"), RemoteJudge("http://m"), RemoteRewriter("http://m"))
    monkeypatch.delenv("LLM_URL")
    assert chosen_models(Config.load(tmp_path))[1] == ThresholdJudge(0.4)
