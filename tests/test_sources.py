"""Followed files, pipes, policies from files, the environment and a server."""

import http.server
import json
import os
import threading

import pytest

from veilspark.config import ScanConfig, from_env, random_salt
from veilspark.sources import follow, policy

BASE = ScanConfig(salt="s" * 32)


def test_environment():
    env = {"PII_SALT": "x" * 16, "PII_ENTROPY_THRESHOLD": "4.5", "PII_CONFIDENCE_THRESHOLD": "no", "PII_MIN_SECRET_LENGTH": "0", "PII_SENSITIVE_KEYS": "a, b", "PII_ENTITY_TYPE_LABELS": "true", "PII_CUSTOM_REGEX_LIST": '[{"pattern": "p", "name": "n"}]', "PII_SAFE_REGEX_LIST": "{", "PII_BIGRAM_DEFAULT_SCORE": "", "OTHER": "1"}
    config, warnings = from_env(env, BASE)
    assert (config.salt, config.entropy_threshold, config.confidence_score, config.min_secret_length, config.sensitive_keys, config.entity_type_labels) == ("x" * 16, 4.5, 1.0, 6, ("a", "b"), True)
    assert config.custom_regexes[0].name == "n" and config.safe_regexes == () and len(warnings) == 3
    assert from_env({"PII_SALT": "short"}, BASE)[1] and len(random_salt()) == 64 and random_salt() != random_salt()
    with pytest.raises(ValueError):
        from_env({"PII_SALT": "short", "PII_REQUIRE_STRONG_SALT": "1"}, BASE)


def test_policy_file(tmp_path):
    path = tmp_path / "p.json"
    source = policy.PolicyFile(str(path), BASE, {"PII_ENTROPY_THRESHOLD": "5"})
    assert source() == source.base and source.base.entropy_threshold == 5
    path.write_text(json.dumps({"revision": "r1", "entropy_threshold": 4, "min_secret_length": 9, "salt": "evil"}))
    assert source().min_secret_length == 9 and source.config.entropy_threshold == 5 and source.config.salt == BASE.salt and source.revision == "r1"
    assert not source.check()  # unchanged
    path.write_text('{"min_secret_length": "bad", "and": "longer than before"}')
    assert source().min_secret_length == 9 and (source.loads, source.refusals) == (1, 1)
    path.write_bytes(b"\xff\xfe")
    assert source().min_secret_length == 9 and source.refusals == 2
    path.unlink()
    assert source().min_secret_length == 9


def test_followed_file(tmp_path):
    path = str(tmp_path / "a.log")
    reader = follow._FileReader(path, 1000)
    at = reader.initialOffset()

    def more():
        nonlocal at
        before = at
        lines, at = reader.read(at)
        got = [x for x, in lines]
        assert [x for x, in reader.readBetweenOffsets(before, at)] == got or not os.path.exists(path)
        return got

    assert more() == []
    with open(path, "wb") as f:
        f.write(b"one\r\ntwo\nthr")
    assert more() == ["one", "two"] and more() == []
    with open(path, "ab") as f:
        f.write(b"ee\n")
    assert more() == ["three"]
    os.rename(path, path + ".1")
    assert more() == []
    with open(path, "wb") as f:
        f.write(b"new file, longer than the old one was when it went\n")
    assert more() == ["new file, longer than the old one was when it went"]
    os.truncate(path, 0)
    with open(path, "ab") as f:
        f.write(b"cut\n")
    assert more() == ["cut"]
    with open(path, "ab") as f:
        f.write(b"x" * 2500 + b"\n")
    assert list(map(len, more() + more() + more())) == [1000, 1000, 500]


def test_pipe(tmp_path):
    path = str(tmp_path / "pipe")
    os.mkfifo(path)
    reader = follow._PipeReader(path, 1 << 20)
    lines, at = reader.read(reader.initialOffset())
    assert list(lines) == []
    writer = os.open(path, os.O_WRONLY)
    os.write(writer, b"a\nb")
    lines, at = reader.read(at)
    assert list(lines) == [("a",)]
    os.write(writer, b"c\nrest")
    os.close(writer)
    lines, at = reader.read(at)
    assert list(lines) == [("bc",), ("rest",)]
    writer = os.open(path, os.O_WRONLY)
    os.write(writer, b"again\n")
    lines, at = reader.read(at)
    os.close(writer)
    assert list(lines) == [("again",)]


def test_followed_file_as_a_stream(spark, tmp_path):
    spark.dataSource.register(follow.FollowedFile)
    path = tmp_path / "a.log"
    path.write_text("one\ntwo\npart")
    seen = []
    query = spark.readStream.format("followed_file").option("path", str(path)).load().writeStream.foreachBatch(lambda df, n: seen.extend(r.value for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    import time

    try:
        for wanted in (2, 3):
            for _ in range(150):
                if len(seen) >= wanted:
                    break
                time.sleep(0.2)
            with open(path, "a") as f:
                f.write("ial\n")
    finally:
        query.stop()
    assert seen[:3] == ["one", "two", "partial"]


def test_server():
    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/policy")
            elif self.path == "/away":
                self.send_response(302)
                self.send_header("Location", "http://other.invalid/policy")
            elif self.path == "/large":
                self.send_response(200)
                self.end_headers()
                self.wfile.write(b"x" * (policy.REMOTE_BYTES + 1))
                return
            elif self.headers.get("If-None-Match") == '"e1"':
                self.send_response(304)
            elif self.headers.get("Authorization") == "Bearer t":
                self.send_response(200)
                self.send_header("ETag", '"e1"')
                self.end_headers()
                self.wfile.write(b'{"a": 1}')
                return
            else:
                self.send_response(401)
            self.end_headers()

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(202 if body == b"{}" else 302)
            self.send_header("Location", "/")
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert policy.fetch_policy(url + "/policy", "t", plain=True) == policy.Fetched('{"a": 1}', '"e1"')
        assert policy.fetch_policy(url + "/moved", "t", plain=True).body == '{"a": 1}'
        assert policy.fetch_policy(url + "/policy", "t", '"e1"', plain=True) == policy.Fetched(None, '"e1"')
        assert policy.send_report(url, "{}", plain=True) == 202
        for call in (lambda: policy.fetch_policy(url + "/policy", plain=True), lambda: policy.fetch_policy(url + "/away", "t", plain=True), lambda: policy.send_report(url, "[]", plain=True), lambda: policy.fetch_policy(url + "/large", "t", plain=True), lambda: policy.fetch_policy(url), lambda: policy.send_report(url, "{}")):
            with pytest.raises((OSError, ValueError)):
                call()
    finally:
        server.shutdown()
