import base64
import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from quillspark import config, server
from quillspark.engine import Engine
from quillspark.errors import ConfigError
from quillspark.sources.kv import SCHEMA, live
from quillspark.streaming.replication import replicate

TOML = """
[server]
id = 7
replication_port = 9000
[peer]
address = "10.0.0.1:9999"
[storage]
base_dir = "/data"
[wal]
flush_interval_secs = 5
batch_size = 3
[http]
port = 3001
trusted_ips = ["127.0.0.1", "192.168.1.0/24"]
secret_key = "s"
[[databases]]
id = 0
name = "default"
[[databases]]
id = 1
name = "second"
"""


def test_config():
    c = config.parse(TOML)
    assert (c.server_id, c.base_dir, c.batch_size, c.peer_address, [d.name for d in c.databases]) == (7, "/data", 3, "10.0.0.1:9999", ["default", "second"])
    assert config.parse("").http_port == 3000
    for bad in ("[[databases]]\nid = 1", "not toml ["):
        with pytest.raises(ConfigError):
            config.parse(bad)
    with pytest.raises(ConfigError):
        config.load("/nonexistent.toml")


def test_put_get_remove(engine, spark):
    assert engine.get(0, "t", b"k") is None
    engine.put(0, "t", b"k", b"1")
    assert engine.get(0, "t", b"k") == b"1"
    engine.flush()
    engine.put(0, "t", b"k", b"2")
    engine.put(0, "other", b"k", b"9")
    assert engine.get(0, "t", b"k") == b"2"
    engine.flush()
    engine.remove(0, "t", b"k")
    assert engine.get(0, "t", b"k") is None
    engine.put(0, "t", b"\x00\xff", b"")
    assert [(bytes(r["key"]), bytes(r["value"])) for r in engine.kv_table(0, "t").collect()] == [(b"\x00\xff", b"")]
    engine.log.compact()
    assert engine.get(0, "t", b"k") is None and engine.get(0, "other", b"k") == b"9" and engine.get(0, "t", b"\x00\xff") == b""
    engine.put(0, "t", b"k", b"3")
    engine.flush()
    again = Engine(spark, base_dir=engine.base_dir)
    assert again.get(0, "t", b"k") == b"3" and again.log.seq == engine.log.seq
    engine.log.put_all(spark.range(100).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit(b"x").alias("value")), 0, "bulk")
    assert engine.kv_table(0, "bulk").count() == 100


def test_batches_fill_up(spark, tmp_path):
    c = config.Config(batch_size=3, flush_interval_secs=1000)
    e = Engine(spark, c, base_dir=f"file://{tmp_path}")
    for i in range(4):
        e.put(0, "t", b"%d" % i, b"v")
    assert len(e.log.buffer) == 1 and e.log.stored().count() == 3


def test_newest_operation_counts_whatever_the_order(spark):
    rows = [(2, 1, 0, "t", b"a", b"new", False), (1, 1, 0, "t", b"a", b"old", False), (2, 1, 0, "t", b"a", b"new", False), (3, 1, 0, "t", b"b", None, True), (1, 2, 0, "t", b"b", b"x", False), (5, 1, 0, "t", b"c", b"1", False), (5, 2, 0, "t", b"c", b"2", False)]
    got = {bytes(r["key"]): bytes(r["value"]) for r in live(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {b"a": b"new", b"c": b"2"}


def test_replication(spark, tmp_path):
    one = Engine(spark, config.Config(server_id=1), base_dir=f"file://{tmp_path}/one")
    two = Engine(spark, config.Config(server_id=2), base_dir=f"file://{tmp_path}/two")
    one.put(0, "t", b"a", b"1")
    one.put(0, "t", b"b", b"1")
    for _ in range(2):  # the second run picks up where the first one stopped
        query = replicate(one.log, two.log, f"{tmp_path}/checkpoint", once=True)
        query.awaitTermination(120)
        assert query.exception() is None
        one.put(0, "t", b"a", b"2")
        one.remove(0, "t", b"b")
    assert two.get(0, "t", b"a") == b"2" and two.get(0, "t", b"b") is None
    assert two.log.stored().count() == 4


@pytest.fixture
def http(spark, tmp_path):
    e = Engine(spark, config.Config(secret_key="key"), base_dir=f"file://{tmp_path}")
    s = server.serve(e, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def call(method, path, body=None, key="key"):
        req = urllib.request.Request(f"http://127.0.0.1:{s.server_address[1]}{path}", json.dumps(body).encode() if body is not None else None, {"x-api-key": key, "Content-Type": "application/json"}, method=method)
        try:
            with urllib.request.urlopen(req, timeout=120) as r:
                raw = r.read()
                return r.status, json.loads(raw) if raw else None
        except urllib.error.HTTPError as err:
            return err.code, json.loads(err.read())

    yield call
    s.shutdown()


def test_http(http):
    ask = lambda sql, params=None, tx=None: http("POST", "/api/db/default/query", {"sql": sql, "params": params, "txId": tx})
    assert ask("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT)")[0] == 200
    assert ask("INSERT INTO users VALUES (?, ?)", [1, "Ann"])[1]["affected_rows"] == 1
    status, tx = http("POST", "/api/db/default/transaction/begin")
    assert status == 200
    ask("UPDATE users SET name = 'Bo'", tx=tx["txId"])
    assert http("POST", f"/api/db/default/transaction/{tx['txId']}/rollback")[0] == 204
    assert http("POST", f"/api/db/default/transaction/{tx['txId']}/commit")[0] == 400
    assert ask("SELECT * FROM users")[1]["rows"] == [{"id": 1, "name": "Ann"}]
    assert ask("SELEC")[0] == 400 and http("POST", "/api/db/nope/query", {"sql": "SELECT 1"})[0] == 404
    assert http("POST", "/api/db/default/query", {"sql": "SELECT 1"}, key="wrong")[0] == 401
    row = "/api/db/default/table/raw/row/my%20key"
    assert http("GET", row)[0] == 404
    assert http("PUT", row, {"value": base64.b64encode(b"hello").decode()})[0] == 204
    assert base64.b64decode(http("GET", row)[1]["value"]) == b"hello"
    assert http("PUT", row, {})[0] == 400 and http("PUT", row, {"value": 5})[0] == 400
    assert http("DELETE", row)[0] == 204 and http("GET", row)[0] == 404
    assert http("POST", "/api/flush")[0] == 204 and http("GET", "/api/unknown")[0] == 404


def test_allow_list():
    trusted = ("127.0.0.1", "::1", "192.168.1.0/24")
    assert server.allowed("192.168.1.77", trusted) and server.allowed("::ffff:127.0.0.1", trusted) and server.allowed("::1", trusted)
    assert not server.allowed("192.168.2.1", trusted) and not server.allowed("10.0.0.1", ())


def test_a_lone_put_is_written_after_the_interval(spark, tmp_path):
    e = Engine(spark, config.Config(batch_size=100, flush_interval_secs=1), base_dir=f"file://{tmp_path}")
    e.put(0, "t", b"k", b"v")
    for _ in range(200):
        if not e.log.buffer:
            break
        time.sleep(0.1)
    assert Engine(spark, base_dir=e.base_dir).get(0, "t", b"k") == b"v"


def test_compaction_waits_for_replicas(spark, tmp_path):
    one, two, three = (Engine(spark, config.Config(server_id=i), base_dir=f"file://{tmp_path}/{i}") for i in (1, 2, 3))
    one.put(0, "t", b"x", b"1")
    replicate(one.log, two.log, f"file://{tmp_path}/cp2", once=True).awaitTermination()
    one.put(0, "t", b"z", b"9")
    one.flush()
    one.remove(0, "t", b"x")
    one.log.compact()
    one.put(0, "t", b"y", b"2")
    one.log.compact()
    one.put(0, "t", b"w", b"3")
    for replica, at in ((two, "cp2"), (three, "cp3")):
        replicate(one.log, replica.log, f"file://{tmp_path}/{at}", once=True).awaitTermination()
        assert {bytes(r["key"]): bytes(r["value"]) for r in replica.kv_table(0, "t").collect()} == {b"z": b"9", b"y": b"2", b"w": b"3"}
    assert one.get(0, "t", b"x") is None
    one.log.forget(f"file://{tmp_path}/cp3")
    one.log.compact()
    assert not [n for n in one.files.list(one.log.operations) if n.endswith(".parquet")] and one.get(0, "t", b"z") == b"9"
