"""Ingest, store, export, live sync and the command line, on a log of our own: a gardener asks about a well."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstore import cli
from turnstore.functions.content import flatten_content, truth
from turnstore.operators import ingest, metrics, sessions
from turnstore.sources.jsonl import find_log, parse_lines, read_logs
from turnstore.store import Session, Store
from turnstore.streaming import live


def record(kind, name, content, parent=None, **more):
    return {"type": kind, "uuid": name, "parentUuid": parent, "message": {"role": kind, "content": content}, **more}


def spent(model, **tokens):
    return {"message_more": {"model": model, "usage": {f"{k}_tokens": v for k, v in tokens.items()}}}


def assistant(name, content, parent, timestamp, message_more):
    r = record("assistant", name, content, parent, timestamp=timestamp)
    r["message"] |= message_more
    return r


ASK = record("user", "ask", "How deep is the well?", timestamp="2031-07-08T03:04:05.250+02:00", cwd="/garden", version="9.9")
CALL = assistant(
    "call", [{"type": "thinking", "thinking": "I must measure."}, {"type": "tool_use", "id": "rope-7", "name": "Sound", "input": {"well": "north", "m": [1, 2]}}], "ask", 777, **spent("gauge", input=3, output=4, cache_read_input=40)
)
ANSWER = record("user", "echo", [{"type": "tool_result", "tool_use_id": "rope-7", "is_error": "yes", "content": [{"type": "text", "text": "eleven"}, {"type": "text", "text": "metres"}]}], "call", timestamp=True, gitBranch="spring")
CLOSE = assistant("close", [{"type": "text", "text": "Eleven metres."}], "echo", "soon", **spent("gauge", input=8, output=2, cache_creation_input=70))
NOTES = {"type": "permission-mode", "permissionMode": "ask-first"}
LOG = [ASK, NOTES, CALL, ANSWER, CLOSE]


def lines_of(spark, records, session="well"):
    return spark.createDataFrame([(session, k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(records)], live.SEGMENT)


@pytest.fixture()
def log(tmp_path):
    folder = tmp_path / "logs" / "project"
    folder.mkdir(parents=True)
    path = folder / "well.jsonl"
    path.write_text("\n\n".join(json.dumps(r) for r in LOG[:3]) + "\n{broken\n[1]\n" + "\r\n".join(json.dumps(r) for r in LOG[3:]))
    return str(path)


@pytest.mark.parametrize("format", ["parquet", "orc"])
def test_convert(spark, log, tmp_path, format):
    store = Store(spark, str(tmp_path / "store"), format)
    assert store.convert(log) == {"messages": 4, "tool_uses": 1, "tool_results": 1, "skipped": 1}
    m = store.table("messages").orderBy("seq").collect()
    assert [(r["seq"], r["uuid"], r["parent_uuid"]) for r in m] == [(0, "ask", ""), (1, "call", "ask"), (2, "echo", "call"), (3, "close", "echo")]
    assert [r["content_text"] for r in m] == ["How deep is the well?", "I must measure.", "eleven\nmetres", "Eleven metres."]
    assert [r["timestamp"] for r in m] == [1941239045.25, 777.0, 1.0, 0.0]
    assert json.loads(m[0]["content_json"]) == ASK["message"]["content"] and json.loads(m[1]["content_json"]) == CALL["message"]["content"]
    (call,) = store.table("tool_calls").collect()
    assert (call["tool_use_id"], call["name"], call["result_text"], call["message_uuid"], call["result_uuid"], call["is_error"]) == ("rope-7", "Sound", "eleven\nmetres", "call", "echo", True)
    (row,) = store.inspect().collect()
    assert (row["cwd"], row["git_branch"], row["agent_version"], row["permission_mode"], row["messages"], row["tool_calls"]) == ("/garden", "spring", "9.9", "ask-first", 4, 1)
    assert (row["input_tokens"], row["output_tokens"], row["cache_creation_input_tokens"], row["cache_read_input_tokens"]) == (11, 6, 70, 40)
    both = sessions.with_messages(store.table("tool_calls"), store.table("messages")).first()
    assert (both["message"]["content_text"], both["result_message"]["seq"]) == ("I must measure.", 2)
    (args,) = sessions.call_args(store.table("tool_calls"), "Sound").select(F.to_json("args").alias("a")).collect()
    assert json.loads(args["a"]) == {"well": "north", "m": [1, 2]} and sessions.call_args(store.table("tool_calls"), "Dig").count() == 0


def test_several_logs(spark, log, tmp_path):
    other = tmp_path / "logs" / "pond side.jsonl"
    other.write_text(json.dumps(ASK))
    store = Store(spark, str(tmp_path / "store"))
    assert store.convert([log, str(other)])["messages"] == 5
    assert {r["session_id"] for r in store.list_sessions().collect()} == {"well", "pond side"}
    store.export(str(tmp_path / "first"))
    assert spark.read.text(str(tmp_path / "first")).count() == 1
    assert store.convert(str(other), session_id="again", overwrite=True)["messages"] == 1 and store.table("messages").count() == 1


def test_pruned_reads(spark, tmp_path):
    """What one session holds is read from its bucket's folder; in a file its rows lie together and in order."""
    store = Store(spark, str(tmp_path))
    rows = spark.range(2000).selectExpr("concat('s', id % 40) as session_id", "cast(2000 - id as long) as seq")
    store.append("messages", rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], "uuid string, parent_uuid string, type string, role string, model string, timestamp double, content_text string, content_json string, input_tokens long, output_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, embedding array<float>").schema)))
    mine = store.table("messages", "s7")
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert mine.count() == 50 and "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(session_id), EqualTo(session_id,s7)]" in plan
    seqs = [r["seq"] for r in mine.coalesce(1).collect()]
    assert seqs == sorted(seqs)


def test_export(spark, log, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for name in (None, "nobody"):
        with pytest.raises(ValueError):
            store.export(str(tmp_path / "out"), name)
    store.convert(log)
    store.export(str(tmp_path / "out"))
    rows = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [r["parentUuid"] for r in rows] == [None, "ask", "call", "echo"]
    assert rows[1]["message"]["content"] == CALL["message"]["content"] and rows[1]["message"]["usage"]["cache_read_input_tokens"] == 40
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.export(str(tmp_path / "out"))


def nested(depth):
    """A tool result in a tool result, and so on, with a text on each level."""
    inner = [{"type": "text", "text": "core"}]
    for k in range(depth):
        inner = [{"type": "text", "text": f"level {k}"}, {"type": "tool_result", "content": inner}, {"type": "text", "text": ""}]
    return inner


@pytest.mark.parametrize(
    "content, text",
    [
        ("plain", "plain"),
        (None, ""),
        (41, ""),
        ({"type": "text", "text": "no list"}, ""),
        ([], ""),
        ([{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "Dig"}, {"type": "tool_result", "content": "mud"}, {"type": "text", "text": "done"}], "hm\nmud\ndone"),
        ([3, "x", None, {"type": "picture"}, {"type": "text", "text": 5}, {"type": "tool_result"}, {"type": "tool_result", "content": 9}, {"text": "no kind"}], ""),
        ([{"type": "text", "text": '"tool_result"'}], '"tool_result"'),
        (nested(10), "\n".join(f"level {k}" for k in range(9, -1, -1)) + "\ncore"),
    ],
)
def test_flatten(spark, content, text):
    df = spark.createDataFrame([(json.dumps(content),)], "c string").select(flatten_content(F.try_parse_json("c")).alias("t"))
    assert df.first()["t"] == text


def test_truth(spark):
    cases = [(True, True), (False, False), (None, False), (0, False), (0.0, False), (2, True), (-0.5, True), ("", False), ("false", True), ("0", True), ([], False), ({}, False), ([0], True), ({"a": None}, True)]
    df = spark.createDataFrame([(json.dumps({"x": x}), want) for x, want in cases] + [("{}", False)], "c string, want boolean")
    assert [r["got"] == r["want"] for r in df.select(truth(F.try_parse_json("c"), "$.x").alias("got"), "want").collect()] == [True] * (len(cases) + 1)


def test_pairing_of_repeated_ids(spark):
    use = lambda i, n: record("assistant", n, [{"type": "tool_use", "id": i, "name": n, "input": {}}])
    result = lambda i, t: record("user", t, [{"type": "tool_result", "tool_use_id": i, "content": t, "is_error": True}])
    rows = [result("p", "early"), use("p", "Dig"), result("p", "late"), use("p", "Fill"), result("q", "stray"), use("r", "Wait")]
    records = parse_lines(lines_of(spark, rows))
    got = [(r["tool_use_id"], r["name"], r["result_text"], r["is_error"], r["seq"]) for r in ingest.tool_calls(records).orderBy("seq").collect()]
    assert got == [("p", "Dig", "late", True, 0), ("p", "Fill", "", False, 1), ("r", "Wait", "", False, 2), ("q", "", "stray", True, 3)]
    c = ingest.counters(records).first()
    assert (c["messages"], c["tool_uses"], c["tool_results"], c["skipped"]) == (6, 4, 3, 0)


@pytest.mark.parametrize("format", ["parquet", "orc"])
def test_session(spark, tmp_path, format):
    store = Store(spark, str(tmp_path), format)
    with Session(store, "pond") as s:
        assert s.turn_count() == 0 and s.get_artifact("map") is None and s.get_recent_context(4).count() == 0 and s.attrs() == {}
        ids = s.add_turns([("gardener", f"plant {k}", [k / 2, 1.0, -k] if k in (1, 4) else None) for k in range(5)])
        s.add_turn("guide", "water it")
        got = s.get_recent_context(2).collect()
        assert [r["content"] for r in got] == ["plant 4", "water it"] and got[0]["embedding"] == [2.0, 1.0, -4.0] and got[1]["embedding"] is None
        assert s.turn_count() == 6 and s.get_recent_context(0).count() == 0 and s.get_recent_context(50).count() == 6
        with pytest.raises(ValueError):
            s.add_turn("guide", "too short", [0.5])
        for data in (np.array([[True], [False]]), np.linspace(0, 1, 12).reshape(2, 3, 2)):
            s.store_artifact("map", data)
        assert (s.get_artifact("map") == data).all() and s.get_artifact("map").dtype == np.float64
        call = s.add_tool_call("Sound", {"well": 2}, "dry", np.arange(3), message_uuid=ids[0], result_uuid=ids[1], is_error=True)
        row = store.table("tool_calls").first()
        assert (row["message_uuid"], row["result_uuid"], row["is_error"], row["seq"]) == (ids[0], ids[1], True, 0) and s.get_artifact(f"tool:{call}").tolist() == [0, 1, 2]
        s.set_session_attrs(cwd="/garden", model="gauge")
        s.set_session_attrs(cwd=None, summary="wet")
        assert (s.attrs()["cwd"], s.attrs()["summary"]) == ("/garden", "wet")
        assert s.total_usage()["input_tokens"] == 0
        before = store.table("messages").inputFiles()
        for name in ("messages", "artifacts"):
            store.rewrite(name)
        assert len(before) == 2 and len(store.table("messages").inputFiles()) == 1
        assert [r["content"] for r in s.get_recent_context(2).collect()] == ["plant 4", "water it"] and s.get_artifact("map").dtype == np.float64
    assert [r["session_id"] for r in store.list_sessions().collect()] == ["pond"] and store.inspect().first()["messages"] == 6
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), "csv")


def test_live_sync(spark, tmp_path):
    """A growing log in three syncs: the use of the first meets its result in the second, and the third has nothing new."""
    log, seg, store = tmp_path / "well.jsonl", str(tmp_path / "seg"), str(tmp_path / "store")
    read = lambda name: live.table(spark, store, name)
    log.write_text("".join(json.dumps(r) + "\n" for r in LOG[:3]))
    assert live.tail_log(spark, str(log), seg, "well") == 3
    live.sync(spark, seg, store)
    assert read("messages").count() == 2 and read("tool_calls").count() == 0
    (a,) = live.session_attributes(spark, store).collect()
    assert (a["cwd"], a["git_branch"], a["agent_version"], a["permission_mode"]) == ("/garden", None, "9.9", "ask-first")
    moved = ANSWER | {"cwd": "/shed"}
    log.write_text("".join(json.dumps(r) + "\n" for r in [*LOG[:3], moved, CLOSE]))
    assert live.tail_log(spark, str(log), seg, "well") == 5
    live.sync(spark, seg, store)
    assert live.tail_log(spark, str(log), seg, "well") == 5
    live.sync(spark, seg, store)
    m = read("messages").orderBy("seq").collect()
    assert [r["seq"] for r in m] == [0, 2, 3, 4] and json.loads(m[1]["content_json"]) == CALL["message"]["content"]
    assert [r["timestamp"] for r in m[:3]] == [1941239045.25, 777.0, 1.0] and m[3]["timestamp"] > 1.6e9  # none in the record: now
    (call,) = read("tool_calls").collect()
    assert (call["name"], call["result_text"], call["message_uuid"], call["timestamp"], call["is_error"]) == ("Sound", "eleven\nmetres", "call", 777.0, True)
    (a,) = live.session_attributes(spark, store).collect()
    assert (a["cwd"], a["git_branch"], a["agent_version"]) == ("/shed", "spring", "9.9")
    # a batch that runs again writes what it wrote before
    live.take_in(spark.read.schema(live.SEGMENT).json(seg).where("line_no >= 3"), 1, store)
    assert read("messages").count() == 4 and read("tool_calls").count() == 1


def test_live_pairing(spark):
    """Of several uses before a result the last counts; a result without a waiting use stands alone; a use waits on."""
    use = lambda n: record("assistant", n, [{"type": "tool_use", "id": "p", "name": n, "input": {}}])
    result = lambda n: record("user", n, [{"type": "tool_result", "tool_use_id": "p", "content": n}])
    records = parse_lines(lines_of(spark, [result("r0"), use("A"), use("B"), result("r1"), result("r2"), use("C")]))
    waiting = spark.createDataFrame([("well", "p", "old", "Old", "{}", 5.0), ("well", "z", "zzz", "Z", "{}", 6.0)], live.PENDING)
    got = {(r["tool_use_id"], r["round"]): (r["use"] and r["use"]["name"], r["result"] and r["result"]["uuid"]) for r in live.rounds(live.live_blocks(records), waiting).collect()}
    assert got == {("p", 0): ("Old", "r0"), ("p", 1): ("B", "r1"), ("p", 2): (None, "r2"), ("p", 3): ("C", None), ("z", 0): ("Z", None)}


def test_files(spark, log, tmp_path):
    assert {r["session_id"] for r in read_logs(spark, log).collect()} == {"well"}
    # a log in many splits has the same numbers
    long = tmp_path / "long.jsonl"
    long.write_text("".join(f"line {k}\n" if k % 7 else "\n" for k in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = read_logs(spark, str(long))
        assert rows.select("line_no", "line").distinct().count() == rows.count() == 1714 and rows.where("line != concat('line ', line_no)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert find_log(spark, str(tmp_path / "logs"), "well").endswith("/project/well.jsonl") and find_log(spark, str(tmp_path / "logs"), "pond") is None
    assert [r["lines"] for r in metrics.line_counts(spark, log).collect()] == [9]
    size = metrics.file_bytes(spark, str(tmp_path / "logs")).first()
    assert (size["bytes"], size["files"]) == (len(open(log, "rb").read()), 1)
    repeats = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 9.0), ("b", 1.0), ("b", 2.0)], "op string, s double")
    assert {r["op"]: r["median"] for r in metrics.median_of_repeats(repeats, "s", "op").collect()} == {"a": 3.0, "b": 1.5}


def test_command_line(spark, log, tmp_path, capsys):
    store = str(tmp_path / "cli")
    assert cli.main(["convert", log, "x.jsonl", "-o", store, "--session-id", "one"]) == 2
    assert cli.main(["convert", log, "-o", store]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["messages"] == 4
    assert cli.main(["inspect", store]) == 0
    assert json.loads(capsys.readouterr().out)["session_id"] == "well"
    assert cli.main(["tail", store, "well", "-n", "1"]) == 0
    assert capsys.readouterr().out == "[assistant] Eleven metres.\n"
    assert cli.main(["export", store, str(tmp_path / "out"), "--session-id", "well"]) == 0 and spark.read.text(str(tmp_path / "out")).count() == 4
    with pytest.raises(SystemExit):
        cli.main(["convert"])
