import json
from datetime import date

import pytest

from marginalia.sources import catalog, jsonl, search
from marginalia.streaming import ledger


def test_repair_and_tail(tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_bytes(b'{"a":1}\n{"a":2}\n{"a":3,"b')
    assert jsonl.repair(str(f)) == 9 and f.read_bytes() == b'{"a":1}\n{"a":2}\n'
    assert jsonl.repair(str(f)) == 0
    f.write_text("".join(json.dumps({"k": k}) + "\n" for k in "AABC"))
    assert jsonl.drop_tail(str(f), lambda r: r["k"] not in "AC") == 0
    assert jsonl.drop_tail(str(f), lambda r: r["k"] not in "A") == 2
    assert [r["k"] for r in jsonl.iter_lines(str(f))] == ["A", "A"]
    (tmp_path / "empty").write_bytes(b"")
    assert jsonl.repair(str(tmp_path / "empty")) == 0


def test_shards(tmp_path):
    assert jsonl.shard_name("x.jsonl", 3, 100) == "x.03.jsonl"
    for k in (0, 1, 3):
        (tmp_path / jsonl.shard_name("x.jsonl", k, 4)).write_text(f'{{"k":{k}}}\n')
    assert jsonl.missing_shards(str(tmp_path), "x.jsonl", 4) == [2]
    assert jsonl.merge_shards(str(tmp_path), "x.jsonl", delete=True) == 3
    assert [r["k"] for r in jsonl.iter_lines(str(tmp_path / "x.jsonl"))] == [0, 1, 3]


def test_round_trip_and_rewrite(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    jsonl.write_records(df, path)
    assert sorted(map(tuple, jsonl.read_lines(spark, path, df.schema).collect())) == [(1, None), (2, "x")]
    jsonl.rewrite(spark, path, df.schema, lambda d: d.where("a > 1"))
    assert jsonl.read_lines(spark, path, df.schema).count() == 1


def test_catalog(tmp_path):
    with pytest.raises(FileNotFoundError):
        catalog.resolve(tmp_path)
    a = catalog.resolve(tmp_path, "2024-01-02T03-04-05", make=True)
    (tmp_path / "zzz").mkdir()
    assert catalog.latest(tmp_path).name == "zzz" and catalog.resolve(tmp_path, a.name) == a
    catalog.write_manifest(a, "m.json", n=1)
    assert catalog.read_manifest(a, "m.json") == {"n": 1}
    with pytest.raises(ValueError):
        catalog.require_same({"n": 1}, n=2)


def test_slices_cover_everything_once():
    stars = [s for s in range(200) for _ in range(30)]
    count = lambda s: sum(s.low <= x and (s.high is None or x <= s.high) for x in stars)
    got = search.plan(search.Slice("python", 0, None, date(2020, 1, 1)), count, lambda: 199, date(2024, 1, 1))
    assert sum(map(count, got)) == len(stars) and all(count(s) <= 1000 for s in got)


def test_unsplittable_point_warns():
    said = []
    got = search.plan(search.Slice("python", 5, 5, date(2024, 1, 1), date(2024, 1, 1)), lambda s: 5000, lambda: 5, date(2024, 1, 1), said.append)
    assert len(got) == 1 and said


def test_retries_rotate_tokens():
    seen = []

    def call(token):
        seen.append(token)
        return (403, {}, None) if len(seen) < 3 else (200, {}, "ok")

    assert search.with_retries(call, ["a", "b"], wait=lambda s: None)[1] == "ok" and seen[:2] == ["a", "b"]


def test_search_source(spark):
    df = search.search(spark, "marginalia.sources.search:offline", [(1, 2), (3, 4)])
    assert df.columns[0] == "id" and df.count() == 0


def test_completions(spark):
    def client():
        def ask(model, prompt):
            if prompt == "boom":
                raise ValueError("no")
            return "```\n# hi\n```" if prompt else ""

        return ask

    df = spark.createDataFrame([(1, "m", "p"), (2, "m", "boom"), (3, "m", "")], "k int, model string, prompt string")
    got = {r.k: (r.comment_text, r.error) for r in search.complete(df, client).collect()}
    assert got == {1: ("# hi", None), 2: (None, "ValueError: no"), 3: (None, "Model returned an empty comment")}


def test_ledger_stream_is_done_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"id":1,"v":1}\n{"id":2,"v":1}\n')
    run = lambda: ledger.process_once(ledger.read_stream(spark, str(src), "id int, v int"), lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    run()
    (src / "2.json").write_text('{"id":1,"v":2}\n')
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_latest_stream(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    (src / "1.json").write_text('{"id":1,"pos":0,"v":"a"}\n{"id":1,"pos":2,"v":"c"}\n{"id":2,"pos":1,"v":"b"}\n')
    s = ledger.latest_rows(ledger.read_stream(spark, str(src), "id int, pos int, v string"), "id", "pos")
    q = s.writeStream.outputMode("complete").format("memory").queryName("latest_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id: r.v for r in spark.table("latest_rows").collect()} == {1: "c", 2: "b"}
