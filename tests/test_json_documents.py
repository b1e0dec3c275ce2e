"""JSON documents against the json module, on files cut into small blocks."""

import json
import random

import pytest

from tabscope.sources import json_documents as J


def written(tmp_path, data, name="d.json", **style):
    (tmp_path / name).write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False, **style), encoding="utf-8")
    return str(tmp_path / name)


@pytest.fixture()
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def grid(df):
    return [list(r["cells"]) for r in df.orderBy("row_number").collect()]


def test_object_with_lists(spark, tmp_path):
    tables = J.json_document(spark, written(tmp_path, {"a": [[1, 2], [3, "x,]"]], "b": [{"k": 1, "n": {"m": "q\"}{"}}, {"k": 2}], "c": {"x": [1, {"y": 2}]}, "d": [], "e": [1, 2]}))
    assert set(tables) == {"a", "b"} and grid(tables["a"]) == [["1", "2"], ["3", "x,]"]]
    assert sorted((r["k"], r["n.m"]) for r in tables["b"].collect()) == [(1, 'q"}{'), (2, None)]


def test_lists(spark, tmp_path):
    assert grid(J.json_document(spark, written(tmp_path, [["h", "i"], [], [None, "\\"]], "g.json"))[None]) == [["h", "i"], [], [None, "\\"]]
    mixed = J.json_document(spark, written(tmp_path, [{"a": 1}, 5, "t,["], "m.json", indent=2))[None]
    assert sorted((r["a"] or 0, r["value"] or "") for r in mixed.collect()) == [(0, "5"), (0, "t,["), (1, "")]


def test_objects_without_tables(spark, tmp_path):
    one = J.json_document(spark, written(tmp_path, {"a": 1, "b": "x, {y"}))[None].first()
    assert (one["a"], one["b"]) == (1, "x, {y")
    pairs = J.json_document(spark, written(tmp_path, {"a": {"x": 1, "y": [2, 3]}, "b": "t", "c": [1, 2, 3], "ключ": None}, "p.json", indent=1))[None]
    got = {r["key"]: r["value"] for r in pairs.collect()}
    assert json.loads(got["a"]) == {"x": 1, "y": [2, 3]} and json.loads(got["c"]) == [1, 2, 3] and got["b"] == "t" and set(got) == {"a", "b", "c", "ключ"}


@pytest.mark.parametrize("indent", [None, 1])
def test_elements_of_split_files(spark, tmp_path, small_blocks, indent):
    rng = random.Random(7)
    odd = ['"', "\\", ",", "{", "}", "[", "]", "\n", "é", "a", ":"]

    def value(depth):
        pick = rng.randrange(4 if depth else 2)
        if pick == 0:
            return rng.randrange(1000)
        if pick == 1:
            return "".join(rng.choices(odd, k=rng.randrange(12)))
        return [value(depth - 1) for _ in range(rng.randrange(4))] if pick == 2 else {f"k{i},": value(depth - 1) for i in range(rng.randrange(4))}

    data = {"".join(rng.choices(odd, k=5)) + str(m): [value(3) for _ in range(60)] for m in range(3)}
    path = written(tmp_path, data, indent=indent)
    rows = J.json_elements(spark, path).orderBy("member", "element").collect()
    assert spark.read.text(path).rdd.getNumPartitions() > 3
    got = {}
    for r in rows:
        got.setdefault(r["name"], []).append(json.loads(r["text"]))
    assert got == data


def test_broken_and_empty(spark, tmp_path):
    marked = J.json_document(spark, written(tmp_path, '\ufeff[["a"]]', "m.json"))
    assert grid(marked[None]) == [["a"]]
    assert J.json_document(spark, written(tmp_path, " \n")) == {} and J.json_document(spark, written(tmp_path, "[]", "e.json")) == {}
    with pytest.raises(Exception, match="close"):
        J.json_elements(spark, written(tmp_path, '{"a": [{"b": 1}, {"c": 2', "x.json")).collect()


def test_facts_of_a_long_member_are_spread_over_its_lines(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 10)
    rows = spark.createDataFrame([("f", i // 95, i) for i in range(100)] + [("g", 0, 3)], "source string, member bigint, from bigint")
    facts = spark.createDataFrame([("f", 0, "x"), ("f", 1, "y"), ("g", 0, "z")], "source string, member bigint, name string")
    got = J._with_facts(rows, facts, ["source", "member"])
    assert sorted((r["source"], r["member"], r["from"], r["name"]) for r in got.collect()) == [("f", i // 95, i, "xy"[i // 95]) for i in range(100)] + [("g", 0, 3, "z")]
    assert "_b" in got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1].split("\n")[0]
