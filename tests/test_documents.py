"""Leaves of nested documents against a walk in Python, and the run outputs among them."""

import json

import pytest
from pyspark.sql import functions as F

from freshet.operators import documents

DOCS = {
    "a": {"key_outputs": {"q": 1.5, "_x": 3, "n": {"m": 2, "l": [1, {"z": "s"}], "e": {}}, "_uncertainty": {"half": 0.25}}, "t": True, "u": None, "s": "é\n"},
    "b": [1, [2, [], [3, {"deep": {"er": {"x": {"y": [[["end"]]]}}}}]]],
    "c": 5,
    "d": "text",
    "e": {},
    "f": {"evidence": {"data": {"q": 7, "r": 8}, "uncertainty": {"lo": 1e-3}}, "key_outputs": {"q": 9, "a": {"b": {"c": {"d": 1, "e": {"f": 2}}}}}, "inputs": {"flag": False, "n": 4}},
}


def walk(node, path=()):
    if isinstance(node, dict):
        for k, v in node.items():
            yield from walk(v, (*path, k))
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from walk(v, (*path, i))
    else:
        kind = "null" if node is None else "boolean" if isinstance(node, bool) else "string" if isinstance(node, str) else "number"
        yield ".".join(map(str, path)), len(path), any(isinstance(p, int) for p in path), kind, float(node) if kind == "number" else None, node if kind == "string" else None


@pytest.fixture(scope="module")
def leaves(spark):
    rows = [(k, json.dumps(v)) for k, v in DOCS.items()] + [("x", "{nope"), ("y", None), ("c", "5")]
    return documents.json_leaves(spark.createDataFrame(rows, "run_id string, doc string"), ["run_id"], "doc")


def test_leaves_are_a_walk(leaves):
    got = sorted((r.run_id, r.path, r.depth, r.in_list, r.kind, r.number, r.text if r.kind == "string" else None) for r in leaves.collect())
    want = sorted((k, *x) for k, v in [*DOCS.items(), ("c", 5)] for x in walk(v))
    assert got == want


def test_depth_is_limited(spark):
    df = spark.createDataFrame([("b", json.dumps(DOCS["b"]))], "run_id string, doc string")
    assert sorted(r.path for r in documents.json_leaves(df, ["run_id"], "doc", most_depth=2).collect()) == ["0", "1.0"]


def test_empty_table(spark):
    assert documents.json_leaves(spark.createDataFrame([], "run_id string, doc string"), ["run_id"], "doc").collect() == []


def test_run_outputs(leaves):
    got = {(r.run_id, r.path): r.value for r in documents.run_outputs(leaves).collect()}
    assert got == {
        ("a", "key_outputs.q"): 1.5, ("a", "key_outputs.n.m"): 2.0, ("a", "key_outputs._uncertainty.half"): 0.25,
        ("f", "key_outputs.q"): 9.0, ("f", "key_outputs.r"): 8.0, ("f", "key_outputs.a.b.c.d"): 1.0, ("f", "evidence.uncertainty.lo"): 1e-3, ("f", "inputs.n"): 4.0,
    }
    assert [r.path for r in documents.run_outputs(leaves, most=2).where("run_id = 'f'").orderBy("path").collect()] == ["key_outputs.a.b.c.d", "key_outputs.q"]


def test_values_at_paths(spark, leaves):
    asked = spark.createDataFrame([("a", "key_outputs.n.l.1.z"), ("a", "t"), ("b", "1.2.0"), ("b", "1.9"), ("zz", "t")], "run_id string, path string")
    got = {(r.run_id, r.path): (r.kind, r.number, r.text) for r in documents.values_at(asked, leaves, ["run_id"]).collect()}
    assert got["a", "key_outputs.n.l.1.z"] == ("string", None, "s") and got["a", "t"] == ("boolean", None, "true")
    assert got["b", "1.2.0"][:2] == ("number", 3.0) and got["b", "1.9"] == got["zz", "t"] == (None, None, None)
    row = spark.createDataFrame([(json.dumps(DOCS["a"]),)], "doc string").select(documents.json_value(F.col("doc"), "key_outputs.n.l.1.z"), documents.json_value(F.col("doc"), "key_outputs.n.l.0", "double"), documents.json_value(F.col("doc"), "nowhere.0")).first()
    assert tuple(row) == ("s", 1.0, None)


def test_many_levels_in_few_rounds(spark, monkeypatch):
    """Thirteen levels take three rounds, with what ends at each level, and lists left out where nobody reads them."""
    rounds, before = [], documents.written
    monkeypatch.setattr(documents, "written", lambda df, name: (rounds.append(name), before(df, name))[1])
    deep = "1"
    for i in range(10):
        deep = json.dumps({"a": json.loads(deep), f"b{i}": i, "c": [i, {"d": None}], "e": {}, "f": []})
    df = spark.createDataFrame([("x", deep), ("y", "7"), ("z", "{}"), ("n", None)], "run_id string, doc string")
    got = {(r.run_id, r.path): (r.depth, r.in_list, r.kind, r.text) for r in documents.json_leaves(df, ["run_id"], "doc").collect()}
    assert len(rounds) == 3
    want = {("y", ""): (0, False, "number", "7"), ("x", ".".join("a" * 10)): (10, False, "number", "1")}
    for i in range(10):
        at = "a." * (9 - i)
        want |= {("x", f"{at}b{i}"): (10 - i, False, "number", str(i)), ("x", f"{at}c.0"): (11 - i, True, "number", str(i)), ("x", f"{at}c.1.d"): (12 - i, True, "null", None)}
    assert got == want
    flat = documents.json_leaves(df, ["run_id"], "doc", lists=False).collect()
    assert {(r.run_id, r.path) for r in flat} == {k for k, v in want.items() if not v[1]}
    assert {(r.run_id, r.path) for r in documents.json_leaves(df, ["run_id"], "doc", most_depth=7).collect()} == {k for k, v in want.items() if v[0] <= 7}
