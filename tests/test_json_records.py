"""First differences of nested records and open label rows, against slow versions."""

import json
import random

from pyspark.sql import functions as F

from obsline.operators import verify as C
from obsline.sources import tables as S


def slow_difference(a, b, path="$"):
    if type(a) is not type(b):
        return path, a, b
    if isinstance(a, dict):
        for key in sorted({*a, *b}):
            if key not in a or key not in b:
                return f"{path}.{key}", a.get(key), b.get(key)
            if found := slow_difference(a[key], b[key], f"{path}.{key}"):
                return found
        return None
    if isinstance(a, list):
        for i in range(max(len(a), len(b))):
            if i >= len(a) or i >= len(b):
                return f"{path}[{i}]", a[i] if i < len(a) else None, b[i] if i < len(b) else None
            if found := slow_difference(a[i], b[i], f"{path}[{i}]"):
                return found
        return None
    return (path, a, b) if a != b else None


def made(rng, depth=0):
    kind = rng.choice(["dict", "list", "scalar", "scalar"]) if depth < 4 else "scalar"
    if kind == "dict":
        return {rng.choice("abcXé"): made(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if kind == "list":
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 12 if depth == 1 else 3))]
    return rng.choice([None, True, False, 0, 1, -7, 0.5, 2.25, "x", "", "é", "1"])


def changed(rng, value):
    if rng.random() < 0.15:
        return made(rng, 3)
    if isinstance(value, dict):
        return {k: changed(rng, v) for k, v in value.items() if rng.random() > 0.05}
    if isinstance(value, list):
        return [changed(rng, v) for v in value] + ([made(rng, 3)] if rng.random() < 0.1 else [])
    return value


def test_first_difference_of_nested_records(spark):
    rng = random.Random(5)
    pairs = [(made(rng), None) for _ in range(300)]
    pairs = [(a, changed(rng, a)) for a, _ in pairs] + [({"k": 1}, {"k": 1.5}), ({"k": None}, {}), ([1] * 11 + [2], [1] * 11 + [3]), ({}, []), ({"b": 1, "a": {"z": 1}}, {"b": 2, "a": {"z": 2}})]
    e, a = (spark.createDataFrame([(i, json.dumps(p[side])) for i, p in enumerate(pairs)], "i long, record string") for side in (0, 1))
    got = {r.i: (r.path, r.expected, r.actual, r.expected_kind, r.actual_kind) for r in C.first_json_difference(e, a, ["i"]).collect()}
    want = {i: d for i, p in enumerate(pairs) if (d := slow_difference(*p))}
    assert {i: g[0] for i, g in got.items()} == {i: d[0] for i, d in want.items()} and len(want) > 80
    for i, (_, x, y) in want.items():
        for text, kind, value in ((got[i][1], got[i][3], x), (got[i][2], got[i][4], y)):
            assert (json.loads(text) if text is not None else None) == value and (kind is None) <= (value is None)
    assert got[301][3:] == ("null", None)


def test_records_that_are_missing_or_malformed(spark):
    kind = "i long, record string, path string"
    e = spark.createDataFrame([(1, '{"a": 1}', ""), (2, "{", ""), (3, None, ""), (4, '{"a": {"board_path": 1, "x": 2}}', "")], kind)
    a = spark.createDataFrame([(2, "{", ""), (3, "null", ""), (4, '{"a": {"x": 2}}', "")], kind)
    got = {r.i: (r.path, r.expected_kind, r.actual_kind) for r in C.first_json_difference(e, a, ["i"], local=("board_path",)).collect()}
    assert got == {1: ("$", "object", None), 3: ("$", None, "null")}
    assert C.first_json_difference(e.limit(0), a.limit(0), ["i"]).collect() == []


def test_only_records_that_may_differ_are_walked(spark, monkeypatch):
    pairs = [('{"p":"1","a":%d}' % i, '{"p":"2","a":%d}' % i) for i in range(40)]
    pairs += [('{"a":"\\"p\\":\\"1\\""}', '{"a":"\\"p\\":\\"2\\""}'), ('{"a":["p","1"]}', '{"a":["p","2"]}'), ('{"a":"p","b":"1"}', '{"a":"p","b":"2"}'), ('{"p":"1"', '{"p":"2"'),
              ('{"p":"1"}', '{"p":"1","p":"1"}'), ('{"p": "1", "a": 1}', '{"a":1,"p":"2"}'), ('{"p":{"x":1},"a":[1]}', '{"a":[1]}'), ('{"q":{"p":"x"}}', '{"q":{}}'), ('{"a":1}', '{"a":1.5}')]
    walked, walk = [], C.json_nodes
    monkeypatch.setattr(C, "json_nodes", lambda df, *rest: walked.append(df.count()) or walk(df, *rest))
    e, a = (spark.createDataFrame([(i, p[side]) for i, p in enumerate(pairs)], "i long, record string") for side in (0, 1))
    got = {r.i: r.path for r in C.first_json_difference(e, a, ["i"], local=("p",)).collect()}
    assert got == {40: "$.a", 41: "$.a[1]", 42: "$.b", 43: "$", 44: "$", 48: "$.a"}
    assert sum(walked) == 2 * 9


def test_label_rows_keep_numbers_of_any_name(spark, tmp_path):
    rows = [{"detector": "d", "truth": "yes", "prediction": "no", "score": 1.5, "pair_score": 2, "new one": 0.25, "flag": True, "text": "7", "deep": {"x": 3}, "list": [1]},
            {"detector": "d", "truth": "yes"}, {"detector": "d", "truth": "yes", "prediction": "no"}]
    path = tmp_path / "labels.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n\n")
    got = sorted(S.read_labels(spark, str(path)).select("detector", "score", "measures", F.try_variant_get("record", "$.deep.x", "int").alias("x")).collect(), key=lambda r: r.score or 0)
    assert [tuple(r) for r in got] == [("d", None, {}, None), ("d", 1.5, {"pair_score": 2.0, "new one": 0.25}, 3)]
