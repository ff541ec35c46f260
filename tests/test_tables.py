"""JSON arrays as tables and back."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import tables as T

ARRAYS = [
    [{"id": 1, "name": "a", "at": {"x": 1, "y": 2.5}}, {"id": 2, "name": "b\n\"q\", {c}", "at": {"x": None, "y": 0}}],
    [{"a": 1}, {"a": None}, {}, {"b": [1, {"c": 2}], "a": "x"}, {"a": True}],
    [{}, {}],
    [{"a.b": 1, "a": {"b": 2}, "": 3, "é ü": "漢", '"': "'", "x-y_1": [], "{": "}"}, {"a.b": 0, "a": {"b": 5}}],
    [{"type": "user", "u": 1, "v": 2}, {"type": "order", "o": 1, "p": 2}, {"type": "user", "u": 3, "v": 1}, {"type": "order", "o": 9, "p": None}, {"type": "user", "u": 5, "v": 1}],
    [{"at": {"x": 1}}, {"at": {"x": 1, "y": 2}}],
    [{"at": {}}, {"at": {}}],
    [{"at": {k: 1 for k in "abcdefg"}}],
    [{"s": "[1]{a:int}", "t": "!0 1", "u": "@3 "}, {"s": "1,2", "t": None}],
    [{"big": 12345678901234567890, "f": 1e300, "n": -0.5, "d": 1.10}],
    [1, {"a": 1}],
    [],
]


def made(seed):
    rng = random.Random(seed)
    names = ["a", "b", "kind", "x y", "n.m", "q"]
    value = lambda d: rng.choice([None, True, rng.randrange(9), rng.random(), "t" * rng.randrange(4), "x,y", {k: value(d - 1) for k in names[: rng.randrange(3)]} if d else 0, [value(d - 1)] * rng.randrange(3) if d else 1])
    return [{**({"kind": rng.choice(["u", "o", "p"])} if seed % 2 else {}), **{n: value(2) for n in names if n != "kind" and rng.random() < 0.5}} for _ in range(20)]


EVERY = ARRAYS + [made(s) for s in range(12)]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(k, p, json.dumps(x), "b", 1) for k, own in enumerate(EVERY) for p, x in enumerate(own)] + [(99, 0, None, "b", 1)]
    return spark.createDataFrame(rows, "key long, pos long, json string, bucket string, rows int").repartition(3).withColumn("item", F.try_parse_json("json")).cache()


def canonical(df):
    return {(r.key, r.pos): r.j for r in df.select("key", "pos", F.to_json("item").alias("j")).collect()}


def test_restore(items):
    found = T.tables(items).cache()
    texts = T.csv_schema(found).cache()
    want = {k: v for k, v in canonical(items).items() if k[0] not in (10, 99)}
    assert canonical(T.restored(texts)) == want
    text = {r.key: r.text for r in texts.collect()}
    assert text[0].split("\n")[0] == "[2]{at.x?:int,at.y:float,id:int,name:string}" or text[0].startswith("[2]{at.x?:int,at.y:")
    assert text[1].split("\n") == ["[5]{a?:json,b?:array}", "!1 1", "!1 null", "!0.1 ", '"x",[1,{"c":2}]', "!1 true"]
    assert text[2] == "[2]{}\n\n"
    assert text[4].split("\n") == ['[2]{o:int,p?:int,type:string}type="order"', '@1 1,2,"order"', '@3 9,null,"order"', '[3]{type:string,u:int,v:int}type="user"', '@0 "user",1,2', '@2 "user",3,1', '@4 "user",5,1']
    assert text[5].startswith("[2]{at:object}") and text[7].startswith("[1]{at:object}")
    assert len(json.loads(T.json_tables(found).where("key = 4").first().json)) == 2
    assert T.markdown_records(items).where("key = 0").first().text.split("\n")[:2] == ["2 records", ""]


def test_one_exchange(items):
    """Tables are made on one exchange by key."""
    plan = T.csv_schema(T.tables(items))._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"Exchange (hashpartitioning\(.*?\)), ENSURE", plan))) == 1
    nulls = items.select(F.lit(None).cast("long").alias("key"), "pos", "item")
    assert T.tables(nulls).count() == 0


def test_cell_classes(spark):
    strings = ["short", '{"a": 1}', " [1]", "[not json", "QUJD" * 80, "<p>" * 100, "long words " * 40, "Q" * 256, None]
    rows = [(json.dumps(x), c) for x, c in zip(strings, ["scalar", "text_json", "text_json", "scalar", "base64", "html", "long", "scalar", "scalar"], strict=True)] + [("1", "scalar"), ("[1]", "array"), ("{}", "object")]
    df = spark.createDataFrame(rows, "json string, want string").withColumn("got", T.cell_class(F.parse_json("json")))
    assert [(r.want, r.got) for r in df.collect() if r.want != r.got] == []


def test_walk(spark):
    doc = {"a": [{"b": [1, 2]}, "x"], "c": {"d": [[]], "e f": '{"g": [3]}'}, "h": []}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, "[1]"), (3, "5"), (4, None)], "id long, j string").select("id", F.parse_json("j").alias("value"))
    got = {(r.id, r.at, r.pos): r.j for r in T.inner_arrays(docs).select("id", "at", "pos", F.to_json("item").alias("j")).collect()}
    assert got == {(1, "$.a", 0): '{"b":[1,2]}', (1, "$.a", 1): '"x"', (1, "$.a[0].b", 0): "1", (1, "$.a[0].b", 1): "2", (1, "$.c.d", 0): "[]", (1, '$.c."e f".g', 0): "3", (2, "$", 0): "1"}


def test_nothing(items):
    none = items.where("key = -1")
    assert T.csv_schema(T.tables(none)).count() == 0 and T.restored(T.csv_schema(T.tables(none))).count() == 0 and T.markdown_records(none).count() == 0
