"""Chunks of long recordings against the streaming fold; schemas and secrets in nested rows."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from talefold.operators import chunking as C
from talefold.operators import long_chunks as L
from talefold.operators import schemas as S
from talefold.operators import titles
from talefold.plans import registry

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("gap", [0, 1])
def test_long_size_chunks_equal_the_fold(spark, gap):
    """Recordings of one row to thousands, rows without a size, rows over the target, indices with gaps."""
    rng = random.Random(gap)
    rows = []
    for rec, n in enumerate([1, 2, 3, 40, 700, 3000]):
        at = 0
        for _ in range(n):
            at += rng.choice([1, 1, 5])
            rows.append((rec, at, rng.choice([0, 0, 3, 20, 60, 250 if rec != 4 else 20])))
    rows += [(9, i, 0) for i in range(50)] + [(10, i, i // 30) for i in range(60)]
    table = spark.createDataFrame(rows, "recording_id long, seg_idx int, size int")
    want = rows_of(C.fold(table, C.size_rule(200, gap), ["size"]), "recording_id", "seg_idx", "chunk_no")
    assert rows_of(L.size_chunks(table, 200, gap), "recording_id", "seg_idx", "chunk_no") == want
    assert L.size_chunks(table.limit(0), 200, gap).collect() == []


def test_long_correction_chunks_equal_the_fold(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 16)
    rng, rows = random.Random(5), []
    for rec, n in enumerate([1, 5, 900]):
        for i in range(n):
            begin = 2400 * i + rng.randint(0, 9000)
            rows.append((rec, i, begin, begin + rng.choice([100, 1800, 50_000]), "x" * rng.choice([0, 10, 80, 700])))
    table = spark.createDataFrame(rows, "recording_id long, seg_idx int, start_ms long, end_ms long, text string")
    for rule in ((500, 40_000, 9), (10**6, 10**9, 35), (10**6, 10**9, 16), (300, 10**9, 1)):
        assert rows_of(L.correction_chunks(table, *rule), "recording_id", "seg_idx", "chunk_no") == rows_of(C.correction_chunks(table, *rule), "recording_id", "seg_idx", "chunk_no")


def test_joined_numbers_through(spark):
    table = spark.createDataFrame([(r, i, f"{r}-{i}") for r in range(7) for i in range(r)], "recording_id long, seg_idx int, text string")
    got = rows_of(L.joined(table, F.col("recording_id") % 2), "recording_id", "seg_idx", "text")
    assert got == [(k, n, f"{r}-{i}") for k in (0, 1) for n, (r, i) in enumerate((r, i) for r in range(k, 7, 2) for i in range(r))]


ITEM = {"type": "object", "required": ["text", "ids"], "properties": {"text": {"type": "string", "minLength": 1}, "ids": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "integer", "minimum": 0}}}, "additionalProperties": False}
SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "required": ["version", "topics"],
    "properties": {
        "version": {"const": "v1"},
        "hash": {"type": "string", "pattern": "^[0-9a-f]{4}$", "maxLength": 4},
        "kind": {"enum": ["a", 2, True, None]},
        "n": {"type": ["integer", "null"], "minimum": 0, "exclusiveMaximum": 10},
        "topics": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "#/$defs/item"}},
        "by name": {"type": "object", "additionalProperties": {"type": "number"}, "maxProperties": 2},
        "either": {"anyOf": [{"type": "string"}, {"type": "array", "items": {"const": 1}}]},
        "nothing": False,
    },
    "additionalProperties": False,
    "$defs": {"item": ITEM},
}
DOCUMENTS = [
    ('{"version":"v1","topics":[{"text":"x","ids":[1,2]}]}', []),
    ('{"version":"v2","topics":[]}', ["$.topics: minItems", "$.version: const"]),
    ('{"version":"v1","topics":[{"text":"","ids":[1,1,-2],"more":1},{"ids":[]},5]}', ["$.topics[0].ids: uniqueItems", "$.topics[0].ids[2]: minimum", "$.topics[0].text: minLength", "$.topics[0]: additionalProperties more", "$.topics[1].ids: minItems", "$.topics[1]: required text", "$.topics[2]: type"]),
    ('{"version":"v1","topics":[{"text":"x","ids":[1.0,2.5]}],"hash":"zzzzz","kind":"c","n":10}', ["$.hash: maxLength", "$.hash: pattern", "$.kind: enum", "$.n: exclusiveMaximum", "$.topics[0].ids[1]: type"]),
    ('{"version":"v1","topics":[{"text":"x","ids":[1]}],"kind":null,"n":null,"by name":{"a":1,"b":2.5}}', []),
    ('{"version":"v1","topics":[{"text":"x","ids":[1]}],"kind":true,"by name":{"a":"1","b":2,"c":3},"either":[1,2]}', ["$.by name.a: type", "$.by name: maxProperties", "$.either: anyOf"]),
    ('{"version":"v1","topics":[{"text":"x","ids":[1]}],"either":"s","nothing":1,"z":0}', ["$.nothing: false", "$: additionalProperties z"]),
    ("[1]", ["$: type"]),
    ('"version":1', ["$: json"]),
    ("{} {}", ["$: json"]),
    ("", ["$: json"]),
    (None, ["$: json"]),
]


def test_schema_findings(spark):
    table = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DOCUMENTS)], "k int, told string")
    assert {r.k: r.findings for r in S.schema_findings(table, "k", "told", SCHEMA).collect()} == {i: w for i, (_, w) in enumerate(DOCUMENTS)}
    parsed = table.select("k", F.try_parse_json("told").alias("told")).where("k < 8")
    assert {r.k: r.findings for r in S.schema_findings(parsed, "k", "told", SCHEMA).collect()} == {i: w for i, (_, w) in enumerate(DOCUMENTS[:8])}


@pytest.mark.parametrize("schema", [{"oneOf": []}, {"$ref": "other.json"}, {"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}}])
def test_schemas_that_are_not_followed(spark, schema):
    with pytest.raises(ValueError, match=r"keywords|references"):
        S.schema_findings(spark.createDataFrame([(1, "{}")], "k int, told string"), "k", "told", schema)


def test_no_secret_is_left_at_any_depth(spark):
    schema = "id int, s string, a array<string>, m map<string,string>, deep array<struct<p:string,q:array<struct<r:string,n:int>>>>, z struct<u:string>, mm map<string,array<struct<w:string>>>, n array<int>"
    row = (1, "a SECRET", ["SECRET", None], {"SECRET": "x SECRET"}, [("SECRET", [("y SECRET", 3)])], None, {"k": [("SECRETSECRET",)]}, [1])
    table = spark.createDataFrame([row, (2, *[None] * 7)], schema).withColumn("v", F.parse_json(F.lit('{"a":["SECRET",1,{"b":"q\\"x"}]}')))
    out = S.without_secrets(table, ["SECRET", 'q"x'], "#")
    assert [(n, k) for n, k in out.dtypes] == [(n, k) for n, k in table.dtypes]
    first, second = (json.loads(r[0]) for r in out.orderBy("id").select(F.to_json(F.struct("*"))).collect())
    assert first == {"id": 1, "s": "a #", "a": ["#", None], "m": {"SECRET": "x #"}, "deep": [{"p": "#", "q": [{"r": "y #", "n": 3}]}], "mm": {"k": [{"w": "##"}]}, "n": [1], "v": {"a": ["#", 1, {"b": "#"}]}}
    assert second == {"id": 2, "v": {"a": ["#", 1, {"b": "#"}]}}


def test_titles_meet_once_and_in_slices(spark):
    rng = random.Random(8)
    letters = [chr(c) for c in range(0xAC00, 0xAC00 + 300)]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(8, 40)))) for i in range(200)]
    rows += [(1000 + i, t[:-2] + "xy" if i % 2 else t + "z") for i, t in rows[:60]]
    table = spark.createDataFrame(rows, "id long, title string")
    whole = rows_of(titles.similar_titles(table), "a", "b")
    assert len(whole) >= 60 and rows_of(titles.similar_titles(table, rows=16), "a", "b") == whole
    told = titles.candidates(table).first()
    assert told.alike <= told.near <= told.looked < 0.2 * len(list(itertools.combinations(rows, 2)))


def test_grams_of_titles_are_not_broadcast(spark):
    """Spark takes exploded grams for as small as their titles; broadcast, they fill the driver."""
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 30)))) for i in range(400)]
    rows += [(1000 + i, f"xy{rows[rng.randrange(400)][1]}z") for i in range(100)] + [(2000 + i, t) for i, t in enumerate(("a", "회의", "회의 abc", "budget x", "budget", "1234567", "12345678", "123456789", ""))]
    spark.conf.set("spark.sql.maxBroadcastTableSize", "200k")
    try:
        got = rows_of(titles.contained_titles(spark.createDataFrame(rows, "id long, title string")), "a", "b")
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    first = {}
    for i, t in rows:
        key = t.replace(" ", "")
        if key:
            first.setdefault(key, i)
    assert got == sorted((min(a, b), max(a, b)) for (x, a), (y, b) in itertools.permutations(first.items(), 2) if x in y)
    assert len(got) > 200


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")
@pytest.mark.parametrize("name", ["title_disambiguation", "title_groups", "title_labels", "similar_titles"])
def test_title_queries_broadcast_no_grams(spark, name):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "8m")
    try:
        assert registry.queries()[name](spark, LARGER).count() > 0
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_reuse_verdicts_build_chunks_once(spark):
    """Four tables are made of the hashes; what they read is written once."""
    frame = registry.queries()["reuse_verdicts"](spark, DATA)
    assert not [x for x in frame.inputFiles() if "documents" in x] and frame.count() > 0


def test_titles_are_copied_in_bounds(spark):
    """A title is in as many units of a pair of levels as there are slices, whatever number of frequent characters it has."""
    rng = random.Random(10)
    rows = [(i, "".join(rng.choice("abcdefghij") for _ in range(20))) for i in range(300)]
    dealt = titles._dealt(titles.representatives(spark.createDataFrame(rows, "id long, title string")), titles.RATIO, 4)
    most = dealt.where("c IS NULL").groupBy("low", "high", "id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert most == titles.SLICES
