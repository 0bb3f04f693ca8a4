"""Literal vectors and the op-log operators against a plain interpreter."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import digests, layouts, paths, versions
from palimpsest.operators import documents, integrity, mutate, state
from palimpsest.plans import registry

URL = "http://library.wisc.edu/123"
SF = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (layouts.hashed_ntuple, URL, "ed7/558/5a6/ed75585a6e8deef3b3f620e5f6d0999908c09e92cad5e112aa5eac5507000d8b"),
        (lambda c: layouts.hashed_ntuple(c, short_root=True), URL, "ed7/558/5a6/e8deef3b3f620e5f6d0999908c09e92cad5e112aa5eac5507000d8b"),
        (lambda c: layouts.hashed_ntuple(c, algorithm="md5"), URL, "609/ea7/968/609ea7968f37d4d61aa0e0df7458f6b1"),
        (layouts.hashed_id, URL, "ed7/558/5a6/http%3a%2f%2flibrary%2ewisc%2eedu%2f123"),
        (layouts.hashed_id, "..Hor/rib:lè-$id", "373/529/21a/%2e%2eHor%2frib%3al%c3%a8-%24id"),
        (lambda c: layouts.flat_omit_prefix(c, ":"), "urn:uuid:6e8bc430-9c3a-11d9-9669-0800200c9a66", "6e8bc430-9c3a-11d9-9669-0800200c9a66"),
        (lambda c: layouts.ntuple_omit_prefix(c, ":", 4, 2), "namespace:1288729", "0128/8729/1288729"),
        (lambda c: layouts.ntuple_omit_prefix(c, ":", 4, 2, pad_left=False), "namespace:1288729", "1288/7290/1288729"),
        (lambda c: layouts.ntuple_omit_prefix(c, ":", 4, 2, pad_left=False, reverse=True), "namespace:1288729", "9278/8210/1288729"),
        (lambda c: paths.percent_encode(c, keep="a-z"), "€", "%E2%82%ac"),
        (versions.following, "v009", "v010"),
        (versions.following, "v099", None),
        (versions.preceding, "v1", None),
    ],
)
def test_vectors(spark, f, value, want):
    assert one(spark, value, f) == want


def test_digests(spark):
    import hashlib

    row = spark.createDataFrame([(b"abc",)], "x binary").select(*(digests.digest(F.col("x"), a).alias(a) for a in ("blake2b-512", "sha512/256", "size"))).first()
    assert tuple(row) == (hashlib.blake2b(b"abc").hexdigest(), hashlib.new("sha512_256", b"abc").hexdigest(), "3")


def test_change_history(spark):
    rows = [("o", 1, "f1", False, "1"), ("o", 2, "f1", True, None), ("o", 3, "f1", False, "1"), ("o", 4, "f1", False, "1")]
    df = spark.createDataFrame(rows, "object_id string, vnum long, path string, removed boolean, digest string")
    assert [(r.vnum, r.change) for r in state.file_changes(df).orderBy("vnum").collect()] == [(1, "UPDATE"), (2, "REMOVE"), (3, "UPDATE")]


def test_states_against_interpreter(spark):
    rng, rows, want = random.Random(1), [], set()
    for o in range(5):
        now = {}
        for v in range(1, 30):
            path, removed, digest = f"p{rng.randrange(4)}", rng.random() < 0.3, str(rng.randrange(3))
            now = {k: x for k, x in now.items() if k != path} | ({} if removed else {path: digest})
            rows.append((o, v, path, removed, digest))
            want |= {(o, v, *x) for x in now.items()}
    df = spark.createDataFrame(rows, "object_id long, vnum long, path string, removed boolean, digest string")
    assert set(map(tuple, state.version_state(df).collect())) == want
    assert set(map(tuple, state.state_as_of(df, F.lit(7)).collect())) == {(o, p, d) for o, v, p, d in want if v == 7}


def test_mutations(spark):
    s = spark.createDataFrame([("o", "a", "1"), ("o", "b", "2")], "object_id string, path string, digest string")
    moves = spark.createDataFrame([("o", "a", "b"), ("o", "zz", "y")], "object_id string, path string, to string")
    assert set(map(tuple, mutate.rename(s, moves).collect())) == {("o", "b", "1")}
    assert set(map(tuple, mutate.missing(s, moves).collect())) == {("o", "zz")}
    assert mutate.overwrites(s, s.where("path = 'a'")).count() == 1


def test_path_rules(spark):
    got = {p: one(spark, p, lambda c: F.array_join(paths.violations(c, "all"), ",")) for p in ("a/b", "/a", "a//b", "a/../b", "x/CON.txt", "a ", "a?b")}
    assert got == {"a/b": "", "/a": "leading_slash,empty_part", "a//b": "empty_part", "a/../b": "dot_part,space_or_period_at_end", "x/CON.txt": "reserved_name", "a ": "space_or_period_at_end", "a?b": "blocked_char"}
    f = spark.createDataFrame([("o", "a"), ("o", "a/b"), ("q", "a")], "object_id string, path string")
    assert list(map(tuple, integrity.path_conflicts(f).collect())) == [("o", "a")]


@pytest.mark.parametrize("name", ["file_change_history", "inventory_parse", "path_constraints_cloud", "file_details", "document_issues"])
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("events", "documents", "conversations", "pages", "orders", "customer"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, sql = registry.QUERIES[name](spark, SF), db.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, sql.select(*columns).fetchall()))


GOOD = '{"id":"urn:x","type":"https://ocfl.io/1.1/spec/#inventory","digestAlgorithm":"sha512","head":"v1","manifest":{"ab":["v1/content/a"]},"versions":{"v1":{"created":"2020-01-01T00:00:00Z","message":"m","user":{"name":"u","address":"mailto:u@x"},"state":{"ab":["a"]}}}}'


#: What stands in the document, what takes its place, and the issues that follow.
BREACHES = [
    ("", "", {}), ("{", "", {"E033": 1}), ('"urn:x"', "7", {"E037": 1}), ('"urn:x"', "null", {"E036": 1}), ('"urn:x"', '"x"', {"W005": 1}),
    ('"v1":{"created"', '"v1":null,"v2":{"created"', {"E047": 1}), ('["a"]', '[1,null]', {"E051": 2}), ('["a"]', 'null', {"E050": 1}),
    ('"message":"m"', '"message":1,"x":2', {"E094": 1, "E102": 1}), ('"2020-01-01T00:00:00Z"', '"2020-01-01"', {"E049": 1}),
    ('"name":"u"', '"name":" "', {"E054": 1}), ('"state":{"ab"', '"state":{"cd"', {"E050": 1, "E107": 1}), ('"v1":{', '"v02":{', {"E010": 2, "E040": 1}),
    ('"v1":{', '"v9000000000":{', {"E010": 9_000_000_000, "E040": 1}),
    ('"versions":{', '"versions":[],"y":{', {"E044": 1, "E102": 1}), ('"manifest":{', '"manifest":null,"fixity":{', {"E106": 1}),
]


def test_document_issues(spark):
    rows = [(old + new, GOOD.replace(old, new, 1)) for old, new, _ in BREACHES]
    df = spark.createDataFrame([*rows, (None, None)], "object_id string, raw string")
    got = {(r.object_id, r.code): r.n for r in documents.issues(df).collect()}
    assert got == {(old + new, c): n for old, new, want in BREACHES for c, n in want.items()} | {(None, "E033"): 1}
    assert documents.issues(df.limit(0)).isEmpty()
