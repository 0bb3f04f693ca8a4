"""A repository on disk, update logs against a plain interpreter, and table rules."""

import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import digests, layouts, paths
from palimpsest.operators import repository, state, tables, updates
from palimpsest.plans import objects, registry
from palimpsest.sources import inventory
from palimpsest.sources.files import repo_files

SF = "/root/testdata/sf0.001"
RAW = '{"id":"urn:x","type":"https://ocfl.io/1.1/spec/#inventory","digestAlgorithm":"sha512","head":"v1","manifest":{"ab":["v1/content/_a"]},"versions":{"v1":{"created":"2020-01-01T00:00:00Z","state":{"ab":["a"]}}}}'


def test_files(spark, tmp_path):
    root = tmp_path / "store"
    for o in ("x", "x/v1/content/nested", "extensions/y"):
        (root / o / "v1/content").mkdir(parents=True)
        (root / o / "0=ocfl_object_1.1").write_text("ocfl_object_1.1\n")
        (root / o / "inventory.json").write_text(RAW)
        (root / o / "inventory.json.sha512").write_text(hashlib.sha512(RAW.encode()).hexdigest() + "  inventory.json\n")
        (root / o / "v1/content/_a").write_text("hello")
    (root / "0=ocfl_1.1").write_text("ocfl_1.1\n")
    files = repo_files(spark, str(root))
    assert [tuple(r) for r in repository.list_objects(files).collect()] == [("urn:x", "x")]
    found = {(r.code, r.subject) for r in repository.object_issues(files).collect()}
    assert ("W010", "v1") in found and not any(c in ("E060", "E058", "E092", "E007") for c, _ in found)
    assert ("E023", "v1/content/nested/0=ocfl_object_1.1") in found
    assert {r.name for r in repository.unsupported_extensions(files).collect()} == {"y"}
    assert repository.object_issues(files.limit(0)).isEmpty()


def test_built_inventories_do_not_hang_on_row_order(spark):
    rows = [(o, v, f"p{v % 3}", hashlib.md5(f"{o} {v}".encode()).hexdigest()) for o in range(2) for v in range(1, 41)]
    told = []
    for seed, n in ((1, 1), (2, 7)):
        dealt = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "object_id long, vnum long, path string, digest string").repartition(n)
        told.append({r.object_id: r.raw for r in inventory.build(dealt).collect()})
    assert told[0] == told[1] and len(told[0]) == 2
    for raw in told[0].values():
        doc = json.loads(raw)
        assert list(doc["versions"]) == [f"v{i}" for i in range(1, 41)] and list(doc["manifest"]) == sorted(doc["manifest"])


def test_updates_against_interpreter(spark):
    rng, rows, log, want, failed = random.Random(3), [], [], set(), set()
    for o in range(60):
        now = {f"p{i}": str(i) for i in range(4) if rng.random() < 0.6}
        rows += [(o, p, d) for p, d in now.items()]
        bad = False
        for seq in range(rng.randrange(1, 7)):
            op, path, to = rng.choice(("add", "remove", "rename", "reinstate", "clear")), f"p{rng.randrange(5)}", f"p{rng.randrange(5)}"
            digest, over = rng.choice((None, "n")) if op == "reinstate" else "n", rng.random() < 0.7
            log.append((o, seq, op, path, to, digest, over, None))
            target = path if op == "add" else to
            if op == "rename" and path not in now or op == "reinstate" and digest is None:
                failed.add((o, seq, "missing"))
                bad = True
            elif op in ("add", "rename", "reinstate") and not over and target in now:
                failed.add((o, seq, "exists"))
                bad = True
            elif op == "clear":
                now = {}
            elif op == "remove":
                now.pop(path, None)
            else:
                value = now.pop(path) if op == "rename" else digest
                now[target] = value
        if not bad:
            want |= {(o, 2, p, d) for p, d in now.items()} or {(o, 2, None, None)}
    s = spark.createDataFrame(rows, "object_id long, path string, digest string")
    h = spark.range(60).select(F.col("id").alias("object_id"), F.lit(1).cast("long").alias("head"))
    g = spark.createDataFrame(log, "object_id long, seq long, op string, path string, to string, digest string, overwrite boolean, expected_head long")
    assert set(map(tuple, updates.apply(s, h, g).collect())) == want
    assert set(map(tuple, updates.errors(s, h, g).collect())) == failed


def test_rules(spark):
    df = spark.createDataFrame([("a/b\\c",), ("x.tmp",), ("é" * 3,)], "p string")
    got = df.select(
        F.array_join(paths.logical_violations(F.col("p"), True), ","), paths.begin_end(F.col("p"), "e", ends=".tmp"), paths.length(F.col("p"), "l", octets=5),
        paths.pattern(F.col("p"), "m", "[a-z.]+", must=True), paths.characters(F.col("p"), "c", "x."), paths.mapped(F.col("p"), "conservative"),
    )
    assert [tuple(r) for r in got.collect()] == [("backslash", None, None, "m", None, "a%2fb%5cc"), ("", "e", None, None, "c", "x%2etmp"), ("", None, "l", "m", None, "%c3%a9" * 3)]
    layouts.register("mine", lambda c: F.upper(c))
    digests.register("first", lambda c: F.hex(F.substring(c, 1, 1)))
    assert tuple(df.limit(1).select(layouts.mapped(F.col("p"), "mine"), digests.digest(F.col("p").cast("binary"), "first")).first()) == ("A/B\\C", "61")
    with pytest.raises(ValueError, match="tuple size"):
        layouts.validate(3, 0, 64)
    f = spark.createDataFrame([("o", "md5", "0" * 32), ("o", "md5", "F" * 32), ("o", "md5", "f" * 32), ("o", "sha1", "zz")], "o string, algorithm string, digest string")
    assert {tuple(r) for r in tables.fixity_block_issues(f, ["o"]).collect()} == {("o", "zz", "E057"), ("o", "f" * 32, "E097")}


def test_blake(spark):
    row = registry.QUERIES["fixity_blake2b"](spark, SF).join(registry.files(spark, SF).select("object_id", "path", "content"), ["object_id", "path"]).limit(20).collect()
    for r in row:
        for n in (512, 384, 256, 160):
            assert r[f"blake2b_{n}"] == hashlib.blake2b(r.content, digest_size=n // 8).hexdigest()
        assert r["sha512_256"] == hashlib.new("sha512_256", r.content).hexdigest()


@pytest.mark.parametrize("name", ["object_issues", "update_log_state", "import_compatible", "inventory_chain", "details_upsert", "file_details", "version_gaps", "inventory_path_issues"])
def test_oracle(spark, name):
    assert objects and state
    db = duckdb.connect()
    for t in ("events", "documents", "conversations", "pages", "orders", "customer"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, sql = registry.QUERIES[name](spark, SF), db.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, sql.select(*[f'"{c}"' for c in columns]).fetchall()))
