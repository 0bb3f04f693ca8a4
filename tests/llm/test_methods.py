"""The operators' methods against plain versions, and odd input."""

import base64
import hashlib
import random
import re
import time
from itertools import product
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from palimpsest import runtime
from palimpsest.llm import archives, byte_bpe, html_text, language_id, mixing, ngram_join, quality, secret_scan, token_counts, topk_search
from palimpsest.llm.common import settled, vocabulary

RAW = vocabulary(None, byte_bpe.VOCABULARY)


def test_long_words():
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RAW), special_tokens={})
    rng = random.Random(2)
    words = ["ab" * 700, "a" * 1201, "é" * 400, "=" * 900 + "-" * 600, "".join(rng.choice("abAB") for _ in range(800)), base64.b64encode(rng.randbytes(600)).decode()]
    codec = byte_bpe.Codec(RAW, public_tokenizers.PATTERN)
    ids = codec.encode([*words, "", " ".join(words), None])
    assert ids.to_pylist() == [own.encode_ordinary(w or "") for w in [*words, "", " ".join(words), None]]
    assert codec.decode(ids) == [(w or "").encode() for w in [*words, "", " ".join(words), None]]


def test_unsafe_merges():
    """A vocabulary in which a longer token has a lower rank than its part: places of one pair can't be contracted together."""
    ranks = {bytes([i]): i for i in range(256)} | {b"aba": 300, b"ab": 301, b"abab": 302, b"bb": 303}
    raw = b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items())
    codec = byte_bpe.Codec(raw, r"\S+")
    codec.create("merges", byte_bpe.merge_table(codec.ranks))
    own = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(x) for n in range(1, 8) for x in product("ab", repeat=n)]
    got = [np.frombuffer(x, np.int32).tolist() for x in codec.contract_long([w.encode() for w in words])]
    assert got == [own.encode_ordinary(w) for w in words] == [np.frombuffer(x, np.int32).tolist() for x in codec.contract([w.encode() for w in words])]


def test_all_segmentations():
    """The forward algorithm's probability of a word is the sum over all its segmentations."""
    pieces = {p: i + 1 for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "aba", "c"])}
    probs = np.vstack([np.zeros(2), np.random.default_rng(1).random((len(pieces), 2))])
    probs /= probs.sum(axis=0)

    def total(word, lang):
        if not word:
            return 1.0
        found = language_id.UNKNOWN * total(word[1:], lang)
        return found + sum(probs[n, lang] * total(word[len(p) :], lang) for p, n in pieces.items() if word.startswith(p))

    for n in (1, 3, 6):
        words = ["▁" + "".join(x) for x in product("abcx", repeat=n)]
        logs = language_id.forward(language_id.lattice(words, pieces, language_id.prefixes(pieces)), probs)[1]
        assert np.allclose(logs, [[np.log(total(w, k)) for k in (0, 1)] for w in words])


def test_fertility_figures(spark):
    import sentencepiece

    tok = sentencepiece.SentencePieceProcessor(model_proto=vocabulary(None, quality.VOCABULARY))
    rng = random.Random(6)
    texts = [None, "", " \n", "x" * 5000, *(" ".join(rng.choice(["one", "two", "three", "𓀀", "ünder", "#"]) for _ in range(rng.randrange(1, 90))) for _ in range(30))]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    for r in quality.measured(df).collect():
        words = (r.text or "").split(" ") if (r.text or "").strip() else []
        words = [w for w in words if w.strip()]
        ids = [i for w in words for i in tok.encode(w)]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_pieces) == (len(words), sum(map(len, words)), len(inside), len(ids))
        if ids:
            p = np.unique(ids, return_counts=True)[1] / len(ids)
            assert np.isclose(r.token_entropy, -(p * np.log2(p)).sum()) and np.isclose(r.byte_share, sum(tok.is_byte(i) or tok.is_unknown(i) for i in ids) / len(ids))
    assert quality.quality(df.limit(0)).isEmpty()


def test_html_method(spark):
    good = "It was there that they had to go with all of us, and what we could do about it was not for me to say. " * 3
    for page, want in [
        ("<article><h1><a href=x>Title</a></h1><p>x</p></article>", "Title\n\nx"), ("<article><ul><li><a href=x>item</a></li></ul></article>", "item"),
        ("<article><p>Copyright law is old.</p></article>", "Copyright law is old."), ("<article><p data-x=Bob's>Hello</p><p>it's</article>", "Hello\n\nit's"),
        ("<article><figure><figcaption class=caption>Cap</figcaption></figure><p class=byline>By me</p><p class=warning>Hot</p></article>", "Cap\n\nBy me\n\nHot"),
        (f"<div><a href=a>One</a> <a href=b>Two</a></div><div><p>Lead</p><p>{good}</p><p>End</p></div><div><a href=c>{'Three ' * 20}</a></div>", f"{good.strip()}"),
        (f"<article><p>{good}</p><p>End</p></article><div><a href=c>{'Three ' * 20}</a></div>", f"{good.strip()}\n\nEnd"),
    ]:
        got = html_text.main_text(page)
        assert got == want or want in got and "Three" not in got and "One" not in got
    rows = [(1, "u", None, "mine"), (2, "u", "<article><p>a &amp; b</p></article>", "mine"), (2, "u", "<article><p>a &amp; b</p></article>", "mine"), (None, None, "<article>" + "<p>w</p>" * 9000, "mine")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, len(r.text), r.n_chars) for r in html_text.extract(df).collect()) == [(0, 26998, 26998), (1, 0, 0), (2, 5, 5), (2, 5, 5)]
    assert html_text.extract(df.limit(0)).isEmpty()


def test_topk(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 64))
    x = np.floor(64 * (centres[rng.integers(12, size=6000)] + 0.1 * rng.normal(size=(6000, 64))))
    ids, asked = np.arange(6000), np.arange(0, 6000, 20)
    floors, found = topk_search.Floors(topk_search.LEVELS, 20), {}
    for at in range(0, 6000, 1500):
        for i, (u, s) in zip(asked, topk_search.best_of(x[asked], ids[asked], x[at : at + 1500], ids[at : at + 1500], floors), strict=True):
            a, b = found.get(i, (np.zeros(0, int), np.zeros(0, int)))
            found[i] = topk_search._top(np.concatenate([a, u]), np.concatenate([b, s]), 20)
    for i in asked:
        score = topk_search.exact(x[i : i + 1], x)[0]
        want = topk_search._top(ids[ids != i], score[ids != i], 20)
        assert np.array_equal(found[i][0], want[0]) and np.array_equal(found[i][1], want[1])
    assert floors.scored < 0.3 * floors.pairs
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, 2.0]), (None, [9.0, 9.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk_search.search(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 1, 64 * 64 + 128 * 128), (0, 2, 5, 64 * 64 + 128 * 128)]
    assert topk_search.search(df.limit(0), F.col("vec_id") % 20 == 0).isEmpty()


def test_archive_of_a_lost_attempt(tmp_path):
    """A store that refuses to move onto a file, as some do, takes the file of the new attempt; a file that is missing is an error."""
    from pyarrow import fs

    class Strict:
        def move(self, a, b):
            if (tmp_path / b).exists():
                raise OSError("exists")
            (tmp_path / a).rename(tmp_path / b)

        def delete_file(self, a):
            (tmp_path / a).unlink()

    (tmp_path / "name").write_text("lost")
    for store, where in ((Strict(), ""), (fs.LocalFileSystem(), f"{tmp_path}/")):
        (tmp_path / "own").write_text("whole")
        archives.settle(store, f"{where}own", f"{where}name")
        assert sorted(x.name for x in tmp_path.iterdir()) == ["name"] and (tmp_path / "name").read_text() == "whole"
    with pytest.raises(OSError):
        archives.settle(Strict(), "own", "name2")


def components(texts: list[str | None]) -> list[int]:
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_families(spark, seed):
    """Families with long lists: copies with changed words of several bases of one stem, cut to many lengths; and sets of 5 to 12 shingles."""
    rng, words = random.Random(seed), [f"w{i}" for i in range(3000)]
    stem, texts = [rng.choice(words) for _ in range(50)], []
    for _ in range(4):
        base = [rng.choice(words) if rng.random() < 0.06 else w for w in stem] + [rng.choice(words) for _ in range(20)]
        for _ in range(60):
            w = [rng.choice(words) if rng.random() < 0.03 else x for x in base]
            texts.append(" ".join(w[: rng.randrange(46, 71)]))
    short = [rng.choice(words) for _ in range(16)]
    texts += [" ".join(short[: rng.randrange(9, 17)]) for _ in range(20)] + [" ".join([rng.choice(words) if rng.random() < 0.1 else x for x in short]) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = components(texts)
    got = {r.doc_id: r.component_id for r in ngram_join.linked(df).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) > 3


def test_ngram_join_of_what_is_common_by_chance(spark, monkeypatch):
    """Random texts with a passage in common stand in its long lists, but no two can link by them: none of them is verified against a centre."""
    rng, words, met = random.Random(4), [f"w{i}" for i in range(3000)], []
    passage = [rng.choice(words) for _ in range(14)]
    texts = [" ".join([rng.choice(words) for _ in range(150)] + passage + [rng.choice(words) for _ in range(rng.randrange(120, 150))]) for _ in range(120)]
    texts += [t.rsplit(" ", rng.randrange(1, 60))[0] for t in texts[:20]]
    central = ngram_join.Join.central
    monkeypatch.setattr(ngram_join.Join, "central", lambda self, members: met.append(members.count()) or central(self, members))
    monkeypatch.setattr(ngram_join, "FREQUENT", 10**9)  # else the passage would stand last
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.linked(df).collect()}
    assert got == dict(enumerate(components(texts))) and met == [0]


def test_saved_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {str(f) for f in (x.getName() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())) if f.startswith("shuffle_")}
    before, switch = names(), spark.conf.get(runtime.CLEANUP)
    kept = runtime.saved(spark, spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    for _ in range(50):
        if not (left := names() - before):
            break
        time.sleep(0.2)
    assert not left and kept.count() == 7 and spark.conf.get(runtime.CLEANUP) == switch


def test_deduplicated_ids(spark):
    """One row of each id and text, the smallest id of a component; rows without id once for each text where they stand alone."""
    same, other = "one two three four five six seven", "a b c d e f g"
    rows = [(3, same, "x"), (3, same, "x"), (4, same, "y"), (None, other, "z"), (None, other, "z"), (9, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = ngram_join.deduplicated(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == {(3, same, "x"), (None, other, "z"), (9, None, "n")} and got.count() == 3
    assert ngram_join.deduplicated(df.limit(0)).isEmpty()


def test_bpe_digests_need_one_python_pass(spark):
    df = spark.createDataFrame([(1, "Some text, some more."), (2, ""), (3, None)], "doc_id long, text string")
    got = byte_bpe.digests(df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    ids = {r.doc_id: list(r.ids) for r in byte_bpe.encode(df).collect()}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = {(r.doc_id, len(ids[r.doc_id]), digest(" ".join(map(str, ids[r.doc_id])).encode()), digest((r.text or "").encode())) for r in df.collect()}
    assert {tuple(r) for r in got.collect()} == want


def test_bpe_digests_by_slices(spark):
    """A batch of more text than one slice holds is worked on in parts that keep every row, in order."""
    sizes = [0, 5, byte_bpe.SLICE - 1, 3, None, 2 * byte_bpe.SLICE + 7, 0, byte_bpe.SLICE // 2, byte_bpe.SLICE // 2, None]
    texts = [None if n is None else ("some words é " * (n // 14 + 1)).encode()[:n].decode(errors="ignore") for n in sizes]
    parts = [x.to_pylist() for x in byte_bpe.slices(pa.array(texts, pa.string()))]
    assert sum(parts, []) == texts and len(parts) > 3
    assert all(sum(len((t or "").encode()) for t in p[1:]) <= byte_bpe.SLICE for p in parts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RAW), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(df).collect()}
    ids = [own.encode_ordinary(t or "") for t in texts]
    assert got == {i: (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, (x, t) in enumerate(zip(ids, texts, strict=True))}


def test_tasks_give_memory_back():
    """What a task's Arrow arrays took is the system's again when it ends, in the join's passes too."""

    def mb():
        return sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    def run(batches):
        for b in batches:
            yield len([pa.array(np.full(12_000, i)) for i in range(1_000)]) + b

    before = mb()
    assert list(settled(run)(iter([1, 2]))) == [1_001, 1_002] and mb() < before + 40


def test_mixing_starts_no_workers_of_another_kind(spark, monkeypatch):
    """The cells' weights reach the JVM without a Python RDD, whose workers stay in the executors beside those of the next stage."""
    tables = {}
    monkeypatch.setattr(mixing, "saved", lambda s, df, name, keep=mixing.saved: keep(s, tables.setdefault(name, df), name))
    df = spark.createDataFrame([(i, "some words, and more", "en", f"s{i % 3}") for i in range(30)], "doc_id long, text string, lang string, source string")
    assert mixing.sample(df).count() > 0
    assert "PythonRDD" not in tables["cell-weights"]._jdf.queryExecution().toRdd().toDebugString()
    assert dict(tables["cell-weights"].dtypes)["weight"] == "double" and tables["cell-weights"].count() == 3


def test_ngram_join_odd(spark):
    same = "one two three four five six seven"
    rows = [(None, same), (None, same), (3, same), (3, same), (2, None), (None, None), (5, " \t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.linked(df).collect())
    assert got == [(0, 0, 0), (0, 3, 3), (0, 3, 3), (2, 0, 2), (3, 3, 3), (3, 3, 3), (5, 0, 5)]
    assert ngram_join.linked(df.limit(0)).isEmpty()


def test_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "token=abcdefghijklmn", "x", "y")], "doc_id long, text string, n_words string, n_tokens string")
    assert dict(token_counts.token_counts(df).dtypes)["n_words"] == "bigint"
    assert token_counts.token_counts(df.limit(0)).isEmpty() and secret_scan.report(df.limit(0)).isEmpty()
    assert secret_scan.report(df).first().n_assign == 1
    long = spark.createDataFrame([(1, "x " * 200_000 + "password: abcdefghijklmn")], "doc_id long, text string")
    assert secret_scan.report(long).first().spans.startswith("assign:400000:")
