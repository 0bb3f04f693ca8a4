"""Exact Jaccard join on word shingles by a size-aware split into light and heavy sets, and its connected components.

Documents with equal shingle sets form a class; all further work is on classes. A set of at most x shingles is light.
Two light sets of sizes a and b link if they share at least c = ceil(3(a + b)/7) shingles (for similarity 0.75), so
each light set lists its subsets of c shingles for every partner size that can link; classes that meet in a key of
(a, b, subset) are linked, with nothing to verify. Larger sets are found by scanning inverted lists: each set enters the
lists of its n - ceil(0.75 n) + 1 first shingles in a common order, in which shingles that are frequent in many lists
come last, so that passages which many documents share seldom open a list (what is frequent is told by repeats inside
partitions; it bears on the cost alone). The boundary x is the one of least
estimated cost over the sizes that occur.

Pairs of a short list are counted over all short lists; two sets that share too few of their first shingles to link are
left out by that count. Where a set stands in fewer long lists than it has to share with the other, they share a short
one too: the pair is left to that count, with the long lists of the one that stands in fewer added. So a set enters a
long list only where one of its members has a size with which long lists alone may tell a link, and what long random
texts have in common by chance is not looked at there. Of the others each class is verified against the partner with most partners first, then only
pairs that are still in different components. A long list is not paired: each member is verified against the list's
centre C and the centres of its size band and the next one, which tells most components. What more than RARE members
have outside C is counted in with it. A linked pair that joins two components shares enough within C, or it shares
something outside. In the second case one of its members, which is not in the list's most frequent component, is
joined by its rarest shingles outside C, as many of them as what it lacks within C allows. In the first case let s be
the smaller of both sizes: both members are verified against a centre of size s, and as one of them does not link to
it and needs no less of its partner than of this centre, both share something outside, by which they are joined. A
group of many copies so costs links in its number, and no pair that may join two components is left unverified: the
result is exact, whatever is frequent.

Shingles are 64-bit hashes. Results for odd input: null text or text without words has no shingles (n_shingles 0) and
is a component of its own; fewer than five words are one shingle; repeated rows are in one component; rows without
doc_id link like others but never name a component that has an id; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import release, settled
from palimpsest.runtime import arrow_rows, cleaned, saved, ship, table

SHINGLE, PERCENT = 5, 75
#: Sizes whose numbers the driver gets to choose the boundary from (one set of this size has more than 1e40 subsets); cost of a posting in terms of one subset key.
SIZES, POSTING_COST = 256, 4
#: Words of a task's cache; characters at once; shingles put last in the order (4 MB at most); least number of repeats inside partitions of a frequent one; bits (32 MB) that tell repeats.
ENTRIES, CHUNK, LAST, FREQUENT, SLOTS = 200_000, 4_000_000, 524_288, 4, 1 << 28
#: Bits of the filter that tells which sets verification needs (1 MB).
FILTER_BITS = 23
#: Members up to which a list is short; members of a star up to which a shingle outside its centre is rare.
SHORT_LIST, RARE = 16, 64
#: Ratio of the sizes that share a centre.
BAND = 1.15
#: Mark of a pair with a list's centre.
CENTRE = 1
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def need(n: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of n with any that it links to."""
    return -(-percent * n // 100)


def overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """Least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, most: int, percent: int = PERCENT) -> range:
    """Sizes up to `most` that can link to n."""
    return range(max(1, need(n, percent)), min(most, 100 * n // percent) + 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class Words(dict):
    """Word to 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= ENTRIES:
                self.clear()
            self[word] = h
        return h


_TRUE = np.ones(1, bool)


def word_hashes(texts: list[str | None], known: Words) -> tuple[np.ndarray, list[int]]:
    """Hashes of the words of all texts, and each text's number of words; each distinct word is looked up once."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    strings = pa.array(data, pa.large_binary()).cast(options=pc.CastOptions(pa.large_string(), allow_invalid_utf8=True))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(strings))
    words, ends = lists.flatten(), lists.offsets.to_numpy()
    filled = pc.binary_length(words).to_numpy() > 0
    before = np.concatenate([[0], np.cumsum(filled)])[ends - ends[0]]
    coded = words.dictionary_encode()
    found = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    return hashes[coded.indices.to_numpy()[filled]], np.diff(before).tolist()


def shingle_sets(texts: list[str | None], width: int = SHINGLE, known: Words | None = None) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    flat, n = word_hashes(texts, Words() if known is None else known)
    k = max(0, len(flat) - width + 1)
    grams = np.zeros(k, np.uint64)
    for i in range(width):
        grams += flat[i : i + k] * MULTIPLIERS[i % 5] + np.uint64(i + 1)
    grams = mixed(grams)
    out, at = [], 0
    for size in n:
        if size >= width:
            g = np.sort(grams[at : at + size - width + 1])
            out.append(g[np.concatenate([_TRUE, g[1:] != g[:-1]])])
        elif size:
            part = flat[at : at + size]
            out.append(mixed(np.array([(part * MULTIPLIERS[:size]).sum(dtype=np.uint64) ^ np.uint64(size)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def class_of(s: np.ndarray) -> int | None:
    return digest(s.tobytes()) if len(s) else None


def prefix(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The shingles in whose lists a set stands: the first in the order of (is in `last`, hash)."""
    p = len(s) - need(len(s)) + 1
    if not len(last):
        return s[:p]
    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
    late = last[at] == s
    return np.concatenate([s[~late], s[late]])[:p]


def light_keys(s: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(key, kind): kind 1 for equal sizes, 2 for different ones."""
    out, n = [], len(s)
    for m in partners(n, most):
        a, b = min(n, m), max(n, m)
        for subset in combinations(s.tolist(), overlap(a, b)):
            out.append((digest(repr((a, b, subset)).encode()), 1 if a == b else 2))
    return out


def boundary(sizes: dict[int, int]) -> int:
    """The x of least estimated cost, from the number of classes of each size; light keys only grow in number with x."""
    best, least, x = 0, None, 0
    while True:
        light = sum(c * comb(n, overlap(min(n, m), max(n, m))) for n, c in sizes.items() if n <= x for m in partners(n, x))
        if least is not None and light >= least or x > max(sizes, default=0):
            return best
        cost = light + POSTING_COST * sum(c * (n - need(n) + 1) for n, c in sizes.items() if 100 * n > PERCENT * x)
        if least is None or cost < least:
            best, least = x, cost
        x += 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and shingle sets of at most about CHUNK characters at once."""
    release()
    known = Words()
    for b in batches:
        ids, texts, at, size = b.column(0).to_pylist(), b.column(1).to_pylist(), 0, 0
        for i, t in enumerate([*texts, None]):
            if i == len(texts) or size > CHUNK:
                if i > at:
                    yield ids[at:i], shingle_sets(texts[at:i], known=known)
                at, size = i, 0
            size += len(t or "")


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ROWS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64())])


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: each row's set size and class. Kind 1: shingles (cls) that other classes of this partition had before, n times in a chunk; a bit may tell one too many."""
    seen: set[int] = set()
    slots = np.zeros(SLOTS >> 6, np.uint64)
    for ids, sets in _chunks(batches):
        classes = [class_of(s) for s in sets]
        firsts = []
        for c, s in zip(classes, sets, strict=True):
            if c is not None and c not in seen:
                seen.add(c)
                firsts.append(s)
        yield _batch(_ROWS, [0] * len(ids), ids, list(map(len, sets)), classes)
        if firsts:
            # With df copies over p partitions about df^2 / 2p pairs fall together, so what is frequent shows at any size.
            found = np.sort(np.concatenate(firsts))
            start = np.flatnonzero(np.concatenate([_TRUE, found[1:] != found[:-1]]))
            count, found = np.diff(start, append=len(found)), found[start]
            at, bit = (found >> np.uint64(6) & np.uint64((SLOTS >> 6) - 1)).astype(np.int64), np.uint64(1) << (found & np.uint64(63))
            count = count - 1 + (slots[at] & bit > 0)
            np.bitwise_or.at(slots, at, bit)
            found, count = found[count > 0], count[count > 0]
            if len(found):
                yield _batch(_ROWS, [1] * len(found), [None] * len(found), count, found.view(np.int64))


_POSTINGS = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("cls", pa.int64()), ("n", pa.int32())])
_LISTS = "key long, kind int, cls long, n int, hub long, at long"


def _postings(last, light: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, seen = last.value, set()
        for _, sets in _chunks(batches):
            keys, kinds, classes, sizes = [], [], [], []
            for s in sets:
                c = class_of(s)
                if c is None or c in seen:
                    continue
                seen.add(c)
                if 100 * len(s) > PERCENT * light:
                    p = prefix(s, late)
                    keys.append(p.view(np.int64))
                    kinds.append(np.zeros(len(p), np.int32))
                    classes.append(np.full(len(p), c, np.int64))
                    sizes.append(np.full(len(p), len(s), np.int32))
                if len(s) <= light:
                    found = light_keys(s, light)
                    keys.append(np.array([k for k, _ in found], np.int64))
                    kinds.append(np.array([k for _, k in found], np.int32))
                    classes.append(np.full(len(found), c, np.int64))
                    sizes.append(np.full(len(found), len(s), np.int32))
            if keys:
                whole = [np.concatenate(x) for x in (keys, kinds, classes, sizes)]
                for a in range(0, len(whole[0]), 100_000):
                    yield _batch(_POSTINGS, *(x[a : a + 100_000] for x in whole))

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, size and class: the lists of two classes at least, with their first class as hub and each row's place. Streams: one row is carried on."""
    names, kinds = ["key", "kind", "cls", "n", "hub", "at"], (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    carry, told = None, 0  # first row of the list that may go on, and how many of its rows have been given out
    for b in batches:
        key, kind, cls, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if carry is not None:
            key, kind, cls, n = (np.concatenate([[c], x]) for c, x in zip(carry[:4], (key, kind, cls, n), strict=True))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        if carry is not None:  # the row carried on is the list's first, the last one given out is carry[4]
            fresh[1:] &= ~((key[1:] == key[0]) & ((cls[1:] == cls[0]) | (cls[1:] == carry[4])))
        key, kind, cls, n = key[fresh], kind[fresh], cls[fresh], n[fresh]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        first = np.repeat(start, size)
        at = np.arange(len(key)) - first
        out = np.repeat(size, size) > 1
        if told:
            out[0] = False
            at[1 : size[0]] += told - 1
        last, gone = cls[-1], told if len(start) == 1 else 0
        yield pa.RecordBatch.from_arrays([pa.array(x[out], t) for x, t in zip((key, kind, cls, n, cls[first], at), kinds, strict=True)], names=names)
        f = start[-1]
        told = gone + int(size[-1]) - 1 if gone else int(size[-1]) if size[-1] > 1 else 0
        carry = (key[f], kind[f], cls[f], n[f], last)


def _sets(filter_bits):
    schema = pa.schema([("cls", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = filter_bits.value, set()
        for _, sets in _chunks(batches):
            classes, found = [], []
            for s in sets:
                c = class_of(s)
                if c is None or c in seen:
                    continue
                bit = c & ((1 << FILTER_BITS) - 1)
                if words[bit >> 6] >> np.uint64(bit & 63) & np.uint64(1):
                    seen.add(c)
                    classes.append(c)
                    found.append(s.view(np.int64))
            for a in range(0, len(classes), 256):
                part = found[a : a + 256]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(classes[a : a + 256], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(part)))], schema=schema)

    return run


def _trim(filter_bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = filter_bits.value
        for b in batches:
            rest = b.column(4)
            lens, flat = rest.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), rest.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lens)), lens)
            bit = (np.repeat(b.column(0).to_numpy(zero_copy_only=False), lens) ^ flat) & ((1 << FILTER_BITS) - 1)
            kept = words[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1) > 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(lens)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[kept], pa.int64()))], names=["a", "b", "a_n", "b_n", "rest"])

    return run


def dropped(*tables: DataFrame) -> None:
    """Delete saved tables whose successors are written."""
    for df in tables:
        if files := df.inputFiles():
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _can_link(a: str, b: str):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT)


def shared_first(a: str, b: str) -> str:
    """SQL: least number of first shingles that linked sets of sizes a and b share."""
    return f"(ceil({PERCENT} * ({a} + {b}) / {100 + PERCENT}) - ceil({PERCENT} * greatest({a}, {b}) / 100) + 1)"


class Join:
    """The state of one join: the documents, the lists and the links found so far."""

    def __init__(self, docs: DataFrame) -> None:
        self.spark: SparkSession = docs.sparkSession
        self.tables: list[DataFrame] = []
        ship(self.spark)
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        arrow_rows(self.spark, 4096)
        first = saved(self.spark, self.texts.mapInArrow(settled(_first_pass), "kind int, doc_id long, n long, cls long"), "shingle-rows")
        self.rows = first.where("kind = 0").select("doc_id", "n", "cls")
        small = self.rows.where(F.col("n").between(1, SIZES)).select("n", "cls").distinct().groupBy("n").count().collect()
        self.light = boundary({r[0]: r[1] for r in small})
        often = first.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("c")).where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "cls").limit(LAST)
        last = np.sort(gathered(often)["cls"].to_numpy(np.int64).view(np.uint64))
        arrow_rows(self.spark, 10_000)
        postings = self.texts.mapInArrow(settled(_postings(self.spark.sparkContext.broadcast(last), self.light)), "key long, kind int, cls long, n int")
        lists = postings.repartition("key").sortWithinPartitions("key", "n", "cls").mapInArrow(settled(_lists), _LISTS)
        self.lists = saved(self.spark, lists, "lists")

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """A table that goes when the components are known."""
        self.tables.append(saved(self.spark, df, name))
        return self.tables[-1]

    def light_links(self) -> DataFrame:
        keys = self.lists.where("kind > 0")
        both = keys.groupBy("key").agg((F.min("n") < F.max("n")).alias("both"))
        return keys.join(both, "key").where("(kind = 1 or both) and cls != hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()

    def near(self, short: DataFrame) -> DataFrame:
        """Pairs (a, b) of short lists (key, cls, n, lists) that share enough of their first shingles to link; `lists` are the long ones that a class stands in.

        Pairs that need no more than the long lists of either are looked for there too.
        """
        p, q = short.alias("p"), short.alias("q")
        meet = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.cls") < F.col("q.cls")) & _can_link("p.n", "q.n") & (F.greatest("p.n", "q.n") > self.light))
        counted = meet.groupBy(F.col("p.cls").alias("a"), F.col("q.cls").alias("b")).agg(F.count("*").alias("k"), F.first("p.n").alias("x"), F.first("q.n").alias("y"), F.first(F.least("p.lists", "q.lists")).alias("lists"))
        least = shared_first("x", "y")
        return counted.where(f"k + if({least} > lists, lists, 0) >= {least}").select("a", "b")

    def standing(self, members: DataFrame) -> DataFrame:
        """Of members (key, cls, n, lists) of long lists: those that share their list with a size to which `lists` long lists alone may tell a link."""
        sizes = members.groupBy("key").agg(F.collect_set("n").alias("sizes"))
        told = f"({shared_first('n', 'n')} <= lists or exists(sizes, m -> m != n and {PERCENT} * greatest(m, n) <= 100 * least(m, n) and {shared_first('n', 'm')} <= lists))"
        return members.join(sizes, "key").where(told).drop("sizes")

    def overlaps(self, pairs: DataFrame, rest: str = "false") -> DataFrame:
        """pairs (a, b, ...) with a_n, b_n, common, and in `rest` the shingles of b outside a where that condition holds."""
        pairs = self.saved(pairs, "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        sets = self.sets.join(ends, "cls", "left_semi").dropDuplicates(["cls"])
        one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("s")), "a")
        two = one.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("t")), "b")
        out = self.saved(
            two.select(*pairs.columns, F.size("s").alias("a_n"), F.size("t").alias("b_n"), F.size(F.array_intersect("s", "t")).alias("common"), F.expr(f"case when {rest} then array_except(t, s) end").alias("rest")),
            "overlaps",
        )
        dropped(pairs)
        return out

    def central(self, members: DataFrame) -> DataFrame:
        """Pairs (a, b, kind) of each member of a long list with its centre (kind 1) and those of its size band and the next one (kind 0).

        A centre is the member with the greatest part of its prefix in long lists: the one with the fewest words of its own.
        """
        own = members.groupBy("cls").agg(F.count("*").alias("c"))
        score = F.struct((F.col("c") / (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).alias("part"), "n", "cls")
        best = self.saved(members.join(own, "cls").groupBy("key", "band").agg(F.max(score).alias("score")), "centres")
        of_list = best.groupBy("key").agg(F.max("score")["cls"].alias("a"))
        of_band = best.select("key", "band", F.col("score")["cls"].alias("a"))
        asked = members.select("key", F.col("cls").alias("b"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
        whole = members.select("key", F.col("cls").alias("b")).join(of_list, "key").select("a", "b", F.lit(CENTRE).alias("kind"))
        banded = asked.join(of_band, ["key", "band"]).select("a", "b", F.lit(0).alias("kind"))
        return whole.union(banded).where("a != b")

    def filter_of(self, values: DataFrame):
        """A broadcast bit filter (1 MB) of the column c."""
        bit = F.col("c").bitwiseAND((1 << FILTER_BITS) - 1)
        words = values.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, int((c & {(1 << FILTER_BITS) - 1}) & 63))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
        filled = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        words = gathered(words)
        filled[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64).view(np.uint64)
        return self.spark.sparkContext.broadcast(filled)

    def sets_of(self, ends: DataFrame) -> DataFrame:
        """(cls, shingles) of the classes c of ends, and of some others; the texts are read again."""
        given = self.filter_of(ends)
        arrow_rows(self.spark, 4096)
        return self.saved(self.texts.mapInArrow(settled(_sets(given)), "cls long, shingles array<long>"), "sets")

    def trimmed(self, stars: DataFrame, asked: DataFrame) -> DataFrame:
        """stars whose `rest` keeps what stands in asked (a, s), and some others, the same ones for all members of a star."""
        given = self.filter_of(asked.select(F.col("a").bitwiseXOR(F.col("s")).alias("c")))
        arrow_rows(self.spark, 256)
        return self.saved(stars.select("a", "b", "a_n", "b_n", "rest").mapInArrow(settled(_trim(given)), "a long, b long, a_n int, b_n int, rest array<long>"), "trimmed")

    def run(self) -> DataFrame:
        """(cls, comp) of the classes that are linked to another."""
        heavy = self.lists.where("kind = 0")
        long = heavy.where(F.col("at") == SHORT_LIST).select("key")
        every = self.saved(heavy.join(long, "key", "left_semi").select("key", "cls", "n"), "long-lists")
        lists = every.groupBy("cls").agg(F.count("*").alias("lists"))
        short = heavy.join(long, "key", "left_anti").select("key", "cls", "n").join(lists, "cls", "left").fillna(0, ["lists"])
        near = self.saved(self.near(short), "near")
        links = self.saved(self.light_links(), "light-links")
        dropped(self.lists)
        members = self.standing(every.join(lists, "cls")).select("key", "cls", "n", F.floor(F.log(BAND, "n")).cast("int").alias("band"))
        members = self.saved(members, "standing")
        dropped(every)
        self.sets = self.sets_of(near.select(F.explode(F.array("a", "b")).alias("c")).union(members.select("cls")).distinct())
        found = self.overlaps(starred(near).withColumn("kind", F.lit(0)).union(self.central(members)).groupBy("a", "b").agg(F.max("kind").alias("kind")), "kind > 0")
        comps = components(links.union(linking(found)))
        told = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = self.saved(apart(near, comps).join(told, ["a", "b"], "left_anti"), "open-near")
        if not more.isEmpty():
            comps = components(linking(self.overlaps(more)), comps)
        comps = self.across(found.where("kind > 0"), told, comps)
        dropped(*self.tables)
        return comps

    def across(self, found: DataFrame, told: DataFrame, comps: DataFrame) -> DataFrame:
        """comps with the links between components of one long list; `told` are pairs that need not be verified again."""
        open_ = self.saved(outside(found.select("a", "b"), comps), "open")
        found = found.join(open_.select("a").distinct(), "a", "left_semi")
        lean = self.trimmed(found, outer(found.join(open_, ["a", "b"], "left_semi")))
        stars, often = self.shifted(found, lean)
        open_ = stars.join(open_, ["a", "b"], "left_semi")
        asked = self.saved(self.inside(stars, open_), "inside")
        pairs = met(open_.withColumn("asked", F.greatest("asked", F.lit(1))), self.trimmed(lean, often), often, comps)
        if not asked.isEmpty():
            found = self.overlaps(self.sized(stars, asked), "true")
            comps = components(linking(found), comps)
            probes = owned(owned(found, comps, "a"), comps, "b").where("a_comp != b_comp")
            needed = F.expr(f"ceil({PERCENT} * (a_n + b_n) / {100 + PERCENT})") - F.col("common")
            probes = self.saved(probes.select("a", "b", F.size("rest").alias("size"), needed.alias("asked")), "probes")
            found = found.join(probes.select("a").distinct(), "a", "left_semi")
            lean = self.trimmed(found, outer(found.join(probes, ["a", "b"], "left_semi")))
            often = self.often(lean)
            pairs = pairs.union(met(probes, self.trimmed(lean, often), often, comps, F.col("p.a_n") == F.least("p.b_n", "q.b_n")))
        more = self.saved(apart(pairs.distinct(), comps).join(told, ["a", "b"], "left_anti"), "open-pairs")
        if not more.isEmpty():
            comps = components(linking(self.overlaps(more)), comps)
        return comps

    def often(self, stars: DataFrame) -> DataFrame:
        """(a, s, often): the shingles outside a centre that two members of its star at least have. By others no two can be joined."""
        return self.saved(outer(stars).groupBy("a", "s").agg(F.count("*").alias("often")).where("often > 1"), "often")

    def shifted(self, stars: DataFrame, lean: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stars (a, b, b_n, size, within, asked), whose centre is taken with what more than RARE members have outside it; and (a, s, often) of the rest.

        lean: the stars with what open members have outside the centre, as an open member is of each pair that is looked for.
        `within` is what a member has in the centre so taken, `size` what it has outside, `asked` what it needs of any partner beyond the centre.
        """
        often = self.often(lean)
        gained = outer(lean).join(often.where(F.col("often") > RARE).select("a", "s"), ["a", "s"]).groupBy("a", "b").agg(F.count("*").alias("gained"))
        least = stars.groupBy("a").agg(F.least(F.min("b_n"), F.min("a_n")).alias("smallest"))
        grown = stars.select("a", "b", "b_n", "common", F.size("rest").alias("all")).join(gained, ["a", "b"], "left").join(least, "a").fillna(0, ["gained"])
        within = F.col("common") + F.col("gained")
        asked = F.expr(f"greatest(ceil({PERCENT} * b_n / 100), ceil({PERCENT} * (b_n + smallest) / {100 + PERCENT}))") - within
        out = grown.select("a", "b", "b_n", (F.col("all") - F.col("gained")).alias("size"), within.alias("within"), asked.alias("asked"))
        return self.saved(out, "stars"), often.where(F.col("often") <= RARE)

    def inside(self, stars: DataFrame, open_: DataFrame) -> DataFrame:
        """(a, s): stars that may have a linked pair, one of it in open_, whose members share enough within the centre alone, and the size of its smaller one."""
        sizes = stars.select("a", F.col("b_n").alias("y_n"), F.col("within").alias("y_within")).distinct()
        both = F.expr(f"least(within, y_within) * {100 + PERCENT} >= {PERCENT} * (b_n + y_n)")
        return open_.join(sizes, "a").where(both & _can_link("b_n", "y_n")).select("a", F.least("b_n", "y_n").alias("s")).distinct()

    def sized(self, stars: DataFrame, asked: DataFrame) -> DataFrame:
        """Pairs (a, b) of a member of size s that has most within the centre, and all members of its star that can link to size s within it."""
        centres = stars.join(asked.withColumnRenamed("s", "b_n"), ["a", "b_n"]).groupBy("a", "b_n").agg(F.max_by("b", F.struct("within", "b")).alias("own"))
        enough = F.expr(f"within * {100 + PERCENT} >= {PERCENT} * (b_n + s)")
        pairs = stars.join(centres.withColumnRenamed("b_n", "s"), "a").where((F.col("b_n") >= F.col("s")) & _can_link("b_n", "s") & enough)
        return pairs.select(F.col("own").alias("a"), "b").where("a != b").distinct()


def gathered(df: DataFrame):
    """A small table on the driver, without shuffle files left."""
    with cleaned(df.sparkSession):
        return df.select("*").toPandas()


def starred(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b): each end with the one of its partners that has most partners, where that one has more than itself."""
    both = pairs.union(pairs.select("b", "a"))
    rank = both.groupBy("a").agg(F.struct(F.count("*").alias("partners"), F.max("a").alias("cls")).alias("rank"))
    ranked = both.join(rank.select(F.col("a").alias("b"), "rank"), "b")
    best = ranked.groupBy("a").agg(F.max("rank").alias("best")).join(rank, "a").where(F.col("best") > F.col("rank"))
    return best.select(F.col("best")["cls"].alias("a"), F.col("a").alias("b"))


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are in different components."""
    return owned(owned(pairs, comps, "a"), comps, "b").where("a_comp != b_comp").select("a", "b")


def owned(df: DataFrame, comps: DataFrame, c: str) -> DataFrame:
    """df with the component of its class c."""
    return df.join(comps.select(F.col("cls").alias(c), F.col("comp").alias(f"{c}_comp")), c, "left").withColumn(f"{c}_comp", F.coalesce(f"{c}_comp", c))


def outside(stars: DataFrame, comps: DataFrame) -> DataFrame:
    """The members outside the most frequent component of their star."""
    own = owned(stars, comps, "b")
    sizes = own.groupBy("a", "b_comp").agg(F.count("*").alias("c"))
    return own.join(sizes.groupBy("a").agg(F.max_by("b_comp", F.struct("c", "b_comp")).alias("main")), "a").where("b_comp != main").drop("main", "b_comp")


def outer(stars: DataFrame) -> DataFrame:
    """A row for each shingle of a member outside its star's centre."""
    return stars.select(*(c for c in ("a", "b", "a_n", "b_n") if c in stars.columns), F.explode("rest").alias("s"))


def met(probes: DataFrame, stars: DataFrame, often: DataFrame, comps: DataFrame, only=None) -> DataFrame:
    """Pairs (a, b) of a probe and a member of the same star in another component that share one of the probe's size - asked + 1 rarest shingles outside the centre.

    stars holds what all members have outside, often how many have a shingle; one that is not in often can't be shared, or is counted in with the centre.
    """
    probes = probes.withColumn("take", F.col("size") - F.col("asked") + 1).where("take > 0").select("a", "b", "take", "size")
    listed = outer(stars.join(probes.select("a", "b"), ["a", "b"], "left_semi")).join(often, ["a", "s"]).join(probes, ["a", "b"])
    # Shingles that no other member has can't meet one, but count in the number to take: they are the rarest.
    order = Window.partitionBy("a", "b").orderBy("often", "s")
    listed = listed.withColumns({"rank": F.row_number().over(order), "shared": F.count("*").over(Window.partitionBy("a", "b"))})
    listed = owned(listed.where(F.col("size") - F.col("shared") + F.col("rank") <= F.col("take")), comps, "b")
    taken = listed.select("a", "s").distinct()
    stored = owned(outer(stars.join(probes.select("a").distinct(), "a", "left_semi")).join(taken, ["a", "s"], "left_semi"), comps, "b")
    p, q = listed.alias("p"), stored.alias("q")
    near = (F.col("p.b_comp") != F.col("q.b_comp")) & _can_link("p.b_n", "q.b_n")
    meet = p.join(q, (F.col("p.a") == F.col("q.a")) & (F.col("p.s") == F.col("q.s")) & (near if only is None else near & only))
    return meet.select(F.least("p.b", "q.b").alias("a"), F.greatest("p.b", "q.b").alias("b")).distinct()


def linking(found: DataFrame) -> DataFrame:
    return found.where(F.col("common") * 100 >= (F.col("a_n") + F.col("b_n") - F.col("common")) * PERCENT).select("a", "b")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(cls, comp): the smallest class of each connected component of the links and of known components, by alternating large and small stars."""
    spark = links.sparkSession
    if known is not None:
        links = links.union(known.select("cls", "comp"))
    edges = saved(spark, links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        seen, before = Observation(), edges
        edges = saved(spark, small.select("e.a", "e.b").where("a != b").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "edges")
        dropped(before)
        if (now := (seen.get["n"], seen.get["s"])) == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("cls")).distinct().select("cls", F.col("cls").alias("comp"))
    out = saved(spark, edges.select(F.col("a").alias("cls"), F.col("b").alias("comp")).union(roots), "components")
    dropped(edges)
    return out


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    join = Join(docs)
    comps = join.run()
    rows = join.rows.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = rows.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest id; of rows that repeat an id and text one. Rows without doc_id stay, once for each text, where their component has no id."""
    found = linked(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    # Texts are dealt by doc_id once, for the join and for what repeats.
    kept = docs.join(found.where("doc_id is not null"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    without = docs.where("doc_id is null").crossJoin(F.broadcast(found.where("doc_id is null").select(F.lit(1).alias("__any")))).drop("__any")
    return kept.select(*docs.columns).union(without.select(*docs.columns).dropDuplicates(["text"]))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


ORACLE = """
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda w: w <> '') w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) g from d),
e as (select doc_id, len(g) n, unnest(g) x from s),
c as (select a.doc_id a, b.doc_id b, a.n an, b.n bn, count(*) k from e a join e b on a.x = b.x and a.doc_id < b.doc_id and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 75 group by all),
l as (select a, b from c where 100 * k >= 75 * (an + bn - k)),
u as (select a, b from l union all select b, a from l),
r(doc_id, m) as (select doc_id, doc_id from s union select u.b, r.m from r join u on u.a = r.doc_id)
select s.doc_id, len(g)::bigint n_shingles, (select min(m) from r where r.doc_id = s.doc_id)::bigint component_id from s"""
