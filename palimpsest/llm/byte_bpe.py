"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one set for each Arrow batch of a partition.

A batch's distinct pre-tokens become token-position rows. One recursive query joins neighbouring tokens with the
merge table and contracts each word's leftmost pair of minimum rank until no word has a pair left. Decoding joins
token positions with the vocabulary and puts the bytes together by an ordered aggregation.

Results for odd input: null text counts as empty and gives no tokens; repeated rows give equal rows; an empty table
gives an empty one; a column that has the name of the new one is replaced, others pass through. Texts are taken whole;
a pre-token over LONG bytes goes through the same step in a loop that keeps one state instead of all of them, so its
memory is linear in its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import appended, field, held, settle, vocabulary
from palimpsest.runtime import table

VOCABULARY = "byte_bpe_50k.tiktoken"
LONG = 512
#: Bytes of pre-tokens in one recursive query, entries of a worker's cache and bytes of one; they only bound memory.
CHUNK, ENTRIES, KEPT = 250_000, 400_000, 512
#: Bytes of texts whose digests are made at once; it only bounds memory.
SLICE = 1_000_000
#: White space; where none meets other white space or an end of the text, each single space or newline is a pre-token boundary.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNEVEN = rf"{BLANK}{BLANK}|\A{BLANK}|{BLANK}\z"
#: Mark between units; UTF-8 never holds this byte.
MARK = b"\xff"

STATES = """
with recursive state(done, g, tok, len) as (
  select false, g, tok, 1::bigint from start_rows
  union all
  select done, g, tok, len from (
    with pairs as (
      select g, tok, len, lead(g) over o as next_g, lead(tok) over o as next_tok, lead(len) over o as next_len
      from state where not done window o as (order by g)
    ), ranked as (
      select p.g, p.tok, p.len, p.next_len, m.rank
      from pairs p left join merges m on m.pair = ((p.tok << 20) | p.next_tok) and (p.next_g >> 20) = (p.g >> 20)
    ), best as (
      select g >> 20 as w, min((rank << 40) | ((g & 1048575) << 20) | len) as b from ranked group by 1
    ), hit as (
      select w, b >> 40 as rank, (w << 20) | ((b >> 20) & 1048575) as g,
             (w << 20) | (((b >> 20) & 1048575) + (b & 1048575)) as gone
      from best
    )
    select h.rank is null as done, r.g, case when r.g = h.g then h.rank else r.tok end as tok,
           case when r.g = h.g then r.len + r.next_len else r.len end as len
    from ranked r join hit h on h.w = (r.g >> 20) where h.gone is null or r.g <> h.gone
  )
)
select g >> 20 as w, list(tok order by g) as ids from state where done group by 1 order by 1
"""

STEP = """
create or replace temp table long_next as
with pairs as (
  select w, pos, tok, lead(tok) over o as next_tok, row_number() over o as i from long_state window o as (partition by w order by pos)
), ranked as (
  select p.*, m.rank, m.safe from pairs p left join merges m on m.pair = ((p.tok << 20) | p.next_tok)
), low as (
  select w, min(rank) as rank from ranked group by w
), hits as (
  select w, i, rank, safe, row_number() over (partition by w order by i) as nth from ranked join low using (w, rank)
), taken as (
  select w, i, rank from (select *, row_number() over (partition by w, i - nth order by i) as k from hits) where k % 2 = 1 and (safe or nth = 1)
)
select r.w, r.pos, coalesce(t.rank, r.tok) as tok
from ranked r left join taken t on t.w = r.w and t.i = r.i left join taken b on b.w = r.w and b.i = r.i - 1
where b.i is null
"""

DECODE = """
select t.doc, unhex(string_agg(v.hex, '' order by t.pos)) as bytes
from tokens t join vocab v on v.id = t.id group by t.doc
"""


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every split of a token into two tokens, with the token's rank, and whether no merge of that token with a neighbour has a lower one."""
    pair, rank, least = [], [], {}
    for t, r in ranks.items():
        for i in range(1, len(t)):
            a, b = ranks.get(t[:i]), ranks.get(t[i:])
            if a is not None and b is not None:
                pair.append((a << 20) | b)
                rank.append(r)
                least[a], least[b] = min(r, least.get(a, r)), min(r, least.get(b, r))
    safe = [least.get(r, r + 1) > r for r in rank]
    return pa.table({"pair": pa.array(pair, pa.int64()), "rank": pa.array(rank, pa.int64()), "safe": safe})


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Codec:
    """A worker's DuckDB connection with the merge table and the vocabulary, and its bounded cache."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks, self.merging = ranks_of(raw), False
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.create("vocab", pa.table({"id": pa.array(self.ranks.values(), pa.int64()), "hex": [t.hex() for t in self.ranks]}))
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def create(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"create table {name} as select * from given")
        self.db.unregister("given")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as packed int32, by the recursive query."""
        out: list[bytes] = []
        at, size = 0, 0
        for i, w in enumerate(words):
            if size and size + len(w) > CHUNK:
                out += self._contract(words[at:i])
                at, size = i, 0
            size += len(w)
        return out + self._contract(words[at:]) if at < len(words) else out

    def _contract(self, words: list[bytes]) -> list[bytes]:
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        w = np.repeat(np.arange(len(words)), lens)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        self.db.register("start_rows", pa.table({"g": (w << 20) | pos, "tok": self.byte[flat]}))
        ids = self.db.sql(STATES).to_arrow_table()["ids"].combine_chunks()
        self.db.unregister("start_rows")
        ends, flat_ids = ids.offsets.to_numpy(), ids.values.to_numpy().astype(np.int32)
        return [flat_ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def contract_long(self, words: list[bytes]) -> list[bytes]:
        """The same for long pre-tokens, keeping one state instead of all: a step contracts each word's places of its minimum-rank pair from left to right.

        Where a merge of the new token may have a lower rank, which would come before the next place, only the leftmost is contracted.
        """
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        tok = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        self.db.register("given_long", pa.table({"w": np.repeat(np.arange(len(words)), lens), "pos": np.arange(len(tok)), "tok": tok}))
        self.db.execute("create or replace temp table long_state as select * from given_long")
        self.db.unregister("given_long")
        count = len(tok)
        while True:
            self.db.execute(STEP)
            self.db.execute("drop table long_state; alter table long_next rename to long_state")
            left = self.db.execute("select count(*) from long_state").fetchall()[0][0]
            if left == count:
                break
            count = left
        found = self.db.sql("select w, list(tok order by pos) as ids from long_state group by w order by w").to_arrow_table()["ids"].combine_chunks()
        self.db.execute("drop table long_state")
        ends, flat = found.offsets.to_numpy(), found.values.to_numpy().astype(np.int32)
        return [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def unit_lists(self, texts: pa.Array) -> pa.Array:
        """Lists of pieces of the texts that begin and end where pre-tokens do."""
        uneven = pc.match_substring_regex(texts, UNEVEN)
        marked = pc.replace_substring(texts.cast(pa.large_binary()), b" ", MARK + b" ")
        marked = pc.replace_substring(marked, b"\n", MARK + b"\n" + MARK)
        marked = pc.replace_substring_regex(marked, b"([A-Za-z])([.,;:!?])", b"\\1" + MARK + b"\\2")  # a run of letters ends there
        slow = [MARK.join(x.encode() for x in self.split(t)) for t in texts.filter(uneven).to_pylist()]
        return pc.split_pattern(pc.replace_with_mask(marked, uneven, pa.array(slow, pa.large_binary())), MARK)

    def unit_ids(self, wanted: list[str]) -> list[bytes]:
        """Packed ids of each unit, from what is known or by contraction. A unit of one pre-token is known by the same key."""
        if not self.merging:  # a task that only decodes never needs them
            self.create("merges", merge_table(self.ranks))
            self.merging = True
        known = self.known
        found = list(map(known.get, wanted))
        missing = [i for i, f in enumerate(found) if f is None]
        parts = [self.split(wanted[i]) for i in missing]
        fresh = list({w for x in parts for w in x if w not in known})
        data = [w.encode() for w in fresh]
        short = [i for i, d in enumerate(data) if len(d) <= LONG]
        words = dict(zip((fresh[i] for i in short), self.contract([data[i] for i in short]), strict=True))
        if len(short) < len(fresh):
            long = [i for i, d in enumerate(data) if len(d) > LONG]
            words.update(zip((fresh[i] for i in long), self.contract_long([data[i] for i in long]), strict=True))
        for i, x in zip(missing, parts, strict=True):
            found[i] = b"".join([words.get(w) or known[w] for w in x])
        if len(known) + len(words) > ENTRIES:
            known.clear()
        known.update((w, v) for w, v in words.items() if len(v) <= KEPT)
        return found

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of each text."""
        lists = self.unit_lists(pa.array([t or "" for t in texts], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        found = self.unit_ids(coded.dictionary.cast(pa.large_string()).to_pylist())
        every, size = np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4
        code = coded.indices.to_numpy()
        count = size[code]
        ends = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat((np.cumsum(size) - size)[code] - ends[:-1], count) + np.arange(ends[-1])
        return pa.ListArray.from_arrays(pa.array(ends[lists.offsets.to_numpy()], pa.int32()), pa.array(every[at], pa.int32()))

    def decode(self, ids: pa.Array) -> list[bytes | None]:
        """Bytes of each list of ids, by the ordered aggregation; null stays null."""
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        out: list[bytes | None] = [b"" if ok else None for ok in ids.is_valid().to_pylist()]
        lens = np.array([n or 0 for n in pc.list_value_length(ids).to_pylist()], dtype=np.int64)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lens)), lens)
        for a in range(0, len(flat), 4_000_000):
            part = slice(a, a + 4_000_000)
            self.db.register("tokens", pa.table({"doc": doc[part], "pos": np.arange(a, a + len(doc[part])), "id": flat[part].astype(np.int64)}))
            found = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("tokens")
            for d, b in zip(found["doc"].to_pylist(), found["bytes"].to_pylist(), strict=True):
                out[d] += b
        return out


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, about SLICE bytes at once; a longer text is one slice."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield texts.slice(a, b - a)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with array<int> `ids`: the BPE tokens of the whole text, without special tokens."""
    import public_tokenizers

    raw, pattern = df.sparkSession.sparkContext.broadcast(vocabulary(path, VOCABULARY)), public_tokenizers.PATTERN

    def make():
        own = held(("codec", hash(raw.value)), lambda: Codec(raw.value, pattern))

        def work(values):
            return [own.encode(values[text].to_pylist())]

        return work

    return appended(df, [text], [field(ids, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with binary `out`: the bytes of the ids, put together in order; null ids give null. Ids outside the vocabulary give no bytes."""
    import public_tokenizers

    raw, pattern = df.sparkSession.sparkContext.broadcast(vocabulary(path, VOCABULARY)), public_tokenizers.PATTERN

    def make():
        own = held(("codec", hash(raw.value)), lambda: Codec(raw.value, pattern))
        return lambda values: [own.decode(values[ids])]

    return appended(df, [ids], [field(out, T.BinaryType())], make, drop=drop)


def digests(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document the number of its ids, their digest and the digest of what they decode to, after the columns to keep."""
    import public_tokenizers

    raw, pattern = docs.sparkSession.sparkContext.broadcast(vocabulary(path, VOCABULARY)), public_tokenizers.PATTERN

    def make():
        own = held(("codec", hash(raw.value)), lambda: Codec(raw.value, pattern))

        def work(values):
            counts, told, back = [], [], []
            for texts in slices(values["text"]):
                ids = own.encode(texts.to_pylist())
                counts += pc.list_value_length(ids).to_pylist()
                told += [hashlib.sha256(b" ".join(map(b"%d".__mod__, x))).hexdigest() for x in map(np.ndarray.tolist, np.split(ids.values.to_numpy(), ids.offsets.to_numpy()[1:-1]))]
                back += [hashlib.sha256(x).hexdigest() for x in own.decode(ids)]
                del ids
                settle()
            return [counts, told, back]

        return work

    # One pass: encoding and decoding in two would keep two workers, with a codec each, for every task.
    fields = [field("n_tokens", T.LongType()), field("ids_sha256", T.StringType()), field("decoded_sha256", T.StringType())]
    return appended(docs.select("doc_id", "text", *keep), ["text"], fields, make, drop=("text",)).select("doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256")


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
