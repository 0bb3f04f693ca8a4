"""Token counts by a linear longest-match automaton.

A trie holds the vocabulary twice: pieces that begin a word and pieces that go on with one. Each node has a failure
link to the node where matching goes on once the longest match so far is cut off, and the precomputed number of
pieces that this cuts off. A word is read once, byte by byte, with no piece built and no step back.

A word is a run of other characters than x20 and x09 to x0D; its first piece comes from the entries that begin with
a space mark, its others from the rest. All 256 bytes are entries, so every word has a count. Null and empty texts
count 0 words and 0 tokens; repeated rows give equal rows; an empty table gives an empty one.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.common import appended, field, held, vocabulary
from palimpsest.runtime import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words that a worker's cache may hold, and the longest of them in bytes.
ENTRIES, LONGEST = 500_000, 64


class Automaton:
    """Node 0 begins a word, node 1 goes on with one."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.go: list[dict[int, int]] = [{}, {}]
        token, parent, byte = [False, False], [0, 0], [0, 0]
        for p in pieces:
            for root in (0,) if p[:1] == b" " and len(p) > 1 else (1, 0) if p == b" " else (1,):
                v = root
                for c in p:
                    if c not in self.go[v]:
                        self.go[v][c] = len(self.go)
                        self.go.append({})
                        token.append(False)
                        parent.append(v)
                        byte.append(c)
                    v = self.go[v][c]
                token[v] = True
        self.fail, self.pops = [1] * len(self.go), [0] * len(self.go)
        level = [v for root in (0, 1) for v in self.go[root].values()]
        while level:
            for v in level:
                if token[v]:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, n, c = self.fail[parent[v]], self.pops[parent[v]], byte[v]
                while c not in self.go[z]:
                    n += self.pops[z]
                    z = self.fail[z]
                self.fail[v], self.pops[v] = self.go[z][c], n
            level = [w for v in level for w in self.go[v].values()]

    def count(self, word: bytes) -> int:
        """Pieces of one word; the space mark before it is read first."""
        go, fail, pops = self.go, self.fail, self.pops
        n, v = 0, go[0][32]
        for c in word:
            w = go[v].get(c)
            while w is None:
                n += pops[v]
                v = fail[v]
                w = go[v].get(c)
            v = w
        while v != 1:
            n += pops[v]
            v = fail[v]
        return n


class Counts(dict):
    """Word to count; forgets all once it is full."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(word) <= LONGEST:
            if len(self) >= ENTRIES:
                self.clear()
            self[word] = n
        return n


def token_counts(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with n_words and n_tokens (long) of the whole text. The vocabulary is a file of public ranks."""
    raw = df.sparkSession.sparkContext.broadcast(vocabulary(path, VOCABULARY))

    def make():
        counts = held(("counts", hash(raw.value)), lambda: Counts(Automaton([base64.b64decode(x.split()[0]) for x in raw.value.splitlines() if x])))

        def work(values):
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in values[text].to_pylist()]
            return [[len(w) for w in words], [sum(map(counts.__getitem__, w)) for w in words]]

        return work

    return appended(df, [text], [field("n_words", T.LongType()), field("n_tokens", T.LongType())], make)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens")
