"""Quality rules with tokeniser fertility: characters a token, byte-fallback share and token entropy.

A public vocabulary with byte fallback cuts each word; a text whose fertility lies outside its bands is rejected,
after the base rules (too few words, too many repeated 8-word windows). Counts cover the whole text.

There are fixed outer bands by script, and one of each figure by language (by script where the language is null),
from all documents of that language that the base rules pass: a middle and BAND scaled median deviations around it.
Characters a token and byte share have their median as middle, and a width that is wider for fewer tokens as a mean's
spread is; byte share is bounded above only. Entropy rises with the number of tokens n, close to a line in 1/sqrt(n):
its middle is that line by least squares, set at the median. Medians come from a bounded quantile sketch.

A language of fewer than LEAST_DOCS such documents takes the bands of all documents of its script. A script of fewer has
its own middles, as those of other scripts would reject all of it, but at least the widths and the slope of all documents.

Words are runs of other characters than x20 and x09 to x0D. Results for odd input: null text has no words, fails the
base rules and is not kept; repeated rows give equal rows; an empty table gives an empty one; a column that has the
name of a new one is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import SPACE, appended, field, vocabulary
from palimpsest.runtime import saved, table

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
WINDOW, FEW_WORDS, REPEATED_PERCENT = 8, 20, 30
#: Entries of a worker's word cache and characters handled at once; both only bound memory.
ENTRIES, CHUNK = 400_000, 3_000_000

#: Per script: least and most characters a token, most byte-fallback share, least and most token entropy in bits.
#: Below MIN_TOKENS tokens the least entropy falls as the highest that can be reached does, log2 of the tokens.
BANDS = {
    "latin": (1.55, 6.0, 0.10, 4.2, 11.5),
    "cyrillic": (1.2, 6.0, 0.15, 4.2, 11.5),
    "greek": (0.8, 6.0, 0.30, 3.6, 11.5),
    "cjk": (0.3, 4.0, 0.60, 3.6, 12.5),
    "other": (0.3, 6.0, 0.80, 3.0, 12.5),
}
MIN_TOKENS = 200
#: Half width of a language's band in scaled median deviations, and the documents that one needs.
BAND, LEAST_DOCS = 5.0, 50
#: Bands up to which they are broadcast.
MOST_KEYS = 10_000
#: Least scaled deviations of entropy in bits and of byte share times sqrt(tokens), where nearly all documents are alike; the
#: latter is the spread of one byte piece in 64, in runs of four.
LEAST_BITS, LEAST_BYTES = 0.02, 0.25
#: First and last code point of the letters by which a script is told.
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("cjk", 0x3040, 0x9FFF), ("cjk", 0xAC00, 0xD7AF))


class Fertility:
    """A worker's tokenizer with a bounded cache from word to its pieces."""

    def __init__(self, raw: bytes) -> None:
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.byte = np.array([self.tok.is_byte(i) or self.tok.is_unknown(i) for i in range(self.tok.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        found = self.tok.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.lens = np.concatenate([self.lens, np.fromiter(map(len, found), np.int64, len(found))])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.int64)])

    def measure(self, texts: list[str]) -> dict[str, np.ndarray]:
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.index) > ENTRIES:
            self.clear()
        if fresh := list({w for x in words for w in x if w not in self.index}):
            self.learn(fresh)
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        index = np.fromiter((self.index[w] for x in words for w in x), np.int64, int(n_words.sum()))
        doc = np.repeat(np.arange(len(words)), n_words)
        lens = self.lens[index]
        begin = (np.cumsum(self.lens) - self.lens)[index]
        ids = self.ids[np.arange(lens.sum()) + np.repeat(begin - (np.cumsum(lens) - lens), lens)]
        tokens = np.bincount(doc, lens, len(words))
        owner = np.repeat(doc, lens)
        in_bytes = np.bincount(owner, self.byte[ids], len(words))
        key, count = np.unique(owner * len(self.byte) + ids, return_counts=True)
        of = key // len(self.byte)
        p = count / np.maximum(tokens[of], 1)
        entropy = np.bincount(of, -p * np.log2(p), len(words))
        return {"n_words": n_words, "tokens": tokens, "in_bytes": in_bytes, "entropy": entropy, "repeated": repeated(index, doc, len(words))}


def repeated(index: np.ndarray, doc: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Per document the words inside a window that its text has twice or more. Windows are numbered exactly, by doubling."""
    if len(index) < window:
        return np.zeros(n, np.int64)
    gram, span = np.unique(index, return_inverse=True)[1].astype(np.int64), 1
    while span < window:
        pair = gram[: len(gram) - span] * (int(gram.max()) + 1) + gram[span:]
        gram = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span *= 2
    start = np.flatnonzero(doc[: len(gram)] == doc[window - 1 :])
    _, where, count = np.unique(doc[start] * (int(gram.max()) + 1) + gram[start], return_inverse=True, return_counts=True)
    twice = start[count[where] > 1]
    edge = np.zeros(len(index) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return np.bincount(doc, np.cumsum(edge[:-1]) > 0, n).astype(np.int64)


def script_of(text: str) -> str:
    """The script of most letters outside ASCII and the Latin blocks, if those outweigh the Latin ones; else Latin."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts: dict[str, int] = {}
    for name, a, b in SCRIPTS:
        counts[name] = counts.get(name, 0) + int(((points >= a) & (points <= b)).sum())
    counts["other"] = int((points > 0x24F).sum()) - sum(v for k, v in counts.items() if k != "latin")
    return max(counts, key=counts.get)


def dup_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            n += line in seen
            seen.add(line)
    return n


def measured(df: DataFrame, text: str = "text", path: str | None = None, bands: dict[str, tuple] | None = None) -> DataFrame:
    """df with the base counts, the fertility figures, base_failed and kept, the verdict of base rules and outer bands."""
    raw, bands = df.sparkSession.sparkContext.broadcast(vocabulary(path, VOCABULARY)), bands or BANDS
    fields = [field(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [field(n, T.BooleanType()) for n in ("base_failed", "kept")]
    fields += [field("script", T.StringType()), *(field(n, T.DoubleType()) for n in ("chars_per_token", "byte_share", "token_entropy", "n_pieces"))]

    def make():
        own = Fertility(raw.value)

        def some(texts: list[str]) -> list[list]:
            m = own.measure(texts)
            chars = np.array([len(t) - sum(map(t.count, SPACE)) for t in texts])
            symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
            scripts = [script_of(t) for t in texts]
            tokens = np.maximum(m["tokens"], 1)
            ratio, share, entropy = chars / tokens, m["in_bytes"] / tokens, m["entropy"]
            low, high, most, least_e, most_e = np.array([bands[s] for s in scripts]).reshape(-1, 5).T
            failed = (m["n_words"] < FEW_WORDS) | (100 * m["repeated"] > REPEATED_PERCENT * m["n_words"])
            fine = (ratio >= low) & (ratio <= high) & (share <= most)
            fine &= (entropy >= least_e * np.minimum(1, np.log2(tokens) / np.log2(MIN_TOKENS))) & (entropy <= most_e)
            return [m["n_words"], chars, symbols, [dup_lines(t) for t in texts], m["repeated"], failed, ~failed & fine, scripts, ratio, share, entropy, m["tokens"]]

        def work(values):
            texts = [t or "" for t in values[text].to_pylist()]
            out, at, size = [[] for _ in fields], 0, 0
            for i, t in enumerate([*texts, None]):
                if t is None or size > CHUNK:
                    for column, made in zip(out, some(texts[at:i]), strict=True):
                        column.extend(made.tolist() if isinstance(made, np.ndarray) else made)
                    at, size = i, 0
                size += len(t or "")
            return out

        return work

    return appended(df, [text], fields, make)


def small(bands: DataFrame) -> DataFrame:
    """A table of a row for each language or script, sent to all tasks where it has MOST_KEYS rows at most; else the engine chooses."""
    return F.broadcast(bands) if bands.limit(MOST_KEYS + 1).count() <= MOST_KEYS else bands


def quality(df: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each of df (doc_id, text, lang): the base counts, the figures and the verdict by both bands."""
    rows = saved(df.sparkSession, measured(df.select("doc_id", "text", "lang"), path=path).drop("text"), "quality")
    # Bands are fitted for each language, for each script and for all documents; a key has what it is and its name.
    keys = F.array(F.concat(F.lit("lang "), F.coalesce("lang", F.lit(""))), F.concat(F.lit("script "), F.col("script")), F.lit("all"))
    usual = rows.where(~F.col("base_failed")).withColumn("key", F.explode(F.when(F.col("lang").isNull(), F.slice(keys, 2, 2)).otherwise(keys)))
    root = F.sqrt("n_pieces")
    median = lambda x: F.percentile_approx(x, 0.5, 1000)
    wide = lambda x: median(F.abs(x)) * 1.4826
    line = F.coalesce(F.regr_slope("token_entropy", 1 / root), F.lit(0.0))
    # Saved, so that these tables of a row for each key are known to be small and are not made anew.
    middle = usual.groupBy("key").agg(median("chars_per_token").alias("middle"), median("byte_share").alias("share"), line.alias("slope"), F.count("*").alias("n"))
    middle = saved(df.sparkSession, middle.where((F.col("n") >= LEAST_DOCS) | ~F.col("key").startswith("lang ")), "quality-line")
    every = middle.where("key = 'all'").select(F.col("slope").alias("all_slope"))
    middle = middle.crossJoin(every).withColumn("slope", F.when(F.col("n") >= LEAST_DOCS, F.col("slope")).otherwise(F.col("all_slope"))).drop("all_slope")
    off, over, rest = (F.col("chars_per_token") - F.col("middle")) * root, (F.col("byte_share") - F.col("share")) * root, F.col("token_entropy") - F.col("slope") / root
    width = usual.join(small(middle), "key").groupBy("key").agg(wide(off).alias("most"), wide(over).alias("most_over"), median(rest).alias("bits"))
    bands = saved(df.sparkSession, middle.join(width, "key"), "quality-middle")
    bent = F.abs(rest - F.col("bits"))
    bands = bands.join(usual.join(small(bands), "key").groupBy("key").agg(wide(bent).alias("most_bent")), "key")
    bands = saved(df.sparkSession, bands, "quality-width")
    widths = ("most", "most_over", "most_bent")
    every = bands.where("key = 'all'").select(*(F.col(c).alias(f"all_{c}") for c in widths))
    bands = bands.crossJoin(every).withColumns({c: F.when(F.col("n") >= LEAST_DOCS, F.col(c)).otherwise(F.greatest(c, f"all_{c}")) for c in widths})
    inside = (F.abs(off) <= BAND * F.col("most")) & (over <= BAND * F.greatest("most_over", F.lit(LEAST_BYTES))) & (bent <= BAND * F.greatest("most_bent", F.lit(LEAST_BITS)))
    known = bands.where(F.col("key").startswith("lang ")).select("key", F.lit(True).alias("known"))
    rows_key = rows.withColumn("key", keys[0]).join(small(known), "key", "left").withColumn("key", F.when(F.col("known") & F.col("lang").isNotNull(), F.col("key")).otherwise(keys[1]))
    return rows_key.join(small(bands), "key", "left").withColumn("kept", F.col("kept") & F.coalesce(inside, F.lit(True))).select([c for c in rows.columns if c not in ("lang", "n_pieces")])


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
