"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary of pieces.

Each language has a probability for each piece. A word's probability is the sum over all its segmentations into
pieces, by a forward algorithm; a text's is the product over its words. Piece probabilities are expected counts from
forward-backward passes over the word counts of the training rows (ROUNDS of EM from equal probabilities).

Training rows: those whose crc32(doc_id as text) mod 4 is not 2 and whose lang is not null; of these, for each
language, the texts of the rows with the smallest md5 of doc_id, at most about SAMPLE rows and then TRAIN_WORDS
distinct words (both documented bounds of the fit; every document is scored over its whole text).

Results for odd input: null text or text without a letter gives `und` with score 0; an empty training set gives `und`
for all; repeated rows give equal rows; an empty table gives an empty one; equal scores go to the first language in
alphabetical order.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import appended, field, held, vocabulary
from palimpsest.runtime import saved, table

VOCABULARY = "piece_bpe_32k.model"
SAMPLE, TRAIN_WORDS, ROUNDS = 3000, 20_000, 3
#: Languages up to which their counts are broadcast.
MOST_LANGUAGES = 10_000
#: Weight of the even distribution in each language's, chance of a character that no piece has, longest piece in characters.
SMOOTH, UNKNOWN, LONGEST_PIECE = 1e-3, 1e-7, 8
ENTRIES, LONG_WORD = 300_000, 48
LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"


def pieces_of(raw: bytes) -> dict[str, int]:
    """Lower-case pieces of letters and the word mark, numbered from 1; 0 stands for no piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    fine = sorted(p for p in found if len(p) <= LONGEST_PIECE and (p == MARK or LETTERS.fullmatch(p.removeprefix(MARK))))
    return {p: i + 1 for i, p in enumerate(fine)}


def prefixes(pieces: dict[str, int]) -> frozenset[str]:
    return frozenset(p[:k] for p in pieces for k in range(1, len(p) + 1))


def lattice(words: list[str], pieces: dict[str, int], begins: frozenset[str]) -> np.ndarray:
    """edges[w, j, k]: the piece of k+1 characters that ends before position j+1 of word w, all words of one length."""
    n = len(words[0])
    where, found = [], []
    get = pieces.get
    for w, word in enumerate(words):
        base = w * n
        for i in range(n):
            for j in range(i + 1, min(i + LONGEST_PIECE, n) + 1):
                part = word[i:j]
                if part not in begins:
                    break
                if p := get(part):
                    where.append((base + j - 1) * LONGEST_PIECE + j - i - 1)
                    found.append(p)
    edges = np.zeros(len(words) * n * LONGEST_PIECE, np.int32)
    edges[where] = found
    return edges.reshape(len(words), n, LONGEST_PIECE)


def forward(edges: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[w, j, language], scaled by exp(-log of each step's sum), and the log probability of each word. probs[0] is 0."""
    words, n, longest = edges.shape
    langs = probs.shape[1]
    alpha, log = np.zeros((n + 1, words, langs)), np.zeros((words, langs))
    alpha[0] = 1.0
    for j in range(1, n + 1):
        total = UNKNOWN * alpha[j - 1]
        for k in range(min(longest, j)):
            total += alpha[j - 1 - k] * probs[edges[:, j - 1, k]]
        log += np.log(total)
        alpha[max(0, j - longest) : j] /= total  # what comes after is counted from here
        alpha[j] = 1.0
    return alpha, log


def expected(edges: np.ndarray, weights: np.ndarray, probs: np.ndarray, size: int) -> np.ndarray:
    """Expected counts of the pieces over all segmentations, for one language; unscaled, as training words are short."""
    words, n, longest = edges.shape
    p = probs[edges]
    alpha, beta = np.zeros((n + 1, words)), np.zeros((n + 1, words))
    alpha[0] = beta[n] = 1.0
    for j in range(1, n + 1):
        alpha[j] = UNKNOWN * alpha[j - 1]
        for k in range(min(longest, j)):
            alpha[j] += alpha[j - 1 - k] * p[:, j - 1, k]
    for j in range(n - 1, -1, -1):
        beta[j] = UNKNOWN * beta[j + 1]
        for k in range(min(longest, n - j)):
            beta[j] += beta[j + 1 + k] * p[:, j + k, k]
    out = np.zeros(size)
    for j in range(1, n + 1):
        for k in range(min(longest, j)):
            share = alpha[j - 1 - k] * p[:, j - 1, k] * beta[j] / alpha[n]
            out += np.bincount(edges[:, j - 1, k], share * weights, size)
    out[0] = 0
    return out


def train(counts: dict[str, dict[str, int]], pieces: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """The languages in alphabetical order and probs[piece, language]."""
    langs, size, begins = sorted(counts), len(pieces) + 1, prefixes(pieces)
    probs = np.zeros((size, len(langs)))
    for n, lang in enumerate(langs):
        by_length: dict[int, list[str]] = {}
        for w in sorted(counts[lang]):
            if len(w) < LONG_WORD:
                by_length.setdefault(len(w) + 1, []).append(MARK + w)
        parts = [(lattice(w[i : i + 4000], pieces, begins), np.array([counts[lang][x[1:]] for x in w[i : i + 4000]], float)) for w in by_length.values() for i in range(0, len(w), 4000)]
        own = np.full(size, 1.0 / len(pieces))
        own[0] = 0
        for _ in range(ROUNDS):
            found = sum((expected(e, c, own, size) for e, c in parts), np.zeros(size))
            own = (1 - SMOOTH) * found / max(found.sum(), 1e-300) + SMOOTH / len(pieces)
            own[0] = 0
        probs[:, n] = own
    return langs, probs


class Scorer:
    """A worker's bounded cache from word to its log probability in each language."""

    def __init__(self, pieces: dict[str, int], probs: np.ndarray) -> None:
        self.pieces, self.probs, self.begins = pieces, probs, prefixes(pieces)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.logs = np.zeros((0, self.probs.shape[1]))

    def learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        logs, at = [], len(self.index)
        for n, group in by_length.items():
            step = max(1, 400_000 // ((n + 1) * LONGEST_PIECE))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                logs.append(forward(lattice([MARK + w for w in part], self.pieces, self.begins), self.probs)[1])
                self.index.update(zip(part, range(at, at + len(part)), strict=True))
                at += len(part)
        self.logs = np.concatenate([self.logs, *logs])

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and its letters."""
        if len(self.index) > ENTRIES:
            self.clear()
        words = [LETTERS.findall(t.lower()) for t in texts]
        if fresh := list({w for x in words for w in x if w not in self.index}):
            self.learn(fresh)
        n = np.fromiter(map(len, words), np.int64, len(words))
        index = np.fromiter((self.index[w] for x in words for w in x), np.int64, int(n.sum()))
        doc = np.repeat(np.arange(len(words)), n)
        return np.stack([np.bincount(doc, self.logs[index, k], len(words)) for k in range(self.probs.shape[1])], axis=1), n


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, raw: bytes) -> tuple[list[str], np.ndarray, dict[str, int]]:
    """Learns from docs (doc_id, text, lang). The driver gets at most TRAIN_WORDS words a language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # A row a language, saved so that its size is known; sent to all tasks while it is small, else the engine's choice.
    total = saved(docs.sparkSession, rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    total = F.broadcast(total) if total.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES else total
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    chosen = rows.join(total, "lang").where(F.coalesce(u, F.lit(0.0)) < share)
    words = chosen.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("c"))
    words = saved(docs.sparkSession, words.where(F.length("word") < LONG_WORD), "language-words")
    top = words.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "word"))).where(F.col("r") <= TRAIN_WORDS)
    counts: dict[str, dict[str, int]] = {}
    for lang, word, c in top.select("lang", "word", "c").toPandas().itertuples(index=False):
        counts.setdefault(lang, {})[word] = int(c)
    pieces = pieces_of(raw)
    langs, probs = train(counts, pieces)
    return langs, probs, pieces


def identify(docs: DataFrame, path: str | None = None, model: tuple | None = None) -> DataFrame:
    """docs with held_out, lang_pred and score, the best language's share of the probability of an average word."""
    spark = docs.sparkSession
    langs, probs, pieces = model or fit(docs, vocabulary(path, VOCABULARY))
    key = uuid.uuid4().hex
    given = spark.sparkContext.broadcast((langs, probs.astype(np.float32), pieces))  # vocabulary times languages, whatever the number of documents

    def make():
        names, table_, known = given.value
        own = held(key, lambda: Scorer(known, table_.astype(np.float64)))

        def work(values):
            texts = [t or "" for t in values["text"].to_pylist()]
            if not names:
                return [["und"] * len(texts), [0.0] * len(texts)]
            logs, n = own.scores(texts)
            mean = logs / np.maximum(n, 1)[:, None]
            odds = np.exp(mean - mean.max(axis=1, keepdims=True))
            best = mean.argmax(axis=1)
            score = odds[np.arange(len(best)), best] / odds.sum(axis=1)
            return [[names[b] if k else "und" for b, k in zip(best, n, strict=True)], np.where(n > 0, score, 0.0).tolist()]

        return work

    found = appended(docs, ["text"], [field("lang_pred", T.StringType()), field("score", T.DoubleType())], make)
    return found.withColumn("held_out", held_out(F.col("doc_id")))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
