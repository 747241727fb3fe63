"""Quality rules on tokeniser fertility, with rejection bands learnt per language or script.

Each word of a whole text is encoded by two public vocabularies.  Their
characters per token (fertility), the share of tokens that fall back to bytes,
and the entropy of the token distribution tell running text from symbol soup,
shouting, tables and loops.  What is usual differs by language, so the bands
come from the quartiles of all documents of a language, or of a script where
no language is given; short texts get wider bands.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkprint.llm.common import materialise, texts

SYMBOLS = b"#*$%&|<>"
#: Bands are broadcast up to this many languages and scripts, and joined by a shuffle beyond.
BROADCAST_ROWS = 10_000
METRICS = ("piece_chars", "bpe_chars", "byte_share", "entropy")
#: UTF-8 lead bytes that start the letters of a script, in the order tried.
SCRIPTS = {"Latn": (0x41, 0x5B, 0x61, 0x7B, 0xC3, 0xCA), "Grek": (0xCD, 0xD0), "Cyrl": (0xD0, 0xD4), "Hebr": (0xD6, 0xD8), "Arab": (0xD8, 0xDC), "Deva": (0xE0, 0xE1), "Kana": (0xE3, 0xE4), "Hani": (0xE4, 0xEA), "Hang": (0xEA, 0xEE)}


@dataclass(frozen=True)
class Bands:
    """Half-width of a band in interquartile ranges: ``wide + short / sqrt(tokens)``."""

    wide: float = 4.0
    short: float = 40.0
    entropy_wide: float = 3.0
    entropy_short: float = 20.0
    #: A byte-fallback share this far over the upper quartile is always let pass.
    byte_slack: float = 0.1
    #: Least interquartile range, as a share of the median.
    least: float = 0.01
    #: Bins of a measure for each unit.
    steps: int = 1000


class Fertility:
    """Word measures under both vocabularies, remembered for recent words."""

    def __init__(self, pieces: str, ranks: str, pattern: str, cache: int = 300_000):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.cache = cache
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        #: characters, second-vocabulary tokens, and where a word's piece ids end; then the ids
        self.tables = [np.zeros(1 << 12, np.int32) for _ in range(4)]
        self.filled = [0, 0, 1, 0]

    def _extend(self, which: int, values: np.ndarray) -> None:
        table, n = self.tables[which], self.filled[which]
        while n + len(values) > len(table):
            table = self.tables[which] = np.concatenate((table, np.zeros_like(table)))
        table[n : n + len(values)] = values
        self.filled[which] = n + len(values)

    def _learn(self, words: list[bytes]) -> None:
        strings = [w.decode() for w in words]
        pieces = self.pieces.encode(strings, num_threads=1)
        seconds = [self.bpe.encode_ordinary(" " + s) for s in strings]
        base = len(self.index)
        self.index.update(zip(words, range(base, base + len(words))))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self._extend(0, np.fromiter(map(len, strings), np.int64, len(strings)))
        self._extend(1, np.fromiter(map(len, seconds), np.int64, len(seconds)))
        self._extend(2, self.filled[3] + np.cumsum(sizes))
        self._extend(3, np.fromiter((i for ids in pieces for i in ids), np.int64, int(sizes.sum())))

    def look_up(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Word indices of each text.  They hold until the next call."""
        new = {w for words in texts for w in words if w not in self.index}
        if self.index and len(self.index) + len(new) > self.cache:
            self._reset()
            new = {w for words in texts for w in words}
        if new:
            self._learn(list(new))
        get = self.index.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]

    def measure(self, at: np.ndarray) -> tuple[int, int, float, float, float, float]:
        """(characters, piece tokens, then METRICS) of a text given as word indices."""
        chars, second, start, ids = self.tables
        n_chars = int(chars[at].sum())
        begin, size = start[at], start[at + 1] - start[at]
        n = int(size.sum())
        if not n:
            return n_chars, 0, 0.0, 0.0, 0.0, 1.0
        taken = ids[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(n)]
        counts = np.bincount(taken)
        fallback = int(counts[self.is_byte[: len(counts)]].sum())
        share = counts[counts > 0] / n
        entropy = float(-(share * np.log2(share)).sum()) / np.log2(n) if n > 1 else 1.0
        return n_chars, n, n_chars / n, n_chars / max(1, int(second[at].sum())), fallback / n, entropy


@lru_cache(maxsize=1)
def _fertility(pieces: str, ranks: str, pattern: str) -> Fertility:
    return Fertility(pieces, ranks, pattern)


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words inside ``width``-word windows that occur at least twice, the first included; ``ids`` are equal for equal words."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    _, local = np.unique(ids, return_inverse=True)
    size = int(local.max()) + 1
    code = local[:n].copy()
    for k in range(1, width):
        if (int(code.max()) + 1) * size >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * size + local[k : k + n]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += twice
    edge[width : width + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, count = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            count += 1
        elif line and not line.isspace():
            seen.add(line)
    return count


def script(text: bytes) -> str:
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    best = max(SCRIPTS, key=lambda s: sum(int(counts[a:b].sum()) for a, b in zip(SCRIPTS[s][::2], SCRIPTS[s][1::2])))
    return best if any(counts[a:b].sum() for a, b in zip(SCRIPTS[best][::2], SCRIPTS[best][1::2])) else "Zyyy"


def _groups(items: Iterator[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts whose words are looked up together: about ``most`` bytes of them."""
    held, size = [], 0
    for item in items:
        held.append(item)
        size += len(item)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


_MEASURED = "doc_id {id}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_pieces long, piece_chars double, bpe_chars double, byte_share double, entropy double"


def measured(docs: DataFrame, pieces: str, ranks: str, pattern: str) -> DataFrame:
    """The base counts and the token measures of each document (doc_id, text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _fertility(pieces, ranks, pattern)
        for batch in batches:
            rows = []
            for group in _groups(texts(batch.column(2))):
                for text, at in zip(group, made.look_up([text.split() for text in group])):
                    chars, n, *rest = made.measure(at)
                    rows.append((len(at), chars, sum(text.count(c) for c in SYMBOL_BYTES), duplicate_lines(text), repeated_words(at), script(text), n, *rest))
            columns = list(zip(*rows)) if rows else [()] * 11
            kinds = [pa.int64()] * 5 + [pa.string(), pa.int64()] + [pa.float64()] * 4
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", "n_pieces", *METRICS]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "lang", *names])

    return docs.select("doc_id", F.col("lang").cast("string"), "text").mapInArrow(run, _MEASURED.format(id=docs.schema["doc_id"].dataType.simpleString()))


SYMBOL_BYTES = [SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))]


def bands(rows: DataFrame, steps: int) -> DataFrame:
    """Quartiles of each measure by language or script, over all rows with a token.

    Measures are counted in bins of 1 / ``steps`` first, so the result doesn't
    depend on how rows are dealt, and a quartile is found among the bins of a
    measure: no more than its range times ``steps``, however many rows there
    are.  It is the lower edge of the first bin that reaches its share of rows.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.floor(F.col(m) * steps).alias("bin")) for m in METRICS)))
    counts = rows.where("n_pieces > 0").select("usual", cells.alias("c")).groupBy("usual", "c.metric", "c.bin").agg(F.count("*").alias("n"))
    own = Window.partitionBy("usual", "metric")
    reached = counts.withColumns({"upto": F.sum("n").over(own.orderBy("bin")), "all": F.sum("n").over(own)})
    at = lambda m, q: F.min(F.when((F.col("metric") == m) & (F.col("upto") >= q * F.col("all")), F.col("bin"))) / steps
    return reached.groupBy("usual").agg(*(F.array(*(at(m, q) for q in (0.25, 0.5, 0.75))).alias(f"q_{m}") for m in METRICS))


def _outside(metric: str, widths: tuple[float, float], least: float, lower: bool, upper: bool, slack: float = 0.0) -> Column:
    low, mid, high = (F.col(f"q_{metric}")[i] for i in range(3))
    spread = F.greatest(high - low, F.abs(mid) * least)
    half = spread * (widths[0] + widths[1] / F.sqrt(F.greatest(F.col("n_pieces"), F.lit(1)).cast("double"))) + slack
    value, out = F.col(metric), F.lit(False)
    if lower:
        out = out | (value < mid - half)
    if upper:
        out = out | (value > mid + half)
    return out


def judge(docs: DataFrame, pieces: str, ranks: str, pattern: str, limits: Bands = Bands()) -> DataFrame:
    """Base counts, token measures and verdict for every row of ``docs`` (doc_id, text, lang).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and the measures.  ``base_failed``: under 10 words, or
    over a fifth of the words in repeated five-word windows.  ``kept`` is false
    if that failed or a measure lies outside its band.

    A null or blank text has no words, fails the base rule and shapes no band.  A
    null language stands for the text's script.  Very long texts are measured
    whole; their words are looked up text by text.  Repeated rows are judged
    each.  An empty table gives an empty result; other columns, whatever their
    names, are ignored.
    """
    rows = materialise(measured(docs, pieces, ranks, pattern).withColumn("usual", F.coalesce("lang", "script")), "measures")
    table = materialise(bands(rows, limits.steps), "bands")
    judged = rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, "usual", "left")
    wide, entropy = (limits.wide, limits.short), (limits.entropy_wide, limits.entropy_short)
    strange = (
        _outside("piece_chars", wide, limits.least, True, True)
        | _outside("bpe_chars", wide, limits.least, True, True)
        | _outside("byte_share", wide, limits.least, False, True, limits.byte_slack)
        | _outside("entropy", entropy, limits.least, True, False)
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~(F.col("base_failed") | F.coalesce(strange, F.lit(False))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "usual", "n_pieces", *METRICS)
