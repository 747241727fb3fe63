"""Byte-level BPE by backtracking from longest matches, in linear time.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over
the vocabulary finds every token occurrence in one pass.  A greedy tokenisation
takes the longest token at each place; it is the true merge result exactly if
every two adjacent tokens are compatible, i.e. merging their joint bytes gives
the two tokens back.  Where they aren't, the next shorter token is tried and,
with none left, the last token is taken back; places proven dead are marked,
so each is left at most once.  Compatibility is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkprint.llm.common import RecentCache, sliced, texts


#: Recent words whose ids are remembered.
CACHE = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64, rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class Encoder:
    """Encodes pieces of text by ranks; ``decode`` is its inverse."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.token[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        self.length = [len(token) for token in self.token]
        #: The longest other token that a token begins with, or -1.
        self.shorter = [-1] * len(self.token)
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        #: (left << 20 | right) -> whether the two may stand side by side.
        self.pairs: dict[int, bool] = {}
        self.most_pairs = cache * 5 // 3
        self.words, self.firsts, self.pieces = RecentCache(cache), RecentCache(20_000), RecentCache(cache // 4)

    def merge(self, piece: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint bytes of two tokens gives just these two; remembered in ``pairs``."""
        joint = self.token[left] + self.token[right]
        if len(self.pairs) > self.most_pairs:
            self.pairs.clear()
        found = self.pairs[left << 20 | right] = joint not in self.ranks and self.merge(joint) == [left, right]
        return found

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, length, shorter, pairs = len(piece), self.length, self.shorter, self.pairs
        longest = [-1] * (n + 1)
        for end, (back, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank  # ends ascend, so the last match from a place is its longest
        out: list[int] = []
        dead, at, take, last = bytearray(n + 1), 0, longest[0], -1
        while at < n:
            while take >= 0:
                if not dead[at + length[take]]:
                    if last < 0:
                        break
                    fits = pairs.get(last << 20 | take)
                    if fits or fits is None and self.compatible(last, take):
                        break
                take = shorter[take]
            if take >= 0:
                out.append(take)
                at += length[take]
                last, take = take, longest[at]
            elif out:
                dead[at] = 1
                take = out.pop()
                at -= length[take]
                last = out[-1] if out else -1
            else:
                return self.merge(piece)
        return out

    def _span(self, text: str) -> bytes:
        """Ids of any text, as little-endian unsigned 32-bit integers."""
        out = []
        for match in self.pattern.findall(text):
            ids = self.pieces.get(match)
            if ids is None:
                ids = np.array(self.piece(match.encode()), "<u4").tobytes()
                if len(match) < 256:
                    self.pieces.put(match, ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of ``text``, as little-endian unsigned 32-bit integers.

        A blank followed by something that is neither blank nor other white
        space begins a match, whatever is before it.  So the text is cut at
        single blanks, and the ids of each cut are remembered.  A text with
        other blanks at a cut is matched as a whole.
        """
        first, *rest = text.split(" ")
        if not rest:
            return self._span(text)
        head, out = self._head(first), list(map(self.words.new.get, rest))
        if head is None:
            return self._span(text)
        if None in out:
            words = self.words
            for at, ids in enumerate(out):
                if ids is None:
                    word = rest[at]
                    ids = words.get(word)
                    if ids is None:
                        if not word or word[0].isspace() or word[-1].isspace():
                            return self._span(text)
                        ids = self._span(" " + word)
                        if len(word) < 256:
                            words.put(word, ids)
                    out[at] = ids
        return head + b"".join(out)

    def _head(self, word: str) -> bytes | None:
        if not word or word[-1].isspace():
            return None
        ids = self.firsts.get(word)
        if ids is None:
            ids = self._span(word)
            if len(word) < 256:
                self.firsts.put(word, ids)
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, cache: int = CACHE) -> Encoder:
    """One encoder a worker process."""
    return Encoder(read_ranks(path), pattern, cache)


def encode_column(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Encode each whole text and decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``keep_ids`` adds the ids themselves; ``cache`` is how many recent words a
    worker remembers, at about 300 bytes each.  An empty table gives an empty
    result.  Null is the empty text: no ids, and
    the digests of nothing.  Very long texts and matches take time in proportion
    to their length.  Repeated rows are encoded each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path, pattern, cache)
        for batch in sliced(batches):
            counts, digests, decoded, kept = [], [], [], []
            for text in texts(batch.column(1)):
                ids = made.encode(text.decode())
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(made.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
