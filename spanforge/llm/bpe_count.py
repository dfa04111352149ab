"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

A text becomes a list of symbols (its characters, spaces written as U+2581 and one put in front). A heap holds
adjacent pairs that form a piece; the best-ranked pair (ties: the leftmost) is merged until none is left. Tokens
= initial symbols - merges, where a character the vocabulary lacks counts its UTF-8 bytes.

Texts are cut between two characters that no piece has side by side: no merge crosses such a place, so the parts'
counts add up. Frequent parts are remembered in a bounded cache.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
CACHE_PARTS = 300_000
MODEL_FILE = "piece_bpe_32k.model"


class PieceCounter:
    """Counts the pieces of texts from ``ranks`` (piece -> rank, lower merges first)."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks, self.cache = ranks, {}
        self.known = {p for p in ranks if len(p) == 1}
        self.pairs = {p[i : i + 2] for p in ranks for i in range(len(p) - 1)}
        self.space_starts = not any(a != SPACE and b == SPACE for a, b in self.pairs)
        self.line_alone = not any("\n" in p for p in self.pairs)

    @classmethod
    def load(cls, path: str) -> "PieceCounter":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        by_rank = sorted(usable, key=lambda i: (-model.get_score(i), i))
        return cls({model.id_to_piece(i): r for r, i in enumerate(by_rank)})

    def count(self, text: str) -> int:
        """Pieces of the whole text; an empty text has none."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.space_starts:
            return self._part(text)
        total, cache = 0, self.cache
        for line in text.split("\n") if self.line_alone else [text]:
            run = 0
            words = line.split(SPACE)
            if words[0]:
                total += self._head(words[0])
            for word in words[1:]:
                if word == "":
                    run += 1
                    continue
                n = cache.get(word) if not run else None
                if n is None:
                    n = self._part(SPACE * (run + 1) + word)
                    if not run:
                        if len(cache) >= CACHE_PARTS:
                            cache.clear()
                        cache[word] = n
                    run = 0
                total += n
            if run:
                total += self._part(SPACE * run)
        return total + (text.count("\n") * self._newline() if self.line_alone else 0)

    def _head(self, word: str) -> int:
        """Of a line's first word, which no space precedes."""
        key = "\n" + word
        n = self.cache.get(key)
        if n is None:
            n = self.cache[key] = self._part(word)
        return n

    @lru_cache  # noqa: B019  one counter lives as long as its worker
    def _newline(self) -> int:
        return self._part("\n")

    def _part(self, part: str) -> int:
        return merged_size(part, self.ranks, self.known)


def merged_size(part: str, ranks: dict[str, int], known: set[str]) -> int:
    """Symbols left after all merges: a heap of (rank, left place), symbols in a doubly linked list."""
    n = len(part)
    symbols: list[str | None] = list(part)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(part[i : i + 2])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i, width = heapq.heappop(heap)
        left = symbols[i]
        if left is None or (j := after[i]) >= n:
            continue
        right = symbols[j]
        if len(left) + len(right) != width or ranks.get(left + right) != rank:  # made before a neighbour was merged
            continue
        joined = left + right
        symbols[i], symbols[j] = joined, None
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := ranks.get(joined + symbols[k])) is not None:
                heapq.heappush(heap, (r, i, len(joined) + len(symbols[k])))
        if (h := before[i]) >= 0 and (r := ranks.get(symbols[h] + joined)) is not None:
            heapq.heappush(heap, (r, h, len(symbols[h]) + len(joined)))
    return sum(1 if len(s) > 1 or s in known else len(s.encode()) for s in symbols if s is not None)


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter.load(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row's whole text.

    A null text is empty: 0 bytes, 0 tokens. Repeated rows give repeated results; an empty table gives none; other
    columns are ignored. ``model_path`` must be readable on the executors (as an installed package's file is).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
