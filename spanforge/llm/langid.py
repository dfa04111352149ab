"""Language ID by cross-parsing entropy.

Per language, a suffix automaton of labelled text is built. A text is parsed against each automaton into phrases:
each phrase is the longest match from its place on, and the next one begins where the match ends. Few phrases a
byte mean that the language's text predicts it well; phrases are normalised by log2 of the automaton's text size.

Texts are parsed as folded UTF-8 bytes (ASCII letters in lower case, other bytes of letters as they are, all else
one blank) in blocks of ``BLOCK`` bytes, a phrase ending at a block's end: all blocks of a batch then move through
the automata in step, one table look-up a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import held_out, slices, utf8_column

#: The bound of what is learned: documents a language, bytes of each, and bytes of all languages together. The last one
#: bounds the broadcast automata, too: two states a byte at most, four bytes for each state and symbol of its language.
SAMPLE_DOCS, SAMPLE_BYTES, TOTAL_BYTES = 40, 1200, 1 << 20
BLOCK = 512
STEP_BYTES = 1 << 20
BLANK = 0
SCHEMA = "doc_id bigint, row bigint, held_out boolean, lang_pred string, score double"


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the root; every substring of ``symbols`` is a path from it."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        cur = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return moves


class CrossParser:
    """An automaton for each learned language, as a table over that language's symbols: entry = next state * 2 + (1 if a new phrase begins)."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        fold = np.full(256, BLANK, np.uint8)
        fold[97:123] = fold[65:91] = np.arange(2, 28)
        fold[128:] = np.arange(28, 156)  # bytes of other letters, each for itself
        self.fold, self.symbols, self.tables, self.bits = fold, [], [], []
        for lang in self.langs:
            joined = fold[np.frombuffer(b" ".join(texts[lang]), np.uint8)]
            joined = joined[np.r_[True, (joined[1:] != BLANK) | (joined[:-1] != BLANK)]] if len(joined) else joined
            own = np.zeros(156, np.uint8)
            known = np.unique(joined)
            own[known] = np.arange(1, len(known) + 1)  # 0: a symbol that the language lacks, a phrase of its own
            moves = suffix_automaton(own[joined].tolist())
            root = np.zeros(len(known) + 1, np.int32)
            for s, to in moves[0].items():
                root[s] = to
            table = np.tile(root * 2 + 1, (len(moves), 1))
            for state, out in enumerate(moves):
                for s, to in out.items():
                    table[state, s] = to * 2
            self.symbols.append(own)
            self.tables.append(table)
            self.bits.append(float(np.log2(max(2, len(joined)))))

    def rates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits a byte of each text (rows) by each language (columns)."""
        n = len(offsets) - 1
        symbols = self.fold[data]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != BLANK) | (symbols[:-1] != BLANK)
        starts = offsets[:-1][offsets[:-1] < len(symbols)]
        keep[starts] = True
        count = np.concatenate([[0], np.cumsum(keep)])
        offsets, symbols = count[offsets], symbols[keep]
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        doc = np.repeat(np.arange(n), blocks)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[doc] + within * BLOCK
        size = np.minimum(BLOCK, offsets[doc + 1] - start)
        order = np.argsort(-size, kind="stable")
        start, size, doc = start[order], size[order], doc[order]
        phrases = np.zeros((len(self.langs), n))
        for k, table in enumerate(self.tables):
            width, table, mine = table.shape[1], table.ravel(), self.symbols[k][symbols]
            state = np.zeros(len(start), np.int64)
            begun = np.zeros(len(start), np.int64)
            alive = len(start)
            for at in range(int(size[0]) if len(size) else 0):
                while alive and size[alive - 1] <= at:
                    alive -= 1
                got = table[state[:alive] * width + mine[start[:alive] + at]]
                begun[:alive] += got & 1
                state[:alive] = got >> 1
            phrases[k] = np.bincount(doc, begun + 1, n) * self.bits[k]  # each block's first phrase
        return (phrases / np.maximum(sizes, 1)).T


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> CrossParser:
    """Learn from at most ``sample_docs`` rows a language, ``sample_bytes`` bytes of each; held-out rows are never read.

    So many languages that this is over ``total_bytes`` have fewer rows each, one at least.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    languages = known.select("lang").distinct().count()
    sample_docs = max(1, min(sample_docs, total_bytes // (sample_bytes * max(1, languages))))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(sample_docs))
    picks = known.groupBy("lang", slot.alias("slot")).agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select("doc_id").collect()
    ids = [r.doc_id for r in picks]
    rows = known.where(F.col("doc_id").isin(ids)).groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, sample_bytes)).alias("text")).collect() if ids else []
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id)):
        mine = texts.setdefault(r.lang, [])
        if len(mine) < sample_docs:
            mine.append(r.text.encode()[:sample_bytes])
    return CrossParser(texts)


def predict(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """See ``tagged``: doc_id, held_out, lang_pred and score alone."""
    return tagged(docs, parser).drop("row")


def tagged(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """doc_id, row (hash of the text), held_out, lang_pred and score of every row.

    ``lang_pred`` is the language with the lowest rate, ``und`` where the text is null or has no letter (score 0);
    ties go to the language first by code point. The score is 1 - lowest rate / second lowest, 1 if only one
    language was learned. Repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.langs, "und"], object)
        for batch in batches:
            data, offsets = utf8_column(batch.column(3))
            letters = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(offsets, STEP_BYTES):
                best, score = np.full(b - a, len(own.langs)), np.zeros(b - a)
                if own.langs:
                    rate = own.rates(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    best = rate.argmin(axis=1)
                    two = np.partition(rate, 1, axis=1) if len(own.langs) > 1 else None
                    score = np.ones(b - a) if two is None else 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
                has = letters[a:b]
                best, score = np.where(has, best, len(own.langs)), np.where(has, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:3]), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "row", "held_out", "lang_pred", "score"])

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"), has_letter.alias("letters"))
    return rows.mapInArrow(run, SCHEMA)
