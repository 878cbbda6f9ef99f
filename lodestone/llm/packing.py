"""Best-fit packing of documents into token sequences, bounded-space and online.

Documents become pieces of at most `capacity` tokens. Each task packs its own pieces, longest
first, into a fixed number of open bins: a bitset has bit f set while some open bin has f tokens
free, so the best fit is the lowest set bit at or above the piece's length. If nothing fits and
all bins are open, the fullest (lowest bit) closes. Only lengths and checksums move, never text.

Defined results: null text is an empty document (its end token only); a repeated doc_id is packed
once for each row; a null doc_id is kept; an empty table gives no rows.
"""

import base64
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pieces_of

CAPACITY = 2048
OPEN = 4096
#: Tokens that one task packs: 16,384 sequences.
TASK_TOKENS = CAPACITY * 16_384
END = 0


class Ids:
    """Token ids as bytes.

    The vocabulary's ranks give the same ids as its tokenizer file several times faster; a text
    that may spell a special token goes through the tokenizer file, which knows those.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            ordinary = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ordinary, special_tokens={})
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return np.array(array("I", ids), "<u4").tobytes()


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes the remainder, the others are full."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    starts = ([0] if first else []) + list(range(first, length, capacity))
    return [(s, (first if first and s == 0 else capacity)) for s in starts]


def pieces(docs: DataFrame, vocabulary: tuple[str, str, str], capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row): the documents tokenized and cut.

    vocabulary: the tokenizer's file, its ranks' file, and the pattern that splits words.
    """

    def run(batches):
        ids = Ids(*vocabulary)
        end = np.array([END], "<u4").tobytes()
        for pdf in pieces_of(batches, lambda r: len(r.text or ""), 2 << 20):
            out = []
            for d, row, text in zip(pdf["doc_id"], pdf["row"], pdf["text"], strict=True):
                b = ids.of(text or "") + end
                view = memoryview(b)
                out += [(d, i, s, n, zlib.crc32(view[4 * s:4 * (s + n)]), row) for i, (s, n) in enumerate(cut(len(b) // 4, capacity))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "row"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def best_fit(lengths, capacity: int = CAPACITY, most: int = OPEN):
    """Yields (bin, offset) for each length, online."""
    free_bins: dict[int, list[int]] = defaultdict(list)
    used: dict[int, int] = {}
    bits = made = opened = 0
    for n in lengths:
        fit = bits >> n
        if fit:
            f = n + (fit & -fit).bit_length() - 1
            stack = free_bins[f]
            b = stack.pop()
            if not stack:
                bits &= ~(1 << f)
        else:
            if opened == most:
                f = (bits & -bits).bit_length() - 1
                used.pop(free_bins[f].pop())
                if not free_bins[f]:
                    bits &= ~(1 << f)
                opened -= 1
            b, f = made, capacity
            made, opened, used[b] = made + 1, opened + 1, 0
        yield b, used[b]
        used[b] += n
        f -= n
        if f:
            free_bins[f].append(b)
            bits |= 1 << f
        else:
            used.pop(b)
            opened -= 1


def assign(parts: DataFrame, capacity: int = CAPACITY, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Pieces with sequence_id and offset; as many tasks as the tokens ask for."""
    total = parts.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_tokens))

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        feed, sent = [], None

        def lengths():
            while True:
                yield feed.pop()

        sent = best_fit(lengths(), capacity)
        for pdf in batches:
            where = []
            for n in pdf["length"]:
                feed.append(int(n))
                where.append(next(sent))
            pdf["sequence_id"] = [base + b for b, _ in where]
            pdf["offset"] = [o for _, o in where]
            yield pdf

    spread = parts.repartition(tasks, F.xxhash64("row", "piece")).sortWithinPartitions(F.desc("length"), "row", "piece")
    out = spread.mapInPandas(run, parts.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint")
    return out.drop("row")


def pack(docs: DataFrame, vocabulary: tuple[str, str, str], capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return assign(keep(pieces(docs, vocabulary, capacity), "pieces"), capacity)
