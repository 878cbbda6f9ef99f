"""Blocks of postings from rows of terms, counted where the rows are.

A posting is a short value and a corpus has hundreds for each row, so they are counted, grouped and sorted as
Arrow and numpy columns, a bounded number of terms at a time. A range of rows that is cut between two chunks
has a block in each: the readers add up or take the largest of a list's blocks.
"""

import sys
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The helper travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRY = "STRUCT<doc: BIGINT, w: DOUBLE, length: DOUBLE, authority: DOUBLE>"
BLOCK = f"bucket INT, key STRING, span BIGINT, n BIGINT, peak DOUBLE, entries ARRAY<{ENTRY}>"
#: Terms that are counted at once, and entries of a batch that goes back.
TERMS = 1 << 18
ENTRIES = 1 << 17
#: Rows that come at once; a row may be a whole document.
ROWS = 256


def blocks(rows: DataFrame, width: int, average: float, k1: float, b: float, pair_weight: float, buckets: int) -> DataFrame:
    """(bucket, key, span, n, peak, entries) of rows(doc, authority, length, terms): a row's terms weigh 1, its pairs
    `pair_weight`, and span is doc // width. peak is the largest gain of an entry, as scoring.gain has it; bucket
    is crc32(key) % buckets.

    Rows without terms have no entries. Narrow: no entry moves, and a chunk's blocks come out by bucket and key, so
    that a sort has only a few runs to merge.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(BLOCK))

    def batches(stream):
        held, n = [], 0
        for batch in stream:
            held.append(batch)
            n += pc.sum(pc.list_value_length(batch.column(3))).as_py() or 0
            if n >= TERMS:
                yield from _posted(held, width, average, k1, b, pair_weight, buckets, schema)
                held, n = [], 0
        if n:
            yield from _posted(held, width, average, k1, b, pair_weight, buckets, schema)

    return rows.select("doc", "authority", "length", "terms").mapInArrow(batches, BLOCK)


def _posted(held, width, average, k1, b, pair_weight, buckets, schema):
    table = pa.Table.from_batches(held)
    doc, authority, length = (table.column(i).to_numpy() for i in range(3))
    terms = table.column(3).combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy().astype(np.int64)
    flat = terms.flatten()
    owner = np.repeat(np.arange(len(doc)), sizes)
    beside = pa.array(owner[:-1] == owner[1:])
    pairs = pc.binary_join_element_wise(flat[:-1].filter(beside), flat[1:].filter(beside), "")
    words = pa.concat_arrays([flat, pairs]).dictionary_encode()
    by_key = pc.sort_indices(words.dictionary).to_numpy().astype(np.int64)
    bucket = np.fromiter((crc32(k) % buckets for k in words.dictionary.cast(pa.binary()).to_pylist()), np.int32, len(by_key))[by_key]
    by_bucket = np.argsort(bucket, kind="stable")
    by_key, bucket = by_key[by_bucket], bucket[by_bucket]
    rank = np.empty_like(by_key)
    rank[by_key] = np.arange(len(by_key))
    owners = np.concatenate([owner, owner[:-1][beside.to_numpy(zero_copy_only=False)]])
    # A number for each occurrence, that sorts by key, row and kind.
    packed = (rank[words.indices.to_numpy()] * len(doc) + owners) * 2
    packed[len(owner):] += 1
    packed.sort()
    at = np.flatnonzero(np.concatenate([[True], packed[1:] >> 1 != packed[:-1] >> 1]))
    in_pairs = np.add.reduceat(packed & 1, at)
    w = np.diff(at, append=len(packed)) - in_pairs + pair_weight * in_pairs
    key, row = np.divmod(packed[at] >> 1, len(doc))
    span = doc[row] // width
    gain = w * (k1 + 1) / (w + k1 * (1 - b + b * length[row] / average))
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (span[1:] != span[:-1])]))
    peak = np.maximum.reduceat(gain, head)
    ends = np.append(head, len(key))
    names = words.dictionary.take(pa.array(by_key))
    entry = schema.field("entries").type.value_type
    start = 0
    while start < len(head):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + ENTRIES, "right")) - 1)
        one = slice(ends[start], ends[stop])
        values = [doc[row[one]], w[one], length[row[one]], authority[row[one]]]
        entries = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, entry, strict=True)], fields=list(entry))
        lists = pa.ListArray.from_arrays(pa.array(ends[start:stop + 1] - ends[start], pa.int32()), entries)
        columns = [pa.array(bucket[key[head[start:stop]]]), names.take(pa.array(key[head[start:stop]])), pa.array(span[head[start:stop]]),
                   pa.array(np.diff(ends[start:stop + 1])), pa.array(peak[start:stop]), lists]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
        start = stop
