"""Texts to postings, on Arrow arrays: the tokens of a run of texts are sorted as numbers.

The functions travel to Python workers by value, so these need numpy and pyarrow but not this
package; both are imported where they are used, so searching a written index needs neither.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

#: Bytes of text that are folded to postings at once, and rows handed back at once.
FOLDED_BYTES = 16 << 20
FOLDED_ROWS = 20_000
FOLDED = "term string, doc_id long, tf int, positions array<int>, length int"


def folded(batches):
    """(term, doc_id, tf, positions, length) of batches of (doc_id, text), sorted by term and document in runs of about FOLDED_BYTES of text."""
    import pyarrow as pa

    kept, size = [], 0
    for batch in batches:
        ends = _offsets(batch.column(1))
        start = 0
        while start < batch.num_rows:
            # as many rows as fit, one at least
            stop = max(start + 1, int(ends.searchsorted(ends[start] + FOLDED_BYTES - size, "right")) - 1)
            kept.append(batch.slice(start, stop - start))
            size += int(ends[stop] - ends[start])
            start = stop
            if size >= FOLDED_BYTES or start < batch.num_rows:
                yield from _fold(pa.Table.from_batches(kept).combine_chunks())
                kept, size = [], 0
    if kept:
        yield from _fold(pa.Table.from_batches(kept).combine_chunks())


def _offsets(texts):
    """Where each text begins, and the last one ends, in bytes."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _fold(rows):
    """One run: a token's rank among the terms and its place in the run make one number, and these are sorted."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = rows.take(pc.sort_indices(rows, [(rows.column_names[0], "ascending")]))
    doc_ids = rows.column(0).combine_chunks()
    split = pc.ascii_split_whitespace(pc.fill_null(rows.column(1), "")).combine_chunks()
    held = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(split)
    word = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    doc = np.repeat(np.arange(len(held)), held)[word]
    if not len(doc):
        return
    coded = flat.filter(pa.array(word)).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    terms = coded.dictionary.take(order)
    rank = np.empty(len(terms), np.int64)
    rank[order.to_numpy()] = np.arange(len(terms))
    length = np.bincount(doc, minlength=len(held))
    first = np.cumsum(length) - length
    bits = len(doc).bit_length()
    key = np.sort((rank[coded.indices.to_numpy()] << bits) | np.arange(len(doc)))
    at = key & ((1 << bits) - 1)
    key >>= bits
    doc = doc[at]
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
    ends = np.concatenate([starts, [len(key)]])
    positions = (at - first[doc]).astype(np.int32)
    key, doc = key[starts], doc[starts]
    for n in range(0, len(starts), FOLDED_ROWS):
        some = slice(n, n + FOLDED_ROWS)
        offsets = ends[n : n + FOLDED_ROWS + 1]
        yield pa.RecordBatch.from_arrays(
            [
                terms.take(pa.array(key[some])),
                doc_ids.take(pa.array(doc[some])),
                pa.array(np.diff(offsets).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(positions[offsets[0] : offsets[-1]])),
                pa.array(length[doc[some]].astype(np.int32)),
            ],
            ["term", "doc_id", "tf", "positions", "length"],
        )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
