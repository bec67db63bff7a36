"""Substring dedup over bytes: suffixes compared by prefix polynomial hashes.

A string of ``window`` bytes that also starts earlier is removed, in whatever document the
earlier one stands. Sorting every suffix of a corpus would write sixteen bytes or more per
byte of text, so only suffixes at content-chosen places are sorted:

* In every window of ``window`` bytes the k-gram with the smallest hash (leftmost of equal
  ones) is its anchor. Equal windows have equal anchors at equal offsets, and neighbouring
  windows share one: about 2/(window - k) anchors per byte. A maximal run of windows with one
  anchor is a cell.
* Anchors whose k-gram occurs once hold no repeat. Of the others, cells with equal bytes
  (one hash over the whole cell) are one class, of which only the earliest cell goes on.
* Classes that share a k-gram may share some of their windows. Their cells are brought
  together by k-gram and the suffixes that start their windows are sorted, as deep as a
  window, by mergesort. A comparison finds the common extension by binary search over prefix
  hashes, after a look at the first eight bytes, and decides on the byte behind it. Equal
  suffixes keep their order of place. In the sorted order each suffix is compared with the
  one before on the bytes: that proves the order and the equalities, and a group in which it
  fails, by a collision, is sorted by bytes. Groups of more than ``GROUP_CELLS`` cells don't
  go to one task: their windows are rows of an aggregation, equal by two 64-bit hashes.

``suffix_order`` is the same sort over all suffixes of one text, however deep.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import read_table, stage
from quern.llm.hashing import U64, mix, powers, prefix_sums, window_hashes
from quern.llm.passages import LAST, _only

WINDOW = 100
KGRAM = 36
#: Windows of a long text are handled so many at a time.
SEGMENT = 1 << 18
#: Cells with one k-gram that meet in one task; larger groups are resolved by aggregation.
GROUP_CELLS = 2048
#: Bytes of cells that a task resolves at a time, unless one group has more.
CHUNK = 1 << 19

_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_RANGES = "array<struct<first:int,last:int>>"


def _extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of the suffixes at a and b, known to lie in [least, most], by binary search over prefix hashes."""
    power = powers(len(prefix))[0]
    low, high = least.copy(), most.copy()
    pa, pb, wa, wb = prefix[a], prefix[b], power[a], power[b]
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        mid = (low + high + 1) >> 1
        same = (prefix[a + mid] - pa) * wa == (prefix[b + mid] - pb) * wb
        low = np.where(same, mid, low)
        high = np.where(same, high, mid - 1)
    return low


def _heads(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, most significant first; zeros behind the end."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8))).astype(U64)
    out = np.zeros(len(raw), U64)
    for at in range(8):
        out |= padded[at : at + len(raw)] << U64(56 - 8 * at)
    return out


def merge_sort(raw: np.ndarray, at: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes raw[at:ends], each within its group; equal ones stay as they are given.

    ``group`` ascends. Bottom-up: at each level the sorted runs of all groups are merged with
    their neighbours at once, every suffix finding its place in the neighbour by binary search.
    """
    n = len(at)
    prefix = prefix_sums(_BYTES[raw])
    head = _heads(raw)[np.minimum(at, max(0, len(raw) - 1))] if n else np.zeros(0, U64)
    length = ends - at
    first = np.searchsorted(group, group)  # place of the group's first suffix
    last = np.searchsorted(group, group, side="right")
    order = np.arange(n)
    local = order - first

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y; ``ties`` says so of equal ones."""
        out = head[x] < head[y]
        same = np.flatnonzero((head[x] == head[y]))
        if len(same):
            a, b = x[same], y[same]
            short = np.minimum(length[a], length[b])
            common = _extension(prefix, at[a], at[b], np.minimum(8, short), short)
            inside = common < short
            by_byte = raw[np.where(inside, at[a] + common, 0)] < raw[np.where(inside, at[b] + common, 0)]
            by_length = np.where(length[a] == length[b], ties[same], length[a] < length[b])
            out[same] = np.where(inside, by_byte, by_length)
        return out

    width, widest = 1, int((last - first).max(initial=0))
    while width < widest:
        run = local // width  # of each place
        start = first + run * width
        left = run % 2 == 0
        other = np.minimum(np.where(left, start + width, start - width), last)
        low, high = other.copy(), np.minimum(other + width, last)
        active = np.flatnonzero(low < high)
        while len(active):
            mid = (low[active] + high[active]) >> 1
            # a suffix of the left run comes before its equals of the right run
            later = before(order[mid], order[active], ~left[active])
            low[active] = np.where(later, mid + 1, low[active])
            high[active] = np.where(later, high[active], mid)
            active = active[low[active] < high[active]]
        place = np.minimum(start, np.where(left, start, other)) + (np.arange(n) - start) + (low - other)
        merged = np.empty(n, np.int64)
        merged[place] = order
        order, width = merged, 2 * width
    return order


def suffix_order(data: bytes) -> tuple[list[int], list[int]]:
    """Suffix array of ``data`` and the common extension of each suffix with the one before it, verified on the bytes."""
    raw, n = np.frombuffer(data, np.uint8), len(data)
    order = merge_sort(raw, np.arange(n), np.full(n, n), np.zeros(n, np.int64))
    a, b = order[:-1], order[1:]
    common = _extension(prefix_sums(_BYTES[raw]), a, b, np.zeros(len(a), np.int64), n - np.maximum(a, b)).tolist()
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while data[x : x + common[i]] != data[y : y + common[i]]:  # a collision: the hashes claimed too much
            common[i] -= 1
        if data[x + common[i] : x + common[i] + 1] > data[y + common[i] : y + common[i] + 1]:  # and so was the order wrong
            order = np.array(sorted(range(n), key=lambda at: data[at:]))
            common = [next((k for k in range(n) if data[p + k : p + k + 1] != data[q + k : q + k + 1]), n) for p, q in zip(order.tolist(), order[1:].tolist())]
            break
    return order.tolist(), [0][:n] + common


def cells_of(data: bytes, window: int = WINDOW, k: int = KGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-gram hash, first, last window start) of each cell, in order."""
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    parts = []
    for at in range(0, n, SEGMENT):
        count = min(SEGMENT, n - at)
        hashes = window_hashes(prefix_sums(_BYTES[raw[at : at + count + window - 1]]), k)
        value, place, width = hashes, np.arange(len(hashes), dtype=np.int32), 1
        span = window - k + 1
        while width < span:
            step = min(width, span - width)
            later = value[step:] < value[:-step]
            value = np.where(later, value[step:], value[:-step])
            place = np.where(later, place[step:], place[:-step])
            width += step
        value, place = value[:count], place[:count]
        turns = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate(([0], turns))
        last = np.concatenate((turns - 1, [count - 1]))
        parts.append((value[first], first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    texts = batch.column(2).cast(pa.binary())
    for i in range(batch.num_rows):
        yield i, texts[i].as_py() or b""


def _anchorer(window: int, k: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [cells_of(data, window, k)[0].view(np.int64) for _, data in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["key", "mark", "anchors"])

    return anchors


def _celler(window: int, k: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks, firsts, lasts, grams, cells = [], [], [], [], [], []
            for i, data in _texts(batch):
                gram, first, last = cells_of(data, window, k)
                at = np.unique(np.array(batch.column(3)[i].as_py(), dtype=np.int64))
                gram, first, last = gram[at], first[at], last[at]
                prefix = prefix_sums(_BYTES[np.frombuffer(data, np.uint8)])
                cell = mix((prefix[last + window] - prefix[first]) * powers(len(prefix))[0][first] + (last - first).astype(U64))
                keys.append(np.full(len(at), batch.column(0)[i].as_py(), np.int64))
                marks.append(np.full(len(at), batch.column(1)[i].as_py(), np.int64))
                firsts.append(first.astype(np.int32))
                lasts.append(last.astype(np.int32))
                grams.append(gram.view(np.int64))
                cells.append(cell.view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, marks, firsts, lasts, grams, cells)], names=["key", "mark", "first", "last", "gram", "cell"])

    return cells


def _reader(window: int):
    """The bytes of the cells to be compared."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, data in _texts(batch):
                key, mark = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows += [(key, mark, c["first"], c["gram"], c["many"], data[c["first"] : c["last"] + window]) for c in batch.column(3)[i].as_py()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], names=["key", "mark", "first", "gram", "many", "bytes"])

    return read


def _repeats(keys: np.ndarray, marks: np.ndarray, firsts: np.ndarray, grams: np.ndarray, texts: list[bytes], window: int) -> list[tuple[int, int]]:
    """(cell, window) of every window that an earlier cell of the same k-gram holds too."""
    by_place = np.lexsort((firsts, marks, keys, grams))
    lengths = np.array([len(texts[c]) for c in by_place], np.int64)
    raw = np.frombuffer(b"".join([texts[c] for c in by_place]), np.uint8)
    starts = np.cumsum(lengths) - lengths
    counts = lengths - window + 1
    cell = np.repeat(by_place, counts)
    offset = np.arange(len(cell)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(starts, counts) + offset
    group = np.cumsum(np.diff(grams[cell], prepend=grams[cell[:1]]) != 0)
    order = merge_sort(raw, at, at + window, group)
    equal, wrong = np.zeros(len(order), bool), []
    wide = np.arange(window)
    for part in range(1, len(order), 1 << 15):
        a, b = order[part - 1 : part - 1 + (1 << 15)], order[part : part + (1 << 15)]
        a = a[: len(b)]
        x, y = raw[at[a][:, None] + wide], raw[at[b][:, None] + wide]
        differ = x != y
        where = differ.argmax(axis=1)
        row = np.arange(len(b))
        same_group = group[a] == group[b]
        equal[part : part + len(b)] = same_group & ~differ[row, where]
        wrong += group[b[same_group & differ[row, where] & (x[row, where] > y[row, where])]].tolist()
    for g in set(wrong):  # a collision: sort these windows by their bytes
        inside = np.flatnonzero(group[order] == g)
        windows = sorted(order[inside].tolist(), key=lambda i: (raw[at[i] : at[i] + window].tobytes(), i))
        order[inside] = windows
        equal[inside] = [n > 0 and raw[at[i] : at[i] + window].tobytes() == raw[at[windows[n - 1]] : at[windows[n - 1]] + window].tobytes() for n, i in enumerate(windows)]
    later = order[equal]
    return list(zip(cell[later].tolist(), offset[later].tolist()))


def _resolver(window: int):
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, marks, firsts, grams = (np.array([r[n] for r in held], np.int64) for n in range(4))
            by_cell: dict[int, list[int]] = {}
            for cell, offset in _repeats(keys, marks, firsts, grams, [r[4] for r in held], window):
                by_cell.setdefault(cell, []).append(offset)
            out: list[tuple] = []
            for cell, offsets in by_cell.items():
                offsets = np.sort(np.array(offsets))
                cuts = np.flatnonzero(np.diff(offsets) > 1) + 1
                out += [(held[cell][0], held[cell][1], held[cell][2] + int(run[0]), held[cell][2] + int(run[-1])) for run in np.split(offsets, cuts)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kind) for n, kind in enumerate(kinds)], names=["key", "mark", "first", "last"])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in range(5))):
                if size >= CHUNK and row[3] != held[-1][3]:
                    yield from flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        yield from flush()

    return resolve


def _exploder(window: int):
    """Windows of the cells of large groups: key, mark, start and two hashes."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, mark, first, _, data in zip(*(batch.column(n).to_pylist() for n in range(5))):
                x = _BYTES[np.frombuffer(data, np.uint8)]
                n = len(data) - window + 1
                starts = np.arange(n)
                for column, values in zip(out, (np.full(n, key), np.full(n, mark), starts + first, window_hashes(prefix_sums(x), window, starts).view(np.int64), window_hashes(prefix_sums(mix(x)), window, starts).view(np.int64))):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["key", "mark", "start", "h", "g"])

    return explode


def _cutter(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, spans = [], [], []
            for i, data in _texts(batch):
                edge = np.zeros(len(data) + 1, np.int32)
                ranges = batch.column(3)[i].as_py()
                np.add.at(edge, [r["first"] for r in ranges], 1)
                np.add.at(edge, [r["last"] + window for r in ranges], -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
                turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                spans.append([{"first": int(a), "last": int(b)} for a, b in zip(turns[::2], turns[1::2])])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, kind)], names=["key", "mark", "n_removed", "kept", "spans"])

    return cut


def repeated_bytes(
    spark: SparkSession, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, k: int = KGRAM, group_cells: int = GROUP_CELLS
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed bytes, end exclusive).

    Null texts are empty; texts shorter than a window lose nothing. Equal rows aren't earlier
    than each other; rows of one id with different texts come in the order of a hash of the
    text. A null id is larger than all others. An empty table gives an empty table. Other
    columns of ``df`` are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("key"), F.xxhash64(text).alias("mark"), text.alias("text"))
    told = stage(spark, texts.select("key", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "suffix")

    same = told.where(F.col("n_bytes") >= window).groupBy("sha", "n_bytes").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    copied = told.join(same.select("sha", "first"), "sha").where("first < key")
    copied = stage(spark, copied.select("key", "mark").distinct(), "suffix-copies")

    originals = _only(texts, copied, "left_anti")
    anchored = originals.mapInArrow(_anchorer(window, k), "key long, mark long, anchors array<long>").where(F.size("anchors") > 0)
    anchored = stage(spark, anchored.withColumn("row_no", F.monotonically_increasing_id()), "suffix-anchors")

    # a k-gram twice in one text counts too; equal rows would count their own, and are settled below
    grams = anchored.select(F.explode("anchors").alias("gram")).groupBy("gram", F.pmod("gram", F.lit(3)).alias("third"))
    grams = grams.agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    places = anchored.select("row_no", F.posexplode("anchors").alias("at", "gram")).join(grams, "gram")
    places = places.groupBy("row_no").agg(F.collect_list("at").alias("at"))
    places = stage(spark, places.join(anchored.select("row_no", "key", "mark"), "row_no").drop("row_no").dropDuplicates(["key", "mark"]), "suffix-places")

    involved = _only(texts, places.select("key", "mark"), "left_semi").dropDuplicates(["key", "mark"])
    held = involved.join(places, ["key", "mark"]).select("key", "mark", "text", "at")
    cells = stage(spark, held.mapInArrow(_celler(window, k), "key long, mark long, first int, last int, gram long, cell long"), "suffix-cells")

    place = F.struct("key", "mark", "first", "last")
    classes = stage(spark, cells.groupBy("gram", "cell").agg(F.min(place).alias("lead"), F.count(F.lit(1)).alias("n")), "suffix-classes")
    # cells with the bytes of an earlier one lose all their windows
    leads = classes.where("n > 1").select("cell", F.col("gram").alias("gram1"), "lead")
    copies = cells.join(leads, "cell").where(((F.col("gram") - F.col("gram1")) == 0) & (place != F.col("lead"))).select("key", "mark", "first", "last")

    groups = classes.groupBy("gram", F.pmod("gram", F.lit(3)).alias("third")).agg(F.count(F.lit(1)).alias("n_cells")).where("n_cells > 1").select("gram", "n_cells")
    open_cells = classes.select("gram", "lead.*").join(groups, "gram")
    entry = F.struct("first", "last", "gram", (F.col("n_cells") > group_cells).alias("many"))
    per_text = stage(spark, open_cells.groupBy("key", "mark").agg(F.collect_list(entry).alias("cells")), "suffix-open")
    asked = _only(texts, per_text.select("key", "mark"), "left_semi").dropDuplicates(["key", "mark"]).join(per_text, ["key", "mark"])
    loaded = asked.select("key", "mark", "text", "cells").mapInArrow(_reader(window), "key long, mark long, first int, gram long, many boolean, bytes binary")
    loaded = stage(spark, loaded, "suffix-loaded")
    few = loaded.where("not many").drop("many").repartition("gram").sortWithinPartitions("gram")
    repeats = few.mapInArrow(_resolver(window), "key long, mark long, first int, last int")
    rows = loaded.where("many").drop("many").mapInArrow(_exploder(window), "key long, mark long, start long, h long, g long")
    firsts = rows.groupBy("h", "g").agg(F.min(F.struct("key", "mark", "start")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select("h", F.col("g").alias("g1"), "lead")
    later = rows.join(firsts, "h").where(((F.col("g") - F.col("g1")) == 0) & (F.struct("key", "mark", "start") != F.col("lead")))
    later = later.select("key", "mark", F.col("start").cast("int").alias("first"), F.col("start").cast("int").alias("last"))
    gone = copies.unionByName(repeats).unionByName(later)
    gone = stage(spark, gone.groupBy("key", "mark").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "suffix-gone")

    losing = _only(texts, gone.select("key", "mark"), "left_semi").dropDuplicates(["key", "mark"]).join(gone, ["key", "mark"])
    cut = losing.select("key", "mark", "text", "ranges").mapInArrow(_cutter(window), f"key long, mark long, n_removed long, kept string, spans {_RANGES}")

    out = told.join(cut, ["key", "mark"], "left").join(copied.withColumn("copy", F.lit(True)), ["key", "mark"], "left")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_bytes").cast("int").alias("last")))
    spans = F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.expr(f"cast(array() as {_RANGES})")))
    return out.select(
        F.when(F.col("key") < LAST, F.col("key")).alias("doc_id"),
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        spans.alias("spans"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return repeated_bytes(spark, read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
