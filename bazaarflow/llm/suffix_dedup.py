"""Removal of byte strings of a fixed length that also start anywhere else, by a distributed suffix order.

Whether a `length`-byte string repeats is a question about neighbours in the order of all suffixes. The
order is built where it can matter only:

1. Each string has an anchor that depends on its content alone (see `anchors`). Consecutive strings with
   one anchor form a segment. Suffixes are ordered by leading tokens: the gram at the anchor, then the
   whole segment. Sampled splitters range-partition them; buckets sort locally; equal neighbours are
   found inside a bucket and, from the first and last keys of all buckets, across boundaries.
   Equal segments repeat as a whole. Segments whose gram occurs nowhere else hold no repeat.
2. Segments with a shared gram that differ, the ends of repeats, are sorted string by string: a bucket
   gets all segments of a gram and sorts their strings by multikey quicksort over blocks of `TOKEN` bytes,
   going deeper only where strings still tie.
3. Grams with more than `CROWD` different segments, such as a passage that a third of all documents quote,
   are not brought together. Their strings are range-partitioned one by one, ties included, and
   compared across boundaries as in 1.

Blocks and segments are compared by 64-bit hashes of all their bytes.

Defined cases: a null text is empty. Texts shorter than `length` lose nothing. Rows that repeat a text
lose all of it. Rows are told apart by id and text hash, so ids may repeat or be null. An empty table
gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from bazaarflow.llm.anchors import Substrings
from bazaarflow.session import write_and_reload

LENGTH = 400
GRAM = 64
TOKEN = 40
CROWD = 8192  # about 4 MB of segments: what a task may hold of one gram

_KEYED = ["k1", "k2", "id", "th", "first", "last", "ahead"]


def _parts(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def multikey_ties(key: np.ndarray, token: Callable[[int, np.ndarray], np.ndarray], depth: int) -> np.ndarray:
    """Indices of items that tie with another one on key and on all of depth tokens.

    Multikey quicksort, all runs at once: sort by key, then each run of ties by the next token, and drop
    items as soon as nothing ties with them.
    """
    index = np.argsort(key, kind="stable")
    run = key[index]
    for level in range(depth + 1):
        same = run[1:] == run[:-1]
        tied = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(run) else np.zeros(0, dtype=bool)
        index, number = index[tied], np.cumsum(np.concatenate(([True], ~same)))[tied] if len(run) else run
        if level == depth or not len(index):
            return index
        value = token(level, index)
        order = np.lexsort((value, number))
        index, value, number = index[order], value[order], number[order]
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (number[1:] != number[:-1])))
        run = np.cumsum(new)
    return index


def _anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of all texts: gram, content, row, first and last string, and how far the anchor is ahead of the first."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for part in _parts(batches):
            raw = [t.encode() for t in part["text"].to_pylist()]
            ends = np.cumsum([len(r) for r in raw])
            data = b"".join(raw)
            subs = Substrings(data)
            anchor, first, last = subs.segments(ends, length, gram)
            if not len(anchor):
                continue
            doc = np.searchsorted(ends, first, side="right")
            begin = np.concatenate(([0], ends))[doc]
            yield pa.RecordBatch.from_arrays([
                _signed(subs.hash(anchor, anchor + gram)), _signed(subs.hash(first, last + length)), part["id"].take(pa.array(doc)), part["th"].take(pa.array(doc)),
                pa.array((first - begin).astype(np.int32)), pa.array((last - begin).astype(np.int32)), pa.array((anchor - first).astype(np.int32)),
            ], _KEYED)

    return texts.mapInArrow(run, f"k1 long, k2 long, id {kind}, th long, first int, last int, ahead int")


def _neighbours(rows: DataFrame) -> DataFrame:
    """rows ordered by their keys over all buckets: id, th, first, last, ahead, k1 with
    equal (another row has both keys), kinds (different k2 of its k1) and lead (first of its two keys).

    Rows of which neither holds are left out. Ranges cut through ties, so no key makes a large bucket.
    """
    kind = rows.schema["id"].dataType
    edges = ["edge_run", "edge_next", "edge_same", "edge_same_next"]

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        k1, k2 = (table[c].to_numpy() for c in ("k1", "k2"))
        new1 = np.concatenate(([True], k1[1:] != k1[:-1]))
        new2 = new1 | np.concatenate(([True], k2[1:] != k2[:-1]))
        run1, run2 = np.cumsum(new1) - 1, np.cumsum(new2) - 1
        equal = np.bincount(run2)[run2] > 1
        kinds_of = np.bincount(run1[new2])
        kinds = kinds_of[run1]
        marks = [run1 == 0, run1 == run1[-1], run2 == 0, run2 == run2[-1]]
        keep = equal | (kinds > 1) | marks[0] | marks[1]
        bucket = TaskContext.get().partitionId()
        chosen = table.filter(pa.array(keep))
        flags = [equal, kinds.astype(np.int64), new2, *marks]
        columns = [chosen[c].combine_chunks() for c in ("id", "th", "first", "last", "ahead", "k1")] + [pa.array(f[keep]) for f in flags]
        n = int(keep.sum())
        columns += [pa.array(np.full(n, bucket, dtype=np.int32)), *[pa.nulls(n, pa.int64())] * 6]
        yield pa.RecordBatch.from_arrays(columns, names)
        summary = [k1[0], k2[0], k1[-1], k2[-1], kinds_of[0], kinds_of[-1]]
        empty = [pa.nulls(1, chosen.schema.field(c).type) for c in ("id", "th", "first", "last", "ahead", "k1")] + [pa.nulls(1, t) for t in (pa.bool_(), pa.int64(), *[pa.bool_()] * 5)]
        yield pa.RecordBatch.from_arrays([*empty, pa.array([bucket], pa.int32()), *[pa.array([int(x)], pa.int64()) for x in summary]], names)

    shape = f"id {kind.simpleString()}, th long, first int, last int, ahead int, k1 long, equal boolean, kinds long, lead boolean, "
    shape += ", ".join(f"{e} boolean" for e in edges) + ", bucket int, " + ", ".join(f"b{i} long" for i in range(6))
    names = [c.split()[0] for c in shape.split(", ")]
    ranged = rows.repartitionByRange("k1", "k2", "id", "first").sortWithinPartitions("k1", "k2")
    stored = write_and_reload(ranged.mapInArrow(run, shape), "neighbours")

    # one row for each bucket, whatever the table's size
    summaries = [tuple(r) for r in stored.filter("b0 is not null").select("bucket", *[f"b{i}" for i in range(6)]).collect()]
    across = stored.sparkSession.createDataFrame(_across(sorted(summaries)), "bucket int, before boolean, after boolean, kinds_first long, kinds_last long")
    found = stored.filter("b0 is null").join(F.broadcast(across), "bucket")
    equal = F.col("equal") | (F.col("edge_same") & F.col("before")) | (F.col("edge_same_next") & F.col("after"))
    kinds = F.greatest("kinds", F.when(F.col("edge_run"), F.col("kinds_first")), F.when(F.col("edge_next"), F.col("kinds_last")))
    return found.select(
        "id", "th", "first", "last", "ahead", "k1", equal.alias("equal"), kinds.alias("kinds"), (F.col("lead") & ~(F.col("edge_same") & F.col("before"))).alias("lead")
    ).filter("equal or kinds > 1")


def _across(summaries: list[tuple]) -> list[tuple]:
    """For each bucket: does its first (last) key go on before (after) it, and how many kinds do its first and last runs have in all."""
    for one, two in zip(summaries, summaries[1:]):
        if one[3:5] > two[1:3]:
            raise RuntimeError("buckets are not in the order of their keys")
    n = len(summaries)
    joint = [i + 1 < n and summaries[i][3:5] == summaries[i + 1][1:3] for i in range(n)]
    kinds: dict[tuple[int, int], int] = {}
    run: list[tuple[int, int]] = []  # (bucket place, 0 for its first run or 1 for its last) that share a k1

    def close(total: int) -> None:
        kinds.update((end, total) for end in run)
        run.clear()

    total = 0
    for i, (_, f1, _, l1, _, first, last) in enumerate(summaries):
        goes_on = i > 0 and summaries[i - 1][3] == f1
        if goes_on:
            total += first - joint[i - 1]
        else:
            close(total)
            total = first
        run.append((i, 0))
        if l1 != f1:
            close(total)
            total = last
        run.append((i, 1))
    close(total)
    return [(s[0], i > 0 and joint[i - 1], joint[i], kinds[i, 0], kinds[i, 1]) for i, s in enumerate(summaries)]


def _spans(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [first, stop)."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(stop[order])
    new = np.concatenate(([True], first[1:] > reach[:-1]))
    return first[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(first) - 1]))]


def _lists(rows: DataFrame, *columns: str) -> DataFrame:
    """(row_id, row_th, marks): what is known of a row, no longer than its text."""
    return rows.groupBy(F.col("id").alias("row_id"), F.col("th").alias("row_th")).agg(F.collect_list(F.struct(*columns)).alias("marks"))


def _removed(text: bytes, spans: list[tuple[int, int]], kept: bool) -> tuple:
    """n_bytes, n_removed, spans, digest of the rest and, if asked for, the rest."""
    if spans:
        a, b = _spans(np.array([s[0] for s in spans], dtype=np.int64), np.array([s[1] for s in spans], dtype=np.int64))
        cuts = list(zip(a.tolist(), b.tolist()))
    else:
        cuts = []
    rest = b"".join(text[a:b] for a, b in zip([0, *[c[1] for c in cuts]], [*[c[0] for c in cuts], len(text)]))
    row = len(text), len(text) - len(rest), [{"start": a, "stop": b} for a, b in cuts], hashlib.sha256(rest).hexdigest()
    return (*row, rest) if kept else row


_RESULT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string())]
_RESULT_SQL = "n_bytes long, n_removed long, spans array<struct<start:bigint,stop:bigint>>, kept_sha256 string"


def repeats_removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kept: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_removed, spans (removed bytes), kept_sha256 and, if asked for, kept (the bytes left)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    result, sql = list(_RESULT), _RESULT_SQL
    if kept:
        result, sql = [*result, ("kept", pa.binary())], sql + ", kept binary"

    known = _neighbours(_anchored(texts, length, gram))
    open_row = F.col("lead") & (F.col("kinds") > 1)
    marks = known.withColumn("open", open_row).withColumn("crowd", F.col("kinds") > CROWD).filter("equal or open")

    def settle(batches):
        """Rows without open segments are done; the others keep their text and marks."""
        for part in _parts(batches, 200):
            done, waiting = [], []
            for text, found in zip(part["text"].to_pylist(), part["marks"].to_pylist()):
                raw = text.encode()
                spans = [(m["first"], m["last"] + length) for m in found or [] if m["equal"]]
                rest = [m for m in found or [] if m["open"]]
                done.append((None,) * len(result) if rest else _removed(raw, spans, kept))
                waiting.append((zlib.compress(raw, 1), _packed(spans), _packed([(m["first"], m["last"], m["ahead"], m["k1"], m["crowd"]) for m in rest])) if rest else (None,) * 3)
            columns = [pa.array(c, k) for c, (_, k) in zip(zip(*done), result)] + [pa.array(c, pa.binary()) for c in zip(*waiting)]
            yield pa.RecordBatch.from_arrays([part["id"], part["th"], *columns], ["id", "th", *[n for n, _ in result], "body", "closed", "open"])

    listed = _lists(marks, "first", "last", "ahead", "k1", "equal", "open", "crowd")
    joined = texts.join(listed, F.col("id").eqNullSafe(F.col("row_id")) & (F.col("th") == F.col("row_th")), "left").select("id", "th", "text", "marks")
    state = write_and_reload(joined.mapInArrow(settle, f"id {id_type}, th long, {sql}, body binary, closed binary, open binary"), "segments")
    names = [n for n, _ in result]
    finished = state.filter("body is null").select("id", *names)
    waiting = state.filter("body is not null").select("id", "th", "body", "closed", "open")
    if waiting.isEmpty():
        return finished
    found = _within_grams(waiting, length, id_type).unionByName(_string_by_string(waiting, length, id_type))

    def close(batches):
        for part in _parts(batches, 200):
            rows = []
            for body, closed, more in zip(part["body"].to_pylist(), part["closed"].to_pylist(), part["marks"].to_pylist()):
                spans = [*map(tuple, _unpacked(closed, 2).tolist()), *[(m["first"], m["stop"]) for m in more or []]]
                rows.append(_removed(zlib.decompress(body), spans, kept))
            yield pa.RecordBatch.from_arrays([part["id"], *[pa.array(c, k) for c, (_, k) in zip(zip(*rows), result)]], ["id", *names])

    more = _lists(found, "first", "stop")
    last = waiting.join(more, F.col("id").eqNullSafe(F.col("row_id")) & (F.col("th") == F.col("row_th")), "left").select("id", "body", "closed", "marks")
    return finished.unionByName(last.mapInArrow(close, f"id {id_type}, {sql}"))


def _packed(rows: list[tuple]) -> bytes:
    return np.array(rows, dtype=np.int64).tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64).reshape(-1, width)


def _opened(batches, crowd: bool):
    """Of each waiting row: its id and th as arrays of one, its text and its open segments in or not in a crowd."""
    for part in _parts(batches, 100):
        for i, (body, data) in enumerate(zip(part["body"].to_pylist(), part["open"].to_pylist())):
            marks = _unpacked(data, 5)
            marks = marks[(marks[:, 4] != 0) == crowd]
            if len(marks):
                yield part["id"].slice(i, 1), part["th"].slice(i, 1), zlib.decompress(body), marks


def _repeated(one: pa.Array, n: int) -> pa.Array:
    return one.take(pa.array(np.zeros(n, dtype=np.int64)))


def _within_grams(waiting: DataFrame, length: int, id_type: str) -> DataFrame:
    """(id, th, first, stop) of repeats among the open segments of a gram."""

    def send(batches):
        for ident, th, text, marks in _opened(batches, crowd=False):
            n = len(marks)
            pieces = [text[a : b + length] for a, b in marks[:, :2].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks[:, 3]), _repeated(ident, n), _repeated(th, n), pa.array(marks[:, 0].astype(np.int32)), pa.array(marks[:, 2].astype(np.int32)), pa.array(pieces, pa.binary())],
                ["k1", "id", "th", "first", "ahead", "piece"],
            )

    def compare(table: pa.Table):
        pieces = table["piece"].to_pylist()
        sizes = np.array([len(p) for p in pieces])
        strings = sizes - length + 1
        base = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(pieces)), strings)
        offset = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
        place = base[of] + offset
        k1 = table["k1"].to_numpy()
        group = np.cumsum(np.concatenate(([False], k1[1:] != k1[:-1])))
        # only strings that stand alike to their anchor can be equal
        key = group[of] * np.int64(1 << 20) + (table["ahead"].to_numpy()[of] - offset)
        subs = Substrings(b"".join(pieces))
        ends = [min(length, i + TOKEN) for i in range(0, length, TOKEN)]
        begins = [min(e - 8, i) for i, e in zip(range(0, length, TOKEN), ends)]
        tied = multikey_ties(key, lambda level, index: subs.hash(place[index] + begins[level], place[index] + ends[level]), len(ends))
        hit = np.zeros(len(place), dtype=bool)
        hit[tied] = True
        start = hit & np.concatenate(([True], ~hit[:-1] | (of[1:] != of[:-1])))
        end = hit & np.concatenate((~hit[1:] | (of[1:] != of[:-1]), [True]))
        row = of[start]
        first = table["first"].to_numpy()[row] + offset[start]
        stop = table["first"].to_numpy()[row] + offset[end] + length
        if len(row):
            taken = table.take(pa.array(row))
            return pa.RecordBatch.from_arrays([taken["id"].combine_chunks(), taken["th"].combine_chunks(), pa.array(first.astype(np.int32)), pa.array(stop.astype(np.int32))], ["id", "th", "first", "stop"])
        return None

    def sort(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for part in _parts(batches, 2000):
            k1 = part["k1"].to_numpy()
            new = np.flatnonzero(k1[1:] != k1[:-1])
            if rows >= 1000 and (len(new) or (held and held[-1]["k1"][-1].as_py() != k1[0])):
                cut = 0 if held[-1]["k1"][-1].as_py() != k1[0] else int(new[0]) + 1
                held.append(part.slice(0, cut))
                if (found := compare(pa.Table.from_batches(held))) is not None:
                    yield found
                held, rows, part = [], 0, part.slice(cut)
            held.append(part)
            rows += part.num_rows
        if held and (found := compare(pa.Table.from_batches(held))) is not None:
            yield found

    sent = waiting.mapInArrow(send, f"k1 long, id {id_type}, th long, first int, ahead int, piece binary")
    return sent.repartitionByRange("k1").sortWithinPartitions("k1").mapInArrow(sort, f"id {id_type}, th long, first int, stop int")


def _string_by_string(waiting: DataFrame, length: int, id_type: str) -> DataFrame:
    """(id, th, first, stop) of repeats among all strings of crowded segments."""

    def send(batches):
        for ident, th, text, marks in _opened(batches, crowd=True):
            place = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in marks[:, :2].tolist()]))
            subs = Substrings(text)
            for i in range(0, len(place), 20_000):
                p = place[i : i + 20_000]
                p32 = pa.array(p.astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    _signed(subs.hash(p, p + min(TOKEN, length))), _signed(subs.hash(p, p + length)), _repeated(ident, len(p)), _repeated(th, len(p)), p32, p32, pa.array(np.zeros(len(p), dtype=np.int32)),
                ], _KEYED)

    strings = waiting.mapInArrow(send, f"k1 long, k2 long, id {id_type}, th long, first int, last int, ahead int")
    return _neighbours(strings).filter("equal").select("id", "th", "first", (F.col("last") + length).cast("int").alias("stop"))
