"""Hard negatives by BOND vertical scans.

Vectors are stored as blocks of at most `BLOCK` rows, dimension by dimension, with the least and largest value of
each dimension. Blocks are cut from ranges of (label, id), so most hold one label. Anchors are stored in files
of at most `WAVE` rows.

Every task takes up to `HELD` blocks and reads the anchor files one after the other. For an anchor it reads
a block's dimensions in the order of the anchor's descending magnitude, `STEP` at a time, and adds to the partial
products. What the other dimensions can still add lies between sums of their least and largest products; rows
whose bounds rule them out leave the bitmap of candidates, until exact scores are left:

1. positives: a row goes if its upper bound is below the k-th largest lower bound of the anchor's label;
2. negatives: each positive opens a window of scores; a row goes if no window can hold it, or only below k
   rows that the window surely holds.

Each task's best rows meet in a windowed top-k by anchor (and positive), of at most k rows for each task. The
work is anchors times rows by nature, and its tasks are independent; nothing but file names goes to the driver,
nothing is broadcast and memory holds at most `HELD` blocks (less where they pass
`HELD_BYTES`) and one file of anchors.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part, as rows or
anchors. Shorter vectors are filled up with zeros. Components count as -LIMIT or LIMIT beyond these, so products fit
64 bits in up to 32,768 dimensions. Null ids are no anchors and come last among equal scores. Rows that repeat
an id are rows of their own (also to each other); ties go by smaller id. Without positives, or with negative scores
of the positives, an anchor gives no rows. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from bazaarflow.session import shared_folder, write_and_reload

BLOCK = 4096
HELD = 8
HELD_BYTES = 1 << 27
WAVE = 2048
STEP = 8
LIMIT = 1 << 24
_NO_ID = np.iinfo(np.int64).max

_BLOCKS = "first long, n int, dims int, ids binary, labels binary, anchors binary, values binary"
_POSITIVE = "anchor_row long, row long, id long, score long"
_NEGATIVE = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, row long, id long, score long"


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null for vectors with a null or non-finite component."""
    infinite = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < infinite))
    bound = lambda x: F.greatest(F.least(x, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    return F.when(sound, F.transform(vector, lambda x: F.floor(bound(F.lit(float(scale)) * x.cast("double"))).cast("int")))


class Block:
    """Rows of one block, one array for each dimension."""

    def __init__(self, row: dict) -> None:
        n = row["n"]
        self.rows = row["first"] + np.arange(n, dtype=np.int64)
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.labels = np.frombuffer(row["labels"], dtype=np.int64)
        self.values = np.frombuffer(row["values"], dtype=np.int32).reshape(row["dims"], n).astype(np.int64)
        self.least, self.most = (self.values.min(axis=1), self.values.max(axis=1)) if n else (None, None)
        self.only = self.labels[0] if n and (self.labels == self.labels[0]).all() else None

    def narrowed(self, anchor: "Anchor", candidates: np.ndarray, ruled_in) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that ruled_in(lower, upper) keeps while dimensions are read, and their exact scores."""
        dims = min(len(self.values), len(anchor.values))
        weights = anchor.values[:dims]
        order = anchor.order[anchor.order < dims]
        ends = np.stack((weights * self.least[:dims], weights * self.most[:dims]))[:, order]
        rest = np.zeros((2, dims + 1), dtype=np.int64)  # what dimensions from the i-th on can add, least and most
        rest[0, :dims] = np.cumsum(ends.min(axis=0)[::-1])[::-1]
        rest[1, :dims] = np.cumsum(ends.max(axis=0)[::-1])[::-1]
        partial = np.zeros(len(candidates), dtype=np.int64)
        for begin in range(0, dims + 1, STEP):
            keep = ruled_in(partial + rest[0, begin], partial + rest[1, begin])
            if not keep.all():
                candidates, partial = candidates[keep], partial[keep]
            if not len(candidates) or begin >= dims:
                break
            for d in order[begin : begin + STEP]:
                column = self.values[d] if len(candidates) == len(self.rows) else self.values[d][candidates]
                partial = partial + weights[d] * column
            if begin + STEP > dims:
                keep = ruled_in(partial, partial)
                return candidates[keep], partial[keep]
        return candidates, partial


class Anchor:
    def __init__(self, row: int, ident, label: int, values: bytes) -> None:
        self.row, self.ident, self.label = row, ident, label
        self.values = np.frombuffer(values, dtype=np.int32).astype(np.int64)
        self.order = np.argsort(-np.abs(self.values), kind="stable")


class Best:
    """The first k rows by descending score, then id, then row."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.rows = k, *(np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids, rows = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        if len(scores) > 4 * self.k:  # ties of the k-th score stay for the order by id
            near = scores >= np.partition(scores, len(scores) - self.k)[-self.k]
            scores, ids, rows = scores[near], ids[near], rows[near]
        first = np.lexsort((rows, ids, -scores))[: self.k]
        self.scores, self.ids, self.rows = scores[first], ids[first], rows[first]

    def floor(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) == self.k else None


def _kth(lower: np.ndarray, k: int, floor: int | None) -> int | None:
    """A score that k rows surely reach."""
    found = int(np.partition(lower, len(lower) - k)[-k]) if len(lower) >= k else None
    return max((x for x in (found, floor) if x is not None), default=None)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to size rows (id, label, values, anchor), in the order in which tasks get them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = TaskContext.get().partitionId() << 40, []

        def block(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            columns = {c: table[c].combine_chunks() for c in table.column_names}
            sizes = np.diff(columns["values"].offsets.to_numpy())
            dims, n = int(sizes.max(initial=0)), len(table)
            values = np.zeros((n, dims), dtype=np.int32)
            values[np.arange(dims) < sizes[:, None]] = columns["values"].flatten().to_numpy(zero_copy_only=False)
            ids = columns["id"]
            out = {
                "first": made, "n": n, "dims": dims, "ids": ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                "labels": columns["label"].to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                "anchors": np.flatnonzero(columns["anchor"].to_numpy(zero_copy_only=False)).astype(np.int64).tobytes(),
                "values": np.ascontiguousarray(values.T).tobytes(),
            }
            made += n
            return pa.RecordBatch.from_pylist([out], schema=shape)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                whole = pa.Table.from_batches(held)
                yield block(whole.slice(0, size))
                held = whole.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    shape = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _BLOCKS.split(", ")])
    return rows.mapInArrow(run, _BLOCKS)


def _anchors(blocks: DataFrame) -> DataFrame:
    """(row, id, label, values) of the rows that are anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["anchors"], dtype=np.int64)
                values = np.frombuffer(row["values"], dtype=np.int32).reshape(row["dims"], row["n"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["first"] + at), pa.array(np.frombuffer(row["ids"], dtype=np.int64)[at]),
                    pa.array(np.frombuffer(row["labels"], dtype=np.int64)[at]),
                    pa.array([np.ascontiguousarray(values[:, i]).tobytes() for i in at], pa.binary()),
                ], ["row", "id", "label", "values"])

    return blocks.mapInArrow(run, "row long, id long, label long, values binary")


def _waves(frame: DataFrame, purpose: str, size: int) -> list[str]:
    """Stores frame in files of at most size rows; their names."""
    path = shared_folder(frame.sparkSession, purpose)
    frame.write.option("maxRecordsPerFile", size).parquet(path)
    return sorted(frame.sparkSession.read.schema(frame.schema).parquet(path).inputFiles())


def _scanned(blocks: DataFrame, files: list[str], search, out: str) -> DataFrame:
    """search(anchor row, blocks) -> rows of out, for every anchor of the files and up to HELD blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in out.split(", ")]

        def answers(held: list[Block]) -> Iterator[pa.RecordBatch]:
            for name in files:
                system, path = pafs.FileSystem.from_uri(name)
                with system.open_input_file(path) as file:
                    wave = pq.read_table(file).to_pylist()
                rows = [r for anchor in wave for r in search(anchor, held)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        held: list[Block] = []
        for batch in batches:
            for i in range(batch.num_rows):
                held.append(Block(batch.slice(i, 1).to_pylist()[0]))
                if len(held) == HELD or sum(b.values.nbytes for b in held) > HELD_BYTES:
                    yield from answers(held)
                    held = []
        if held:
            yield from answers(held)

    return blocks.mapInArrow(run, out)


def _positives_in(k: int):
    def search(row: dict, blocks: list[Block]) -> Iterator[tuple]:
        anchor, best = Anchor(row["row"], row["id"], row["label"], row["values"]), Best(k)
        for block in blocks:
            if block.only is not None and block.only != anchor.label:
                continue
            floor = best.floor()

            def ruled_in(lower, upper):
                least = _kth(lower, k, floor)
                return np.ones(len(upper), dtype=bool) if least is None else upper >= least

            rows, scores = block.narrowed(anchor, np.flatnonzero((block.labels == anchor.label) & (block.rows != anchor.row)), ruled_in)
            best.add(scores, block.ids[rows], block.rows[rows])
        for i in range(len(best.scores)):
            yield anchor.row, int(best.rows[i]), int(best.ids[i]), int(best.scores[i])

    return search


def _negatives_in(k: int, low: int, high: int):
    def search(row: dict, blocks: list[Block]) -> Iterator[tuple]:
        anchor = Anchor(row["row"], row["id"], row["label"], row["values"])
        # low * positive <= 100 * negative <= high * positive
        windows = [(-(-low * p["score"] // 100), high * p["score"] // 100, p, Best(k)) for p in row["positives"]]
        windows = [w for w in windows if w[0] <= w[1]]
        if not windows:
            return
        for block in blocks:
            if block.only is not None and block.only == anchor.label:
                continue

            def ruled_in(lower, upper):
                keep = np.zeros(len(upper), dtype=bool)
                for least, most, _, best in windows:
                    bound = _kth(lower[(lower >= least) & (upper <= most)], k, best.floor())
                    keep |= (upper >= (least if bound is None else max(least, bound))) & (lower <= most)
                return keep

            rows, scores = block.narrowed(anchor, np.flatnonzero(block.labels != anchor.label), ruled_in)
            for least, most, _, best in windows:
                inside = (scores >= least) & (scores <= most)
                best.add(scores[inside], block.ids[rows[inside]], block.rows[rows[inside]])
        for _, _, p, best in windows:
            for i in range(len(best.scores)):
                yield anchor.row, anchor.ident, p["row"], p["id"], p["score"], int(best.rows[i]), int(best.ids[i]), int(best.scores[i])

    return search


def _named(column: str) -> Column:
    return F.when(F.col(column) != _NO_ID, F.col(column))


def mined(rows: DataFrame, id_col: str, label: Column, values: Column, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = BLOCK, wave: int = WAVE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor and positive.

    values are whole numbers (see scaled). An anchor's positives are its first other rows of its label; a positive's
    negatives are the first rows of other labels whose score is from low to high percent of the positive's.
    """
    narrow = rows.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), values.alias("values"),
        (F.coalesce(anchor, F.lit(False)) & F.col(id_col).isNotNull()).alias("anchor"),
    ).filter(F.col("label").isNotNull() & F.col("values").isNotNull())
    ranged = narrow.repartitionByRange("label", "id").sortWithinPartitions("label", "id")
    blocks = write_and_reload(_packed(ranged, block), "blocks")
    anchors = write_and_reload(_anchors(blocks), "anchors")
    first = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    found = _scanned(blocks, _waves(anchors, "anchor-files", wave), _positives_in(positives), _POSITIVE)
    best = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= positives)
    listed = best.groupBy("anchor_row").agg(F.collect_list(F.struct("row", "id", "score")).alias("positives"))
    asked = anchors.join(listed, F.col("row") == F.col("anchor_row")).drop("anchor_row")
    hard = _scanned(blocks, _waves(asked, "windows", wave), _negatives_in(negatives, low, high), _NEGATIVE)
    order = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("score"), "id", "row")
    return hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(
        "anchor_id", _named("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), _named("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
