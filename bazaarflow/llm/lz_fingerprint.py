"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each is the longest known phrase plus one code point). The
phrase set is hashed and its `SIZE` smallest hash values are the signature; the likeness of two
signatures estimates the Jaccard similarity of the phrase sets, which behaves like a
compression-based similarity.

`neighbours` compares each document with an edited version of itself and with the next document in
descending id order. Documents are dealt out by id ranges; the first document of a range is also
sent to the range before it, so no task sees more than its range.

Defined cases: a null text counts as empty; an empty text has an empty fingerprint; two empty
fingerprints are alike (1), an empty and another one are not (0). Rows that repeat an id follow each
other in descending text order. Null ids come last. The next document of a single row is itself. An
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from bazaarflow.llm.hashing import hash_runs

SIZE = 64
_DIGITS = 10  # hex digits of a hash value in a signature


class Parse:
    """Phrases of a text up to a point, from which it can go on with different endings."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.node = self.root
        self.begin = 0  # of the phrase under way
        self.end = 0

    def feed(self, piece: str) -> tuple[list[int], list]:
        """Ends of the new phrases, and the dictionary entries they made."""
        root, node, ends, made = self.root, self.node, [], []
        for i, char in enumerate(piece, self.end + 1):
            if char in node:
                node = node[char]
            else:
                node[char] = {}
                made.append((node, char))
                ends.append(i)
                node = root
        self.node, self.end = node, self.end + len(piece)
        if ends:
            self.begin = ends[-1]
        return ends, made

    def branch(self, piece: str) -> list[int]:
        """Ends of the phrases that piece would add; the state stays as it is."""
        before = self.node, self.begin, self.end
        ends, made = self.feed(piece)
        for node, char in made:
            del node[char]
        self.node, self.begin, self.end = before
        return ends


def _phrase_hashes(text: str, begin: int, ends: list[int]) -> np.ndarray:
    """Hashes of the phrases that follow each other from begin."""
    if not ends:
        return np.zeros(0, dtype=np.uint64)
    codes = np.frombuffer(text[begin : ends[-1]].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    stops = np.asarray(ends, dtype=np.int64) - begin
    return hash_runs(codes, np.concatenate(([0], stops[:-1])), stops)


def _signature(*hashes: np.ndarray) -> np.ndarray:
    every = np.concatenate(hashes) >> np.uint64(64 - 4 * _DIGITS)
    if len(every) > 4 * SIZE:
        every = np.partition(every, 2 * SIZE)[: 2 * SIZE]
    return np.unique(every)[:SIZE]


def _text_of(signature: np.ndarray) -> str:
    return "".join(f"{int(x):0{_DIGITS}x}" for x in signature)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase sets behind two sorted signatures."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SIZE]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], side="right")) / len(union)


def fingerprint(text: str | None) -> np.ndarray:
    parse = Parse()
    return _signature(_phrase_hashes(text or "", 0, parse.feed(text or "")[0]))


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


class _Document:
    def __init__(self, ident, text: str) -> None:
        self.ident, self.text = ident, text
        self.parse, keep = Parse(), len(text) - len(text) // 3
        head = self.parse.feed(text[:keep])[0]
        self.head = _phrase_hashes(text, 0, head)
        self.signature = _signature(self.head, _phrase_hashes(text, self.parse.begin, self.parse.branch(text[keep:])))

    def against(self, following: "_Document") -> tuple:
        changed = edited(self.text, following.text)
        keep = len(self.text) - len(self.text) // 3
        other = _signature(self.head, _phrase_hashes(changed, self.parse.begin, self.parse.branch(changed[keep:])))
        return (
            self.ident, len(self.text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
            _text_of(self.signature), _text_of(other), likeness(self.signature, other), likeness(self.signature, following.signature),
        )


_OUT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = part["text"].to_pylist()
                marks = [_text_of(fingerprint(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([len(t) for t in texts], pa.int64()), pa.array(marks, pa.string())], ["id", "n_chars", "fingerprint"])

    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, n_chars long, fingerprint string")


def _in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows with range and later; the first rows of the next range follow with later = 1."""
    points = sorted(set(docs.approxQuantile("place", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    splits = [-float("inf"), *points, float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    dealt = Bucketizer(splits=splits, inputCol="place", outputCol="range").transform(docs)
    # one row for each range, however long the table is
    tops = {r["range"]: r["top"] for r in dealt.groupBy("range").agg(F.max(F.struct("place", "id")).alias("top")).collect()}
    order = sorted(tops, reverse=True)
    if not order:
        return dealt.withColumn("later", F.lit(0))
    goes = [(tops[r]["id"], r, order[i - 1]) for i, r in enumerate(order)]  # the first one follows the last
    spark = docs.sparkSession
    heads = spark.createDataFrame(goes, f"head_id {docs.schema['id'].dataType.simpleString()}, head_range double, before double")
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("later"))
    again = F.struct(F.col("before").alias("range"), F.lit(1).alias("later"))
    return (
        dealt.join(F.broadcast(heads), (F.col("range") == F.col("head_range")) & F.col("id").eqNullSafe(F.col("head_id")), "left")
        .withColumn("goes", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, again))))
        .select("id", "text", "goes.range", "goes.later")
    )


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    narrow = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(id_col).cast("double"), F.lit(-1.7e308)).alias("place"),
    )
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _in_ranges(narrow, ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the phrase dictionaries hold no cycles; walking them again and again costs most of the time
        held, now, rows = None, None, []
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                for ident, text, where, later in zip(*(part[c].to_pylist() for c in ("id", "text", "range", "later"))):
                    if where != now:
                        held, now = None, where
                    elif held is None and later:  # more rows that share the first id of the next range
                        continue
                    doc = _Document(ident, text)
                    if held is not None:
                        rows.append(held.against(doc))
                    held = None if later else doc
                if rows:
                    yield _batch(rows, part.schema.field("id").type)
                    rows = []

    kind = narrow.schema["id"].dataType.simpleString()
    return (
        dealt.repartition(ranges, "range")
        .sortWithinPartitions("range", "later", F.col("id").desc_nulls_last(), F.col("text").desc())
        .mapInArrow(run, f"id {kind}, {_OUT}")
    )


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["id", *[c.split()[0] for c in _OUT.split(", ")]]
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(column, k) for column, k in zip(zip(*rows), kinds)], names)
