"""Interpolated modified Kneser-Ney language model, counted in Spark and stored as sorted hash arrays.

Words are what space, tab, LF, VT, FF and CR separate, with A-Z lower-cased; every text ends with one end token
and starts, as context only, with a begin mark.

Counting. A combined aggregate counts words by 64-bit hash; their sorted hashes and counts are the vocabulary, and a
word's number is its place there. Tasks then count n-grams of word numbers in runs of `CHUNK` tokens and
deal them out by the n-gram's hash as compressed columns, one blob for each shard and run. As n-grams are dealt by
all their words, a frequent word or context is spread over all shards; a shard receives a frequent n-gram once from
each run. A shard sums its n-grams, stores their hashes, sorted, with the counts, and deals out two smaller things:
sums for each context (by hash of the context), and the n-grams less their first word, whose number of different
predecessors is the count of the next lower order. N-grams that start with the begin mark keep plain counts.

Model. For each order and shard a file of sorted n-gram hashes with counts and one of sorted context hashes
with total and numbers of followers seen once, twice and more often. Discounts come from the counts of counts.
The number of shards follows the number of tokens, so a shard holds about `SHARD` tokens however large the corpus.

Scoring. Workers map the files into memory and look up a run's sorted hashes by binary search, shard by shard:

    p(w | h) = max(c(hw) - D(c), 0) / total(h) + backoff(h) * p(w | h less its first word)

down to an even share 1 / (V + 1) for each word, the unknown one included. Unseen contexts leave the lower order as it is.
Files in a folder that all workers mount are mapped; those of another Arrow file system are read shard by shard.

Files carry names of their own and only rows of finished tasks name them, so a repeated or lost task leaves at most
a file that nothing refers to. The driver gets the files' names, one row for each shard, and sums.

Defined cases: a null or empty text is one end token. Null ids are learned from. Repeated rows count each time. Very
long texts are split in pieces of `PIECE` bytes; their word numbers (8 bytes each) are held whole. An empty table,
or one without training rows, gives a model in which every token has probability 1 / (V + 1) = 1. Where a count of
counts is zero, discounts are 0.5, 1 and 1.5. Further columns are ignored. Words and n-grams are told apart by 64-bit hashes
in look-ups, n-grams by their words in counting.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow.llm.hashing import mix
from bazaarflow.session import shared_folder, write_and_reload

ORDER = 2
CHUNK = 1 << 20
SHARD = 1 << 21
PIECE = 1 << 20
KNOWN_WORDS = 400_000  # words whose numbers a worker remembers
END = b""

_FILES = "shard int, path string, size long"
_BLOBS = "order int, kind string, shard int, size long, payload binary, path string, sums binary"


def held_out(id_col: str = "doc_id") -> Column:
    """True where the id's CRC-32 says that a document is kept for testing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text in runs, the end token last."""
    data, begin = data.lower(), 0
    while len(data) - begin > PIECE:
        cut = min((x for x in (data.find(space, begin + PIECE) for space in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if x >= 0), default=len(data))
        yield data[begin:cut].split()
        begin = cut
    yield [*data[begin:].split(), END]


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of the n-grams that stand across the columns of word numbers; all are of one length."""
    found = np.full(len(columns[0]) if columns else 1, len(columns), dtype=np.uint64)
    for column in columns:
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1))
    return found


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes."""
    return ((hashes >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of the columns in ascending order, and how often each occurs."""
    if len(columns) == 2 and all(c.dtype == np.uint32 for c in columns):
        both, counts = np.unique(columns[0].astype(np.uint64) << np.uint64(32) | columns[1], return_counts=True)
        return [(both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)], counts
    columns, (counts,) = summed(columns, np.ones(len(columns[0]), dtype=np.int64))
    return columns, counts


def summed(columns: list[np.ndarray], *counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Different rows of the columns in ascending order, and the sums of their counts."""
    if not len(columns[0]):
        return columns, list(counts)
    if len(columns) == 2 and all(c.dtype == np.uint32 for c in columns):
        order = np.argsort(columns[0].astype(np.uint64) << np.uint64(32) | columns[1])
    else:
        order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], [np.add.reduceat(c[order], starts) for c in counts]


# Blobs: arrays of one length, byte planes first so that small numbers compress
def _packed(arrays: list[np.ndarray]) -> bytes:
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(payload: bytes, size: int, kinds: list) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(payload, decompressed_size=size * sum(widths), codec="zstd"), dtype=np.uint8)
    found, at = [], 0
    for kind, width in zip(kinds, widths):
        planes = raw[at : at + size * width].reshape(width, size)
        found.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * width
    return found


# Files: arrays one after the other, 64-bit ones first
def _store(folder: str, arrays: list[np.ndarray]) -> str:
    name = f"{uuid.uuid4().hex}.arrays"
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as file:
        for array in arrays:
            file.write(np.ascontiguousarray(array))
    return f"{folder.rstrip('/')}/{name}"


def _mapped(uri: str, size: int, kinds: list) -> list[np.ndarray]:
    if not size:
        return [np.zeros(0, dtype=k) for k in kinds]
    system, path = pafs.FileSystem.from_uri(uri)
    if isinstance(system, pafs.LocalFileSystem):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
    else:
        with system.open_input_file(path) as file:
            raw = np.frombuffer(file.read(), dtype=np.uint8)
    found, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize * size
        found.append(raw[at : at + width].view(kind))
        at += width
    return found


class Sorted:
    """Files of one kind, each with the sorted hashes of a range and numbers for each hash."""

    def __init__(self, files: list[tuple[str, int]], kinds: list) -> None:
        self.files, self.kinds = [f for f in files if f[1]], [np.uint64, *kinds]
        self.held: dict[int, list[np.ndarray]] = {}
        self.firsts = np.array([self._file(i)[0][0] for i in range(len(self.files))], dtype=np.uint64)
        self.starts = np.cumsum([0, *[size for _, size in self.files]])

    def _file(self, i: int) -> list[np.ndarray]:
        if i not in self.held:
            uri, size = self.files[i]
            found = _mapped(uri, size, self.kinds)
            if not isinstance(found[0].base, np.memmap) and not isinstance(found[0], np.memmap):  # read, not mapped: one at a time
                self.held.clear()
            self.held[i] = found
        return self.held[i]

    def __getstate__(self) -> dict:
        return {**self.__dict__, "held": {}}

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For sorted hashes: the place of each among all files (-1: absent) and its numbers (0: absent)."""
        places = np.full(len(hashes), -1, dtype=np.int64)
        found = [np.zeros(len(hashes), dtype=k) for k in self.kinds[1:]]
        cuts = np.append(np.searchsorted(hashes, self.firsts[1:]), len(hashes)) if len(self.files) else []
        begin = 0
        for i, end in enumerate(cuts):
            if end > begin:
                keys, *numbers = self._file(i)
                at = np.minimum(np.searchsorted(keys, hashes[begin:end]), len(keys) - 1)
                hit = keys[at] == hashes[begin:end]
                places[begin:end] = np.where(hit, at + self.starts[i], -1)
                for mine, theirs in zip(found, numbers):
                    mine[begin:end] = np.where(hit, theirs[at], 0)
            begin = end
        return places, found

    def numbers(self, hashes: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(hashes)
        found = []
        for mine in self.places(hashes[order])[1]:
            found.append(np.empty_like(mine))
            found[-1][order] = mine
        return found

    def at(self, places: np.ndarray) -> np.ndarray:
        """First number of what stands at sorted places."""
        found = np.zeros(len(places), dtype=self.kinds[1])
        cuts = np.searchsorted(places, self.starts)
        for i in range(len(self.files)):
            mine = places[cuts[i] : cuts[i + 1]]
            if len(mine):
                found[cuts[i] : cuts[i + 1]] = self._file(i)[1][mine - self.starts[i]]
        return found


class Numbering:
    """Numbers of words by the vocabulary; unknown words get the number after the begin mark's."""

    def __init__(self, vocabulary: Sorted, size: int) -> None:
        self.vocabulary, self.unknown, self.known = vocabulary, size + 1, {}

    def of(self, run: list[bytes]) -> np.ndarray:
        new = list(set(run).difference(self.known))
        if new:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
                new = list(set(run))
            hashes = np.array([word_hash(w) for w in new], dtype=np.uint64)
            order = np.argsort(hashes)
            places = self.vocabulary.places(hashes[order])[0]
            found = np.empty(len(new), dtype=np.int64)
            found[order] = np.where(places < 0, self.unknown, places)
            self.known.update(zip(new, found.tolist()))
        return np.fromiter(map(self.known.__getitem__, run), dtype=np.int64, count=len(run))


@dataclass
class Model:
    order: int
    tokens: int  # of the training texts
    types: int  # different ones
    vocabulary: Sorted
    grams: list[Sorted]  # by order, from 1
    contexts: list[Sorted]
    discounts: list[tuple[float, float, float]]

    def log10(self, numbers: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each word, and logarithm of the probability of each but the begin marks (place 0), which get 0."""
        # what depends on one word is looked up once for each different word
        different, word = np.unique(numbers, return_inverse=True)
        count = np.where(different < self.types, self.vocabulary.at(different), 0)[word]
        found = np.full(len(numbers), 1.0 / (self.types + 1))
        for k in range(1, self.order + 1):
            at = np.flatnonzero(place >= max(1, k - 1))
            if not len(at):
                continue
            columns = [numbers[at - i] for i in range(k - 1, -1, -1)]
            if k == 1:
                grams = self.grams[0].numbers(gram_hash([different]))[0][word[at]]
                above = [np.repeat(x, len(at)) for x in self.contexts[0].numbers(gram_hash([]))]
            else:
                grams = self.grams[k - 1].numbers(gram_hash(columns))[0]
                one = k == 2
                above = self.contexts[k - 1].numbers(gram_hash([different] if one else columns[:-1]))
                above = [x[word[at - 1]] for x in above] if one else above
            total, once, twice, more = (x.astype(np.float64) for x in above)
            cut = np.array([0.0, *self.discounts[k - 1]])
            seen = total > 0
            rest = (cut[1] * once + cut[2] * twice + cut[3] * more)[seen] / total[seen]
            direct = np.maximum(grams.astype(np.float64) - cut[np.minimum(grams, 3)], 0.0)[seen] / total[seen]
            found[at[seen]] = direct + rest * found[at[seen]]
        found[place == 0] = 1.0
        return count, np.log10(found)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"), held_out(id_col).alias("held_out"))


def _word_counts(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            hashes = np.array([word_hash(w) for w in counts], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for data in batch["data"]:
                for run_ in words(data.as_py()):
                    counts.update(run_)
                if len(counts) > KNOWN_WORDS:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return train.select("data").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _stored_words(counts: DataFrame, folder: str) -> DataFrame:
    """A file for each range of hashes: (shard, path, size), shards in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            hashes = table["word"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            path = _store(folder, [hashes, table["n"].to_numpy()])
            return pa.RecordBatch.from_pylist([{"first": int(table["word"][0].as_py()), "path": path, "size": len(table), "tokens": int(table["n"].to_numpy().sum())}])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SHARD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    # signed order of the flipped hash is the unsigned order of the hash
    flipped = counts.select(F.col("word").bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("word"), "n")
    return flipped.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(run, "first long, path string, size long, tokens long")


class _Dealer:
    """Collects n-grams by order and deals them out by shard."""

    def __init__(self, shards: int, kind) -> None:
        self.shards, self.kind = shards, kind

    def blobs(self, order: int, name: str, columns: list[np.ndarray], counts: list[np.ndarray], hashes: np.ndarray) -> Iterator[dict]:
        shard = shard_of(hashes, self.shards)
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(self.shards + 1))
        for s in range(self.shards):
            rows = by[cuts[s] : cuts[s + 1]]
            if len(rows):
                yield {"order": order, "kind": name, "shard": s, "size": len(rows), "payload": _packed([c[rows] for c in (*columns, *counts)])}

    def grams(self, order: int, columns: list[np.ndarray]) -> Iterator[dict]:
        columns, counts = counted([c.astype(self.kind) for c in columns])
        yield from self.blobs(order, "gram", columns, [counts], gram_hash(columns))


_SHAPE = pa.schema([("order", pa.int32()), ("kind", pa.string()), ("shard", pa.int32()), ("size", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("sums", pa.binary())])


def _batch(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=_SHAPE)


def _runs(batches: Iterator[pa.RecordBatch], numbering: Numbering, begin: int, limit: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(rows, numbers with a begin mark before each text, place in the text) for runs of whole texts of about limit tokens."""
    rows, held, size = [], [], 0

    def out():
        places = np.concatenate([np.arange(len(x)) for x in held])
        return rows, np.concatenate(held), places

    mark = np.array([begin], dtype=np.int64)
    for batch in batches:
        others = [batch[c] for c in batch.schema.names if c != "data"]
        for i, data in enumerate(batch["data"]):
            held.append(np.concatenate([mark, *map(numbering.of, words(data.as_py()))]))
            rows.append([o[i].as_py() for o in others])
            size += len(held[-1])
            if size >= limit:
                yield out()
                rows, held, size = [], [], 0
    if rows:
        yield out()


def _gram_blobs(train: DataFrame, vocabulary: Sorted, types: int, order: int, shards: int, kind) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(shards, kind)
        for _, numbers, place in _runs(batches, Numbering(vocabulary, types), types, CHUNK):
            for k in range(1 if order == 1 else 2, order + 1):
                # below the highest order only n-grams that start with the begin mark
                at = np.flatnonzero(place >= max(1, k - 1) if k == order else place == k - 1)
                for row in dealer.grams(k, [numbers[at - i] for i in range(k - 1, -1, -1)]):
                    yield _batch(row)

    return train.select("data").mapInArrow(run, _BLOBS)


def _gathered(batches: Iterator[pa.RecordBatch], kinds: list, keys: int) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """(shard, summed key columns, sums), shard after shard."""

    def merge(parts: list) -> list:
        arrays = [np.concatenate(x) for x in zip(*parts)]
        columns, counts = summed(arrays[:keys], *arrays[keys:])
        return [*columns, *counts]

    now, parts, size, least = None, [], 0, 0
    for batch in batches:
        for shard, n, payload in zip(*(batch[c].to_pylist() for c in ("shard", "size", "payload"))):
            if shard != now and parts:
                whole = merge(parts)
                yield now, whole[:keys], whole[keys:]
                parts, size, least = [], 0, 0
            now = shard
            parts.append(_unpacked(payload, n, kinds))
            size += n
            if size > max(SHARD, 2 * least):  # copies from many runs shrink before more arrive
                parts = [merge(parts)]
                size = least = len(parts[0][0])
    if parts:
        whole = merge(parts)
        yield now, whole[:keys], whole[keys:]


def _dealt(blobs: DataFrame, order: int, name: str, shards: int) -> DataFrame:
    found = blobs.filter((F.col("order") == order) & (F.col("kind") == name)).select("shard", "size", "payload")
    return found.repartition(shards, "shard").sortWithinPartitions("shard")


def _merged_grams(blobs: DataFrame, order: int, shards: int, kind, folder: str) -> DataFrame:
    """Stores the n-grams of an order; gives rows for the files, blobs for its contexts and for the next lower order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(shards, kind)
        for shard, columns, (counts,) in _gathered(batches, [*[kind] * order, np.int64], order):
            hashes = gram_hash(columns)
            by = np.argsort(hashes)
            path = _store(folder, [hashes[by], np.minimum(counts[by], 0xFFFFFFFF).astype(np.uint32)])
            seen = np.array([np.count_nonzero(counts == i) for i in (1, 2, 3, 4)], dtype=np.int64)
            yield _batch({"order": order, "kind": "grams", "shard": shard, "size": len(counts), "path": path, "sums": seen.tobytes()})
            above = gram_hash(columns[:-1]) if order > 1 else np.repeat(gram_hash([]), len(counts))
            sums = [counts, *[(counts == i).astype(np.int64) for i in (1, 2)], (counts > 2).astype(np.int64)]
            (above,), sums = summed([above], *sums)
            for row in dealer.blobs(order, "context", [above], sums, above):
                yield _batch(row)
            if order > 1:
                for row in dealer.grams(order - 1, columns[1:]):
                    yield _batch(row)

    return _dealt(blobs, order, "gram", shards).mapInArrow(run, _BLOBS)


def _merged_contexts(blobs: DataFrame, order: int, shards: int, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (hashes,), (total, *follow) in _gathered(batches, [np.uint64, *[np.int64] * 4], 1):
            path = _store(folder, [hashes, total, *[np.minimum(f, 0xFFFFFFFF).astype(np.uint32) for f in follow]])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(hashes)], pa.int64())], ["shard", "path", "size"])

    return _dealt(blobs, order, "context", shards).mapInArrow(run, _FILES)


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """Of counts one, two, and three or more, from the numbers of n-grams with counts one to four."""
    if all(counts):
        one, two, three, four = counts
        y = one / (one + 2 * two)
        found = (1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three)
        if all(0 <= d <= i for i, d in enumerate(found, 1)):
            return found
    return 0.5, 1.0, 1.5


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, shard: int = SHARD) -> Model:
    """Model of the texts that are not held out, stored in the shared folder."""
    train = _narrow(docs, id_col, text_col).filter(~F.col("held_out")).select("data")
    folder = shared_folder(docs.sparkSession, "kneser-ney")
    files = sorted(write_and_reload(_stored_words(_word_counts(train), folder), "words").collect(), key=lambda r: r["first"])  # a row for each file
    types, tokens = sum(r["size"] for r in files), sum(r["tokens"] for r in files)
    vocabulary = Sorted([(r["path"], r["size"]) for r in files], [np.int64])
    shards, kind = max(1, -(-tokens // shard)), np.uint32 if types < (1 << 32) - 2 else np.uint64
    blobs = write_and_reload(_gram_blobs(train, vocabulary, types, order, shards, kind), "grams")
    grams, contexts, cuts = [], [], []
    for k in range(order, 0, -1):
        stage = write_and_reload(_merged_grams(blobs, k, shards, kind, folder), "grams")
        made = stage.filter("kind = 'grams'").select("shard", "path", "size", "sums").collect()  # a row for each shard
        made.sort(key=lambda r: r["shard"])
        grams.insert(0, Sorted([(r["path"], r["size"]) for r in made], [np.uint32]))
        cuts.insert(0, discounts([sum(int(x) for x in c) for c in zip(*(np.frombuffer(r["sums"], dtype=np.int64) for r in made))] or [0]))
        found = sorted(_merged_contexts(stage, k, shards, folder).collect(), key=lambda r: r["shard"])
        contexts.insert(0, Sorted([(r["path"], r["size"]) for r in found], [np.int64, np.uint32, np.uint32, np.uint32]))
        blobs = blobs.unionByName(stage)
    return Model(order, tokens, types, vocabulary, grams, contexts, cuts)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity for every row of docs."""
    narrow = _narrow(docs, id_col, text_col)
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = Numbering(model.vocabulary, model.types)
        ident = None

        def watched():
            nonlocal ident
            for batch in batches:
                ident = batch.schema.field("id").type
                yield batch

        for rows, numbers, place in _runs(watched(), numbering, model.types, CHUNK // 2):
            starts = np.flatnonzero(place == 0)
            known = (numbers < model.types) & (place > 0)
            count, logarithm = model.log10(numbers, place)
            base = np.where(place > 0, np.log10((count + 1) / (model.tokens + model.types + 1)), 0.0)
            lengths = np.diff(np.append(starts, len(numbers))) - 1
            score = np.add.reduceat(logarithm, starts)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], ident), pa.array([r[1] for r in rows], pa.bool_()), pa.array(lengths), pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                pa.array(np.full(len(rows), model.tokens)), pa.array(np.add.reduceat(base, starts)), pa.array(score), pa.array(10.0 ** (-score / lengths)),
            ], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return narrow.select("id", "held_out", "data").mapInArrow(
        run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

