"""N-gram Jaccard self-join with PartEnum signatures, exact, and its connected components.

**Signatures.** Sets of similar size fall into bands. Two sets of a band that reach the similarity
differ in at most k elements. The features are dealt over n1 parts, each of n2 smaller ones; at
least one part then has at most k2 differences, so n2 - k2 of its smaller parts are equal in both
sets, and each subset of n2 - k2 smaller parts is enumerated as a signature. A set near its band's upper
end also signs in the next band. n1 holds some parts to spare, so signatures of empty parts are only
needed from sets that have more of those than the spare; that keeps them rare (see `Scheme`).

**Candidates.** Equal sets are one node from the start. A task keeps one signature row for each
signature and sends further members past the grouping, so even a signature of a third of all nodes
is met by one row from each task. Signatures of one node end here. Parts to spare mean that a similar pair shares
several signatures (`needed`), so each node drops all but one of that many, its most frequent ones.

**Links.** In a small bucket all pairs are candidates, in a large one the pairs with its most central node.
Candidates must pass two exact bounds, on sizes and on 256-bit parity sketches (their difference never
exceeds the sets' difference), then the same with 1024 bits and, for long sets, with four bits an element. Each node is compared with its most linked candidate first, then the
candidates whose nodes are still in different components. Nodes of large buckets that are still split meet once more by
their rarest elements (two sets that reach the similarity share one of these), as families with much text in common share
signatures by the square of their size, but few rare elements. Buckets of such an element that hold several components
compare members of different ones, in blocks of bounded size.

Only links inside a component may stay unlooked at, so components are those of all links.

Defined cases: a null text, or one without words, has an empty set, no links and is its own component.
Rows that repeat are equal sets. Null ids never are a component's smallest id, unless all are null. An
empty table gives an empty result. Further columns are ignored. Elements, sets and signatures are
64-bit hashes; sets with equal and wrong hashes are noticed by a second hash and hashed anew.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from bazaarflow.llm import components, worker_memory
from bazaarflow.llm.exact_dedup import joined
from bazaarflow.llm.hashing import mix
from bazaarflow.llm.names import free
from bazaarflow.llm.shingles import shingle_set
from bazaarflow.session import write_and_reload

SMALL = 16
FLUSH = 1_000_000
BLOCK, STRAYS = 2048, 512
SKETCH = ["s0", "s1", "s2", "s3"]
WIDE_BITS = 1024
DEEP = 4  # bits for each element of a long set's sketch, at least
TOLD = 500_000  # nodes whose numbers are broadcast at most
COMMON = 1 << 20  # elements known as common at most
MARKS = 1 << 25  # bits of the table that tells open nodes


@dataclass(frozen=True)
class Scheme:
    """PartEnum for similarity share / whole over sets of words; n2 and k2 as in the module's text."""

    width: int = 5
    share: int = 80
    whole: int = 100
    n2: int = 2
    k2: int = 1
    growth: float = 1.5

    def differences(self, sizes: int) -> int:
        """Most elements in which two sets with that sum of sizes may differ."""
        return (self.whole - self.share) * sizes // (self.whole + self.share)

    def reaches(self, common: int, sizes: int) -> bool:
        return self.whole * common >= self.share * (sizes - common)

    def bound(self, bits: np.ndarray, one: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Could sets of sizes one and other, whose sketches differ in bits, reach the similarity?"""
        close = bits * (self.whole + self.share) <= (self.whole - self.share) * sizes
        return close & (self.whole * np.minimum(one, other) >= self.share * np.maximum(one, other))

    def bands(self, size: int) -> list[int]:
        """Upper ends of the bands in which a set of that size signs."""
        tops = _tops(max(self.growth, self.whole / self.share), size * self.whole // self.share)
        own = int(np.searchsorted(tops, size))
        return [int(t) for t in tops[own : own + 2] if t == tops[own] or size * self.whole >= self.share * (tops[own] + 1)]

    def rarest(self, size: int) -> int:
        """So many first elements, in one order of all elements, of each of two sets that reach the similarity have one in common."""
        return size - -(-self.share * size // self.whole) + 1

    def layout(self, top: int) -> tuple[int, int]:
        """n1 and the parts to spare of a band."""
        k = self.differences(2 * top)
        bare = k // (self.k2 + 1) + 1
        each = top / self.growth * (self.n2 - self.k2) / (bare * self.n2)
        rate = bare * math.comb(self.n2, self.k2) * math.exp(-each)
        spare = math.ceil(rate + 4 * math.sqrt(rate)) if bare > 3 else 1
        return bare + spare, spare

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """Signatures of a set; sets that reach the similarity and are not equal share at least one."""
        found = []
        for top in self.bands(len(elements)):
            if not self.differences(2 * top):
                continue
            n1, spare = self.layout(top)
            part = self._dealt(elements, top, n1)
            sums, counts = np.zeros(n1 * self.n2, dtype=np.uint64), np.bincount(part, minlength=n1 * self.n2).reshape(n1, self.n2)
            np.add.at(sums, part, elements)
            mixed = mix(sums.reshape(n1, self.n2).T ^ np.arange(1, self.n2 + 1, dtype=np.uint64)[:, None])
            subsets = list(itertools.combinations(range(self.n2), self.n2 - self.k2))
            marks = mix(np.array([mixed[list(s)].sum(axis=0, dtype=np.uint64) for s in subsets]) ^ _places(top, n1, len(subsets)))
            full = np.array([counts[:, list(s)].sum(axis=1) > 0 for s in subsets])
            sparse = (~full).any(axis=0).sum() > spare
            found.append(marks.ravel() if sparse else marks[full])
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)

    def _dealt(self, elements: np.ndarray, top: int, n1: int) -> np.ndarray:
        """The smaller part of each element in a band."""
        dealt = elements * np.uint64(0xD6E8FEB86659FD93 + 2 * top)
        high, low = dealt >> np.uint64(32), dealt & np.uint64(0xFFFFFFFF)
        return ((high * np.uint64(n1) >> np.uint64(32)) * np.uint64(self.n2) + (low * np.uint64(self.n2) >> np.uint64(32))).astype(np.int64)

    def needed(self, elements: np.ndarray) -> int:
        """Signatures that a set shares at least with each different set that it reaches.

        Of n1 parts, at most bare - 1 hold more than k2 differences, so spare + 1 parts share a signature each, less those
        of the parts in which the set has an empty subset.
        """
        found = []
        for top in self.bands(len(elements)):
            if self.differences(2 * top):
                n1, spare = self.layout(top)
                counts = np.bincount(self._dealt(elements, top, n1), minlength=n1 * self.n2).reshape(n1, self.n2)
                poor = int(((counts == 0).sum(axis=1) >= self.n2 - self.k2).sum())
                found.append(max(1, spare + 1 - poor))
        return min(found, default=1)


@lru_cache(maxsize=24)
def _places(top: int, n1: int, subsets: int) -> np.ndarray:
    """What a band's signatures of equal content in different places differ by."""
    place = np.arange(n1, dtype=np.uint64) * np.uint64(1 << 20) + (np.uint64(top) << np.uint64(36))
    return mix(place + np.arange(subsets, dtype=np.uint64)[:, None])


@lru_cache(maxsize=64)
def _tops_upto(ratio: float, power: int) -> np.ndarray:
    tops, top = [], 4
    for _ in range(power):
        tops.append(top)
        top = max(top + 1, math.ceil(top * ratio))
    return np.array(tops, dtype=np.int64)


def _tops(ratio: float, size: int) -> np.ndarray:
    """Upper ends of bands, far enough for a size."""
    power = 8
    while (tops := _tops_upto(ratio, power))[-1] <= size:
        power *= 2
    return tops


def node_of(elements: np.ndarray, seed: int = 0) -> int:
    """64-bit hash of a set of hashes."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(elements ^ np.uint64(0x51ED270B + seed)).sum(dtype=np.uint64) + np.uint64(len(elements))]))[0].astype(np.int64))


def sketch_of(elements: np.ndarray, bits: int = 256) -> np.ndarray:
    """Parities, a power of two: bit i tells whether an odd number of elements fall on i."""
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def deep_sketch(elements: np.ndarray) -> np.ndarray | None:
    """A sketch in proportion to the set, where WIDE_BITS are too few to tell sets apart."""
    bits = 1 << (DEEP * len(elements) - 1).bit_length() if len(elements) else 0
    return sketch_of(elements, bits) if bits > WIDE_BITS else None


def _bits_apart(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ; the longer one is folded to the length of the shorter."""
    least = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)
    folded = lambda s: F.aggregate(
        F.sequence(F.lit(0), (F.size(s) / least).cast("int") - 1), F.array_repeat(F.lit(0).cast("long"), least), lambda acc, i: F.zip_with(acc, F.slice(s, i * least + 1, least), xor)
    )
    return F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda n, x: n + x)


def _narrowed(sketch: Column) -> Column:
    """A sketch folded to a fourth of its length."""
    part = lambda i: F.slice(sketch, (F.size(sketch) / 4).cast("int") * i + 1, (F.size(sketch) / 4).cast("int"))
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), [part(i) for i in range(4)])


def _differing(pairs) -> np.ndarray:
    """Bits in which the words of two sketches differ; the words are signed in Spark."""
    return sum(np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64) for a, b in pairs)


class _Folds:
    """Sketches of several lengths, 256 bits at least, as a table for each length that holds all sketches of it or longer ones folded to it."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray) -> None:
        self.lengths, starts = lengths, np.cumsum(lengths) - lengths
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        own = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
        for least in sorted({len(SKETCH), *own}):
            place, parts, held = np.full(len(lengths), -1, dtype=np.int64), [], 0
            for n, rows in own.items():
                if n >= least:
                    whole = words[starts[rows, None] + np.arange(n)]
                    parts.append(np.bitwise_xor.reduce(whole.reshape(len(rows), n // least, least), axis=1))
                    place[rows] = held + np.arange(len(rows))
                    held += len(rows)
            self.tables[least] = place, np.concatenate(parts)

    def narrow(self) -> np.ndarray:
        """All sketches at 256 bits."""
        place, table = self.tables[len(SKETCH)]
        return table[place]

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of rows i and j differ, at the length of the shorter."""
        common, bits = np.minimum(self.lengths[i], self.lengths[j]), np.zeros(len(i), dtype=np.int64)
        for n in np.unique(common):
            place, table = self.tables[int(n)]
            same = np.flatnonzero(common == n)
            step = max(1, FLUSH // int(n))
            for at in range(0, len(same), step):
                cut = same[at : at + step]
                bits[cut] = np.bitwise_count((table[place[i[cut]]] ^ table[place[j[cut]]]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        return bits


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _sha(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def _parts(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


def _described(texts: DataFrame, scheme: Scheme) -> tuple[DataFrame, int]:
    """Stored id, sha if texts has it, size, node, sketch of every row (node is null for an empty set), and the seed of the nodes."""
    names = [c for c in texts.columns if c != "text"]
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names)

    def run_with(seed: int):
        def run(batches):
            worker_memory.kept("jaccard")
            for part in _parts(batches):
                rows, wide, deep = [], [], []
                for text in part["text"].to_pylist():
                    held = shingle_set(text, scheme.width)
                    full = len(held) > 0
                    wide.append(sketch_of(held, WIDE_BITS) if full else None)
                    deep.append(deep_sketch(held))
                    nodes = [node_of(held, s) if full else None for s in (seed, seed + 1)]
                    rows.append((len(held), *nodes, scheme.needed(held) if full else None, *(int(x) for x in sketch_of(held))))
                columns = [*(part[c] for c in names), *(pa.array(c, pa.int64()) for c in zip(*rows)), *(pa.array(c, pa.list_(pa.int64())) for c in (wide, deep))]
                yield pa.RecordBatch.from_arrays(columns, [*names, "size", "node", "other", "need", *SKETCH, "wide", "deep"])

        return run

    for seed in range(0, 16, 2):
        stored = write_and_reload(texts.mapInArrow(run_with(seed), f"{kinds}, size long, node long, other long, need long, " + ", ".join(f"{s} long" for s in SKETCH) + ", wide array<long>, deep array<long>"), "sets")
        clash = stored.filter("node is not null").groupBy("node").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a <> b")
        if clash.isEmpty():
            return stored, seed
    raise RuntimeError("different sets share 64-bit hashes under every seed")


def _chosen(part: pa.RecordBatch, marked: np.ndarray | None) -> list[str | None]:
    """The texts of a batch, or those whose mark is set in the table."""
    texts = part["text"]
    if marked is not None:
        at = part["mark"].to_numpy()
        texts = texts.filter(pa.array(marked[at >> 6] >> (at & 63) & 1 == 1))
    return texts.to_pylist()


def _buckets(texts: DataFrame, scheme: Scheme, seed: int, signatures: Callable[[np.ndarray], np.ndarray], marked: np.ndarray | None = None) -> DataFrame:
    """(sig, node) of all signatures that at least two nodes share; with marked, of the texts marked in it."""

    def sign(batches):
        worker_memory.kept("jaccard")
        seen: set[int] = set()
        sigs, nodes, held = [], [], 0

        def flush():
            nonlocal sigs, nodes, held
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            order = np.lexsort((node, sig))
            same = sig[order][1:] == sig[order][:-1]
            first, shared = np.empty(len(sig), dtype=bool), np.zeros(len(sig), dtype=bool)
            first[order] = np.concatenate(([True], ~same))
            shared[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
            # the first member of a signature meets other tasks' rows under it, the others go anywhere;
            # rows stay in the order of their nodes, so they compress well
            route = np.where(first, sig, mix(sig.view(np.uint64) ^ node.view(np.uint64)).view(np.int64))
            away = pa.array(sig, mask=first)
            sigs, nodes, held = [], [], 0
            for i in range(0, len(sig), 50_000):
                cut = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(route[cut]), away[cut], pa.array(node[cut]), pa.array(shared[cut])], ["route", "sig", "node", "shared"])

        for part in _parts(batches):
            for text in _chosen(part, marked):
                elements = shingle_set(text, scheme.width)
                if not len(elements):
                    continue
                node = node_of(elements, seed)
                if node in seen:
                    continue
                seen.add(node)
                found = signatures(elements)
                sigs.append(found.view(np.int64))
                nodes.append(np.full(len(found), node, dtype=np.int64))
                held += len(found)
                if held >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def meet(batches):
        """Rows come ordered by route; keep those of signatures with two nodes or more."""
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is None:
                columns = rest
                rest = None
            else:
                route, node, shared = (batch[c].to_numpy(zero_copy_only=False) for c in ("route", "node", "shared"))
                first = batch["sig"].is_null().to_numpy(zero_copy_only=False)
                columns = [route, np.where(first, route, batch["sig"].fill_null(0).to_numpy()), node, first, shared]
                if rest is not None:
                    columns = [np.concatenate(p) for p in zip(rest, columns)]
                # what may go on in the next batch waits
                waiting = columns[0] == columns[0][-1]
                rest = [c[waiting] for c in columns]
                columns = [c[~waiting] for c in columns]
            if columns is None or not len(columns[0]):
                continue
            if ((columns[0][1:] == columns[0][:-1]) & (columns[1][1:] != columns[1][:-1])).any():  # routes hardly ever clash
                order = np.lexsort((columns[1], columns[0]))
                columns = [c[order] for c in columns]
            route, sig, node, first, shared = columns
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (route[1:] != route[:-1])))
            group = np.cumsum(new) - 1
            begins = np.flatnonzero(new)
            several = np.maximum.reduceat(node, begins) != np.minimum.reduceat(node, begins)
            several |= np.logical_or.reduceat(shared, begins)
            keep = several[group] | ~first
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(node[keep])], ["sig", "node"])

    signed = texts.select("text", *["mark"] * (marked is not None)).mapInArrow(sign, "route long, sig long, node long, shared boolean")
    met = signed.repartition("route").sortWithinPartitions("route").mapInArrow(meet, "sig long, node long")
    return met.distinct()


def _common(texts: DataFrame, scheme: Scheme, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements that come often in the marked texts, in order, and how often at least.

    An element counts where it comes again among about FLUSH elements of a task, so most elements, which come once, stay in
    their task. The counts only order the elements, so they need not be whole; the most frequent COMMON are kept.
    """

    def run(batches):
        worker_memory.kept("jaccard")
        parts, held = [], 0

        def flush():
            nonlocal parts, held
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            parts, held = [], 0
            again = n > 1
            if again.any():
                yield pa.RecordBatch.from_arrays([pa.array(found[again].view(np.int64)), pa.array(n[again].astype(np.int64))], ["element", "n"])

        for part in _parts(batches):
            for text in _chosen(part, marked):
                elements = shingle_set(text, scheme.width)
                parts.append(elements)
                held += len(elements)
                if held >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    counted = write_and_reload(texts.select("text", "mark").mapInArrow(run, "element long, n long").groupBy("element").agg(F.sum("n").alias("n")), "common")
    powers = counted.groupBy(F.log2(F.col("n").cast("double")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()
    least, total = 0, 0
    for power, n in sorted(powers, reverse=True):
        total += n
        if total > COMMON:
            least = 2 << power
            break
    found = counted.filter(F.col("n") >= least).toArrow()
    elements, n = found["element"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(elements)
    return elements[order], n[order]


class _Join:
    """The parts of one run: nodes (node, first_id, copies, size, sketch), zipped texts of candidates, buckets."""

    def __init__(self, docs: DataFrame, scheme: Scheme, id_col: str, text_col: str, hashed: bool = False) -> None:
        self.scheme = scheme
        self.texts = _texts(docs, id_col, text_col)
        self.sets, self.seed = _described(self.texts.withColumn("sha", _sha("text")) if hashed else self.texts, scheme)
        self.nodes = self.sets.filter("node is not null").groupBy("node").agg(
            F.min("id").alias("first_id"), F.count("*").alias("copies"), F.max("size").alias("size"), F.max("need").alias("need"), *[F.max(s).alias(s) for s in SKETCH]
        )
        buckets = self._telling(write_and_reload(_buckets(self.texts, scheme, self.seed, scheme.signatures), "buckets"))
        self.shape = write_and_reload(buckets.select("node").distinct().join(self.nodes, "node"), "candidates")
        chosen = self.shape.select("node", F.col("first_id").alias("id"))
        same = self.sets["node"].eqNullSafe(chosen["node"]) & self.sets["id"].eqNullSafe(chosen["id"])
        self.wide = write_and_reload(self.sets.join(chosen, same, "left_semi").select("node", "size", "wide", "deep").dropDuplicates(["node"]), "sketches")
        self.members = write_and_reload(buckets.join(self.shape.select("node", "size", *SKETCH), "node"), "members")

    def _telling(self, buckets: DataFrame) -> DataFrame:
        """Stored (sig, node, members) of the signatures by which links are still found, the rarest ones.

        A node that shares `need` signatures with each partner leaves out the need - 1 most frequent ones: in one order
        of all signatures, both of a pair then still have the pair's first shared one. Nodes with fewer have no partner.
        """
        sizes = buckets.groupBy("sig").agg(F.count("*").alias("members"))
        own = Window.partitionBy("node")
        told = buckets.join(sizes, "sig").join(self.nodes.select("node", "need"), "node")
        placed = told.withColumn("place", F.row_number().over(own.orderBy("members", "sig"))).withColumn("held", F.count("*").over(own))
        kept = write_and_reload(placed.filter("place <= held - need + 1").select("sig", "node"), "telling")
        left = kept.groupBy("sig").agg(F.count("*").alias("members")).filter("members > 1")
        return write_and_reload(kept.join(left, "sig"), "buckets")

    def bodies(self, wanted: DataFrame) -> DataFrame:
        """Stored (node, zipped text) of the wanted nodes, all of them candidates.

        A node's smallest id leads to a row of it, and to others where ids repeat, so nodes are still looked at.
        """
        scheme, seed = self.scheme, self.seed

        def run(batches):
            seen: set[int] = set()
            for part in _parts(batches):
                rows = []
                for text in part["text"].to_pylist():
                    elements = shingle_set(text, scheme.width)
                    node = node_of(elements, seed)
                    if len(elements) and node not in seen:
                        seen.add(node)
                        rows.append((node, zlib.compress(text.encode(), 1)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "body"])

        wanted, texts = write_and_reload(wanted, "wanted"), self.texts
        if wanted.count() <= TOLD:  # a node and an id each; tasks then cut only wanted texts into words and keep those, beyond that all are shuffled
            held = self.shape.join(wanted, "node", "left_semi").select(F.col("first_id").alias("held_id")).distinct()
            held = F.broadcast(write_and_reload(held, "held"))
            texts, wanted = texts.join(held, texts["id"].eqNullSafe(held["held_id"]), "left_semi"), F.broadcast(wanted)
        zipped = texts.select("text").mapInArrow(run, "node long, body binary")
        return write_and_reload(zipped.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "bodies")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that pass the bounds on sizes and sketches."""
        side = lambda x: self.shape.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), *[F.col(s).alias(f"{x}_{s}") for s in SKETCH])
        return pairs.join(side("u"), "u").join(side("v"), "v").filter(_passes(self.scheme, "u_", "v_")).select("u", "v")

    def closer(self, pairs: DataFrame) -> DataFrame:
        """The pairs that also pass the bound on wide sketches, then on those in proportion to long sets: too large to travel with signatures."""
        for kind in ("wide", "deep"):
            side = lambda x: self.wide.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col(kind).alias(f"{x}_{kind}"))  # noqa: B023, E731
            u, v = F.col(f"u_{kind}"), F.col(f"v_{kind}")
            most = (F.col("u_size") + F.col("v_size")) * (self.scheme.whole - self.scheme.share)
            near = _bits_apart(u, v) * (self.scheme.whole + self.scheme.share) <= most
            pairs = pairs.join(side("u"), "u").join(side("v"), "v").filter(u.isNull() | v.isNull() | near).select("u", "v")
        return pairs

    def links(self, pairs: DataFrame, bodies: DataFrame) -> DataFrame:
        """Stored links among candidate pairs (u, v)."""
        scheme = self.scheme

        def run(batches):
            last, held = None, None
            for part in _parts(batches, 200):
                good = []
                for v, a, b in zip(part["v"].to_pylist(), part["a"].to_pylist(), part["b"].to_pylist()):
                    if last != v:
                        last, held = v, shingle_set(zlib.decompress(b).decode(), scheme.width)
                    other = shingle_set(zlib.decompress(a).decode(), scheme.width)
                    common = len(np.intersect1d(other, held, assume_unique=True))
                    good.append(scheme.reaches(common, len(other) + len(held)))
                yield pa.RecordBatch.from_arrays([part["u"], part["v"]], ["u", "v"]).filter(pa.array(good, pa.bool_()))

        a = bodies.select(F.col("node").alias("u"), F.col("body").alias("a"))
        b = bodies.select(F.col("node").alias("v"), F.col("body").alias("b"))
        return write_and_reload(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "links")

    def labels(self) -> DataFrame:
        """(node, label) of all nodes with a link."""
        large = self.members.filter(F.col("members") > SMALL)
        # the node that meets most others stands in the middle of its group of near copies
        weight = large.groupBy("node").agg(F.sum("members").alias("weight"))
        middle = large.join(weight, "node").groupBy("sig").agg(F.max_by("node", F.col("weight")).alias("middle"))
        spokes = large.join(middle, "sig").filter("node <> middle").select(F.least("node", "middle").alias("u"), F.greatest("node", "middle").alias("v"))
        pairs = write_and_reload(self.closer(self._within().union(self.bounded(spokes.distinct())).distinct()), "pairs")
        both = pairs.union(pairs.select("v", "u"))
        bodies = self.bodies(both.select(F.col("u").alias("node")).distinct())

        # each node with its most linked neighbour first; of the other pairs only those that could still join components
        degree = both.groupBy("u").agg(F.count("*").alias("degree"))
        hub = both.join(degree.select(F.col("u").alias("v"), "degree"), "v").groupBy("u").agg(F.max_by("v", F.struct("degree", "v")).alias("v"))
        links = self.links(hub.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), bodies)
        known = write_and_reload(components.labels(links), "labels")
        open_pairs = _apart(pairs, known)
        more = self.links(open_pairs, bodies)
        if not more.isEmpty():
            links = links.union(more)
            known = write_and_reload(components.labels(links), "labels")
        if large.isEmpty():
            return known
        rare = self._rare(large, known)
        if rare is None:
            return known
        across = write_and_reload(self.closer(write_and_reload(self._across(rare, known), "across")), "pairs")
        if across.isEmpty():
            return known
        more = self.links(across, self.bodies(across.select(F.col("u").alias("node")).union(across.select("v")).distinct()))
        return known if more.isEmpty() else components.labels(links.union(more))

    def _within(self) -> DataFrame:
        """All pairs of a small bucket that pass the bounds."""
        scheme, names = self.scheme, ["sig", "node", "size", *SKETCH]

        def pairs(columns: list[np.ndarray]):
            for step in range(1, SMALL):
                sig, node, size, *sketch = columns
                if len(sig) <= step:
                    break
                sizes = size[step:] + size[:-step]
                bits = _differing((x[step:], x[:-step]) for x in sketch)
                good = (sig[step:] == sig[:-step]) & scheme.bound(bits, size[step:], size[:-step], sizes)
                if good.any():
                    u, v = node[:-step][good], node[step:][good]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

        def run(batches):
            rest = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = [batch[c].to_numpy(zero_copy_only=False) for c in names]
                if rest is not None:
                    columns = [np.concatenate(p) for p in zip(rest, columns)]
                waiting = columns[0] == columns[0][-1]
                rest = [c[waiting] for c in columns]
                yield from pairs([c[~waiting] for c in columns])
            if rest is not None:
                yield from pairs(rest)

        small = self.members.filter(F.col("members") <= SMALL).select(names)
        return small.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "u long, v long").distinct()

    def _rare(self, large: DataFrame, known: DataFrame) -> DataFrame | None:
        """Stored (sig, node) of the rare elements that nodes of split large buckets share; None if no large bucket is split.

        Pairs that are still open lie in such a bucket, so both of their nodes are signed here. Other texts may be, too:
        texts with the id of a wanted one or with the same mark.
        """
        scheme = self.scheme
        labelled = large.select("sig", "node").join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
        split = labelled.groupBy("sig").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b")
        open_nodes = write_and_reload(large.select("sig", "node").join(split, "sig", "left_semi").select("node").distinct(), "open")
        if open_nodes.isEmpty():
            return None
        mark = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
        marks = self.shape.join(open_nodes, "node", "left_semi").select(mark("first_id").alias("mark"))
        words = marks.groupBy(F.shiftright("mark", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(mark & 63 as int)))").alias("bits")).toArrow()
        marked = np.zeros(MARKS >> 6, dtype=np.int64)
        marked[words["word"].to_numpy()] = words["bits"].to_numpy()
        texts = self.texts.withColumn("mark", mark("id"))
        common, often = _common(texts, scheme, marked)

        def first(elements: np.ndarray) -> np.ndarray:
            n = np.zeros(len(elements), dtype=np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, elements), len(common) - 1)
                n = np.where(common[at] == elements, often[at], 0)
            return elements[np.argsort(n, kind="stable")[: scheme.rarest(len(elements))]]

        return write_and_reload(_buckets(texts, scheme, self.seed, first, marked), "rare")

    def _across(self, large: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs of different components in the same bucket that pass the bounds.

        The members outside a bucket's most frequent component are its strays. Each block has up to
        about STRAYS strays and BLOCK members; every stray meets every member in one block. The bound needs a bit for each
        element, or nearly all pairs of long sets pass it in every bucket that they share. Sketches don't compress,
        so members get theirs on the way to the blocks only, and each step before is stored, which ends its shuffles.
        """
        scheme = self.scheme
        labelled = write_and_reload(large.select("sig", "node").join(known, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        by_label = labelled.groupBy("sig", "label").agg(F.count("*").alias("n"))
        main = by_label.groupBy("sig").agg(F.max_by("label", "n").alias("main"), F.sum("n").alias("all"), F.max("n").alias("n"))
        split = main.filter(F.col("all") > F.col("n")).select(
            "sig", "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("columns"), F.ceil((F.col("all") - F.col("n")) / STRAYS).cast("int").alias("rows")
        )
        rows = write_and_reload(labelled.join(split, "sig"), "split")
        place = lambda n: F.pmod(F.xxhash64("node"), F.col(n).cast("long")).cast("int")
        is_stray = F.col("label") != F.col("main")
        # a stray is a member too; the one block that has it as both gets it once
        members = rows.withColumn("column", place("columns")).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("member", F.lit(True)).withColumn("stray", is_stray & (F.col("row") == place("rows")))
        strays = rows.filter(is_stray).withColumn("row", place("rows")).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).filter(F.col("column") != place("columns")).withColumn("member", F.lit(False)).withColumn("stray", F.lit(True))
        placed = ["sig", "row", "column", "member", "stray", "node", "label"]
        names = [*placed, "size", "sketch"]
        told = self.wide.select("node", "size", _narrowed(F.coalesce("deep", "wide")).alias("sketch"))
        met = members.select(placed).union(strays.select(placed)).join(told, "node")
        blocks = met.select(names).repartition("sig", "row", "column").sortWithinPartitions("sig", "row", "column")

        def compare(blocks: list[list[np.ndarray]], begins: np.ndarray):
            """Small blocks are compared all at once, row by row with the next ones, large ones each for itself."""
            block = [np.concatenate(p) for p in zip(*blocks)]
            member, stray = (c.astype(bool) for c in block[3:5])
            node, label, size, lengths, words = block[5:]
            folds = _Folds(words, lengths)
            narrow = folds.narrow()
            counts = np.diff(np.append(begins, len(node)))
            number = np.repeat(np.arange(len(begins)), counts)

            def candidates():
                rows = np.flatnonzero(counts[number] <= SMALL)
                for step in range(1, SMALL):
                    i, j = rows[:-step], rows[step:]
                    meet = (number[i] == number[j]) & (label[i] != label[j]) & ((stray[i] & member[j]) | (stray[j] & member[i]))
                    i, j = i[meet], j[meet]
                    bits = _differing((narrow[i, k], narrow[j, k]) for k in range(len(SKETCH)))
                    close = scheme.bound(bits, size[i], size[j], size[i] + size[j])
                    yield i[close], j[close]
                for start, count in zip(begins[counts > SMALL], counts[counts > SMALL]):
                    own = slice(start, start + count)
                    a, b = start + np.flatnonzero(stray[own]), start + np.flatnonzero(member[own])
                    for at in range(0, len(a), 64):
                        one = a[at : at + 64, None]
                        bits = _differing((narrow[one, k], narrow[b, k]) for k in range(len(SKETCH)))
                        i, j = np.nonzero((label[one] != label[b]) & scheme.bound(bits, size[one], size[b], size[one] + size[b]))
                        yield a[at + i], b[j]

            for i, j in candidates():
                good = scheme.bound(folds.differing(i, j), size[i], size[j], size[i] + size[j])
                if good.any():
                    u, v = node[i[good]], node[j[good]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

        def run(batches):
            held: list[list[np.ndarray]] = []
            begins, count = [], 0
            now = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = [batch[c].to_numpy(zero_copy_only=False) for c in names[:-1]]
                sketch = batch["sketch"]
                words, ends = sketch.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sketch.value_lengths().to_numpy(), dtype=np.int64)))
                new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
                for a, b in zip([0, *new], [*new, batch.num_rows]):
                    key = tuple(c[a] for c in columns[:3])
                    if key != now:
                        if count >= BLOCK:
                            yield from compare(held, np.array(begins))
                            held, begins, count = [], [], 0
                        begins.append(count)
                    now = key
                    held.append([*(c[a:b] for c in columns), np.diff(ends[a : b + 1]), words[ends[a] : ends[b]]])
                    count += int(b - a)
            if held:
                yield from compare(held, np.array(begins))

        return blocks.mapInArrow(run, "u long, v long").distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (u, v) whose nodes have different labels; a node without one is its own."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
    told = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return told.filter(F.coalesce("u_label", "u") != F.coalesce("v_label", "v")).select("u", "v")


def _passes(scheme: Scheme, a: str, b: str):
    sizes = F.col(f"{a}size") + F.col(f"{b}size")
    bits = sum((F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in SKETCH), F.lit(0))
    less, more = F.least(f"{a}size", f"{b}size"), F.greatest(f"{a}size", f"{b}size")
    return (F.lit(scheme.whole) * less >= F.lit(scheme.share) * more) & (bits * (scheme.whole + scheme.share) <= sizes * (scheme.whole - scheme.share))


def linked(docs: DataFrame, scheme: Scheme = Scheme(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, size (of its set), component_id (smallest id that links reach)."""
    run = _Join(docs, scheme, id_col, text_col)
    labels = run.labels()
    placed = run.nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = placed.groupBy("label").agg(F.min("first_id").alias("keep_id"), F.sum("copies").alias("all"))
    several = placed.join(smallest.filter("all > 1"), "label").select(F.unhex(F.lpad(F.hex("node"), 16, "0")).alias("digest"), "keep_id", F.col("copies").alias("group_size"))
    # rows of empty sets meet nothing
    alone = F.unhex(F.md5(F.concat(F.lit("empty "), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    rows = run.sets.select("id", "size", F.when(F.col("node").isNull(), alone).otherwise(F.unhex(F.lpad(F.hex("node"), 16, "0"))).alias("digest"))
    found = joined(rows, write_and_reload(several, "components"), run.sets.count())
    return found.select("id", "size", F.col("keep_id").alias("component_id"))


def representatives(docs: DataFrame, scheme: Scheme = Scheme(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns: of each component one row, all rows of empty sets.

    It is the row with the smallest id; null ids come last, equal ids go by the hash of the text. Rows are told apart
    by id and text, so ids may be null or repeat.
    """
    run = _Join(docs, scheme, id_col, text_col, hashed=True)
    key = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("sha"))
    digest = F.unhex(F.lpad(F.hex("node"), 16, "0"))
    rows = run.sets.filter("node is not null").select("node", key.alias("id"))
    firsts = rows.groupBy("node", "id").agg(F.count("*").alias("same")).groupBy("node").agg(
        F.min(F.struct("id", "same")).alias("first"), F.sum("same").alias("copies")
    )
    placed = write_and_reload(firsts.join(run.labels(), "node", "left").withColumn("label", F.coalesce("label", "node")), "firsts")
    smallest = placed.groupBy("label").agg(F.min("first").alias("first"), F.sum("copies").alias("all"))
    several = placed.select("node", "label", "copies").join(smallest.filter("all > 1"), "label")
    several = write_and_reload(several.select(digest.alias("digest"), F.col("first.id").alias("keep_id"), F.col("copies").alias("group_size")), "components")
    found = joined(rows.select("id", digest.alias("digest")), several, run.sets.count())
    gone_id, gone_sha, near_sha = free(docs, "gone_id", "gone_sha", "near_sha")
    gone = found.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id.id").alias(gone_id), F.col("id.sha").alias(gone_sha)).distinct()
    gone = write_and_reload(gone, "gone")  # its size is known then, so Spark shuffles the texts only where it is large
    keyed = docs.withColumn(near_sha, _sha(text_col))
    same_row = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(near_sha) == F.col(gone_sha))
    left = keyed.join(gone, same_row, "left_anti")
    # rows that stay and repeat both id and text stay once
    repeats = smallest.filter("first.same > 1").select(F.col("first.id.id").alias(gone_id), F.col("first.id.sha").alias(gone_sha))
    if not repeats.isEmpty():
        once = left.join(repeats, same_row, "left_semi").dropDuplicates([id_col, near_sha])
        left = left.join(repeats, same_row, "left_anti").unionByName(once)
    return left.select(*docs.columns)
