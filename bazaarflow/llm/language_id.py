"""Language identification: family first, then one-versus-one linear SVMs inside the family.

A text becomes hashed counts of its letters' byte 1- to 4-grams (words framed by spaces), scaled by
square root and to unit length. Linear support vector machines separate every pair of families and
every pair of languages of one family. A prediction sums the squashed margins of the pairwise
machines, takes the best family, then the best language in it. Only the text is read for that.

Fitting uses a sample with a documented bound: at most `SAMPLE` labelled texts of a language, taken
by hash order of their id. Prediction reads every whole text.

Defined cases: a null text, or one without any letter, is `und` with score 0. Null labels are never
learned from. One learned language is predicted with score 1; none at all gives `und`. Repeated rows
get equal predictions. Further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from bazaarflow.llm import worker_memory
from bazaarflow.session import write_and_reload

SAMPLE = 1_500
BUCKETS = 4096
UNKNOWN = "und"

# ISO 639-1 codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc rm",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tt",
    "indo-aryan": "hi ur bn pa mr gu ne",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = re.compile(r"[^\W\d_]")
# other ASCII than letters separates words; A-Z are lower-cased before
_SPACED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].lower(), lang)


def features(text: str) -> np.ndarray:
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_SPACED), dtype=np.uint8)
    # runs of separators count once
    space = raw == 32
    raw = raw[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint32)
    counts = np.zeros(BUCKETS, dtype=np.float32)
    key = np.zeros(len(raw), dtype=np.uint32)
    for n in range(4):
        if len(raw) <= n:
            break
        size = len(raw) - n
        key = (key[:size] if n else key) ^ ((raw[n:] + np.uint32(1 + n * 257)) * _MULTIPLIERS[n])
        spread = (key * np.uint32(0x9E3779B1)) >> np.uint32(20)
        counts += np.bincount(spread, minlength=BUCKETS)
    np.sqrt(counts, out=counts)
    norm = float(np.linalg.norm(counts))
    return counts / norm if norm else counts


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass
class Model:
    """Pairwise machines over families and, by family, over languages: (first, second) -> weights, intercept."""

    languages: list[str]
    families: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)
    members: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = sorted({family_of(x) for x in self.languages})
        family, sure = _vote(matrix, names, self.families)
        lang = np.empty(len(matrix), dtype=object)
        score = np.empty(len(matrix))
        for i, name in enumerate(names):
            rows = np.flatnonzero(family == i)
            codes = sorted(x for x in self.languages if family_of(x) == name)
            best, inner = _vote(matrix[rows], codes, self.members)
            lang[rows] = np.array(codes, dtype=object)[best]
            score[rows] = sure[rows] * inner
        return lang, score


def _vote(matrix: np.ndarray, names: list[str], machines: dict) -> tuple[np.ndarray, np.ndarray]:
    """Index of the name with most support for each row, and that support as a mean over its pairs."""
    votes = np.zeros((len(matrix), len(names)))
    for i, j in itertools.combinations(range(len(names)), 2):
        weights, intercept = machines[names[i], names[j]]
        first = 1.0 / (1.0 + np.exp(-4.0 * np.clip(matrix @ weights + intercept, -9, 9)))
        votes[:, i] += first
        votes[:, j] += 1.0 - first
    if len(names) == 1:
        votes += 1.0
    best = votes.argmax(axis=1) if len(matrix) else np.zeros(0, dtype=int)
    return best, votes[np.arange(len(matrix)), best] / max(1, len(names) - 1)


def held_out(id_col: str = "doc_id"):
    """True where the id's CRC-32 says that a document is kept for testing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text): about `sample` rows of each language at most, by hash of the id."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        (F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) / F.lit(1e6)).alias("u"),
    )
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return labelled.select("lang", "text")
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(sample / n)) for k, n in counts.items()))
    return labelled.filter(F.col("u") < F.element_at(share, F.col("lang"))).select("lang", "text")


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_memory.kept("language")
    for batch in batches:
        for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
            rows = [(lang, features(text).tolist()) for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist()) if has_letter(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["lang", "x"])


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    chosen = training_sample(docs, sample, id_col, text_col, lang_col)
    stored = write_and_reload(chosen.mapInArrow(_featured, "lang string, x array<float>"), "language-sample")
    codes = sorted(r["lang"] for r in stored.select("lang").distinct().collect())
    rows = stored.select("lang", array_to_vector(F.col("x").cast("array<double>")).alias("features"))
    model = Model(codes)
    family = F.create_map(*itertools.chain.from_iterable((F.lit(c), F.lit(family_of(c))) for c in codes)) if codes else None
    names = sorted({family_of(c) for c in codes})
    for a, b in itertools.combinations(names, 2):
        model.families[a, b] = _machine(rows.withColumn("name", F.element_at(family, F.col("lang"))), a, b)
    for name in names:
        for a, b in itertools.combinations([c for c in codes if family_of(c) == name], 2):
            model.members[a, b] = _machine(rows.withColumn("name", F.col("lang")), a, b)
    return model


def _machine(rows: DataFrame, first: str, second: str) -> tuple[np.ndarray, float]:
    pair = rows.filter(F.col("name").isin(first, second)).select("features", (F.col("name") == first).cast("double").alias("label"))
    fitted = LinearSVC(maxIter=15, regParam=1e-4, standardization=False).fit(pair)
    return np.asarray(fitted.coefficients.toArray(), dtype=np.float32), float(fitted.intercept)


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.kept("language")
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = part["text"].to_pylist()
                lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
                known = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
                if known:
                    lang[known], score[known] = model.predict(np.stack([features(texts[i]) for i in known]))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in whose text a language can be recognised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.kept("language")
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = part[text_col].to_pylist()
                good = [model.languages != [] and has_letter(t) for t in texts]
                lang = np.full(len(texts), UNKNOWN, dtype=object)
                rows = np.flatnonzero(good)
                if len(rows):
                    lang[rows] = model.predict(np.stack([features(texts[i]) for i in rows]))[0]
                yield part.filter(pa.array(lang != UNKNOWN))

    return docs.mapInArrow(run, docs.schema)
