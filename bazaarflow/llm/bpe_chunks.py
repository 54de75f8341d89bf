"""BPE encoding and decoding with content-defined chunk reuse.

Each text is cut where a rolling hash of the last eight bytes says so, on average every `CHUNK` bytes, so
passages that documents share give the same chunks wherever they stand. A chunk's inside, from its
first to its last white space, is encoded once and kept in a dictionary (per Python worker, bounded in
bytes); inside a chunk, words that are new to the worker are encoded in one library call. What
remains at a join, the end of one chunk and the beginning of the next, is repaired: it is encoded anew
together with the word before and the word after, and counts only if these two come out exactly as
in their chunks. Otherwise the whole document is encoded anew, which is exact by definition.

White space separates pre-tokens of these tokenizers, so agreement on both neighbours makes the
repaired join equal to the library's result for the whole text.

Decoding looks ids up in the vocabulary and joins them as the library does without a decoder.

The dictionaries live in the workers: sharing them over the cluster would take a shuffle of all chunk
texts and another of all their ids, more disk than the texts themselves.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to an empty text.
Text without any white space is one join and is encoded as a whole. Repeated rows get equal results.
An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from bazaarflow.llm import worker_memory

CHUNK = 1024
WORDS_KEPT = 300_000
CHUNK_BYTES_KEPT = 48 << 20
_SPACE = re.compile("[ \t\r\n]+")
_WORD_BYTES = 64  # longer words are not kept
_MARKS = ".,;:!?"
_WINDOW = 8


def cuts(raw: bytes, average: int = CHUNK) -> list[int]:
    """Ends of the content-defined chunks of a text's UTF-8 bytes; the last one is its length."""
    if len(raw) <= _WINDOW:
        return [len(raw)] if raw else []
    data = np.frombuffer(raw, dtype=np.uint8)
    windows = np.ndarray((len(raw) - _WINDOW + 1,), dtype="<u8", buffer=raw, strides=(1,))
    rolled = (windows * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    found = []
    for end in (np.flatnonzero(rolled % np.uint64(average) == 0) + _WINDOW).tolist():
        while end < len(raw) and data[end] & 0xC0 == 0x80:
            end += 1
        if end < len(raw) and (not found or end > found[-1]):
            found.append(end)
    return [*found, len(raw)]


#: Latin letters and digits that stay one under the tokenizer's normalisation
_SETTLED = frozenset(c for c in map(chr, range(0x250)) if c.isalnum() and len(c.lower()) == 1)


class _Chunk:
    __slots__ = ("head", "tail", "first", "last", "ids")

    def __init__(self, head: str, tail: str | None, first: str, last: str, ids: bytes) -> None:
        #: text before the first and after the last white space; tail is None without white space
        self.head, self.tail = head, tail
        self.first, self.last, self.ids = first, last, ids


class Encoder:
    """Encodes texts with dictionaries of words and chunks that it keeps between calls."""

    def __init__(self, path: str, average: int = CHUNK) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.average = average
        #: words used of late and, each time that these are too many, the ones before them
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chunks: dict[bytes, _Chunk] = {}
        self.chunk_bytes = 0
        self.reused = self.encoded = self.disagreed = 0
        self.ignores_case = self.library.normalizer is not None and self.library.normalizer.normalize_str("AbC") == "abc"
        #: lower-cased; they are found in the text as it is, so words that might hold one are not changed or cut
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.vocabulary = pa.array(self.tokens, pa.large_string())

    def _encoded(self, texts: list[str]) -> list[bytes]:
        done = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.int32).tobytes() for e in done]

    def _learn(self, pieces: list[bytes]) -> dict[bytes, _Chunk]:
        """Chunks of the pieces, each different one encoded at most once."""
        known = {p: self.chunks[p] for p in pieces if p in self.chunks}
        split = {p: _SPACE.split(p.decode()) for p in dict.fromkeys(pieces) if p not in known}
        self.reused += len(pieces) - len(split)
        self.encoded += len(split)
        if len(self.words) > WORDS_KEPT:
            self.words, self.older = {}, self.words
        if self.chunk_bytes > CHUNK_BYTES_KEPT:
            self.chunks.clear()
            self.chunk_bytes = 0
        look = self._words({w for words in split.values() for w in words[1:-1]})
        for piece, words in split.items():
            inside = words[1:-1]
            joined = b"".join([look[w] for w in inside])
            tail = words[-1] if len(words) > 1 else None
            chunk = _Chunk(words[0], tail, inside[0] if inside else "", inside[-1] if inside else "", joined)
            known[piece] = chunk
            if len(piece) <= 16 * self.average:
                self.chunks[piece] = chunk
                self.chunk_bytes += len(piece) + len(joined) + 400
        return known

    def _words(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids of the words; only what no known word settles goes to the library.

        The tokenizer ignores case, and a word's marks at the end are pre-tokens of their own after a
        letter or digit. So `Word.` has the ids of `word` and of `.`, exactly. Words that hold an added
        token in any case are left as they are.
        """
        young, old = self.words, self.older
        look = {w: young[w] for w in wanted & young.keys()}
        rest = wanted - look.keys()
        if old:
            back = {w: old[w] for w in rest & old.keys()}
            young.update(back)
            look.update(back)
            rest -= back.keys()
        # words hold no line break, so an added token in none of them joined is in no word
        joined = "\n".join(rest).lower()
        added = [t for t in self.added if t in joined]
        plain: list[tuple[str, str, str]] = []
        parts: set[str] = set()
        for word in rest:
            core = word.rstrip(_MARKS)
            special = False
            if added:
                lower = word.lower()
                special = any(t in lower for t in added)
            if special or not core or core[-1] not in _SETTLED:
                core = word
            marks = word[len(core) :]
            if self.ignores_case and not special and core.isascii():
                core = core.lower()
            plain.append((word, core, marks))
            parts.add(core)
            if marks:
                parts.add(marks)
        known = {part: young[part] for part in parts & young.keys()}
        if old:
            known.update((part, old[part]) for part in (parts - known.keys()) & old.keys())
        fresh = list(parts - known.keys())
        ids = dict(zip(fresh, self._encoded(fresh)))
        known.update(ids)
        found = {word: known[core] + known[marks] if marks else known[core] for word, core, marks in plain}
        look.update(found)
        ids.update(found)
        young.update(ids if max(map(len, ids), default=0) <= _WORD_BYTES else {w: i for w, i in ids.items() if len(w) <= _WORD_BYTES})
        return look

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        found = self.words.get(word)
        return found if found is not None else self._encoded([word])[0]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        raw = [(t or "").encode() for t in texts]
        pieces = []
        for r in raw:
            ends = cuts(r, self.average)
            pieces.append([r[a:b] for a, b in zip([0, *ends], ends)])
        known = self._learn([p for doc in pieces for p in doc])

        plans: list[list] = []  # for each text its parts: ids of insides and (before, join, after)
        joins: dict[tuple[str, str, str], bytes | None] = {}
        for doc in pieces:
            parts: list = []
            open_text, before = "", ""
            for piece in doc:
                chunk = known[piece]
                open_text += chunk.head
                if chunk.tail is None:
                    continue
                if open_text:
                    parts.append((before, open_text, chunk.first))
                    before = open_text if not chunk.ids else before
                if chunk.ids:
                    parts.append(chunk.ids)
                    before = chunk.last
                open_text = chunk.tail
            if open_text:
                parts.append((before, open_text, ""))
            plans.append(parts)
            joins.update((p, None) for p in parts if type(p) is tuple)
        self._repair(joins)

        result = []
        for text, parts in zip(texts, plans):
            found = [joins[p] if type(p) is tuple else p for p in parts]
            if None in found:
                self.disagreed += 1
                found = self._encoded([text])
            result.append(np.frombuffer(b"".join(found), dtype=np.int32))
        return result

    def _repair(self, joins: dict[tuple[str, str, str], bytes | None]) -> None:
        """Encode each join between its neighbours; None stays where these don't agree with their chunks."""
        keys = list(joins)
        for key, ids in zip(keys, self._encoded([" ".join(k) for k in keys])):
            left, right = self._word(key[0]), self._word(key[2])
            if ids.startswith(left) and ids.endswith(right) and len(ids) >= len(left) + len(right):
                joins[key] = ids[len(left) : len(ids) - len(right)]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))

    def decode_all(self, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Decoded texts of many lists of ids, end to end in flat; ends begin with 0."""
        tokens = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), self.vocabulary.take(pa.array(flat)))
        return pc.binary_join(tokens, pa.scalar(" ", pa.large_string())).cast(pa.string())


def _encoder(path: str) -> Encoder:
    """The worker's encoder, kept between tasks of this operator."""
    encoders = worker_memory.kept("bpe")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, ids array<int>, decoded) and the columns to carry for every row of docs. path: the tokenizer's file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for part in (batch.slice(i, 400) for i in range(0, batch.num_rows, 400)):
                ids = encoder.encode(part["text"].to_pylist())
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
                decoded = encoder.decode_all(flat, ends)
                yield pa.RecordBatch.from_arrays([part["id"], lists, decoded, *[part[c] for c in carry]], ["id", "ids", "decoded", *carry])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *carry)
    more = "".join(f", `{c}` {narrow.schema[c].dataType.simpleString()}" for c in carry)
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, ids array<int>, decoded string{more}")
