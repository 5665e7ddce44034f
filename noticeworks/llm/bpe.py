"""Operator 5: byte-level BPE encoding by backtracking, decoding by an offset table.

The encoder never replays merges.  An Aho-Corasick automaton over the vocabulary lists the tokens that start at
each byte of a word; the longest is tried first and kept only if the pair (previous token, token) is compatible,
that is, if merging the two tokens' bytes leaves exactly these two tokens.  A dead end marks its byte as
unreachable and steps back, so every byte fails at most once and the time is linear in the word.

Words (the pre-tokenizer's pieces) repeat, so each Python worker keeps a bounded table of finished words.  Texts
stream through ``mapInArrow``: no shuffle, and a lost task only reads its split again.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm.common import table

#: Words that a worker remembers before it starts afresh (about 150 bytes each).
CACHED_WORDS = 1_000_000

#: Bytes of a long word whose matches are listed at once (about 130 bytes each).
CHUNK = 1 << 16

#: Latin letters without a gap, for the fast pre-tokenizer.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts made of these characters only: here re and the tokenizer's own classes agree.
PLAIN = re.compile(rf"[\x00-\x1b\x20-\x7f{LATIN}]*")
PLAIN_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+")
ANY_WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in keep}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Encoder(dict):
    """A vocabulary; as a mapping, word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import regex

        super().__init__()
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.letters = byte_letters()
        self.as_letters = {b: letter for b, letter in enumerate(self.letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splits_special = re.compile("|".join(f"({re.escape(t)})" for t in self.special)) if self.special else None
        self.any_words = regex.compile(ANY_WORDS)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.longest = max(len(t) for t in vocab)
        # offset table: all tokens' bytes in one buffer
        of_letter = {letter: b for b, letter in self.as_letters.items()}
        by_id = {i: bytes(of_letter[c] for c in t) for t, i in vocab.items() if t not in self.special}
        by_id |= {i: t.encode() for t, i in self.special.items()}
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.offsets = np.cumsum([0, *map(len, parts)])
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)

    @functools.cached_property
    def automaton(self):
        """Finds the tokens that end at each place; made, with the tables of merges, when a word first asks for it."""
        import ahocorasick

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: How late a merge makes the token; 0 for single bytes.
        self.rank = {vocab[a + b]: n for n, (a, b) in reversed(list(enumerate(merges, 1)))}
        self.halves = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in reversed(merges)}
        self.joined = {(vocab[a], vocab[b]): vocab[a + b] for a, b in reversed(merges)}
        automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if len(token) == 1 or i in self.rank:
                automaton.add_word(token, (i, len(token)))
        automaton.make_automaton()
        return automaton

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE, given the bytes of both tokens, ends in exactly (left, right).

        Both tokens are unmade, latest merge first, down to their edge; a merge across the edge that comes before
        the merge just unmade would have happened first, and then the pair can't stand.
        """
        rank, a, b, before = self.rank, left, right, 1 << 62
        while True:
            across = self.joined.get((a, b))
            # of equal rank, the merge further left comes first: a's own, then the one across
            if across is not None and rank[across] < before:
                ok = False
                break
            ra, rb = rank.get(a, 0), rank.get(b, 0)
            if not ra and not rb:
                ok = True
                break
            if ra > rb:
                before, a = ra, self.halves[a][1]
            else:
                before, b = rb + 1, self.halves[b][0]
        if len(self.compatible) > 4 * CACHED_WORDS:
            self.compatible.clear()
        self.compatible[left, right] = ok
        return ok

    def matches(self, text: str, chunk: int) -> list[list[tuple[int, int]]]:
        """The (token, length) pairs that start at each place of one chunk of text, shorter ones first."""
        low, high = chunk * CHUNK, min(len(text), (chunk + 1) * CHUNK)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(high - low)]
        # a match that starts in the chunk ends less than the longest token behind it
        for end, found in self.automaton.iter(text, low, min(len(text), high + self.longest)):
            at = end - found[1] + 1 - low
            if at < len(starts):
                starts[at].append(found)
        return starts

    def encode_long_word(self, word: str) -> list[int]:
        """encode_word for a piece of any length: the automaton runs chunk by chunk, and only few chunks are held."""
        text = "".join(map(self.letters.__getitem__, word.encode("utf-8", "replace")))
        chunk_of = functools.lru_cache(maxsize=4)(lambda chunk: self.matches(text, chunk))
        compatible, failed = self.compatible, set()
        ids, sizes, at, below = array.array("I"), array.array("H"), 0, 1 << 30
        while at < len(text):
            for i, n in reversed(chunk_of(at // CHUNK)[at % CHUNK]):
                if n < below and at + n not in failed:
                    if not ids:
                        break
                    ok = compatible.get((ids[-1], i))
                    if self.fits(ids[-1], i) if ok is None else ok:
                        break
            else:  # back to the token before, and from there to a shorter one
                failed.add(at)
                ids.pop()
                below = sizes.pop()
                at -= below
                continue
            ids.append(i)
            sizes.append(n)
            at, below = at + n, 1 << 30
        return ids.tolist()

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-tokenizer piece."""
        if len(word) > CHUNK:
            return self.encode_long_word(word)
        text = "".join(map(self.letters.__getitem__, word.encode("utf-8", "replace")))
        size, at, out = len(text), 0, []
        starts: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, found in self.automaton.iter(text):
            starts[end - found[1] + 1].append(found)  # shorter ones come first
        compatible, failed = self.compatible, set()
        while at < size:
            options = starts[at]
            while options:
                token = options.pop()
                i, n = token
                if at + n not in failed:
                    if not out:
                        break
                    ok = compatible.get((out[-1][0], i))
                    if self.fits(out[-1][0], i) if ok is None else ok:
                        break
            else:
                failed.add(at)
                at -= out.pop()[1]
                continue
            out.append(token)
            at += n
        return [i for i, _ in out]

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode_word(word), "<u4").tobytes()
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def plain_bytes(self, text: str) -> bytes:
        words = PLAIN_WORDS.findall(text) if PLAIN.fullmatch(text) else self.any_words.findall(text)
        return b"".join(map(self.__getitem__, words))

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text, little-endian unsigned 32-bit."""
        if not self.special or not any(t in text for t in self.special):
            return self.plain_bytes(text)
        out, at = [], 0
        for m in self.splits_special.finditer(text):
            out += [self.plain_bytes(text[at : m.start()]), np.array([self.special[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain_bytes(text[at:])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a row of ids, gathered from the offset table."""
        first = self.offsets[ids]
        size = self.offsets[ids + 1] - first
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.buffer[np.repeat(first - ends + size, size) + np.arange(ends[-1])].tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Ids decoded at once, to bound memory for very long texts.
DECODED = 1 << 18


def digests(enc: Encoder, text: str) -> tuple[int, str, str]:
    raw = enc.encode_bytes(text)
    ids = np.frombuffer(raw, "<u4").astype(np.int64)
    back = b"".join(enc.decode(ids[i : i + DECODED]) for i in range(0, len(ids), DECODED))
    back = back.decode("utf-8", "replace").encode()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, decodes it again and returns counts and digests of both.

    A null text counts as empty (0 tokens, digests of no bytes); a null id stays null; repeated rows are answered
    once each; the vocabulary's own special strings become their ids, as the tokenizers library has it.  An empty
    table gives no rows; a text of one word of any length costs time and memory in proportion.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            rows = [digests(enc, t or "") for t in batch.column(1).to_pylist()]
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids themselves, for pipelines that need them; null texts give an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = [np.frombuffer(enc.encode_bytes(t or ""), "<u4").astype(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"]
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids array<long>")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op5_bpe": op5_bpe}
ORACLE_SQL: dict[str, str] = {}
