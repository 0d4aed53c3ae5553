"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Merging text by text looks up the best pair of each word again and again. Here the distinct words of a
whole share of the corpus lie side by side in one array of symbols, an inverted index leads from each
mergeable pair to the positions where it stands, and the merges are replayed in rank order over all
words at once; each one touches its positions and their two neighbours only. Spark deals the documents
out; every task replays the merges for the words that are new to it and then encodes its documents
by lookup.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from celltide.llm.text import whole

#: Characters of text whose new words are replayed together and whose ids leave a task together; bounds its memory beside single long texts.
REPLAY_CHARS = 1_000_000
#: Bytes of remembered words, after which a task forgets them and replays anew (the result is the same).
MEMORY_BYTES = 64_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file of ``base64 rank`` lines."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Merges:
    """Lookup tables of a vocabulary: which two tokens join to which, by their ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.span = ranks, max(ranks.values(), default=0) + 1
        self.joined: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.joined[a * self.span + b] = rank
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.two_bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], dtype=np.int32)


def _ints(values: np.ndarray) -> array:
    out = array("i")
    out.frombytes(values.astype(np.int32).tobytes())
    return out


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """The packed ids of each word, by replaying all merges in rank order over all words together.

    ``token`` holds the symbols of all words one after the other (-1 once merged into its left neighbour),
    ``before`` and ``after`` chain the living ones and break at word ends, and ``index`` maps a rank to the positions
    whose symbol and successor join to the token of that rank. Ranks come off a heap, smallest first, and
    positions in ascending order, which is leftmost first within each word. Where a merge opens a still
    smaller rank inside its word, the rest of that word waits until that one is done.
    """
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    n, ends = len(raw), np.cumsum(length)
    if not n:
        return [b""] * len(words)
    inner = np.ones(n, dtype=bool)
    inner[ends[length > 0] - 1] = False  # positions that have a successor in their word
    place = np.arange(n, dtype=np.int32)
    after = _ints(np.where(inner, place + 1, -1))
    before = _ints(np.where(np.concatenate([[False], inner[:-1]]), place - 1, -1))
    word_of, token = _ints(np.repeat(np.arange(len(words)), length)), _ints(merges.byte[raw])
    rank_at = np.full(n, -1, dtype=np.int32)
    rank_at[:-1] = merges.two_bytes[raw[:-1], raw[1:]]
    at = np.flatnonzero(inner & (rank_at >= 0))
    at = at[np.argsort(rank_at[at], kind="stable")]
    heap, cuts = np.unique(rank_at[at], return_index=True)
    heap, cuts = heap.tolist(), [*cuts.tolist(), len(at)]
    index = {r: at[a:b].tolist() for r, a, b in zip(heap, cuts, cuts[1:])}
    get, span, push = merges.joined.get, merges.span, heapq.heappush
    while heap:
        rank = heapq.heappop(heap)
        positions = index.pop(rank)
        positions.sort()
        waiting = -1  # the word whose other places have to wait
        held: list[int] = []
        for i in positions:
            j = after[i]
            if j < 0 or (a := token[i]) < 0 or get(a * span + token[j]) != rank:
                continue  # a neighbour has changed since this was posted
            if word_of[i] == waiting:
                held.append(i)
                continue
            token[i] = rank
            token[j] = -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                r = get(rank * span + token[k])
                if r is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        push(heap, r)
                    if r < rank:
                        waiting = word_of[i]
            h = before[i]
            if h >= 0:
                r = get(token[h] * span + rank)
                if r is not None:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        push(heap, r)
                    if r < rank:
                        waiting = word_of[i]
        if held:
            index[rank] = held
            push(heap, rank)
    ids = np.frombuffer(token, dtype=np.int32)
    alive = ids >= 0
    packed = ids[alive].astype("<u4").tobytes()
    cuts = (4 * np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])]).tolist()
    return [packed[a:b] for a, b in zip(cuts, cuts[1:])]


class Replayer:
    """Encodes texts by the words it has replayed so far and replays the new ones together."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges, self.split = Merges(ranks), regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.held = 0

    def learn(self, texts: Iterable[str]) -> list[list[str]]:
        """The words of each text, all of them replayed; a word that is a token itself needs no replay."""
        if self.held > MEMORY_BYTES:
            self.known, self.held = {}, 0
        split = [self.split(t) for t in texts]
        rest, ranks = [], self.merges.ranks
        for word in set().union(*split) - self.known.keys():
            rank = ranks.get(word.encode())
            if rank is None:
                rest.append(word)
            else:
                self.known[word] = rank.to_bytes(4, "little")
            self.held += 150 + 8 * len(word)
        self.known.update(zip(rest, replay([w.encode() for w in rest], self.merges)))
        return split

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split, known = self.learn(texts), self.known
        return [b"".join([known[w] for w in words]) for words in split]


def decode(packed: bytes, tokens: dict[int, bytes]) -> bytes:
    """Bytes of a text from its packed ids."""
    return b"".join([tokens[i] for i in memoryview(packed).cast("I")])


def _shares(texts: Iterable[str]) -> Iterator[list[str]]:
    """Runs of texts of about REPLAY_CHARS characters; a longer text is a run of its own."""
    run, held = [], 0
    for text in texts:
        if run and held + len(text) > REPLAY_CHARS:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def _encoded(batches: Iterable[pd.Series], ranks: dict[bytes, int], pattern: str, names: list[str]) -> Iterator[pd.DataFrame]:
    """The columns ``names`` of all texts in order, a frame for each share of a batch."""
    worker, tokens = Replayer(ranks, pattern), {r: t for t, r in ranks.items()}
    for batch in batches:
        if not len(batch):
            yield pd.DataFrame(columns=names)
        for share in _shares(batch):
            packed = worker.encode(share)
            rows = [(len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256(decode(p, tokens)).hexdigest(), p)[:len(names)] for p in packed]
            yield pd.DataFrame(rows, columns=names)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, column: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, on demand, ``ids``.

    ``ids`` is binary: the ids as little-endian unsigned 32-bit integers. The digests are those of these
    bytes and of the bytes that decoding them gives back. Null texts are encoded as empty ones (no ids). New names replace columns of the same name.
    The rank file is read on the driver and broadcast; its size is the vocabulary's, not the corpus's.
    """
    spark, names = docs.sparkSession, ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    docs = docs.drop(*names)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "binary"}
    packed = ", ".join(f"{n}: {fields[n]}" for n in names)

    @F.pandas_udf(f"struct<{packed}>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _encoded(batches, shared.value, pattern, names)

    return docs.withColumn("_bpe", encode(whole(F.col(column)))).select(*docs.columns, *[F.col(f"_bpe.{n}").alias(n) for n in names])


def decode_ids(encoded: DataFrame, ranks_path: str, column: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast({r: t for t, r in read_ranks(ranks_path).items()})

    @F.pandas_udf("binary")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if row is None else decode(row, shared.value) for row in batch], dtype=object)

    return encoded.withColumn(to, back(F.col(column)))
