"""BPE encoding by tree concatenation: halves are encoded apart and their joins re-encoded until both sides agree.

Two encodings of neighbouring stretches can be put together without encoding the whole again: only tokens
near the join may change. A window around the join is encoded anew and grown until its first token is one
of the left encoding and its last token one of the right. Every neighbouring pair of tokens then stands in
some right encoding, which makes the whole right.

It happens on two levels. A long text is cut into leaves that Spark deals out to all tasks; a leaf's
end may cut a match of the pattern, so matches around a join are searched again, from the last match
that the cut can't have changed to the first boundary that the right side has too. And a long match, which the
pattern doesn't split, is encoded by halves down to short stretches.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from celltide.llm.text import fresh, whole

#: Characters of a leaf; longer texts are cut and encoded by several tasks.
LEAF = 16_384
#: Bytes up to which a match is merged directly.
STRETCH = 48
#: Bytes of remembered matches, after which a task forgets them (the result is the same).
MEMORY_BYTES = 200_000_000
#: A match may depend on this many characters from its start, and on one behind its end.
LOOKAHEAD = 3


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself where printable, else from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, bytes and merges of a byte-level vocabulary file, and its special strings."""

    def __init__(self, path: str):
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        letters, ids = byte_letters(), held["model"]["vocab"]
        self.token = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.byte = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        merges = (m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"])
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
        self.rank = {(a, b): rank for rank, (a, b, _) in enumerate(merges)}
        self.joined = [both for _, _, both in merges]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        #: Memory of the worker that holds this object, kept from task to task: match to ids as text, to decoded bytes.
        self.shown: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}
        self.held = 0


def _numbers(values: Iterable[int]) -> np.ndarray:
    return np.fromiter(values, dtype=np.uint32)


@dataclass
class Part:
    """Encoding of a stretch of text: all ids, and how many each match of the pattern has."""

    ids: np.ndarray
    sizes: np.ndarray


class Encoder:
    """Encodes and decodes with one vocabulary, which remembers the matches seen."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v, self.pattern = vocabulary, regex.compile(pattern)
        marks = sorted(vocabulary.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None

    # --- one match ---------------------------------------------------------------------------

    def merged(self, raw: bytes) -> list[int]:
        """Ids of a stretch, merged pair by pair, least rank and leftmost first."""
        byte, rank, joined, none = self.v.byte, self.v.rank.get, self.v.joined, len(self.v.joined)
        ids = [byte[b] for b in raw]
        if len(ids) <= STRETCH:
            ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
            while ranks and (least := min(ranks)) < none:
                i = ranks.index(least)
                ids[i:i + 2] = [joined[least]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
                if i < len(ranks):
                    ranks[i] = rank((ids[i], ids[i + 1]), none)
            return ids
        after, before = list(range(1, len(ids))) + [-1], list(range(-1, len(ids) - 1))
        heap = [(r, i) for i, pair in enumerate(zip(ids, ids[1:])) if (r := rank(pair, none)) < none]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or rank((ids[i], ids[j])) != r:
                continue  # a neighbour has changed since
            ids[i], ids[j] = joined[r], -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (r := rank((ids[i], ids[k]), none)) < none:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((ids[h], ids[i]), none)) < none:
                heapq.heappush(heap, (r, h))
        return [i for i in ids if i >= 0]

    def concat(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of both stretches together; only a window around the join is encoded anew."""
        if not left or not right:
            return left + right
        token, reach = self.v.token, 1
        while True:
            a, b = min(reach, len(left)), min(reach, len(right))
            window = self.merged(b"".join([token[i] for i in left[len(left) - a:] + right[:b]]))
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:len(left) - a] + window + right[b:]
            reach *= 2

    def stretch(self, raw: bytes) -> list[int]:
        """Ids of one match: directly if short, else by halves."""
        if len(raw) <= STRETCH:
            return self.merged(raw)
        middle = len(raw) // 2
        return self.concat(self.stretch(raw[:middle]), self.stretch(raw[middle:]))

    def learn(self, pieces: list[str]) -> None:
        """Encode the matches that are new; plain strings are kept, which cost Python's collector nothing."""
        v = self.v
        if v.held > MEMORY_BYTES:
            v.shown, v.raw, v.held = {}, {}, 0
        shown = v.shown
        for piece in [p for p in set(pieces) if p not in shown]:
            ids = self.stretch(piece.encode())
            shown[piece] = ",".join(map(str, ids))
            v.raw[piece] = self.decode(ids)
            v.held += 250 + 10 * len(ids)

    def match(self, piece: str) -> list[int]:
        """Ids of a match."""
        self.learn([piece])
        return list(map(int, self.v.shown[piece].split(",")))

    def decode(self, ids: list[int]) -> bytes:
        token = self.v.token
        return b"".join([token[i] for i in ids])

    # --- texts ---------------------------------------------------------------------------------

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The stretches between special strings, each with the id of the one that follows."""
        out, at = [], 0
        for m in self.marks.finditer(text) if self.marks else ():
            out.append((text[at:m.start()], self.v.special[m.group()]))
            at = m.end()
        return [*out, (text[at:], None)]

    def encode(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids of a whole text, the ids as text, and their bytes decoded."""
        shown, raw = [], []
        for segment, mark in self.segments(text):
            pieces = self.pattern.findall(segment)
            self.learn(pieces)
            shown += map(self.v.shown.__getitem__, pieces)
            raw += map(self.v.raw.__getitem__, pieces)
            if mark is not None:
                shown.append(str(mark))
                raw.append(self.v.token[mark])
        joined = ",".join(shown)
        return joined.count(",") + 1 if joined else 0, joined, b"".join(raw)

    def leaf(self, text: str) -> Part:
        """Ids of each match of a leaf."""
        pieces = self.pattern.findall(text)
        self.learn(pieces)
        shown = list(map(self.v.shown.__getitem__, pieces))
        ids = np.array(",".join(shown).split(",") if shown else [], dtype=np.uint32)
        return Part(ids, np.array([s.count(",") + 1 for s in shown], dtype=np.uint32))

    def concat_leaves(self, left: Part, right: Part) -> Part:
        """Matches of two neighbouring leaves together."""
        if not len(left.sizes) or not len(right.sizes):
            return left if len(left.sizes) else right
        tail: list[str] = []  # matches of the left leaf that its end may have changed
        at, behind = len(left.ids), 0
        while len(tail) < len(left.sizes):
            begin = at - int(left.sizes[-1 - len(tail)])
            ids = left.ids[begin:at].tolist()
            piece = self.decode(ids).decode()
            if behind >= 1 and behind + len(piece) >= LOOKAHEAD:
                break
            last = last if tail else ids
            tail.append(piece)
            at, behind = begin, behind + len(piece)
        kept, tail_text, reach = len(left.sizes) - len(tail), "".join(reversed(tail)), 4
        while True:
            ends, starts = {len(tail_text): 0}, [0, *np.cumsum(right.sizes[:reach], dtype=np.int64).tolist()]
            heads = [right.ids[x:y].tolist() for x, y in zip(starts, starts[1:])]
            head = [self.decode(ids).decode() for ids in heads]
            window, place = tail_text + "".join(head), len(tail_text)
            for i, piece in enumerate(head):
                place += len(piece)
                ends[place] = i + 1
            everything, middle = reach >= len(right.sizes), []
            for m in self.pattern.finditer(window):
                if not everything and (m.end() + 1 > len(window) or m.start() + LOOKAHEAD > len(window)):
                    break
                middle.append(m)
                if m.end() in ends and m.end() >= len(tail_text):
                    parts, agreed = [], ends[m.end()]
                    for m in middle:
                        as_one = m.start() == len(tail_text) - len(tail[0]) and m.end() == len(tail_text) + len(head[0])
                        parts.append(self.concat(last, heads[0]) if as_one else self.match(m.group()))
                    return Part(
                        np.concatenate([left.ids[:at], *map(_numbers, parts), right.ids[starts[agreed]:]]),
                        np.concatenate([left.sizes[:kept], _numbers(map(len, parts)), right.sizes[agreed:]]))
            reach *= 2

    def tree(self, leaves: list[Part]) -> Part:
        """Neighbouring leaves put together level by level."""
        while len(leaves) > 1:
            pairs = zip(leaves[::2], leaves[1::2])
            leaves = [self.concat_leaves(a, b) for a, b in pairs] + ([leaves[-1]] if len(leaves) % 2 else [])
        return leaves[0]


def _digests(n: int, shown: str, raw: bytes) -> tuple[int, str, str]:
    decoded = raw.decode("utf-8", "replace").encode()
    return n, hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, vocabulary_path: str, pattern: str, column: str = "text", ids: bool = True, leaf: int = LEAF) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, on demand, ``ids`` (decimal, comma-joined).

    The digests are those of ``ids`` and of the decoded text in UTF-8. Texts of at most ``leaf`` characters are
    encoded where they are read. Longer ones become leaves in all tasks, equal texts once; a text's
    encoded leaves meet in one group, which is as large as its text, and are put together there.
    Null texts are encoded as empty ones (no ids). Repeated rows stay. New names replace columns of the same name.
    """
    spark, names = docs.sparkSession, ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    docs = docs.drop(*names)
    key, coded = fresh("_text", docs.columns), fresh("_coded", docs.columns)
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary_path))
    fields = RESULT + ", ids string" * ids
    text, long = whole(F.col(column)), F.length(whole(F.col(column))) > leaf

    @F.pandas_udf(f"struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker = Encoder(shared.value, pattern)
        for batch in batches:
            rows = []
            for t in batch:
                n, shown, raw = worker.encode(t)
                rows.append((*_digests(n, shown, raw), *[shown] * ids))
            yield pd.DataFrame(rows, columns=names)

    @F.pandas_udf("array<struct<segment:int,leaf:int,mark:int,chunk:string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker = Encoder(shared.value, pattern)
        for batch in batches:
            yield pd.Series([[
                (s, at // leaf, mark, segment[at:at + leaf])
                for s, (segment, mark) in enumerate(worker.segments(t)) for at in range(0, max(len(segment), 1), leaf)
            ] for t in batch])

    @F.pandas_udf("struct<ids:binary,sizes:binary>")
    def encode_leaf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker = Encoder(shared.value, pattern)
        for batch in batches:
            parts = [worker.leaf(t) for t in batch]
            yield pd.DataFrame([(p.ids.tobytes(), p.sizes.tobytes()) for p in parts], columns=["ids", "sizes"])

    def put_together(of: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        worker, out = Encoder(shared.value, pattern), []
        for _, part in rows.sort_values(["segment", "leaf"]).groupby("segment", sort=True):
            leaves = [Part(np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)) for a, b in zip(part["ids"], part["sizes"])]
            out += worker.tree(leaves).ids.tolist()
            if not pd.isna(mark := part["mark"].iloc[0]):
                out.append(int(mark))
        shown = ",".join(map(str, out))
        return pd.DataFrame([(of[0], *_digests(len(out), shown, worker.decode(out)), *[shown] * ids)], columns=[key, *names])

    short = docs.filter(~long).withColumn(coded, encode(text)).select(*docs.columns, *[F.col(f"{coded}.{n}").alias(n) for n in names])
    longer = docs.filter(long).withColumn(key, F.sha2(text, 256))
    leaves = (
        longer.select(key, F.explode(cut(text)).alias("leaf")).select(key, "leaf.*")
        .groupBy(key, "segment", "leaf").agg(F.first("mark").alias("mark"), F.first("chunk").alias("chunk"))
        .withColumn("coded", encode_leaf("chunk")).select(key, "segment", "leaf", "mark", "coded.*")
    )
    whole_texts = leaves.groupBy(key).applyInPandas(put_together, f"{key} string, {fields}")
    return short.unionByName(longer.join(whole_texts, key).select(*docs.columns, *names))


def decode_ids(encoded: DataFrame, vocabulary_path: str, column: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its comma-joined ids; null ids give null, bytes that are no UTF-8 the replacement mark."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path).token)

    def text_of(ids: str) -> str:
        return b"".join([shared.value[int(i)] for i in ids.split(",") if i]).decode("utf-8", "replace")

    @F.pandas_udf("string")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if row is None else text_of(row) for row in batch], dtype=object)

    return encoded.withColumn(to, back(F.col(column)))
