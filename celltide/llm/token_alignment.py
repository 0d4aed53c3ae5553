"""Alignment of two tokenizers over a corpus, as an Arrow pipeline inside Spark tasks.

Each task turns shares of documents into flat Arrow columns: lists of ids are flattened beside the indices of their
parents, running sums of token lengths, begun anew at each document, give the byte where every token ends, and a hash
join on (document, end) finds the ends that both tokenizers share. They cut a document into groups; a second join, on
the group, links the tokens of both sides, and ``Table.group_by`` adds up the links of each document and the documents
of each pair of ids. Spark merges these partial counts over the corpus and brings each batch the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from celltide.llm.tree_concat import byte_letters
from celltide.runtime import checkpoint

#: Characters of the documents whose tokens lie in memory together; a longer text is a share of its own.
SHARE_CHARS = 1_000_000
#: Characters of a batch: its documents share one list of pairs. A longer text is a batch of its own.
BATCH_CHARS = 8_000_000
#: Links that one join puts out at once.
SLICE_LINKS = 4_000_000
#: Remembered words, after which a worker forgets them (the result is the same).
MEMORY_WORDS = 500_000

#: Words with the white space before them. Neither tokenizer has a token across the end of one: it lies between a
#: character that is no white space and a space.
_WORD = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")


class TokenizerPair:
    """Both tokenizers from the contents of their files, and the bytes of their tokens; workers keep it from task to task."""

    def __init__(self, merges_path: str, pieces_path: str):
        self.files = Path(merges_path).read_text(encoding="utf-8"), Path(pieces_path).read_bytes()
        self.open()
        letters = byte_letters()
        a = {i: bytes(letters[c] for c in t) for t, i in self.merges.get_vocab(with_added_tokens=False).items()}
        pieces = range(self.pieces.get_piece_size())
        b = [
            bytes([int(self.pieces.id_to_piece(i)[3:5], 16)]) if self.pieces.is_byte(i)
            else self.pieces.id_to_piece(i).replace("▁", " ").encode() for i in pieces
        ]
        self.bytes_a = pa.array([a.get(i, b"") for i in range(max(a) + 1)], pa.binary())
        self.bytes_b = pa.array(b, pa.binary())

    def __getstate__(self):
        return self.files, self.bytes_a, self.bytes_b

    def __setstate__(self, state):
        self.files, self.bytes_a, self.bytes_b = state
        self.open()

    def open(self) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.merges, self.pieces = Tokenizer.from_str(self.files[0]), SentencePieceProcessor(model_proto=self.files[1])
        self.merges.encode_special_tokens = True
        self.before = len(self.pieces.encode("x"))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends = [np.zeros(0, dtype=np.int32) for _ in "ab"], [np.zeros(1, dtype=np.int64) for _ in "ab"]

    def learn(self, words: list[str]) -> None:
        """Encode the words that are new by both tokenizers and append their ids to the lists."""
        if len(self.place) > MEMORY_WORDS:
            self.forget()
        new = [w for w in words if w not in self.place]
        if not new:
            return
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        first = [e.ids for e in self.merges.encode_batch_fast(new, add_special_tokens=False)]
        # behind another word, so that the space that begins a text is not added to each
        second = self.pieces.encode(["x" + w for w in new], num_threads=1)
        for i, (lists, skip) in enumerate(((first, 0), (second, self.before))):
            length = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(length.sum()))
            if skip:
                flat = np.delete(flat, _spread(np.cumsum(length) - length, np.full(len(lists), skip)))
            self.ends[i] = np.concatenate([self.ends[i], self.ends[i][-1] + np.cumsum(length - skip)])
            self.ids[i] = np.concatenate([self.ids[i], flat])

    def encode(self, words: pa.DictionaryArray) -> list[pa.LargeListArray]:
        """Ids of each word by both tokenizers, as lists."""
        distinct = words.dictionary.to_pylist()
        self.learn(distinct)
        at = pa.array(np.fromiter(map(self.place.__getitem__, distinct), dtype=np.int64, count=len(distinct))).take(words.indices)
        return [pa.LargeListArray.from_arrays(pa.array(e), pa.array(i)).take(at) for e, i in zip(self.ends, self.ids)]


# --- one share of documents ------------------------------------------------------------------------

def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _cut(values: pa.Array, of: np.ndarray, n: int) -> pa.LargeListArray:
    """Values as lists by the rising numbers 0 to n - 1 that they belong to."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends), values)


class Side:
    """Flat tokens of one tokenizer: ids, the document of each, and the byte of its document where each ends."""

    def __init__(self, lists: pa.ListArray, doc_of_word: np.ndarray, token_bytes: pa.Array, n_docs: int):
        self.ids = lists.flatten()
        self.doc = doc_of_word[pc.list_parent_indices(lists).to_numpy()].astype(np.int64)
        self.bytes, self.n_docs = token_bytes, n_docs
        self.count = np.bincount(self.doc, minlength=n_docs)

    def joined(self) -> pa.Array:
        """The bytes of each document's tokens, one after the other."""
        return pc.binary_join(_cut(self.bytes.take(self.ids), self.doc, self.n_docs), b"")

    def keep(self, docs: np.ndarray) -> None:
        kept = docs[self.doc]
        self.ids, self.doc = self.ids.filter(pa.array(kept)), self.doc[kept]
        self.count = np.where(docs, self.count, 0)

    def ends(self) -> pa.Array:
        """Document and end of each token as one key: the running sum of lengths begins anew with each document."""
        length = pc.cast(pc.binary_length(self.bytes).take(self.ids), pa.int64())
        total = pc.cumulative_sum(length).to_numpy()
        first = np.cumsum(self.count) - self.count
        base = np.concatenate([[0], total])[first]
        return pa.array((self.doc.astype(np.int64) << 40) + total - base[self.doc])

    def shown(self, group: np.ndarray, n: int) -> pa.Array:
        """Decimal ids of each group, comma-joined."""
        return pc.binary_join(_cut(pc.cast(pa.array(range(len(self.bytes))), pa.string()).take(self.ids), group, n), ",")


def _distinct(ids: np.ndarray, group: np.ndarray, size: np.ndarray, width: int, names: list[str]) -> pa.Table:
    """(group, id, times), each id once per group."""
    alone = size[group] == 1
    many = pa.table({"key": group[~alone].astype(np.int64) * width + ids[~alone]}).group_by("key", use_threads=False).aggregate([([], "count_all")])
    key = many.column("key").to_numpy()
    return pa.table({
        "group": np.concatenate([group[alone], key // width]).astype(np.int64), names[0]: np.concatenate([ids[alone], key % width]).astype(np.int64),
        names[1]: np.concatenate([np.ones(alone.sum(), dtype=np.int64), many.column("count_all").to_numpy()]),
    })


def _links(a: Side, b: Side, groups: list[np.ndarray], doc_of_group: np.ndarray) -> pa.Table:
    """(doc, pair, times) of all links; pair is a's id times the number of b's ids, plus b's id.

    A group of one token of each side is a link as it stands; the others meet in joins on the group, a slice of groups at a time.
    """
    size_a, size_b = (np.bincount(g, minlength=len(doc_of_group)) for g in groups)
    wide_a, wide_b = len(a.bytes), len(b.bytes)
    alone = (size_a == 1) & (size_b == 1)
    one_a, one_b = alone[groups[0]], alone[groups[1]]
    ids_a, ids_b = a.ids.to_numpy().astype(np.int64), b.ids.to_numpy().astype(np.int64)
    keys = [(a.doc[one_a] * wide_a + ids_a[one_a]) * wide_b + ids_b[one_b]]
    times = [np.ones(len(keys[0]), dtype=np.int64)]
    left = _distinct(ids_a[~one_a], groups[0][~one_a], size_a, wide_a, ["a", "na"])
    right = _distinct(ids_b[~one_b], groups[1][~one_b], size_b, wide_b, ["b", "nb"])
    partners = np.bincount(right.column("group").to_numpy(), minlength=len(doc_of_group))
    slice_of = np.cumsum(partners[left.column("group").to_numpy()]) // SLICE_LINKS
    summed = [pa.table({"key": keys[0], "times": times[0]})]
    for s in range(int(slice_of[-1]) + 1 if len(slice_of) else 0):
        both = left.filter(pa.array(slice_of == s)).join(right, "group", join_type="inner", use_threads=False)
        key = (doc_of_group[both.column("group").to_numpy()] * wide_a + both.column("a").to_numpy()) * wide_b + both.column("b").to_numpy()
        summed.append(_added(pa.table({"key": key, "times": both.column("na").to_numpy() * both.column("nb").to_numpy()})))
    total = _added(pa.concat_tables(summed))
    key = total.column("key").to_numpy()
    return pa.table({"doc": (key // (wide_a * wide_b)).astype(np.int32), "pair": key % (wide_a * wide_b), "times": pc.cast(total.column("times"), pa.int32())})


def _added(links: pa.Table) -> pa.Table:
    return links.group_by("key", use_threads=False).aggregate([("times", "sum")]).rename_columns(["key", "times"])


def align(texts: list[str], pair: TokenizerPair) -> tuple[dict[str, np.ndarray | list[str]], pa.Table]:
    """Columns n_a, n_b, n_groups, n_links and groups of each text, and (doc, pair, times) of their links."""
    n = len(texts)
    spaced = [" " + t if t else "" for t in texts]
    words = [_WORD.findall(t) for t in spaced]
    doc_of_word = np.repeat(np.arange(n), [len(w) for w in words])
    coded = pa.array([w for of in words for w in of], pa.large_string()).dictionary_encode()
    a, b = (Side(lists, doc_of_word, token_bytes, n) for lists, token_bytes in zip(pair.encode(coded), (pair.bytes_a, pair.bytes_b)))
    expected = pa.array([t.encode() for t in spaced], pa.large_binary())
    same = np.array([bool(t) for t in texts], dtype=bool)
    for side in (a, b):
        same &= pc.equal(pc.cast(side.joined(), pa.large_binary()), expected).to_numpy(zero_copy_only=False)
    a.keep(same)
    b.keep(same)
    ends_a = pa.table({"end": a.ends(), "at_a": np.arange(len(a.ids))})
    ends_b = pa.table({"end": b.ends(), "at_b": np.arange(len(b.ids))})
    common = ends_a.join(ends_b, "end", join_type="inner", use_threads=False)
    groups, cuts = [], []
    for side, at in ((a, "at_a"), (b, "at_b")):
        ends = np.zeros(len(side.ids), dtype=np.int64)
        ends[common.column(at).to_numpy()] = 1
        groups.append(np.cumsum(ends) - ends)
        cuts.append(ends)
    n_groups = common.num_rows
    doc_of_group = a.doc[cuts[0] == 1]
    size_a, size_b = (np.bincount(g, minlength=n_groups) for g in groups)
    per_doc = lambda values: np.bincount(doc_of_group, values, minlength=n)
    shown = pc.binary_join(_cut(pc.binary_join_element_wise(
        a.shown(groups[0], n_groups), b.shown(groups[1], n_groups), "|"), doc_of_group, n), ";").to_pylist()
    links = _links(a, b, groups, doc_of_group)
    return {
        "n_a": a.count, "n_b": b.count, "n_groups": np.bincount(doc_of_group, minlength=n),
        "n_links": per_doc(size_a * size_b).astype(np.int64), "groups": [s if ok else "" for s, ok in zip(shown, same)],
    }, links


# --- batches ---------------------------------------------------------------------------------------

RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _shares(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > chars:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


class Batch:
    """Aligned documents that are put out together with the pairs they hold."""

    def __init__(self):
        self.rows: list[pa.Array] = []
        self.columns: list[dict] = []
        self.links: list[pa.Table] = []
        self.docs = self.chars = 0

    def add(self, rows: pa.Array, texts: list[str], pair: TokenizerPair) -> None:
        columns, links = align(texts, pair)
        self.rows.append(rows)
        self.columns.append(columns)
        self.links.append(links.set_column(0, "doc", pc.add(links.column("doc"), pa.scalar(self.docs, pa.int32()))))
        self.docs += len(texts)
        self.chars += sum(map(len, texts))

    def out(self, schema: pa.Schema) -> pa.RecordBatch:
        """One row per document and a last one with the batch's pairs and in how many of its documents each stands."""
        links, n = pa.concat_tables(self.links), self.docs
        partial = links.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by([("count_all", "descending"), ("pair", "ascending")])
        place = pc.index_in(links.column("pair").combine_chunks(), value_set=partial.column("pair").combine_chunks())
        order = pa.array(np.argsort(links.column("doc").to_numpy(), kind="stable"))
        doc = links.column("doc").to_numpy()[order.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n)), [len(doc)]]).astype(np.int32)
        listed = lambda values: pa.ListArray.from_arrays(pa.array(ends), pc.cast(values.take(order), pa.int32()))
        only_last = lambda values, kind: pa.array([None] * n + [values.to_pylist()], pa.list_(kind))
        numbers = lambda name: pa.array(np.append(np.concatenate([c[name] for c in self.columns]), 0), pa.int64())
        digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for c in self.columns for g in c["groups"]]
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([*self.rows, pa.nulls(1, self.rows[0].type)]), pa.array([uuid.uuid4().hex] * (n + 1)),
            *[numbers(c) for c in RESULT[:4]], pa.array([*digests, None], pa.string()),
            listed(place), listed(links.column("times").combine_chunks()),
            only_last(partial.column("pair"), pa.int64()), only_last(partial.column("count_all"), pa.int32()),
        ], schema=schema)


def align_texts(docs: DataFrame, merges_path: str, pieces_path: str, column: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A text is read by both tokenizers with a space before it. Tokens are ``n_a`` and ``n_b``; the ends that both share cut them
    into ``n_groups``; all pairs of one token of each side in a group are links. A pair of ids counts in how many documents it is
    linked; ``n_best`` are the links whose count is the highest of their first id (ties included), ``count_sum`` sums
    the counts over the links. Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have
    zeros and an empty digest. Repeated rows stay and count each. New names replace columns of the same name.

    The aligned documents are stored once, with numbers into the list of pairs of their batch in place of pairs; only
    a batch's list, not its links, meets the counts of the corpus.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in {column, *RESULT}]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *kept).alias("row"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(TokenizerPair(merges_path, pieces_path))
    width = len(shared.value.bytes_b)
    row_type = StructType([StructField(f.name, f.dataType) for f in rows.schema["row"].dataType])  # a batch's last row has none
    schema = StructType().add("row", row_type).add("batch", StringType())
    for name in RESULT[:4]:
        schema = schema.add(name, LongType())
    schema = schema.add("groups_sha256", StringType())
    for name, kind in (("links", IntegerType()), ("times", IntegerType()), ("pairs", LongType()), ("holders", IntegerType())):
        schema = schema.add(name, ArrayType(kind))

    def aligned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held = None, Batch()
        for batch in batches:
            texts, row = batch.column(1).to_pylist(), batch.column(0)
            row = row.cast(pa.struct([f.with_nullable(True) for f in row.type]))
            if arrow is None:
                kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                arrow = pa.schema([pa.field(f, k) for f, k in zip(schema.names, [row.type, *kinds])])
            for begin, end in _shares(texts, SHARE_CHARS):
                if held.docs and held.chars + sum(map(len, texts[begin:end])) > BATCH_CHARS:
                    yield held.out(arrow)
                    held = Batch()
                held.add(row.slice(begin, end - begin), texts[begin:end], shared.value)
        if held.docs:
            yield held.out(arrow)

    def with_counts(documents: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("at")
        count, best = counts.column("n").to_numpy(), counts.column("best").to_numpy()
        links, times = documents.column("links").combine_chunks(), documents.column("times").combine_chunks()
        at, many = links.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(links).to_numpy())])
        sums = []
        for values in (best[at] * many, count[at] * many) if len(at) else (many, many):
            total = np.concatenate([[0], np.cumsum(values)])
            sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
        return pa.table([
            documents.column("row"), *[documents.column(c) for c in RESULT[:4]], *sums, documents.column("groups_sha256"),
        ], names=["row", *RESULT])

    stored = checkpoint(rows.mapInArrow(aligned, schema))
    partial = stored.filter("pairs IS NOT NULL").select(
        F.col("batch").alias("in_batch"), F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "x")).select("in_batch", "at", "x.*")
    highest = F.max("n").over(Window.partitionBy(F.expr(f"pairs DIV {width}")))
    totals = partial.groupBy("pairs").agg(F.sum("holders").alias("n")).withColumn("best", (F.col("n") == highest).cast("long"))
    answers = partial.join(totals, "pairs").select("in_batch", "at", "n", "best")
    documents = stored.filter("pairs IS NULL").select("row", "batch", *RESULT[:4], "groups_sha256", "links", "times")
    out = StructType().add("row", row_type)
    for name in RESULT:
        out = out.add(name, StringType() if name == "groups_sha256" else LongType())
    finished = documents.groupBy("batch").cogroup(answers.groupBy("in_batch")).applyInArrow(with_counts, out)
    return finished.select(*[F.col("row")[c].alias(c) for c in kept], *RESULT)
