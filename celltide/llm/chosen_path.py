"""Near-duplicate documents by a chosen-path set similarity join on word shingles.

A document is the set of its distinct word shingles, and links with every document of at least the given
Jaccard similarity. Each set has a signature of minwise tokens. A tree starts with all sets in one node; a
node chooses some of the signature's coordinates at random, 1 / similarity of them on average, and its sets branch
along each by their minwise token, so that similar sets keep meeting while others part. Nodes small enough are compared
exhaustively; larger ones branch again. Independent trees are repeated until a link is as
good as certain to be met.

A dense node, whose sets stay together level after level because they are copies of each other, is compared
in blocks: first each block within itself and with some hubs of the node, so that a large group of copies costs time in
proportion to its size. Later trees, which know the components, branch a node further only while many
of its sets are outside its main component, and compare the few that are left against all others. No pairs are written: a block gives the links that join its components. Nodes of
different trees with the same sets are one block. Candidate pairs are those in one block whose sketches, a byte of each
minwise token, agree well enough; only their texts are shuffled, and each link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from celltide.llm.blocks import by_block, runs
from celltide.llm.components import components
from celltide.llm.text import whole
from celltide.runtime import checkpoint

#: Coordinates of a signature, and how many must agree for a candidate pair: at similarity 0.8 fewer agree in about one pair of 100,000.
COORDINATES, AGREE = 64, 37
#: Trees of the two rounds: the first finds nearly all links, the second the links that it missed.
TREES = (2, 10)
#: Sets of a node that is compared at once, levels of branching, sets of a block of a dense node, hubs of a dense node.
SMALL, DEPTH, BLOCK, HUBS = 256, 4, 256, 4
#: Levels of branching in the second round, for nodes with more than CROSSED blocks of sets outside their main component only: so few
#: meet all others in a few rows a set, fewer than the node's branches have by the time that they are small.
DEEP, CROSSED = 12, 2
#: Bits of the filter that keeps texts without a candidate out of the shuffle, at most 8 MB of them.
FILTER_BITS = 2**26
#: Bits of one row of that filter, as Spark's bitmap functions cut them.
_BITMAP = 32_768
_ODD = np.random.default_rng(20).integers(0, 2**32, (2, COORDINATES), dtype=np.uint32) | np.uint32(1)
_FLIP = np.random.default_rng(21).integers(0, 2**32, COORDINATES, dtype=np.uint32)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)


class _Hashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def words_of(text: str) -> list[bytes]:
    """Words between ASCII blanks, with A-Z in lower case."""
    return text.encode().lower().split()


def shingles(words: list[bytes], size: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; fewer words are one shingle as a whole."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(size, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - span + 1, span, dtype=np.uint64)
        for k in range(span):
            out = (out ^ h[k:len(h) - span + 1 + k]) * _MIX[k % 4]
            out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(sets: np.ndarray) -> bytes:
    """The minwise token of each coordinate: the least of 32-bit hashes of the set's shingles."""
    least, tokens = np.full(COORDINATES, np.iinfo(np.uint32).max, dtype=np.uint32), (sets >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(tokens), 2048):
            h = (tokens[at:at + 2048, None] ^ _FLIP) * _ODD[0]
            h ^= h >> np.uint32(15)
            h *= _ODD[1]
            np.minimum(least, h.min(axis=0), out=least)
    return least.astype("<u4").tobytes()


def _key(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words)).digest()


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, n_shingles, signature, sketch) per row; key tells different word sequences apart and is null without words.

    The sketch is the lowest byte of each of the signature's tokens.
    """
    @F.pandas_udf("struct<key: binary, n_shingles: long, signature: binary, sketch: binary>")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for batch in batches:
            rows = []
            for text in batch:
                words = words_of(text)
                found = shingles(words, size, hashes)
                tokens = signature(found) if words else b""
                rows.append((_key(words), len(found), tokens, tokens[::4]) if words else (None, 0, None, None))
            yield pd.DataFrame(rows, columns=["key", "n_shingles", "signature", "sketch"])

    return docs.withColumn("_set", digest(whole(F.col("text")))).select(
        "doc_id", "_set.key", "_set.n_shingles", "_set.signature", "_set.sketch",
    )


def _chosen(node: Column, similarity: float) -> Column:
    """The coordinates that a node chooses, at least one."""
    share = int(1_000_000 / (similarity * COORDINATES))
    chosen = F.filter(
        F.sequence(F.lit(0), F.lit(COORDINATES - 1)),
        lambda i: F.pmod(F.xxhash64(node, i), F.lit(1_000_000)) < share,
    )
    one = F.array(F.pmod(F.xxhash64(node, F.lit("first")), F.lit(COORDINATES)).cast("int"))
    return F.when(F.size(chosen) > 0, chosen).otherwise(one)


def _branch(frontier: DataFrame) -> DataFrame:
    """Children (node, doc, component) of each (node, at, doc, component, signature), one per chosen coordinate ``at``."""
    token = F.substring(F.col("signature"), F.col("at") * 4 + 1, F.lit(4))
    return frontier.select(F.xxhash64("node", "at", token).alias("node"), "doc", "component")


def _paths(sets: DataFrame, trees: range, similarity: float, deep: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Members (block, doc) of the small nodes of some trees, and (node, doc) of the dense ones that stay large to the last level.

    A small node is named by its sets, so that the same sets are one block wherever they meet. Where ``deep`` is beyond DEPTH, only nodes with more than CROSSED blocks of sets outside
    their main component branch; the others are dense ones as they are. Nodes whose sets are already in one component have nothing to find and are left out. Rows are narrow:
    signatures join large nodes only.
    """
    # a root's choice is the same for all sets: one row per tree
    root = F.xxhash64(F.lit("tree"), "id")
    roots = sets.sparkSession.range(trees.start, trees.stop).select(root.alias("node"), F.explode(_chosen(root, similarity)).alias("at")).collect()
    chosen = F.array(*[F.struct(F.lit(r["node"]).alias("node"), F.lit(r["at"]).alias("at")) for r in roots])
    frontier, small = sets.select("doc", "component", "signature", F.inline(chosen)), None
    dense = None
    for level in range(1, deep + 1):
        children = _branch(frontier)
        counts = children.groupBy("node").agg(
            F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"),
            F.expr("bit_xor(xxhash64(doc, 'name'))").alias("name"),
        ).filter("n > 1 AND low < high").select("node", F.xxhash64("n", "name").alias("block"), F.when(F.col("n") > SMALL, _chosen(F.col("node"), similarity)).alias("chosen"))
        kept = checkpoint(children.join(counts, "node"))
        found = kept.filter("chosen IS NULL").select("block", "doc")
        small = found if small is None else small.unionByName(found)
        large = kept.filter("chosen IS NOT NULL").drop("block")
        if large.isEmpty():
            break
        if level == deep:
            dense = large if dense is None else dense.unionByName(large)
        elif deep > DEPTH:
            rest = large.groupBy("node", "component").agg(F.count("*").alias("n")).groupBy("node").agg((F.sum("n") - F.max("n")).alias("rest"))
            rest = checkpoint(rest)
            done = large.join(rest.filter(F.col("rest") <= CROSSED * BLOCK), "node", "left_semi")
            dense = done if dense is None else dense.unionByName(done)
            large = large.join(rest.filter(F.col("rest") > CROSSED * BLOCK), "node", "left_semi")
            if large.isEmpty():
                break
        frontier = large.withColumn("at", F.explode("chosen")).drop("chosen").join(sets.select("doc", "signature"), "doc")
    return small.distinct(), (large if dense is None else dense).select("node", "doc")


def _in_block(*parts) -> Column:
    return F.xxhash64(*parts).alias("block")


def _spot(blocks: str) -> Column:
    return F.pmod(F.xxhash64("doc", F.lit("spot")), F.col(blocks))


def _diagonal(dense: DataFrame) -> DataFrame:
    """Blocks (block, doc) of dense nodes, each with the node's hubs."""
    hub = [F.min(F.struct(F.xxhash64("doc", F.lit(k)), "doc")).getField("doc") for k in range(HUBS)]
    nodes = dense.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.array(*hub).alias("hubs"))
    own = dense.join(nodes, "node").select(_in_block("node", _spot("blocks")), "doc")
    hubs = nodes.withColumn("spot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        _in_block("node", "spot"), F.explode(F.array_distinct("hubs")).alias("doc"),
    )
    return own.unionByName(hubs)


def _crossing(dense: DataFrame, sets: DataFrame) -> DataFrame:
    """Blocks (block, doc) of dense nodes that bring what is outside a node's main component together with all of the node."""
    placed = dense.join(sets.select("doc", "component"), "doc")
    sizes = placed.groupBy("node", "component").agg(F.count("*").alias("n")).groupBy("node").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main"),
    ).select(
        "node", F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).alias("rest_blocks"),
        F.col("main.component").alias("main"),
    ).filter("rest_blocks > 0")
    at = placed.join(sizes, "node")
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = at.filter("component <> main").withColumn("b", others("blocks")).select(_in_block("node", _spot("rest_blocks"), "b"), "doc")
    every = at.withColumn("r", others("rest_blocks")).select(_in_block("node", "r", _spot("blocks")), "doc")
    return rest.unionByName(every)


def find_links(blocks: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each block's sets, confirmed on the full sets of their texts.

    ``blocks`` holds (block, doc). Sketches come first: a set stays in its block only beside another that is
    not yet in its component, is near enough in size, and has a sketch that agrees. Blocks that are left with the same sets
    become one, so what meets in many nodes is confirmed once.
    """
    posted = blocks.join(sets, "doc").select("block", "doc", "key", "component", "n_shingles", "sketch")

    def candidates(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for _, (doc, key, component, n, sig) in runs(batches):
            group, n = np.array(component), np.array(n)
            sig = np.frombuffer(b"".join(sig), dtype=np.uint8).reshape(len(doc), -1)
            alive = []
            for i in range(len(doc)):
                other = np.flatnonzero((group != group[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent))
                if len(other) and ((sig[other] == sig[i]).sum(axis=1) >= AGREE).any():
                    alive.append((doc[i], key[i], component[i]))
            if alive:
                name = hashlib.blake2b(repr(sorted(set(alive))).encode(), digest_size=8).digest()
                rows += [(int.from_bytes(name, "little", signed=True), *a) for a in set(alive)]
            if len(rows) > 10_000:
                yield pd.DataFrame(rows, columns=["block", "doc", "key", "component"])
                rows = []
        yield pd.DataFrame(rows, columns=["block", "doc", "key", "component"])

    alive = checkpoint(by_block(posted).mapInPandas(candidates, "block long, doc long, key binary, component long").distinct())
    texts = _likely_in(docs.select(F.col("doc_id").alias("doc"), "text"), alive)
    shipped = by_block(alive.join(texts, "doc").select("block", "doc", "key", "component", "text"))

    def confirm(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for _, members in runs(batches):
            if links := _links_of_block(members, size, percent, hashes):
                yield pd.DataFrame(links, columns=["a", "b"])

    return shipped.mapInPandas(confirm, "a long, b long")


def _likely_in(texts: DataFrame, alive: DataFrame) -> DataFrame:
    """``texts`` whose doc is in ``alive``, and few others: a join must follow.

    A filter of one hashed bit per document, at most FILTER_BITS, 16 for each row of ``alive`` below that, is broadcast. The more documents
    are alive, the less it holds back.
    """
    maps = max(1, min(FILTER_BITS, 16 * alive.count()) // _BITMAP)
    spot = F.pmod(F.xxhash64("doc", F.lit("filter")), F.lit(maps * _BITMAP))
    bits = alive.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("map")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"),
    )
    at = F.bitmap_bit_position("spot")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return texts.withColumn("spot", spot).withColumn("map", F.bitmap_bucket_number("spot")).join(F.broadcast(bits), "map").filter(
        F.getbit(byte, (at % 8).cast("int")) == 1,
    ).select("doc", "text")


def _links_of_block(members: list[list], size: int, percent: int, hashes: _Hashes) -> list[tuple[int, int]]:
    """Links between sets of different components, as many as join them."""
    found: dict[tuple[int, bytes], tuple[int, np.ndarray]] = {}
    for doc, key, component, text in zip(*members):
        if (doc, key) in found:
            continue
        words = words_of(text or "")
        if _key(words) == key:  # a row of the same id with another text is not this set
            found[doc, key] = (component, shingles(words, size, hashes))
    docs, sets = [doc for doc, _ in found], [s for _, s in found.values()]
    if len(sets) < 2:
        return []
    group, size_of = np.array([c for c, _ in found.values()]), np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size_of)[:-1]])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, links = np.zeros(flat.max() + 1, dtype=np.int32), []
    for i in range(len(sets)):
        other = group != group[i]
        if not other.any():
            continue
        own = flat[start[i]:start[i] + size_of[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], start)
        mark[own] = 0
        linked = other & (100 * common >= percent * (size_of + size_of[i] - common))
        joined = np.unique(group[linked])
        links += [(docs[i], docs[int(np.flatnonzero(linked & (group == g))[0])]) for g in joined]
        group[np.isin(group, joined)] = group[i]
    return links


def classify(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept), one per row of ``docs``, which needs doc_id and text only.

    Rows of an equal word sequence are one set, whose least id stands for it. ``component_id`` is the
    least id reachable by links, ``kept`` marks the rows whose id it is. Texts without words, null ones included, have
    no shingles, link with nothing and are kept. Rows without an id take no part: their component is null and they are kept
    as well, since nothing is known to stand for them. A null key marks texts without words.
    """
    percent = round(similarity * 100)
    rows = checkpoint(sets_of(docs, size))
    sets = checkpoint(rows.filter("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
        F.first("sketch").alias("sketch"),
    ).withColumn("component", F.col("doc")))
    small, dense = _paths(sets, range(TREES[0]), similarity)
    blocks = small.unionByName(_diagonal(dense))
    first = checkpoint(find_links(blocks, sets, docs, size, percent))
    sets = checkpoint(_with_components(sets, components(first)))
    small, dense = _paths(sets, range(TREES[0], sum(TREES)), similarity, DEEP)
    blocks = small.unionByName(_crossing(dense, sets))
    second = checkpoint(find_links(blocks, sets, docs, size, percent))
    sets = _with_components(sets, components(first.unionByName(second)))
    own = F.coalesce("component", "doc_id")
    return rows.join(sets.select("key", "component"), "key", "left").select(
        "doc_id", "key", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _with_components(sets: DataFrame, found: DataFrame) -> DataFrame:
    return sets.drop("component").join(found.select(F.col("id").alias("doc"), "component_id"), "doc", "left").select(
        "key", "doc", "n_shingles", "signature", "sketch", F.coalesce("component_id", "doc").alias("component"),
    )


def word_key(text: Column) -> Column:
    """The key of a text's word sequence, as ``classify`` gives it."""
    lower = F.translate(whole(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.md5(F.btrim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))))


def deduplicate(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates those with its least id.

    Rows repeated with their id and text stay together; so does everything without words or id. Columns are kept.
    """
    gone = classify(docs.select("doc_id", "text"), size, similarity).filter("NOT kept").groupBy(
        F.col("doc_id").alias("_id"),
    ).agg(F.collect_set("key").alias("_keys"))
    goes = F.when(F.col("_keys").isNull(), F.lit(False)).otherwise(F.array_contains("_keys", word_key(F.col("text"))))
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left").filter(~goes).select(*[docs[c] for c in docs.columns])
