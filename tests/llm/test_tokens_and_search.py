"""Tree concatenation, alignment of tokenizers and ranked search on small fixtures."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from celltide.llm import length_strata, token_alignment, tree_concat
from celltide.llm.queries import PIECES_FILE, VOCABULARY_FILE
from tests.conftest import rows

VOCABULARY = public_tokenizers.path(VOCABULARY_FILE)
PARTS = ["a", " ", "\n", "'", "re", "s", "é", "1", "!", "  ", "aaaa", "the", "\t", "<|endoftext|>", "中", "😀", "▁", "=", "-----", " ", "\r\n"]


@pytest.fixture(scope="module")
def vocabulary():
    return tree_concat.Vocabulary(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def made_texts(n, seed, most=80):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, most))) for _ in range(n)]


# --- tree concatenation ------------------------------------------------------------------------

def test_texts_are_encoded_as_the_library_does(vocabulary, library):
    worker = tree_concat.Encoder(vocabulary, public_tokenizers.PATTERN)
    for text in made_texts(1500, 1):
        ids = library.encode(text, add_special_tokens=False).ids
        n, shown, raw = worker.encode(text)
        assert (n, shown) == (len(ids), ",".join(map(str, ids))) and raw.decode() == text


@pytest.mark.parametrize("letters", [["a"], ["a", "aa", "b"], ["the", "in", "g", "e", "r"], list("abcdefgh")])
def test_long_matches_are_put_together_exactly(vocabulary, library, letters):
    worker, draw = tree_concat.Encoder(vocabulary, public_tokenizers.PATTERN), random.Random(5)
    for n in (47, 49, 200, 1500):
        text = "".join(draw.choice(letters) for _ in range(n))
        assert worker.encode(text)[1] == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_leaves_cut_anywhere_give_the_same_ids(vocabulary, library):
    worker, draw = tree_concat.Encoder(vocabulary, public_tokenizers.PATTERN), random.Random(7)
    for text in made_texts(1500, 2) + ["word" * 300, "it's we're " * 40, " \n \n  x" * 60]:
        size, out = draw.randint(1, 9), []
        for segment, mark in worker.segments(text):
            out += worker.tree([worker.leaf(segment[a:a + size]) for a in range(0, max(len(segment), 1), size)]).ids.tolist()
            out += [] if mark is None else [mark]
        assert out == library.encode(text, add_special_tokens=False).ids


def test_join_windows_stay_small(vocabulary):
    worker, seen = tree_concat.Encoder(vocabulary, public_tokenizers.PATTERN), []
    plain = worker.merged
    worker.merged = lambda raw: seen.append(len(raw)) or plain(raw)
    draw = random.Random(3)
    worker.stretch("".join(draw.choice("etaoinshrdlu") for _ in range(20000)).encode())
    assert max(seen) < 2000  # far below the whole: only windows around the joins are encoded anew


def test_tree_concat_over_tables(spark, library):
    texts = [None, "", "word", " ", *made_texts(40, 3), *made_texts(10, 4, 3000), "x" * 5000, "<|endoftext|>" * 50, "é中" * 900]
    texts += [texts[-3]] * 5  # equal long texts
    rows = [(i, t, f"{i}", 1.0) for i, t in enumerate(texts)] + [(None, "no id", "x", 0.0), (3, texts[3], "twice", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, _text double").repartition(3)
    out = tree_concat.encode_texts(docs, VOCABULARY, public_tokenizers.PATTERN, leaf=64)
    assert out.columns == ["doc_id", "text", "_text", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        shown = ",".join(map(str, ids))
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids"], r["ids_sha256"]) == (len(ids), shown, hashlib.sha256(shown.encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    back = tree_concat.decode_ids(out, VOCABULARY).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert tree_concat.encode_texts(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


# --- ranked search -------------------------------------------------------------------------------

def terms_by_hand(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def ranked_by_hand(docs, items, k):
    held = [(i, terms_by_hand(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for doc, words in held:
            tf, m = Counter(words), 100 - 25 + 25 * len(words) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
                for t in terms_by_hand(text) if t in tf)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def made_docs(n, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "é", "the", "THE", "a-b", "中文", "it's", "x1", "🙂"]
    draw_word = lambda: words[min(int(draw.paretovariate(0.5)) - 1, len(words) - 1)]
    return [(i, " ".join(draw_word() for _ in range(int(draw.paretovariate(0.7)) + draw.randint(0, 20)))) for i in range(n)]


@pytest.mark.parametrize("first", [1, 4])
def test_search_equals_scoring_every_document(spark, first, monkeypatch):
    docs = [(i, t[:4000]) for i, t in made_docs(400, 1)]
    docs += [(1000 + i, "the same few words w1 w2 w250") for i in range(150)]  # a third of all rows are copies
    docs += [(None, "w1 w7"), (None, None), (7, None), (8, ""), (9, "-- !!"), (3, docs[3][1]), (3, docs[3][1]), (2000, "w5 w250 " * 3000)]
    items = [(i, " ".join(t.split()[:25])) for i, t in made_docs(30, 2)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "w1 w1 w1 w250"), (None, "w2 w250"), (104, "The same few words")]
    monkeypatch.setattr(length_strata, "BLOCK_DOCS", 40)
    monkeypatch.setattr(length_strata, "CELLS", 300)
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, terms string").repartition(5)
    index = length_strata.build_index(table)
    out = length_strata.search(index, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"), k=20, first=first)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(out) == ranked_by_hand(docs, items, 20)
    strata = index.blocks.groupBy("m").count().collect()
    assert len(strata) > 5 and max(r["count"] for r in strata) > 1  # several strata, a large one in several blocks


def test_low_strata_are_not_visited(spark):
    """Blocks whose bound stays below the last place reached are left out, with the same result."""
    docs = [(i, f"rare common {'filler ' * (i % 7)}") for i in range(60)] + [(100 + i, "common " + "pad " * (30 + i)) for i in range(60)]
    index = length_strata.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    queries = length_strata.Queries([(1, "rare common")])
    shared = spark.sparkContext.broadcast(queries)
    queries.weigh(index.n_docs, length_strata._collect_terms(index, shared))
    shared = spark.sparkContext.broadcast(queries)
    least = np.array([ranked_by_hand(docs, [(1, "rare common")], 20)[0][3] // 2])
    visited = {r["doc_id"] for r in length_strata._visit(index, shared, least, 20).collect()}
    assert visited and max(visited) < 100


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame(made_docs(20, 3), "doc_id long, text string")
    items = spark.createDataFrame([(1, "the w1")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit(None).cast("string")), items)):
        out = length_strata.search(length_strata.build_index(d), i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


# --- alignment of tokenizers -----------------------------------------------------------------------

def aligned_by_hand(texts, pieces):
    merges = Tokenizer.from_file(VOCABULARY)
    merges.encode_special_tokens = True
    letters = tree_concat.byte_letters()
    ends = lambda tokens: list(itertools.accumulate(map(len, tokens)))
    out, linked = [], []
    for text in texts:
        a = merges.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        as_bytes = [bytes(letters[c] for c in merges.id_to_token(i)) for i in a]
        bs_bytes = [
            bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i in b for p in [pieces.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(as_bytes) != whole or b"".join(bs_bytes) != whole:
            out.append((0, 0, [], Counter()))
            linked.append(Counter())
            continue
        ea, eb = ends(as_bytes), ends(bs_bytes)
        groups, last = [], 0
        for e in sorted(set(ea) & set(eb)):
            groups.append(([i for i, x in zip(a, ea) if last < x <= e], [i for i, x in zip(b, eb) if last < x <= e]))
            last = e
        out.append((len(a), len(b), groups, None))
        linked.append(Counter((x, y) for g, h in groups for x in g for y in h))
    held = Counter(p for c in linked for p in c)
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    result = []
    for (n_a, n_b, groups, _), links in zip(out, linked):
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        result.append((
            n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]),
            sum(n * held[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return result


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_pairing_by_hand(spark, small, monkeypatch):
    if small:  # many shares, batches and slices
        monkeypatch.setattr(token_alignment, "SHARE_CHARS", 60)
        monkeypatch.setattr(token_alignment, "BATCH_CHARS", 300)
        monkeypatch.setattr(token_alignment, "SLICE_LINKS", 7)
    texts = [None, "", " ", "  two  spaces ", "a\n  b\n\n c", "▁", "<s> <unk> <0x0A> <|endoftext|>", "x\x00y", "ﬁ ① é", "=" * 400, "tail ", "　 wide", "a\xa0 b \x1c c"]
    texts += made_texts(150, 11) + ["hot copies of one text"] * 60 + ["The quick brown fox isn't naïve 中文 12345 " * 20]
    table = [(i, t, "kept", "n") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(table, "doc_id long, text string, row string, n_best string").repartition(4)
    out = token_alignment.align_texts(docs, VOCABULARY, public_tokenizers.path(PIECES_FILE))
    assert out.columns == ["doc_id", "row", *token_alignment.RESULT]
    want = aligned_by_hand(texts, SentencePieceProcessor(model_file=public_tokenizers.path(PIECES_FILE)))
    found = {r["doc_id"]: tuple(r[c] for c in token_alignment.RESULT) for r in out.collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        assert found[i] == want[i], t


def test_alignment_of_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    run = lambda df: token_alignment.align_texts(df, VOCABULARY, public_tokenizers.path(PIECES_FILE))
    assert run(docs.limit(0)).count() == 0
    assert sorted((r["doc_id"] or 0, r["n_links"], r["count_sum"]) for r in run(docs).collect()) == [(0, 0, 0), (0, 2, 6), (1, 2, 6), (1, 2, 6)]
    assert [r["n_a"] for r in run(docs.filter("text IS NULL")).collect()] == [0]


def test_search_holds_few_blocks_at_once(spark, monkeypatch):
    key, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", length_strata._rows
    docs = spark.createDataFrame([(i, "common " * (1 + 9 * i) + f"rare{i % 7}") for i in range(40)], "doc_id long, text string").coalesce(1)
    index = length_strata.build_index(docs)
    index.blocks = index.blocks.coalesce(1)
    most = length_strata.BATCH_BLOCKS
    assert index.blocks.count() > 2 * most

    def few(batches):
        def checked():
            for batch in batches:
                assert batch.num_rows <= most
                yield batch
        return plain(checked())

    before = spark.conf.get(key)
    monkeypatch.setattr(length_strata, "_rows", few)
    found = length_strata.search(index, spark.createDataFrame([(1, "common rare3")], "item_id long, text string"), k=20)
    assert found.count() == 20 and spark.conf.get(key) == before


def test_scoring_holds_few_postings_at_once():
    texts = [" ".join(f"t{k}" for k in range(100)) + f" own{i}" for i in range(300)]
    tables = [pa.Table.from_batches([b]) for b in length_strata._frequencies([pa.RecordBatch.from_pydict({"doc_id": range(300), "salt": range(300), "text": texts})])]
    held = pa.concat_tables(tables)
    held = held.append_column("m", pa.array([100] * 300)).append_column("shard", pa.array([0] * 300, pa.int32()))
    block = next(length_strata._rows(length_strata._block(held).to_batches()))
    queries = length_strata.Queries([(i, texts[i]) for i in range(200)])
    places, least = length_strata._places(queries, block), np.zeros(200, dtype=np.int64)
    tracemalloc.start()
    found = list(length_strata._score(queries, block, places, np.arange(200), least, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    one = int(length_strata.impact(np.array([1]), 100)[0])
    assert [f for f in found if f[0] == 7] == [(7, 7, 101 * one), (7, 0, 100 * one), (7, 1, 100 * one)]
    assert len(found) == 600 and peak < 60_000_000  # the 6 million postings of all queries take 48 MB a column
