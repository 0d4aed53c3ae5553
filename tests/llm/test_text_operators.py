"""Mixing, tokenising, personal data, toxicity and line spread on small fixtures."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from celltide.llm import bpe, line_spread, mixing, pii, toxicity
from celltide.llm.queries import RANKS_FILE

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


# --- mixing ---------------------------------------------------------------------------------

def targets_by_hand(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        now = {s for s in order if s in capped or (share and weight[s] * rest / share > most * sizes[s])}
        if now == capped:
            return {s: most * sizes[s] if s in capped else weight[s] * rest / share for s in order}
        capped = now


def test_mix_reaches_targets_and_reruns_agree(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(["w"] * draw.randint(0, 60)), draw.choice(["a", "b", "c", None, "é"])) for i in range(3000)]
    rows += [(5000 + i, "few words here", "tiny") for i in range(3)]
    df = docs_of(spark, rows)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = targets_by_hand(dict(sizes))
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.005 * t), s
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in out) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_flight_keeps_totals_and_settles_all_but_a_few():
    draw = np.random.default_rng(1)
    size, chance = np.sort(draw.integers(0, 900, 5000))[::-1], np.full(5000, 0.37)
    left = mixing.fly(size, chance, "s")
    assert abs(left.sum() - chance.sum()) < 1e-6 and abs((left * size).sum() - (chance * size).sum()) < 1e-3
    assert ((left > 1e-9) & (left < 1 - 1e-9)).sum() <= mixing.HELD + 2
    same = mixing.fly(np.full(9, 5), np.full(9, 0.5), "s", held=0)
    assert abs(same.sum() - 4.5) < 1e-9


def test_flights_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    df = docs_of(spark, [(i, "w " * (i % 17), "s" if i % 3 else "t") for i in range(900)])
    out = mixing.mix(df)
    sums = {r["source"]: r for r in out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("k"), F.first("target").alias("t")).collect()}
    assert all(abs(r["k"] - r["t"]) < 3 for r in sums.values())


def test_mix_edge_cases(spark):
    odd = docs_of(spark, [(1, None, None), (None, "a b", "x"), (None, "a b", "x"), (2, "", "x"), (3, "\t\n", "y"), (4, "z", "y")])
    out = mixing.mix(odd.withColumn("size", F.lit("mine")).withColumn("rows", F.lit(9)))
    assert out.count() == 6 and "rows" in out.columns
    assert {r["copies"] for r in out.filter("doc_id IS NULL").collect()}.__len__() == 1
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(docs_of(spark, [(1, None, "a"), (2, "", "b")])).agg(F.sum("target")).first()[0] == 0
    repeated = mixing.repeated(mixing.mix(odd))
    assert repeated.columns == odd.columns


# --- byte-level BPE --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(RANKS_FILE))


@pytest.fixture(scope="module")
def reference_encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_word_by_word_merging(ranks, reference_encoding):
    draw = random.Random(5)
    texts = ["", "aaaa", "a" * 4001, "abababab", "  \n\n x", "é" * 60, "漢字かな交じり", "<|endoftext|>", "don't 123456 \x00"]
    texts += ["".join(draw.choice("abeé tion12\n漢") for _ in range(draw.randint(1, 80))) for _ in range(1500)]
    worker = bpe.Replayer(ranks, public_tokenizers.PATTERN)
    tokens = {r: t for t, r in ranks.items()}
    for text, packed in zip(texts, worker.encode(texts)):
        assert list(memoryview(packed).cast("I")) == reference_encoding.encode_ordinary(text)
        assert bpe.decode(packed, tokens) == text.encode()


def test_merge_that_opens_a_smaller_rank_comes_first():
    tokens = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 260, b"abcab": 301}
    encoding = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=tokens, special_tokens={})
    merges = bpe.Merges(tokens)
    for word in ("abcab", "ababcab", "cabcabab", "abab"):
        packed = bpe.replay([word.encode()], merges)[0]
        assert list(memoryview(packed).cast("I")) == encoding.encode_ordinary(word)


def test_replay_forgets_words_without_changing_results(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 10)
    worker = bpe.Replayer(ranks, public_tokenizers.PATTERN)
    assert worker.encode(["one two"]) == worker.encode(["one two"]) == worker.encode(["one two"])


def test_encode_texts_round_trip(spark, ranks):
    df = docs_of(spark, [(1, None, "a"), (2, "", "a"), (None, "héllo wörld", "b"), (None, "héllo wörld", "b"), (3, "x " * 5000, None)])
    path = public_tokenizers.path(RANKS_FILE)
    out = bpe.encode_texts(df.withColumn("n_tokens", F.lit("mine")), path, public_tokenizers.PATTERN)
    rows = bpe.decode_ids(out, path).collect()
    assert len(rows) == 5
    for r in rows:
        text = (r["text"] or "").encode()
        assert bytes(r["decoded"]) == text and r["decoded_sha256"] == hashlib.sha256(text).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest() and r["n_tokens"] == len(r["ids"]) // 4
    assert bpe.encode_texts(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_ids_leave_a_task_in_shares(spark, monkeypatch):
    # by way of the query: what a task gives back at once holds no more than a share of the texts
    texts = [f"word{i} " * 100 for i in range(40)]
    monkeypatch.setattr(bpe, "REPLAY_CHARS", 3000)
    frames, plain = [], bpe.F.pandas_udf
    monkeypatch.setattr(bpe.F, "pandas_udf", lambda kind: lambda f: frames.extend(f(iter([pd.Series(texts)]))) or plain(kind)(f))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = bpe.encode_texts(df, public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN)
    assert max(map(len, frames)) <= 5 and sum(map(len, frames)) == 40
    assert [p for f in frames for p in f["ids"]] == [bytes(r["ids"]) for r in out.orderBy("doc_id").collect()]


def test_read_ranks(tmp_path):
    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)) + b"\n")
    assert bpe.read_ranks(str(tmp_path / "v"))[b"a"] == 97


# --- personal data ----------------------------------------------------------------------------

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [
                True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True,
                14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15,
            ][kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_plain_patterns():
    draw = random.Random(7)
    for _ in range(4000):
        text = "".join(draw.choice("ab@.1234567890  -+()%") for _ in range(draw.randint(0, 60)))
        assert pii.find_spans([text], None)[0][0] == plain_spans(text), text
    for text in ("4111 1111 1111 1111", "a@b@c.de", "1.2.3.4.5.6.7.8", "+1 (262) 555-3752", "999.1.1.1", "x@" * 3000, "1" * 2000):
        assert pii.find_spans([text], None)[0][0] == plain_spans(text)


def test_gradient_of_the_tagger():
    draw = np.random.default_rng(0)
    x = draw.integers(1, 10, (3, pii.WINDOW))
    x[1, 40:], x[2, 5:] = 0, 0
    y = draw.integers(0, 9, x.shape) * (x > 0)
    tagger = pii.Tagger()

    def loss():
        both = np.concatenate([tagger._lstm("f", x)[0], tagger._lstm("b", x)[0]], axis=2)
        scores = both @ tagger.p["out"] + tagger.p["bias"]
        total, out = tagger._chain(scores, x)[2], 0.0
        for i in range(len(x)):
            n = (x[i] > 0).sum()
            out += total[i, 0, 0] - scores[i, 0, y[i, 0]] - sum(tagger.p["move"][y[i, t - 1], y[i, t]] + scores[i, t, y[i, t]] for t in range(1, n))
        return out / len(x)

    slope = tagger.gradient(x, y)
    for name, value in tagger.p.items():
        at = tuple(int(x[0, 3]) if k == 0 and name in ("fx", "bx") else draw.integers(0, n) for k, n in enumerate(value.shape))
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        down = loss()
        value[at] += 1e-5
        assert abs((up - down) / 2e-5 - slope[name][at]) < 1e-5, name


def test_tagger_learns_and_windows_reconcile(spark):
    draw = random.Random(2)
    words = "lorem ipsum dolor sit amet consectetur".split()

    def sentence():
        filler = lambda: " ".join(draw.choices(words, k=draw.randint(3, 12)))
        mail = f"{draw.choice(words)}.{draw.choice(words)}{draw.randint(1, 99)}@{draw.choice(words)}.org"
        address = ".".join(str(draw.randint(1, 255)) for _ in range(4))
        return f"{filler()} {draw.choice([mail, address, str(draw.randint(1, 9999))])} {filler()}"

    df = docs_of(spark, [(i, sentence(), "s") for i in range(600)])
    tagger = pii.train_tagger(df, train_docs=500, train_windows=400)
    held = [sentence() for _ in range(150)]
    hit = total = 0
    for text in held:
        probability = {}
        for a, b in pii.stretches(text):
            starts = pii.windows(a, b)
            p = tagger.probabilities(np.stack([pii.symbols(text[s:min(s + pii.WINDOW, b)]) for s in starts]))
            for span in pii.best_spans(pii.reconcile(p, starts, a, b), a):
                probability[span[:3]] = span[3]
        base = pii.find_spans([text], None)[0][0]
        total += len(base)
        hit += sum(s in probability for s in base)
    assert hit / total > 0.9
    out = pii.personal_data(df, tagger)
    for r in out.collect():
        assert r["n_email"] == sum(k == 0 for _, _, k in plain_spans(r["text"]))
        assert r["base_sha256"] == hashlib.sha256(pii.said(plain_spans(r["text"])).encode()).hexdigest()
        assert all(r["text"][f["start"]:f["end"]] == f["text"] for f in r["found"])


def test_network_adds_spans_that_the_patterns_miss(spark):
    draw = random.Random(6)
    words = "lorem ipsum dolor sit amet consectetur".split()
    filler = lambda: " ".join(draw.choices(words, k=draw.randint(4, 10)))
    n = lambda k: "".join(draw.choices("0123456789", k=k))

    def sentence(part):
        return f"{filler()} {part} {filler()}"

    def seen():
        mail = f"{draw.choice(words)}{draw.randint(1, 99)}@{draw.choice(words)}.org"
        address = ".".join(str(draw.randint(1, 255)) for _ in range(4))
        return sentence(draw.choice([mail, address, f"+1 ({n(3)}) 555-{n(4)}", str(draw.randint(1, 9999)), "4111111111111111"]))

    tagger = pii.train_tagger(docs_of(spark, [(i, seen(), "s") for i in range(800)]))
    for kind, make in (
        (3, lambda: f"({n(3)}) 555-{n(4)}"), (3, lambda: f"030 / {n(3)} {n(3)} {n(2)}"), (3, lambda: f"{n(3)}-{n(3)}-{n(4)}"),
        (0, lambda: f"john{n(2)} @ {draw.choice(words)}.com"), (1, lambda: " . ".join(str(draw.randint(1, 255)) for _ in range(4))),
        (2, lambda: "4111.1111.1111.1111"),
    ):
        parts = [make() for _ in range(40)]
        texts = [sentence(p) for p in parts]
        wanted = [(t.index(p), t.index(p) + len(p), kind) for t, p in zip(texts, parts)]
        found = [added for _, added in pii.find_spans(texts, tagger)]
        assert sum(w in f for w, f in zip(wanted, found)) >= 32, parts[0]
    clean = [sentence(p) for p in ("2024-01-15", "15.01.2024", "12:30:45", "1,234,567", "1999", "4111111111111112", "999.1.1.1", "3 @ 5") for _ in range(5)]
    assert sum(bool(added) for _, added in pii.find_spans(clean, tagger)) <= 4
    out = pii.personal_data(docs_of(spark, [(1, sentence("(555) 123-4567"), "s"), (2, sentence("john12 @ example.com"), "s")]), tagger)
    spans = {r["doc_id"]: r["spans"] for r in out.collect()}
    assert spans[1].startswith("phone:") and spans[2].startswith("email:")


def test_personal_data_edge_cases(spark):
    df = docs_of(spark, [(1, None, "a"), (1, None, "a"), (None, "", None), (2, "é 10.0.0.1", "b")]).withColumn("spans", F.lit(1))
    out = pii.personal_data(df, None).collect()
    assert sorted(r["spans"] for r in out) == ["", "", "", "ip:2:10"]
    assert pii.train_tagger(df.limit(0)) is None and pii.personal_data(df.limit(0), None).count() == 0
    assert pii.train_tagger(docs_of(spark, [(1, "no data", "a")])) is None


# --- toxicity ---------------------------------------------------------------------------------

def test_composed_grammar_marks_context():
    matcher = toxicity.Matcher(["idiot", "grum*"])
    held = lambda text: {p for p, i in matcher.place.items() if matcher.matches(text) >> i & 1}
    assert held("Plain text. No more.") == set()
    assert held("what an IDIOT") == {"insult"} == held("such grumlich words")
    assert held("you idiot") == {"aimed insult"}
    assert held("not an idiot") == {"negated insult"}
    assert held("not a word of this or that idiot") == {"insult"}
    assert held("he said you idiot") == {"aimed reported insult"}
    assert held("you there. idiot") == {"insult"}
    assert held("they kill you") == {"aimed threat"}
    assert held("xidiot idiotic") == set()


def test_composition_equals_one_after_the_other():
    a = toxicity.Transducer("p", {("p", "x"): ("q", "y"), ("q", "x"): ("p", "insult x")})
    b = toxicity.Transducer("0", {("0", "y"): ("1", "z"), ("1", "insult x"): ("0", "insult w")})
    table, outputs = toxicity.compose([a, b], ["x", "o"])
    state, got, sa, sb, want = 0, [], "p", "0", []
    for symbol in "xoxxxoxx":
        state, out = table[state][symbol]
        got.append(out)
        sa, mid = a.step(sa, symbol)
        sb, out = b.step(sb, mid)
        want.append(out)
    assert got == want and "insult w" in outputs


def test_toxicity_on_held_out_rows(spark):
    draw = random.Random(11)
    clean = ["".join(draw.choices("aeionrst", k=7)) for _ in range(400)]
    bad = ["sludge", "vermin", *(f"quorx{x}" for x in ("a", "el", "ik", "o", "um"))]
    rows, labels = [], []
    for i in range(1500):
        words, toxic = draw.choices(clean, k=40), int(i % 5 == 0)
        if toxic:
            for w in draw.choices(bad, k=2):
                words.insert(draw.randint(0, 40), w)
        rows.append((i, " ".join(words).capitalize() + ".", "s"))
        labels.append((i, 1, toxic))
    # one toxic document with many copies must not make its other words toxic
    rows += [(2000 + i, rows[0][1], "s") for i in range(60)]
    labels += [(2000 + i, 1, 1) for i in range(60)]
    df, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks)
    out = toxicity.score(df, model).join(marks, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) > 200 and sum(r["predicted"] == r["toxic"] for r in out) / len(out) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out)
    assert not any(w in model.lexicon for w in rows[0][1].lower().rstrip(".").split() if w in clean)


def test_toxicity_edge_cases(spark):
    df = docs_of(spark, [(1, None, "a"), (1, "", None), (None, "idiot " * 3000, "b")]).withColumn("score", F.lit("x"))
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, none)
    out = toxicity.score(df, model)
    assert out.count() == 3 and out.filter("predicted = 1").count() == 0
    assert toxicity.fit(df, none.limit(0)).lexicon == [] and toxicity.score(df.limit(0), model).count() == 0


# --- line spread ------------------------------------------------------------------------------

def spread_by_hand(rows, least):
    """Lines on at least so many sites and in as many different texts."""
    sites, texts = defaultdict(set), defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                sites[line].add(site)
                texts[line].add(text)
    return {line for line in sites if min(len(sites[line]), len(texts[line])) >= least}


def test_lines_of_many_sites_go_but_for_their_first(spark):
    draw = random.Random(4)
    own = lambda: "".join(draw.choices("abcdef ", k=20)) + "."
    rows = []
    for i in range(300):
        lines = [own() for _ in range(4)]
        if i % 2:
            lines.insert(draw.randint(0, 4), "Accept all cookies")
        if i < 44:
            lines.append(f"near {i % 4}")  # eleven sites each, near the threshold
        rows.append((i, "\n".join(lines), f"site{i % 30}"))
    copy = "\n".join(own() for _ in range(5))
    rows += [(1000 + i, copy, f"site{i % 30}") for i in range(60)]
    out = {r["doc_id"]: r for r in line_spread.remove_boilerplate(docs_of(spark, rows), min_sites=10).collect()}
    gone = spread_by_hand(rows, 10)
    assert "Accept all cookies" in gone and "near 0" in gone and not any(line in gone for line in copy.split("\n"))
    seen = set()
    for i, text, _ in sorted(rows):
        kept = []
        for line in text.split("\n"):
            if line not in gone or line not in seen:
                kept.append(line)
            if line in gone:
                seen.add(line)
        assert out[i]["text"] == "\n".join(kept) and out[i]["n_removed"] == len(text.split("\n")) - len(kept)


def test_blocks_and_paragraphs_of_many_sites_go(spark):
    own = lambda i, k: f"own line {k} of document {i}"
    block, paragraph = [f"boilerplate {k}" for k in range(5)], "a paragraph between blank lines"
    rows = [(i, "\n".join([own(i, 0), *block, own(i, 1)]), f"site{i}") for i in range(30)]
    rows += [(100 + i, "\n".join(["header one", "header two", own(100 + i, 0), "", paragraph, "", own(100 + i, 1)]), f"site{i}") for i in range(30)]
    # every document stands on the site that sorts first too
    rows += [(200 + i + 50 * k, f"{own(200 + i, 0)}\nhot line\n{own(200 + i, 1)}", ["a", f"site{i}"][k]) for i in range(30) for k in range(2)]
    # nine sites are too few, and so are nine texts on thirty sites
    rows += [(400 + i, f"{own(400 + i, 0)}\nnine sites", f"site{i % 9}") for i in range(30)]
    rows += [(500 + i, f"{own(500 + i % 9, 0)}\nnine texts", f"site{i}") for i in range(30)]
    df = docs_of(spark, rows)
    out = {r["doc_id"]: r for r in line_spread.remove_boilerplate(df, min_sites=10).collect()}
    spread = {*block, paragraph, "header one", "header two", "hot line"}
    seen = set()
    for i, text, _ in sorted(rows):
        kept = [x for x in text.split("\n") if x not in spread or x not in seen]
        seen |= spread & set(text.split("\n"))
        assert out[i]["text"] == "\n".join(kept) and out[i]["n_removed"] == len(text.split("\n")) - len(kept), i
    sites = sorted(r["sites"] for r in line_spread.spread_lines(df, min_sites=10).collect())
    assert sites == pytest.approx([30] * 8 + [31], abs=0.01)


def test_line_spread_edge_cases(spark):
    odd = docs_of(spark, [(1, None, "a"), (2, "", None), (None, "x\n\nx", "b"), (None, "x\n\nx", "b"), (3, "x\n" * 3000, "c")])
    out = line_spread.remove_boilerplate(odd.withColumn("line", F.lit(1)).withColumn("n_lines", F.lit("q")), min_sites=2)
    assert out.count() == 5 and out.filter("doc_id = 1").first()["text"] is None
    assert out.filter("doc_id = 2").first()["text"] == ""
    assert line_spread.remove_boilerplate(odd.limit(0)).count() == 0


def test_clauses_are_read_from_their_beginning():
    matcher = toxicity.Matcher(["idiot"])
    names = lambda text: {p for p, i in matcher.place.items() if matcher.matches(text) >> i & 1}
    filler = "calm and even words " * 100
    for text in ("he wrote that you are an idiot", f"he wrote that you {filler} are an idiot", f"{filler}. he wrote that you {filler} are an idiot"):
        assert names(text) == {"aimed reported insult"}, text
    assert names(f"he wrote that. you {filler} idiot") == {"aimed insult"}
    assert names(f"you idiot {filler} idiot. {filler} idiot") == {"aimed insult", "insult"}


def test_training_windows_are_distinct(spark, monkeypatch):
    """One line in thousands of documents is one training window, not all of them."""
    docs = [(i, f"write to person{i}@host{i % 97}.example.org now\n\n\n{'. ' * 200}\ncall us at 555 1234 today") for i in range(3000)]
    seen, plain = [], pii.symbols
    monkeypatch.setattr(pii, "symbols", lambda window: seen.append(window) or plain(window))
    monkeypatch.setattr(pii.Tagger, "train", lambda self, x, y: self)
    pii.train_tagger(spark.createDataFrame(docs, "doc_id long, text string"), train_windows=400)
    own = seen[:400]
    assert len(set(own)) == 400
