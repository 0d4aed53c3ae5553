"""Near-duplicates, lattice links, nearest neighbours, URL verdicts and fixity on small fixtures."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from celltide.llm import chosen_path, fixity, lattice, permutation_index, url_graph
from celltide.llm.components import components
from celltide.llm.queries import RULES

DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


def groups_by_hand(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    draw = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, draw.randint(200, 400)) for _ in range(80)] + [(3, 3), (900, 901), (901, 900)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == groups_by_hand(pairs, {x for p in pairs for x in p})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near-duplicate documents ------------------------------------------------------------------

def classes_by_hand(rows, size, percent):
    sets, holders, pairs = {}, defaultdict(list), []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        found = {tuple(words[k:k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()
        common = defaultdict(int)
        for s in found:
            for j in holders[s]:
                common[j] += 1
            holders[s].append(i)
        pairs += [(i, j) for j, k in common.items() if 100 * k >= percent * (len(found) + len(sets[j]) - k)]
        sets[i] = found
    groups = groups_by_hand(pairs, sets)
    return {i: (len(sets[i]), groups[i]) for i in sets}


def edited(draw, words, share):
    return [draw.choice("uvwxyz") * draw.randint(3, 9) if draw.random() < share else w for w in words]


def corpus(seed, n_groups, big):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows, passage = [], draw.choices(vocabulary, k=60)
    for g in range(n_groups):
        base = draw.choices(vocabulary, k=draw.randint(3, 120))
        for _ in range(draw.choice([1, 1, 2, 5])):
            rows.append(" ".join(edited(draw, base, draw.choice([0, 0.01, 0.04]))))
    base = draw.choices(vocabulary, k=150)
    rows += [" ".join(edited(draw, base, draw.choice([0.003, 0.01, 0.03, 0.05]))) for _ in range(big)]
    rows += [" ".join(passage + draw.choices(vocabulary, k=40)) for _ in range(80)]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size", [4, 5])
def test_classes_equal_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 16)
    monkeypatch.setattr(chosen_path, "BLOCK", 32)  # the large group and the passage go through dense nodes
    rows = corpus(size, 120, 160)
    want = classes_by_hand(rows, size, 80)
    got = chosen_path.classify(spark.createDataFrame(rows, DOCS), size=size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_pairs_in_crowded_nodes_are_found(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 8)
    monkeypatch.setattr(chosen_path, "BLOCK", 8)
    monkeypatch.setattr(chosen_path, "TREES", (1, 10))  # the first round leaves more to the second
    monkeypatch.setattr(chosen_path, "DEPTH", 1)  # nodes of some hundred documents
    # every document holds the passage; a pair shares 80 of 100 words, other documents 60 of 120
    passage, rows = [f"p{k}" for k in range(60)], []
    for pair in range(150):
        both = [f"b{pair}x{k}" for k in range(20)]
        rows += [(2 * pair + i, " ".join(passage + both + [f"o{pair}x{i}x{k}" for k in range(10)])) for i in range(2)]
    got = {r["doc_id"]: r["component_id"] for r in chosen_path.classify(spark.createDataFrame(rows, DOCS), size=1).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_sets_of_a_large_group_meet_in_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 16)
    monkeypatch.setattr(chosen_path, "BLOCK", 64)
    draw, plain, posted = random.Random(9), chosen_path.find_links, []
    base = [f"w{k}" for k in range(150)]  # copies of it, most of them just below the similarity of a link
    rows = [(i, " ".join(edited(draw, base, 0.035))) for i in range(200)]

    def counted(blocks, *rest):
        posted.append(blocks.count())
        return plain(blocks, *rest)

    monkeypatch.setattr(chosen_path, "find_links", counted)
    got = {r["doc_id"]: r["component_id"] for r in chosen_path.classify(spark.createDataFrame(rows, DOCS), size=4).collect()}
    assert got == {i: c for i, (_, c) in classes_by_hand(rows, 4, 80).items()}
    assert posted[1] < 60 * len(rows)


def test_near_duplicates_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO\n"), (5, "one two"), (None, "one two"), (None, None), (7, "w " * 20000), (8, "w " * 19000), (9, "É"), (10, "é")]
    df = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)).withColumn("component_id", F.lit("q"))
    got = chosen_path.classify(df).select("doc_id", "n_shingles", "component_id").collect()
    assert len(got) == len(rows)
    of = defaultdict(set)
    for r in got:
        of[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert of[1] == {(0, 1)} and of[2] == {(0, 2)} and of[3] == {(0, 3)} and of[4] == of[5] == {(1, 4)}
    assert of[7] == of[8] == {(1, 7)} and of[9] == {(1, 9)} and of[10] == {(1, 10)}
    kept = chosen_path.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 7, 9, 10]
    assert kept.filter("doc_id IS NULL").count() == 2
    assert chosen_path.deduplicate(df.limit(0)).count() == 0


# --- vectors -----------------------------------------------------------------------------------

def clustered(seed, n, d=64, big=150):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for at in range(0, n // 3, 6):
        x[at:at + 6] = x[at] + draw.normal(0, draw.choice([0.004, 0.012, 0.02]), (6, d))
    x[-big:] = x[-1] + draw.normal(0, 0.01, (big, d))
    x[5] = x[4]
    return x.astype(np.float32)


def cosines_by_hand(x):
    x = x.astype(float)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    return x @ x.T


def test_lattice_decoding_is_nearest():
    around, draw = lattice.shortest_e8(), np.random.default_rng(3)
    assert len(around) == 240 and np.allclose((around ** 2).sum(axis=1), 2)
    x = draw.normal(0, 3, (300, 8))
    point = lattice.nearest_e8(x)
    assert np.allclose(lattice.nearest_e8(point), point)
    other = point[:, None, :] + np.concatenate([around, 2 * np.eye(8), -2 * np.eye(8)])
    assert (((x - point) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - other) ** 2).sum(axis=2) + 1e-9).all()


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 40)  # the large group takes several blocks
    x = clustered(1, 700)
    label = [i % 3 if i < 500 else 1 for i in range(700)]
    got = {r["vec_id"]: r for r in lattice.link_vectors(spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, label))], VECTORS)).collect()}
    near = cosines_by_hand(x) >= 0.98
    pairs = [(i, j) for i, j in np.argwhere(near) if i < j and label[i] == label[j]]
    groups, count = groups_by_hand(pairs, range(700)), np.bincount(np.array(pairs).ravel(), minlength=700)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (count[i], groups[i], groups[i] == i) for i in range(700)}


def test_links_edge_cases(spark):
    one, nan = [1.0, 0.0], float("nan")
    rows = [(1, one, 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, one, None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1),
            (7, [nan, 1.0], 1), (8, [float("inf"), 1.0], 1), (None, one, 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (None, [0.0, 1.0], 1), (11, [1e-38, 0.0], 1)]
    got = lattice.link_vectors(spark.createDataFrame(rows, VECTORS).withColumn("cells", F.lit(0))).collect()
    assert len(got) == len(rows)
    of = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert of == {(1, 4, 1, True), (2, 4, 1, False), (None, 4, 1, False), (11, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
                  (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (None, 0, None, False)}
    assert lattice.link_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "SHARD", 400)
    monkeypatch.setattr(permutation_index, "QUERIES", 10)
    x = clustered(2, 1500, big=400)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in permutation_index.nearest_neighbours(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    cosine = cosines_by_hand(x)
    np.fill_diagonal(cosine, -9)
    hits = []
    for q in range(0, 1500, 50):
        best = np.lexsort((np.arange(1500), -cosine[q]))[:5]
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(s - cosine[q, v]) < 1e-12 for _, v, s in got[q]) and [s for *_, s in got[q]] == sorted((s for *_, s in got[q]), reverse=True)
        hits.append(len(set(best) & {v for _, v, _ in got[q]}) / 5)
    assert np.mean(hits) >= 0.9


def test_search_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (100, [0.0, 0.0]), (4, [nan, 1.0]), (None, [1.0, 1.0]), (150, [1.0, None]), (5, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = permutation_index.nearest_neighbours(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 50), (0, 3, 2), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert permutation_index.nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- URL verdicts ---------------------------------------------------------------------------------

def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules_hosts_and_paths(spark):
    urls = {
        "http://EXAMPLE.com/en/x?q#f": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://a.www.example.com/en/y": ("a.www.example.com", "/en/y", "www.example.com/en/", "allow"),
        "x://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://com/": ("com", "/", "com/", "allow"), "x://b.net/fr/": ("b.net", "/fr/", "net/fr/", "block"),
        "http://a.com?u=http://b.net/fr/": ("a.com", "", None, None), "no scheme": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None),
        "a://É.NET/es/://": ("É.net", "/es/://", "net/es/", "block"),
    }
    got = url_graph.judge(pages_of(spark, [(i, u, None) for i, u in enumerate(urls)]).withColumn("host", F.lit("mine")), RULES)
    for r in got.collect():
        host, path, rule, verdict = urls[r["url"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        assert verdict is None or r["verdict"] == verdict
    assert url_graph.judge(pages_of(spark, []), RULES).count() == 0


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    rows = [
        (1, "http://good.org/a", link("friend.info", "friend.info")), (2, "http://friend.info/", link("second.info")), (3, "http://second.info/", None),
        (4, "http://bad.biz/a", ""), (5, "http://accomplice.info/", link("bad.biz")), (6, "http://lonely.info/", link("lonely.info")),
    ]
    rules = [("allow", "good.org", "/"), ("block", "bad.biz", "/")]
    got = {r["page_id"]: r for r in url_graph.judge(pages_of(spark, rows), rules).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow"}
    assert got[2]["trust"] > got[3]["trust"] > 0 == got[6]["trust"] and got[5]["distrust"] > 0 == got[2]["distrust"]


def test_ranks_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    n, raw = 12, []
    weight = (draw.random((n, n)) < 0.3) * draw.random((n, n))
    np.fill_diagonal(weight, 0)
    share = weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-30)
    for i, j in np.argwhere(share > 0):
        raw.append(("trust", f"h{i}", f"h{j}", float(share[i, j])))
    seeds = np.zeros(n)
    seeds[:3] = [0.5, 0.3, 0.2]
    rank = seeds
    for _ in range(url_graph.TURNS):
        rank = (1 - url_graph.DAMPING) * seeds + url_graph.DAMPING * rank @ share
    got = url_graph.spread(spark.createDataFrame(raw, "kind string, src string, dst string, share double"), spark.createDataFrame([("trust", f"h{i}", float(seeds[i])) for i in range(3)], "kind string, host string, score double"))
    for r in got.collect():
        assert abs(r["score"] - rank[int(r["host"][1:])]) < 1e-12


# --- fixity -----------------------------------------------------------------------------------------

def test_audit_finds_all_damage(spark):
    draw, rows = random.Random(9), []
    for f in range(6):
        at = 0
        for i in range(60):
            size = draw.randint(1, 900)
            rows.append((f"file{f}" if f else None, at, size, f"d{f}-{i}"))
            at += size
    other, want = [], set()
    for file, at, size, digest in rows:
        what = draw.random() if file in ("file2", "file4", None) else 1
        if what < 0.02:
            want.add((file, at, "missing in b"))
        elif what < 0.05:
            other.append((file, at, size, digest + "!"))
            want.add((file, at, "differs"))
        else:
            other.append((file, at, size, digest))
    other.append(("new", 0, 3, "x"))
    want.add(("new", 0, "missing in a"))
    other.append(("file5", 0, rows[-60][2], rows[-60][3]))  # a repeated record
    want.add(("file5", 0, "differs"))
    schema = "file string, offset long, length long, digest string"
    a, b = (fixity.leaves(spark.createDataFrame(r, schema)) for r in (rows, other))
    got = fixity.damaged(a, b, range_bytes=512, fan_bits=2).collect()
    assert {(r["file"], r["offset"], r["status"]) for r in got} == want and len(got) == len(want)
    empty = spark.createDataFrame([], schema)
    assert fixity.damaged(a, a).count() == 0 and fixity.damaged(empty, empty).count() == 0
    assert fixity.damaged(a, fixity.leaves(empty)).count() == len(rows)


def test_only_differing_branches_are_descended(spark):
    schema = "file string, offset long, length long, digest string"
    rows = [("f", i * 100, 100, f"d{i}") for i in range(256)]
    a = fixity.leaves(spark.createDataFrame(rows, schema))
    b = fixity.leaves(spark.createDataFrame([(f, o, n, "!" if o == 12300 else d) for f, o, n, d in rows], schema))
    levels = [fixity.tree(x, range_bytes=100, fan_bits=2) for x in (a, b)]
    assert [x.count() for x in levels[0]] == [256, 64, 16, 4, 1]
    for x, y in zip(*levels):
        assert x.join(y, ["file", "node", "hash"], "left_anti").count() == 1


def test_packing_and_record_bytes(spark):
    df = spark.createDataFrame([(1, "http://a/", "é"), (2, None, None)], "page_id long, url string, html string")
    record = df.select("page_id", fixity.record_bytes(F.col("url"), F.col("html")).alias("b")).orderBy("page_id").collect()
    assert bytes(record[0]["b"]) == "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://a/\r\nContent-Length: 2\r\n\r\né\r\n\r\n".encode()
    packed = fixity.pack(spark.createDataFrame([("f", i, 10 * i) for i in range(4)], "file string, page_id long, length long"), ["page_id"])
    assert [r["offset"] for r in packed.orderBy("page_id").collect()] == [0, 0, 10, 30]


def test_pivots_beside_many_copies_of_one_vector(spark):
    draw = np.random.default_rng(9)
    rows = [(i, draw.normal(size=8).tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS)
    least = df.orderBy(F.xxhash64("embedding")).select("embedding").first()["embedding"]
    copies = spark.createDataFrame([(1000 + i, least, 0) for i in range(600)], VECTORS)
    alone, beside = permutation_index.pick_pivots(df), permutation_index.pick_pivots(df.unionByName(copies))
    assert len(beside) == permutation_index.PIVOTS and np.array_equal(alone, beside)
