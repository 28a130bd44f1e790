"""Operators that compare rows with one another, against brute force."""

import os
import random

import numpy as np
import pytest

from millrace.llm import embedding_dedup, order_minhash, url_filter
from millrace.llm.components import components

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("local", [None, 1 << 19, 60])
def test_components(spark, monkeypatch, local):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 30)] + [(5, 5)]
    group = {}

    def find(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        group[y] = x
    monkeypatch.setattr("millrace.llm.components.LOCAL_EDGES", local or 0)
    got = dict(map(tuple, components(spark.createDataFrame([*edges, (None, 1), (2, None)], "x long, y long").repartition(8), "x", "y", bool(local)).collect()))
    for n in group:
        assert got.get(n, n) == find(n)
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y", bool(local)).count() == 0


# -- URL filters -----------------------------------------------------------------

RULES = [url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"), url_filter.Rule("block", "b.example.com"), url_filter.Rule("allow", "net", "/de/")]


def plain(url, hosts):
    import re

    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    listed = any(host == h or host.endswith("." + h) for h in hosts)
    return host, path, best.key if best else None, best.verdict if best else "block" if listed else "allow"


def test_urls(spark):
    r = random.Random(4)
    urls = [None, "", "no scheme", "://", "http://", "http://COM", "http://com/en/", "http://a.B.Example.com/en/77?x#y", "http://xcom/en/", "http://.com/en/x", "HTTP://É.net/de/é", "http://a?b/c", "http://a#b", "x://y://z.com/en/", "http://" + "a." * 3000 + "com/en/" + "p" * 5000, "http://bad.org/", "http://x.bad.org", "http://notbad.org"]
    urls += ["http://" + ".".join(r.choice(["a", "b", "example", "com", "net", "bad", "org"]) for _ in range(r.randrange(1, 5))) + r.choice(["", "/", "/en/", "/en/7", "/de/1", "/fr"]) for _ in range(600)]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(0, None, "y"), (None, urls[6], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.judge(pages, RULES, ["bad.org", "Bad.com"]).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.page_id is not None:
            assert (x.host, x.path, x.rule, x.verdict) == plain(urls[x.page_id], ["bad.org", "bad.com"]), urls[x.page_id]
    assert url_filter.judge(pages.limit(0), RULES, []).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = [f"key{i}" for i in range(4000)]
    listed = universe[::7] + ["outside"]
    frame = spark.createDataFrame([(k,) for k in universe], "key string")
    levels = url_filter.build_cascades(spark, frame, [listed, []], len(universe))
    h = frame.select("key", *[c.alias(f"h{n}") for n, c in enumerate(url_filter._hashes(frame["key"]))]).toPandas()
    inside = url_filter.listed(levels[0], h["h0"].to_numpy(), h["h1"].to_numpy())
    assert set(h["key"][inside]) == set(listed) - {"outside"}
    assert not url_filter.listed(levels[1], h["h0"].to_numpy(), h["h1"].to_numpy()).any()
    # Far too many false positives at level 0 make it be built anew.
    again = url_filter.build_cascades(spark, frame, [["key1"]], 1)
    assert url_filter.listed(again[0], h["h0"].to_numpy(), h["h1"].to_numpy()).sum() == 1


# -- embeddings ---------------------------------------------------------------------


def brute_links(rows):
    ok = [i for i, (v, e, label) in enumerate(rows) if v is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a].add(b)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 256), (2, 2)])
def test_embeddings_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(seed)
    rows = []
    centres = r.normal(size=(12, 16))
    for i in range(260):
        c = centres[i % 12] + r.normal(size=16) * r.choice([0.02, 0.08, 0.15, 1.0])
        rows.append((i, [float(np.float32(x)) for x in c], int(i % 3)))
    rows += [(300 + k, rows[0][1], rows[0][2]) for k in range(40)] + [(400, [2 * x for x in rows[1][1]], rows[1][2])]
    nan, inf = float("nan"), float("inf")
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [nan] * 16, 1), (504, [inf] + [1.0] * 15, 1), (505, [None] + [1.0] * 15, 1), (506, rows[0][1], None), (None, rows[0][1], rows[0][2]), (507, [1.0], 1), (508, [2.0], 1), (509, [-1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as cell", "2 as cid")
    got = embedding_dedup.link(frame).collect()
    assert len(got) == len(rows)
    want = {v: w for (v, _, _), w in zip(rows, brute_links(rows), strict=True)}
    for x in got:
        if x.vec_id is not None:
            assert (x.n_links, x.component_id) == want[x.vec_id], x
            assert x.kept == (x.vec_id == x.component_id)
    assert embedding_dedup.link(frame.limit(0)).count() == 0
    assert [tuple(x) for x in embedding_dedup.link(frame.where("vec_id = 5")).collect()] == [(5, 0, 5, True)]


def test_embeddings_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    r = np.random.default_rng(3)
    base = r.normal(size=8)
    rows = [(i, (base + r.normal(size=8) * 0.01).tolist(), 1) for i in range(90)] + [(100 + i, r.normal(size=8).tolist(), 1) for i in range(60)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[v] for v, _, _ in rows] == brute_links(rows)


def test_embeddings_in_many_files(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 600)
    monkeypatch.setattr(embedding_dedup, "FILE_BLOCKS", 2)
    monkeypatch.setattr(embedding_dedup, "CELLS", 40)
    monkeypatch.setattr(embedding_dedup, "SMALL", 6)
    r = np.random.default_rng(11)
    base = r.normal(size=(4, 6))
    rows = [(i, (base[i % 4] + r.normal(size=6) * r.choice([0.01, 0.06, 0.12])).tolist(), "xyz"[i % 9 % 3]) for i in range(240)] + [(300 + i, r.normal(size=4).tolist(), "x") for i in range(20)]
    rows += [(400 + i, rows[0][1], "x") for i in range(30)] + [(500 + i, [1.0, 0.001 * i], f"own{i // 3}") for i in range(60)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)).collect()}
    assert [got[v] for v, _, _ in rows] == brute_links(rows)


def test_embeddings_are_not_copied_by_visit(spark):
    r = np.random.default_rng(12)
    x = r.normal(size=(4000, 64)).astype(np.float32)
    x[1::50] = x[::50] + 0.01
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(stages.apply(n).stageId(), stages.apply(n).attemptId()): stages.apply(n).shuffleWriteBytes() for n in range(stages.size())}

    before = shuffled()
    got = embedding_dedup.link(frame).collect()
    assert sum(x.n_links for x in got) == 160
    after = shuffled()
    written = sum(v for k, v in after.items() if k not in before)
    assert 0 < written < 4 * x.nbytes


def test_multi_sequence_visits():
    r = np.random.default_rng(5)
    for _ in range(200):
        a, b = r.random(r.integers(1, 12)), r.random(r.integers(1, 12))
        a[r.integers(len(a))] = b[r.integers(len(b))] = 0
        got = embedding_dedup.visits(a, b, 0.6)
        every = (a[:, None] + b[None, :]).ravel()
        assert sorted(got) == np.flatnonzero(every <= 0.6).tolist() and (np.diff(every[got]) >= 0).all()
    # Codebooks of the smallest size leave most cells of clustered vectors unvisited.
    x = embedding_dedup._unit(r.normal(size=(40, 64))[r.integers(40, size=2000)] + r.normal(size=(2000, 64)) * 0.1)
    words = [embedding_dedup._codebook(h, embedding_dedup.MIN_CODEWORDS) for h in (x[:, :32], x[:, 32:])]
    low = [embedding_dedup._bounds(h, w)[1] for h, w in zip((x[:, :32], x[:, 32:]), words, strict=True)]
    assert np.mean([len(embedding_dedup.visits(p, q, 0.04)) for p, q in zip(*low, strict=True)]) < 0.5 * len(words[0]) * len(words[1])


# -- near-duplicates ------------------------------------------------------------------


def grams(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def near_corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(600)]
    out = []
    passage = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randrange(60, 300))]
        if r.random() < 0.5:
            base = base[:40] + passage + base[40:]
        for _ in range(r.randrange(2, 9)):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 9])):
                p = r.randrange(len(w))
                w[p : p + r.choice([0, 1])] = [r.choice(vocabulary)] * r.choice([0, 1])
            out.append(w)
    hub = [r.choice(vocabulary) for _ in range(200)]
    for i in range(60):  # one large group around a text
        w = list(hub)
        for _ in range(2):
            w[r.randrange(len(w))] = f"own{i}x{r.randrange(9)}"
        out.append(w)
    out.append(hub)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    texts = near_corpus(seed)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(900, ""), (901, None), (902, "..."), (903, "one two"), (904, "One, TWO!"), (905, "two one"), (906, "a " * 20_000), (907, "a " * 20_000), (0, " ".join(texts[0])), (None, " ".join(texts[0]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as id", "'y' as node", "1 as near", "2 as digest", "3 as bucket", "4 as other", "5 as root", "6 as cid")
    got = {}
    result = order_minhash.classes(docs).collect()
    assert len(result) == len(rows)
    for x in result:
        assert got.setdefault(x.doc_id, x.class_id) == x.class_id
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    all_grams = [grams(w) for w in texts]
    for a in range(len(texts)):
        for b in range(a):
            both = len(all_grams[a] & all_grams[b])
            if both / (len(all_grams[a]) + len(all_grams[b]) - both) >= 0.8:
                x, y = sorted((find(a), find(b)))
                group[y] = x
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert got[900] == got[901] == got[902] == 900 and got[903] == got[904] == 903 and got[905] == 905 and got[906] == got[907] == 906 and got[None] == got[0]
    kept = order_minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(x.doc_id for x in kept.where("doc_id is not null").collect())
    assert ids == sorted({v for k, v in got.items() if k is not None and v == k}) and kept.where("doc_id is null").count() == 1
    assert order_minhash.classes(docs.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [("b", one), ("b", two), ("a", one + " more"), (None, one), ("c", two), ("c", two), ("d", two), ("d", two), ("A", "alone here"), ("A", "alone here")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((x.doc_id or "", x.text) for x in order_minhash.deduplicate(docs).collect())
    assert got == sorted([("", one), ("a", one + " more"), ("b", two), ("A", "alone here")])
    assert sorted((x.doc_id or "", x.class_id, x.n_copies) for x in order_minhash.classes(docs).collect()) == sorted([("b", "a", 2), ("b", "b", 5), ("a", "a", 1), ("", "a", 2), ("c", "b", 5), ("c", "b", 5), ("d", "b", 5), ("d", "b", 5), ("A", "A", 2), ("A", "A", 2)])


def letters(seed, many, words=200, slots=12, values=4):
    """Form letters: one template, the values of its slots shared by many of them."""
    r = random.Random(seed)
    base = [f"t{r.randrange(9_000)}" for _ in range(words)]
    out = set()
    while len(out) < many:
        w = list(base)
        for n in range(slots):
            w[(2 * n + 1) * words // (2 * slots)] = f"slot{n}v{r.randrange(values)}"
        out.add(tuple(w))
    return sorted(out)


@pytest.mark.parametrize("rows", [256, 40])
def test_form_letters_keep_all_links(spark, monkeypatch, rows):
    monkeypatch.setattr(order_minhash, "BLOCK_ROWS", rows)
    texts = letters(3, 600)
    got = {x.doc_id: x.class_id for x in order_minhash.classes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()}
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    all_grams = [grams(w) for w in texts]
    links = 0
    for a in range(len(texts)):
        for b in range(a):
            both = len(all_grams[a] & all_grams[b])
            if both / (len(all_grams[a]) + len(all_grams[b]) - both) >= 0.8:
                links += 1
                x, y = sorted((find(a), find(b)))
                group[y] = x
    assert links > 300 and [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def test_alignment_similarity():
    r = random.Random(6)
    for _ in range(300):
        a = [r.randrange(1, 1 << 31) for _ in range(r.randrange(5, 120))]
        b = list(a)
        for _ in range(r.randrange(5)):
            p = r.randrange(len(b))
            b[p : p + r.choice([0, 1, 2])] = [r.randrange(1, 1 << 31)] * r.choice([0, 1])
        if len(b) < 5:
            continue
        ga, gb = grams(a), grams(b)
        want = len(ga & gb) / len(ga | gb)
        got = order_minhash.compare(np.array(a, np.uint32), np.array(b, np.uint32))
        assert abs(got - want) < 1e-9 if want >= 0.8 else got < 0.8
    x = list(range(1, 101))
    assert order_minhash.compare(np.array(x, np.uint32), np.array(x[50:] + x[:50], np.uint32)) < 0.8


# -- the pipeline ------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
            assert set(after) <= set(before)
            if name == "line_dedup":
                assert set(after) == set(before)
            else:
                assert all(before[k] == t for k, t in after.items())
            before = after
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in docs.collect()}
    assert got == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in before.items()}
    assert corpus_pipeline.run(spark, DATA).count() == len(got)
