"""Operators that look at one text at a time, against plain patterns and the tokenizers library."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe, decontaminate, pii, secret_scan, token_counts, toxicity, wordhash

SCHEMA = "doc_id long, text string, source string, spans string, ids int"


def table(spark, texts):
    """Texts with ids, a repeated row, a null id, and columns whose names clash with results."""
    rows = [(i, t, f"s{i % 3}", "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, texts[0], None, None, None)], SCHEMA), [*texts, texts[0], texts[0]]


ODD = ["", None, " ", "\n\n", "é", "日本語 😀 text", "a" * 5000, "word " * 3000, "x\x1cy\x85z\xa0w", "don't I'll  we've", "<|endoftext|>a<|startoftext|> <|endoftext|>"]


def by_id(df):
    out = {}
    for r in df.collect():
        assert out.setdefault(r.doc_id, r) == r
    return out


# -- tokenizers ---------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_encoding_equals_the_library(seed):
    r = random.Random(seed)
    path = public_tokenizers.path("byte_bpe_50k.json")
    parts = ["the", "ing", "er", "tion", "a", " and", "==", "--", "00", "é", "日", "😀", "\n", "  ", "'s", "<|endoftext|>", "aaaa"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(1500)]
    library = Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    coder = bpe.Encoder(open(path).read())
    for text, ids, packed in zip(texts, want, coder.encode_many(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert coder.decode(packed) == library.decode(ids, skip_special_tokens=False) == text


def test_decoding_of_broken_bytes():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, coder = Tokenizer.from_file(path), bpe.Encoder(open(path).read())
    for ids in ([200], [220, 200, 64], [50256, 3, 201, 50256]):
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs, texts = table(spark, ODD)
    got = by_id(bpe.encode_decode(docs, path))
    library = Tokenizer.from_file(path)
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[i]
        assert (r.n_tokens, list(r.ids), r.decoded) == (len(ids), ids, t or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(docs, path).count() == len(texts)
    assert bpe.encode_decode(docs.limit(0), path).count() == 0


def test_bpe_workers_keep_no_encoder(spark):
    docs = spark.range(8).selectExpr("id as doc_id", "'some text' as text").repartition(8)
    bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()

    def held(batches):
        import gc

        for b in batches:  # one row: 8 tasks in the same workers
            yield b.assign(text=str(sum(isinstance(x, (bpe.Encoder, bpe.Vocabulary)) for x in gc.get_objects())))

    assert {r.text for r in docs.mapInPandas(held, "doc_id long, text string").collect()} == {"0"}


def test_memo_limits_do_not_change_results(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"word{i} other{i % 7} é{i}" for i in range(300)]
    want = list(bpe.Encoder(open(path).read()).encode_many(texts))
    monkeypatch.setattr(bpe, "MEMO_BYTES", 2000)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 50)
    assert list(bpe.Encoder(open(path).read()).encode_many(texts)) == want


def test_token_counts(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*ODD, "Ångström ΣΑΣ ﬁ İ \u0301x", "a " * 2049, "a " * 2048]
    docs, all_texts = table(spark, texts)
    got = by_id(token_counts.count_tokens(docs, path))
    library = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert token_counts.count_tokens(docs, path).count() == len(all_texts)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 300)
    monkeypatch.setattr(token_counts, "GROUP_BYTES", 40)
    counter = token_counts.Counter(open(path).read())
    assert counter.split and counter.count(texts) == [got[i].n_tokens for i in range(len(texts))]
    whole = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    counter = token_counts.Counter(whole)
    assert not counter.split and counter.count(texts) == [len(Tokenizer.from_str(whole).encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert list(token_counts.byte_balanced(["aa", "b", "cccc", "d"], 3)) == [["aa", "b"], ["cccc"], ["d"]]


# -- spans ----------------------------------------------------------------------

PIECES = ["a", "b1", "@", ".", "-", " ", "\n", "user.name@mail.example.com", "x@y", "1", "22", "333", ".4", "+", "+49 (30) 1234-5678", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "300.1.1.1", "1.2.3.4.5", "é", "password", ":", "=", "\"", "secret", "API_KEY", "token= abcdefgh12", "AKIA", "AKIAABCDEFGH1234", "deadbeef", "0123456789abcdef" * 2, "DE89370400440532013000", "ghp_" + "a1" * 18]


def generated(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randrange(14))) for _ in range(n)]


def plain_pii(t):
    out = []
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = digits(m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_pii_equals_plain_patterns(spark):
    texts = [*ODD, "a@b.c@d.e", "x..@-.a", "@a.b", "IBAN: DE89 3704 0044 0532 0130 00 ok", "IBAN DE89370400440532013001", "call +49 30 1234567", *generated(5)]
    docs, _ = table(spark, texts)
    got = by_id(pii.digest(pii.scan(docs)))
    for i, t in enumerate(texts):
        want = plain_pii(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i].spans)
        for k in pii.BASE:
            assert got[i][f"n_{k}"] == len(re.findall(rf"\b{k}:", want))
    assert "iban:6:33" in got[texts.index("IBAN: DE89 3704 0044 0532 0130 00 ok")].spans
    assert "iban" not in got[texts.index("IBAN DE89370400440532013001")].spans
    assert pii.score("please call +49 30 1234567", 12, "phone") > pii.score("value +49 30 1234567", 6, "phone")
    assert pii.scan(docs.limit(0)).count() == 0


def test_long_texts_stay_linear():
    import time

    began = time.time()
    for t in ("1" * 300_000, "1." * 150_000, "a" * 300_000, "a@" * 150_000, "+1" * 150_000, "A" * 300_000):
        pii.find(t)
    assert time.time() - began < 20


def plain_secrets(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 16:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", t):
        if len(m[0]) >= 32:
            out.append((m.start(), 2, m.end(), "hex"))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_secrets_equal_plain_patterns(spark):
    texts = [*ODD, "password: token: abcdefghijk", "Password='hunter2hunter2' secret", "😀 token=abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", *generated(7)]
    docs, all_texts = table(spark, texts)
    full = secret_scan.digest(secret_scan.scan(docs))
    got = by_id(full)
    for i, t in enumerate(texts):
        want = plain_secrets(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i].spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(want.count(f"{k}:") for k in ("assign", "access", "hex"))
    assert "pem:0:31" in got[texts.index("-----BEGIN RSA PRIVATE KEY-----")].spans
    assert full.count() == len(all_texts)
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_ownership(spark):
    rows = [(i, "token=sharedsecret1", f"owner{i % 4}") for i in range(8)] + [(20, "token=mineonly12345", "me"), (21, "token=mineonly12345", "me"), (22, "password=changeme99", None), (23, "token=mineonly12345 token=sharedsecret1", "me")]
    got = by_id(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    standing = {i: (r.n_shared, r.n_owner_specific, r.n_owners, r.n_repos) for i, r in got.items()}
    assert standing[0] == (1, 0, 5, 9) and standing[20] == (0, 1, 1, 3) and standing[22] == (1, 0, 1, 1) and standing[23] == (1, 1, 5, 9)
    many = [(i, "token=copiedbyoneowner", "one") for i in range(secret_scan.WIDE_REPOS)]
    assert {(r.n_shared, r.n_owner_specific) for r in secret_scan.scan(spark.createDataFrame(many, "doc_id long, text string, source string")).collect()} == {(1, 0)}


def test_many_secrets_in_one_text(spark):
    import time

    text = " ".join(f"token=abcdefgh{i:06d}" for i in range(100_000))
    began = time.time()
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    spans = secret_scan.candidates(docs).select("spans.start", "spans.end").first()
    assert list(spans["start"]) == [21 * i for i in range(100_000)] and list(spans["end"])[-1] == len(text)
    assert time.time() - began < 60


# -- words, templates, grammar -----------------------------------------------------


def test_words_of_any_cut(monkeypatch):
    r = random.Random(3)
    texts = ["", "Été ÉTÉ", None, "one two " * 400, "..."] + ["".join(r.choice("ab Cé.\n😀") for _ in range(r.randrange(60))) for _ in range(300)]
    whole = [(h.tolist(), c.tolist(), a, b) for h, c, a, b in wordhash.grouped(texts)]
    flat = [h[c[k] : c[k + 1]] for h, c, a, b in whole for k in range(b - a)]
    monkeypatch.setattr(wordhash, "BLOCK_BYTES", 70_000)
    cut = [h[c[k] : c[k + 1]].tolist() for h, c, a, b in wordhash.grouped(texts) for k in range(b - a)]
    assert flat == cut and len(flat) == len(texts)
    fold = lambda t: ["".join(chr(ord(x) + 32) if "A" <= x <= "Z" or ("À" <= x <= "Þ" and x != "×") else x for x in w) for w in re.findall(r"(?:\w|[^\x00-\x7f])+", t or "")]
    names = {}
    for t, hs in zip(texts, flat, strict=True):
        words = fold(t)
        assert len(words) == len(hs)
        for w, h in zip(words, hs, strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_templates(spark):
    item = "Tom bought 12 apples and paid 3 dollars to Anna, then Tom gave 12 apples to Bob in the park."
    items = spark.createDataFrame([(1, item), (2, None), (None, "x"), (3, ""), (4, "only three words"), (5, item)], "item_id long, text string")
    texts = [
        f"We know: {item} Yes.",
        "Jim bought 99 apples and paid 7 dollars to Lisa, then Jim gave 99 apples to Carl in the park.",
        "Jim bought 99 apples and paid 7 dollars to Lisa, then Zed gave 55 apples to Carl in the park.",
        item.upper().replace(" ", "  "),
        "nothing of the kind stands in this text at all",
        "only three words",
        "",
        None,
        "filler " * 50_000 + item,
    ]
    docs, all_texts = table(spark, texts)
    got = by_id(decontaminate.flagged(docs, items))
    assert [got[i].item_ids for i in range(len(texts))] == [[1, 5], [1, 5], [], [1, 5], [], [4], [], [], [1, 5]]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 4, 6, 7}
    assert decontaminate.clean(docs, items.limit(0)).count() == len(all_texts)
    assert decontaminate.flagged(docs.limit(0), items).count() == 0


def test_leaks_equal_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(r.choice(words) for _ in range(r.randrange(8, 40))) for _ in range(30)]
    texts = []
    for _ in range(200):
        t = [r.choice(words) for _ in range(r.randrange(5, 120))]
        if r.random() < 0.4:
            part = r.choice(items).split()
            a = r.randrange(max(1, len(part) // 2))
            p = r.randrange(len(t))
            t[p:p] = part[a:] if r.random() < 0.5 else part
        texts.append(" ".join(t))
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = by_id(decontaminate.flagged(docs, bench))
    for d, t in enumerate(texts):
        assert got[d].item_ids == [i for i, x in enumerate(items) if len(grams(x) & grams(t)) >= 0.8 * len(grams(x))]


def test_large_benchmarks_are_joined_by_hash(spark, monkeypatch):
    r = random.Random(8)
    names = ["Anna", "Bob", "Carl", "Dora", "Emil"]
    make = lambda n: f"In task {n} {r.choice(names)} buys {r.randrange(99)} apples for {r.randrange(9)} dollars, kind {n} of question, and asks {r.choice(names)} how much {n} is"
    items = spark.createDataFrame([(i, make(f"q{i % 40}")) for i in range(60)] + [(7, None), (None, "x"), (90, "only three words"), (3, make("q3"))], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"Well. {make(f'q{i % 50}')}. Yes", "x", "y") for i in range(80)] + [(91, "only three words", "", ""), (92, None, "", ""), (93, "", "", ""), (5, "nothing", "", "")], "doc_id long, text string, digest string, found string")
    want = sorted((x.doc_id, x.text or "", [tuple(y) for y in x.contamination]) for x in decontaminate.marked(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    joined = decontaminate.marked(docs, items)
    assert sorted((x.doc_id, x.text or "", [tuple(y) for y in x.contamination]) for x in joined.collect()) == want
    assert joined.columns == [*docs.columns, "contamination"] and sum(bool(w[2]) for w in want) > 20
    assert decontaminate.clean(docs, items).columns == docs.columns


def test_grammar():
    m = toxicity.Machine(toxicity.grammar())
    I, T, N, R, H = toxicity.INSULT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.THREAT  # noqa: E741
    assert m.clause([(0, I, 2.0)]) == 2.0
    assert m.clause([(0, T, 1), (2, I, 2.0)]) == 2.0 * toxicity.AIMED
    assert m.clause([(0, T, 1), (9, I, 2.0)]) == 2.0
    assert m.clause([(0, N, 1), (2, I, 2.0)]) == 2.0 * toxicity.NEGATED
    assert m.clause([(0, R, 1), (7, I, 2.0)]) == 2.0 * toxicity.QUOTED
    assert m.clause([(0, H, 1), (1, T, 1)]) == 1.0
    assert m.clause([(0, H, 1), (5, T, 1)]) == 0.0
    assert m.clause([(0, T, 1), (1, N, 1)]) == 0.0


def plain_evidence(text, words, stems):
    """Sum, maximum and number of matched clauses, by rules over word lists instead of a machine."""
    lists = {w: n for n, ws in enumerate((toxicity.THREATS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS)) for w in ws if re.fullmatch(r"\w+", w)}
    totals = []
    for clause in re.split(r"[.!?;\n]", text or ""):
        total, seen, threat, negated, aimed, reported = 0.0, [], None, None, None, False
        for at, w in enumerate(re.findall(r"\w+", clause.lower())):
            weight = max([words.get(w, 0.0), *(v for s, v in stems.items() if w.startswith(s) and len(w) > len(s))])
            kind = None if weight else lists.get(w)
            if weight or kind == 0:
                factor = toxicity.QUOTED if reported else 1.0
                if negated is not None and at - negated <= 3:
                    factor *= toxicity.NEGATED
                seen.append(at)
            if weight:
                if aimed is not None and at - aimed <= 5:
                    factor *= toxicity.AIMED
                total += weight * factor
            elif kind == 0:
                threat = at
            elif kind == 1:
                if threat is not None and at - threat <= 3:
                    total, threat = total + 1.0, None
                aimed = at
            elif kind == 2:
                negated = at
            elif kind == 3:
                reported = True
        if total:
            totals.append(total)
    return [sum(totals), max(totals, default=0.0), len(totals)]


def test_evidence_equals_plain_rules():
    r = random.Random(12)
    words, stems = {"zorg": 2.0, "blat": 0.7, "idiot": 2.5}, {"vrum": 1.5, "krack": 3.0}
    hashes = lambda d: (np.array([h for h, _ in d]), np.array([w for _, w in d]))
    stem = lambda s: int(next(wordhash.blocks([s + "x"])).prefix(len(s))[0])
    arcs = {0: hashes(sorted((np.uint64(wordhash.hash_of(w)), v) for w, v in words.items()))}
    for s, v in stems.items():
        arcs[len(s)] = hashes([(np.uint64(stem(s)), v)])
    vocabulary = ["zorg", "Zorg", "blat", "vrumm", "vrum", "kracker", "kill", "hurt", "you", "your", "not", "never", "said", "wrote", *[f"f{i}" for i in range(12)], ".", ";", "!", "\n"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(40))) for _ in range(600)] + [None, "", "you kill you kill you"]
    got = toxicity.evidence(texts, toxicity.Model(arcs), toxicity.Machine(toxicity.grammar()))
    for t, x in zip(texts, got, strict=True):
        assert np.allclose(x, plain_evidence(t, words, stems)), (t, x, plain_evidence(t, words, stems))


def test_toxicity_edge_cases(spark):
    texts = [*ODD, "you are an idiot", "not an idiot. fine", "x. " * 3000 + "you moron"]
    docs, all_texts = table(spark, texts)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.scored(docs, none))
    assert got[texts.index("you are an idiot")].predicted == 1 and got[0].predicted == got[1].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[len(texts) - 1].score > got[0].score
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (999, 1)], "doc_id long, toxic int")
    assert toxicity.scored(docs, odd).count() == len(all_texts)
    assert toxicity.clean(docs, none).columns == docs.columns
    assert toxicity.scored(docs.limit(0), none).count() == 0


def test_toxicity_learns_and_holds_out(spark):
    import zlib

    r = random.Random(9)
    filler, slurs = [f"f{i}" for i in range(300)], [f"zorg{c}ul" for c in "abcdefgh"]
    rows, labels = [], []
    for i in range(1500):
        t = [r.choice(filler) for _ in range(r.randrange(5, 80))]
        bad = r.random() < 0.15
        for _ in range(r.randrange(1, 4) if bad else 0):
            t.insert(r.randrange(len(t)), r.choice(slurs))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    out = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out)
    held = [x for x in out if x.held_out]
    assert sum(x.predicted == labels[x.doc_id][1] for x in held) / len(held) > 0.97
