"""Line dedup against brute force."""

import random
import re

import pytest

from millrace.llm import line_dedup as L
from millrace.llm.components import components
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edit(r, s, alphabet="abé😀 "):
    p = r.randrange(len(s) + 1)
    return r.choice([s[:p] + r.choice(alphabet) + s[p:], s[:p] + s[p + 1 :], s[:p] + r.choice(alphabet) + s[p + 1 :]])


def test_automaton(spark):
    r = random.Random(1)
    pairs = [("", ""), ("", "a"), ("a", ""), ("ab", ""), ("ab", "ba"), ("😀", "é")]
    for _ in range(400):
        a = "".join(r.choice("abé😀") for _ in range(r.randrange(12)))
        b = a
        for _ in range(r.randrange(4)):
            b = edit(r, b) if b else "a"
        pairs.append((a, b))
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, x string, y string")
    for column in (L.within_one_edit(F.col("x"), F.col("y")), L.near(F.col("x"), F.col("y"))):
        for row in df.select("k", column.alias("v")).collect():
            assert row.v == (distance(*pairs[row.k]) <= 1), pairs[row.k]


def corpus(seed, lines=120):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randrange(20, 40))) for _ in range(8)]
    out = []
    for _ in range(lines):
        s = r.choice(base)
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            s = edit(r, s, "abcdé ")
        out.append(s)
    # A template: many lines share their first half and differ in pairs only.
    out += [f"common beginning of many lines, number {i:05d}" for i in range(0, 500, 11)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_connect_what_brute_force_connects(spark, seed):
    lines = [s for s in corpus(seed) if len(s) >= L.MIN_CHARS]
    docs = spark.createDataFrame([(i, s, "x") for i, s in enumerate(lines)], "doc_id long, text string, line string")
    table = L.indexed(L._long_lines(docs, "doc_id", "text")).checkpoint()
    hashes = dict(table.join(docs, table.id == docs.doc_id).select("text", "h").distinct().collect())
    roots = dict(components(L.links(docs, table), "a", "b").collect())
    distinct = sorted(hashes)
    group = {s: s for s in distinct}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1:
                group[find(b)] = find(a)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            ra, rb = (roots.get(hashes[s], hashes[s]) for s in (a, b))
            assert (ra == rb) == (find(a) == find(b)), (a, b)


def test_thinning(spark):
    common, near = "this line is in every document", "this line is in every dokument"
    rows = [(i, f"{common}\nown line number {i} {'x' * i}\nshort" if i < 8 else f"{near}\nshort\nshort", "a") for i in range(9)]
    twice = "a long line that stands twice here"
    rows += [(20, f"{twice}\nb\n{twice}\nb", "b"), (20, f"{twice}\nb\n{twice}\nb", "b"), (30, "", "c"), (31, None, "d"), (None, f"{common}\n{common}", "e"), (32, "\n\n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    got = {(r.doc_id, r.gone): r for r in L.deduplicate(docs, report=True).collect()}
    assert got[0, "a"].text.startswith(common) and got[0, "a"].n_near == 1
    assert got[3, "a"].text == "own line number 3 xxx\nshort"
    assert got[8, "a"].text == "short\nshort"
    assert got[20, "b"].text == f"{twice}\nb\nb"
    assert got[30, "c"].text == "" and got[31, "d"].text is None and got[32, None].text == "\n\n"
    assert got[None, "e"].text == common
    assert L.deduplicate(docs).count() == len(rows) and L.deduplicate(docs).columns == docs.columns
    assert L.deduplicate(docs.limit(0)).count() == 0


def test_names_and_ids_of_any_kind(spark):
    common = "this line is in every document"
    rows = [(f"d{i}", f"{common}\nown line number {i} {'x' * i}") for i in range(9)]
    extra = ["line_id", "line_gone", "line_near", "line_bucket", "line_bucket_", "id", "pos", "line", "h", "b", "gone", "key", "hub"]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", *[f"{n} as {c}" for n, c in enumerate(extra)])
    out = L.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r.text.count(common) for r in out.collect()) == [0] * 8 + [1]
    assert {r.doc_id for r in out.collect()} == {r[0] for r in rows}


def test_passages(spark):
    r = random.Random(5)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, other, short = say(60), say(50), say(49)
    near = passage[:-1] + "z"
    whole = "\n".join([say(55), passage, say(40), say(40)])
    # 2 is a near copy of 1 (one word changed) and is left whole; 3 to 5 only share lines with it.
    copy = whole.replace(whole.split("\n")[2], whole.split("\n")[2].replace(whole.split("\n")[2].split(" ")[3], "zzzzz"))
    own = {i: say(70) for i in range(3, 8)}
    rows = [(1, whole), (2, copy), (3, f"{own[3]}\n{passage}"), (4, f"{near}\n{own[4]}"), (5, f"{own[5]}\n{other}\n{short}"), (6, f"{other}\n{own[6]}\n{short}\n{other}"), (7, f"{own[7]}\n{other[:-5]}")]
    rows += [(None, f"{own[7]}\n{passage}"), (3, ""), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(i, t) for i, t in L.deduplicate(docs).collect()}
    want = {(1, whole), (2, copy), (3, own[3]), (3, ""), (4, own[4]), (5, rows[4][1]), (6, f"{own[6]}\n{short}"), rows[6], rows[7], (8, None), (9, "")}
    assert got == want


def test_near_copies_against_brute_force(spark):
    r = random.Random(9)
    base = [[str(r.randrange(300)) for _ in range(r.choice([3, 5, 60, 200]))] for _ in range(6)]
    texts = []
    for i in range(40):
        w = list(base[i % 6])
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = "x"
        texts.append(r.choice([" ", "\n", " \t\n"]).join(w))
    texts += ["", ""]

    def windows(t):
        w = re.split("[ \t\r\n]+", t)
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    sets = [windows(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = set(map(tuple, L.near_copies(docs, spark.createDataFrame(pairs, "id long, first_id long")).collect()))
    assert got == {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} and got


def test_texts_are_split_once(spark):
    docs = spark.createDataFrame([(i, f"a line that is in every document\nown line number {i}") for i in range(9)], "doc_id long, text string")
    plan = L.deduplicate(docs, report=True)._jdf.queryExecution().optimizedPlan().toString()
    # Once for the documents with marks, once for those without, however many columns are made of the lines.
    assert len(re.findall(r"split\(text", plan)) == 2


def test_passage_pattern(spark):
    r = random.Random(3)
    lines = ["".join(r.choice(["", " ", "\t\r "]) for _ in range(1)) + "".join(r.choice("ab,") * r.randrange(1, 4) + r.choice([" ", "\t", " \r", "  "]) for _ in range(n)) + r.choice(["", "z"]) for n in range(30, 60) for _ in range(8)]
    lines += ["", " ", "x" * 500, " " * 500, " ".join("x" * 60)]
    docs = spark.createDataFrame(list(enumerate(lines)), "id long, line string").selectExpr("id", "0 as pos", "line", "xxhash64(line) as h")
    got = {x.id: x.passage for x in L.indexed(docs).collect()}
    assert got == {i: len(re.split("[ \t\r\n]+", s)) >= L.PASSAGE_WORDS for i, s in enumerate(lines)} and 8 < sum(got.values()) < len(lines)
