"""Line dedup by a segment-partition edit join; DataFrame functions only.

Lines within one edit (threshold 1) are linked.  One edit leaves one of
threshold + 1 = 2 segments whole: of two lines whose lengths are ``2m`` to
``2m + 2`` and differ by one at most, the first ``m`` or the last ``m``
characters agree.  Each line is therefore indexed by the hashes of its first
and last ``m = length div 2`` characters (with ``m`` and the side), and lines of even length
probe with ``m - 1`` as well, for the lines one character shorter.

A bucket is compared with its hub only, the line of the smallest hash.  Where that leaves
a line unlinked, everything but the hub is cut again: what is still open
between the agreed beginning and end is halved, and one edit again leaves one
half whole.  The open part halves with each level, so after some ten levels
every link is found, without ever forming the pairs of a bucket.

A pair is verified by narrowing to where it differs (an open half that agrees is dropped,
``NARROW`` times; if neither agrees the pair is no link) and a banded
bit-parallel automaton over the rest: for 0 and 1 errors a word of three
bits, one for each diagonal of the band.

Links are closed to classes.  Lines of at least ``MIN_CHARS`` characters whose
class occurs in more than ``MAX_DOCS`` documents are boilerplate: only the
first occurrence (smallest document id, then place) stays.  Passages, lines of
at least ``PASSAGE_WORDS`` words, are thinned from the second document on, but not
in a document that is a near copy of the one with the first occurrence (``SIMILAR`` of
their windows of ``WINDOW`` words agree): a whole copy is left to near-dedup, which
could not tell it from what would remain.  Within a document
the exact repeats of such a long line are dropped in any case.

What is shuffled is small: hashes of lines and halves (fixed width, combined
where they are read), and texts only of lines that share a half with another line, and of
documents that change.  Which those may be is broadcast as a set of at most
hash buckets of a fixed number (see ``slim``).

Cases: a null text stays null and has no lines; an empty text has one empty
line; shorter lines are always kept; a document with a null id takes part
only in the repeats within itself; rows with the same id count as one document, so
they lose the same lines; a document never disappears, though its text may
become empty; ids may be of any type that has an order; all columns of the input are kept, whatever their names (``report`` needs its own three free); ties go to the smaller id and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import slim
from millrace.llm.components import components
from millrace.llm.ship import release, shared_folder

MIN_CHARS = 20
MAX_DOCS = 6
PASSAGE_WORDS = 50
WINDOW = 5
SIMILAR = 0.8
NARROW = 4
SHORT = 3
#: At least ``PASSAGE_WORDS`` words: one more than the gaps between them.  Counted without making the words, and only as far as that.
_PASSAGE = rf"^[^ \t\r\n]*+(?:[ \t\r\n]++[^ \t\r\n]++){{{PASSAGE_WORDS - 2}}}[ \t\r\n]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(text: Column) -> Column:
    return F.split(text, "[ \t\r\n]+", -1)


def _left(s: Column, n: Column) -> Column:
    return F.substring(s, F.lit(1), n)


def _right(s: Column, n: Column) -> Column:
    return F.when(n > 0, F.substring(s, F.length(s) - n + 1, n)).otherwise(F.lit(""))


def within_one_edit(x: Column, y: Column) -> Column:
    """True iff the edit distance of two strings is at most one.

    Bit ``d`` of a state stands for the diagonal that is ``d - 1`` places
    ahead in ``y``.  Reading a character of ``x``: agreement keeps the bit, a
    replacement takes one more error on the same diagonal, a deletion moves
    to the diagonal below, an insertion to the one above.
    """
    chars = F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    other = F.regexp_extract_all(y, F.lit("(?s)."), F.lit(0))
    start = F.struct(F.lit(0).alias("i"), F.lit(2).alias("r0"), F.lit(6).alias("r1"), other.alias("y"))

    def step(s: Column, c: Column) -> Column:
        bit = lambda d: F.when(F.get(s["y"], s["i"] + (d - 1)) == c, F.lit(1 << d)).otherwise(F.lit(0))
        same = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))
        r0 = s["r0"].bitwiseAND(same)
        r1 = s["r1"].bitwiseAND(same).bitwiseOR(s["r0"]).bitwiseOR(F.shiftright(s["r0"], 1)).bitwiseOR(F.shiftleft(r0, 1)).bitwiseAND(F.lit(7))
        return F.struct((s["i"] + 1).alias("i"), r0.alias("r0"), r1.alias("r1"), s["y"].alias("y"))

    ahead = F.length(y) - F.length(x) + 1
    end = F.aggregate(chars, start, step, lambda s: s["r1"])
    return F.when((ahead < 0) | (ahead > 2), F.lit(False)).otherwise(F.call_function("shiftright", end, F.greatest(ahead, F.lit(0))).bitwiseAND(F.lit(1)) == 1)


def near(x: Column, y: Column) -> Column:
    """Whether two open parts are within one edit: narrowed by halves that agree, then run through the automaton."""

    def narrow(s: Column, _: Column) -> Column:
        a, b = s["x"], s["y"]
        half = F.floor(F.least(F.length(a), F.length(b)) / 2).cast("int")
        front = _left(a, half) == _left(b, half)
        back = _right(a, half) == _right(b, half)
        rest = lambda t: F.when(front, F.substring(t, half + 1, F.length(t))).when(back, _left(t, F.length(t) - half))
        return F.struct(rest(a).alias("x"), rest(b).alias("y")).cast("struct<x:string,y:string>")

    start = F.struct(F.when(F.abs(F.length(x) - F.length(y)) <= 1, x).alias("x"), y.alias("y")).cast("struct<x:string,y:string>")
    end = F.aggregate(F.sequence(F.lit(1), F.lit(NARROW)), start, narrow)
    return F.get(F.transform(F.array(end), lambda s: F.when(s["x"].isNotNull() & s["y"].isNotNull(), within_one_edit(s["x"], s["y"])).otherwise(F.lit(False))), F.lit(0))


def _long_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id``, ``pos``, ``line``, ``h``) of the long lines of documents with an id."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    return rows.where(F.length("line") >= MIN_CHARS).withColumn("h", F.xxhash64("line"))


def indexed(lines: DataFrame) -> DataFrame:
    """(``id``, ``pos``, ``h``, ``m``, ``passage``, ``keys``): the index and probe keys of each line, without its text."""
    n = F.length("line")
    m = F.floor(n / 2).cast("int")
    even = n % 2 == 0

    def key(size: Column, side: int) -> Column:
        part = _left(F.col("line"), size) if side == 0 else _right(F.col("line"), size)
        return F.xxhash64(size, F.lit(side), part)

    own = [key(m, 0), key(m, 1)]
    probe = [F.when(even, key(m - 1, s)) for s in (0, 1)]
    passage = F.col("line").rlike(_PASSAGE)
    return lines.select("id", "pos", "h", m.alias("m"), passage.alias("passage"), F.array(*own, *probe).alias("keys"))


def _crowded(entries: DataFrame) -> DataFrame:
    """(``key``, ``hub``) of keys with more than one line; combined before the shuffle."""
    return entries.groupBy("key").agg(F.min("h").alias("hub"), F.max("h").alias("top")).where("hub <> top").select("key", "hub")


def _branches(key: Column, mid: Column, least: Column) -> Column:
    """Where an open part goes on: (key, mid, least); ``least`` is the length that all parts of a bucket have at least.

    While that is over ``SHORT``, parts go on where the first or the last half
    of ``least`` characters agree: two branches, or where it is long four of two such steps. Shorter parts go on in the
    bucket of their own length and of the length below, for a bucket of
    length ``l`` joins parts of ``l`` and ``l + 1`` characters. There what is open
    gets shorter in each branch, so this ends: parts of at most one character are all within one edit.
    """
    size = F.length(mid)
    long = least > SHORT
    longer = least > 8 * SHORT
    first = F.floor(least / 2).cast("int")

    def branch(when: Column, length: Column, side: int, begin: Column, end: Column) -> Column:
        agreed = F.concat(_left(mid, begin), _right(mid, end))
        rest = _left(F.substring(mid, begin + 1, F.length(mid)), size - begin - end)
        then = F.when(long, least - begin - end).otherwise(F.lit(0))
        return F.when(when, F.struct(F.xxhash64(key, F.lit(side), length, agreed).alias("key"), rest.alias("mid"), then.alias("least")))

    zero, one = F.lit(0), F.lit(1)
    back = least - first
    out = [branch(long & ~longer, least, 4, first, zero), branch(long & ~longer, least, 5, zero, back)]
    # Two halvings at once: what is open after the first is halved again.
    more, less = F.floor(back / 2).cast("int"), F.floor(first / 2).cast("int")
    out += [branch(longer, least, 6, first + more, zero), branch(longer, least, 7, first, back - more)]
    out += [branch(longer, least, 8, less, back), branch(longer, least, 9, zero, back + first - less)]
    for down in (0, 1):
        length = size - down
        half = F.floor(length / 2).cast("int")
        out += [branch(~long & (length > 1), length, 0, half, zero), branch(~long & (length > 1), length, 1, zero, length - half)]
        # One character against two: the one is the first or the last of the two.
        out += [branch(~long & (length == 1), length, 0, one, zero), branch(~long & (length == 1), length, 1, zero, one)]
    out += [branch(~long & (size == 1), size, 2, zero, zero), branch(~long & (size <= 1), zero, 3, zero, zero)]
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def links(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``a``, ``b``): links between hashes of lines that connect all lines within one edit. ``table``: see ``indexed``."""
    shared_folder(docs.sparkSession)
    entries = table.select("h", "id", "m", F.posexplode("keys").alias("slot", "key")).where("key is not null").select("key", "h", "id", (F.col("m") - F.floor(F.col("slot") / 2).cast("int")).alias("m"), (F.col("slot") % 2).cast("int").alias("side"))
    members = entries.join(_crowded(entries), "key").groupBy("key", "hub", "h", "m", "side").agg(F.min("id").alias("id")).checkpoint()
    # Texts of these lines only, each from one document that has it.
    wanted = members.groupBy("h").agg(F.min("id").alias("id"))
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    some = plain.join(slim.buckets(wanted, "b", F.xxhash64("id")), slim.bucket(F.xxhash64(plain["id"])) == F.col("b"), "left_semi")
    texts = _long_lines(some, "id", "text").join(slim.buckets(wanted, "b", F.col("h")), slim.bucket(F.col("h")) == F.col("b"), "left_semi").select("id", "h", "line")
    texts = texts.join(wanted, ["h", "id"], "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    opened = F.when(F.col("side") == 0, F.substring("line", F.col("m") + 1, F.length("line"))).otherwise(_left(F.col("line"), F.length("line") - F.col("m")))
    now = members.join(texts, "h").select("key", "hub", "h", opened.alias("mid"), "m")
    now = now.withColumnRenamed("m", "least")
    found: list[DataFrame] = []
    while True:
        hub = now.where(F.col("h") == F.col("hub")).groupBy("key").agg(F.first("mid").alias("hub_mid"))
        pairs = now.where(F.col("h") != F.col("hub")).join(hub, "key").select("key", "hub", "h", "mid", "least", near(F.col("mid"), F.col("hub_mid")).alias("linked")).checkpoint()
        found.append(pairs.where("linked").select(F.col("hub").alias("a"), F.col("h").alias("b")))
        # Buckets in which two lines or more are no hub and some is not linked: all but the hub go on.
        going = pairs.groupBy("key").agg(F.min("h").alias("p"), F.max("h").alias("q"), F.bool_and("linked").alias("all")).where("p <> q and not all").select("key")
        rest = pairs.join(going, "key", "left_semi")
        deeper = rest.select("h", F.explode(_branches(F.col("key"), F.col("mid"), F.col("least"))).alias("n")).select("n.key", "h", "n.mid", "n.least").checkpoint()
        if deeper.isEmpty():
            break
        now = deeper.join(_crowded(deeper), "key")
        release(docs.sparkSession)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def _windows(text: Column) -> Column:
    """The distinct hashes of a text's windows of ``WINDOW`` words; a shorter text is one window."""
    # What lies beyond a text's end is null, which a hash skips.
    window = lambda w: lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])
    every = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(1))), window(w))
    return F.array_distinct(F.get(F.transform(F.array(F.transform(_words(text), lambda x: F.xxhash64(x))), every), F.lit(0)))


def near_copies(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those of ``pairs`` (``id``, ``first_id``) whose texts agree in ``SIMILAR`` of their windows; of several texts of an id, the greatest counts."""
    wanted = pairs.select(F.explode(F.array("id", "first_id")).alias("id")).distinct()
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    some = plain.join(slim.buckets(wanted, "b", F.xxhash64("id")), slim.bucket(F.xxhash64(plain["id"])) == F.col("b"), "left_semi")
    texts = some.join(wanted, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    sets = texts.select("id", _windows(F.col("text")).alias("w")).withColumn("n", F.size("w")).checkpoint()
    mine = sets.select("id", F.col("n").alias("mine"))
    theirs = sets.select(F.col("id").alias("first_id"), F.col("n").alias("theirs"))
    # Sets of too different sizes cannot agree enough, and are not sent anywhere.
    fair = pairs.join(mine, "id").join(theirs, "first_id").where(F.least("mine", "theirs") >= SIMILAR * F.greatest("mine", "theirs"))
    sided = fair.join(sets.select("id", F.col("w").alias("x")), "id").join(sets.select(F.col("id").alias("first_id"), F.col("w").alias("y")), "first_id")
    both = F.size(F.array_intersect("x", "y"))
    return sided.select("id", "first_id", "mine", "theirs", both.alias("both")).where(F.col("both") >= SIMILAR * (F.col("mine") + F.col("theirs") - F.col("both"))).select("id", "first_id")


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS) -> DataFrame:
    """(``id``, ``gone``, ``n_near``): by document, the places of its boilerplate lines, and how many of its lines have a near, different line."""
    shared_folder(docs.sparkSession)
    table = indexed(_long_lines(docs, id_col, text_col)).checkpoint()
    roots = components(links(docs, table, id_col, text_col), "a", "b")
    classes = roots.select(F.col("node").alias("h"), "root").unionByName(roots.select(F.col("root").alias("h"), "root").distinct()).checkpoint()
    spots = table.select("id", "pos", "h", "passage")
    # Only lines that occur often enough, or have a near line, can be in a class of so many documents.
    often = spots.groupBy("h").agg(F.count("*").alias("n"), F.bool_or("passage").alias("passage")).where((F.col("n") > max_docs) | (F.col("passage") & (F.col("n") > 1))).select("h")
    slim = spots.join(often.unionByName(classes.select("h")).distinct(), "h").join(classes, "h", "left").select("id", "pos", "h", "passage", F.coalesce("root", "h").alias("class"), F.col("root").isNotNull().alias("near")).checkpoint()
    by_class = slim.groupBy("class", "id").agg(F.bool_or("passage").alias("passage")).groupBy("class").agg(F.count("*").alias("docs"), F.min("id").alias("first_id"), F.bool_or("passage").alias("passage")).where((F.col("docs") > max_docs) | (F.col("passage") & (F.col("docs") > 1)))
    first = by_class.join(slim.groupBy("class", "id").agg(F.min("pos").alias("first_pos")), (by_class["class"] == slim["class"]) & (by_class["first_id"] == slim["id"])).select(by_class["class"], "first_id", "first_pos", (F.col("docs") <= max_docs).alias("few"))
    hit = slim.join(first, "class", "left").checkpoint()
    copies = near_copies(docs, hit.where("few and id <> first_id").select("id", "first_id").distinct().checkpoint(), id_col, text_col)
    hit = hit.join(copies.withColumn("copy", F.lit(True)), ["id", "first_id"], "left")
    gone = F.col("first_id").isNotNull() & ~((F.col("id") == F.col("first_id")) & (F.col("pos") == F.col("first_pos"))) & ~(F.col("few") & F.col("copy").isNotNull())
    return hit.groupBy("id").agg(F.array_distinct(F.collect_list(F.when(gone, F.col("pos")))).alias("gone"), F.count_if("near").alias("n_near")).where((F.size("gone") > 0) | (F.col("n_near") > 0))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, report: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with the text thinned; ``report`` adds ``n_lines``, ``n_kept``, ``n_near``."""
    mine, gone, near, taken = (slim.free(n, docs.columns) for n in ("line_id", "line_gone", "line_near", "line_bucket"))
    marks = dropped(docs, id_col, text_col, max_docs).select(F.col("id").alias(mine), F.col("gone").alias(gone), F.col("n_near").alias(near))
    # Without a report only documents that lose a line matter.
    marks = (marks if report else marks.where(F.size(gone) > 0)).checkpoint()
    # Documents whose bucket has no mark are not shuffled.
    touched = slim.buckets(marks, taken, F.xxhash64(mine))
    sided = docs.join(touched, slim.bucket(F.xxhash64(docs[id_col])) == F.col(taken), "left")
    apart = sided.where(F.col(taken).isNotNull()).drop(taken).join(marks, F.col(id_col) == F.col(mine), "left")
    same = sided.where(F.col(taken).isNull()).drop(taken)
    same = same.withColumns({c: F.lit(None).cast(marks.schema[c].dataType) for c in marks.columns})
    thin = lambda df: _thinned(df, docs.columns, text_col, gone, near, report)
    return thin(same).unionByName(thin(apart))


def _thinned(joined: DataFrame, columns: list[str], text_col: str, gone: str, near: str, report: bool) -> DataFrame:
    # One step, one column: what several later ones read (the lines, what is left of them) is made once for each document.
    every, left, kept = (slim.free(n, joined.columns) for n in ("line_every", "line_left", "line_kept"))
    now = joined.withColumn(every, _lines(F.col(text_col)))
    some = F.size(gone) > 0
    places = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(gone))
    now = now.withColumn(left, F.when(some, F.transform(places, lambda i: F.get(every, i))).otherwise(F.col(every)))
    long = F.filter(F.col(left), lambda x: F.length(x) >= MIN_CHARS)
    again = F.size(long) > F.size(F.array_distinct(long))
    # Short lines are told apart by their place, so that only long ones collapse.
    tagged = F.array_distinct(F.transform(left, lambda x, i: F.when(F.length(x) < MIN_CHARS, F.concat(i.cast("string"), F.lit(":"), x)).otherwise(F.concat(F.lit(":"), x))))
    now = now.withColumn(kept, F.when(again, F.transform(tagged, lambda x: F.substring(x, F.locate(":", x) + 1, F.length(x)))).otherwise(F.col(left)))
    same = F.size(kept) == F.size(every)  # a text that loses no line stays as it is
    thinned = F.when(same, now[text_col]).otherwise(F.array_join(kept, "\n"))
    cols = [thinned.alias(c) if c == text_col else now[c] for c in columns]
    extra = [F.greatest(F.size(every), F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.size(kept), F.lit(0)).cast("long").alias("n_kept"), F.coalesce(near, F.lit(0)).cast("long").alias("n_near")] if report else []
    return now.select(*cols, *extra)
