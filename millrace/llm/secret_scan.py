"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Patterns propose candidate spans.  A native regular expression gives matches
but not places, so places are sums of lengths: splitting a text at a pattern
yields the pieces between its matches, and both cut at the same matches.

Every candidate's value is hashed; over the whole corpus the distinct
repositories (documents, by default) and distinct owners (sources) of each
hash are counted, summed by (hash, owner) and then by hash so that
a value that sits in a third of all rows is summed before it is shuffled.  A
value held by ``WIDE_OWNERS`` owners or more or standing in ``WIDE_REPOS`` repositories or more, whosever they are, or that spells out a
placeholder word, is a widely copied example; any other is owner-specific and
looks live.  Each row has the most owners and repositories of any of its values.

Base kinds are ``assign``, ``access`` and ``hex``; the method adds ``pem``,
``github`` and ``jwt``.

Cases: null and empty texts give zero counts and an empty list; spans are in
code points, end exclusive, ordered by start and then kind as listed in
``KINDS``; a null owner counts as one owner of its own; repeated rows each get
their row; whole texts of any length are scanned; columns other than the ones
named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.ship import shared_folder

#: A value of so many distinct owners is a widely copied example.
WIDE_OWNERS = 3
#: A value in so many distinct repositories is one too.
WIDE_REPOS = 25
# Words that mark a placeholder.
PLACEHOLDER = "example|sample|dummy|changeme|placeholder|xxxxxx|your_|your-|<.*>"


@dataclass(frozen=True)
class Kind:
    """A pattern; ``group`` is what is secret, of ``least`` characters or more; ``gate`` must match for the pattern to match."""

    name: str
    pattern: str
    gate: str
    group: int = 0
    least: int = 1


# The patterns. A run that must have N characters is written with {N,}: runs are maximal, so the matches are the same.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)(?:password|passwd|secret|token|api_?key)[\x20\x22\x27:=]", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", r"AKIA[A-Z0-9]{12}"),
    Kind("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{32}"),
    Kind("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", r"-----BEGIN "),
    Kind("github", r"gh[opsur]_[A-Za-z0-9]{36,}", r"gh[opsur]_[A-Za-z0-9]{36}"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]"),
)
BASE = KINDS[:3]

_SPAN = "struct<start:int,ord:int,end:int,kind:string,value:string>"
_STATE = f"struct<at:int,out:array<{_SPAN}>>"
_PARTS = f"struct<at:int,out:array<array<{_SPAN}>>>"


def _spans(text: Column, kind: Kind, order: int) -> Column:
    """All spans of one kind in a text."""
    pattern = F.lit(kind.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else found
    between = F.split(text, kind.pattern, -1)
    none = F.array().cast(f"array<{_SPAN}>")
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  a value that f names several times

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["between"])
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind.name).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(state["out"], span).alias("out")).cast(_STATE)

    def folded(z: Column) -> Column:
        """Appending copies what is there, so a long list is folded in parts of the root of its length, and these are joined."""
        width = F.ceil(F.sqrt(F.size(z))).cast("int")
        parts = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / width).cast("int"))

        def part(state: Column, n: Column) -> Column:
            inner = F.aggregate(F.slice(z, n * width + 1, width), F.struct(state["at"].alias("at"), none.alias("out")).cast(_STATE), step)
            return bind(inner, lambda r: F.struct(r["at"].alias("at"), F.array_append(state["out"], r["out"]).alias("out")).cast(_PARTS))

        start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(_PARTS)
        return F.when(F.size(z) > 0, F.aggregate(parts, start, part, lambda s: F.flatten(s["out"]))).otherwise(none)

    # One piece more than matches; its partner is null and is cut off.
    zipped = F.slice(F.arrays_zip(found.alias("found"), value.alias("value"), between.alias("between")), 1, F.size(found))
    out = bind(zipped, folded)
    return F.when(F.rlike(text, F.lit(kind.gate)), F.filter(out, lambda x: F.length(x["value"]) >= kind.least)).otherwise(none)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``owner``, ``repo`` and ``spans``, an array of start, ord, end, kind, value."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = F.array_sort(F.concat(*[_spans(text, k, n) for n, k in enumerate(KINDS)]))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col or id_col).cast("string").alias("repo"), every.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """For each value's hash: ``n_repos``, ``n_owners``."""
    each = found.select("owner", "repo", F.explode("spans.value").alias("value")).select(F.xxhash64("value").alias("h"), "owner", "repo")
    by_repo = each.groupBy("h", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("h", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("h").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``spans``, ``n_shared`` and ``n_owner_specific`` (spans by the standing of their value), ``n_owners``, ``n_repos``."""
    shared_folder(docs.sparkSession)
    # Without texts and read three times below; most rows have no span at all.
    found = candidates(docs, id_col, text_col, owner_col, repo_col).checkpoint()
    some, none = found.where(F.size("spans") > 0), found.where(F.size("spans") == 0)
    # Rows that agree in this key have equal answers, so it need not be unique.
    keyed = some.withColumn("row_key", F.md5(F.to_json(F.struct("doc_id", "spans"))))
    values = keyed.select("row_key", F.posexplode("spans.value").alias("pos", "value")).groupBy("row_key", "pos").agg(F.first("value").alias("value"))
    wide = F.coalesce((F.col("n_owners") >= WIDE_OWNERS) | (F.col("n_repos") >= WIDE_REPOS), F.lit(False)) | F.rlike(F.lower("value"), F.lit(PLACEHOLDER))
    owned = ownership(found).checkpoint()  # written, so that Spark can split the rows of a value that stands everywhere
    judged = values.withColumn("h", F.xxhash64("value")).join(owned, "h", "left").groupBy("row_key").agg(F.sum(wide.cast("long")).alias("n_shared"), F.sum((~wide).cast("long")).alias("n_owner_specific"), F.max("n_owners").alias("n_owners"), F.max("n_repos").alias("n_repos"))
    more = ("n_shared", "n_owner_specific", "n_owners", "n_repos")
    return keyed.join(judged, "row_key", "left").select("doc_id", "spans", *more).unionByName(none.select("doc_id", "spans", *[F.lit(0).cast("long").alias(c) for c in more]))


def digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of ``scan``'s result."""
    counts = []
    for k in BASE:
        counts.append(F.size(F.filter("spans", _is(k.name))).cast("long").alias(f"n_{k.name}"))
    base = F.filter("spans", lambda x: x["ord"] < len(BASE))
    return scanned.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_shared", "n_owner_specific", "n_owners", "n_repos")


def _is(kind: str):  # noqa: ANN202
    return lambda x: x["kind"] == kind
