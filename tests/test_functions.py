"""Codec, hashes, fingerprints, interning."""

import dataclasses
import datetime as dt
import decimal
import gc
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions.codec import decode, encode, register_class
from millrace.functions.fingerprint import frame_fingerprint, slice_fingerprints, stable_hash
from millrace.functions.intern import Interner

plain = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text() | st.binary()
nested = st.recursive(plain, lambda x: st.lists(x) | st.tuples(x, x) | st.dictionaries(st.text(), x) | st.sets(st.integers()) | st.frozensets(st.text()), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(nested)
def test_codec_round_trip(x):
    assert decode(encode(x)) == x
    assert stable_hash(x) == stable_hash(decode(encode(x)))


def test_codec_types():
    for x in (decimal.Decimal("1.50"), dt.datetime(2024, 1, 2, 3, 4, 5, 6), dt.date(2024, 1, 2), dt.timedelta(1, 2, 3), range(1, 9, 2), -0.0, math.inf):
        back = decode(encode(x))
        assert back == x and type(back) is type(x)
    assert math.isnan(decode(encode(math.nan)))
    assert stable_hash(0.0) != stable_hash(-0.0)
    assert stable_hash({"a": 1, "b": 2}) == stable_hash({"b": 2, "a": 1})
    assert stable_hash(["ab", "c"]) != stable_hash(["a", "bc"])
    assert stable_hash(1) != stable_hash("1") != stable_hash(True)
    assert stable_hash(1, seed=1) != stable_hash(1, seed=2)
    with pytest.raises(TypeError):
        encode(object())
    with pytest.raises(ValueError):
        decode('["?"]')


def test_skipped_fields():
    @dataclasses.dataclass(frozen=True)
    class Point:
        x: int
        note: str = dataclasses.field(default="", metadata={"skip": True})

    with pytest.raises(ValueError):
        decode(encode(Point(1)))
    register_class(f"{Point.__module__}.{Point.__qualname__}", Point)
    assert decode(encode(Point(1, "hello"))) == Point(1)


def test_frame_fingerprints(spark):
    fp = lambda rows, schema="a string, b string": frame_fingerprint(spark.createDataFrame(rows, schema))
    assert fp([("x", "y"), ("z", None)]) == fp([("z", None), ("x", "y")])
    assert fp([(None, "a")]) != fp([("a", None)])
    assert fp([("a", "b")]) != fp([("a", "b"), ("a", "b")])
    assert fp([(0.0,)], "a double") != fp([(-0.0,)], "a double")
    assert fp([([[1], [2]],)], "a array<array<int>>") != fp([([[1, 2]],)], "a array<array<int>>")
    assert fp([({"p": 1, "q": 2},)], "a map<string,int>") == fp([({"q": 2, "p": 1},)], "a map<string,int>")
    assert fp([], "a int") != fp([], "a long")
    assert fp([(1, None)], "a int, b int") != fp([(None, 1)], "a int, b int")


def test_slice_fingerprints(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    got = slice_fingerprints(df, "k", 10)
    assert set(got) == {1, 2, None}
    assert got[1] == frame_fingerprint(df.where("k = 1"))
    with pytest.raises(ValueError):
        slice_fingerprints(df, "k", 2)


def test_interner():
    i = Interner()
    a, b = i.intern([1, 2]), i.intern([1, 2])
    assert a is b and i.get_from_hash(list, a.hash) is a
    assert i.intern((1, 2)) is not a
    digest = a.hash
    del a, b
    gc.collect()
    assert i.get_from_hash(list, digest) is None
    assert i.vacuum() == 2 and len(i) == 0


NESTED = {
    "array<timestamp>": "array(timestamp'2024-01-01 00:00:00.00000{}')",
    "array<timestamp_ntz>": "array(timestamp_ntz'2024-01-01 00:00:00.00000{}')",
    "struct": "named_struct('a', timestamp'2024-01-01 00:00:00.00000{}', 'b', array(1))",
    "map value": "map('k', timestamp'2024-01-01 00:00:00.00000{}')",
    "map key": "map(timestamp'2024-01-01 00:00:00.00000{}', 1)",
    "deep": "array(named_struct('m', map(1, array(timestamp_ntz'0001-01-01 00:00:00.00000{}'))))",
    "decimal": "array(cast('1.00000{}' as decimal(20, 6)))",
    "double": "array(1.000000000000001D + {}e-15D)",
    "binary": "array(cast('{}' as binary))",
    "interval": "array(interval '0.00000{}' second)",
}


@pytest.mark.parametrize("kind", NESTED)
def test_nested_values_differ_to_the_last_digit(spark, kind):
    from millrace.functions.fingerprint import frame_fingerprint

    one, two, again = (frame_fingerprint(spark.sql(f"select {NESTED[kind].format(d)} as x")) for d in (1, 2, 1))
    assert one == again != two


def test_nested_nulls_are_values(spark):
    from millrace.functions.fingerprint import frame_fingerprint

    texts = ["array(timestamp'2024-01-01', null)", "array(timestamp'2024-01-01')", "array(null, timestamp'2024-01-01')", "cast(null as array<timestamp>)", "cast(array() as array<timestamp>)"]
    assert len({frame_fingerprint(spark.sql(f"select {t} as x")) for t in texts}) == len(texts)
    structs = ["named_struct('a', timestamp'2024-01-01')", "named_struct('a', cast(null as timestamp))", "cast(null as struct<a:timestamp>)"]
    assert len({frame_fingerprint(spark.sql(f"select {t} as x")) for t in structs}) == len(structs)
