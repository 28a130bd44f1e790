"""Call counts and dirty-edge counts of the incremental engine, on scalar values."""

import pytest

from millrace.operators.definition import CyclicRead, MissingExecutor, RuleError, Style, executor, query
from millrace.operators.engine import SetResult


@query
class Var:
    n: int


@query
class Single:
    kind: str


@query
class Of:
    kind: str
    n: int


def simple(kind_type, f, **kw):
    return executor(kind_type, **kw)(f)


def key_type(name):
    return query(type(name, (), {"__annotations__": {"n": int}}), name=name)


def no_field(name):
    return query(type(name, (), {}), name=name)


def put(engine, **values):
    with engine.session() as s:
        return [s.set_input(Var(int(k[1:])), v) for k, v in values.items()]


def test_safe_division_checks_in_order(engine):
    Div, Safe = no_field("Div"), no_field("Safe")
    div = simple(Div, lambda k, c: c.query(Var(0)) // c.query(Var(1)))
    safe = simple(Safe, lambda k, c: None if c.query(Var(1)) == 0 else c.query(Div()))
    engine.register(div, safe)
    put(engine, v0=42, v1=2)
    assert engine.query(Safe()) == 21
    put(engine, v1=0)
    assert engine.query(Safe()) is None
    assert (div.runs, safe.runs) == (1, 2)
    put(engine, v1=2)
    assert engine.query(Safe()) == 21
    assert (div.runs, safe.runs) == (1, 3)


def test_early_cutoff(engine):
    Abs, Add = key_type("Abs"), no_field("Add")
    a = simple(Abs, lambda k, c: abs(c.query(Var(k.n))))
    add = simple(Add, lambda k, c: c.query(Abs(0)) + c.query(Abs(1)))
    engine.register(a, add)
    put(engine, v0=200, v1=150)
    assert engine.query(Add()) == 350
    put(engine, v0=-200)
    assert engine.query(Add()) == 350
    assert (a.runs, add.runs) == (3, 1)
    put(engine, v1=-150)
    assert engine.query(Add()) == 350
    assert (a.runs, add.runs) == (4, 1)


def test_firewall(engine):
    Sq, Neg, Str = no_field("Sq"), no_field("Neg"), no_field("Str")
    sq = simple(Sq, lambda k, c: c.query(Var(0)) ** 2, style=Style.FIREWALL)
    neg = simple(Neg, lambda k, c: -c.query(Sq()))
    text = simple(Str, lambda k, c: str(c.query(Neg())))
    engine.register(sq, neg, text)
    runs = lambda: (sq.runs, neg.runs, text.runs)
    put(engine, v0=3)
    assert engine.query(Str()) == "-9"
    put(engine, v0=-3)
    assert engine.dirtied_edges() == 1
    assert engine.query(Str()) == "-9"
    assert runs() == (2, 1, 1)
    assert engine.dirtied_edges() == 1
    put(engine, v0=4)
    assert engine.dirtied_edges() == 1
    assert engine.query(Str()) == "-16"
    assert runs() == (3, 2, 2)
    assert engine.dirtied_edges() == 3


def test_chained_firewalls(engine):
    A, C, D = no_field("FA"), no_field("FC"), no_field("FD")
    a = simple(A, lambda k, c: abs(c.query(Var(0))), style=Style.FIREWALL)
    cl = simple(C, lambda k, c: min(c.query(A()), 100), style=Style.FIREWALL)
    d = simple(D, lambda k, c: 2 * c.query(C()))
    engine.register(a, cl, d)
    script = [(50, 100, (1, 1, 1), 0), (-50, 100, (2, 1, 1), 1), (80, 160, (3, 2, 2), 3), (150, 200, (4, 3, 3), 3), (200, 200, (5, 4, 3), 2)]
    for v, want, runs, dirt in script:
        put(engine, v0=v)
        assert engine.query(D()) == want
        assert (a.runs, cl.runs, d.runs) == runs
        assert engine.dirtied_edges() == dirt


def test_diamond_and_several_callers(engine):
    S, Sum, Two, One = key_type("S"), no_field("Sum"), no_field("Two"), no_field("One")
    s = simple(S, lambda k, c: c.query(Var(k.n)) ** 2, style=Style.FIREWALL)
    sm = simple(Sum, lambda k, c: c.query(S(0)) + c.query(S(1)))
    two, one = simple(Two, lambda k, c: 2 * c.query(S(0))), simple(One, lambda k, c: 1 + c.query(S(0)))
    engine.register(s, sm, two, one)
    for (x, y), want, runs in [((3, 4), 25, (2, 1)), ((-3, 4), 25, (3, 1)), ((-3, -4), 25, (4, 1)), ((5, -4), 41, (5, 2))]:
        put(engine, v0=x, v1=y)
        assert engine.query(Sum()) == want
        assert (s.runs, sm.runs) == runs
    assert (engine.query(Two()), engine.query(One())) == (50, 26)
    put(engine, v0=-5)
    assert (engine.query(Two()), engine.query(One())) == (50, 26)
    assert (two.runs, one.runs) == (1, 1)


def test_conditional_firewall(engine):
    S, Cond = no_field("CS"), no_field("Cond")
    s = simple(S, lambda k, c: c.query(Var(1)) ** 2, style=Style.FIREWALL)
    cond = simple(Cond, lambda k, c: c.query(S()) if c.query(Var(0)) > 0 else -1)
    engine.register(s, cond)
    put(engine, v0=1, v1=3)
    assert engine.query(Cond()) == 9
    put(engine, v1=-3)
    assert engine.query(Cond()) == 9
    assert (s.runs, cond.runs) == (2, 1)
    put(engine, v0=0, v1=4)
    assert engine.dirtied_edges() == 2
    assert engine.query(Cond()) == -1
    assert (s.runs, cond.runs, engine.dirtied_edges()) == (3, 2, 3)
    put(engine, v1=100)
    assert engine.query(Cond()) == -1
    assert (s.runs, engine.dirtied_edges()) == (3, 1)


def square_sum(engine):
    Slow, All, One, Sum = key_type("Slow"), no_field("All"), key_type("OneOf"), no_field("SumOf")
    slow = simple(Slow, lambda k, c: c.query(Var(k.n)) ** 2)
    every = simple(All, lambda k, c: {i: 2 * c.query(Slow(i)) for i in c.query(Single("targets"))}, style=Style.FIREWALL)
    one = simple(One, lambda k, c: c.query(All()).get(k.n), style=Style.PROJECTION)
    total = simple(Sum, lambda k, c: sum(c.query(One(i)) for i in c.query(Single("targets"))))
    engine.register(slow, every, one, total)
    with engine.session() as s:
        s.set_input(Single("targets"), list(range(8)))
        for i in range(8):
            s.set_input(Var(i), i + 1)
    return Sum, slow, every, one, total


def test_projection_counts(engine):
    Sum, slow, every, one, total = square_sum(engine)
    assert engine.query(Sum()) == 408
    put(engine, v0=10)
    assert engine.dirtied_edges() == 2
    assert engine.query(Sum()) == 606
    assert engine.dirtied_edges() == 11
    assert (slow.runs, every.runs, one.runs, total.runs) == (9, 2, 16, 2)


def levels(engine, n=100):
    Fw, P = no_field("Fw"), key_type("P")
    fw = simple(Fw, lambda k, c: {i: c.query(Var(i)) for i in range(n)}, style=Style.FIREWALL)
    p = simple(P, lambda k, c: 2 * c.query(Fw())[k.n], style=Style.PROJECTION)
    engine.register(fw, p)
    put(engine, **{f"v{i}": i + 1 for i in range(n)})
    return P, fw, p


def test_projection_diamond(engine):
    P, fw, p = levels(engine)
    Comb = no_field("Comb")
    comb = simple(Comb, lambda k, c: c.query(P(0)) + c.query(P(1)))
    engine.register(comb)
    assert engine.query(Comb()) == 6
    put(engine, v2=100)
    assert engine.query(Comb()) == 6
    assert (fw.runs, p.runs, comb.runs, engine.dirtied_edges()) == (2, 4, 1, 3)
    put(engine, v0=50)
    assert engine.query(Comb()) == 104
    assert (fw.runs, p.runs, comb.runs, engine.dirtied_edges()) == (3, 6, 2, 4)


def test_all_projections(engine):
    P, fw, p = levels(engine)
    CP, Last = no_field("CP"), no_field("Last")
    cp = simple(CP, lambda k, c: c.query(P(0)) + c.query(P(1)), style=Style.PROJECTION)
    last = simple(Last, lambda k, c: 100 * c.query(CP()))
    engine.register(cp, last)
    for change, want, runs in [({}, 600, (1, 2, 1, 1)), ({"v2": 100}, 600, (2, 4, 1, 1)), ({"v0": 50}, 10400, (3, 6, 2, 2)), ({"v0": 52, "v1": 0}, 10400, (4, 8, 3, 2))]:
        put(engine, **change)
        assert engine.query(Last()) == want
        assert (fw.runs, p.runs, cp.runs, last.runs) == runs


def test_asymmetric_diamond_is_never_stale(engine):
    P, fw, p = levels(engine)
    L2, L3, Con = key_type("L2"), key_type("L3"), no_field("Con")
    engine.register(
        simple(L2, lambda k, c: c.query(P(k.n)) + 100, style=Style.PROJECTION),
        simple(L3, lambda k, c: abs(c.query(L2(k.n))), style=Style.PROJECTION),
        simple(Con, lambda k, c: 10 * (c.query(L3(0)) + c.query(P(1)))),
    )
    assert engine.query(Con()) == 10 * (102 + 4)
    put(engine, v0=5)
    assert engine.query(Con()) == 10 * (110 + 4)
    put(engine, v2=7)
    assert engine.query(Con()) == 1140
    put(engine, v1=10)
    assert engine.query(Con()) == 1300


def test_dynamic_keys(engine):
    Fw, P, D, Sum = no_field("DFw"), query(type("DP", (), {"__annotations__": {"k": str}}), name="DP"), query(type("DD", (), {"__annotations__": {"k": str}}), name="DD"), no_field("DSum")
    engine.register(
        simple(Fw, lambda k, c: dict(c.query(Single("map"))), style=Style.FIREWALL),
        simple(P, lambda k, c: c.query(Fw()).get(k.k), style=Style.PROJECTION),
        simple(D, lambda k, c: 2 * c.query(P(k.k))),
        simple(Sum, lambda k, c: sum(c.query(D(x)) for x in sorted(c.query(Fw())))),
    )
    for m, want in [({"a": 1, "b": 2, "c": 3}, 12), ({"a": 1, "c": 3}, 8), ({"a": 1, "b": 20, "c": 3}, 48)]:
        with engine.session() as s:
            s.set_input(Single("map"), m)
        assert engine.query(Sum()) == want


def test_cycles(engine):
    A, B, D = no_field("CA"), no_field("CB"), no_field("CD")
    a = simple(A, lambda k, c: c.query(B()) + 10, cycle_value=lambda: 42)
    b = simple(B, lambda k, c: c.query(A()) + 20, cycle_value=lambda: 84)
    d = simple(D, lambda k, c: c.query(A()) + c.query(B()) + 100)
    engine.register(a, b, d)
    assert engine.query(D()) == 226
    assert (engine.query(A()), engine.query(B())) == (42, 84)
    assert (a.runs, b.runs, d.runs) == (1, 1, 1)


def test_cycle_that_appears_during_a_repair(engine):
    A, B, T = no_field("QA"), no_field("QB"), no_field("QT")
    engine.register(
        simple(A, lambda k, c: c.query(B()), cycle_value=lambda: -1),
        simple(B, lambda k, c: c.query(A()) + 1 if c.query(Var(0)) else 5, cycle_value=lambda: -2),
        simple(T, lambda k, c: [c.query(A()), c.query(B())]),
    )
    for v, want in [(0, [5, 5]), (1, [-1, -2]), (0, [5, 5]), (1, [-1, -2])]:
        put(engine, v0=v)
        assert engine.query(T()) == want


def test_conditional_cycle(engine):
    A, B = no_field("KA"), no_field("KB")
    engine.register(
        simple(A, lambda k, c: c.query(B()) if c.query(Var(0)) == 1 else 100 * c.query(Var(0)), cycle_value=lambda: 0),
        simple(B, lambda k, c: c.query(A()) if c.query(Var(0)) == 1 else 200 * c.query(Var(0)), cycle_value=lambda: 0),
    )
    for v, want in [(5, (500, 1000)), (1, (0, 0)), (3, (300, 600)), (1, (0, 0))]:
        put(engine, v0=v)
        assert (engine.query(A()), engine.query(B())) == want


def test_external_refresh(engine):
    outside = {0: "a", 1: "b"}
    Read, Other, Up = key_type("Read"), key_type("OtherRead"), key_type("Up")
    read = simple(Read, lambda k, c: outside.get(k.n, "none"), style=Style.EXTERNAL)
    other = simple(Other, lambda k, c: 1, style=Style.EXTERNAL)
    up = simple(Up, lambda k, c: c.query(Read(k.n)).upper())
    engine.register(read, other, up)
    assert [engine.query(Up(i)) for i in (0, 1)] == ["A", "B"]
    outside[0] = "x"
    assert engine.query(Up(0)) == "A"
    with engine.session() as s:
        assert s.refresh(Other) == 0
    assert engine.query(Up(0)) == "A"
    with engine.session() as s:
        assert s.refresh(Read) == 1
    assert (engine.query(Up(0)), engine.query(Up(1))) == ("X", "B")
    assert (read.runs, up.runs, other.runs) == (4, 3, 0)


def test_set_results_and_abort(engine):
    assert put(engine, v0=1) == [SetResult.FRESH]
    assert put(engine, v0=1) == [SetResult.UNCHANGED]
    assert put(engine, v0=2) == [SetResult.UPDATED]
    assert engine.dirtied_edges() == 0
    with pytest.raises(ZeroDivisionError), engine.session() as s:
        s.set_input(Var(0), 99)
        raise ZeroDivisionError
    assert engine.query(Var(0)) == 2
    with engine.session() as s:
        s.update(Var(0), lambda x: x + 1)
        s.update(Var(5), lambda x: x or 7)
    assert (engine.query(Var(0)), engine.query(Var(5))) == (3, 7)


def test_input_overrides_executable(engine):
    A, B = no_field("OA"), no_field("OB")
    a, b = simple(A, lambda k, c: c.query(Var(0))), simple(B, lambda k, c: 2 * c.query(A()))
    engine.register(a, b)
    put(engine, v0=1)
    assert engine.query(B()) == 2
    with engine.session() as s:
        s.set_input(A(), 50)
    assert engine.query(B()) == 100
    put(engine, v0=9)
    assert engine.dirtied_edges() == 0
    assert engine.query(B()) == 100


def test_failures_leave_no_trace(engine):
    A, B = no_field("EA"), no_field("EB")
    a = simple(A, lambda k, c: c.query(Var(0)) + 1)

    def div(k, c):
        return 10 // c.query(A())

    b = simple(B, div)
    engine.register(a, b)
    put(engine, v0=-1)
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            engine.query(B())
    assert a.runs == 1
    put(engine, v0=4)
    assert engine.query(B()) == 2


def test_rules(engine):
    E, P = no_field("RE"), no_field("RP")
    engine.register(simple(E, lambda k, c: c.query(Var(0)), style=Style.EXTERNAL), simple(P, lambda k, c: c.query(Var(0)), style=Style.PROJECTION))
    put(engine, v0=1)
    for k in (E(), P()):
        with pytest.raises(RuleError):
            engine.query(k)
    with pytest.raises(MissingExecutor):
        engine.query(no_field("Nobody")())
    assert not issubclass(CyclicRead, Exception)


def test_parallel_readers_compute_once(engine):
    import threading
    import time

    Slow, Wide = key_type("PS"), no_field("Wide")

    def work(k, c):
        time.sleep(0.05)
        return c.query(Var(0)) + k.n

    slow = simple(Slow, work)
    wide = simple(Wide, lambda k, c: sum(c.map([Slow(i) for i in range(6)])))
    engine.register(slow, wide)
    put(engine, v0=1)
    got = []
    threads = [threading.Thread(target=lambda: got.append(engine.query(Wide()))) for _ in range(20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert set(got) == {21}
    assert (slow.runs, wide.runs) == (6, 1)
    put(engine, v0=2)
    assert engine.query(Wide()) == 27
    assert (slow.runs, wide.runs) == (12, 2)


def test_random_sessions_equal_recomputation(spark, tmp_path):
    import random

    from millrace.operators.engine import Engine

    r = random.Random(3)
    Map, Sl, Mix, Top = no_field("RM"), key_type("RS"), key_type("RX"), no_field("RT")
    makers = [
        (Map, lambda k, c: {i: abs(c.query(Var(i))) for i in range(5)}, Style.FIREWALL),
        (Sl, lambda k, c: c.query(Map()).get(k.n), Style.PROJECTION),
        (Mix, lambda k, c: c.query(Sl(k.n)) if c.query(Var(4)) > 0 else -c.query(Var(k.n)), Style.NORMAL),
        (Top, lambda k, c: [c.query(Mix(i)) for i in range(4)], Style.NORMAL),
    ]

    def fresh(path):
        e = Engine(spark, str(path), durable=False)
        e.register(*[executor(t, style=s)(f) for t, f, s in makers])
        return e

    e, state = fresh(tmp_path / "a"), {i: 0 for i in range(5)}
    with e.session() as s:
        for i, v in state.items():
            s.set_input(Var(i), v)
    for _ in range(60):
        change = {r.randrange(5): r.randrange(-2, 3) for _ in range(r.randrange(1, 3))}
        state |= change
        with e.session() as s:
            for i, v in change.items():
                s.set_input(Var(i), v)
        if r.random() < 0.7:
            f = fresh(tmp_path / "b")
            with f.session() as s:
                for i, v in state.items():
                    s.set_input(Var(i), v)
            assert e.query(Top()) == f.query(Top())


# -- more projection shapes ------------------------------------------------------


def maps(engine, *names):
    """Firewalls of maps over Var: name i maps n to Var(100 * i + n)."""
    types = [no_field(n) for n in names]
    reads = lambda i: lambda k, c: {n: c.query(Var(100 * i + n)) for n in range(4)}
    engine.register(*[simple(t, reads(i), style=Style.FIREWALL) for i, t in enumerate(types)])
    put(engine, **{f"v{100 * i + n}": n + 1 for i in range(len(names)) for n in range(4)})
    return types


def test_projection_of_two_firewalls(engine):
    A, B = maps(engine, "TwoA", "TwoB")
    Pair, Sum = key_type("TwoPair"), no_field("TwoSum")
    pair = simple(Pair, lambda k, c: (c.query(A())[k.n], c.query(B())[k.n]), style=Style.PROJECTION)
    total = simple(Sum, lambda k, c: sum(sum(c.query(Pair(n))) for n in range(4)))
    engine.register(pair, total)
    assert engine.query(Sum()) == 20
    put(engine, v2=30)
    assert engine.query(Sum()) == 47
    assert (pair.runs, total.runs) == (8, 2)
    put(engine, v2=30, v100=1)
    assert engine.query(Sum()) == 47 and total.runs == 2
    put(engine, v2=3, v102=30)  # one slice changes in both, and its sum does not
    assert engine.query(Sum()) == 47 and total.runs == 3


def test_chained_projections(engine):
    (A,) = maps(engine, "ChainA")
    One, Two, Three, Sum = key_type("ChainOne"), key_type("ChainTwo"), key_type("ChainThree"), no_field("ChainSum")
    one = simple(One, lambda k, c: c.query(A())[k.n], style=Style.PROJECTION)
    two = simple(Two, lambda k, c: c.query(One(k.n)) % 10, style=Style.PROJECTION)
    three = simple(Three, lambda k, c: c.query(Two(k.n)) * 2, style=Style.PROJECTION)
    total = simple(Sum, lambda k, c: sum(c.query(Three(n)) for n in range(4)))
    engine.register(one, two, three, total)
    assert engine.query(Sum()) == 20
    put(engine, v0=11)  # the second projection absorbs it
    assert engine.query(Sum()) == 20
    assert (one.runs, two.runs, three.runs, total.runs) == (8, 5, 4, 1)
    put(engine, v0=12)
    assert engine.query(Sum()) == 22
    assert (two.runs, three.runs, total.runs) == (6, 5, 2)


def test_absolute_chain(engine):
    (A,) = maps(engine, "AbsA")
    One, Abs, Next, Use = key_type("AbsOne"), key_type("AbsAbs"), key_type("AbsNext"), no_field("AbsUse")
    one = simple(One, lambda k, c: c.query(A())[k.n], style=Style.PROJECTION)
    absolute = simple(Abs, lambda k, c: abs(c.query(One(k.n))), style=Style.PROJECTION)
    after = simple(Next, lambda k, c: c.query(Abs(k.n)) + 1)
    use = simple(Use, lambda k, c: [c.query(Next(n)) for n in range(4)])
    engine.register(one, absolute, after, use)
    assert engine.query(Use()) == [2, 3, 4, 5]
    put(engine, v1=-2)
    assert engine.query(Use()) == [2, 3, 4, 5] and (absolute.runs, after.runs, use.runs) == (5, 4, 1)
    put(engine, v1=-7)
    assert engine.query(Use()) == [2, 8, 4, 5] and (absolute.runs, after.runs, use.runs) == (6, 5, 2)


def test_mixed_diamond(engine):
    (A,) = maps(engine, "MixA")
    Left, Wall, Right, Top = key_type("MixLeft"), no_field("MixWall"), key_type("MixRight"), no_field("MixTop")
    left = simple(Left, lambda k, c: c.query(A())[k.n], style=Style.PROJECTION)
    wall = simple(Wall, lambda k, c: {n: v // 10 for n, v in c.query(A()).items()}, style=Style.FIREWALL)
    right = simple(Right, lambda k, c: c.query(Wall())[k.n], style=Style.PROJECTION)
    top = simple(Top, lambda k, c: (c.query(Left(0)), c.query(Right(1)), c.query(Var(3))))
    engine.register(left, wall, right, top)
    assert engine.query(Top()) == (1, 0, 4)
    put(engine, v1=5)  # the second firewall and both slices hold
    assert engine.query(Top()) == (1, 0, 4) and (wall.runs, right.runs, top.runs) == (2, 1, 1)
    put(engine, v1=50)
    assert engine.query(Top()) == (1, 5, 4) and (right.runs, top.runs) == (2, 2)
    put(engine, v0=9, v3=8)
    assert engine.query(Top()) == (9, 5, 8) and top.runs == 3


def test_sandwich(engine):
    (A,) = maps(engine, "SandA")
    Lower, Middle, Upper, Use = key_type("SandLower"), no_field("SandMiddle"), key_type("SandUpper"), no_field("SandUse")
    lower = simple(Lower, lambda k, c: c.query(A())[k.n], style=Style.PROJECTION)
    middle = simple(Middle, lambda k, c: {n: c.query(Lower(n)) ** 2 for n in range(3)}, style=Style.FIREWALL)
    upper = simple(Upper, lambda k, c: c.query(Middle())[k.n], style=Style.PROJECTION)
    use = simple(Use, lambda k, c: c.query(Upper(0)) + c.query(Upper(2)))
    engine.register(lower, middle, upper, use)
    assert engine.query(Use()) == 10
    put(engine, v3=77)  # no slice that the second firewall reads
    assert engine.query(Use()) == 10 and (middle.runs, upper.runs, use.runs) == (1, 2, 1)
    put(engine, v0=-1)  # its square holds
    assert engine.query(Use()) == 10 and (middle.runs, use.runs) == (2, 1)
    put(engine, v1=5)  # a slice that nobody uses
    assert engine.query(Use()) == 10 and (middle.runs, use.runs) == (3, 1)
    put(engine, v2=4)
    assert engine.query(Use()) == 17 and use.runs == 2


# -- depth, failure and cancellation -----------------------------------------------


def test_long_chains(engine):
    Step = key_type("LongStep")
    step = simple(Step, lambda k, c: c.query(Step(k.n - 1)) + 1 if k.n else c.query(Var(0)))
    engine.register(step)
    put(engine, v0=5)
    assert engine.query(Step(2000)) == 2005
    put(engine, v0=6)
    assert engine.query(Step(2000)) == 2006 and step.runs == 4002


def test_a_failing_member_of_a_group_means_recompute(engine):
    Part, Whole = key_type("GroupPart"), no_field("GroupWhole")

    def part(k, c):
        value = c.query(Var(k.n))
        if value < 0:
            raise ValueError("negative")
        return value

    engine.register(simple(Part, part), simple(Whole, lambda k, c: sum(c.map([Part(n) for n in range(c.query(Var(9)))]))))
    put(engine, v0=1, v1=2, v2=3, v9=3)
    assert engine.query(Whole()) == 6
    put(engine, v2=-3, v9=2)
    assert engine.query(Whole()) == 3
    put(engine, v9=3)
    with pytest.raises(ValueError, match="negative"):
        engine.query(Whole())


def test_cancelled_contexts_leave_no_trace(engine):
    import threading
    import time

    from millrace.operators.engine import Cancelled

    Slow, Top = no_field("CancelSlow"), no_field("CancelTop")
    slow = simple(Slow, lambda k, c: c.spark.range(1).count() if not c.query(Var(0)) else c.spark.sql("select sum(a.id * b.id % 7) from range(40000) a cross join range(40000) b").first()[0])
    top = simple(Top, lambda k, c: c.query(Slow()) + 1)
    engine.register(slow, top)
    put(engine, v0=1)
    ctx, seen = engine.tracked(), []

    def ask():
        try:
            ctx.query(Top())
        except BaseException as e:
            seen.append(e)

    thread = threading.Thread(target=ask)
    thread.start()
    while not slow.runs:
        time.sleep(0.05)
    time.sleep(1)
    began = time.time()
    ctx.cancel()
    thread.join(60)
    ctx.close()
    assert not thread.is_alive() and time.time() - began < 30 and isinstance(seen[0], Cancelled)
    with pytest.raises(Cancelled):
        raise seen[0]
    put(engine, v0=0)
    assert engine.query(Top()) == 2 and not engine.running


def test_reopened_cycles_and_crashes(spark, tmp_path):
    from millrace.operators.engine import Engine

    A, B = no_field("ReopenA"), no_field("ReopenB")
    made = lambda: (simple(A, lambda k, c: c.query(B()) + 1, cycle_value=lambda: 7), simple(B, lambda k, c: c.query(A()) + 1, cycle_value=lambda: 9))
    path = str(tmp_path / "state")
    with Engine(spark, path) as e:
        e.register(*made())
        put(e, v0=1)
        assert (e.query(A()), e.query(B())) == (7, 9)
    with Engine(spark, path) as e:
        e.register(*made())
        assert e.recheck(A()) and e.recheck(B()) and len(e.graph.nodes) == 3
        files, folder = e.store.files, e.state.folder
    # A crash after the next state, before its manifest; and one before older ones are deleted.
    files.write(f"{folder}/state-99.jsonl", "half a li")
    assert len(Engine(spark, path).graph.nodes) == 3
    newest = max(n for n in files.names(folder) if n.startswith("manifest-"))
    files.write(f"{folder}/manifest-0.json", files.read(f"{folder}/{newest}"))
    with Engine(spark, path) as e:
        put(e, v0=2)
    with Engine(spark, path) as e:
        assert e.query(Var(0)) == 2 and len([n for n in files.names(folder) if not n.startswith(".")]) == 2
