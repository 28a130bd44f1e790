"""Analyses as incremental graphs, each driven through input sessions to a final state.

Every function takes (spark, sf_dir), sets inputs, asks, changes inputs and
asks again; what it returns must equal a query over the final state.  Tables
enter as references, never as copies; nodes hold aggregates.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.definition import Style, executor, query
from millrace.operators.engine import Context, Engine, SetResult
from millrace.plans import graph_frames
from millrace.sources.values import TableRef
from millrace.streaming import bridge


@query(name="catalog.Table", method="table", spread=True)
class Table:
    """A table of the data folder: set by a session, or read as it is."""

    name: str


@query(name="catalog.Setting", method="setting", spread=True)
class Setting:
    """A plain value."""

    name: str


def _node(name: str) -> type:
    return query(type(name, (), {"__annotations__": {}}), name=f"catalog.{name}")


def _keyed(name: str, kind: type = int) -> type:
    return query(type(name, (), {"__annotations__": {"k": kind}}), name=f"catalog.{name}")


def engine(spark: SparkSession) -> Engine:
    """An engine of its own below the cluster's shared folder."""
    graph_frames.shared_checkpoints(spark)
    return Engine(spark, f"{spark.sparkContext.getCheckpointDir()}/millrace-{uuid.uuid4().hex}", durable=False)


def ref(sf_dir: str, name: str, where: str | None = None, columns: tuple[str, ...] | None = None) -> TableRef:
    return TableRef(f"{sf_dir}/{name}.parquet", where=where, columns=columns)


def put(e: Engine, values: dict[object, object]) -> list[SetResult]:
    with e.session() as s:
        return [s.set_input(k, v) for k, v in values.items()]


def cents(column: str) -> Column:
    """Money as whole cents, so that sums do not depend on their order."""
    return F.round(F.expr(column) * 100).cast("long")


# -- the flagship: revenue by month ----------------------------------------

RevenueByMonth, TopMonth = _node("RevenueByMonth"), _node("TopMonth")


@executor(RevenueByMonth, style=Style.FIREWALL)
def revenue_by_month(key: object, ctx: Context) -> DataFrame:
    orders = ctx.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    lines = ctx.table("lineitem").select("l_orderkey", cents("l_extendedprice * (1 - l_discount)").alias("c"))
    # Lines are summed by order before the join, so the join moves one row an order.
    by_order = lines.groupBy("l_orderkey").agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    return orders.join(by_order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("month").agg(F.sum("c").alias("revenue_cents"), F.sum("n").alias("n_lines"))


@executor(TopMonth)
def top_month(key: object, ctx: Context) -> DataFrame:
    return ctx.query(RevenueByMonth()).orderBy(F.desc("revenue_cents"), "month").limit(12)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders up to a day first, all of them in a second session."""
    e = engine(spark).register(revenue_by_month, top_month)
    put(e, {Table("lineitem"): ref(sf_dir, "lineitem"), Table("orders"): ref(sf_dir, "orders", "o_orderdate < timestamp_ntz'1998-01-01'")})
    e.query(TopMonth())
    put(e, {Table("orders"): ref(sf_dir, "orders")})
    return e.query(TopMonth())


# -- evaluation and sessions -----------------------------------------------


def cold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    Named = _node("NationNames")

    @executor(Named)
    def names(key: object, ctx: Context) -> DataFrame:
        nation, region = ctx.table("nation"), ctx.table("region")
        return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")  # region: a fixed table of five rows

    e = engine(spark).register(names)
    put(e, {Table("nation"): ref(sf_dir, "nation"), Table("region"): ref(sf_dir, "region")})
    return e.query(Named())


def input_update_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    ByStatus = _node("OrdersByStatus")

    @executor(ByStatus)
    def by_status(key: object, ctx: Context) -> DataFrame:
        return ctx.table("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"), F.sum(cents("o_totalprice")).alias("total_cents"))

    e = engine(spark).register(by_status)
    put(e, {Table("orders"): ref(sf_dir, "orders", "o_orderkey % 2 = 0")})
    e.query(ByStatus())
    if put(e, {Table("orders"): ref(sf_dir, "orders")}) != [SetResult.UPDATED]:
        raise AssertionError("another predicate is another value")
    return e.query(ByStatus())


def input_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    Upper = _node("UpperRegion")
    e = engine(spark).register(executor(Upper)(lambda key, ctx: ctx.table("region").select("r_regionkey", F.upper("r_name").alias("r_name"))))
    put(e, {Table("region"): ref(sf_dir, "region")})
    e.query(Upper())
    if put(e, {Table("region"): ref(sf_dir, "region")}) != [SetResult.UNCHANGED] or e.dirtied_edges():
        raise AssertionError("an equal value must change nothing")
    return e.query(Upper())


def update_fn_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    Counts, Totals = _node("EventCounts"), _node("EventTotals")

    def part(where: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/events.parquet").where(where).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(cents("value")).alias("c"))

    @executor(Totals)
    def totals(key: object, ctx: Context) -> DataFrame:
        return ctx.query(Counts()).groupBy("event_type").agg(F.sum("n").alias("n_events"), F.sum("c").alias("value_cents"), F.count_distinct("day").alias("n_days"))

    e = engine(spark).register(totals)
    with e.session() as s:
        s.update(Counts(), lambda old: part("ts < timestamp_ntz'2024-01-16'"))
    e.query(Totals())
    with e.session() as s:
        s.update(Counts(), lambda old: old.unionByName(part("ts >= timestamp_ntz'2024-01-16'")))
    return e.query(Totals())


# -- repair ------------------------------------------------------------------


def safe_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads the divisor first; while it is 0 the division is not even looked at."""
    Division, Safe = _node("Division"), _node("SafeDivision")

    @executor(Division)
    def division(key: object, ctx: Context) -> DataFrame:
        d = ctx.setting("divisor")
        return ctx.table("lineitem").groupBy("l_returnflag").agg(F.expr(f"div(cast(sum(l_quantity) as long), {d})").alias("share"))

    @executor(Safe)
    def safe(key: object, ctx: Context) -> DataFrame:
        if ctx.setting("divisor") == 0:
            return ctx.table("lineitem").select("l_returnflag", F.lit(None).cast("long").alias("share")).distinct()
        return ctx.query(Division())

    e = engine(spark).register(division, safe)
    put(e, {Table("lineitem"): ref(sf_dir, "lineitem", columns=("l_returnflag", "l_quantity")), Setting("divisor"): 7})
    for d in (7, 0, 7):
        put(e, {Setting("divisor"): d})
        out = e.query(Safe())
    if division.runs != 1:
        raise AssertionError("an old result counts again when its inputs are back")
    return out


def abs_sum_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances change their sign; absolute sums do not change, so nothing above them runs."""
    Absolute, Total = _node("AbsoluteBalance"), _node("TotalBalance")

    @executor(Absolute)
    def absolute(key: object, ctx: Context) -> DataFrame:
        return ctx.table("customer").groupBy("c_mktsegment").agg(F.sum(F.abs(cents("c_acctbal") * ctx.setting("sign"))).alias("c"))

    @executor(Total)
    def total(key: object, ctx: Context) -> DataFrame:
        return ctx.query(Absolute()).select("c_mktsegment", F.col("c").alias("abs_cents"))

    e = engine(spark).register(absolute, total)
    put(e, {Table("customer"): ref(sf_dir, "customer", columns=("c_mktsegment", "c_acctbal")), Setting("sign"): 1})
    e.query(Total())
    put(e, {Setting("sign"): -1})
    out = e.query(Total())
    if (absolute.runs, total.runs) != (2, 1):
        raise AssertionError("no early cutoff")
    return out


def firewall_clamp_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by value, clamped, doubled: two firewalls in a chain."""
    Hist, Clamp, Double = _node("QuantityHistogram"), _node("ClampedHistogram"), _node("DoubledQuantity")

    @executor(Hist, style=Style.FIREWALL)
    def hist(key: object, ctx: Context) -> DataFrame:
        return ctx.table("lineitem").groupBy("l_returnflag", F.abs("l_quantity").cast("long").alias("q")).agg(F.count("*").alias("n"))

    @executor(Clamp, style=Style.FIREWALL)
    def clamp(key: object, ctx: Context) -> DataFrame:
        return ctx.query(Hist()).groupBy("l_returnflag", F.least("q", F.lit(40)).alias("q")).agg(F.sum("n").alias("n"))

    @executor(Double)
    def double(key: object, ctx: Context) -> DataFrame:
        return ctx.query(Clamp()).groupBy("l_returnflag").agg(F.sum(F.col("q") * 2 * F.col("n")).alias("doubled"))

    e = engine(spark).register(hist, clamp, double)
    for where in ("l_linenumber < 4", None):
        put(e, {Table("lineitem"): ref(sf_dir, "lineitem", where, None if where else ("l_returnflag", "l_quantity"))})
        out = e.query(Double())
    return out


def diamond_firewalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    Cust, Supp, Both = _node("CustomerBalance"), _node("SupplierBalance"), _node("NationBalance")

    @executor(Cust, style=Style.FIREWALL)
    def cust(key: object, ctx: Context) -> DataFrame:
        return ctx.table("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum(cents("c_acctbal")).alias("customer_cents"))

    @executor(Supp, style=Style.FIREWALL)
    def supp(key: object, ctx: Context) -> DataFrame:
        return ctx.table("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.sum(cents("s_acctbal")).alias("supplier_cents"))

    @executor(Both)
    def both(key: object, ctx: Context) -> DataFrame:
        return ctx.query(Cust()).join(ctx.query(Supp()), "nation", "full").select("nation", F.coalesce("customer_cents", F.lit(0)).cast("long").alias("customer_cents"), F.coalesce("supplier_cents", F.lit(0)).cast("long").alias("supplier_cents"))

    e = engine(spark).register(cust, supp, both)
    put(e, {Table("customer"): ref(sf_dir, "customer", "c_custkey % 3 = 0"), Table("supplier"): ref(sf_dir, "supplier")})
    e.query(Both())
    put(e, {Table("customer"): ref(sf_dir, "customer")})
    return e.query(Both())


def conditional_dep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read depends on a setting; it is switched off and on again."""
    Purchases, Shown = _node("Purchases"), _node("Shown")

    @executor(Purchases, style=Style.FIREWALL)
    def purchases(key: object, ctx: Context) -> DataFrame:
        return ctx.table("events").where("event_type = 'purchase'").groupBy(F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("n_events"))

    @executor(Shown)
    def shown(key: object, ctx: Context) -> DataFrame:
        if ctx.setting("show"):
            return ctx.query(Purchases())
        return ctx.spark.createDataFrame([(-1, 0)], "day int, n_events long")

    e = engine(spark).register(purchases, shown)
    put(e, {Table("events"): ref(sf_dir, "events")})
    for flag in (True, False, True):
        put(e, {Setting("show"): flag})
        out = e.query(Shown())
    return out


def projection_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One firewall, one projection for each nation; slices that stay equal are not recomputed."""
    Rev, Nation, All = _node("BalanceBySegment"), _keyed("NationSlice"), _node("AllNations")

    @executor(Rev, style=Style.FIREWALL)
    def revenue(key: object, ctx: Context) -> DataFrame:
        return ctx.table("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n_customers"), F.sum(cents("c_acctbal")).alias("cents"))

    @executor(Nation, style=Style.PROJECTION)
    def nation(key: object, ctx: Context) -> DataFrame:
        return ctx.slice(Rev(), "c_nationkey", key.k)

    @executor(All)
    def every(key: object, ctx: Context) -> DataFrame:
        keys = sorted(r[0] for r in ctx.query(Rev()).select("c_nationkey").distinct().collect())  # one row for each nation
        parts = ctx.map([Nation(k) for k in keys])
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("c_nationkey").agg(F.sum("n_customers").alias("n_customers"), F.sum("cents").alias("balance_cents"))

    e = engine(spark).register(revenue, nation, every)
    put(e, {Table("customer"): ref(sf_dir, "customer", "c_nationkey <> 3")})
    e.query(All())
    put(e, {Table("customer"): ref(sf_dir, "customer")})
    return e.query(All())


def mean_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean behind a firewall, differences and variance on top; whole numbers, truncating."""
    Mean, Variance = _node("Mean"), _node("Variance")

    @executor(Mean, style=Style.FIREWALL)
    def mean(key: object, ctx: Context) -> int:
        return ctx.table("part").agg(F.expr("div(sum(p_size), count(*))")).first()[0]

    @executor(Variance)
    def variance(key: object, ctx: Context) -> DataFrame:
        m = ctx.query(Mean())
        return ctx.table("part").agg(F.lit(m).cast("long").alias("mean_size"), F.expr(f"div(sum(cast((p_size - {m}) * (p_size - {m}) as long)), count(*))").alias("variance"))

    e = engine(spark).register(mean, variance)
    for where in ("p_partkey % 2 = 0", None):
        put(e, {Table("part"): ref(sf_dir, "part", where)})
        out = e.query(Variance())
    return out


def dynamic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types vanish and come back; each is a projection of one firewall."""
    Types, ByType, Sum = _node("TypeCounts"), _keyed("TypeCount", str), _node("TypeSum")

    @executor(Types, style=Style.FIREWALL)
    def types(key: object, ctx: Context) -> dict:
        return dict(ctx.table("events").groupBy("event_type").count().collect())  # one row for each type of event

    @executor(ByType, style=Style.PROJECTION)
    def by_type(key: object, ctx: Context) -> int | None:
        return ctx.query(Types()).get(key.k)

    @executor(Sum)
    def total(key: object, ctx: Context) -> DataFrame:
        rows = [(t, ctx.query(ByType(t))) for t in sorted(ctx.query(Types()))]
        return ctx.spark.createDataFrame(rows, "event_type string, n_events long")

    e = engine(spark).register(types, by_type, total)
    for where in (None, "event_type <> 'click'", None):
        put(e, {Table("events"): ref(sf_dir, "events", where)})
        out = e.query(Sum())
    return out


def external_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that is read once, and again on refresh only."""
    Source, Other, Langs = _keyed("DocumentFiles", str), _keyed("OtherFiles", str), _node("Languages")
    seen = {"where": "doc_id % 2 = 0"}
    source = executor(Source, style=Style.EXTERNAL)(lambda key, ctx: TableRef(key.k, where=seen["where"], columns=("lang", "n_chars")))
    other = executor(Other, style=Style.EXTERNAL)(lambda key, ctx: TableRef(key.k))

    @executor(Langs)
    def langs(key: object, ctx: Context) -> DataFrame:
        return ctx.query(Source(f"{sf_dir}/documents.parquet")).groupBy(F.upper("lang").alias("lang")).agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))

    e = engine(spark).register(source, other, langs)
    e.query(Langs())
    seen["where"] = None
    with e.session() as s:
        s.refresh(Other)
    e.query(Langs())
    if source.runs != 1:
        raise AssertionError("the refresh of another type must not read this one")
    with e.session() as s:
        s.refresh(Source)
    return e.query(Langs())


def scc_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions count their nations; one region and its count depend on each other and take their fallback."""
    Region, Count, All = _keyed("RegionValue"), _keyed("RegionCount"), _node("RegionValues")
    region = executor(Region, cycle_value=lambda: -1)(lambda key, ctx: ctx.query(Count(key.k)))

    @executor(Count, cycle_value=lambda: -2)
    def count(key: object, ctx: Context) -> int:
        if key.k == ctx.setting("cyclic"):
            return ctx.query(Region(key.k)) + 1
        return ctx.table("nation").where(F.col("n_regionkey") == key.k).count()

    @executor(All)
    def every(key: object, ctx: Context) -> DataFrame:
        return ctx.spark.createDataFrame([(k, ctx.query(Region(k)), ctx.query(Count(k))) for k in ctx.setting("regions")], "r_regionkey int, value long, n_nations long")

    e = engine(spark).register(region, count, every)
    put(e, {Table("nation"): ref(sf_dir, "nation"), Setting("regions"): list(range(5))})
    for c in (-1, 4, 2):
        put(e, {Setting("cyclic"): c})
        out = e.query(All())
    return out


def unordered_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve months, read in no particular order and so checked at the same time."""
    Month, Year = _keyed("MonthOrders"), _node("YearOrders")

    @executor(Month)
    def month(key: object, ctx: Context) -> DataFrame:
        return ctx.table("orders").where(F.month("o_orderdate") == key.k).agg(F.lit(key.k).alias("month"), F.count("*").alias("n_orders"), F.sum(cents("o_totalprice")).alias("total_cents"))

    @executor(Year)
    def year(key: object, ctx: Context) -> DataFrame:
        parts = ctx.map([Month(k) for k in range(1, 13)])
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    e = engine(spark).register(month, year)
    put(e, {Table("orders"): ref(sf_dir, "orders", columns=("o_orderdate", "o_totalprice"))})
    return e.query(Year())


def interned_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts counted once, by content hash; twice the same table is stored once."""
    Distinct, Again, Both = _node("DistinctTexts"), _node("DistinctTextsAgain"), _node("TextCounts")
    texts = lambda key, ctx: ctx.table("documents").groupBy("lang").agg(F.count("*").alias("n_rows"), F.count_distinct(F.md5("text")).alias("n_texts"))

    @executor(Both)
    def both(key: object, ctx: Context) -> DataFrame:
        return ctx.query(Distinct()).join(ctx.query(Again()).select("lang", F.col("n_texts").alias("again")), "lang").select("lang", "n_rows", "n_texts", (F.col("again") == F.col("n_texts")).alias("same"))

    e = engine(spark).register(executor(Distinct)(texts), executor(Again)(texts), both)
    put(e, {Table("documents"): ref(sf_dir, "documents", columns=("lang", "text"))})
    out = e.query(Both())
    if len({n.value.path for n in e.graph.nodes.values() if n.key in (Distinct(), Again())}) != 1:
        raise AssertionError("equal results share their files")
    return out


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events; every micro-batch is one session."""
    Counts, Days = _node("StreamedCounts"), _node("StreamedDays")

    @executor(Days)
    def days(key: object, ctx: Context) -> DataFrame:
        return ctx.query(Counts()).groupBy("day", "event_type").agg(F.sum("n").alias("n_events"))

    def fold(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))
        return new if old is None else old.unionByName(new).groupBy("day", "event_type").agg(F.sum("n").alias("n"))

    e = engine(spark).register(days)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    name = f"events_{uuid.uuid4().hex}"
    bridge.run(stream, e, Counts(), fold, name, f"{e.store.root}/stream", after=lambda: e.query(Days()) and None).awaitTermination()
    return e.query(Days())


def late_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of events; a tenth of the events come late, in a second stream, and are folded into windows long past."""
    Counts, Hours = _node("HourCounts"), _node("Hours")

    @executor(Hours)
    def hours(key: object, ctx: Context) -> DataFrame:
        return ctx.query(Counts()).groupBy("hour").agg(F.sum("n").alias("n_events"), F.sum("c").alias("value_cents"))

    def fold(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum(cents("value")).alias("c")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "n", "c")
        return new if old is None else old.unionByName(new).groupBy("hour").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))

    e = engine(spark).register(hours)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    for n, which in enumerate(("event_id % 10 <> 0", "event_id % 10 = 0")):
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").where(which)
        bridge.run(stream, e, Counts(), fold, f"late_{n}_{uuid.uuid4().hex}", f"{e.store.root}/stream{n}", after=lambda: e.query(Hours()) and None).awaitTermination()
    return e.query(Hours())


# -- further relational shapes ---------------------------------------------------


def _after_half(spark: SparkSession, sf_dir: str, name: str, half: str, f: Callable[[DataFrame, Context], DataFrame]) -> DataFrame:
    """An executor over one table that is set to half of its rows first, then to all."""
    Result = _node(f"{name}.{half}")
    e = engine(spark).register(executor(Result)(lambda key, ctx: f(ctx.table(name), ctx)))
    for where in (half, None):
        put(e, {Table(name): ref(sf_dir, name, where)})
        out = e.query(Result())
    return out


def window_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of value from each event of a user to the next, summed by type of event."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")

    def diffs(events: DataFrame, ctx: Context) -> DataFrame:
        c = cents("value")
        changed = events.select("event_type", (c - F.lag(c).over(by_user)).alias("d")).where("d is not null")
        return changed.groupBy("event_type").agg(F.count("*").alias("n_changes"), F.sum("d").alias("change_cents"), F.max("d").alias("most_cents"))

    return _after_half(spark, sf_dir, "events", "event_id % 2 = 0", diffs)


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's last view before it: one sort by user and time, no join."""
    past = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)

    def viewed(events: DataFrame, ctx: Context) -> DataFrame:
        view = F.when(F.col("event_type") == "view", F.col("event_id"))
        return events.where("event_type in ('view', 'purchase')").select("event_id", "event_type", F.last(view, ignorenulls=True).over(past).alias("view_id")).where("event_type = 'purchase'").select("event_id", "view_id")

    return _after_half(spark, sf_dir, "events", "event_id % 3 = 0", viewed)


def rollup_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    def totals(lines: DataFrame, ctx: Context) -> DataFrame:
        return lines.rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_lines"), F.sum(cents("l_extendedprice")).alias("price_cents"))

    return _after_half(spark, sf_dir, "lineitem", "l_linenumber < 4", totals)


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON text, by way of SQL."""

    def fields(events: DataFrame, ctx: Context) -> DataFrame:
        return ctx.spark.sql("select event_type, count(k) as n_keys, sum(k) as sum_k, min(k) as min_k, max(k) as max_k from (select event_type, cast(get_json_object(props, '$.k') as bigint) as k from {events}) group by event_type", events=events)

    return _after_half(spark, sf_dir, "events", "event_id % 5 = 0", fields)


def nested_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of times that differ by a microsecond are other values."""
    Times, Last = _node("NestedTimes"), _node("LastTimes")

    def times(micros: int) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.array(F.max("ts") + F.expr(f"make_dt_interval(0, 0, 0, {micros} / 1e6)")).alias("times"))

    e = engine(spark).register(executor(Last)(lambda key, ctx: ctx.query(Times()).select("event_type", F.date_format(F.get("times", F.lit(0)), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"))))
    for micros in (0, 1):
        put(e, {Times(): times(micros)})
        out = e.query(Last())
    return out


# -- graphs of rows ----------------------------------------------------------


def foreign_keys(spark: SparkSession, sf_dir: str) -> dict[tuple[str, str], DataFrame]:
    """Edges (caller, callee) by kinds: lineitem -> orders -> customer -> nation -> region; lines that agree in order and number are one."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    edge = lambda df, a, ka, b, kb: df.select(F.concat(F.lit(a), ka.cast("string")).alias("caller"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("callee"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber").distinct()
    parts = [(lines, "l", F.concat_ws("-", "l_orderkey", "l_linenumber"), "o", "l_orderkey"), (t("orders"), "o", F.col("o_orderkey"), "c", "o_custkey"), (t("customer"), "c", F.col("c_custkey"), "n", "c_nationkey"), (t("nation"), "n", F.col("n_nationkey"), "r", "n_regionkey")]
    return {(p[1], p[3]): edge(*p) for p in parts}


def _nations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"n": spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))}


def dirty_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = graph_frames.dirty_closure(foreign_keys(spark, sf_dir), {"r": spark.createDataFrame([("r2",)], "id string")})
    return marks.groupBy("step").agg(F.count("*").alias("n_edges"), F.count_distinct("callee").alias("n_callees"))


def firewall_boundary_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = graph_frames.dirty_closure(foreign_keys(spark, sf_dir), {"r": spark.createDataFrame([("r2",)], "id string")}, _nations(spark, sf_dir))
    return marks.select("caller", "callee", "step")


def tfc_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_frames.firewall_sets(foreign_keys(spark, sf_dir), _nations(spark, sf_dir)).groupBy("firewall").agg(F.count("*").alias("n_callers"))


def graph_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select(F.concat(F.lit("l"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("id"))
    return graph_frames.breadth_first(foreign_keys(spark, sf_dir), {"l": roots}).groupBy("depth").agg(F.count("*").alias("n_nodes"))


def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's own graph after its sessions, as nodes."""
    e = engine(spark).register(revenue_by_month, top_month)
    put(e, {Table("lineitem"): ref(sf_dir, "lineitem"), Table("orders"): ref(sf_dir, "orders")})
    e.query(TopMonth())
    nodes, _ = graph_frames.snapshot(e, TopMonth())
    return nodes.select("kind", "depth", "is_input", F.size("firewalls").alias("n_firewalls"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "top_month": flagship,
    **{f.__name__: f for f in (cold_lookup, input_update_agg, input_unchanged, update_fn_append, safe_division, abs_sum_cutoff, firewall_clamp_chain, diamond_firewalls, conditional_dep, projection_slices)},
    **{f.__name__: f for f in (mean_variance, dynamic_keys, external_refresh, scc_default, unordered_group, interned_dedup, stream_sessions, late_batch, window_diff, asof_join, rollup_sales, json_fields, nested_change, dirty_closure, firewall_boundary_closure, tfc_sets, graph_snapshot, graph_export)},
}

_FK = "with e as (select distinct 'l' || l_orderkey || '-' || l_linenumber as caller, 'o' || l_orderkey as callee from lineitem union all select 'o' || o_orderkey, 'c' || o_custkey from orders union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)"

SQL: dict[str, str] = {
    "top_month": "select strftime(o_orderdate, '%Y-%m') as month, sum(round(l_extendedprice * (1 - l_discount) * 100)::bigint)::bigint as revenue_cents, count(*) as n_lines from lineitem join orders on l_orderkey = o_orderkey group by 1 order by revenue_cents desc, month limit 12",
    "cold_lookup": "select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey",
    "input_update_agg": "select o_orderstatus, count(*) as n_orders, sum(round(o_totalprice * 100)::bigint)::bigint as total_cents from orders group by 1",
    "input_unchanged": "select r_regionkey, upper(r_name) as r_name from region",
    "update_fn_append": "select event_type, count(*) as n_events, sum(round(value * 100)::bigint)::bigint as value_cents, count(distinct ts::date) as n_days from events group by 1",
    "safe_division": "select l_returnflag, sum(l_quantity)::bigint // 7 as share from lineitem group by 1",
    "abs_sum_cutoff": "select c_mktsegment, sum(abs(round(c_acctbal * 100)::bigint))::bigint as abs_cents from customer group by 1",
    "firewall_clamp_chain": "select l_returnflag, sum(2 * least(abs(l_quantity)::bigint, 40))::bigint as doubled from lineitem group by 1",
    "diamond_firewalls": "select nation, coalesce(c, 0)::bigint as customer_cents, coalesce(s, 0)::bigint as supplier_cents from (select c_nationkey as nation, sum(round(c_acctbal * 100)::bigint)::bigint as c from customer group by 1) full join (select s_nationkey as nation, sum(round(s_acctbal * 100)::bigint)::bigint as s from supplier group by 1) using (nation)",
    "conditional_dep": "select day(ts)::int as day, count(*) as n_events from events where event_type = 'purchase' group by 1",
    "projection_slices": "select c_nationkey, count(*)::bigint as n_customers, sum(round(c_acctbal * 100)::bigint)::bigint as balance_cents from customer group by 1",
    "mean_variance": "with m as (select sum(p_size)::bigint // count(*) as mean_size from part) select any_value(mean_size) as mean_size, sum((p_size - mean_size) * (p_size - mean_size))::bigint // count(*) as variance from part, m",
    "dynamic_keys": "select event_type, count(*) as n_events from events group by 1",
    "external_refresh": "select upper(lang) as lang, count(*) as n_docs, sum(n_chars)::bigint as n_chars from documents group by 1",
    "scc_default": "select r_regionkey, case when r_regionkey = 2 then -1 else count(n_nationkey) end::bigint as value, case when r_regionkey = 2 then -2 else count(n_nationkey) end::bigint as n_nations from region left join nation on n_regionkey = r_regionkey group by 1",
    "unordered_group": "select month(o_orderdate)::int as month, count(*) as n_orders, sum(round(o_totalprice * 100)::bigint)::bigint as total_cents from orders group by 1",
    "interned_dedup": "select lang, count(*) as n_rows, count(distinct md5(text)) as n_texts, true as same from documents group by 1",
    "stream_sessions": "select ts::date::varchar as day, event_type, count(*)::bigint as n_events from events group by 1, 2",
    "late_batch": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, count(*)::bigint as n_events, sum(round(value * 100)::bigint)::bigint as value_cents from events group by 1",
    "window_diff": "with d as (select event_type, round(value * 100)::bigint - lag(round(value * 100)::bigint) over (partition by user_id order by ts, event_id) as d from events) select event_type, count(*) as n_changes, sum(d)::bigint as change_cents, max(d) as most_cents from d where d is not null group by 1",
    "asof_join": "with w as (select event_id, event_type, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as view_id from events where event_type in ('view', 'purchase')) select event_id, view_id from w where event_type = 'purchase'",
    "rollup_sales": "select l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::bigint as level, count(*) as n_lines, sum(round(l_extendedprice * 100)::bigint)::bigint as price_cents from lineitem group by rollup (l_returnflag, l_linestatus)",
    "json_fields": "select event_type, count(k) as n_keys, sum(k)::bigint as sum_k, min(k) as min_k, max(k) as max_k from (select event_type, regexp_extract(props, '\"k\": *(-?[0-9]+)', 1)::bigint as k from events) group by 1",
    "nested_change": "select event_type, strftime(max(ts) + interval 1 microsecond, '%Y-%m-%d %H:%M:%S.%f') as last_ts from events group by 1",
    "dirty_closure": _FK.replace("with e", "with recursive e") + ", r(caller, callee, step) as (select caller, callee, 1 from e where callee = 'r2' union all select e.caller, e.callee, r.step + 1 from e join r on e.callee = r.caller) select step, count(*) as n_edges, count(distinct callee) as n_callees from r group by 1",
    "firewall_boundary_closure": "select 'n' || n_nationkey as caller, 'r2' as callee, 1 as step from nation where n_regionkey = 2",
    "tfc_sets": "select firewall, sum(n)::bigint as n_callers from (select 'n' || c_nationkey as firewall, count(*) as n from customer group by 1 union all select 'n' || c_nationkey, count(*) from orders join customer on o_custkey = c_custkey group by 1 union all select 'n' || c_nationkey, count(distinct (l_orderkey, l_linenumber)) from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1) group by 1",
    "graph_snapshot": _FK.replace("with e", "with recursive e") + ", r(id, depth) as (select distinct 'l' || l_orderkey || '-' || l_linenumber, 0 from lineitem where l_returnflag = 'R' union select e.callee, r.depth + 1 from e join r on e.caller = r.id) select depth, count(*) as n_nodes from r group by 1",
    "graph_export": "select * from (values ('normal', 0, false, 1), ('firewall', 1, false, 0), ('input', 2, true, 0), ('input', 2, true, 0)) t(kind, depth, is_input, n_firewalls)",
}
