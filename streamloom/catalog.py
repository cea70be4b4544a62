"""Named queries, each built as a graph and run through the planner, and their DuckDB SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from . import functions as fn
from . import operators as op
from . import sources as src
from .plans import Composite, Graph, ToAll, composite, only, run
from .streaming import BoundedStream, DailyWindow, StreamCount, StreamRunningCount, to_completion

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _read(sf_dir: str, name: str, *columns: str) -> src.Table:
    return src.Table(f"{sf_dir}/{name}.parquet", *columns)


def _line(spark, *nodes):
    return only(run(spark, Graph().pipeline(*nodes)))


# --- maps, filters, flat maps ---------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders")
def pipeline_identity(spark, d):
    return _line(spark, _read(d, "orders", "o_orderkey", "o_totalprice"), *[op.Identity() for _ in range(5)])


@query("SELECT l_orderkey, l_linenumber, ((l_quantity::BIGINT + 1) * 3) % 2 = 1 AS value FROM lineitem")
def chain_functions(spark, d):
    rows = op.Select("l_orderkey", "l_linenumber", "cast(l_quantity as bigint) as value")
    return _line(spark, _read(d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"), rows, op.chain([(fn.add, {"n": 1}), (fn.multiply, {"n": 3}), fn.is_odd]))


@query("SELECT l_orderkey, l_linenumber, floor(((l_quantity + 2) * 4) / 2) - 1 AS value FROM lineitem")
def chain_arithmetic(spark, d):
    rows = op.Select("l_orderkey", "l_linenumber", "l_quantity as value")
    steps = op.chain([(fn.add, {"n": 2}), (fn.multiply, {"n": 4}), (fn.divide, {"n": 2}), lambda c: F.floor(c).cast("double"), fn.subtract])
    return _line(spark, _read(d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"), rows, steps)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS l_extendedprice, l_discount FROM lineitem")
def apply_field(spark, d):
    """A function of one field that is given another one of its record."""
    node = op.ApplyField(lambda price, discount: F.round(price * (1 - discount), 4), "l_extendedprice", given={"discount": "l_discount"})
    return _line(spark, _read(d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), node)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0")
def filter_not_divisible(spark, d):
    return _line(spark, _read(d, "orders", "o_orderkey", "o_custkey"), op.Where(lambda df: fn.not_divisible(df["o_orderkey"], 3)))


@query("SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents")
def flatmap_words(spark, d):
    return _line(spark, _read(d, "documents", "doc_id", "text"), op.FlatMap("split(text, ' ', -1)", "word", keep=("doc_id",)))


_WORDS_SQL = r"""
WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
     words AS (SELECT unnest(string_split(regexp_replace(line, '^\s+|\s+$', '', 'g'), ' ')) AS word FROM lines)
SELECT word, count(*)::BIGINT AS "count" FROM words GROUP BY word
"""


def _line_nodes():
    """One row a line, then stripped: a compiled expression of rows, not of an array's elements."""
    return op.FlatMap(r"split(text, '\n', -1)", "line"), op.Select(r"regexp_replace(line, '^[\\s]++|(?<![\\s])[\\s]++$', '') as line")


@query(_WORDS_SQL)
def wordcount_by_group(spark, d):
    return _line(spark, _read(d, "documents", "text"), *_line_nodes(), op.Tokenise(), op.KeyedSum())


@query("SELECT o_orderkey, o_totalprice * 2 AS value FROM orders WHERE o_totalprice > 1000")
def python_function(spark, d):
    rows = op.Select("o_orderkey", "o_totalprice as value")
    return _line(spark, _read(d, "orders", "o_orderkey", "o_totalprice"), rows, op.PythonApply(lambda v: v * 2 if v > 1000 else None, "double"))


@query("SELECT 1 AS one, count(*) AS primes, max(p) AS largest FROM (SELECT a.i AS p FROM range(2, 1000) a(i) WHERE NOT EXISTS (SELECT 1 FROM range(2, 1000) b(i) WHERE b.i < a.i AND a.i % b.i = 0))")
def sieve(spark, d):
    g = Graph()
    numbers, stage, total = src.IntRange(2, 1000), op.Sieve(1000), op.Aggregate({"primes": "count(*)", "largest": "max(value)"})
    g.connect(numbers, "output", stage, "input").connect(stage, "prime", total, "input").connect(total, "output", one := op.Select("cast(1 as int) as one", "primes", "largest"), "input")
    return run(spark, g, results={one: ["output"]}).of(one)


def _draw_sql(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT"


@query(f"SELECT event_id, event_type FROM events WHERE {_draw_sql(1, 'event_id')} / 4503599627370496.0 < 0.5")
def bernoulli_filter(spark, d):
    return _line(spark, _read(d, "events", "event_id", "event_type"), op.Bernoulli(["event_id"], 0.5, seed=1))


@query(
    f"WITH w AS (SELECT i::BIGINT AS id, {list(src.WORDS)}[1 + {_draw_sql(3, 'i')} % {len(src.WORDS)}] AS word FROM range(1000) t(i))"
    f" SELECT id, word, row_number() OVER (PARTITION BY word ORDER BY id) AS n FROM w WHERE {_draw_sql(0, 'id')} / 4503599627370496.0 < 0.5"
)
def random_words_running(spark, d):
    words = src.RandomWords(seed=3)
    g = Graph().pipeline(words, op.Bernoulli(["id"], 0.5), op.RunningCount("word", ["id"]))
    return only(run(spark, g, {words: 1000}))


@query("SELECT n_nationkey, n_name FROM nation")
def delay(spark, d):
    return _line(spark, _read(d, "nation", "n_nationkey", "n_name"), op.Delay(0.001))


# --- graphs ----------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, 'cheap' AS branch FROM lineitem WHERE l_extendedprice < 20000 UNION ALL SELECT l_orderkey, l_linenumber, 'returned' FROM lineitem WHERE l_returnflag = 'R'")
def tee_two_branches(spark, d):
    g, table = Graph(), _read(d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    merged = op.Identity()
    for name, condition in (("cheap", "l_extendedprice < 20000"), ("returned", "l_returnflag = 'R'")):
        branch, tag = op.Where(condition), op.Select("l_orderkey", "l_linenumber", f"'{name}' as branch")
        g.connect(table, "output", branch, "input").connect(branch, "output", tag, "input").connect(tag, "output", merged, "input")
    return only(run(spark, g))


@query("SELECT 'F' || o_orderkey AS value FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'O' || o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def split_merge(spark, d):
    g, table = Graph(), _read(d, "orders", "o_orderkey", "o_orderstatus")
    split, merge = op.Split({"output0": "o_orderstatus = 'F'", "output1": "o_orderstatus = 'O'"}), op.ConcatPorts(["input0", "input1"])
    g.connect(table, "output", split, "input")
    for i in (0, 1):
        text = op.Select("concat(o_orderstatus, o_orderkey) as value")
        g.connect(split, f"output{i}", text, "input").connect(text, "output", merge, f"input{i}")
    return only(run(spark, g))


@query("SELECT o_orderkey, 'late' AS _port FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def projection_by_port(spark, d):
    g, table = Graph(), _read(d, "orders", "o_orderkey", "o_orderdate")
    split, tagged = op.Split({"old": "o_orderdate < timestamp_ntz'1997-01-01'", "new": "o_orderdate >= timestamp_ntz'1997-01-01'"}), op.Tagged(["a", "b"])
    renamed, out = op.RenamePorts({"b": "late"}), op.Select("o_orderkey", "_port")
    g.connect(table, "output", split, "input").connect(split, "old", tagged, "a").connect(split, "new", tagged, "b").pipeline(tagged, renamed, out)
    return only(run(spark, g))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def pick_port(spark, d):
    g, table = Graph(), _read(d, "orders", "o_orderkey", "o_orderdate")
    split, tagged = op.Split({"old": "o_orderdate < timestamp_ntz'1997-01-01'", "new": "o_orderdate >= timestamp_ntz'1997-01-01'"}), op.Tagged(["a", "b"])
    g.connect(table, "output", split, "input").connect(split, "old", tagged, "a").connect(split, "new", tagged, "b").pipeline(tagged, op.PickPort("b"), op.Select("o_orderkey"))
    return only(run(spark, g))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def fan_in_merge(spark, d):
    g, merged = Graph(), op.Identity()
    for condition in ("o_totalprice > 100000", "o_orderstatus = 'O'"):
        some, key = op.Where(condition), op.Select("o_orderkey")
        g.pipeline(_read(d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus"), some, key).connect(key, "output", merged, "input")
    return only(run(spark, g))


@query("SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders")
def duplicate_edge(spark, d):
    g, table, out = Graph(), _read(d, "orders", "o_orderkey"), op.Identity()
    g.connect(table, "output", out, "input").connect(table, "output", out, "input")
    return only(run(spark, g))


def scaled(factor: int):
    g, node = Graph(), op.chain([(fn.multiply, {"n": factor}), fn.add])
    g.add(node)
    return g, {"in": (node, "input")}, {"out": (node, "output")}


@query("SELECT p_partkey, (p_size * 2 + 1) * 3 + 1 AS value FROM part")
def composite_nested(spark, d):
    inner, outer = Graph(), Graph()
    a, b = composite(scaled, 2), composite(scaled, 3)
    inner.connect(a, "out", b, "in")
    both = Composite(inner, {"in": (a, "in")}, {"out": (b, "out")}, name="both")
    rows = op.Select("p_partkey", "p_size as value")
    outer.pipeline(_read(d, "part", "p_partkey", "p_size"), rows).connect(rows, "output", both, "in")
    return only(run(spark, outer))


@query("SELECT p_partkey AS id, 'part' AS kind FROM part UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def unconnected(spark, d):
    g = Graph().pipeline(_read(d, "part"), op.Select("p_partkey as id", "'part' as kind")).pipeline(_read(d, "supplier"), op.Select("s_suppkey as id", "'supplier' as kind"))
    first, second = run(spark, g).values()
    return first.unionByName(second)


@query("SELECT i::BIGINT AS value, port FROM range(1, 6) t(i), (VALUES ('output0'), ('output1')) p(port)")
def counter_ports(spark, d):
    g, counter = Graph(), src.Counter(2)
    g.add(counter)
    found = run(spark, g, {counter: 5})
    frames = [df.withColumn("port", F.lit(port)) for (_, port), df in found.items()]
    return frames[0].unionByName(frames[1])


# --- distribution ----------------------------------------------------------------------------------


@query("SELECT event_type, 1::BIGINT AS partitions FROM events GROUP BY event_type")
def group_by_routing(spark, d):
    dealt = op.Select("event_type", "spark_partition_id() as p", instances=8).group("input", ["event_type"])
    return _line(spark, _read(d, "events", "event_type"), dealt, op.Aggregate({"partitions": "count(distinct p)"}, keys=["event_type"]))


@query("SELECT 1::BIGINT AS partitions, count(*) AS n FROM events")
def global_routing(spark, d):
    dealt = op.Select("spark_partition_id() as p").group("input", "global")
    return _line(spark, _read(d, "events", "event_id"), dealt, op.Aggregate({"partitions": "count(distinct p)", "n": "count(*)"}))


@query("SELECT true AS balanced, count(*) AS n FROM events")
def shuffle_balance(spark, d):
    dealt = op.Select("spark_partition_id() as p", instances=5).group("input", "shuffle")
    per = op.Aggregate({"c": "count(*)"}, keys=["p"])
    return _line(spark, _read(d, "events", "event_id"), dealt, per, op.Aggregate({"balanced": "count(*) = 5 and max(c) - min(c) <= 5", "n": "sum(c)"}))


@query("SELECT n_nationkey, n_name, i::INT AS _instance FROM nation, range(3) t(i)")
def one_to_all(spark, d):
    return _line(spark, _read(d, "nation", "n_nationkey", "n_name"), op.Identity(instances=3).group("input", ToAll()))


@query("SELECT 3 AS instances, true AS apart, 3 * count(*) AS n FROM nation")
def one_to_all_dealt(spark, d):
    dealt = op.Select("_instance", "spark_partition_id() as p", instances=3).group("input", ToAll())
    per = op.Aggregate({"parts": "count(distinct p)", "lo": "min(p)", "c": "count(*)"}, keys=["_instance"])
    whole = op.Aggregate({"instances": "cast(count(distinct lo) as int)", "apart": "max(parts) = 1 and min(c) = max(c)", "n": "sum(c)"})
    return _line(spark, _read(d, "nation", "n_nationkey"), dealt, per, whole)


# --- aggregates ------------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM lineitem")
def parallel_count(spark, d):
    return _line(spark, _read(d, "lineitem", "l_orderkey"), op.Count())


@query("SELECT sum(l_quantity::DECIMAL(18,2))::DOUBLE AS s FROM lineitem")
def parallel_sum(spark, d):
    return _line(spark, _read(d, "lineitem", "l_quantity"), op.Select("cast(l_quantity as decimal(18,2)) as q"), op.Sum("q"), op.Select("cast(sum_q as double) as s"))


@query("SELECT min(l_extendedprice) AS min_l_extendedprice, min(l_shipdate) AS min_l_shipdate FROM lineitem")
def parallel_min(spark, d):
    return _line(spark, _read(d, "lineitem", "l_extendedprice", "l_shipdate"), op.Min("l_extendedprice", "l_shipdate"))


@query("SELECT max(l_extendedprice) AS max_l_extendedprice, max(l_shipdate) AS max_l_shipdate FROM lineitem")
def parallel_max(spark, d):
    return _line(spark, _read(d, "lineitem", "l_extendedprice", "l_shipdate"), op.Max("l_extendedprice", "l_shipdate"))


@query("SELECT round(avg(l_quantity), 6) AS avg_q, count(l_quantity) AS n, round(sum(l_quantity), 2) AS sum_q FROM lineitem")
def parallel_avg(spark, d):
    return _line(spark, _read(d, "lineitem", "l_quantity"), op.Average("l_quantity"), op.Select("round(avg_l_quantity, 6) as avg_q", "n", "round(sum_l_quantity, 2) as sum_q"))


@query("SELECT round(stddev_samp(l_quantity), 6) AS sd, count(*) AS n, round(sum(l_quantity), 2) AS s, round(sum(l_quantity * l_quantity), 2) AS sq FROM lineitem")
def parallel_stddev(spark, d):
    out = op.Select("round(stddev_l_quantity, 6) as sd", "n", "round(sum_l_quantity, 2) as s", "round(sum_sq_l_quantity, 2) as sq")
    return _line(spark, _read(d, "lineitem", "l_quantity"), op.StdDev("l_quantity"), out)


@query("SELECT 0::BIGINT AS n, 0::DOUBLE AS s, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::DOUBLE AS mean, NULL::DOUBLE AS sd")
def aggregate_empty(spark, d):
    x = "l_quantity"
    made = op.Aggregate({"n": f"count({x})", "s": f"coalesce(sum({x}), 0D)", "lo": f"min({x})", "hi": f"max({x})", "mean": f"avg({x})", "sd": f"stddev_samp({x})"})
    return _line(spark, _read(d, "lineitem", "l_quantity"), op.Where("false"), made)


@query("SELECT l_returnflag, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag")
def two_phase_aggregate(spark, d):
    made = op.TwoPhase({"c": "count(*)", "m": "max(l_quantity)"}, {"n": "sum(c)", "most": "max(m)"}, keys=["l_returnflag"])
    return _line(spark, _read(d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), made)


@query("SELECT event_type, max(value) - min(value) AS value FROM events GROUP BY event_type")
def python_aggregate(spark, d):
    return _line(spark, _read(d, "events", "event_type", "value"), op.PythonAggregate(lambda v: float(v.max() - v.min()), "value", "double", keys=["event_type"]))


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events")
def running_count_by_key(spark, d):
    return _line(spark, _read(d, "events", "event_id", "event_type", "ts"), op.RunningCount("event_type", ["ts", "event_id"]), op.Select("event_id", "event_type", "n"))


@query("SELECT event_id, (sum(value::DECIMAL(18,2)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS total FROM events")
def continuous_reduce(spark, d):
    made = op.Running({"total": F.col("value").cast("decimal(18,2)")}, ["ts", "event_id"])
    return _line(spark, _read(d, "events", "event_id", "ts", "value"), made, op.Select("event_id", "cast(total as double) as total"))


# --- Python nodes ----------------------------------------------------------------------------------


class FirstOfKey:
    """Sends the first value of its key at once, and how many there were at the end."""

    def __init__(self):
        self.count, self.key = 0, None

    def process(self, row):
        self.count += 1
        self.key = row["event_type"]
        return [("first", (row["event_type"], row["event_id"]))] if self.count == 1 else None

    def finish(self):
        return [("total", (self.key, self.count))]


def _element(d):
    g, table = Graph(), _read(d, "events", "event_type", "event_id", "ts")
    node = op.PythonNode(FirstOfKey, {"first": "event_type string, event_id bigint", "total": "event_type string, n bigint"}, keys=["event_type"], order=["ts", "event_id"])
    g.connect(table, "output", node, "input")
    return g, node


@query("SELECT event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type")
def udtf_keyed_state(spark, d):
    g, node = _element(d)
    return run(spark, g, results={node: ["first"]}).of(node, "first")


class RandomPair:
    """Sends one random number for every row to both of its ports."""

    def process(self, row):
        import random

        x = random.random()
        yield "left", (row["event_id"], x)
        yield "right", (row["event_id"], x)


@query("SELECT count(*) AS n, true AS agree FROM events")
def random_ports_agree(spark, d):
    """The body runs once for both ports, so what it drew is the same in them."""
    g, node = Graph(), op.PythonNode(RandomPair, {"left": "event_id bigint, x double", "right": "event_id bigint, y double"}).group("input", "shuffle")
    joined, same = op.Join("event_id"), op.Aggregate({"n": "count(*)", "agree": "bool_and(x = y)"})
    g.connect(_read(d, "events", "event_id"), "output", node, "input").connect(node, "left", joined, "left").connect(node, "right", joined, "right").pipeline(joined, same)
    return only(run(spark, g))


@query("SELECT event_type, count(*) * 10 AS n FROM events GROUP BY event_type")
def udtf_postprocess(spark, d):
    g, node = _element(d)
    later = op.Select("event_type", "n * 10 as n")
    g.connect(node, "total", later, "input")
    return run(spark, g, results={later: ["output"]}).of(later)


# --- sources and sinks -----------------------------------------------------------------------------


@query("SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b'), (3, NULL)) t(_0, _1)")
def list_source(spark, d):
    rows = src.Rows()
    return only(run(spark, Graph().pipeline(rows, op.Identity()), {rows: [(1, "a"), (2, "b"), (3, None)]}))


@query("SELECT i::BIGINT AS value FROM range(1, 21) t(i)")
def json_source(spark, d):
    counter = src.Counter(name="TestProducer")
    g = Graph().pipeline(counter, op.Identity())
    return only(run(spark, g, src.load_inputs(g, text='{"TestProducer": 20}')))


@query("SELECT i::BIGINT AS value FROM range(1, 21) t(i)")
def json_file_source(spark, d):
    import tempfile

    counter = src.Counter(name="TestProducer")
    g = Graph().pipeline(counter, op.Identity())
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        f.write('{"TestProducer": 20}')
        f.flush()
        return only(run(spark, g, src.load_inputs(g, file=f.name)))


@query("SELECT i::BIGINT AS value FROM range(5, 234) t(i)")
def int_range_source(spark, d):
    return _line(spark, src.IntRange(5, 234), op.Identity())


@query("SELECT (c + 1) * i AS _0 FROM range(3) a(c), range(10) b(i)")
def multiples_source(spark, d):
    numbers = src.Multiples(10)
    return only(run(spark, Graph().pipeline(numbers, op.Identity()), {numbers: 3}))


@query("SELECT i::BIGINT AS value FROM range(2), range(10) t(i)")
def burst_source(spark, d):
    burst = src.Burst(10)
    return only(run(spark, Graph().pipeline(burst, op.Identity()), {burst: 2}))


@query("SELECT i::BIGINT AS value FROM range(7) t(i)")
def iteration_source(spark, d):
    node = src.Iterations()
    return only(run(spark, Graph().pipeline(node, op.Identity()), {node: 7}))


@query("SELECT n_name AS line FROM nation")
def text_lines_source(spark, d):
    """Writes names as text in the shared folder and reads the lines back."""
    from .streaming.runner import state_folder

    path = f"{state_folder(spark)}/lines"
    with run(spark, Graph().pipeline(_read(d, "nation", "n_name"), op.Select("concat('  ', n_name, ' ') as value"), src.Write(path, "text"))) as written:
        written.execute()
    return _line(spark, src.TextLines(path), op.Identity())


@query("SELECT r_regionkey, r_name FROM region")
def partitioned_sink(spark, d):
    from .streaming.runner import state_folder

    path = f"{state_folder(spark)}/regions"
    with run(spark, Graph().pipeline(_read(d, "region", "r_regionkey", "r_name"), src.PerKeyFiles(path, "r_name"))) as written:
        written.execute()
    return _line(spark, _read_path(path), op.Select("r_regionkey", "r_name"))


def _read_path(path: str) -> src.Table:
    return src.Table(path)


# --- signals ---------------------------------------------------------------------------------------

_TRACE = "t AS (SELECT event_type AS trace_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n, value AS x FROM events)"


def _signal(spark, d, *nodes):
    trace = op.Select("event_type as trace_id", "ts", "event_id", "value as x")
    out = op.Select("trace_id", "n", "round(x, 6) + 0D as x")
    return _line(spark, _read(d, "events", "event_type", "ts", "event_id", "value"), trace, op.Numbered(["ts", "event_id"]), op.Select("trace_id", "n", "x"), *nodes, out)


@query(f"WITH {_TRACE} SELECT trace_id, n, round(x / (sum(abs(x)) OVER (PARTITION BY trace_id ORDER BY n ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) / 31), 6) + 0.0::DOUBLE AS x FROM t")
def mean_norm(spark, d):
    return _signal(spark, d, op.MeanNorm(15))


@query(f"WITH {_TRACE} SELECT trace_id, n, sign(x)::DOUBLE AS x FROM t")
def onebit_norm(spark, d):
    return _signal(spark, d, op.OneBit())


@query(f"WITH {_TRACE} SELECT trace_id, n, round(x - avg(x) OVER (PARTITION BY trace_id), 6) + 0.0::DOUBLE AS x FROM t")
def demean(spark, d):
    return _signal(spark, d, op.Demean())


@query(
    f"WITH {_TRACE}, e AS (SELECT trace_id, arg_min(x, n) AS a, arg_max(x, n) AS b, max(n) AS m FROM t GROUP BY trace_id)"
    " SELECT t.trace_id, n, round(x - a - (b - a) / m * n, 6) + 0.0::DOUBLE AS x FROM t JOIN e ON t.trace_id = e.trace_id"
)
def detrend_simple(spark, d):
    return _signal(spark, d, op.DetrendSimple())


@query(
    f"WITH {_TRACE}, e AS (SELECT trace_id, regr_slope(x, n) AS s, regr_intercept(x, n) AS i FROM t GROUP BY trace_id)"
    " SELECT t.trace_id, n, round(x - (i + s * n), 6) + 0.0::DOUBLE AS x FROM t JOIN e ON t.trace_id = e.trace_id"
)
def detrend_linear(spark, d):
    return _signal(spark, d, op.DetrendLinear())


@query(f"WITH {_TRACE} SELECT trace_id, n // 4 AS n, round(x, 6) + 0.0::DOUBLE AS x FROM t WHERE n % 4 = 0")
def decimate(spark, d):
    return _signal(spark, d, op.Decimate(4))


_GAIN_TERMS = " + ".join(f"{1 - j / 4} * (coalesce(lag(x * x, {j}) OVER w, 0) + coalesce(lead(x * x, {j}) OVER w, 0))" for j in (1, 2, 3))


@query(
    f"WITH {_TRACE}, r AS (SELECT trace_id, n, x, sqrt(x * x + {_GAIN_TERMS}) AS rms FROM t WINDOW w AS (PARTITION BY trace_id ORDER BY n))"
    " SELECT trace_id, n, round(x * rms / (rms * rms + 1e-12 * max(rms) OVER (PARTITION BY trace_id)), 6) + 0.0::DOUBLE AS x FROM r"
)
def gain_norm(spark, d):
    return _signal(spark, d, op.GainNorm(3.0, 1.0))


@query()
def spectral_whitening(spark, d):
    return _signal(spark, d, op.Whiten())


@query("SELECT event_type AS trace_id, 1.0::DOUBLE AS power FROM events GROUP BY event_type HAVING count(*) >= 256")
def whitening_power(spark, d):
    """A whitened trace whose length is a power of two has the power of a unit spectrum."""
    trace = op.Select("event_type as trace_id", "ts", "event_id", "value as x")
    first = op.Where(lambda df: (df["n"] < 256) & df["x"].isNotNull())
    power = op.Aggregate({"power": "round(sum(x * x), 6)", "c": "count(*)"}, keys=["trace_id"])
    whole, out = op.Where(lambda df: df["c"] == 256), op.Select("trace_id", "power")
    return _line(spark, _read(d, "events", "event_type", "ts", "event_id", "value"), trace, op.Numbered(["ts", "event_id"]), op.Select("trace_id", "n", "x"), first, op.WhitenSmooth(), power, whole, out)


_LOW, _HIGH, _CYCLES = 0.02, 0.2, (5, 20, 50, 200, 400)


@query(
    f"WITH f AS (SELECT k::BIGINT AS trace_id, k / 1000.0 AS f FROM (SELECT unnest({list(_CYCLES)}) AS k))"
    f" SELECT trace_id, round(1 / (1 + ({_LOW} / f) ** 8) / (1 + (f / {_HIGH}) ** 8), 6) AS power FROM f"
)
def bandpass_gain(spark, d):
    """The power that a band-pass leaves of sine waves below, in and above its band."""
    waves = spark.range(1000).selectExpr(f"explode(array({', '.join(f'{k}L' for k in _CYCLES)})) as trace_id", "id as n").selectExpr("trace_id", "n", "sqrt(2D) * sin(2 * pi() * trace_id * n / 1000) as x")
    return _line(spark, src.Table(waves), op.Bandpass(_LOW, _HIGH, 1.0), op.Aggregate({"power": "round(avg(x * x), 6)"}, keys=["trace_id"]))


@query()
def bandpass_filter(spark, d):
    return _signal(spark, d, op.Bandpass(0.01, 0.1, 1.0))


# --- streams ---------------------------------------------------------------------------------------


def _stream(spark, d, name):
    """A table as a stream: all files of its folder or, if it is one file, that one of the folder it is in."""
    path = f"{d}/{name}.parquet"
    table = spark.read.parquet(path)
    files = [f.split("/")[-2:] for f in table.inputFiles()]
    if len(files) == 1 and files[0][1] == f"{name}.parquet" != files[0][0]:
        return BoundedStream(d, f"{name}.parquet", table.schema)
    return BoundedStream(path, None, table.schema)


@query(SQL["running_count_by_key"])
def stream_running_count(spark, d):
    g = Graph().pipeline(_stream(spark, d, "events"), op.Select("event_id", "event_type", "ts"), StreamRunningCount("event_type", ["ts", "event_id"]), op.Select("event_id", "event_type", "n"))
    return to_completion(spark, g)


@query(_WORDS_SQL)
def stream_wordcount(spark, d):
    g = Graph().pipeline(_stream(spark, d, "documents"), op.Select("text"), *_line_nodes(), op.Tokenise(), StreamCount("word", name="count"))
    return to_completion(spark, g, mode="complete")


@query(
    "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL"
)
def stream_daily_window(spark, d):
    g = Graph().pipeline(_stream(spark, d, "events"), op.Select("ts", "event_type", "value"), DailyWindow("ts", "event_type", "value"))
    return to_completion(spark, g, mode="complete")


# --- extensions --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def extension_join(spark, d):
    g, orders, customer = Graph(), _read(d, "orders", "o_orderkey", "o_custkey", "o_totalprice"), _read(d, "customer", "c_custkey", "c_name")
    some, join, out = op.Where("o_totalprice > 200000"), op.Join(F.expr("o_custkey = c_custkey")), op.Select("o_orderkey", "c_name")
    g.connect(orders, "output", some, "input").connect(some, "output", join, "left").connect(customer, "output", join, "right").connect(join, "output", out, "input")
    return only(run(spark, g))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def extension_top_k(spark, d):
    return _line(spark, _read(d, "orders", "o_orderkey", "o_totalprice"), op.TopK(10, "o_totalprice desc", "o_orderkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def extension_except(spark, d):
    g, minus = Graph(), op.SetOperation("except")
    a, b = op.Select("o_custkey as k"), op.Select("c_custkey as k")
    low = op.Where("c_acctbal < 0")
    g.pipeline(_read(d, "orders", "o_custkey"), a).pipeline(_read(d, "customer", "c_custkey", "c_acctbal"), low, b).connect(a, "output", minus, "left").connect(b, "output", minus, "right")
    return only(run(spark, g))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def extension_sql(spark, d):
    g, nation = Graph(), _read(d, "nation", "n_regionkey")
    node = op.SqlNode("SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey", ["nation"])
    g.connect(nation, "output", node, "nation")
    return only(run(spark, g))
