"""Registered queries that run the engine: whole campaigns, the store, control files, programs' files and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import adaptive, expand, samplers
from ..operators.runners import RUNNERS, ExampleProcessRunner, ExampleRunner, FunctionRunner, ProcessRunner, SumRunner
from ..sources import files, scans
from ..sources.store import Store
from ..streaming.micro_batch import commit_stream
from .config import load, parse
from .engine import Engine, run_campaign, run_sequence
from .progress import all_done
from .queries import query, table, unit_sql


def _folder(spark: SparkSession) -> str:
    """A fresh folder where executors can write; it goes when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="campaigns-")
    path = f"{shared}/campaign-{uuid.uuid4()}"
    files.delete_on_exit(spark, path)
    return path


def _random(budget: int, size: int, name: str = "c1", kind: str = "RandomSampler", **more) -> dict:
    return {"type": kind, "bounds": [[0, 1]], "parameters": [name], "budget": budget, "batch_size": size, "seed": 3, **more}


def _campaign(folder: str, levels: dict[str, dict], mode: str = "fresh", **supervisor) -> dict:
    """A campaign of one sum runner over samplers, one to a level."""
    runners = {"r": {"type": "SumRunner", "params_to_sum": ["c1", "c2"], "fail_if": 0.0, "tolerance": 0.25}}
    order = [{"sampler": name, "runner": "r"} for name in levels]
    return {"samplers": levels, "runners": runners, "supervisor": {"base_run_dir": folder, "run_mode": mode, "run_order": order, **supervisor}}


def _engine(spark: SparkSession, *args, **more) -> Engine:
    return Engine(spark, parse(_campaign(*args, **more)))


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


_C1 = unit_sql(3, "c1", "i")
_FAILS = f"abs({_C1}) < 0.25"


# --- resuming, extending, budgets ---------------------------------------------


@query(f"SELECT CAST(i // 10 AS BIGINT) AS batch, i % 10 AS sample, round({_C1}, 9) AS c1 FROM range(30) t(i)")
def resume_after_kill(spark, d):
    """A campaign that is killed after two of three batches and resumed: each run once."""
    folder = _folder(spark)
    try:
        _engine(spark, folder, {"s": _random(30, 10, kind="RandomSamplerWithKill", kill_after=2)}).run()
    except samplers.SamplerKilled:
        pass
    out = _engine(spark, folder, {"s": _random(30, 10, kind="RandomSamplerWithKill")}, "resume").run()
    return out.select(*_long("batch", "sample"), F.round("c1", 9).alias("c1"))


@query(f"SELECT CAST(i // 4 AS BIGINT) AS batch, i % 4 AS sample, round({_C1}, 9) AS c1 FROM range(12) t(i)")
def extend_campaign(spark, d):
    folder = _folder(spark)
    _engine(spark, folder, {"s": _random(8, 4)}).run()
    out = _engine(spark, folder, {"s": _random(8, 4)}, "extend").run({"s": 4})
    return out.select(*_long("batch", "sample"), F.round("c1", 9).alias("c1"))


@query("SELECT 'discard' AS overflow, CAST(b AS BIGINT) AS batch, CAST(4 AS BIGINT) AS submitted FROM range(2) t(b) UNION ALL SELECT 'truncate', b, least(4, 10 - 4 * b) FROM range(3) t(b)")
def budget_guard(spark, d):
    """Budget 10 in full batches of 4: a batch that would pass it is not run, or cut."""
    out = []
    for overflow in ("discard", "truncate"):
        engine = _engine(spark, _folder(spark), {"s": _random(10, 4)}, overflow=overflow)
        engine.run()
        out.append(engine.store.commit_table().select(F.lit(overflow).alias("overflow"), "batch", "submitted"))
    return expand.union_batches(out)


@query("SELECT CAST(depth AS BIGINT) AS depth, CAST(batch AS BIGINT) AS batch, CAST(submitted AS BIGINT) AS submitted FROM (VALUES (0, 1, 3), (1, 1, 2)) t(depth, batch, submitted)")
def resume_last_batch(spark, d):
    """The latest committed batch of each level, as a new reader of the store finds it."""
    engine = _engine(spark, _folder(spark), {"a": _random(6, 3), "b": _random(4, 2, "c2")})
    engine.run()
    rows = Store(spark, engine.store.base).commit_table()
    return rows.groupBy("depth").agg(F.max(F.struct("batch", "submitted")).alias("last")).select("depth", "last.batch", "last.submitted")


@query("SELECT CAST(b AS BIGINT) AS batch, i AS sample FROM range(2) t(b), range(5) u(i)")
def partial_batch_redone(spark, d):
    """Three of five runs were written, and no record: the batch is not there, and done again, once."""
    store = Store(spark, _folder(spark))
    points = spark.range(5).select(F.col("id").alias("sample"), F.lit(True).alias("success"))
    store.write(points, 0, 0)
    points.where("sample < 3").write.parquet(f"{store.base}/data/depth=0/batch=1")
    again = Store(spark, store.base)
    if len(again.commits(0)) != 1 or again.level(0).count() != 5:
        raise RuntimeError("a batch without a record counts")
    again.write(points, 0, 1)
    return Store(spark, store.base).level(0).select(*_long("batch", "sample"))


# --- records, reports, exports --------------------------------------------------


@query(f"SELECT CAST(0 AS BIGINT) AS depth, CAST(i // 20 AS BIGINT) AS batch, count(*) AS submitted, count(*) AS rows, CAST(count(*) FILTER (WHERE NOT {_FAILS}) AS BIGINT) AS successes FROM range(40) t(i) GROUP BY 2")
def run_state(spark, d):
    engine = _engine(spark, _folder(spark), {"s": _random(40, 20)})
    engine.run()
    return Store(spark, engine.store.base).commit_table()


@query(f"""
SELECT 'depth 0, batch ' || b || ': ' || n || ' runs, ' || ok || ' ok, ' || (n - ok) || ' failed, ' || printf('%.1f', 100.0::DOUBLE * ok / n) || ' %' AS line
FROM (SELECT i // 20 AS b, count(*) AS n, count(*) FILTER (WHERE NOT {_FAILS}) AS ok FROM range(40) t(i) GROUP BY 1)""")
def progress_lines(spark, d):
    engine = _engine(spark, _folder(spark), {"s": _random(40, 20)})
    engine.run()
    return spark.read.text(f"{engine.store.base}/all_progress.txt").select(F.col("value").alias("line"))


_RUNS = f"SELECT i AS sample, round({_C1}, 9) AS c1, NOT {_FAILS} AS success, CASE WHEN NOT {_FAILS} THEN round({_C1}, 9) END AS output, 'd0_b0_s' || i || '_r0' AS run_dir FROM range(50) t(i)"


def _summary(spark: SparkSession, **supervisor) -> tuple[DataFrame, str]:
    folder = _folder(spark)
    return run_campaign(spark, _campaign(folder, {"s": _random(50, 50)}, **supervisor)), folder


def _as_runs(rows: DataFrame) -> DataFrame:
    return rows.select("sample", F.round("c1", 9).alias("c1"), "success", F.round("output", 9).alias("output"), "run_dir")


@query(_RUNS)
def summary_csv(spark, d):
    out, folder = _summary(spark)
    return _as_runs(scans.summary(spark, f"{folder}/dataset_csv", out.schema))


@query(_RUNS)
def summary_parquet(spark, d):
    _, folder = _summary(spark, summary_datatype="parquet")
    return _as_runs(spark.read.parquet(f"{folder}/dataset_parquet"))


@query(f"SELECT 'd0_b0_s' || i || '_r0' AS run, round({_C1}, 9) AS value FROM range(50) t(i)")
def summary_long(spark, d):
    """The long export, of which one column comes back."""
    _, folder = _summary(spark)
    return spark.read.parquet(f"{folder}/dataset_long").where("column = 'c1'").select("run", F.round("value", 9).alias("value"))


@query("SELECT CAST(b AS BIGINT) AS batch, s AS sample, b * 5 + s AS parent FROM range(3) t(b), range(5) u(s) WHERE b * 5 + s < 13")
def parent_places(spark, d):
    """The rows of a level as parents of the next, numbered over all its batches."""
    engine = _engine(spark, _folder(spark), {"s": _random(13, 5)}, overflow="truncate")
    engine.run()
    return engine.store.parents(0).select(*_long("batch", "sample", "parent"))


@query(f"SELECT i % 5 AS sample, round({_C1}, 9) AS c1 FROM range(5, 10) t(i)")
def batch_scan(spark, d):
    engine = _engine(spark, _folder(spark), {"s": _random(15, 5)})
    engine.run()
    return engine.store.batch(0, 1).select("sample", F.round("c1", 9).alias("c1"))


@query("SELECT * FROM (VALUES ('all', true), ('one is missing', false), ('none', true)) t(runs, done)")
def all_done_check(spark, d):
    runs = spark.range(4).select(F.lit(True).alias("success"), "id")
    cases = [("all", runs), ("one is missing", runs.withColumn("success", F.when(F.col("id") > 0, F.col("success")))), ("none", runs.where("false"))]
    return spark.createDataFrame([(name, all_done(df)) for name, df in cases], "runs string, done boolean")


@query("SELECT * FROM (VALUES ('CPU Efficiency:', '97.5%'), ('Memory Utilized:', '1.2 GB'), ('Nodes:', '')) t(entry, value)")
def report_fields(spark, d):
    """What a report says after the first line that starts with each entry."""
    report = spark.createDataFrame([(["Job ID: 7", "CPU Efficiency: 97.5%", "Memory Utilized:  1.2 GB ", "CPU Efficiency: 1%"],)], "lines array<string>")
    return expand.union_batches([report.select(F.lit(e).alias("entry"), text.report_field(F.col("lines"), e).alias("value")) for e in ("CPU Efficiency:", "Memory Utilized:", "Nodes:")])


# --- configuration and names ----------------------------------------------------


@query("SELECT * FROM (VALUES (0, 'outer', 'RandomSampler', 'first,second'), (1, 'inner', 'GridSampler', 'first')) t(depth, sampler, class, runners)")
def config_levels(spark, d):
    """A YAML file, read and checked."""
    lines = [
        "samplers:", "  outer: {type: random_sampler, bounds: [[0, 1]], budget: 4, parameters: [c1]}", "  inner: {type: GridSampler, bounds: [[0, 1]], num_samples: 2, parameters: [c2]}",
        "runners:", "  first: {type: SumRunner, params_to_sum: [c1]}", "  second: {type: ExampleRunner}",
        "supervisor:", "  base_run_dir: /none", "  run_order:", "    - {sampler: outer, runner: [first, second]}", "    - {sampler: inner, runner: first}",
    ]
    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as file:  # read on the driver, where it is written
        file.write("\n".join(lines))
        file.flush()
        levels = parse(load(file.name)).levels
    rows = [(k, x.sampler_name, type(x.sampler).__name__, ",".join(r.name for r in x.runners)) for k, x in enumerate(levels)]
    return spark.createDataFrame(rows, "depth int, sampler string, class string, runners string")


@query("""
SELECT * FROM (VALUES ('grid_sampler', 'GridSampler'), ('GridSampler', 'GridSampler'), ('trialweave.operators.samplers:ArraySampler', 'ArraySampler'), ('nothing', NULL),
  ('sum_runner', 'SumRunner'), ('Process_Runner', 'ProcessRunner')) t(name, class)""")
def registry_names(spark, d):
    """Classes by either style of name, by module path, and a name that names nothing."""
    rows = []
    for registry, names in ((samplers.SAMPLERS, ["grid_sampler", "GridSampler", "trialweave.operators.samplers:ArraySampler", "nothing"]), (RUNNERS, ["sum_runner", "Process_Runner"])):
        for name in names:
            try:
                rows.append((name, registry.find(name).__name__))
            except ValueError:
                rows.append((name, None))
    return spark.createDataFrame(rows, "name string, class string")


@query("SELECT 'unknown distribution ' || chr(39) || 'other' || chr(39) AS error")
def unknown_distribution(spark, d):
    error = None
    try:
        samplers.RandomSampler([(0, 1)], 1, ["x"], distribution="other")
    except ValueError as e:
        error = str(e)
    return spark.createDataFrame([(error,)], "error string")


@query("SELECT n AS wanted, CAST(1 << CAST(floor(log2(n)) AS INTEGER) AS BIGINT) AS budget FROM range(1, 41) t(n)")
def sobol_budgets(spark, d):
    return spark.createDataFrame([(n, samplers.SobolSequenceSampler([(0, 1)], n, ["x"]).budget) for n in range(1, 41)], "wanted long, budget long")


# --- programs and their files -----------------------------------------------------


_DOUBLED = "SELECT i AS sample, CASE WHEN i % 10 = 3 THEN NULL ELSE 2.0::DOUBLE * i END AS output, i % 10 <> 3 AS success FROM range(200) t(i)"


@query(_DOUBLED)
def function_runner(spark, d):
    """A Python function per row; one that raises is a failed run."""

    def double(run_dir: str, params: dict) -> dict:
        if params["c1"] % 10 == 3:
            raise RuntimeError("three")
        return {"output": 2.0 * params["c1"], "success": True}

    rows = spark.range(200).select(F.col("id").alias("sample"), F.col("id").cast("double").alias("c1"))
    return FunctionRunner(double, name="f").apply(rows, ["c1"]).select("sample", "output", "success")


@query(_DOUBLED)
def process_runner(spark, d):
    """A program per row; one that ends with an error is a failed run."""
    rows = spark.range(200).select(F.col("id").alias("sample"), F.col("id").alias("c1"))
    runner = ProcessRunner(["sh", "-c", "[ $(({c1} % 10)) -ne 3 ] && echo $((2 * {c1}))"], name="p")
    return runner.apply(rows, ["c1"]).select("sample", "output", "success")


@query("SELECT i AS sample, 11.0::DOUBLE * i AS output, true AS success, true AS slept FROM range(16) t(i)")
def example_process(spark, d):
    """The example as a program that sleeps between 20 and 40 ms."""
    rows = spark.range(16).select(F.col("id").alias("sample"), F.lit(0.0).alias("c1"), F.col("id").cast("double").alias("c9"), (F.col("id") * 10.0).alias("c10"))
    out = ExampleProcessRunner(sleep_sec=[0.02, 0.04], name="e").apply(rows, ["c1", "c9", "c10"])
    return out.select("sample", "output", "success", (F.col("runtime_sec_e") >= 0.02).alias("slept"))


@query(f"SELECT o_orderkey, CASE WHEN {unit_sql(1, 'example_runner/fail', 'o_orderkey')} < 0.3 THEN 'RuntimeError: the run failed because it was unlucky, fail_prob:0.3' END AS error FROM orders")
def raised_failures(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.lit(1.0).alias("c1"), F.lit(2.0).alias("c2"))
    out = ExampleRunner(fail_prob=0.3, raise_failures=True).apply(rows, ["c1", "c2"], seed=1)
    return out.select(F.col("sample").alias("o_orderkey"), F.col("error_example_runner").alias("error"))


def _with_files(spark: SparkSession, folder: str, keep: str) -> None:
    """Runs that write a datapoint and a log; every third fails before."""

    def write(run_dir: str, params: dict) -> dict:
        if params["c1"] % 3 == 2:
            raise RuntimeError("no files")
        for name, content in (("datapoint.csv", f"output,success,x\n{params['c1'] / 2},True,{params['c1']}\n"), ("log.txt", "ok")):
            with open(f"{run_dir}/{name}", "w", encoding="utf-8") as file:
                file.write(content)
        return {"output": 0.0, "success": True}

    rows = spark.range(12).select(F.col("id").alias("sample"), F.col("id").alias("c1"))
    runner = FunctionRunner(write, keep=keep, keep_files=["datapoint.csv"], keep_dir="/" + folder.removeprefix("file:").lstrip("/"), name="f")
    run_sequence(rows, [runner]).write.format("noop").mode("overwrite").save()


@query("SELECT 'd0_b0_s' || i || '_r0' AS run_dir, i / 2.0::DOUBLE AS output, true AS success, i::DOUBLE AS x FROM range(12) t(i) WHERE i % 3 <> 2 AND contains('d0_b0_s' || i, 's1')")
def datapoint_scan(spark, d):
    """Run directories' datapoints, those with s1 in their names; failed runs have none."""
    folder = _folder(spark)
    _with_files(spark, folder, "all")
    return scans.datapoints(spark, folder, "output double, success boolean, x double", name_filter="s1").select("run_dir", "output", "success", "x")


@query("""
SELECT k.keep, 'd0_b0_s' || i || '_r0' AS run_dir, f.name FROM (VALUES ('all'), ('custom'), ('none')) k(keep), range(12) t(i), (VALUES ('datapoint.csv'), ('log.txt')) f(name)
WHERE i % 3 <> 2 AND (keep = 'all' OR (keep = 'custom' AND f.name = 'datapoint.csv'))""")
def kept_files(spark, d):
    rows = []
    for keep in ("all", "custom", "none"):
        folder = _folder(spark)
        _with_files(spark, folder, keep)
        rows += [(keep, run, name) for run in files.names(spark, folder) for name in files.names(spark, f"{folder}/{run}")]
    return spark.createDataFrame(rows, "keep string, run_dir string, name string")


@query("""
SELECT 'd0_b0_s' || i || '_r0' AS run_dir, i / 2.0::DOUBLE AS output, i::DOUBLE AS x FROM range(12) t(i) WHERE i % 3 <> 2 AND i <> 4 AND NOT contains('d0_b0_s' || i, 's1')
UNION ALL SELECT 'd0_b0_s4_r0', -1.0, 4.0""")
def history_ingest(spark, d):
    """An optimizer's observations: its own run, and those of a folder that it has not seen."""
    folder = _folder(spark)
    _with_files(spark, folder, "all")
    s = adaptive.BayesianOptimizationSampler([(0, 12)], ["x"], history=folder, history_skip=["s1"])
    own = spark.createDataFrame([("d0_b0_s4_r0", -1.0, True, 4.0)], "run_dir string, output double, success boolean, x double")
    return s.with_history(spark, own).select("run_dir", "output", "x")


# --- streams ------------------------------------------------------------------------


@query("SELECT o_orderkey AS sample, CASE WHEN abs(o_totalprice - 1000.0) >= 100 THEN o_totalprice END AS output, abs(o_totalprice - 1000.0) >= 100 AS success FROM orders")
def stream_committed(spark, d):
    """Orders as a stream of points, evaluated and committed once; starting the stream again finds nothing new."""
    folder = _folder(spark)
    points = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_totalprice").alias("c1"))
    points.write.parquet(f"{folder}/points")
    for _ in range(2):
        stream = spark.readStream.schema(points.schema).parquet(f"{folder}/points")
        runner = SumRunner(["c1"], fail_if=1000.0, tolerance=100.0, name="r")
        commit_stream(stream, [runner], Store(spark, f"{folder}/store"), f"{folder}/progress").awaitTermination()
    return Store(spark, f"{folder}/store").level(0).select("sample", "output", "success")
