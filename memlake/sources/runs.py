"""Results of benchmark runs: nested JSON files to rows, with what can't be read beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read of a file; other fields are passed over.
RESULT = (
    "arm string, environment struct<provider: string, model: string, judgeProvider: string, judgeModel: string, scenarioFiles: array<string>, extMode: string, extDrivers: int, extSnapshot: string, pluginVersion: string>, scenarios array<struct<id: string, kind: string, checks: array<struct<name: string, ok: boolean>>, "
    "probes: array<struct<id: string, type: string, q: string, gold: array<string>, stale: array<string>, hit: boolean, tools: int, recall: struct<lines: array<string>>>>>>"
)
DAMAGED = "_damaged"
PATH = r"([^/]+)/(rep-\d+)/result\.json$"


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every `<run>/rep-N/result.json` in a folder, whole."""
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="result.json")
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def env_key(e: Column) -> Column:
    """What two runs must have in common to be compared: models, judges, scenarios, and the form of external memory."""
    part = lambda name, other="": F.coalesce(e[name].cast("string"), F.lit(other))
    files = F.coalesce(F.array_join(e["scenarioFiles"], ","), F.lit(""))
    external = F.concat(F.lit("ext="), part("extMode", "off"), F.lit("/"), part("extDrivers", "0"), F.lit("/"), part("extSnapshot"))
    return F.concat_ws("|", F.concat_ws("/", part("provider"), part("model")), F.concat_ws("/", part("judgeProvider"), part("judgeModel")), files, external)


def scan_runs(files: DataFrame, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files (path, text) as (runs, faults): runs (run, rep, arm, external, env_key, scenarios), and (run, rep, fault) of what gives none.

    A file is damaged if it isn't an object of the stated schema, empty without text, and unnamed if its path isn't `<run>/rep-N/result.json`; it then gives no
    rows, and doesn't stop the others. expected (run, rep), if given, are those that should be there; the others of them are missing. A run without an arm is of arm A.
    """
    named = files.select("path", F.regexp_extract("path", PATH, 1).alias("run"), F.regexp_extract("path", PATH, 2).alias("rep"), "text")
    parsed = named.withColumn("r", F.from_json("text", f"{RESULT}, {DAMAGED} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": DAMAGED}))
    empty = ~F.coalesce("text", F.lit("")).rlike(r"\S")
    broken = F.col(f"r.{DAMAGED}").isNotNull() | F.col("r").isNull() | ~F.coalesce("text", F.lit("")).rlike(r"^\s*\{")
    told = parsed.withColumn("fault", F.when(F.col("rep") == "", "unnamed").when(empty, "empty").when(broken, "damaged"))
    good = told.where("fault is null")
    runs = good.select("run", "rep", F.coalesce("r.arm", F.lit("A")).alias("arm"), F.coalesce("r.environment.extMode", F.lit("off")).alias("external"), env_key(F.col("r.environment")).alias("env_key"), F.coalesce("r.scenarios", F.from_json(F.lit("[]"), RESULT.split("scenarios ", 1)[1])).alias("scenarios"))
    faults = told.where("fault is not null").select(F.when(F.col("fault") == "unnamed", F.col("path")).otherwise(F.col("run")).alias("run"), "rep", "fault")
    if expected is not None:
        faults = faults.union(expected.select("run", "rep").distinct().join(told.select("run", "rep"), ["run", "rep"], "left_anti").select("run", "rep", F.lit("missing")))
    return runs, faults


def scenarios(runs: DataFrame) -> DataFrame:
    return runs.select("run", "rep", "arm", "external", F.posexplode("scenarios").alias("s", "x")).select("run", "rep", "arm", "external", "s", F.col("x.id").alias("scenario"), F.col("x.kind").alias("kind"), "x.checks", "x.probes")


def probes(runs: DataFrame) -> DataFrame:
    """(run, rep, arm, external, scenario, probe_id, type, q, gold, stale, hit, tools, lines) of the probes of scenarios that are no workflows; lists that aren't there are empty. probe_id tells all probes apart."""
    none = F.array().cast("array<string>")
    each = scenarios(runs).where(F.coalesce("kind", F.lit("")) != "workflow").select("run", "rep", "arm", "external", "scenario", "s", F.posexplode("probes").alias("p", "x"))
    listed = lambda c: F.filter(F.coalesce(F.col(f"x.{c}"), none), lambda t: t.isNotNull())
    return each.select("run", "rep", "arm", "external", "scenario", F.concat_ws("/", "run", "rep", "s", "p").alias("probe_id"), "x.type", "x.q", listed("gold").alias("gold"), listed("stale").alias("stale"), "x.hit", F.coalesce("x.tools", F.lit(0)).alias("tools"), listed("recall.lines").alias("lines"))


def checks(runs: DataFrame) -> DataFrame:
    """(run, rep, arm, scenario, name, ok) of the checks of workflows."""
    each = scenarios(runs).where("kind = 'workflow'").select("run", "rep", "arm", "scenario", F.explode("checks").alias("x"))
    return each.select("run", "rep", "arm", "scenario", "x.name", F.coalesce("x.ok", F.lit(False)).alias("ok"))
