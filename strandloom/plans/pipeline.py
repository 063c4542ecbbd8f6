"""A thin pipeline runner: named steps over DataFrames, with a status file and resume.

Each step's result is written as Parquet under the output folder and read back, so
a run that stopped goes on after the last finished step. The folder may be on any
file system that the session knows; nothing is kept on the driver's own disk.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import assess, filters, intervals, probes, select, sets, variants
from ..sources.sinks import write_status
from .runtime import read_text, require


def step_clean(spark, tables, p):
    return variants.with_type(variants.valid_snps(tables["variants"], p.get("biallelic_only", False)))


def step_cluster(spark, tables, p):
    return variants.cluster_filter(tables["last"], p.get("flank", 60), p.get("most", 3), p.get("least", 1))


def step_regions(spark, tables, p):
    return intervals.covered(tables["last"], tables["regions"], p.get("keep", True), p.get("base", "one_based"))


def step_scores(spark, tables, p):
    from pyspark.sql import functions as F

    tests = [(c, filters.in_range(F.col(c), lo, hi)) for c, (lo, hi) in p["ranges"].items()]
    return filters.cascade(tables["last"], tests).filter("fail_reason is null").drop("fail_reason")


def step_select(spark, tables, p):
    how = p.get("strategy", "uniform")
    if how == "uniform":
        return select.select_uniform(tables["last"], p["total"], p.get("window", 10_000), p.get("seed", 42))
    if how == "random":
        return select.select_random(tables["last"], p["total"], ["chr", "pos", "ref", "alt"], p.get("seed", 42))
    if how == "weighted":
        return select.select_weighted(tables["last"], select.SCORES[:4], p.get("weights", [1, 1, 1, 1]), p.get("targets", select.TARGETS[:4]), p.get("per_window", 1), p.get("window", 10_000))
    if how == "priority":
        flagged = intervals.flag_covered(tables["last"], tables["regions"])
        return select.select_priority(flagged, "in_region", p.get("per_window", 1), p.get("window", 10_000), p.get("seed", 42))
    raise ValueError(f"unknown strategy {how}")


def step_build(spark, tables, p):
    return probes.cut_probes(tables["last"], tables["genome"], p.get("length", 81), p.get("shift", 0), p.get("replace_snp", False)).filter("reject is null").drop("reject")


def step_tile(spark, tables, p):
    """Windows of the sequences in the table named by ``of`` (the last result without it)."""
    return probes.tile_regions(tables[p.get("of", "last")], length=p.get("length", 81), step=p.get("by", 30))


def step_merge(spark, tables, p):
    """The last result and the tables named in ``with``: of each sequence the first one stays."""
    parts = [("last", tables["last"]), *[(name, tables[name]) for name in p["with"]]]
    for name, t in parts:
        require(t, "id", "seq")
    return sets.merge_dedup([(name, t.select("id", "seq")) for name, t in parts])[0]


def step_assess(spark, tables, p):
    """One row of statistics for each of the columns."""
    return assess.summary(tables["last"], p.get("columns", select.SCORES[:4]))


STEPS: dict[str, Callable] = {"clean": step_clean, "cluster": step_cluster, "regions": step_regions, "scores": step_scores, "select": step_select, "build": step_build, "tile": step_tile, "merge": step_merge, "assess": step_assess}


def load_config(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML file with ``steps``: a list of {"step": name, …parameters}."""
    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML needs the yaml package; use JSON") from e
        config = yaml.safe_load(text)
    else:
        config = json.loads(text)
    unknown = [s["step"] for s in config["steps"] if s["step"] not in STEPS]
    if unknown:
        raise ValueError(f"unknown step(s): {', '.join(unknown)}; have {', '.join(STEPS)}")
    return config


def run(spark: SparkSession, config: dict, tables: dict[str, DataFrame], out: str, resume: bool = False) -> DataFrame:
    """Runs the steps in order and returns the last result; ``tables`` names the inputs
    (variants, regions, genome, and those that steps name). With ``resume`` finished steps of
    an earlier run are read back. A failing step is recorded and raises."""
    folder = out.rstrip("/")
    status = f"{folder}/status.json"
    before = read_text(spark, status) if resume else None
    done = {s["place"] for s in json.loads(before)["steps"] if s["state"] == "done"} if before else set()
    state = [{"place": i, "step": s["step"], "state": "done" if i in done else "waiting"} for i, s in enumerate(config["steps"])]
    tables = dict(tables)
    for i, s in enumerate(config["steps"]):
        path = f"{folder}/{i:02d}_{s['step']}"
        if i not in done:
            try:
                STEPS[s["step"]](spark, tables, {k: v for k, v in s.items() if k != "step"}).write.mode("overwrite").parquet(path)
            except Exception as e:
                state[i] |= {"state": "failed", "error": str(e)[:500]}
                write_status(spark, status, state)
                raise
            state[i]["state"] = "done"
            write_status(spark, status, state)
        tables["last"] = spark.read.parquet(path)
    return tables["last"]
