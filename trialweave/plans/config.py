"""A campaign's configuration: YAML or a dict, validated into levels."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

import yaml

from ..operators import adaptive  # noqa: F401  registers the adaptive samplers
from ..operators.runners import FunctionRunner, Runner, make_runner
from ..operators.samplers import Sampler, make_sampler

RUN_MODES = ("fresh", "resume", "extend")


@dataclass(frozen=True)
class Level:
    """One nesting level: a sampler of its own and the runners applied one after another."""

    sampler_name: str
    sampler: Sampler
    runners: list[Runner]


@dataclass(frozen=True)
class Campaign:
    levels: list[Level]
    base_run_dir: str
    run_mode: str = "fresh"
    log_failures: bool = False
    summary_datatype: str = "csv"
    hdf5: bool = False
    overflow: str = "discard"
    seed: int = 0
    raw: dict[str, Any] = field(default_factory=dict)


def load(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as file:
        config = yaml.safe_load(file)
    if not isinstance(config, dict):
        raise ValueError(f"{path} holds no mapping")
    return config | {"config_filepath": path}


def _listed(value: Any) -> list:
    return value if isinstance(value, list) else [value]


def _keep_files(runner: FunctionRunner, supervisor: dict[str, Any], base: str) -> None:
    """``save_files`` (all, custom or none; anything else is all), ``save_files_list`` and ``local_storage`` apply to programs' scratch folders.

    Files are kept under ``base``, which has to be a mounted folder; ValueError where it is a store such as s3a or hdfs.
    """
    if save := supervisor.get("save_files"):
        scheme, _, path = base.partition("://")
        if path and scheme == "file":
            base = path
        elif path and save != "none":
            # programs write plain files from the workers; only Spark reaches such a store
            raise ValueError(f"files of programs cannot be kept under {base}; give save_files: none, or a base_run_dir that all executors mount")
        runner.keep = save if save in ("custom", "none") else "all"
        runner.keep_files = set(supervisor.get("save_files_list") or ())
        runner.keep_dir = f"{base}/runs"
    runner.scratch_dir = supervisor.get("local_storage") or runner.scratch_dir


def parse(config: dict[str, Any]) -> Campaign:
    """``samplers``, ``runners`` and ``supervisor`` (run_order, base_run_dir, ...); ``executors`` are named but Spark's own.

    A sampler named at two levels has a fresh state at each.
    """
    supervisor = dict(config.get("supervisor") or {})
    order = supervisor.get("run_order")
    if not order:
        raise ValueError("supervisor.run_order is missing")
    base = supervisor.get("base_run_dir")
    if not base:
        raise ValueError("supervisor.base_run_dir is missing")
    mode = supervisor.get("run_mode", "fresh")
    if mode not in RUN_MODES:
        raise ValueError(f"run_mode must be one of {RUN_MODES}")
    samplers, runners, executors = (config.get(k) or {} for k in ("samplers", "runners", "executors"))
    levels = []
    for entry in order:
        names = _listed(entry.get("runners", entry.get("runner")))
        for kind, known, wanted in (("sampler", samplers, [entry["sampler"]]), ("runner", runners, names)):
            if missing := [n for n in wanted if n not in known]:
                raise ValueError(f"unknown {kind}: {missing}")
        named = [e for e in _listed(entry.get("executors", entry.get("executor"))) if e is not None]
        if len(named) not in (0, 1, len(names)):
            raise ValueError("a level names one executor, or one for each runner")
        if executors and (missing := [e for e in named if e not in executors]):
            raise ValueError(f"unknown executor: {missing}")
        made = [make_runner(n, runners[n]) for n in names]
        for r in made:
            if isinstance(r, FunctionRunner):
                _keep_files(r, supervisor, base)
        levels.append(Level(entry["sampler"], make_sampler(samplers[entry["sampler"]]), made))
    storage = config.get("storage") or {}
    return Campaign(
        levels, os.path.expandvars(base), mode, bool(supervisor.get("log_failures", False)), supervisor.get("summary_datatype", "csv"),
        hdf5=str(storage.get("type", "None")) != "None", overflow=supervisor.get("overflow", "discard"), seed=int(supervisor.get("seed", 0)), raw=config,
    )
