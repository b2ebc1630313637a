"""Operators as declarative plans: SQL over named inputs, composed lazily into one DataFrame that Catalyst optimises as a whole.

A Plan names its inputs in braces and its settings in angle brackets. apply() binds inputs to DataFrames; as_sql() composes the same plans
into one statement of ordinary SQL, with common table expressions, for a check by another engine. Expressions keep to what both dialects
define alike. Settings are numbers of a config.Settings.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..config import Settings


@dataclass(frozen=True)
class Plan:
    name: str
    sql: str
    #: For the other engine, where a function's name differs: (here, there).
    dialect: tuple[tuple[str, str], ...] = field(default=())

    @property
    def inputs(self) -> list[str]:
        return list(dict.fromkeys(re.findall(r"\{(\w+)\}", self.sql)))

    def bound(self, values: dict[str, str]) -> str:
        return re.sub(r"<([a-z_]+)>", lambda m: values[m[1]], self.sql)


LIMIT = "spark.sql.codegen.hugeMethodLimit"


def store(df: DataFrame) -> DataFrame:
    """Writes df into the folder that driver and executors share and reads it back: plans stay short and lost executors cost nothing."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tramline-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/plan-{uuid.uuid4().hex}"
    # the JVM does not compile methods of more than 8000 bytes; plans with larger ones run faster in parts, outside of whole stages
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "8000")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(LIMIT, before)
    return spark.read.schema(df.schema).parquet(path)


#: Plans that several others read. Left in place, their copies would multiply along the chain; each is stored once in a run.
STORED = frozenset(("dedup_first", "conflict_islands", "nonconflict_sample", "events", "neighbor_roles", "event_rows", "slot_assignment", "ttc_obb_rows", "kinematics_by_pair", "tensor_rows"))
#: The same where scenes are dealt to tasks: no rows of tracks, pairs or windows, only what is counted or chosen from them.
STORED_BY_SCENE = frozenset(("conflict_frames", "conflict_islands", "nonconflict_sample", "windows_valid", "events", "seen", "ttc_center_kernel", "ttc_obb", "ttc_smoothness", "kinematics_compat"))


class Catalog:
    """Plans by name; the inputs that no plan makes are tables."""

    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        #: Texts, and helpers, that hold instead where scenes are dealt to tasks.
        self.by_scene: dict[str, Plan] = {}

    def add(self, name: str, sql: str, *dialect: tuple[str, str]) -> Plan:
        if name in self.plans:
            raise KeyError(f"plan {name} exists")
        self.plans[name] = Plan(name, sql.strip(), dialect)
        return self.plans[name]

    def scenes(self, name: str, sql: str) -> None:
        if name in self.by_scene:
            raise KeyError(f"plan {name} exists for scenes")
        self.by_scene[name] = Plan(name, sql.strip())

    def apply(self, spark: SparkSession, name: str, memo: dict[str, DataFrame] | None = None, settings: Settings | None = None, by_scene: bool = False, **bound: DataFrame) -> DataFrame:
        """The plan over the bound DataFrames; what is not bound is made by other plans, each of them once.

        memo: stored plans of earlier calls with the same inputs and settings, which are read again instead of being made again.
        by_scene: what is bound is dealt to tasks by scenes, as plans/scenes.py has it.
        """
        plans, stored = (self.plans | self.by_scene, STORED_BY_SCENE) if by_scene else (self.plans, STORED)
        memo = {} if memo is None else memo
        values = (settings or Settings()).values()
        if name in bound:
            return bound[name]
        if name not in plans:
            raise KeyError(f"no plan and no input {name}; plans: {sorted(plans)}")
        plan, made = plans[name], dict(bound)

        def make(of: str) -> DataFrame:
            if of in memo and of in stored and of not in made:
                made[of] = memo[of]
            if of not in made:
                p = plans.get(of)
                if p is None:
                    raise KeyError(f"{name} needs an input {of}")
                df = spark.sql(p.bound(values), **{i: make(i) for i in p.inputs})
                made[of] = store(df) if of in stored else df
                if of in stored:
                    memo[of] = made[of]
            return made[of]

        if by_scene and name in stored:
            return make(name)
        return spark.sql(plan.bound(values), **{i: make(i) for i in plan.inputs})

    def as_sql(self, name: str, settings: Settings | None = None) -> str:
        values = (settings or Settings()).values()
        order: list[str] = []

        def visit(of: str) -> None:
            if of in self.plans and of not in order:
                for i in self.plans[of].inputs:
                    visit(i)
                order.append(of)

        visit(name)

        def text(of: str) -> str:
            p = self.plans[of]
            sql = re.sub(r"\{(\w+)\}", r"\1", p.bound(values))
            for here, there in p.dialect:
                sql = sql.replace(here, there)
            return sql

        ctes = [f"{n} AS MATERIALIZED ({text(n)})" for n in order[:-1]]
        return (f"WITH {', '.join(ctes)} " if ctes else "") + f"SELECT * FROM ({text(name)}) AS q"


PLANS = Catalog()
