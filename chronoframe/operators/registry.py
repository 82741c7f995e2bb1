"""Feature registry operators.

The registry is a dimension table: one row per (name, version) definition.
Operators are set-wise; a registration is a full outer merge that produces
the next registry version (write it to a new directory, then switch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ts_lit
from ..schemas import DEFINITION
from .numbering import number_rows

DEF_COLS = ["name", "version", "dtype", "entity_type", "ttl_hours", "description", "tags"]
REG_COLS = ["feature_id"] + DEF_COLS + ["created_at", "updated_at"]


def load_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Definitions from JSON lines, one object per definition; absent
    fields are NULL and get their defaults on registration."""
    return spark.read.schema(DEFINITION).json(path)


def normalize_definitions(defs: DataFrame) -> DataFrame:
    """Apply the definition defaults: version 1, ttl 24 h, description '',
    tags NULL -> [] (V1 defaults, E11)."""
    cols = set(defs.columns)

    def opt(name, default):
        return F.coalesce(F.col(name), default) if name in cols else default

    out = defs.select(
        F.col("name").cast("string").alias("name"),
        opt("version", F.lit(1)).cast("int").alias("version"),
        F.col("dtype").cast("string").alias("dtype") if "dtype" in cols else F.lit(None).cast("string").alias("dtype"),
        F.col("entity_type").cast("string").alias("entity_type") if "entity_type" in cols
        else F.lit(None).cast("string").alias("entity_type"),
        opt("ttl_hours", F.lit(24)).cast("int").alias("ttl_hours"),
        opt("description", F.lit("")).cast("string").alias("description"),
        opt("tags", F.array().cast("array<string>")).alias("tags"),
        *([F.col("def_seq").cast("long")] if "def_seq" in cols else []),
    )
    return out


def validate_definitions(defs: DataFrame) -> DataFrame:
    """V1: adds ``violations ARRAY<STRING>`` and ``valid BOOLEAN``."""
    d = normalize_definitions(defs)
    checks = [
        (F.col("name").isNull() | (F.length("name") < 1), "name_empty"),
        (F.length("name") > 255, "name_too_long"),
        (F.col("version") < 1, "version_lt_1"),
        (F.col("ttl_hours") < 1, "ttl_lt_1"),
        (F.col("dtype").isNull(), "dtype_missing"),
        (F.col("entity_type").isNull(), "entity_type_missing"),
    ]
    viol = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())
    return d.withColumn("violations", viol).withColumn("valid", F.size("violations") == 0)


def _dedupe_definitions(defs: DataFrame) -> DataFrame:
    """One definition per (name, version); with ``def_seq`` the last wins,
    otherwise the choice is the deterministic max of the row."""
    payload = F.struct(*[F.col(c) for c in DEF_COLS if c not in ("name", "version")])
    if "def_seq" in defs.columns:
        agg = F.max_by(payload, F.col("def_seq"))
    else:
        agg = F.max(payload)
    return defs.groupBy("name", "version").agg(agg.alias("d")).select("name", "version", "d.*")


def register(registry: DataFrame, definitions: DataFrame, as_of) -> DataFrame:
    """Upsert definitions keyed by (name, version).

    New keys get ids ``max(id) + 1, 2, ...`` in (name, version) order and
    ``created_at = updated_at = as_of``; existing keys keep id and created_at,
    take the new dtype/entity_type/ttl/description/tags and move updated_at.
    Invalid definitions (V1) are not applied.  The new keys are numbered in
    range partitions, so a large load of definitions goes through no single task.
    """
    t = ts_lit(as_of)
    payload = ["dtype", "entity_type", "ttl_hours", "description", "tags"]
    new = _dedupe_definitions(validate_definitions(definitions).where("valid"))
    old = registry.select(*REG_COLS)
    fresh = number_rows(new.join(old.select("name", "version"), ["name", "version"], "left_anti"), ["name", "version"], "_n")
    top = old.agg(F.max("feature_id")).first()[0] or 0
    n = new.select("name", "version", F.struct(*payload).alias("n"))
    has_new = F.col("n").isNotNull()
    kept = old.join(n, ["name", "version"], "left").select(
        "feature_id", "name", "version",
        *[F.when(has_new, F.col("n")[c]).otherwise(F.col(c)).alias(c) for c in payload],
        "created_at", F.when(has_new, t).otherwise(F.col("updated_at")).alias("updated_at"))
    added = fresh.select((F.col("_n") + top).cast("int").alias("feature_id"), "name", "version", *payload,
                         t.alias("created_at"), t.alias("updated_at"))
    return kept.select(*REG_COLS).unionByName(added.select(*REG_COLS))


def register_with_rejects(registry: DataFrame, definitions: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """G1 with V1's other half: the next registry, and the definitions that
    were not applied with their violations."""
    return register(registry, definitions, as_of), validate_definitions(definitions).where("not valid").drop("valid")


def resolve(registry: DataFrame, names=None, version: int | None = None) -> DataFrame:
    """By name (and version); version None or 0 -> latest."""
    r = registry
    if names is not None:
        r = r.where(F.col("name").isin(list(names) if not isinstance(names, str) else [names]))
    if version:
        return r.where(F.col("version") == version)
    return latest_versions(r)


def latest_versions(registry: DataFrame) -> DataFrame:
    """T3 set-wise: the highest version row per name."""
    cols = [c for c in registry.columns if c != "name"]
    return registry.groupBy("name").agg(F.max_by(F.struct(*cols), F.col("version")).alias("r")) \
        .select("name", "r.*").select(*registry.columns)


def list_features(registry: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Optional entity_type filter, ordered by (name, version)."""
    r = registry if entity_type is None else registry.where(F.col("entity_type") == entity_type)
    return r.orderBy("name", "version")


def get_by_id(registry: DataFrame, feature_id: int) -> DataFrame:
    """F7/G4."""
    return registry.where(F.col("feature_id") == feature_id)


def metadata_view(registry: DataFrame) -> DataFrame:
    """The public columns of a definition."""
    return registry.select("feature_id", "name", "version", "dtype", "entity_type",
                           "ttl_hours", "description", "tags", "created_at", "updated_at")


def tag_search(registry: DataFrame, any_of=None, all_of=None) -> DataFrame:
    """definitions whose tags overlap ``any_of`` / contain ``all_of``."""
    r = registry
    if any_of:
        r = r.where(F.arrays_overlap(F.col("tags"), F.array(*[F.lit(t) for t in any_of])))
    for t in all_of or []:
        r = r.where(F.array_contains(F.col("tags"), t))
    return r


def expand_members(members: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J7 for groups of any size, one row per member: (``members`` with their latest definition, NULL where
    none; those without one)."""
    latest = (latest_versions(registry).select(
        F.col("name").alias("member"), "feature_id", "version", "dtype", "entity_type"))
    return members.join(latest, "member", "left"), members.join(latest.select("member"), "member", "left_anti")


def expand_groups(groups: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group -> members -> latest definition.  Returns (members with
    their definition, NULL where none) and the dangling member report."""
    return expand_members(groups.select("group", F.posexplode("members").alias("pos", "member")), registry)
