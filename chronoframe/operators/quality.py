"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decode_json_value

MAX_BATCH_ENTITIES = 1000


def validate_requests(requests: DataFrame, max_entities: int | None = MAX_BATCH_ENTITIES) -> DataFrame:
    """V2 per request row: entity ids 1..max_entities and non-empty, at
    least one feature.  Adds ``violations`` and ``valid``; the cap is per
    request, never on a table join."""
    n = F.coalesce(F.size("entity_ids"), F.lit(-1))
    checks = [
        (n < 1, "no_entities"),
        (F.lit(False) if max_entities is None else n > max_entities, "too_many_entities"),
        (F.exists("entity_ids", lambda e: e.isNull() | (F.length(e) < 1)), "empty_entity_id"),
        (F.coalesce(F.size("feature_names"), F.lit(-1)) < 1, "no_features"),
    ]
    viol = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in checks]), lambda x: x.isNotNull())
    return requests.withColumn("violations", viol).withColumn("valid", F.size("violations") == 0)


def decode_values(values: DataFrame, registry: DataFrame) -> DataFrame:
    """Decode each stored JSON value by its definition's dtype; NULL
    where the JSON does not hold that type (then ``violation`` is true)."""
    reg = (registry.select("feature_id", F.col("name").alias("feature_name"),
                                           F.col("version").alias("feature_version"), "dtype"))
    v = values.join(reg, "feature_id")
    dec = decode_json_value(F.col("value_json"), F.col("dtype"))
    return v.withColumn("decoded", dec).withColumn(
        "violation", F.col("value_json").isNotNull() & F.col("decoded").isNull())


def dtype_violations(values: DataFrame, registry: DataFrame) -> DataFrame:
    """V3: per feature, rows checked and rows whose value does not match
    the declared dtype."""
    d = decode_values(values, registry)
    return d.groupBy("feature_id", "feature_name", "feature_version", "dtype").agg(
        F.count(F.lit(1)).alias("checked"),
        F.sum(F.col("violation").cast("int")).cast("long").alias("violations"))


def orphans(values: DataFrame, registry: DataFrame) -> DataFrame:
    """V5: values whose feature id has no definition."""
    return values.join(registry.select("feature_id"), "feature_id", "left_anti")


def cascade_delete(values: DataFrame, registry_after: DataFrame) -> DataFrame:
    """V5 cascade: keep only values whose feature still exists."""
    return values.join(registry_after.select("feature_id"), "feature_id", "left_semi")


def json_path_equals(col: str, path: str, value) -> F.Column:
    """predicate on a JSON field (``$.k == value``) by the value's type:
    booleans equal booleans, numbers equal numbers of any notation (10 and
    10.0), strings equal strings, None equals JSON null."""
    v = F.try_variant_get(F.try_parse_json(F.col(col)), path, "variant")
    kind = F.schema_of_variant(v)
    text = kind == "STRING"
    if value is None:
        hit = F.is_variant_null(v)
    elif isinstance(value, bool):
        hit = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    elif isinstance(value, int):
        hit = ~text & (kind != "BOOLEAN") & (F.try_variant_get(v, "$", "decimal(38,9)") == F.lit(value).cast("decimal(38,9)"))
    elif isinstance(value, float):
        hit = ~text & (kind != "BOOLEAN") & (F.try_variant_get(v, "$", "double") == F.lit(value))
    else:
        hit = text & (F.try_variant_get(v, "$", "string") == F.lit(value))
    return F.coalesce(hit, F.lit(False))


def to_variant(values: DataFrame, column: str = "value_json") -> DataFrame:
    """The JSON text as a VARIANT column ``value``, as it is stored; NULL where it isn't JSON."""
    return values.withColumn("value", F.try_parse_json(column))


def typed_values(values: DataFrame, registry: DataFrame) -> DataFrame:
    """Values with a VARIANT ``value``, decoded by the declared dtype into typed columns: ``int64`` (whole
    numbers of 64 bits), ``float64``, ``bool``, ``string`` and ``json`` (a VARIANT).  The other columns are NULL, and so
    is the declared one if the value is of another type; ``matches`` tells."""
    v = values.join(registry.select("feature_id", F.col("name").alias("feature_name"), "dtype"), "feature_id")
    kind = F.schema_of_variant("value")
    whole = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    number = whole | kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    is_of = {"int64": whole, "float64": number, "bool": kind == "BOOLEAN", "string": kind == "STRING",
             "json": kind.startswith("OBJECT") | kind.startswith("ARRAY")}
    sql = {"int64": "bigint", "float64": "double", "bool": "boolean", "string": "string"}
    typed = {d: F.when((F.col("dtype") == d) & ok, F.try_variant_get("value", "$", sql[d]) if d in sql else F.col("value"))
             for d, ok in is_of.items()}
    matches = F.coalesce(F.element_at(F.create_map(*[x for d, ok in is_of.items() for x in (F.lit(d), ok)]), F.col("dtype")), F.lit(False))
    return v.select(*[c for c in v.columns if c != "value"], *[c.alias(d) for d, c in typed.items()], matches.alias("matches"))
