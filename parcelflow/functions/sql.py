"""The normalisers that SQL users need, as temporary SQL functions: their bodies are inlined by the optimiser."""

from __future__ import annotations

from pyspark.sql import SparkSession

BODIES = {
    "norm_phone": r"nullif(regexp_replace(s, '[^0-9]', ''), '')",
    "phone_e164": r"CASE WHEN length(regexp_replace(s, '[^0-9]', '')) = 10 THEN concat('+1', regexp_replace(s, '[^0-9]', '')) WHEN length(regexp_replace(s, '[^0-9]', '')) BETWEEN 8 AND 15 THEN concat('+', regexp_replace(s, '[^0-9]', '')) END",
    "norm_email": r"nullif(lower(trim(s)), '')",
    "norm_website": r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(s)), '^https?://', ''), '^www\\.', ''), '/+$', ''), '')",
    "norm_entity_alnum": r"trim(regexp_replace(upper(s), '[^A-Z0-9]+', ' '))",
    "strip_article": r"regexp_replace(trim(s), '(?i)^(the|a|an)\\s+', '')",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in this session and returns their names."""
    for name, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN {body}")
    return list(BODIES)
