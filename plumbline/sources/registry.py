"""The contract as DataFrames and as a JSON file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.contracts import registry as R

PARAMS = (
    "component_id string, param_pos int, key string, kind string, required boolean, min double, max double, warn_min double, "
    "warn_max double, integer boolean, enum_values array<string>, aliases array<string>, candidates array<string>, "
    "applies_when array<struct<control_key: string, candidates: array<string>, allowed: array<string>>>, "
    "advisories array<struct<when_value: string, code: string>>, expected_min string, expected_max string, "
    "expected_warn_min string, expected_warn_max string, expected_enum string"
)


def _g(x: float | None) -> str | None:
    return None if x is None else f"{x:g}"


def param_rows(bound: Callable[[float | None], str | None] = _g) -> list[tuple]:
    """Everything about a parameter that does not depend on data is worked out here, once. bound: prints a bound."""
    return [
        (
            c.component_id, i, p.key, p.kind, p.required, p.low, p.high, p.warn_low, p.warn_high, p.integer, p.values,
            p.aliases, p.candidates,
            [(k, R.spellings(k), [v.lower() for v in vs]) for k, vs in p.when.items()],
            [(v.lower(), code) for v, code in p.notes],
            bound(p.low), bound(p.high), bound(p.warn_low), bound(p.warn_high), str(p.values) if p.kind == "enum" else None,
        )
        for c in R.COMPONENTS for i, p in enumerate(c.params)
    ]


def registry_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(param_rows(), PARAMS)


def registry_components(spark: SparkSession) -> DataFrame:
    rows = [(c.component_id, c.layer_type, c.requires_incoming_input, c.formula, c.roles) for c in R.COMPONENTS]
    return spark.createDataFrame(
        rows, "component_id string, layer_type string, requires_incoming_input boolean, formula_kind string, formula_roles map<string,string>"
    )


def registry_diagnostics(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in R.DIAGNOSTICS.items()]
    return spark.createDataFrame(rows, "code string, severity string, template string, fix_hint string")


def register_views(spark: SparkSession) -> None:
    """The three tables as temporary views of the same names."""
    for f in (registry_components, registry_params, registry_diagnostics):
        f(spark).createOrReplaceTempView(f.__name__)


def write_contract(path: str) -> str:
    """Write the contract document to ``path``; returns its text."""
    text = R.contract_json()
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text
