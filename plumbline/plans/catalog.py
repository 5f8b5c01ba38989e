"""Registered queries of the contract engine, and their SQL.

The driver's tables hold no architecture documents, so each query first builds JSON texts from them,
with an expression that means the same in Spark and in DuckDB. The SQL that checks is written by
hand, not derived from the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.contracts.registry import COMPONENTS_TEXT, DIAGNOSTICS, contract
from plumbline.operators import normalize, validate
from plumbline.sources import registry
from plumbline.sources.folders import shared_folder
from plumbline.streaming.validate import run_once, validate_stream

RATE = """concat('{"rate":', CAST(l_discount * 20 AS STRING), ',"p":', CAST(l_tax AS STRING), '}')"""
#: Padding values by p_partkey % 12.
PADDINGS = (
    '"same"', '"SAME"', "2", "-1", "true", "2.0", "[1,2]", "[1,-2]", '{"mode":"explicit","value":2}',
    '{"mode":"explicit","value":[]}', '{"mode":"reflect"}', '{"mode":"explicit","value":"1"}',
)
BITS = ("4", "8", "8.0", '"8"', "16", "true", "null")
VARIANTS = (
    '{"filters":8,"kernelSize":20}', '{"filters":8,"kernel_size":20}', '{"filters":8,"KERNELSIZE":20}',
    '{"filters":8,"kernelSize":null,"kernel_size":20}', '{"filters":8,"kernelSize":3,"kernel_size":20}',
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where a table has fewer parts than there are cores, as small ones have; no step of larger ones."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _pick(texts: tuple[str, ...], number: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col(number) % len(texts) + 1).cast("int"))


def _out(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(*[F.col(c).cast("bigint") if c.endswith("_pos") else F.col(c) for c in verdicts.columns])


def _rows(spark: SparkSession, sf_dir: str, table: str, key: str, component: str, config) -> DataFrame:
    config = F.expr(config) if isinstance(config, str) else config
    rows = _table(spark, sf_dir, table).select(F.col(key).cast("string").alias("node_id"), F.lit(component).alias("component_id"), config.alias("config"))
    return _spread(rows)


def _configs(spark: SparkSession, sf_dir: str, table: str, key: str, component: str, config, dialect: str = "python") -> DataFrame:
    return _out(validate.validate_configs(_rows(spark, sf_dir, table, key, component, config), dialect=dialect))


def validate_dropout(spark, sf_dir):
    return _configs(spark, sf_dir, "lineitem", "l_orderkey", "dropout", RATE)


def validate_dense_units(spark, sf_dir):
    return _configs(spark, sf_dir, "part", "p_partkey", "dense-layer", """concat('{"units":', CAST(p_retailprice AS STRING), '}')""")


def validate_conv_numeric(spark, sf_dir):
    text = """concat('{"filters":', CAST(p_size * 60 - 100 AS STRING), ',"kernel_size":', CAST(p_partkey % 14 AS STRING), '}')"""
    return _configs(spark, sf_dir, "part", "p_partkey", "convolution-layer", text)


def _padded() -> F.Column:
    return F.concat(F.lit('{"filters":8,"kernelSize":3,"padding":'), _pick(PADDINGS, "p_partkey"), F.lit("}"))


def validate_conv_padding(spark, sf_dir):
    return _configs(spark, sf_dir, "part", "p_partkey", "convolution-layer", _padded())


def validate_conv_padding_ts(spark, sf_dir):
    return _configs(spark, sf_dir, "part", "p_partkey", "convolution-layer", _padded(), "ts")


def dialect_diff(spark, sf_dir):
    return _out(validate.dialect_diff(_rows(spark, sf_dir, "part", "p_partkey", "convolution-layer", _padded())))


LORA = """concat('{"rank":', CAST(value AS STRING), ',"alpha":', get_json_object(props, '$.k'), '}')"""


def validate_lora(spark, sf_dir):
    return _configs(spark, sf_dir, "events", "event_id", "lora-adapter", LORA)


def validate_lora_ts(spark, sf_dir):
    return _configs(spark, sf_dir, "events", "event_id", "lora-adapter", LORA, "ts")


def stream_validate(spark, sf_dir):
    """The stream's rows, run over what is there now into the session's shared folder and read back."""
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.select(F.col("event_id").cast("string").alias("node_id"), F.lit("lora-adapter").alias("component_id"), F.expr(LORA).alias("config"))
    return _out(run_once(spark, validate_stream(rows), f"{shared_folder(spark)}/streams"))


def validate_output_optimizer(spark, sf_dir):
    text = """concat('{"optimizer":"', CASE o_orderpriority WHEN '1-URGENT' THEN 'SGD' WHEN '2-HIGH' THEN 'adam' WHEN '3-MEDIUM' THEN 'adamw' ELSE 'lion' END,
        '","weightDecay":', CAST((o_custkey % 12) / 8.0D AS STRING), '}')"""
    return _configs(spark, sf_dir, "orders", "o_orderkey", "output-layer", text)


def advisory_notes(spark, sf_dir):
    text = """concat('{"lr_scheduler_type":"', CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE 'cosine' END, '","mixed_precision":"', CASE WHEN o_orderkey % 2 = 0 THEN 'no' ELSE 'bf16' END, '"}')"""
    return _configs(spark, sf_dir, "orders", "o_orderkey", "output-layer", text)


def validate_enum(spark, sf_dir):
    return _configs(spark, sf_dir, "customer", "c_custkey", "ffn-block", """concat('{"activation":"', CASE WHEN c_custkey % 2 = 0 THEN 'relu' ELSE c_mktsegment END, '"}')""")


def validate_quantization_bits(spark, sf_dir):
    return _configs(spark, sf_dir, "part", "p_partkey", "quantization-aware", F.concat(F.lit('{"bits":'), _pick(BITS, "p_partkey"), F.lit("}")))


def validate_quantization_bits_ts(spark, sf_dir):
    return _configs(spark, sf_dir, "part", "p_partkey", "quantization-aware", F.concat(F.lit('{"bits":'), _pick(BITS, "p_partkey"), F.lit("}")), "ts")


def key_variant_resolution(spark, sf_dir):
    return _configs(spark, sf_dir, "part", "p_partkey", "convolution-layer", _pick(VARIANTS, "p_partkey"))


def diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order with a dropout node per line item, in the order of the nodes' texts."""
    node = F.expr(f"""concat('{{"id":"', CAST(l_linenumber AS STRING), '","data":{{"layer_type":"Dropout","config":', {RATE}, '}}}}')""")
    nodes = F.array_join(F.sort_array(F.collect_list(node)), ",")
    return (
        _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("arch_id"))
        .agg(F.concat(F.lit('{"nodes":['), nodes, F.lit("]}")).alias("diagram"))
    )


def validate_architecture(spark, sf_dir):
    return _out(validate.validate_architectures(diagrams(spark, sf_dir)))


NODES = (
    '{"componentId":"dropout","config":{"rate":2}}', '{"componentId":"","layer_type":"DROPOUT","config":{"rate":2}}',
    '{"config":{"componentId":"dropout","rate":2}}', '{"layer_type":"dropout","rate":2}', '{"layer_type":"nope","config":{"rate":2}}',
    '{"componentId":"conv2d","config":{"padding":1}}',
)


def resolve_component(spark, sf_dir):
    text = F.concat(F.lit('{"nodes":[7,{"id":'), F.col("n_nationkey").cast("string"), F.lit(',"data":'), _pick(NODES, "n_nationkey"), F.lit("}]}"))
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("arch_id"), text.alias("diagram"))
    return _out(validate.validate_architectures(rows))


def normalize_padding(spark, sf_dir):
    text = F.concat(F.lit('{"a":2.0,"padding":'), _pick(PADDINGS, "p_partkey"), F.lit(',"b":null}'))
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.lit("convolution-layer").alias("component_id"), text.alias("config"))
    return normalize.normalize_configs(_spread(rows)).select("p_partkey", "normalized")


def normalize_diagram(spark, sf_dir):
    text = F.concat(F.lit('{"v":1,"nodes":[7,{"id":"a","data":{"layer_type":"CONV2D","config":{"padding":'), _pick(PADDINGS, "p_partkey"), F.lit('}}},{"data":{}}]}'))
    rows = _table(spark, sf_dir, "part").select("p_partkey", text.alias("diagram"))
    return normalize.normalize_diagrams(_spread(rows)).select("p_partkey", "normalized")


def normalize_layers(spark, sf_dir):
    text = F.concat(F.lit('{"layers":[{"type":"conv2d","config":{"padding":'), _pick(PADDINGS, "p_partkey"), F.lit('}},{"type":"pooling","config":{"padding":"same"}},{"type":"conv2d"}]}'))
    rows = _table(spark, sf_dir, "part").select("p_partkey", text.alias("architecture"))
    return normalize.normalize_layer_lists(_spread(rows)).select("p_partkey", "normalized")


FLAGS = (
    ("dropout", "seed", "{}", True, True), ("dropout", "rate", "{}", False, True), ("dropout", "p", "{}", None, True),
    ("dropout", "dropoutMode", "{}", None, True), ("nope", "x", "{}", None, True), ("convolution-layer", "kernel_size", "{}", True, True),
    ("output-layer", "weight_decay", '{"optimizer":"AdamW"}', False, True), ("output-layer", "weightDecay", "{}", False, False),
    ("output-layer", "epochs", "{}", True, True),
)


def param_flags(spark, sf_dir):
    asked = [F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("component_id", "key", "config"))]) for r in FLAGS]
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*asked), (F.col("o_orderkey") % len(FLAGS) + 1).cast("int")).alias("q"))
    rows = rows.select("o_orderkey", "q.*")
    return validate.param_flags(_spread(rows)).select("o_orderkey", "is_integer", "is_applicable")


#: (component, config) by p_partkey: values of other kinds, below the recommended range, under an alias, and with notes.
VALUES = (
    ("dense-layer", '{"units":"many"}'), ("dense-layer", '{"units":true}'), ("dense-layer", '{"units":{"a":1,"b":[null,"x"]}}'),
    ("dense-layer", '{"units":8,"useBias":"banana"}'), ("dense-layer", '{"units":8,"activation":"linear"}'),
    ("output-layer", '{"learningRate":0.000001}'), ("output-layer", '{"learningRate":2}'), ("dropout", '{"rate":null,"p":1.5}'),
    ("dropout", '{"rate":0.5,"p":1.5}'), ("instance-normalization", '{"affine":false}'), ("instance-normalization", '{"affine":"no"}'),
    ("reshape", '{"targetShape":7}'), ("no-such-component", '{"units":"many"}'),
)


def validate_values(spark, sf_dir):
    picked = F.element_at(F.array(*[F.struct(F.lit(c).alias("component_id"), F.lit(t).alias("config")) for c, t in VALUES]), (F.col("p_partkey") % len(VALUES) + 1).cast("int"))
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("node_id"), picked.alias("q")).select("node_id", "q.*")
    return _out(validate.validate_configs(_spread(rows)))


#: Ids of nodes as documents write them, and as verdicts name them.
IDS = (('"id":null,', "None"), ("", ""), ('"id":12,', "12"), ('"id":1.50,', "1.5"), ('"id":true,', "True"), ('"id":"a b",', "a b"))


def node_ids(spark, sf_dir):
    text = F.concat(F.lit('{"nodes":[{'), _pick(tuple(i for i, _ in IDS), "p_partkey"), F.lit('"data":{"componentId":"dropout","config":{"rate":2}}}]}'))
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("arch_id"), text.alias("diagram"))
    return _out(validate.validate_architectures(rows))


def registry_contract(spark, sf_dir):
    """Version and sizes of the contract, from its document."""
    found = contract()
    sizes = (found["version"], len(found["components"]), sum(len(c["params"]) for c in found["components"]), len(found["diagnostics"]))
    return spark.createDataFrame([sizes], "version bigint, n_components bigint, n_params bigint, n_diagnostics bigint")


def registry_components(spark, sf_dir):
    return registry.registry_components(spark).select("component_id", "layer_type", "requires_incoming_input", "formula_kind", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("formula_roles")))).alias("formula_roles"))


def registry_params(spark, sf_dir):
    rows = registry.registry_params(spark)
    return rows.select(*[F.to_json(c).alias(c) if isinstance(rows.schema[c].dataType, T.ArrayType) else F.col(c) for c in rows.columns])


def registry_diagnostics(spark, sf_dir):
    return registry.registry_diagnostics(spark)


def severity_summary(spark, sf_dir):
    """Extension: verdicts counted; summed before the shuffle."""
    return validate_dropout(spark, sf_dir).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        validate_dropout, validate_dense_units, validate_conv_numeric, validate_conv_padding, validate_lora, stream_validate,
        validate_output_optimizer, advisory_notes, validate_enum, validate_quantization_bits, key_variant_resolution,
        validate_architecture, resolve_component, normalize_padding, normalize_diagram, normalize_layers, param_flags,
        registry_components, registry_params, registry_diagnostics, severity_summary,
        validate_conv_padding_ts, validate_lora_ts, validate_quantization_bits_ts, dialect_diff, validate_values, node_ids, registry_contract,
    )
    return {f.__name__: f for f in every}


def _sql(rows: str, component: str, extra: str = "", joint: str = "_") -> str:
    """Full verdict rows from ``rows``: node_id, pos, diag, sev, code, field, expected, got, message, hint."""
    return f"""SELECT {extra} node_id, '{component}' AS component_id, CAST(pos AS BIGINT) AS param_pos, CAST(diag AS BIGINT) AS diag_pos,
      concat('parameter{joint}', sev) AS type, sev AS severity, code, field, expected, got, concat('{component}: ', message) AS message, hint AS fix_hint FROM ({rows})"""


def _over(field: str, pos: int, bound: str, value: str) -> str:
    return f"""{pos} AS pos, 0 AS diag, 'error' AS sev, 'PARAM_NUMBER_ABOVE_MAX' AS code, '{field}' AS field, '{bound}' AS expected, {value} AS got,
      concat('{field} must be at most {bound}, got ', {value}) AS message, 'decrease {field} to at most {bound}' AS hint"""


def _under(field: str, pos: int, bound: str, value: str) -> str:
    return f"""{pos} AS pos, 0 AS diag, 'error' AS sev, 'PARAM_NUMBER_BELOW_MIN' AS code, '{field}' AS field, '{bound}' AS expected, {value} AS got,
      concat('{field} must be at least {bound}, got ', {value}) AS message, 'increase {field} to at least {bound}' AS hint"""


def _high(field: str, pos: int, bound: str, value: str) -> str:
    return f"""{pos} AS pos, 0 AS diag, 'warning' AS sev, 'PARAM_NUMBER_ABOVE_RECOMMENDED' AS code, '{field}' AS field, '{bound}' AS expected, {value} AS got,
      concat('{field} = ', {value}, ' is unusually high (recommended <= {bound})') AS message, 'reduce {field} toward {bound} unless this is deliberate' AS hint"""


def _whole(field: str, pos: int, value: str) -> str:
    return f"""{pos} AS pos, 0 AS diag, 'error' AS sev, 'PARAM_NUMBER_NOT_INTEGER' AS code, '{field}' AS field, NULL AS expected, {value} AS got,
      concat('{field} must be a whole number, got ', {value}) AS message, 'round {field} to an integer' AS hint"""


def _enum(field: str, pos: int, values: str, value: str) -> str:
    v = values.replace("'", "''")
    return f"""{pos} AS pos, 0 AS diag, 'error' AS sev, 'PARAM_ENUM_NOT_ALLOWED' AS code, '{field}' AS field, '{v}' AS expected, {value} AS got,
      concat('{field} must be one of {v}, got ', {value}) AS message, 'choose {field} from {v}' AS hint"""


def _below(field: str, pos: int, bound: str, value: str) -> str:
    return f"""{pos} AS pos, 0 AS diag, 'warning' AS sev, 'PARAM_NUMBER_BELOW_RECOMMENDED' AS code, '{field}' AS field, '{bound}' AS expected, {value} AS got,
      concat('{field} = ', {value}, ' is unusually low (recommended >= {bound})') AS message, 'increase {field} toward {bound} unless this is deliberate' AS hint"""


def _no_number(field: str, pos: int, value: str) -> str:
    return f"""{pos} AS pos, 0 AS diag, 'error' AS sev, 'PARAM_NUMBER_NOT_A_NUMBER' AS code, '{field}' AS field, NULL AS expected, {value} AS got,
      concat('{field} must be a number, got ', {value}) AS message, 'set {field} to a numeric value' AS hint"""


def _values_sql() -> str:
    number = lambda k, got: (k, "dense-layer", _no_number("units", 0, got))
    linear = """1 AS pos, 0 AS diag, 'info' AS sev, 'INFO_LINEAR_ACTIVATION' AS code, 'activation' AS field, NULL AS expected, '''linear''' AS got,
      'activation = ''linear'' applies no nonlinearity; consecutive linear layers without an activation collapse into a single linear map' AS message,
      'add a nonlinear activation (relu/gelu/...) unless a linear projection is intended' AS hint"""
    affine = """1 AS pos, 0 AS diag, 'info' AS sev, 'INFO_NO_NORMALIZATION_AFFINE' AS code, 'affine' AS field, NULL AS expected, 'False' AS got,
      'affine = False disables the learnable affine transform; the layer normalizes but adds no trainable scale/shift' AS message,
      'enable affine to restore the per-feature scale/shift unless intended' AS hint"""
    rows = [
        number(0, "'''many'''"), number(1, "'True'"), number(2, "'{''a'': 1, ''b'': [None, ''x'']}'"), (4, "dense-layer", linear),
        (5, "output-layer", _below("learningRate", 6, "1e-05", "'1e-06'")), (6, "output-layer", _over("learningRate", 6, "1", "'2'")),
        (7, "dropout", _over("rate", 0, "1", "'1.5'")), (9, "instance-normalization", affine),
    ]
    each = lambda k, row: f"SELECT CAST(p_partkey AS VARCHAR) AS node_id, {row} FROM part WHERE p_partkey % {len(VALUES)} = {k}"
    return " UNION ALL ".join(f"SELECT * FROM ({_sql(each(k, row), component)})" for k, component, row in rows)


#: The contract's text, read by SQL: a component's lines, and the words of each.
CONTRACT_SQL = f"""
lines AS (
  SELECT no, line, line NOT LIKE ' %' AS head, string_split(trim(line), ' ') AS words
  FROM (SELECT unnest(string_split($text${COMPONENTS_TEXT}$text$, chr(10))) AS line, generate_subscripts(string_split($text${COMPONENTS_TEXT}$text$, chr(10)), 1) AS no)
  WHERE line <> ''
), owned AS (
  SELECT *, max(CASE WHEN head THEN no END) OVER (ORDER BY no) AS owner FROM lines
)"""
COMPONENTS_SQL = f"""WITH {CONTRACT_SQL}
SELECT words[1] AS component_id, words[2] AS layer_type, NOT list_contains(words, 'source') AS requires_incoming_input,
  nullif(regexp_extract(line, ' = (\\S+)', 1), '') AS formula_kind,
  '{{' || array_to_string(list_transform(list_sort(list_filter(words, lambda w: contains(w, ':'))), lambda w: '"' || replace(w, ':', '":"') || '"'), ',') || '}}' AS formula_roles
FROM owned WHERE head"""
PARAMS_SQL = f"""WITH {CONTRACT_SQL}, params AS (
  SELECT o.no, h.words[1] AS component_id, CAST(row_number() OVER (PARTITION BY o.owner ORDER BY o.no) - 1 AS INT) AS param_pos, o.words[1] AS key, o.words[2] AS type, o.words[3:] AS rest,
    regexp_replace(o.line, ' (alias|when|note|warn) \\S+', '', 'g') AS plain, o.line
  FROM owned o JOIN owned h ON o.owner = h.no WHERE NOT o.head
), named AS (
  SELECT *, regexp_extract_all(line, ' alias (\\S+)', 1) AS aliases, regexp_extract(plain, ' (\\S*)\\.\\.', 1) AS low, regexp_extract(plain, '\\.\\.(\\S*)', 1) AS high,
    regexp_extract(line, ' warn (\\S*)\\.\\.', 1) AS wlow, regexp_extract(line, ' warn \\S*\\.\\.(\\S*)', 1) AS whigh,
    CASE WHEN type = 'enum' THEN string_split(string_split(trim(plain), ' ')[3], '|') ELSE [] END AS vals,
    regexp_extract_all(line, ' when (\\S+)', 1) AS whens, regexp_extract_all(line, ' note (\\S+)', 1) AS notes
  FROM params
), spelled AS (
  SELECT *, list_transform([key] || aliases, lambda n: [n,
      string_split(n, '_')[1] || array_to_string(list_transform(string_split(n, '_')[2:], lambda w: upper(w[1]) || w[2:]), ''),
      lower(regexp_replace(n, '([A-Z])', '_\\1', 'g'))]) AS forms
  FROM named
), cast_ AS (
  SELECT *, flatten(forms) AS every, try_cast(nullif(low, '') AS DOUBLE) AS a, try_cast(nullif(high, '') AS DOUBLE) AS b, try_cast(nullif(wlow, '') AS DOUBLE) AS c, try_cast(nullif(whigh, '') AS DOUBLE) AS d FROM spelled
)
SELECT component_id, param_pos, key, CASE WHEN type IN ('int', 'num') THEN 'number' ELSE type END AS kind, list_contains(rest, 'required') AS required,
  a AS min, b AS max, c AS warn_min, d AS warn_max, type = 'int' AS integer, CAST(to_json(vals) AS VARCHAR) AS enum_values, CAST(to_json(aliases) AS VARCHAR) AS aliases,
  CAST(to_json(list_filter(every, lambda x, i: list_position(every, x) = i)) AS VARCHAR) AS candidates,
  '[' || array_to_string(list_transform(whens, lambda w: '{{"control_key":"' || string_split(w, '=')[1] || '","candidates":["' || string_split(w, '=')[1] || '"],"allowed":'
    || CAST(to_json(list_transform(string_split(string_split(w, '=')[2], '|'), lambda v: lower(v))) AS VARCHAR) || '}}'), ',') || ']' AS applies_when,
  '[' || array_to_string(list_transform(notes, lambda n: '{{"when_value":"' || lower(string_split(n, '=')[1]) || '","code":"' || string_split(n, '=')[2] || '"}}'), ',') || ']' AS advisories,
  printf('%g', a) AS expected_min, printf('%g', b) AS expected_max, printf('%g', c) AS expected_warn_min, printf('%g', d) AS expected_warn_max,
  CASE WHEN type = 'enum' THEN '[''' || array_to_string(vals, ''', ''') || ''']' END AS expected_enum
FROM cast_"""


def oracle_sql() -> dict[str, str]:
    rate = "CAST(l_discount * 20 AS VARCHAR)"
    dropout = f"""SELECT CAST(l_orderkey AS VARCHAR) AS node_id, {_over('rate', 0, '1', rate)} FROM lineitem WHERE l_discount * 20 > 1
      UNION ALL SELECT CAST(l_orderkey AS VARCHAR), {_high('rate', 0, '0.7', rate)} FROM lineitem WHERE l_discount * 20 > 0.7 AND l_discount * 20 <= 1"""
    price = "CAST(p_retailprice AS VARCHAR)"
    key = "CAST(p_partkey AS VARCHAR) AS node_id"
    filters, kernel = "CAST(p_size * 60 - 100 AS VARCHAR)", "CAST(p_partkey % 14 AS VARCHAR)"
    conv = f"""SELECT {key}, {_under('filters', 1, '1', filters)} FROM part WHERE p_size * 60 - 100 < 1
      UNION ALL SELECT {key}, {_over('filters', 1, '2048', filters)} FROM part WHERE p_size * 60 - 100 > 2048
      UNION ALL SELECT {key}, {_high('filters', 1, '1024', filters)} FROM part WHERE p_size * 60 - 100 BETWEEN 1025 AND 2048
      UNION ALL SELECT {key}, {_under('kernelSize', 2, '1', kernel)} FROM part WHERE p_partkey % 14 < 1
      UNION ALL SELECT {key}, {_over('kernelSize', 2, '11', kernel)} FROM part WHERE p_partkey % 14 > 11"""
    shape = "{mode:''same''|''valid''|''explicit'', value?}"
    typed = f"'PARAM_PADDING_NOT_TYPED', '{shape}', "
    hint = "'wrap an explicit pad as {mode:''explicit'', value:N}'"
    explicit = "'set padding.value to a non-negative integer or a list of non-negative integers'"
    shapes = [(k, f"{typed} '{got}', 'padding must be a typed object {shape}, got {got}', {hint}") for k, got in ((2, "2"), (3, "-1"), (4, "True"), (5, "2.0"), (6, "[1, 2]"), (7, "[1, -2]"))]
    shapes += [
        (1, f"'PARAM_PADDING_BAD_STRING', '{shape}', '''SAME''', 'padding must be ''valid'', ''same'', or a typed object {shape}, got ''SAME''', 'use {{mode:''same''}} or {{mode:''explicit'', value:N}}'"),
        (9, "'PARAM_PADDING_BAD_AXIS_LENGTH', NULL, '[]', 'explicit padding list must hold 1 to 3 entries (one symmetric pad per spatial axis), got []', 'provide one pad per spatial axis, e.g. [padH, padW]'"),
        (10, "'PARAM_PADDING_BAD_MODE', NULL, '''reflect''', 'padding.mode must be ''valid'', ''same'', or ''explicit'', got ''reflect''', 'set padding.mode to one of valid|same|explicit'"),
        (11, f"'PARAM_PADDING_BAD_EXPLICIT_VALUE', NULL, '''1''', 'explicit padding needs a non-negative integer or a list of non-negative integers, got ''1''', {explicit}"),
    ]
    values = ", ".join(f"({k}, {v})" for k, v in shapes)
    padded = lambda values: f"""SELECT {key}, 4 AS pos, 0 AS diag, 'error' AS sev, code, 'padding' AS field, expected, got, message, hint
      FROM part JOIN (VALUES {values}) v(k, code, expected, got, message, hint) ON p_partkey % 12 = k"""  # noqa: E731
    padding = padded(values)
    bad_mode = "'PARAM_PADDING_BAD_MODE', NULL, 'undefined', 'padding.mode must be ''valid'', ''same'', or ''explicit'', got undefined', 'set padding.mode to one of valid|same|explicit'"
    shapes_ts = dict(shapes) | {5: f"{typed} '2', 'padding must be a typed object {shape}, got 2', {hint}", 6: bad_mode, 7: bad_mode}
    padding_ts = padded(", ".join(f"({k}, {v})" for k, v in shapes_ts.items()))
    differ = " UNION ALL ".join(
        f"SELECT * EXCLUDE (type), '{d}' AS dialect FROM ({_sql(padded(', '.join(f'({k}, {of[k]})' for k in (5, 6, 7))), 'convolution-layer')})"
        for d, of in (("python", dict(shapes)), ("ts", shapes_ts))
    )
    event = "CAST(event_id AS VARCHAR) AS node_id"
    alpha = "json_extract_string(props, '$.k')"
    lora_rows = lambda rank: f"""SELECT {event}, {_whole('rank', 0, rank)} FROM events WHERE value <> floor(value)
      UNION ALL SELECT {event}, {_under('rank', 0, '1', rank)} FROM events WHERE value = floor(value) AND value < 1
      UNION ALL SELECT {event}, {_over('rank', 0, '256', rank)} FROM events WHERE value = floor(value) AND value > 256
      UNION ALL SELECT {event}, {_high('rank', 0, '128', rank)} FROM events WHERE value = floor(value) AND value > 128 AND value <= 256
      UNION ALL SELECT {event}, {_under('alpha', 1, '1', alpha)} FROM events WHERE CAST({alpha} AS BIGINT) < 1
      UNION ALL SELECT {event}, {_over('alpha', 1, '512', alpha)} FROM events WHERE CAST({alpha} AS BIGINT) > 512"""  # noqa: E731
    lora = _sql(lora_rows("CAST(value AS VARCHAR)"), "lora-adapter")
    order = "CAST(o_orderkey AS VARCHAR) AS node_id"
    names, decay = "['adam', 'sgd', 'rmsprop', 'adamw', 'adagrad']", "CAST((o_custkey % 12) / 8.0::DOUBLE AS VARCHAR)"
    active = "o_orderpriority IN ('1-URGENT', '3-MEDIUM')"
    named = "CASE o_orderpriority WHEN '1-URGENT' THEN '''SGD''' ELSE '''lion''' END"
    optimizer = f"""SELECT {order}, {_enum('optimizer', 4, names, named)} FROM orders WHERE o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM')
      UNION ALL SELECT {order}, {_over('weight_decay', 11, '1', decay)} FROM orders WHERE {active} AND o_custkey % 12 > 8
      UNION ALL SELECT {order}, {_high('weight_decay', 11, '0.1', decay)} FROM orders WHERE {active} AND o_custkey % 12 BETWEEN 1 AND 8"""
    note = lambda pos, code, field, got, text, hint: f"{pos} AS pos, 0 AS diag, 'info' AS sev, '{code}' AS code, '{field}' AS field, NULL AS expected, '''{got}''' AS got, '{field} = ''{got}'' {text}' AS message, '{hint}' AS hint"
    scheduler = note(23, "INFO_NO_LR_SCHEDULE", "lr_scheduler_type", "none", "keeps the learning rate constant; a schedule (cosine/step/plateau) often improves convergence", "set lr_scheduler_type to cosine, step, or plateau to anneal the learning rate")
    precision = note(21, "INFO_MIXED_PRECISION_OFF", "mixed_precision", "no", "trains in full precision; bf16/fp16 cuts memory and speeds up training on supported accelerators", "set mixed_precision to bf16 (or fp16) on supported hardware")
    segment = "concat('''', c_mktsegment, '''')"
    bits = "CASE p_partkey % 7 WHEN 2 THEN '8.0' WHEN 4 THEN '16' ELSE 'True' END"
    nodes = f"""SELECT *, row_number() OVER (PARTITION BY arch_id ORDER BY node) - 1 AS node_pos FROM (
      SELECT l_orderkey AS arch_id, CAST(l_linenumber AS VARCHAR) AS node_id, l_discount * 20 AS r, {rate} AS rate,
        concat('{{"id":"', CAST(l_linenumber AS VARCHAR), '","data":{{"layer_type":"Dropout","config":{{"rate":', {rate}, ',"p":', CAST(l_tax AS VARCHAR), '}}}}}}') AS node FROM lineitem)"""
    architecture = f"""SELECT arch_id, node_pos, node_id, {_over('rate', 0, '1', 'rate')} FROM ({nodes}) WHERE r > 1
      UNION ALL SELECT arch_id, node_pos, node_id, {_high('rate', 0, '0.7', 'rate')} FROM ({nodes}) WHERE r > 0.7 AND r <= 1"""
    upgraded = dict(enumerate(PADDINGS)) | {0: '{"mode":"same"}', 2: '{"mode":"explicit","value":2}', 6: '{"mode":"explicit","value":[1,2]}'}
    new = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in upgraded.items()) + ") v(k, new)"
    text = lambda x: "NULL" if x is None else str(x).lower()
    flags = ", ".join(f"({k}, {text(r[3])}::BOOLEAN, {text(r[4])})" for k, r in enumerate(FLAGS))
    known = f"SELECT CAST(n_nationkey AS BIGINT) AS arch_id, 1 AS node_pos, CAST(n_nationkey AS VARCHAR) AS node_id, {_over('rate', 0, '1', repr('2'))} FROM nation WHERE n_nationkey % 6 < 4"
    where = "arch_id, CAST(node_pos AS BIGINT) AS node_pos,"
    return {
        "validate_dropout": _sql(dropout, "dropout"),
        "validate_dense_units": _sql(f"SELECT {key}, {_whole('units', 0, price)} FROM part WHERE p_retailprice <> floor(p_retailprice)", "dense-layer"),
        "validate_conv_numeric": _sql(conv, "convolution-layer"),
        "validate_conv_padding": _sql(padding, "convolution-layer"),
        "validate_lora": lora,
        "stream_validate": lora,
        "validate_output_optimizer": _sql(optimizer, "output-layer"),
        "advisory_notes": _sql(f"SELECT {order}, {scheduler} FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT {order}, {precision} FROM orders WHERE o_orderkey % 2 = 0", "output-layer"),
        "validate_enum": _sql(f"SELECT CAST(c_custkey AS VARCHAR) AS node_id, {_enum('activation', 2, str(['relu', 'swiglu', 'geglu']), segment)} FROM customer WHERE c_custkey % 2 = 1", "ffn-block"),
        "validate_quantization_bits": _sql(f"SELECT {key}, {_enum('bits', 0, str(['4', '8']), bits)} FROM part WHERE p_partkey % 7 IN (2, 4, 5)", "quantization-aware"),
        "key_variant_resolution": _sql(
            f"""SELECT {key}, {_over('kernelSize', 2, '11', repr('20'))} FROM part WHERE p_partkey % 5 IN (0, 1, 3)
            UNION ALL SELECT {key}, 2, 0, 'error', 'PARAM_REQUIRED_MISSING', 'kernelSize', NULL, NULL, 'missing required parameter ''kernelSize''', 'provide a value for kernelSize' FROM part WHERE p_partkey % 5 = 2""",
            "convolution-layer",
        ),
        "validate_architecture": _sql(architecture, "dropout", where),
        "resolve_component": _sql(known, "dropout", where),
        "normalize_padding": f"""SELECT p_partkey, concat('{{"a":2.0,"padding":', new, ',"b":null}}') AS normalized FROM part JOIN {new} ON p_partkey % 12 = k""",
        "normalize_diagram": f"""SELECT p_partkey, concat('{{"v":1,"nodes":[7,{{"id":"a","data":{{"layer_type":"CONV2D","config":{{"padding":', new, '}}}}}},{{"data":{{"config":null}}}}]}}') AS normalized FROM part JOIN {new} ON p_partkey % 12 = k""",
        "normalize_layers": f"""SELECT p_partkey, concat('{{"layers":[{{"type":"conv2d","config":{{"padding":', new, '}}}},{{"type":"pooling","config":{{"padding":"same"}}}},{{"type":"conv2d","config":null}}]}}') AS normalized FROM part JOIN {new} ON p_partkey % 12 = k""",
        "param_flags": f"SELECT o_orderkey, is_integer, is_applicable FROM orders JOIN (VALUES {flags}) v(k, is_integer, is_applicable) ON o_orderkey % {len(FLAGS)} = k",
        "validate_conv_padding_ts": _sql(padding_ts, "convolution-layer", joint=" "),
        "validate_lora_ts": _sql(lora_rows("regexp_replace(CAST(value AS VARCHAR), '[.]0$', '')"), "lora-adapter", joint=" "),
        "validate_quantization_bits_ts": _sql(f"SELECT {key}, {_enum('bits', 0, str(['4', '8']), bits)} FROM part WHERE p_partkey % 7 IN (4, 5)", "quantization-aware", joint=" "),
        "dialect_diff": differ,
        "validate_values": _values_sql(),
        "node_ids": _sql(
            f"""SELECT CAST(p_partkey AS BIGINT) AS arch_id, 0 AS node_pos, id AS node_id, {_over('rate', 0, '1', repr('2'))}
            FROM part JOIN (VALUES {', '.join(f"({k}, '{name}')" for k, (_, name) in enumerate(IDS))}) v(k, id) ON p_partkey % {len(IDS)} = k""",
            "dropout", where,
        ),
        "registry_contract": f"""WITH {CONTRACT_SQL} SELECT 3::BIGINT AS version, count(*) FILTER (head) AS n_components, count(*) FILTER (NOT head) AS n_params,
          {len(DIAGNOSTICS)}::BIGINT AS n_diagnostics FROM owned""",
        "registry_components": COMPONENTS_SQL,
        "registry_params": PARAMS_SQL,
        "registry_diagnostics": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"$x${y}$x$" for y in (k, *v)) + ")" for k, v in DIAGNOSTICS.items()) + ") v(code, severity, template, fix_hint)",
        "severity_summary": f"SELECT sev AS severity, code, count(*) AS n FROM ({dropout}) GROUP BY sev, code",
    }
