"""Golden configs, padding values and documents."""

import json

import pytest

from plumbline.contracts import registry as R
from plumbline.functions.render import js_number
from plumbline.operators import normalize, validate

SHAPE = "{mode:'same'|'valid'|'explicit', value?}"
CONV, OUT = "convolution-layer", "output-layer"
GOLDEN = [
    (CONV, '{"filters":-999}', [("NUMBER_BELOW_MIN", "filters", "1", "-999"), ("REQUIRED_MISSING", "kernelSize", None, None)]),
    (CONV, '{"filters":32,"kernelSize":3}', []),
    (CONV, '{"filters":32.0,"kernel_size":3}', []),
    (CONV, '{"filters":32.5,"kernelSize":3}', [("NUMBER_NOT_INTEGER", "filters", None, "32.5")]),
    (CONV, '{"filters":true,"kernelSize":3}', [("NUMBER_NOT_A_NUMBER", "filters", None, "True")]),
    (CONV, '{"filters":"32","kernelSize":3}', [("NUMBER_NOT_A_NUMBER", "filters", None, "'32'")]),
    (CONV, '{"filters":[1, {"a":2.0}],"kernelSize":3}', [("NUMBER_NOT_A_NUMBER", "filters", None, "[1, {'a': 2.0}]")]),
    (CONV, '{"filters":"it\'s","kernelSize":3}', [("NUMBER_NOT_A_NUMBER", "filters", None, '"it\'s"')]),
    (CONV, '{"filters":null,"kernelSize":3}', [("REQUIRED_MISSING", "filters", None, None)]),
    (CONV, '{"filters":1024,"kernelSize":11}', []),
    (CONV, '{"filters":2048,"kernelSize":3}', [("NUMBER_ABOVE_RECOMMENDED", "filters", "1024", "2048")]),
    (CONV, '{"filters":2049,"kernelSize":3}', [("NUMBER_ABOVE_MAX", "filters", "2048", "2049")]),
    (CONV, '{"filters":123456789012345678901234567890,"kernelSize":3}', [("NUMBER_ABOVE_MAX", "filters", "2048", "123456789012345678901234567890")]),
    (CONV, '{"filters":2e20,"kernelSize":3}', [("NUMBER_ABOVE_MAX", "filters", "2048", "2e+20")]),
    (CONV, '{"KERNELSIZE":3,"filters":8}', [("REQUIRED_MISSING", "kernelSize", None, None)]),
    (CONV, '{"filters":8,"kernelSize":3,"activation":"none"}', [("INFO_LINEAR_ACTIVATION", "activation", None, "'none'")]),
    (CONV, '{"filters":8,"kernelSize":3,"activation":"Linear"}', [("ENUM_NOT_ALLOWED", "activation", "['none', 'relu', 'sigmoid', 'tanh', 'linear']", "'Linear'"), ("INFO_LINEAR_ACTIVATION", "activation", None, "'Linear'")]),
    ("dense-layer", '{"units":300000}', []),
    ("dense-layer", '{"units":900.1}', [("NUMBER_NOT_INTEGER", "units", None, "900.1")]),
    ("dense-layer", '{"units":8,"useBias":"banana"}', []),
    ("dense-layer", "{}", [("REQUIRED_MISSING", "units", None, None)]),
    (OUT, '{"weight_decay":5}', []),
    (OUT, '{"optimizer":"adam","weight_decay":5,"optimizer_momentum":5}', []),
    (OUT, '{"optimizer":"SGD","weight_decay":5}', [("ENUM_NOT_ALLOWED", "optimizer", "['adam', 'sgd', 'rmsprop', 'adamw', 'adagrad']", "'SGD'"), ("NUMBER_ABOVE_MAX", "weight_decay", "1", "5")]),
    (OUT, '{"optimizer":"adamw","weightDecay":0.2}', [("NUMBER_ABOVE_RECOMMENDED", "weight_decay", "0.1", "0.2")]),
    (OUT, '{"learningRate":1e-6}', [("NUMBER_BELOW_RECOMMENDED", "learningRate", "1e-05", "1e-06")]),
    (OUT, '{"learning_rate":1e-9}', [("NUMBER_BELOW_MIN", "learningRate", "1e-08", "1e-09")]),
    (OUT, '{"learning_rate":12345678.5}', [("NUMBER_ABOVE_MAX", "learningRate", "1", "12345678.5")]),
    (OUT, '{"learning_rate":2e20}', [("NUMBER_ABOVE_MAX", "learningRate", "1", "2e+20")]),
    (OUT, '{"vocabSize":2000000}', [("NUMBER_ABOVE_MAX", "vocabSize", "1e+06", "2000000")]),
    (OUT, '{"mixed_precision":"no","lr_scheduler_type":"none"}', [("INFO_MIXED_PRECISION_OFF", "mixed_precision", None, "'no'"), ("INFO_NO_LR_SCHEDULE", "lr_scheduler_type", None, "'none'")]),
    (OUT, '{"lr_scheduler_type":"plateau"}', []),
    ("dropout", '{"p":0.9}', [("NUMBER_ABOVE_RECOMMENDED", "rate", "0.7", "0.9")]),
    ("dropout", '{"rate":0.1,"p":9}', []),
    ("dropout", '{"rate":null,"p":9}', [("NUMBER_ABOVE_MAX", "rate", "1", "9")]),
    ("instance-normalization", '{"affine":false}', [("INFO_NO_NORMALIZATION_AFFINE", "affine", None, "False")]),
    ("instance-normalization", '{"affine":"FALSE"}', [("INFO_NO_NORMALIZATION_AFFINE", "affine", None, "'FALSE'")]),
    ("instance-normalization", '{"affine":0}', []),
    ("quantization-aware", '{"bits":8}', []), ("quantization-aware", '{"bits":"8"}', []),
    ("quantization-aware", '{"bits":8.0}', [("ENUM_NOT_ALLOWED", "bits", "['4', '8']", "8.0")]),
    ("pooling-layer", '{"padding":1}', [("ENUM_NOT_ALLOWED", "padding", "['valid', 'same']", "1")]),
    ("rope", '{"base":-5}', []), ("rope", '{"base":10000.5}', [("NUMBER_NOT_INTEGER", "base", None, "10000.5")]),
    ("noise-scheduler", '{"beta_start":"x"}', [("NUMBER_NOT_A_NUMBER", "beta_start", None, "'x'")]),
    ("ffn-block", '{"d_ff":0}', [("NUMBER_BELOW_MIN", "dFf", "1", "0")]), ("moe-layer", '{"dModel":0}', [("NUMBER_BELOW_MIN", "d_model", "1", "0")]),
    ("merge-node", '{"axis":-5}', [("NUMBER_BELOW_MIN", "axis", "-4", "-5")]),
    ("no-such-component", '{"x":1}', []), ("conv2d", "{}", []), ("dropout", "not json", []), ("dropout", "[1]", []),
]
#: padding, verdict without its prefix, normalized form if it changes
PADDINGS = [
    ('"same"', None, '{"mode":"same"}'), ('"SAME"', ("BAD_STRING", SHAPE, "'SAME'"), None), ('"full"', ("BAD_STRING", SHAPE, "'full'"), None),
    ("2", ("NOT_TYPED", SHAPE, "2"), '{"mode":"explicit","value":2}'), ("-1", ("NOT_TYPED", SHAPE, "-1"), None),
    ("true", ("NOT_TYPED", SHAPE, "True"), None), ("2.0", ("NOT_TYPED", SHAPE, "2.0"), None), ("null", None, None),
    ("[1,2]", ("NOT_TYPED", SHAPE, "[1, 2]"), '{"mode":"explicit","value":[1,2]}'), ("[1,-2]", ("NOT_TYPED", SHAPE, "[1, -2]"), None),
    ("[]", ("NOT_TYPED", SHAPE, "[]"), None), ("[1,2,3,4]", ("NOT_TYPED", SHAPE, "[1, 2, 3, 4]"), None),
    ('{"mode":"explicit","value":2}', None, None), ('{"mode":"explicit","value":2.0}', ("BAD_EXPLICIT_VALUE", None, "2.0"), None),
    ('{"mode":"explicit"}', ("BAD_EXPLICIT_VALUE", None, "None"), None), ('{"mode":"explicit","value":true}', ("BAD_EXPLICIT_VALUE", None, "True"), None),
    ('{"mode":"explicit","value":[]}', ("BAD_AXIS_LENGTH", None, "[]"), None), ('{"mode":"explicit","value":[1,2,3,4]}', ("BAD_AXIS_LENGTH", None, "[1, 2, 3, 4]"), None),
    ('{"mode":"explicit","value":[1,-2]}', ("BAD_EXPLICIT_VALUE", None, "[1, -2]"), None), ('{"mode":"explicit","value":[1,true]}', ("BAD_EXPLICIT_VALUE", None, "[1, True]"), None),
    ('{"mode":"explicit","value":"1"}', ("BAD_EXPLICIT_VALUE", None, "'1'"), None), ('{"mode":"same","value":-5}', None, None),
    ('{"mode":"reflect"}', ("BAD_MODE", None, "'reflect'"), None), ("{}", ("BAD_MODE", None, "None"), None), ('{"mode":1}', ("BAD_MODE", None, "1"), None),
]


#: In the ts dialect: component, config, diagnostics
GOLDEN_TS = [
    (CONV, '{"filters":32.5,"kernelSize":true}', [("NUMBER_NOT_INTEGER", "filters", None, "32.5"), ("NUMBER_NOT_A_NUMBER", "kernelSize", None, "True")]),
    (CONV, '{"filters":[1, {"a":2.0}, null, "x"],"kernelSize":3.0}', [("NUMBER_NOT_A_NUMBER", "filters", None, "[1, [object Object], None, 'x']")]),
    (CONV, '{"filters":"it\'s","kernelSize":{}}', [("NUMBER_NOT_A_NUMBER", "filters", None, "'it's'"), ("NUMBER_NOT_A_NUMBER", "kernelSize", None, "[object Object]")]),
    (CONV, '{"filters":12345678901234567890,"kernelSize":-0}', [("NUMBER_ABOVE_MAX", "filters", "2048", "12345678901234567000"), ("NUMBER_BELOW_MIN", "kernelSize", "1", "0")]),
    (CONV, '{"filters":1e22,"kernelSize":1e400}', [("NUMBER_ABOVE_MAX", "filters", "2048", "1e+22"), ("NUMBER_NOT_INTEGER", "kernelSize", None, "Infinity")]),
    (CONV, '{"filters":8,"kernelSize":3,"activation":["relu"]}', []),
    (CONV, '{"filters":NaN,"kernelSize":3}', [("NUMBER_NOT_A_NUMBER", "filters", None, "NaN")]),
    (CONV, '{"kernelSize":3}', [("REQUIRED_MISSING", "filters", None, None)]),
    (OUT, '{"learning_rate":1e-9}', [("NUMBER_BELOW_MIN", "learningRate", "1e-8", "1e-9")]),
    (OUT, '{"learning_rate":1e-6}', [("NUMBER_BELOW_RECOMMENDED", "learningRate", "0.00001", "0.000001")]),
    (OUT, '{"vocabSize":2000000.0}', [("NUMBER_ABOVE_MAX", "vocabSize", "1000000", "2000000")]),
    (OUT, '{"optimizer":["SGD"],"weight_decay":5}', [("ENUM_NOT_ALLOWED", "optimizer", "['adam', 'sgd', 'rmsprop', 'adamw', 'adagrad']", "['SGD']"), ("NUMBER_ABOVE_MAX", "weight_decay", "1", "5")]),
    (OUT, '{"weight_decay":5}', []),
    ("instance-normalization", '{"affine":false}', [("INFO_NO_NORMALIZATION_AFFINE", "affine", None, "False")]),
    ("quantization-aware", '{"bits":8.0}', []), ("quantization-aware", '{"bits":[8]}', []),
    ("quantization-aware", '{"bits":true}', [("ENUM_NOT_ALLOWED", "bits", "['4', '8']", "True")]),
    ("dropout", '{"rate":1.50}', [("NUMBER_ABOVE_MAX", "rate", "1", "1.5")]),
]
#: padding, verdict without its prefix, in the ts dialect where it differs
PADDINGS_TS = {
    "2.0": ("NOT_TYPED", SHAPE, "2"), '{"mode":"explicit","value":2.0}': None, '{"mode":"explicit"}': ("BAD_EXPLICIT_VALUE", None, "undefined"),
    "{}": ("BAD_MODE", None, "undefined"), **{x: ("BAD_MODE", None, "undefined") for x in ("[1,2]", "[1,-2]", "[]", "[1,2,3,4]")},
}


def verdicts(spark, rows, dialect="python"):
    frame = spark.createDataFrame([(str(i), c, t) for i, (c, t) in enumerate(rows)], "node_id string, component_id string, config string")
    found = sorted(validate.validate_configs(frame, dialect=dialect).collect(), key=lambda r: (int(r["node_id"]), r["param_pos"], r["diag_pos"]))
    return [[r for r in found if r["node_id"] == str(i)] for i in range(len(rows))]


def test_configs(spark):
    for (component, config, expected), got in zip(GOLDEN, verdicts(spark, [g[:2] for g in GOLDEN])):
        assert [(r["code"].removeprefix("PARAM_"), r["field"], r["expected"], r["got"]) for r in got] == expected, (component, config)
        for r in got:
            severity, template, hint = R.DIAGNOSTICS[r["code"]]
            values = {k: r[k] or "" for k in ("component_id", "field", "expected", "got")}
            assert (r["severity"], r["type"]) == (severity, f"parameter_{severity}")
            assert (r["message"], r["fix_hint"]) == (template.format(**values), hint.format(**values))


def test_padding(spark):
    texts = [f'{{"filters":8,"kernelSize":3,"padding":{p[0]}}}' for p in PADDINGS]
    for (padding, expected, _), got in zip(PADDINGS, verdicts(spark, [(CONV, t) for t in texts])):
        mine = [(r["code"].removeprefix("PARAM_PADDING_"), r["expected"], r["got"]) for r in got]
        assert mine == ([expected] if expected else []), padding
    frame = spark.createDataFrame([(CONV, t) for t in texts], "component_id string, config string")
    for (padding, _, new), r in zip(PADDINGS, normalize.normalize_configs(frame).collect()):
        assert r["normalized"] == f'{{"filters":8,"kernelSize":3,"padding":{new or padding}}}'
    again = normalize.normalize_configs(normalize.normalize_configs(frame), config_col="normalized", out="twice").collect()
    assert all(r["twice"] == r["normalized"] for r in again)


def test_second_dialect(spark):
    for (component, config, expected), got in zip(GOLDEN_TS, verdicts(spark, [g[:2] for g in GOLDEN_TS], "ts")):
        assert [(r["code"].removeprefix("PARAM_"), r["field"], r["expected"], r["got"]) for r in got] == expected, (component, config)
        assert all(r["type"] == f"parameter {r['severity']}" for r in got)
    texts = [f'{{"filters":8,"kernelSize":3,"padding":{p[0]}}}' for p in PADDINGS]
    for (padding, expected, _), got in zip(PADDINGS, verdicts(spark, [(CONV, t) for t in texts], "ts")):
        mine = [(r["code"].removeprefix("PARAM_PADDING_"), r["expected"], r["got"]) for r in got]
        expected = PADDINGS_TS.get(padding, expected)
        assert mine == ([expected] if expected else []), padding
    frame = spark.createDataFrame([(p, CONV, t) for p, t in zip((p[0] for p in PADDINGS), texts)], "node_id string, component_id string, config string")
    differ = validate.dialect_diff(frame).collect()
    assert {r["node_id"] for r in differ} == set(PADDINGS_TS) and {r["dialect"] for r in differ} == {"python", "ts"}
    with pytest.raises(ValueError):
        validate.validate_configs(frame, dialect="go")


@pytest.mark.parametrize("x, text", [(0.1 + 0.2, "0.30000000000000004"), (1e21, "1e+21"), (123e18, "123000000000000000000"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (-5e-324, "-5e-324"), (1e-6, "0.000001"), (-0.0, "0"), (100.0, "100")])
def test_js_numbers(x, text):
    assert js_number(x) == text


def test_documents(spark):
    nodes = [
        '{"id":1,"data":{"componentId":"dropout","layer_type":"dense","config":{"rate":2}}}', '{"data":{"config":{"componentId":"dropout","rate":2}}}',
        '{"id":null,"data":{"layer_type":"DROPOUT","config":{"rate":2}}}', '{"id":"x","data":{"componentId":"","layer_type":"dropout","rate":2}}',
        '{"id":"y","data":{"componentId":"conv2d","config":{"padding":1}}}', "7", "null", '{"id":"z","data":{"layer_type":"nope"}}', '{"id":"w"}', '"text"',
    ]
    documents = [f'{{"nodes":[{",".join(nodes)}],"k":1}}', '{"nodes":{}}', "{}", "[]", None, "bad", '{"nodes":[]}', '{"nodes":5}']
    frame = spark.createDataFrame(list(enumerate(documents)), "arch_id long, diagram string")
    got = sorted((r["arch_id"], r["node_pos"], r["node_id"], r["code"]) for r in validate.validate_architectures(frame).collect())
    assert got == [(0, k, i, "PARAM_NUMBER_ABOVE_MAX") for k, i in enumerate(["1", "", "None", "x"])]
    new = [r["normalized"] for r in normalize.normalize_diagrams(frame).orderBy("arch_id").collect()]
    assert new[1:] == documents[1:]
    out = json.loads(new[0])
    assert out["nodes"][4]["data"]["config"] == {"padding": {"mode": "explicit", "value": 1}} and out["k"] == 1
    assert out["nodes"][3]["data"]["config"] is None and out["nodes"][5:7] == [7, None] and out["nodes"][9] == "text"


def test_registry():
    params = [p for c in R.COMPONENTS for p in c.params]
    assert (len(R.COMPONENTS), len(params), len(R.DIAGNOSTICS), len(R.BY_LAYER)) == (44, 154, 17, 44)
    kinds = {k: sum(p.kind == k for p in params) for k in ("number", "enum", "padding", "bool", "string")}
    assert kinds == {"number": 102, "enum": 31, "padding": 3, "bool": 16, "string": 2}
    assert sum(p.required for p in params) == 7 and sum(len(p.notes) for p in params) == 6 and sum(bool(c.formula) for c in R.COMPONENTS) == 20
    document = json.loads(R.contract_json())
    assert document["version"] == 3 and [c["component_id"] for c in document["components"]] == sorted(R.BY_ID)


@pytest.mark.parametrize("name, expected", [("dFf", ["dFf", "d_ff"]), ("weight_decay", ["weight_decay", "weightDecay"]), ("p", ["p"])])
def test_spellings(name, expected):
    assert R.spellings(name) == expected


def test_registry_as_views_and_as_a_file(spark, tmp_path):
    from plumbline.sources import registry

    registry.register_views(spark)
    asked = spark.sql(
        "SELECT c.layer_type, p.key, d.severity FROM registry_params p JOIN registry_components c USING (component_id) "
        "JOIN registry_diagnostics d ON d.code = p.advisories[0].code WHERE p.key = 'affine'"
    )
    assert [tuple(r) for r in asked.collect()] == [("instance_normalization", "affine", "info")]
    text = registry.write_contract(str(tmp_path / "contract.json"))
    assert (tmp_path / "contract.json").read_text() == text == R.contract_json()
    document = json.loads(text)
    assert [len(document[k]) for k in ("components", "diagnostics")] == [44, 17]
    dropout = next(c for c in document["components"] if c["component_id"] == "dropout")
    assert dropout["params"][0]["numeric"] == {"integer": False, "min": 0.0, "max": 1.0, "warn_max": 0.7} and dropout["params"][0]["aliases"] == ["p"]


def test_shared_folder_is_never_local_on_a_cluster(spark):
    from types import SimpleNamespace

    from plumbline.sources.folders import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context, conf=conf))
