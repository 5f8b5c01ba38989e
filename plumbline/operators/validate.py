"""Validation of configs and architecture documents: narrow plans, no shuffle, batch or streaming.

A config column is JSON text. It is parsed twice, side by side: as variants, which know types, and as
texts, which keep what was written. The contract's parameters are joined by component (44 rows,
broadcast) and unfolded in verdict order.

There are two dialects. ``python`` is the canonical one. ``ts`` reads and prints values as JavaScript does:
all numbers are doubles, arrays are objects, what is missing is undefined, and one-element arrays pass as
their element where a name is due.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.contracts.registry import BY_ID, BY_LAYER, COMPONENTS, PADDING_SHAPE, spellings
from plumbline.functions.binding import let, parsed
from plumbline.functions.render import is_int_text, is_number, js_number, js_repr, js_str, rendered, repr_text, str_text
from plumbline.sources.registry import PARAMS, param_rows

VERDICT = ("type", "severity", "code", "field", "expected", "got", "message", "fix_hint")


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def found_key(values: Column, candidates: Column) -> Column:
    """The first candidate that has a value; a JSON null counts as none."""
    return F.get(F.filter(candidates, lambda c: values[c].isNotNull() & ~F.is_variant_null(values[c])), F.lit(0))


def is_active(values: Column, texts: Column, applies_when: Column, show: Callable[[Column, Column], Column] = str_text) -> Column:
    """Whether all controlling parameters have one of the values, turned into strings by ``show``, for which a parameter applies."""

    def one(a: Column) -> Column:
        return let(found_key(values, a["candidates"]), lambda key: F.array_contains(a["allowed"], F.lower(show(texts[key], kind_of(values[key])))))

    return F.when(F.size(applies_when) == 0, True).otherwise(F.forall(applies_when, one))


def _is_whole(d: Column) -> Column:
    """Whether a double has no fraction; beyond 2**53 none has one, and floor would leave the range of longs."""
    size = F.abs(d)
    return ~F.isnan(d) & (size < float("inf")) & ((size >= 2.0**53) | (d == F.floor(d)))


def _is_pad(kind: Column, text: Column, ts: bool = False) -> Column:
    if ts:
        d = text.try_cast("double")
        return F.coalesce(is_number(kind) & (d >= 0) & _is_whole(d), F.lit(False))
    return F.coalesce((kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE")) & text.rlike("^([0-9]+|-0+)$"), F.lit(False))


def _diag(code: str, got: tuple[Column, Column] | None = None) -> Column:
    text, kind = got if got else (F.lit(None), F.lit(None))
    return F.struct(F.lit(code).alias("code"), text.cast("string").alias("text"), kind.cast("string").alias("kind"))


def _number(p: Column, t: Column, kind: Column, d: Column, ts: bool = False) -> Column:
    got = (F.btrim(t, F.lit('"')), kind)
    whole = F.coalesce(_is_whole(d), F.lit(False))
    whole = whole if ts else F.when(is_int_text(t), True).otherwise(whole)
    return (
        F.when(~is_number(kind), _diag("PARAM_NUMBER_NOT_A_NUMBER", (t, kind)))
        .when(F.isnan(d) & F.lit(ts), _diag("PARAM_NUMBER_NOT_A_NUMBER", got))
        .when(p["integer"] & ~whole, _diag("PARAM_NUMBER_NOT_INTEGER", got))
        .when(F.isnan(d), None)
        .when(d < p["min"], _diag("PARAM_NUMBER_BELOW_MIN", got))
        .when(d > p["max"], _diag("PARAM_NUMBER_ABOVE_MAX", got))
        .when(d < p["warn_min"], _diag("PARAM_NUMBER_BELOW_RECOMMENDED", got))
        .when(d > p["warn_max"], _diag("PARAM_NUMBER_ABOVE_RECOMMENDED", got))
    )


def _padding(v: Column, t: Column, kind: Column, ts: bool = False) -> Column:
    missing = F.lit("UNDEFINED" if ts else "VOID")

    def typed(inside: Column) -> Column:
        def of(name: str) -> Column:
            return F.struct(inside[name].alias("text"), F.coalesce(kind_of(F.try_variant_get(v, f"$.{name}", "variant")), missing).alias("kind"))

        def judged(mode: Column) -> Column:
            good = F.coalesce((mode["kind"] == "STRING") & mode["text"].isin("valid", "same", "explicit"), F.lit(False))
            bad = _diag("PARAM_PADDING_BAD_MODE", (mode["text"], mode["kind"]))
            return F.when(~good, bad).when(mode["text"] == "explicit", let(of("value"), explicit))

        return let(of("mode"), judged)

    def explicit(value: Column) -> Column:
        got = (value["text"], value["kind"])
        items = F.arrays_zip(
            F.from_json(value["text"], "array<string>").alias("text"), F.try_variant_get(v, "$.value", "array<variant>").alias("item")
        )
        axes = let(
            items,
            lambda e: F.when(~F.size(e).between(1, 3), _diag("PARAM_PADDING_BAD_AXIS_LENGTH", got)).when(
                F.exists(e, lambda x: ~_is_pad(kind_of(x["item"]), x["text"], ts)), _diag("PARAM_PADDING_BAD_EXPLICIT_VALUE", got)
            ),
        )
        plain = F.when(~_is_pad(value["kind"], value["text"], ts), _diag("PARAM_PADDING_BAD_EXPLICIT_VALUE", got))
        return F.when(value["kind"].startswith("ARRAY"), axes).otherwise(plain)

    return (
        F.when(kind == "STRING", F.when(~t.isin("valid", "same"), _diag("PARAM_PADDING_BAD_STRING", (t, kind))))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY") if ts else kind.startswith("OBJECT"), let(F.from_json(t, "map<string,string>"), typed))
        .otherwise(_diag("PARAM_PADDING_NOT_TYPED", (t, kind)))
    )


def validate_configs(
    df: DataFrame,
    component_col: str = "component_id",
    config_col: str = "config",
    node_id_col: str = "node_id",
    keep: tuple[str, ...] = (),
    dialect: str = "python",
) -> DataFrame:
    """A row per diagnostic: ``keep``, node_id, component_id, param_pos, diag_pos and VERDICT.

    Rows of unknown components, and configs that are not JSON objects, give no diagnostics. dialect:
    ``python`` or ``ts``.
    """
    if dialect not in ("python", "ts"):
        raise ValueError(f"unknown dialect {dialect!r}")
    entries = df.select(
        *[F.col(c) for c in keep],
        F.col(node_id_col).cast("string").alias("node_id"),
        F.col(component_col).alias("__component"),
        parsed(F.col(config_col)).alias("config"),
    )
    return _verdicts(entries, keep, dialect)


def _verdicts(entries: DataFrame, keep: tuple[str, ...], dialect: str) -> DataFrame:
    """Verdicts on configs that are ``parsed`` already: ``keep``, node_id, __component and config."""
    ts = dialect == "ts"
    to_str, to_repr = (js_str, js_repr) if ts else (str_text, repr_text)
    by_component = _contract_rows(entries.sparkSession, dialect)
    joined = entries.join(F.broadcast(by_component), F.col("__component") == F.col("component_id"))
    each = joined.select(
        *keep, "node_id", "component_id", F.col("config.values").alias("__values"), F.col("config.texts").alias("__texts"), F.explode("__params").alias("p")
    )
    values, texts, p = F.col("__values"), F.col("__texts"), F.col("p")
    # One condition that needs p: as two, the null test would move below the unfolding and parse every config again.
    active = each.where(F.when(values.isNull(), False).otherwise(is_active(values, texts, p["applies_when"], to_str))).withColumn("__key", found_key(values, p["candidates"]))
    active = active.where(F.col("__key").isNotNull() | p["required"]).select(
        *keep, "node_id", "component_id", "p", values[F.col("__key")].alias("__v"), texts[F.col("__key")].alias("__t")
    )
    number = F.when(F.col("p.kind") == "number", F.translate("__t", '"', "").try_cast("double"))
    active = active.select("*", kind_of(F.col("__v")).alias("__kind"), number.alias("__d"))
    v, t, kind = F.col("__v"), F.col("__t"), F.col("__kind")
    printed = F.when((p["kind"] == "enum") | (F.size(p["advisories"]) > 0), to_str(t, kind))
    primary = (
        F.when(v.isNull(), _diag("PARAM_REQUIRED_MISSING"))
        .when(p["kind"] == "number", _number(p, t, kind, F.col("__d"), ts))
        .when(p["kind"] == "padding", _padding(v, t, kind, ts))
        .when((p["kind"] == "enum") & ~F.array_contains(p["enum_values"], printed), _diag("PARAM_ENUM_NOT_ALLOWED", (t, kind)))
    )
    notes = F.when(
        v.isNotNull() & (F.size(p["advisories"]) > 0),
        F.transform(
            let(F.lower(printed), lambda name: F.filter(p["advisories"], lambda a: a["when_value"] == name)),
            lambda a: F.struct(a["code"].alias("code"), t.alias("text"), kind.alias("kind")),
        ),
    )
    # A step of its own: inside a function over arrays, the large expression would be interpreted.
    judged = active.select(*keep, "node_id", "component_id", F.col("p.param_pos").alias("param_pos"), primary.alias("__one"), notes.alias("__notes"))
    one, notes = F.col("__one"), F.col("__notes")
    every = F.when(one.isNull(), notes).when(notes.isNull(), F.array(one)).otherwise(F.concat(F.array(one), notes))
    rows = judged.select(*keep, "node_id", "component_id", "param_pos", F.posexplode(every).alias("diag_pos", "d"))
    rows = rows.select(*keep, "node_id", "component_id", "param_pos", "diag_pos", "d.*")
    messages = _message_rows(entries.sparkSession, dialect)
    rows = rows.join(F.broadcast(messages), ["component_id", "param_pos", "code"])
    got = F.when(F.col("code") != "PARAM_REQUIRED_MISSING", to_repr(F.col("text"), F.col("kind")))
    rows = rows.withColumn("got", got)
    message = F.when(F.col("after").isNull(), F.col("before")).otherwise(F.concat("before", F.coalesce("got", F.lit("")), "after"))
    return rows.select(
        *keep, "node_id", "component_id", "param_pos", "diag_pos", "type", "severity", "code",
        "field", "expected", "got", message.alias("message"), "fix_hint",
    )


def dialect_diff(df: DataFrame, **options) -> DataFrame:
    """Diagnostics that one dialect gives and the other does not, with ``dialect``: whose they are.

    ``options`` are those of validate_configs. The types, which always differ, are left out.
    """
    of = {d: validate_configs(df, **options, dialect=d).drop("type").withColumn("__n", F.lit(n)) for d, n in (("python", 1), ("ts", -1))}
    both = of["python"].unionByName(of["ts"])
    columns = [c for c in both.columns if c != "__n"]
    counted = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n != 0")
    dialect = F.when(F.col("__n") > 0, "python").otherwise("ts")
    return counted.withColumn("dialect", dialect).withColumn("__n", F.explode(F.sequence(F.lit(1), F.abs("__n")))).drop("__n")


def _param_rows(dialect: str) -> list[dict]:
    """Parameters with bounds as the dialect prints them."""
    js_bound = lambda x: None if x is None else js_number(x)
    names = [x.split()[0] for x in _split_fields(PARAMS)]
    return [dict(zip(names, r)) for r in (param_rows(js_bound) if dialect == "ts" else param_rows())]


#: What the checks of a parameter need to know of it.
CHECKED = (
    "param_pos int, kind string, required boolean, min double, max double, warn_min double, warn_max double, integer boolean, "
    "enum_values array<string>, candidates array<string>, "
    "applies_when array<struct<control_key: string, candidates: array<string>, allowed: array<string>>>, "
    "advisories array<struct<when_value: string, code: string>>"
)


def _contract_rows(spark, dialect: str = "python") -> DataFrame:
    """A row per component with its parameters in order."""
    fields = _split_fields(CHECKED)
    rows: dict[str, list] = {c: [] for c in BY_ID}
    for r in _param_rows(dialect):
        rows[r["component_id"]].append(tuple(r[f.split()[0]] for f in fields))
    inner = ", ".join(x.replace(" ", ": ", 1) for x in fields)
    return spark.createDataFrame(list(rows.items()), f"component_id string, __params array<struct<{inner}>>")


#: Codes of diagnostics by kind of parameter, with the field that holds what is expected.
CODES = {
    "number": {
        "PARAM_NUMBER_NOT_A_NUMBER": None, "PARAM_NUMBER_NOT_INTEGER": None, "PARAM_NUMBER_BELOW_MIN": "expected_min",
        "PARAM_NUMBER_ABOVE_MAX": "expected_max", "PARAM_NUMBER_BELOW_RECOMMENDED": "expected_warn_min",
        "PARAM_NUMBER_ABOVE_RECOMMENDED": "expected_warn_max",
    },
    "padding": {
        "PARAM_PADDING_NOT_TYPED": "shape", "PARAM_PADDING_BAD_STRING": "shape", "PARAM_PADDING_BAD_MODE": None,
        "PARAM_PADDING_BAD_EXPLICIT_VALUE": None, "PARAM_PADDING_BAD_AXIS_LENGTH": None,
    },
    "enum": {"PARAM_ENUM_NOT_ALLOWED": "expected_enum"},
}


def _message_rows(spark, dialect: str = "python") -> DataFrame:
    """A row per parameter and diagnostic that it can give, with all of the message that the contract decides."""
    rows = []
    for r in _param_rows(dialect):
        codes = {"PARAM_REQUIRED_MISSING": None} | CODES.get(r["kind"], {}) | {code: None for _, code in r["advisories"]}
        for code, name in codes.items():
            expected = (r | {"shape": PADDING_SHAPE}).get(name)
            filled = {"component_id": r["component_id"], "field": r["key"], "expected": expected or ""}
            rows.append((r["component_id"], r["param_pos"], code, r["key"], expected, *rendered(code, " " if dialect == "ts" else "_", **filled)))
    return spark.createDataFrame(
        rows,
        "component_id string, param_pos int, code string, field string, expected string, type string, severity string, "
        "before string, after string, fix_hint string",
    )


def _split_fields(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


def _object_text(text: Column, v: Column) -> Column:
    """Text of a JSON value if it is an object, else null."""
    return F.when(F.coalesce(kind_of(v).startswith("OBJECT"), F.lit(False)), text)


def layer_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in BY_LAYER.items() for x in pair])


def _truthy(text: Column, kind: Column) -> Column:
    """str(value) of what counts as true: not null, not empty, not zero, not false."""
    falsy = (
        (kind == "VOID") | ((kind == "STRING") & (text == "")) | ((kind == "BOOLEAN") & (text == "false"))
        | (is_number(kind) & (text.try_cast("double") == 0)) | text.rlike(r"^(\[\s*\]|\{\s*\})$") & (kind != "STRING")
    )
    return F.when(text.isNotNull() & kind.isNotNull() & ~falsy, str_text(text, kind))


def resolve_component(data_texts: Column, data_values: Column, config_texts: Column, config_values: Column) -> Column:
    """componentId of the data or of the config, else by layer type in any case; null if neither is known."""
    own = _truthy(data_texts["componentId"], kind_of(data_values["componentId"]))
    inner = _truthy(config_texts["componentId"], kind_of(config_values["componentId"]))
    layer = F.when(F.map_contains_key(data_texts, "layer_type"), str_text(data_texts["layer_type"], kind_of(data_values["layer_type"]))).otherwise("")
    return F.coalesce(own, inner, F.element_at(layer_map(), F.lower(layer)))


def architecture_nodes(df: DataFrame, diagram_col: str = "diagram", keep: tuple[str, ...] = ("arch_id",)) -> DataFrame:
    """A row per node that is an object and whose component is known: ``keep``, node_pos, node_id, component_id, config (see parsed).

    Nodes are unfolded, and what is known of a node is unfolded again from a list of one or none: a
    condition on the component would move below the parsing and repeat it.
    """
    listed = F.arrays_zip(
        F.from_json(F.col(diagram_col), "nodes array<string>")["nodes"].alias("text"),
        F.from_json(F.col(diagram_col), "nodes array<variant>")["nodes"].alias("value"),
    )
    nodes = df.select(*keep, F.posexplode(listed).alias("node_pos", "node"))

    def known(node: Column) -> Column:
        id_text = str_text(node["texts"]["id"], kind_of(node["values"]["id"]))
        node_id = F.when(F.map_contains_key(node["texts"], F.lit("id")), id_text).otherwise("")
        data = F.coalesce(_object_text(node["texts"]["data"], node["values"]["data"]), F.lit("{}"))

        def with_data(d: Column) -> Column:
            config = _object_text(d["texts"]["config"], d["values"]["config"])
            inner = F.when(config.isNull(), d).otherwise(parsed(config))
            return let(inner, lambda c: let(resolve_component(d["texts"], d["values"], c["texts"], c["values"]), lambda i: one(i, c)))

        def one(component: Column, config: Column) -> Column:
            row = F.struct(node_id.alias("node_id"), component.alias("component_id"), config.alias("config"))
            return F.when(component.isNotNull(), F.array(row))

        return let(parsed(data), with_data)

    is_object = F.coalesce(kind_of(F.col("node.value")).startswith("OBJECT"), F.lit(False))
    found = F.when(is_object, let(parsed(F.col("node.text")), known))
    return nodes.select(*keep, "node_pos", F.explode(found).alias("n")).select(*keep, "node_pos", "n.*")


def validate_architectures(df: DataFrame, diagram_col: str = "diagram", arch_id_col: str = "arch_id") -> DataFrame:
    """Diagnostics of all nodes of all documents: arch_id, node_pos and the columns of validate_configs.

    Documents are read in the ``python`` dialect only: the other has no notion of them.
    """
    nodes = architecture_nodes(df.withColumnRenamed(arch_id_col, "arch_id"), diagram_col)
    return _verdicts(nodes.withColumnRenamed("component_id", "__component"), ("arch_id", "node_pos"), "python")


def param_flags(df: DataFrame, component_col: str = "component_id", key_col: str = "key", config_col: str = "config") -> DataFrame:
    """``df`` with ``is_integer`` (null unless a number parameter of that name) and ``is_applicable`` (true if unknown).

    Names match in any spelling of either side; aliases do not count. An inactive parameter is one
    whose controlling parameter has another value, read as the ``ts`` dialect reads it.
    """
    rows = [
        (c.component_id, s, p.kind == "number", p.integer, [(k, spellings(k), [x.lower() for x in v]) for k, v in p.when.items()])
        for c in COMPONENTS
        for s, p in {s: p for p in reversed(c.params) for s in spellings(p.key)}.items()
    ]
    lookup = df.sparkSession.createDataFrame(
        rows,
        "__c string, __k string, __number boolean, __integer boolean, __when array<struct<control_key: string, candidates: array<string>, allowed: array<string>>>",
    )
    joined = df.withColumn("__config", parsed(F.col(config_col))).join(
        F.broadcast(lookup), (F.col(component_col) == F.col("__c")) & (F.col(key_col) == F.col("__k")), "left"
    )
    values = F.col("__config.values")
    active = is_active(values, F.col("__config.texts"), F.col("__when"), js_str)
    return joined.select(
        *df.columns,
        F.when(F.col("__number"), F.col("__integer")).alias("is_integer"),
        F.when(F.col("__c").isNull() | values.isNull(), True).otherwise(active).alias("is_applicable"),
    )
