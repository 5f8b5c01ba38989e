"""Normalization: old forms of padding become typed objects; everything else is kept as written.

Objects are rebuilt from their texts, entry by entry, so numbers keep their spelling and keys their
order. All of it is expressions on one row: no unfolding and regrouping, no shuffle. Every object is
parsed once, and bound to a name for all that follows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.contracts.registry import BY_ID, COMPONENTS
from plumbline.functions.binding import let, parsed
from plumbline.operators.validate import _is_pad, kind_of, layer_map

#: Components with a typed padding parameter, and the keys under which a config may hold it.
PADDED = {c.component_id: p.candidates for c in COMPONENTS for p in c.params if p.kind == "padding"}


def quoted(s: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")


def raw(text: Column, v: Column) -> Column:
    """An entry as JSON text."""
    return F.when(v.isNull() | F.is_variant_null(v), "null").when(kind_of(v) == "STRING", quoted(text)).otherwise(text)


def _object(v: Column) -> Column:
    return F.coalesce(kind_of(v).startswith("OBJECT"), F.lit(False))


def rebuilt(entries: Column, key: Column, new: Column) -> Column:
    """JSON text of a ``parsed`` object with the entry ``key`` replaced by ``new``, or added at the end."""
    texts, values = entries["texts"], entries["values"]

    def joined(n: Column) -> Column:
        kept = F.transform(F.map_keys(texts), lambda k: F.concat(quoted(k), F.lit(":"), F.when(k == key, n).otherwise(raw(texts[k], values[k]))))
        more = F.when(F.map_contains_key(texts, key), F.array().cast("array<string>")).otherwise(F.array(F.concat(quoted(key), F.lit(":"), n)))
        return F.concat(F.lit("{"), F.array_join(F.concat(kept, more), ","), F.lit("}"))

    return let(new, joined)


def normalized_padding(text: Column, v: Column) -> Column:
    """JSON text of an upgraded padding value: a whole number from 0, one to three of them, 'same' or 'valid'."""

    def upgraded(kind: Column) -> Column:
        items = F.arrays_zip(
            F.from_json(text, "array<string>").alias("text"), F.try_variant_get(v, "$", "array<variant>").alias("item")
        )
        all_pads = let(items, lambda e: F.size(e).between(1, 3) & F.forall(e, lambda x: _is_pad(kind_of(x["item"]), x["text"])))
        explicit = F.concat(F.lit('{"mode":"explicit","value":'), text, F.lit("}"))
        good = F.when(kind == "STRING", False).when(kind.startswith("ARRAY"), F.coalesce(all_pads, F.lit(False))).otherwise(_is_pad(kind, text))
        return (
            F.when((kind == "STRING") & text.isin("same", "valid"), F.concat(F.lit('{"mode":'), quoted(text), F.lit("}")))
            .when(good, explicit)
            .otherwise(raw(text, v))
        )

    return let(kind_of(v), upgraded)


def normalized_config(identifier: Column, config: Column) -> Column:
    """JSON text of a config, upgraded if ``identifier`` is a component with typed padding, or a layer type of one."""
    known = F.when(identifier.isin(*BY_ID), identifier).otherwise(F.element_at(layer_map(), F.lower(identifier)))

    def upgraded(entries: Column) -> Column:
        out = config
        for keys in {tuple(v) for v in PADDED.values()}:
            own = known.isin(*[c for c, v in PADDED.items() if tuple(v) == keys])
            present = reduce(lambda rest, k: F.when(F.map_contains_key(entries["texts"], k), k).otherwise(rest), reversed(keys), F.lit(None).cast("string"))
            new = rebuilt(entries, present, normalized_padding(entries["texts"][present], entries["values"][present]))
            out = F.when(F.coalesce(own & present.isNotNull(), F.lit(False)), new).otherwise(out)
        return out

    return F.when(known.isin(*PADDED), let(parsed(config), upgraded)).otherwise(config)


def normalize_configs(df: DataFrame, identifier_col: str = "component_id", config_col: str = "config", out: str = "normalized") -> DataFrame:
    return df.withColumn(out, normalized_config(F.col(identifier_col), F.col(config_col)))


def _string(entries: Column, key: str) -> Column:
    """The entry's text if it is a string other than the empty one."""
    text = entries["texts"][key]
    return F.when((kind_of(entries["values"][key]) == "STRING") & (text != ""), text)


def _unit(holder: Column, identifier: Column) -> Column:
    """The text of a ``parsed`` object with its ``config`` upgraded; a missing config becomes null."""
    text, v = holder["texts"]["config"], holder["values"]["config"]
    new = F.when(_object(v), normalized_config(identifier, text)).otherwise(raw(text, v))
    return rebuilt(holder, F.lit("config"), F.coalesce(new, F.lit("null")))


def _over_list(df: DataFrame, column: str, out: str, name: str, one: Callable[[Column, Column], Column]) -> DataFrame:
    """Rewrite every object in the list ``name`` of a document; documents without such a list stay as they are."""
    text = F.col(column)

    def document(entries: Column) -> Column:
        listed = entries["texts"][name]
        items = F.arrays_zip(F.from_json(listed, "array<string>").alias("text"), F.from_json(listed, "array<variant>").alias("item"))
        new = F.transform(items, lambda e: F.when(_object(e["item"]), let(parsed(e["text"]), lambda x: one(x, e["text"]))).otherwise(raw(e["text"], e["item"])))
        array = F.concat(F.lit("["), F.array_join(new, ","), F.lit("]"))
        has_list = F.coalesce(kind_of(entries["values"][name]).startswith("ARRAY"), F.lit(False))
        return F.when(has_list, rebuilt(entries, F.lit(name), array)).otherwise(text)

    return df.withColumn(out, let(parsed(text), document))


def normalize_diagrams(df: DataFrame, diagram_col: str = "diagram", out: str = "normalized") -> DataFrame:
    """``nodes[*].data.config`` by the data's componentId, else layer_type."""

    def node(entries: Column, text: Column) -> Column:
        def data(d: Column) -> Column:
            own = d["texts"]["componentId"]
            absent = own.isNull() | (kind_of(d["values"]["componentId"]) == "VOID") | own.isin("", "false", "0")
            identifier = F.when(absent, _string(d, "layer_type")).otherwise(_string(d, "componentId"))
            return rebuilt(entries, F.lit("data"), let(identifier, lambda i: _unit(d, i)))

        return F.when(_object(entries["values"]["data"]), let(parsed(entries["texts"]["data"]), data)).otherwise(text)

    return _over_list(df, diagram_col, out, "nodes", node)


def normalize_layer_lists(df: DataFrame, architecture_col: str = "architecture", out: str = "normalized") -> DataFrame:
    """``layers[*].config`` by the layer's type."""
    return _over_list(df, architecture_col, out, "layers", lambda entries, _: _unit(entries, _string(entries, "type")))
