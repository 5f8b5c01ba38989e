"""Values as Python and as JavaScript print them, and message templates, as expressions."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.contracts.registry import DIAGNOSTICS
from plumbline.functions.binding import let


@F.pandas_udf(T.StringType())
def _printed(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    """repr of the few values that expressions can't print: nested ones, odd strings, very large floats."""

    def one(text: str | None, kind: str | None) -> str | None:
        if text is None:
            return None
        if kind == "STRING":
            return repr(text)
        return repr(json.loads(re.sub(r'"(NaN|-?Infinity)"', r"\1", text)))

    return pd.Series([one(t, k) for t, k in zip(texts, kinds)], dtype=object)


def is_number(kind: Column) -> Column:
    return kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE") | kind.startswith("DECIMAL")


def is_int_text(text: Column) -> Column:
    """Whether a number's text is an integer literal; a float has a point, an exponent, or is not finite."""
    return text.rlike("^-?[0-9]+$")


def float_text(text: Column) -> Column:
    """A float as Python prints it, from Spark's text of it: an exponent only below 1e-4 and from 1e16 on."""
    d = text.try_cast("double")
    s = d.cast("string")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    plain = F.regexp_replace(s, "^-", "")
    exponent = F.regexp_extract(plain, "E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "E.*$", ""), "\\.0$", ""), "\\.", "")
    rest = F.regexp_replace(digits, "^.", "")
    first = F.substring(digits, 1, 1)
    padded = F.when(F.length(digits) > exponent + 1, digits).otherwise(F.rpad(digits, exponent + 1, F.lit("0")))
    point = F.concat(
        F.substring(padded, F.lit(1), exponent + 1),
        F.lit("."),
        F.when(F.length(digits) > exponent + 1, F.substring(padded, exponent + 2, F.length(padded))).otherwise("0"),
    )
    small = F.concat(
        first,
        F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""),
        F.lit("e-"),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    return (
        F.when(F.abs(d).between(1e-3, 9_999_999.0), s)  # as both print them
        .when(F.isnan(d), "nan")
        .when(s.isin("Infinity", "-Infinity"), F.concat(sign, F.lit("inf")))
        .when(exponent.isNull(), s)
        .when(exponent >= 0, F.concat(sign, point))
        .when(exponent >= -4, F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
        .otherwise(F.concat(sign, small))
    )


def str_text(text: Column, kind: Column) -> Column:
    """str(value) of a scalar; nested values give their JSON text, which equals no name in the contract."""
    return (
        F.when(text.isNull() | kind.isNull() | (kind == "VOID"), "None")
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(is_number(kind) & ~is_int_text(text), float_text(text))
        .when(is_number(kind) & text.rlike("^-0+$"), "0")
        .otherwise(text)
    )


def repr_text(text: Column, kind: Column) -> Column:
    """repr(value), by expressions for plain scalars and by an Arrow UDF for the rest."""
    odd = (
        kind.startswith("ARRAY") | kind.startswith("OBJECT")
        | ((kind == "STRING") & text.rlike("['\\\\\\\\]|[^ -~]"))
        | (is_number(kind) & F.abs(text.try_cast("double")).between(1e15, 1e308) & ~is_int_text(text))
    )
    plain = F.when(kind == "STRING", F.concat(F.lit("'"), text, F.lit("'"))).otherwise(str_text(text, kind))
    return F.when(F.coalesce(odd, F.lit(False)), _printed(F.when(odd, text), kind)).otherwise(plain)


def js_number(d: float) -> str:
    """A number as JavaScript prints it: no point before a zero fraction, an exponent below 1e-6 and from 1e21 on."""
    if d != d or d in (float("inf"), float("-inf")):
        return "NaN" if d != d else "Infinity" if d > 0 else "-Infinity"
    if d == 0:
        return "0"
    digits, _, exponent = f"{abs(Decimal(repr(float(d)))):e}".partition("e")
    digits, e = digits.replace(".", "").rstrip("0"), int(exponent)
    if e >= 21 or e < -6:
        out = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{e:+d}"
    elif e < 0:
        out = "0." + "0" * (-e - 1) + digits
    else:
        digits = digits.ljust(e + 1, "0")
        out = digits[: e + 1] + ("." + digits[e + 1 :] if digits[e + 1 :] else "")
    return "-" + out if d < 0 else out


def _js_value(x: object) -> str:
    if isinstance(x, str):
        return f"'{x}'"
    if x is None or isinstance(x, bool):
        return str(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(_js_value, x)) + "]"
    return "[object Object]" if isinstance(x, dict) else js_number(x)


def _as_double(digits: str) -> float:
    return float(digits)  # unlike int's, never too large


@F.pandas_udf(T.StringType())
def _js_printed(texts: pd.Series) -> pd.Series:
    """Arrays, and numbers far from 1, as the second dialect prints them."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        return _js_value(json.loads(re.sub(r'^"(NaN|-?Infinity)"$', r"\1", text), parse_int=_as_double))

    return pd.Series([one(t) for t in texts], dtype=object)


def _js_scalar(text: Column, kind: Column) -> Column:
    """A boolean, or a number near 1, as JavaScript turns it into a string; any other text as it is."""
    number = F.regexp_replace(text.try_cast("double").cast("string"), r"^-?0\.0$|\.0$", "")
    return (
        F.when(is_number(kind) & is_int_text(text), F.when(text.rlike("^-?0+$"), "0").otherwise(text))
        .when(is_number(kind), F.when(number == "", "0").otherwise(number))
        .otherwise(text)
    )


def js_str(text: Column, kind: Column) -> Column:
    """A value as JavaScript turns it into a string, to be compared with names of the contract.

    What is missing is ``undefined``. Arrays of one element, and such arrays in each other up to three
    deep, give their element's string; others give their JSON text, which equals no name.
    """

    def opened(x: Column) -> Column:
        def inner(items: Column) -> Column:
            first = F.struct(F.get(items, 0).alias("text"), F.regexp_extract(x["kind"], "^ARRAY<(.*)>$", 1).alias("kind"))
            return F.when(F.size(items) == 1, first).otherwise(x)

        return F.when(x["kind"].startswith("ARRAY"), let(F.from_json(x["text"], "array<string>"), inner)).otherwise(x)

    def shown(text: Column, kind: Column) -> Column:
        return F.when(kind.isNull() | (kind == "UNDEFINED"), "undefined").when(kind == "VOID", "null").otherwise(_js_scalar(text, kind))

    whole = F.struct(text.alias("text"), kind.alias("kind"))
    deep = let(whole, lambda a: let(opened(a), lambda b: let(opened(b), lambda c: let(opened(c), lambda x: shown(x["text"], x["kind"])))))
    return F.when(kind.startswith("ARRAY"), deep).otherwise(shown(text, kind))


def js_repr(text: Column, kind: Column) -> Column:
    """A value as the second dialect prints it: scalars by expressions, arrays and numbers far from 1 by an Arrow UDF."""
    size = F.abs(text.try_cast("double"))
    near = F.when(is_int_text(text), F.length(text) <= 15).otherwise((size >= 1e-3) & (size < 1e7))
    odd = F.coalesce(kind.startswith("ARRAY") | (is_number(kind) & ~near), F.lit(False))
    plain = (
        F.when(kind.isNull() | (kind == "UNDEFINED"), "undefined")
        .when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind == "STRING", F.concat(F.lit("'"), text, F.lit("'")))
        .when(kind.startswith("OBJECT"), "[object Object]")
        .otherwise(_js_scalar(text, kind))
    )
    return F.when(odd, _js_printed(F.when(odd, text))).otherwise(plain)


def rendered(code: str, joint: str = "_", **values: str) -> tuple[str, str, str, str | None, str]:
    """type, severity, the message before and after the value that was found (after: null if it names none), and the hint.

    All else of a message is known from the contract. joint: what stands between the type's two words.
    """
    severity, template, hint = DIAGNOSTICS[code]
    before, *after = template.format(**values, got="\x00").split("\x00")
    return "parameter" + joint + severity, severity, before, "\x00".join(after) if after else None, hint.format(**values, got="")
