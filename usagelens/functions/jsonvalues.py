"""JSON as values: equality, any-depth search, and cleaning before storage."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_TOKEN = r'"(?:[^"\\]|\\.)*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[^"0-9-]+|.'
_NUMBER = r"^-?[0-9]"
# Digits that a stored decimal holds. Numbers beyond, and those with exponents, are spelled by their digits.
DIGITS = 38
_UNSETTLED = rf"[0-9][eE]|[0-9.]{{{DIGITS}}}"


def _listed(text: Column) -> Column:
    """The text as the first element of a list with a known second one; text after a value moves or loses that."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"~"]')))


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _alone(listed: Column) -> Column:
    alone = (F.try_variant_get(listed, "$[1]", "string") == "~") & F.try_variant_get(listed, "$[2]", "variant").isNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def parsed(text: Column) -> Column:
    """The JSON value of a whole text; null where the text is anything else, or goes on after a value."""
    return _bound(_listed(text), _alone)


def _spelled(tokens: Column) -> Column:
    """Tokens with a letter before what strings and numbers hold, numbers spelled by value.

    A number is 0.kept times ten to the power of point. It is spelled in full where a stored
    decimal could hold it. An exponent of ten digits and more is beyond reckoning: such a
    number stays as its digits and its exponent are.
    """
    parts = F.transform(tokens, lambda t: F.struct(
        t.alias("t"), F.rlike(t, F.lit(_NUMBER)).alias("number"), F.regexp_extract(t, r"^-?([0-9]+)", 1).alias("whole"),
        F.regexp_extract(t, r"^-?[0-9]+\.([0-9]+)", 1).alias("part"), F.regexp_extract(t, r"^-?[0-9.]+[eE](.*)$", 1).alias("exponent"),
    ))
    digits = F.transform(parts, lambda p: F.struct(
        p["t"].alias("t"), p["number"].alias("number"), p["exponent"].alias("exponent"), F.length(p["whole"]).alias("whole"),
        F.concat(p["whole"], p["part"]).alias("digits"), F.regexp_replace(p["exponent"], r"^([+-]?)0*(?=[0-9])", "$1").alias("power"),
    ))
    placed = F.transform(digits, lambda d: F.struct(
        d["t"].alias("t"), d["number"].alias("number"), F.upper(d["t"]).alias("far"), F.regexp_replace(d["digits"], "^0+|0+$", "").alias("kept"),
        F.when(F.length(d["power"]) < 11, F.coalesce(d["power"].try_cast("bigint"), F.lit(0).cast("bigint"))
               + d["whole"] - F.length(F.regexp_extract(d["digits"], "^0*", 0))).alias("point"),
    ))

    def spelling(p: Column) -> Column:
        kept, n = p["kept"], F.length(p["kept"])
        # The places are few where they are used.
        at = F.least(F.greatest(p["point"], F.lit(-DIGITS).cast("bigint")), F.lit(DIGITS).cast("bigint")).cast("int")
        value = (
            F.when(n == 0, "0").when(p["point"].isNull(), F.regexp_replace(p["far"], "^-", ""))
            .when((p["point"] >= n) & (p["point"] <= DIGITS), F.concat(kept, F.repeat(F.lit("0"), at - n)))
            .when((p["point"] > 0) & (p["point"] < n) & (n <= DIGITS), F.concat(F.left(kept, at), F.lit("."), F.substring(kept, at + 1, n)))
            .when((p["point"] <= 0) & (n - p["point"] <= DIGITS), F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), kept))
            .otherwise(F.concat(kept, F.lit("E"), (p["point"] - n).cast("string")))
        )
        sign = F.when(F.startswith(p["t"], F.lit("-")) & (n > 0), "-").otherwise("")
        return (
            F.when(p["number"], F.concat(F.lit('"n'), sign, value, F.lit('"')))
            .when(F.startswith(p["t"], F.lit('"')), F.concat(F.lit('"s'), F.substring(p["t"], F.lit(2), F.length(p["t"])))).otherwise(p["t"])
        )

    return F.transform(placed, spelling)


def canonical_json(text: Column) -> Column:
    """One spelling per JSON value: sorted keys, no spaces, numbers by value.

    Numbers are compared by their digits and exponent, never as floating point, so
    ``1e1``, ``10.0`` and ``10`` are one and long integers stay apart. Invalid JSON
    gives null. Repeated keys keep the last value (see session settings).
    """
    lettered = F.array_join(_spelled(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))), "")
    # A quote inside a string has a backslash before it, so the letters stand at starts alone.
    numbers = F.regexp_replace(F.to_json(F.try_parse_json(lettered)), r'(?<!\\)"n([0-9.E+-]+)"', "$1")
    far = F.regexp_replace(numbers, r'(?<!\\)"s', '"')
    plain = lambda value: F.when(value.isNotNull(), F.when(F.rlike(text, F.lit(_UNSETTLED)), far).otherwise(F.to_json(value)))
    return _bound(_listed(text), lambda listed: _bound(_alone(listed), plain))


def json_text(text: Column, path: str) -> Column:
    """First value at ``path`` as text, null when missing or not JSON."""
    return F.try_variant_get(F.try_parse_json(text), path, "string")


def any_depth(text: Column, key: str) -> Column:
    """All string values of ``key`` at any depth of a JSON text, in text order.

    Inside a JSON string every quote is escaped, so an unescaped ``"key":`` is
    always a key. One pass over the text replaces a recursive walk; decoding the
    matches as a JSON array undoes their escapes.
    """
    raw = F.regexp_extract_all(
        text, F.lit(rf'(?<!\\)"{key}"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1)
    )
    return F.from_json(F.concat(F.lit("["), F.array_join(raw, ","), F.lit("]")), "array<string>")


def is_primitive(value: Column) -> Column:
    """True for a JSON string, number or boolean."""
    kind = F.schema_of_variant(value)
    return ~(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
             | (kind == "VOID"))


def strip_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def json_number(value: Column) -> Column:
    """A double as JSON text; infinities become the strings ``+inf``/``-inf``."""
    return (
        F.when(value == float("inf"), F.lit('"+inf"'))
        .when(value == float("-inf"), F.lit('"-inf"'))
        .otherwise(value.cast("string"))
    )
