"""Model responses to notes: strict JSON, unnested in order, with all four members required."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaria.operators.dealt import dealt
from glossaria.operators.salvage import salvage
from glossaria.schema import FIELDS

#: With options the whole schema is parsed whatever columns are used, so nothing escapes validation.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def json_array(text: Column, element: str) -> Column:
    """The elements of a text that is one JSON array and nothing else; null where it isn't.

    Spark's parser stops at the end of the first value. So the text is read twice: as the one element of an array, which
    shows a second value or an early ``}``, and, without taking it apart, as the one member of an object, which shows an
    early ``]``. What both accept can have nothing but blanks after it.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<array<{element}>>", _STRICT)
    member = F.from_json(F.concat(F.lit('{"a":'), text, F.lit("}")), "a string", _STRICT)
    # Each reading is named once, as the variable of a function: whatever names a parse twice does it twice.
    both = F.array(F.struct(listed.alias("listed"), member["a"].isNotNull().alias("whole")))
    return F.get(F.transform(both, lambda x: F.when((F.size(x["listed"]) == 1) & x["whole"], F.get(x["listed"], F.lit(0)))), F.lit(0))


def json_rows(rows: DataFrame, column: str, element: str, carry: tuple[str, ...]) -> DataFrame:
    """carry, pos and item for each element of the JSON arrays in ``column``; texts that are none give no rows."""
    return rows.select(*carry, F.posexplode(json_array(F.col(column), element)).alias("pos", "item"))


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def _by_python(responses: pd.Series) -> pd.Series:
    """json.loads; null where it or the array of objects and nulls fails. Values that are no strings are written as JSON."""

    def one(text):
        try:
            found = json.loads(text)
        except (TypeError, ValueError):
            return None
        if not isinstance(found, list) or not all(x is None or isinstance(x, dict) for x in found):
            return None
        return [x and {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in x.items()} for x in found]

    return responses.map(one)


def parsed(responses: DataFrame, parser: str = "native", carry: tuple[str, ...] = ("batch_id",), salvaging: bool = False) -> DataFrame:
    """One row for each element of each response, and one for each response that can't be parsed.

    Columns: ``carry``, pos, the four members, problem: null, ``document``, ``element`` or the missing members, and raw:
    the element as JSON, or the whole response where it can't be parsed. Of a member given twice the last value counts.
    ``parser``: native, in Spark expressions, or python, exactly json.loads.

    ``salvaging``: of a response that is cut off or broken the objects before the first error are parsed as others; its
    problem comes after them, with what is left as raw, and ``at`` says which character the first error stands at.
    """
    text, broken = F.col("response"), []
    if salvaging or parser == "python":
        responses = dealt(responses)
    if salvaging:
        responses = responses.select(*carry, "response", salvage("response").alias("_left"))
        text = F.when(F.col("_left.at").isNull(), F.col("response")).otherwise(F.concat(F.lit("["), F.array_join("_left.elements", ","), F.lit("]")))
        tail = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("map<string,string>").alias("m"), F.col("_left.rest").alias("raw"), F.col("_left.at").alias("at"))
        broken = [F.when(F.col("_left.at").isNotNull(), F.array(tail)).otherwise(F.array().cast(_ITEMS))]
    maps = _by_python(text) if parser == "python" else json_array(text, "map<string,string>")
    items = F.transform(maps, lambda m: F.struct(F.lit(True).alias("ok"), m.alias("m"), F.lit(None).cast("string").alias("raw"), F.lit(None).cast("int").alias("at")))
    failed = F.array(F.struct(F.lit(False).alias("ok"), F.lit(None).cast("map<string,string>").alias("m"), F.col("response").alias("raw"), F.lit(None).cast("int").alias("at")))
    rows = responses.select(*carry, F.posexplode(F.concat(F.coalesce(items, failed), *broken)).alias("pos", "_e"))
    last = lambda f: F.try_element_at(F.transform(F.filter(F.map_entries("_e.m"), lambda e: e["key"] == f), lambda e: e["value"]), F.lit(-1))
    missing = F.array_join(F.filter(F.array(*map(F.lit, FIELDS)), lambda f: ~F.coalesce(F.map_contains_key("_e.m", f), F.lit(False))), ",")
    problem = F.when(~F.col("_e.ok"), "document").when(F.col("_e.m").isNull(), "element").when(missing != "", F.concat(F.lit("missing "), missing))
    raw = F.when(~F.col("_e.ok"), F.col("_e.raw")).otherwise(F.coalesce(F.to_json("_e.m"), F.lit("null")))
    at = [F.col("_e.at").alias("at")] if salvaging else []
    return rows.select(*carry, "pos", *(last(f).alias(f) for f in FIELDS), problem.alias("problem"), raw.alias("raw"), *at)


_ITEMS = "array<struct<ok: boolean, m: map<string,string>, raw: string, at: int>>"


def notes(responses: DataFrame, mode: str = "failfast", parser: str = "native", carry: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """The notes in order of (carry, pos). failfast: any problem ends the job; permissive: good elements only; salvage:
    those of broken responses too, as far as they are whole."""
    rows = parsed(responses, parser, carry, mode == "salvage")
    if mode == "failfast":
        checked = F.when(F.col("problem").isNull(), F.col("pos")).otherwise(F.raise_error(F.concat(F.lit("bad response: "), F.col("problem"))).cast("int"))
        rows = rows.withColumn("pos", checked)
    else:
        rows = rows.where("problem is null")
    key = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(f), F.lit("\x00")) for f in FIELDS)), 256)
    return rows.select(*carry, "pos", *FIELDS, key.alias("note_key"))


def rejects(responses: DataFrame, parser: str = "native", carry: tuple[str, ...] = ("batch_id",), salvaging: bool = False) -> DataFrame:
    """What permissive notes leave out, so that it can be repaired: carry, pos, reason and raw; ``salvaging``: what salvage
    leaves out, and ``at``, the place of the first error in a broken response."""
    found = parsed(responses, parser, carry, salvaging).where("problem is not null")
    return found.select(*carry, "pos", F.col("problem").alias("reason"), "raw", *(["at"] if salvaging else []))


def accumulated(batches: list[DataFrame], accumulate: bool = True) -> DataFrame:
    """The deck's notes: of all batches with their number as batch_order, duplicates kept, or of the last batch only."""
    numbered = [b.withColumn("batch_order", F.lit(i)) for i, b in enumerate(batches)]
    out = numbered[0] if accumulate else numbered[-1]
    for more in numbered[1:] if accumulate else []:
        out = out.unionByName(more)
    return out
