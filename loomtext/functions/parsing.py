"""Reading scores and objects out of free-form replies."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.lexicon import ERROR_FAMILIES

_FENCE = r"```(?:json)?"
#: The word by which a judgment names a family.
FAMILY_WORDS = [(f.split()[0], f) for f in ERROR_FAMILIES]


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _FENCE, ""))


def object_text(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(strip_fences(text), r"(?s)\{.*\}", 0), F.lit(""))


def fidelity(reply: Column, missing: float | None = None) -> Column:
    """The fidelity of a judge's reply, 1 to 5, as a share of 5. A reply without a readable object has `missing` (null: not judged); 0.2 is what scores such a reply as the least one."""
    value = F.get_json_object(object_text(reply), "$.fidelity")
    number = value.try_cast("double")
    clamped = F.when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), F.floor(number).cast("int"))) / 5.0)
    return F.coalesce(clamped, F.lit(missing).cast("double"))


def judgment(reply: Column, most: int = 160) -> Column:
    return F.substring(F.get_json_object(object_text(reply), "$.judgment"), 1, most)


#: A string of an object, which is left as it is, or a comma with nothing after it.
_STRAY_COMMA = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])')


def first_object(reply: str | None) -> str | None:
    """The object that begins at a reply's first brace, as canonical JSON, whatever comes after it; null if there is none or it is broken.

    Braces and commas within strings are text. Commas before a closing bracket are forgiven.
    """
    _, brace, rest = (reply or "").partition("{")
    try:
        found, _ = json.JSONDecoder().raw_decode(_STRAY_COMMA.sub(lambda m: m[1] or "", brace + rest))
    except ValueError:
        return None
    return json.dumps(found, sort_keys=True, ensure_ascii=False)


def extract_object(text: Column) -> Column:
    """first_object of a column, by Arrow batches: there is no native matcher of nested braces."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return read(text)
