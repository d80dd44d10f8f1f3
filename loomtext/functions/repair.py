"""One bounded repair of replies that were cut off: open strings and brackets are closed, a member that was cut off is dropped."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.parsing import object_text

_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*')
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{0,3})?\Z")
_NUMBER, _PART = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"), re.compile(r"[-+.0-9eE]*\Z")
_LITERALS = ("true", "false", "null")
_CLOSING = {"{": "}", "[": "]"}


def close_cut(text: str | None) -> str | None:
    """The object that begins at a text's first brace: as it stands if it ends, else closed where the text was cut off.

    A value's string is closed, without an escape that was cut off; a key, a member without its value, a literal that is not
    whole, and a number at the very end, which may lack digits, are dropped. None where there is no brace, or where the text
    is wrong before it ends. One pass with a stack of open brackets; what a string holds plays no part.
    """
    start = (text or "").find("{")
    if start < 0:
        return None
    at, stack, state, safe = start + 1, ["}"], "first key", (start + 1, "}")
    while at < len(text):
        c = text[at]
        if c in " \t\r\n":
            at += 1
            continue
        if state in ("next", "first key", "first value") and c == stack[-1]:
            stack.pop()
            at += 1
            if not stack:
                return text[start:at]
            state = "next"
        elif state == "next" and c == ",":
            state, at = ("key" if stack[-1] == "}" else "value"), at + 1
            continue
        elif state == "colon" and c == ":":
            state, at = "value", at + 1
            continue
        elif c == '"' and state != "next" and state != "colon":
            end = _STRING.match(text, at).end()
            key = "key" in state
            if text[end : end + 1] != '"':
                if end < len(text) and not _ESCAPE.match(text, end):
                    return None
                return text[start : safe[0]] + safe[1] if key else text[start:end] + '"' + "".join(reversed(stack))
            at, state = end + 1, "colon" if key else "next"
            if key:
                continue
        elif "value" in state and c in _CLOSING:
            stack.append(_CLOSING[c])
            at, state = at + 1, "first key" if c == "{" else "first value"
        elif "value" in state:
            m = _NUMBER.match(text, at)
            word = next((w for w in _LITERALS if text.startswith(w, at)), None)
            if word:
                at += len(word)
            elif any(w.startswith(text[at:]) for w in _LITERALS) or _PART.match(text, at):
                break
            elif m:
                at = m.end()
            else:
                return None
            state = "next"
        else:
            return None
        safe = (at, "".join(reversed(stack)))
    return text[start : safe[0]] + safe[1]


def read_object(reply: Column) -> Column:
    """From a reply's first brace to its last, without fences, if that is an object; else null."""
    body = object_text(reply)
    return F.when(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), body)


def with_objects(replies: DataFrame, reply: str, repair_fn: Callable[[str | None], str | None] = close_cut, limit: int = 1) -> DataFrame:
    """Adds object, the JSON text of a reply's object, and status: read, repaired or unreadable.

    What can be read as it stands never leaves the JVM. Only other replies go, in Arrow batches, to the repair, at most `limit`
    times and then once more through the same reading: a repair that returns prose is none. A null reply is unreadable.
    """

    @F.pandas_udf("string")
    def repaired(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else repair_fn(t))

    out = replies.withColumn("object", read_object(F.col(reply))).withColumn("_try", F.when(F.col("object").isNull(), F.coalesce(reply, F.lit(""))))
    out = out.withColumn("status", F.when(F.col("object").isNotNull(), "read"))
    for _ in range(limit):
        out = out.withColumn("_try", repaired("_try"))
        out = out.withColumn("object", F.coalesce("object", read_object(F.col("_try")))).withColumn("status", F.coalesce("status", F.when(F.col("object").isNotNull(), "repaired")))
    return out.withColumn("status", F.coalesce("status", F.lit("unreadable"))).drop("_try")
