"""Model responses as input tables: choice of attempt, JSON repair, normalised findings, page merge.

Repair runs in one Arrow UDF: Spark's own JSON functions accept text after a value and refuse repeated keys, which strict
parsing does the other way round. Its time grows with the length of a text, whatever stands in it.
"""

from __future__ import annotations

import itertools
import json
import re
import sys
from decimal import Decimal

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import text as X

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

FINDING = "array<struct<type:string,severity:string,description:string,section_id:string,code_citation:string,affected_sheets:array<string>,location_hint:string>>"
FENCE = "```"
# fixed values: what trimming takes off both ends
BLANK = "\t\n\v\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_HALF = re.compile("[\ud800-\udfff]")  # half of a pair
_TEXT_FIELDS = ("section_id", "code_citation", "location_hint")


def choose_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The first attempt whose text holds a bracket, else the last one. attempts: keys, attempt, content, reasoning."""
    a = attempts.withColumn("text", X.choice_text(F.col("content"), F.col("reasoning"))).withColumn("valid", F.instr("text", "[") > 0)
    order = [F.desc("valid"), F.when(F.col("valid"), F.col("attempt")).otherwise(-F.col("attempt"))]
    return a.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


#: a token of JSON, with the white space before it
_JSON = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+")|(-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?)|(true|false|null))')


def _deep(s: str):
    """The value of strict JSON whatever its depth: one pass over the tokens, with a stack of open arrays and objects."""
    top: list = []
    stack, key, at, wanted = [(top, None)], None, 0, "value"
    while len(stack) > 1 or not top:
        m = _JSON.match(s, at)
        if not m:
            raise ValueError("no token")
        at, sign, text = m.end(), m[1], m[2]
        into, _ = stack[-1]
        if sign in ("]", "}"):
            if type(into) is not (list if sign == "]" else dict) or len(stack) == 1 or wanted not in ("end", "first"):
                raise ValueError("out of place")
            stack.pop()
            wanted = "end"
            continue
        if sign == "," and wanted == "end" and len(stack) > 1:
            wanted = "key" if isinstance(into, dict) else "value"
            continue
        if sign == ":" and wanted == "colon":
            wanted = "value"
            continue
        if isinstance(into, dict) and wanted in ("key", "first") and text:
            key, wanted = json.loads(text), "colon"
            continue
        if wanted not in (("value",) if isinstance(into, dict) else ("value", "first")) or sign in (",", ":"):
            raise ValueError("out of place")
        value = [] if sign == "[" else {} if sign == "{" else json.loads(text) if text else float(m[3]) if m[3] else {"true": True, "false": False, "null": None}[m[4]]
        if isinstance(into, dict):
            into[key] = value
        else:
            into.append(value)
        wanted = "end"
        if sign:
            stack.append((value, None))
            wanted = "first"
    if s[at:].strip(" \t\n\r"):
        raise ValueError("text after a value")
    return top[0]


def _load(s: str):
    """(value, True), or (None, False) for what isn't strict JSON. Numbers are doubles, however long."""
    try:
        return json.loads(s, parse_constant=_refuse, parse_int=float), True
    except RecursionError:
        try:
            return _deep(s), True
        except ValueError:
            return None, False
    except ValueError:
        return None, False


#: an escaped sign, a string with what is left of an open one, or a brace
_TOKEN = re.compile(r'\\.|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\Z)|[{}]', re.S)


def complete_objects(s: str) -> list[str]:
    """The closed objects at the top level of a truncated array, braces inside strings left out."""
    braces = [(m.start(), 1 if m[0] == "{" else -1) for m in _TOKEN.finditer(s) if m[0] in ("{", "}")]
    depths = list(itertools.accumulate((d for _, d in braces), initial=0))
    starts = (at for (at, d), before in zip(braces, depths) if d > 0 and before == 0)
    ends = (at for (at, d), after in zip(braces, depths[1:]) if d < 0 and after == 0)
    return [s[a : z + 1] for a, z in zip(starts, ends)]  # they alternate; the last start may have no end


def _fenced(body: str) -> str:
    """What stands in the first fence, or the whole text."""
    begin = body.find(FENCE)
    end = body.find(FENCE, begin + len(FENCE)) if begin >= 0 else -1
    if end < 0:
        return body
    inner = body[begin + len(FENCE) : end]
    return (inner[4:] if inner[:4].lower() == "json" else inner).strip(BLANK)


def repair(raw: str | None):
    """The JSON value in a model's text, an empty list if there is none.

    Tried in turn: the fenced or whole text, what lies between its first opening and its last closing bracket, and the closed
    objects of an array that was cut off. Each is one pass over the text.
    """
    body = _fenced(raw.strip(BLANK)) if raw else ""
    tries = [body, None, None]
    first, last = min((at for at in map(body.find, "[{") if at >= 0), default=-1), max(map(body.rfind, "]}"))
    if 0 <= first < last:
        tries[1] = body[first : last + 1]
    for attempt in filter(None, tries):
        value, ok = _load(attempt)
        if ok:
            return value
    parts = complete_objects(body[1:]) if body.startswith("[") else []
    value, ok = _load("[" + ",".join(parts) + "]") if parts else (None, False)
    return value if ok else []


def number(x: float) -> str:
    """A double as JSON: the shortest digits, an exponent from 1e21 on and below 1e-6; null if it isn't finite."""
    if x - x != 0:
        return "null"
    if x == 0 or 1e-6 <= abs(x) < 1e21:
        return format(Decimal(repr(abs(x) or 0.0) if x == 0 else repr(x)).normalize(), "f")
    return re.sub(r"e([+-])0*", r"e\1", repr(x))


def to_text(value) -> str:
    """JSON without white space; half a pair stays escaped. Open arrays and objects are on a stack, so depth is no limit."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, Raw):
            out.append(v)
        elif isinstance(v, str):
            out.append(_HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(v, ensure_ascii=False)))
        elif isinstance(v, bool) or v is None:
            out.append({True: "true", False: "false", None: "null"}[v])
        elif isinstance(v, (int, float)):
            out.append(number(float(v)))
        else:
            parts = [[k, Raw(":"), x] for k, x in v.items()] if isinstance(v, dict) else [[x] for x in v]
            for i, part in enumerate(parts):
                part[:0] = [Raw(",")] if i else []
            ends = "{}" if isinstance(v, dict) else "[]"
            todo += [Raw(ends[1]), *[x for part in reversed(parts) for x in reversed(part)], Raw(ends[0])]
    return "".join(out)


class Raw(str):
    """Punctuation of to_text."""


def _whole(x) -> str | None:
    """A text that UTF-8 can hold: half a pair becomes the replacement sign; None for what is no text."""
    return _HALF.sub("\ufffd", x) if isinstance(x, str) else None


def _finding(r: dict) -> dict | None:
    d = r.get("description")
    d = d.strip(BLANK) if isinstance(d, str) else ""
    if not d:
        return None
    sheets = r.get("affected_sheets")
    out = {k: _whole(r.get(k)) for k in ("type", "severity", *_TEXT_FIELDS)}
    return out | {"description": _whole(d), "affected_sheets": [_whole(x) for x in sheets if isinstance(x, str)] if isinstance(sheets, list) else None}


def _findings(raw: pd.Series) -> pd.Series:
    def one(text):
        value = repair(text)
        rows = [_finding(r) for r in value if isinstance(r, dict)] if isinstance(value, list) else []
        return [r for r in rows if r]

    return raw.map(one)


def _repaired(raw: pd.Series) -> pd.Series:
    return raw.map(lambda t: to_text(repair(t)))


def parse_findings(raw: Column) -> Column:
    """Typed findings of a response: objects with a description, other fields only where they are texts."""
    return F.pandas_udf(_findings, FINDING)(raw)


def repaired_json(raw: Column) -> Column:
    return F.pandas_udf(_repaired, "string")(raw)


def normalize(responses: DataFrame, text: str, sheet: str, default_type: str = "compliance") -> DataFrame:
    """One row for each finding, with coerced type and severity and the default sheet."""
    keep = [c for c in responses.columns if c != text]
    rows = responses.select(*keep, F.posexplode(parse_findings(F.col(text))).alias("pos", "f"))
    sheets = F.coalesce("f.affected_sheets", F.array(F.col(sheet)))
    return rows.select(*keep, "pos", X.coerce_type(F.col("f.type"), default_type).alias("type"), X.coerce_severity(F.col("f.severity")).alias("severity"), "f.description", "f.section_id", "f.code_citation", sheets.alias("affected_sheets"), "f.location_hint")


def merge_pages(pages: DataFrame, key: str, page: str, arrays: list[str], scalars: list[str], limit: int = 6) -> DataFrame:
    """One row for each key: arrays of the first pages in page order, and each scalar's first non-empty value."""
    rows = pages.where(F.col(page) <= limit)

    def ordered(c: str) -> Column:
        own = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(c).alias("v"))))
        return F.flatten(F.transform(F.filter(own, lambda x: x["v"].isNotNull()), lambda x: x["v"])).alias(c)

    def first(c: str) -> Column:
        return F.min(F.when(F.col(c) != "", F.struct(F.col(page).alias("p"), F.col(c).alias("v")))).getField("v").alias(c)

    return rows.groupBy(key).agg(*[ordered(c) for c in arrays], *[first(c) for c in scalars])


def extraction_route(images: Column, text: Column, empty: Column, failed: Column) -> Column:
    """Which step of the extraction ladder gives a sheet: text, vision, rescue or nothing."""
    has_text = F.length(X.trim(F.coalesce(text, F.lit("")))) >= 20
    return (
        F.when((images == 0) & has_text, "text_only").when(images == 0, "EXTRACT_EMPTY").when(~empty & ~failed, "vision")
        .when(has_text, "text_rescue").when(failed, "VISION_ERROR").otherwise("EXTRACT_EMPTY")
    )
