"""Scalar functions over strings and numbers, as Column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUM = r"(-?\d+(?:\.\d+)?)"
END = r"(?![A-Za-z0-9_])"  # an ASCII word border
SPACE = r"[\s ]"
WHITE = " \t\n\x0b\f\r\u00a0"  # what SPACE matches
INCH, FOOT = 25.4, 304.8
# fixed values: the line on a sheet's use
STATED, CITE_PART = "Stated occupancy/building type: ", ". Cite sections from the matching NBC Part only."
UNSTATED = "NOT SPECIFIED. Treat as ambiguous and note this in any width-threshold violations rather than assuming Part 3 or Part 9."
# fixed values: words that keyword search leaves out
STOP_WORDS = "the and or for of to a an in on at by with from is are be requirements minimum maximum width length".split()


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def blank_null(c: Column) -> Column:
    return F.when(c != "", c)


def _num(s: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(s, pattern, group).try_cast("double")


def parse_to_mm(raw: Column) -> Column:
    """Millimetres of a dimension text: feet and inches, inches, mm, cm, m, else a bare number; null if none.

    The first unit that matches wins; a pattern runs only on texts that hold its unit's sign.
    """
    s = F.lower(trim(raw))
    feet = NUM + r"\s*'\s*[-\s]?\s*(\d+(?:\.\d+)?)?\s*\"?"
    inch = NUM + rf"\s*(?:\"|in{END}|inch(?:es)?)"

    def unit(u: str) -> Column:
        return F.when(s.contains(u), _num(s, NUM + rf"\s*{u}{END}"))

    return F.coalesce(
        F.when(s.contains("'"), _num(s, feet) * FOOT + F.coalesce(_num(s, feet, 2), F.lit(0.0)) * INCH), F.when(s.contains('"') | s.contains("in"), _num(s, inch) * INCH),
        unit("mm"), unit("cm") * 10, unit("m") * 1000, _num(s, NUM),
    )


def parsed(df: DataFrame, raw: Column, name: str = "value_mm") -> DataFrame:
    """df with the millimetres of raw, without the rows that have none.

    The value passes through a generator, which Spark neither merges with filters nor repeats in them: it is
    computed once a row.
    """
    return df.select("*", F.explode(F.array_compact(F.array(parse_to_mm(raw)))).alias(name))


def number_text(d: Column) -> Column:
    """Text of a double: the shortest digits; an exponent only from 1e21 on and below 1e-6."""
    text = d.cast("string")
    sign, digits = F.regexp_extract(text, "^(-?)", 1), F.regexp_replace(F.regexp_extract(text, r"^-?([\d.]+)E", 1), r"\.0$|\.", "")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    size = F.length(digits)
    whole = F.rpad(digits, power + 1, "0")
    split = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, size))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    far = F.concat(F.substring(digits, 1, 1), F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(""), F.lit("e"), F.when(power > 0, "+").otherwise(""), power.cast("string"))
    spread = F.when((power >= 21) | (power < -6), far).when(power < 0, small).when(size <= power + 1, whole).otherwise(split)
    return F.when(text.contains("E"), F.concat(sign, spread)).otherwise(F.regexp_replace(text, r"\.0$", ""))


def building_part(occupancy: Column, building: Column) -> Column:
    blob = F.lower(F.concat(F.coalesce(occupancy, F.lit("")), F.lit(" "), F.coalesce(building, F.lit(""))))
    nine = r"part\s*9|house|dwelling|residential\s*(small|low)|small\s*building"
    three = r"part\s*3|assembly|business|mercantile|industrial|institutional|high[-\s]?rise"
    return F.when(blob.rlike(nine), "Part9").when(blob.rlike(three), "Part3")


def part_prefix(part: Column) -> Column:
    return F.when(part == "Part9", "9.").when(part == "Part3", "3.")


def part_hint(part: Column) -> Column:
    return F.when(part == "Part9", "Part 9 housing dwelling unit small building ").when(part == "Part3", "Part 3 fire protection major occupancy ").otherwise("")


def _dimension(label: Column, to) -> Column:
    t = F.lower(F.coalesce(label, F.lit("")))

    def has(*words: str) -> Column:
        return functools.reduce(Column.__or__, [t.contains(w) for w in words])

    return (
        F.when(has("ceiling"), to("room", "ceiling_height_mm")).when(has("guard"), to("guard", "height_mm")).when(has("handrail"), to("stair", "handrail_height_mm"))
        .when(has("headroom", "head room"), to("stair", "headroom_mm")).when(has("stair") & has("run", "tread"), to("stair", "run_depth_mm")).when(has("stair") & has("rise"), to("stair", "rise_mm"))
        .when(has("stair") & has("width"), to("stair", "width_mm")).when(has("door") & has("width"), to("door", "width_mm")).when(has("corridor", "hall") & has("width"), to("corridor", "width_mm"))
    )


def dimension_target(label: Column) -> Column:
    """(type, attribute) that a free label measures, null if none."""
    return _dimension(label, lambda kind, attribute: F.struct(F.lit(kind).alias("type"), F.lit(attribute).alias("attribute")))


def dimension_attribute(label: Column) -> Column:
    """The same as one text, "type.attribute"."""
    return _dimension(label, lambda kind, attribute: F.lit(f"{kind}.{attribute}"))


def coerce_type(raw: Column, fallback: str = "compliance") -> Column:
    v = F.lower(raw)
    return F.when(v.contains("consist"), "consistency").when(v.contains("compli"), "compliance").otherwise(fallback)


def coerce_severity(raw: Column) -> Column:
    v = F.lower(raw)
    return F.when(v.contains("crit") | v.contains("high") | v.contains("severe"), "critical").when(v.contains("min") | v.contains("low"), "minor").otherwise("major")


def topics(title: Column) -> Column:
    t = F.lower(title)
    pairs = [("egress", t.contains("egress") | t.contains("exit")), ("doors", t.contains("door")), ("corridors", t.contains("corridor")), ("stairs", t.contains("stair")), ("occupancy", t.contains("occupanc")), ("fire", t.contains("fire"))]
    return F.array_compact(F.array(*[F.when(c, name) for name, c in pairs]))


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


TERM = 4  # fixed value: signs of the shortest keyword


def keyword_terms(query: Column, limit: int = 4) -> Column:
    """The first distinct terms of TERM or more ASCII characters that are no stop words."""
    parts = F.split(F.lower(query), "[^a-z0-9]+")
    return F.slice(F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= TERM) & ~t.isin(STOP_WORDS))), 1, limit)


def section_ids(text: Column, part: str = r"\d+") -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_]){part}\.\d+(?:\.\d+){{0,3}}{END}"), F.lit(0))


def root_id(section: Column) -> Column:
    return F.substring_index(section, "#", 1)


def direction(clause: Column) -> Column:
    c = F.lower(clause)
    return F.when(c.rlike(r"not\s+less\s+than|at\s+least|minimum|min\."), "min").when(c.rlike(r"not\s+more\s+than|maximum|max\."), "max").otherwise("unknown")


def choice_text(content: Column, reasoning: Column) -> Column:
    return F.coalesce(F.when(trim(content) != "", content), F.when(trim(reasoning) != "", reasoning), F.lit(""))


def is_transient(status: Column) -> Column:
    return F.coalesce(status.isin(429, 500, 502, 503, 504), F.lit(False))


def citation(jurisdiction: Column, part: Column, section: Column, title: Column) -> Column:
    return F.concat(F.lit("NBC "), jurisdiction, F.lit(" Part "), F.coalesce(part, F.lit("9")), F.lit(", "), section, F.when(title != "", F.concat(F.lit(" — "), title)).otherwise(""))


def _sql(spark: SparkSession, body: Column, *names: str) -> str:
    """The SQL of an expression over text columns."""
    one = spark.createDataFrame([], ", ".join(f"{n} string" for n in names)).select(body.alias("x"))
    return one._jdf.queryExecution().analyzed().expressions().apply(0).child().sql()


def register(spark: SparkSession) -> None:
    """SQL functions parse_to_mm(raw), building_part(occupancy, building) and dimension_attribute(label) ("type.attribute")
    of this session."""
    made = {
        "parse_to_mm(raw STRING) RETURNS DOUBLE": _sql(spark, parse_to_mm(F.col("raw")), "raw"),
        "building_part(occupancy STRING, building STRING) RETURNS STRING": _sql(spark, building_part(F.col("occupancy"), F.col("building")), "occupancy", "building"),
        "dimension_attribute(label STRING) RETURNS STRING": _sql(spark, dimension_attribute(F.col("label")), "label"),
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def occupancy_label(occupancy: Column, building: Column) -> Column:
    """What a sheet says of its use: the parts that aren't empty, "" if none."""
    return F.concat_ws(" / ", blank_null(occupancy), blank_null(building))


def occupancy_line(occupancy: Column, building: Column) -> Column:
    """The line that tells a model what a sheet says of its use."""
    label = occupancy_label(occupancy, building)
    return F.when(label != "", F.concat(F.lit(STATED), label, F.lit(CITE_PART))).otherwise(F.lit(STATED + UNSTATED))


def embedding_text(section: Column, title: Column, content: Column) -> Column:
    """What is embedded of a chunk."""
    return F.concat(section, F.lit(" "), title, F.lit("\n"), content)


def hint_text(text: Column, pages: bool = True) -> Column:
    """The part of a sheet's own text that goes with a page's image, or with a text-only call."""
    return F.left(text, F.lit(6000 if pages else 12000))
