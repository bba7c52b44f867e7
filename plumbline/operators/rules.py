"""The deterministic rule engine: sheets to elements, elements to violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X

RULE = "id string, section string, title string, part string, jurisdiction string, element_type string, attribute string, operator string, value double, value_max double, conditions struct<occupancy_type:string,building_part:string>, severity string, message string"
SHEET = (
    "sheet_name string, file_type string, rooms array<struct<name:string,dimensions:string,area:string>>, doors array<struct<location:string,width:string,type:string>>, "
    "corridors array<struct<location:string,width:string,length:string>>, stairs array<struct<location:string,width:string,rise:string,run:string>>, "
    "egress_paths array<struct<`from`:string,`to`:string,width:string>>, dimensions array<struct<element:string,value:string,unit:string>>, "
    "annotations struct<rooms:array<string>,doors:array<string>,dimensions:array<string>,levels:array<string>,totals:array<string>,sections:array<string>,other:array<string>>, occupancy_type string, building_type string"
)
# fixed values: the nine curated rules (id, section, title, element, attribute, operator, value, upper value, severity, message)
CURATED = [
    ("nbc-9.8.4.1-rise", "9.8.4.1", "Rise of Steps", "stair", "rise_mm", "between", 125.0, 200.0, "major", "Stair rise {value}mm is outside the permitted {min}-{max}mm range (NBC §9.8.4.1, Table 9.8.4.1). Public stairs are further limited to a 180mm maximum."),
    ("nbc-9.8.4.2-run", "9.8.4.2", "Run of Steps", "stair", "run_depth_mm", "gte", 255.0, None, "major", "Stair run {value}mm is below the {min}mm minimum for private stairs (NBC §9.8.4.2, Table 9.8.4.2). Public stairs require at least 280mm."),
    ("nbc-9.8.2.1-width", "9.8.2.1", "Minimum Width of Stairs", "stair", "width_mm", "gte", 860.0, None, "major", "Stair width {value}mm is below the {min}mm minimum (NBC §9.8.2.1). Required exit/public stairs serving non-residential occupancies require more."),
    ("nbc-9.8.2.2-headroom", "9.8.2.2", "Stair Headroom", "stair", "headroom_mm", "gte", 1950.0, None, "major", "Stair headroom {value}mm is below the {min}mm minimum (NBC §9.8.2.2); headroom must be at least 1950mm plus the height of one riser."),
    ("nbc-9.5.3-doorway-width", "9.5.3", "Doorway Width", "door", "width_mm", "gte", 810.0, None, "minor", "Door width {value}mm is below the {min}mm minimum for required/barrier-free doorways (NBC §9.5.3). Verify the doorway's role before actioning."),
    ("nbc-9.9.3.3-corridor-width", "9.9.3.3", "Width of Corridors", "corridor", "width_mm", "gte", 1100.0, None, "minor", "Corridor width {value}mm is below the {min}mm minimum for a public, public-use or exit corridor (NBC §9.9.3.3). In-suite corridors are exempt."),
    ("nbc-9.5.3.1-ceiling-height", "9.5.3.1", "Room Ceiling Heights", "room", "ceiling_height_mm", "gte", 1950.0, None, "minor", "Ceiling height {value}mm is below the {min}mm absolute minimum (NBC §9.5.3.1, Table 9.5.3.1). Most habitable rooms require 2100mm over the required area."),
    ("nbc-9.8.8.3-guard-height", "9.8.8.3", "Height of Guards", "guard", "height_mm", "gte", 900.0, None, "critical", "Guard height {value}mm is below the {min}mm minimum (NBC §9.8.8.3). Guards other than within a dwelling unit must be at least 1070mm high."),
    ("nbc-9.9.3.2-exit-width", "9.9.3.2", "Exit Width", "egress", "width_mm", "gte", 900.0, None, "major", "Exit facility width {value}mm is below the {min}mm minimum (NBC §9.9.3.2)."),
]
JURISDICTION = "NBC_Alberta_2019"  # fixed value: of rules that name none
#: rules that may be broadcast; beyond, a rule is dealt to SALT parts of its elements
RULES, SALT = 10_000, 64


def curated_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, s, t, "9", JURISDICTION, e, a, op, v, m, None, sev, message) for i, s, t, e, a, op, v, m, sev, message in CURATED]
    return spark.createDataFrame(rows, RULE)


def with_defaults(rules: DataFrame) -> DataFrame:
    """Loaded rules with the default jurisdiction and empty conditions."""
    none = F.struct(F.lit(None).cast("string").alias("occupancy_type"), F.lit(None).cast("string").alias("building_part"))
    numbers = {c: F.col(c).cast("double") for c in ("value", "value_max")}
    return rules.withColumns({"jurisdiction": F.coalesce("jurisdiction", F.lit(JURISDICTION)), "conditions": F.coalesce("conditions", none), **numbers})


def flatten_sheets(sheets: DataFrame) -> DataFrame:
    """Measured elements in long form: (sheet, type, id, attribute, value_mm, occupancy, building_part).

    Rooms are measured only through labelled dimensions; a row appears for each attribute that parses. Each sheet is read
    once: its five arrays become one array of raw measures, in their order.
    """
    def measure(kind, ident, attribute, raw) -> Column:
        return F.struct(kind.alias("type"), ident.alias("id"), attribute.alias("attribute"), raw.alias("raw"))

    def each(array: str, make) -> Column:
        none = F.array().cast("array<struct<type:string,id:string,attribute:string,raw:string>>")
        return F.coalesce(F.flatten(F.transform(array, lambda e, i: F.array(*make(e, i)))), none)

    def placed(array: str, kind: str, fields: dict[str, str]) -> Column:
        def make(e, i):
            ident = F.coalesce(X.blank_null(e["location"]), F.concat(F.lit(f"{kind}#"), i.cast("string")))
            return [measure(F.lit(kind), ident, F.lit(a), e[f]) for f, a in fields.items()]

        return each(array, make)

    def route(e, i):
        a, b = e["from"], e["to"]
        either = F.coalesce(a != "", F.lit(False)) | F.coalesce(b != "", F.lit(False))
        ident = F.when(either, F.concat(F.coalesce(a, F.lit("?")), F.lit("→"), F.coalesce(b, F.lit("?")))).otherwise(F.concat(F.lit("egress#"), i.cast("string")))
        return [measure(F.lit("egress"), ident, F.lit("width_mm"), e["width"])]

    def labelled(e, i):
        t = X.dimension_target(e["element"])
        ident = F.coalesce(X.blank_null(e["element"]), F.concat(t["type"], F.lit("#dim"), i.cast("string")))
        return [measure(t["type"], ident, t["attribute"], X.trim(F.concat(F.coalesce(e["value"], F.lit("")), F.lit(" "), F.coalesce(e["unit"], F.lit("")))))]

    every = F.concat(
        placed("stairs", "stair", {"width": "width_mm", "rise": "rise_mm", "run": "run_depth_mm"}), placed("doors", "door", {"width": "width_mm"}),
        placed("corridors", "corridor", {"width": "width_mm", "length": "length_mm"}), each("egress_paths", route), each("dimensions", labelled),
    )
    part = X.building_part(F.col("occupancy_type"), F.col("building_type"))
    rows = sheets.select(F.col("sheet_name").alias("sheet"), F.col("occupancy_type").alias("occupancy"), part.alias("building_part"), F.explode(every).alias("m")).where("m.type is not null")
    return X.parsed(rows, F.col("m.raw")).select("sheet", "m.type", "m.id", "m.attribute", "value_mm", "occupancy", "building_part")


def passes(value: Column, operator: Column, low: Column, high: Column) -> Column:
    between = F.coalesce((value >= low) & (value <= high), F.lit(False))
    return F.when(operator == "gte", value >= low).when(operator == "lte", value <= low).when(operator == "eq", value == low).when(operator == "between", between).otherwise(True)


def applies(wanted_part: Column, part: Column, wanted_occupancy: Column, occupancy: Column) -> Column:
    """Conditions hold where either side is unknown."""
    p, q = X.blank_null(wanted_part), X.blank_null(part)
    o, s = X.blank_null(wanted_occupancy), X.blank_null(occupancy)
    return (p.isNull() | q.isNull() | (p == q)) & (o.isNull() | s.isNull() | F.lower(s).contains(F.lower(o)))


def fill(message: Column, value: Column, low: Column, high: Column) -> Column:
    out = F.replace(message, F.lit("{value}"), X.number_text(value))
    out = F.replace(out, F.lit("{min}"), X.number_text(low))
    return F.replace(out, F.lit("{max}"), F.coalesce(X.number_text(high), F.lit("")))


def violations(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """Elements that fail a rule.

    Rules are counted; up to RULES of them are broadcast, so that elements, of which a few types and attributes hold
    all, are not shuffled. More rules are joined in SALT parts of each type and attribute.
    """
    e, r = elements.alias("e"), rules.alias("r")
    if _few(rules):
        r = F.broadcast(r)
        on = F.lit(True)
    else:
        e = elements.withColumn("__part", F.pmod(F.xxhash64("sheet", "id"), F.lit(SALT)).cast("int")).alias("e")
        r = rules.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).alias("r")
        on = F.col("e.__part") == F.col("r.__part")
    on = on & (F.col("e.type") == F.col("r.element_type")) & (F.col("e.attribute") == F.col("r.attribute"))
    on = on & applies(F.col("r.conditions.building_part"), F.col("e.building_part"), F.col("r.conditions.occupancy_type"), F.col("e.occupancy"))
    value, low, high = F.col("e.value_mm"), F.col("r.value"), F.col("r.value_max")
    met = e.join(r, on & ~passes(value, F.col("r.operator"), low, high))
    return met.select(
        F.lit("compliance").alias("type"), F.col("r.severity").alias("severity"), fill(F.col("r.message"), value, low, high).alias("description"), F.col("r.section").alias("section_id"),
        X.citation(F.col("r.jurisdiction"), F.col("r.part"), F.col("r.section"), F.col("r.title")).alias("code_citation"), F.array(F.col("e.sheet")).alias("affected_sheets"), F.col("e.id").alias("location_hint"), F.lit("rule_engine").alias("source"),
    )


def _few(rules: DataFrame) -> bool:
    return not rules.isStreaming and len(rules.select("id").take(RULES + 1)) <= RULES


def covered_sections(found: DataFrame) -> DataFrame:
    return found.select(F.explode("affected_sheets").alias("sheet"), "section_id").distinct()


def not_covered(llm: DataFrame, covered: DataFrame) -> DataFrame:
    """Model findings whose section no rule has flagged on the same sheet; those without a section stay."""
    return llm.join(covered, ["sheet", "section_id"], "left_anti")


def validate(rules: DataFrame) -> DataFrame:
    """(i, error) for each check that a rule row fails. Columns: i, then those of RULE."""
    def missing(c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing {c}"))

    operator = F.when(~F.coalesce(F.col("operator").isin("gte", "lte", "eq", "between"), F.lit(False)), F.concat(F.lit('bad operator "'), F.coalesce("operator", F.lit("undefined")), F.lit('"')))
    severity = F.when(~F.coalesce(F.col("severity").isin("critical", "major", "minor"), F.lit(False)), F.concat(F.lit('bad severity "'), F.coalesce("severity", F.lit("undefined")), F.lit('"')))
    checks = [missing("id"), missing("section"), missing("element_type"), missing("attribute"), operator, F.when(F.col("value").isNull(), "value must be a number")]
    checks += [F.when((F.col("operator") == "between") & F.col("value_max").isNull(), "'between' rule needs numeric value_max"), severity, missing("message")]
    return rules.select("i", F.explode(F.array_compact(F.array(*checks))).alias("e")).select("i", F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), F.col("e")).alias("error"))


def upsert(old: DataFrame, new: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """new replaces the rows of old with its keys, of one column or several."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def summary(found: DataFrame, *by: str) -> DataFrame:
    """Counts by severity and by type, of all or for each value of `by`."""
    one = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "major", "minor")]
    return found.groupBy(*by).agg(*one, *[F.count_if(F.col("type") == t).alias(t) for t in ("compliance", "consistency")])


class RuleErrors(ValueError):
    """Rules that fail validation: how many errors there are, and where all of them are stored (None: all are in the message)."""

    def __init__(self, lines: list[str], count: int, path: str | None):
        self.count, self.path = count, path
        rest = f"\n({len(lines)} of {count} errors; all of them are in {path})" if count > len(lines) else ""
        super().__init__("\n".join(lines) + rest)


def _by_number(c: str) -> list[Column]:
    return [F.regexp_extract(c, r"^\[(\d+)\]", 1).cast("long"), F.col(c)]


def checked(rules: DataFrame, path: str | None = None, shown: int = 100) -> DataFrame:
    """The rules, numbered by i; raises RuleErrors if validate finds any.

    With a path all errors are written there as text, and the message has the first `shown` of them; without one it has them all.
    """
    errors = validate(rules)
    if errors.isEmpty():
        return rules
    if path is None:
        lines = [r.error for r in errors.orderBy(*_by_number("error")).collect()]
        raise RuleErrors(lines, len(lines), None)
    errors.select("error").write.mode("overwrite").text(path)
    stored = rules.sparkSession.read.text(path)
    first = [r.value for r in stored.orderBy(*_by_number("value")).limit(shown).collect()]
    raise RuleErrors(first, stored.count(), path)


def select_violations(found: DataFrame, severity: str = "all", kind: str = "all") -> DataFrame:
    if severity != "all":
        found = found.where(F.col("severity") == severity)
    return found if kind == "all" else found.where(F.col("type") == kind)


ELEMENT = ["type", "id", "attribute"]


def conflict_members(elements: DataFrame) -> DataFrame:
    """(type, id, attribute, sheet, value_mm) of the elements that have several values, each sheet and value once."""
    once = _differing(elements).select(*ELEMENT, "sheet", "value_mm").distinct()
    several = once.groupBy(*ELEMENT).agg((F.min("value_mm") < F.max("value_mm")).alias("differ")).where("differ").select(*ELEMENT)
    return once.join(several, ELEMENT, "left_semi")


def _differing(elements: DataFrame) -> DataFrame:
    """The rows of elements that may have several values: all of those that have, told by a hash of the element.

    Most elements have one value; of each only two numbers are shuffled.
    """
    own = elements.withColumn("__hash", F.xxhash64(*ELEMENT))
    several = own.groupBy("__hash").agg(F.min("value_mm").alias("low"), F.max("value_mm").alias("high"), F.bool_or(F.col("value_mm").isNull()).alias("some_null"))
    several = several.where("low < high or (some_null and low is not null)").select("__hash")
    return own.join(several, "__hash", "left_semi").drop("__hash")


def conflict_classes(elements: DataFrame) -> DataFrame:
    """One row for each value of an element that has several: (type, id, attribute, value_mm, sheets, first_sheet, n_values, pairs).

    sheets have this value, first_sheet is the first of them; pairs of entries of different sheets disagree on the element, which is
    counted, not made: of all pairs, those of one value and those of one sheet are taken off. Everything is summed in each task first,
    so an element on any number of sheets gives no more rows than it has values; conflict_members has the sheets.
    """
    entries = _differing(elements).select(*ELEMENT, "sheet", "value_mm").distinct()
    values = entries.groupBy(*ELEMENT, "value_mm").agg(F.count("*").alias("sheets"), F.min("sheet").alias("first_sheet"))
    of = values.groupBy(*ELEMENT).agg(F.count("*").alias("n_values"), F.sum("sheets").alias("n"), F.sum(F.col("sheets") * F.col("sheets")).alias("same")).where("n_values > 1")
    own = entries.groupBy(*ELEMENT, "sheet").agg(F.count("*").alias("m")).groupBy(*ELEMENT).agg(F.sum(F.col("m") * F.col("m")).alias("own"))
    pairs = F.expr("(n * n - same - own + n) div 2").alias("pairs")
    return values.join(of.join(own, ELEMENT).select(*ELEMENT, "n_values", pairs), ELEMENT).select(*ELEMENT, "value_mm", "sheets", "first_sheet", "n_values", "pairs")


def conflicts(elements: DataFrame) -> DataFrame:
    """The same element with different values on two sheets: (type, id, attribute, sheet_a, value_a, sheet_b, value_b).

    All pairs of the members, as many as conflict_classes counts; both sides share one shuffle.
    """
    once = conflict_members(elements)
    a, b = once.alias("a"), once.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ELEMENT]
    met = a.join(b, same[0] & same[1] & same[2] & (F.col("a.sheet") < F.col("b.sheet")) & (F.col("a.value_mm") != F.col("b.value_mm")))
    return met.select("a.type", "a.id", "a.attribute", F.col("a.sheet").alias("sheet_a"), F.col("a.value_mm").alias("value_a"), F.col("b.sheet").alias("sheet_b"), F.col("b.value_mm").alias("value_b"))


def missing_elements(elements: DataFrame, project: str) -> DataFrame:
    """Elements of a project that one of its other sheets lacks: (project, type, id, sheet)."""
    keys, sheets = elements.select(project, "type", "id").distinct(), elements.select(project, "sheet").distinct()
    return keys.join(sheets, project).join(elements.select(project, "type", "id", "sheet").distinct(), [project, "type", "id", "sheet"], "left_anti")
