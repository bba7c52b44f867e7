"""Drawing annotations: atoms and their buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import text as X

# fixed values: names on one sample drawing, which a caller may replace by those of its own
NAMES = ("elvis alcequiez", "chesnut residence")
# fixed values: vocabulary of title blocks and legends that carries no measurement
BOILERPLATE = (
    r"freecadfloorplans|copyright|drawing title|sheet number|cad drawing|scale\s*not\s*to\s*scale|educational or personal use|redistribute|resell|republish|architectural plan|symbology|wall axis|"
    r"cut[- ]off indicator|rainwater drainage|level change|level in elevations|access signal|inside elevation indicator|finished floor level|width of doors\s*$|n\.p\.t\.\s*$|b\.a\.p\s*$|hemi\s*$"
)
BUCKETS = ["rooms", "doors", "dimensions", "levels", "totals", "sections", "other"]
# fixed values: what is matched. A word border is an ASCII look-around, since Java's \b takes accented letters for word signs.
GRID = r"^[A-Ga-g]'?$|^(0?\d|1[0-7])$"
WIDE_GRID = r"^[A-Ga-g][\s,]+[A-Ga-g]"
JUNK = r"^[\d.\s,'\"\-+/\[\]ftm²]+$"
TOTALS = r"(?i)total|m²|m2(?![A-Za-z0-9_])|basement|ground floor|first level|garden\s*:"
SECTIONS = r"(?i)^section\s+[A-Z]|front elevation|side elevation|rear elevation|elevation$"
DOORS = r"(?i)^P\d+\s+\d+(\.\d+)?\s*(m|cm)|puerta\s+\d|width of doors"
LEVELS = r"(?i)(NPT|NLT|LEVEL)\s*="
NAMED_LEVEL = r"(?i)^(.+?)\s*(NPT|NLT|LEVEL)\s*=\s*([+\-±]?[\d.]+)"
LENGTH = r"^\d+(\.\d+)?\s*m(?![A-Za-z0-9_])"
BREAK = r"\s{3,}|(?=(?<![A-Za-z0-9_])(?:NPT|NLT|LEVEL)\s*=)|(?=(?<![A-Za-z0-9_])Section\s+[A-Z](?![A-Za-z0-9_]))|(?=(?<![A-Za-z0-9_])P\d+\s+\d)"


def atoms(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entry, part, atom): the pieces of each annotation in order. notes: (key, pos, text)."""
    parts = F.flatten(F.transform(F.split(text, r"\r?\n+"), lambda line: F.split(line, BREAK)))
    rows = notes.select(key, F.col("pos").alias("entry"), F.posexplode(parts).alias("part", "raw"))
    return rows.select(key, "entry", "part", X.squeeze(F.col("raw")).alias("atom")).where("atom <> ''")


def bucket(atom: Column) -> Column:
    """(bucket, text) of an atom; a null bucket drops it."""
    named = F.length(X.trim(F.regexp_extract(atom, NAMED_LEVEL, 1))) >= 3
    room = F.concat(X.trim(F.regexp_extract(atom, NAMED_LEVEL, 1)), F.lit(" — "), F.upper(F.regexp_extract(atom, NAMED_LEVEL, 2)), F.lit(" "), F.regexp_extract(atom, NAMED_LEVEL, 3))
    level = F.when(named, F.struct(F.lit("rooms").alias("bucket"), room.alias("text"))).otherwise(F.struct(F.lit("levels").alias("bucket"), atom.alias("text")))

    def to(name: str) -> Column:
        return F.struct(F.lit(name).alias("bucket"), atom.alias("text"))

    out = F.when(atom.rlike(TOTALS), to("totals")).when(atom.rlike(SECTIONS), to("sections")).when(atom.rlike(DOORS), to("doors")).when(atom.rlike(LEVELS), level)
    return out.when(atom.rlike(LENGTH) & (F.length(atom) < 60), to("dimensions")).when(F.length(atom) <= 80, to("other"))


def noise(atom: Column, names: tuple[str, ...] = NAMES) -> Column:
    """Whether an atom carries nothing: title blocks, the given names, grid references, short numbers."""
    grid = atom.rlike(GRID) | (atom.rlike(WIDE_GRID) & (F.length(atom) < 20))
    return (F.length(atom) < 2) | atom.rlike("(?i)" + "|".join([BOILERPLATE, *map(re.escape, names)])) | grid | (atom.rlike(JUNK) & (F.length(atom) < 6))


def categorize(notes: DataFrame, key: str, text: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(key, entry, part, bucket, text): atoms without noise, the first of each spelling, routed to buckets."""
    kept = atoms(notes, key, text).where(~noise(F.col("atom"), names))
    first = W.partitionBy(key, F.lower("atom")).orderBy("entry", "part")
    kept = kept.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("b", bucket(F.col("atom"))).where("b is not null")
    return kept.select(key, "entry", "part", F.col("b.bucket").alias("bucket"), F.col("b.text").alias("text"))


def buckets(routed: DataFrame, key: str) -> DataFrame:
    """One struct of seven arrays for each key."""
    def own(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("bucket") == name, F.struct("entry", "part", "text"))))
        return F.transform(rows, lambda x: x["text"]).alias(name)

    return routed.groupBy(key).agg(*[own(b) for b in BUCKETS]).select(key, F.struct(*BUCKETS).alias("annotations"))


def total(annotations: str = "annotations") -> Column:
    return sum((F.coalesce(F.size(F.col(f"{annotations}.{b}")), F.lit(0)) for b in BUCKETS), F.lit(0))


def usable(annotations: str = "annotations") -> Column:
    arrays = ("rooms", "doors", "corridors", "stairs", "egress_paths", "dimensions")
    return sum((F.coalesce(F.size(F.col(a)), F.lit(0)) for a in arrays), F.lit(0)) + total(annotations) > 0


def flags(sheets: DataFrame, name: str, other: str) -> DataFrame:
    """Warnings "<file>: <flag>" of the entries that report a parse or extraction error."""
    bad = F.filter(F.col(other), lambda x: x.startswith("PARSE_ERROR") | x.startswith("VISION_ERROR") | x.startswith("EXTRACT_EMPTY"))
    return sheets.select(F.col(name).alias("name"), F.explode(bad).alias("flag")).select(F.concat("name", F.lit(": "), "flag").alias("warning"))
