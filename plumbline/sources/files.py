"""Files: kinds by name, the upload filter, binary reading, and drawing entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.operators import scan

ACCEPTED = "pdf dxf dwg png jpg jpeg tif tiff".split()
# fixed value: what is said of DWG files
DWG_ERROR = "DWG files are proprietary and not supported. Please convert to DXF and re-upload."


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def file_type(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext.isin("pdf", "dxf", "dwg"), ext).otherwise("image")


def accepted(name: Column) -> Column:
    return extension(name).isin(ACCEPTED)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, file_type, error) of every file under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = file_type(F.col("path"))
    return files.select("path", "content", kind.alias("file_type"), F.when(kind == "dwg", DWG_ERROR).alias("error"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    from plumbline.operators.rules import RULE, with_defaults

    return with_defaults(spark.read.option("multiLine", True).schema(RULE).json(path))


def uploads(requests: DataFrame) -> DataFrame:
    """(request, project_name, name, content, error): the files of each upload form, and an error for a form without any.

    requests: request, project_name, parts (array of name, content; a part without a file has no name).
    """
    files = F.filter(F.coalesce("parts", F.array().cast(requests.schema["parts"].dataType)), lambda p: p["name"].isNotNull())
    named = F.coalesce(F.when(F.col("project_name") != "", F.col("project_name")), F.lit("Untitled Project"))
    rows = requests.select("request", named.alias("project_name"), F.explode_outer(files).alias("f"))
    return rows.select("request", "project_name", "f.name", "f.content", F.when(F.col("f").isNull(), "no files uploaded").alias("error"))


def fixed2(x: Column) -> Column:
    """Two decimals of the exact binary value, ties away from zero; from 1e21 on the number's own text, null for NaN.

    200 x is p + e with p rounded and e exact, since x is cut in two halves whose products are; its floor, and with it the rounded
    number of hundredths, is known without a decimal of the whole. What is above 2^40 is taken off first.
    """
    a = F.abs(x)
    high = F.floor(F.when(a < 1e21, a) / 2.0**40)
    rest = a - high.cast("double") * 2.0**40
    upper = rest * 134217729.0 - (rest * 134217729.0 - rest)
    p = rest * 200.0
    e = (upper * 200.0 - p) + (rest - upper) * 200.0
    n = F.floor(p) - F.when((F.floor(p).cast("double") == p) & (e < 0), 1).otherwise(0)
    cents = F.floor((n + 1) / 2) + high.cast("decimal(10,0)") * F.lit(100 << 40).cast("decimal(15,0)")
    digits = cents.cast("decimal(38,0)").cast("string")
    digits = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.left(digits, F.length(digits) - 2), F.lit("."), F.right(digits, F.lit(2)))
    return F.when(F.isnan(x), None).when(a == float("inf"), F.concat(F.when(x < 0, "-").otherwise(""), F.lit("Infinity"))).when(a >= 1e21, X.number_text(x)).otherwise(text)


# fixed values: group codes of drawing files
CODES = {"8": "layer", "10": "x0", "20": "y0", "11": "x1", "21": "y1", "42": "measurement", "1": "text"}


def dxf_entities(files: DataFrame, key: str, text: str, block: int | None = None) -> DataFrame:
    """(key, id, type, layer, x0, y0, x1, y1, measurement, text) of the entities of drawing files, which are pairs of lines:
    a group code and its value. Code 0 starts an entity or a section; an entity's own codes follow it, the first of each counts.

    Drawings of fewer than `block` pairs are read in their own row; the lines of larger ones are dealt out, so many tasks read one.
    """
    size = block or scan.SIZE
    marked = files.select(key, (scan.breaks(F.col(text)) >= 2 * size).alias("many"), text)
    found = _short_entities(marked.where("not many"), key, text)
    large = marked.where("many")
    if not files.isStreaming and large.isEmpty():
        return found
    lines = large.select(key, "many", F.posexplode(F.split(text, r"\r?\n")).alias("i", "line"))
    return found.unionByName(_entities(lines, key, size))


def _short_entities(files: DataFrame, key: str, text: str) -> DataFrame:
    """dxf_entities of drawings that are read in their row: an entity begins at a code 0 and holds the pairs up to the next."""
    names = {c: n for n, c in enumerate(["0", *CODES])}

    def entities(body: str):
        lines = [x.strip(" ") for x in body.replace("\r\n", "\n").split("\n")]
        lines += [None] * (len(lines) % 2)
        section, before, own, number = None, None, None, 0
        for code, value in zip(lines[::2], lines[1::2]):
            if code == "2" and before == ("0", "SECTION") and value is not None:
                section = value
            if code == "0":
                if own:
                    yield own
                number += 1
                own = [number, *[None] * len(names)] if section == "ENTITIES" and value not in (None, "SECTION", "ENDSEC", "EOF") else None
                seen = set()
            if own and code in names and code not in seen:
                seen.add(code)
                own[names[code] + 1] = value
            before = code, value
        if own:
            yield own

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), *[pa.string()] * len(names)]
        for batch in batches:
            found = [(i, e) for i, body in enumerate(batch.column(1).to_pylist()) if body is not None for e in entities(body)]
            keys = batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            columns = zip(*[e for _, e in found]) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, k) for c, k in zip(columns, kinds)]], [key, "id", "type", *CODES.values()])

    schema = T.StructType([T.StructField(key, files.schema[key].dataType), T.StructField("id", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("type", *CODES.values())]])
    return _with_numbers(files.select(key, text).mapInArrow(run, schema))


def read_drawings(spark: SparkSession, path: str, block: int | None = None) -> DataFrame:
    """The same of the drawing files under path, key `path`, read by lines: a file is split between tasks wherever Spark cuts it.

    Lines are numbered within each split and the splits of a file stitched by their counts, so no task holds a large drawing.
    """
    size = block or scan.SIZE
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    counts = raw.groupBy("path", "start").agg(F.count("*").alias("n"))
    of = W.partitionBy("path").orderBy("start")
    counts = counts.select("path", "start", F.coalesce(F.sum("n").over(of.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), (F.sum("n").over(W.partitionBy("path")) >= 2 * size).alias("many"))
    own = raw.withColumn("i", F.row_number().over(W.partitionBy("path", "start").orderBy("at")) - 1)
    lines = own.join(counts, ["path", "start"]).select("path", "many", (F.col("i") + F.col("before")).alias("i"), "line")
    return _entities(lines, "path", size)


def _entities(lines: DataFrame, key: str, size: int) -> DataFrame:
    """lines: key, many (whether a drawing may have more than size pairs), i (a line's place from 0 on), line."""
    even, none = F.col("i") % 2 == 0, F.lit(None).cast("string")
    pair, line = F.expr("i div 2"), F.trim("line")
    # SECTION and the code 0 before it go to their own pair and to the next
    own = F.struct(pair.alias("pair"), F.when(even, line).alias("code"), F.when(~even, line).alias("value"), none.alias("code0"), none.alias("value0"))
    behind = F.struct((pair + 1).alias("pair"), none.alias("code"), none.alias("value"), F.when(even, line).alias("code0"), F.when(~even, line).alias("value0"))
    passed = (even & (line == "0")) | (~even & (line == "SECTION"))
    rows = lines.select(key, "many", F.explode(F.when(passed, F.array(own, behind)).otherwise(F.array(own))).alias("p")).select(key, "many", "p.*")
    pairs = rows.groupBy(key, "many", "pair").agg(*[F.max(c).alias(c) for c in ("code", "value", "code0", "value0")]).where("code is not null")
    section = F.when((F.col("code") == "2") & (F.col("code0") == "0") & (F.col("value0") == "SECTION"), F.col("value"))
    pairs = scan.carried(pairs, key, "pair", F.col("many"), {"id": F.col("code") == "0"}, {"section": section}, size).where("section = 'ENTITIES'")
    fields = [F.min_by(F.when(F.col("code") == c, F.col("value")), F.when(F.col("code") == c, F.col("pair"))).alias(n) for c, n in {"0": "type", **CODES}.items()]
    out = pairs.groupBy(key, "id").agg(*fields).where(F.col("type").isNotNull() & ~F.col("type").isin("SECTION", "ENDSEC", "EOF"))
    return _with_numbers(out)


def _with_numbers(entities: DataFrame) -> DataFrame:
    return entities.withColumns({c: F.col(c).try_cast("double") for c in ("x0", "y0", "x1", "y1", "measurement")})


def dxf_dimensions(entities: DataFrame) -> DataFrame:
    """Measured lines and dimensions. entities: (id, type, layer, x0, y0, x1, y1, measurement, text)."""
    line = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    value = F.when(F.col("type") == "LINE", line).when(F.col("type") == "DIMENSION", F.col("measurement"))
    rows = entities.withColumn("v", value).where("v is not null")
    return rows.select("id", F.trim(F.concat("type", F.lit(" "), F.coalesce("layer", F.lit("")))).alias("element"), fixed2(F.col("v")).alias("value"), F.lit("units").alias("unit"))


def dxf_annotations(entities: DataFrame) -> DataFrame:
    note = F.when(F.col("type") == "DIMENSION", F.concat(F.lit("DIM: "), F.col("text"))).when(F.col("type").isin("TEXT", "MTEXT"), F.col("text"))
    return entities.where(F.col("text") != "").select("id", note.alias("annotation")).where("annotation is not null")
