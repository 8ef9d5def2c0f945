"""Generated sources, logs and manifests as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def source_lines(files: DataFrame, variables: DataFrame) -> DataFrame:
    """(path, line, variable, measure) of the first code line after each ``% m. N`` comment in a known variable's block.

    ``files(path, text)``; ``variables(variable)`` is joined, so lines of unknown blocks vanish.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "s")).withColumn("line", F.col("line") + 1)
    w = Window.partitionBy("path").orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("v", F.nullif(F.regexp_extract("s", r"^\s*([A-Za-z]+)\s*=", 1), F.lit("")))
    d = d.withColumn("variable", F.last("v", ignorenulls=True).over(upto))
    mark = F.regexp_extract("s", r"^\s*%\s*m\.\s*(\S+)", 1)
    d = d.withColumn("m", F.nullif(mark, F.lit(""))).withColumn("block", F.count("m").over(upto)).withColumn("measure", F.last("m", ignorenulls=True).over(upto))
    code = d.filter((F.trim("s") != "") & ~F.trim("s").startswith("%") & (F.col("block") > 0) & F.col("v").isNull())
    first = code.groupBy("path", "variable", "block", "measure").agg(F.min("line").alias("line"))
    return first.join(variables, "variable", "left_semi").select("path", "line", "variable", "measure")


def diagnostics(log: DataFrame, line: str) -> DataFrame:
    """Severity, message, file, line and column of the lines of a log that are diagnostics."""
    p = r"^(.*?):(\d+):(\d+): (?:(fatal error|error|warning|programming error|note)): (.*)$"
    part = lambda g: F.regexp_extract(line, p, g)
    d = log.filter(F.col(line).rlike(p))
    return d.select(part(4).alias("severity"), part(5).alias("message"), part(1).alias("file"), part(2).cast("int").alias("line_no"), part(3).cast("int").alias("column_no"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON list of pieces with a given schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def page_graph(spark: SparkSession, path: str, schema: str | None = None) -> dict[str, DataFrame]:
    """Sheets, systems, stacks, slots and symbols of exported page graphs, one JSON object a file, as linked tables."""
    schema = schema or PAGE_GRAPH
    book = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("book", F.input_file_name())
    sheet = book.select("book", F.posexplode("sheets").alias("sheet", "s"))
    system = sheet.select("book", "sheet", F.posexplode("s.systems").alias("system", "y"))
    stack = system.select("book", "sheet", "system", F.posexplode("y.stacks").alias("stack", "k"))
    return {
        "sheet": sheet.select("book", "sheet", "s.number", "s.width", "s.height", "s.interline"),
        "system": system.select("book", "sheet", "system", "y.starts_movement"),
        "stack": stack.select("book", "sheet", "system", "stack", "k.left", "k.right"),
        "slot": stack.select("book", "sheet", "system", "stack", F.explode("k.slots").alias("slot")).select("book", "sheet", "system", "stack", "slot.*"),
        "inter": system.select("book", "sheet", "system", F.explode("y.inters").alias("i")).select("book", "sheet", "system", "i.*", F.coalesce("i.ctx_grade", "i.grade").alias("confidence")),
    }


PAGE_GRAPH = """sheets array<struct<number:int,width:int,height:int,interline:double,systems:array<struct<starts_movement:boolean,
 stacks:array<struct<left:double,right:double,slots:array<struct<time:string,x:double>>>>,
 inters:array<struct<id:bigint,kind:string,shape:string,grade:double,ctx_grade:double,staff:int,box:struct<x:double,y:double,w:double,h:double>,step:int,value:string,role:string>>>>>>"""
