"""STAR tables: particle files, multi-block model files, and their writers.

Particle tables are read with Spark, line by line; the writers make one ordered text file on the driver's side of
Spark's own text sink. A particle table has 43 known columns with defaults; unknown ones stay in a map.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from lumenfold.functions.strings import number_text

# The labels of particle tables with their types and defaults.
_D, _I, _S = DoubleType(), IntegerType(), StringType()
LABELS: dict[str, tuple[object, object]] = {
    "Voltage": (_D, 0.0), "DefocusU": (_D, 0.0), "DefocusV": (_D, 0.0), "DefocusAngle": (_D, 0.0), "SphericalAberration": (_D, 0.0),
    "AmplitudeContrast": (_D, 0.0), "Bfactor": (_D, 0.0), "ImageName": (_S, ""), "MicrographName": (_S, ""), "GroupNumber": (_I, 1),
    "GroupName": (_S, ""), "RandomSubset": (_I, 0), "AngleRot": (_D, 0.0), "AngleTilt": (_D, 0.0), "AnglePsi": (_D, 0.0),
    "OriginX": (_D, 0.0), "OriginY": (_D, 0.0), "OriginZ": (_D, 0.0), "ClassNumber": (_I, 0), "NormCorrection": (_D, 1.0),
    "ScaleCorrection": (_D, 1.0), "LogLikeliContribution": (_D, 0.0), "MaxValueProbDistribution": (_D, 0.0), "NrOfSignificantSamples": (_I, 0),
    "AngleRotPrior": (_D, 999.0), "AngleTiltPrior": (_D, 999.0), "AnglePsiPrior": (_D, 999.0), "OriginXPrior": (_D, 999.0),
    "OriginYPrior": (_D, 999.0), "OriginZPrior": (_D, 999.0), "Magnification": (_D, 0.0), "DetectorPixelSize": (_D, 0.0),
    "BeamTiltX": (_D, 0.0), "BeamTiltY": (_D, 0.0), "Matrix_1_1": (_D, 1.0), "Matrix_1_2": (_D, 0.0), "Matrix_1_3": (_D, 0.0),
    "Matrix_2_1": (_D, 0.0), "Matrix_2_2": (_D, 1.0), "Matrix_2_3": (_D, 0.0), "Matrix_3_1": (_D, 0.0), "Matrix_3_2": (_D, 0.0), "Matrix_3_3": (_D, 1.0),
}
SHORTEST = 10


def _header(lines: list[str]) -> list[str]:
    """Labels in column order from the lines before the body."""
    found: dict[int, str] = {}
    for line in lines:
        if m := re.match(r"\s*_rln(\w+)(?:\s+#(\d+))?", line):
            found[int(m[2]) - 1 if m[2] else len(found)] = m[1]
    if sorted(found) != list(range(len(found))):
        raise ValueError("columns are not numbered from 1 without gaps")
    return [found[i] for i in range(len(found))]


def read_star(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a particle file, with inner_id (place in the file), labels as columns and `extra` for unknown ones.

    A row is a line after the header with the text .mrcs; the body ends at a line of ten characters or fewer. The
    header is the last run of labels before the first row, however long. Numbers that can't be read are 0. A single
    label is an error; a file without rows gives none.
    """
    text = spark.read.option("wholetext", False).text(path)
    numbered = text.select(F.monotonically_increasing_id().alias("line"), "value")
    label = F.ltrim("value").startswith("_rln")
    row = F.col("value").contains(".mrcs") & (F.length("value") > SHORTEST) & ~label
    first = numbered.where(row).agg(F.min("line").alias("line")).first()["line"]
    above = numbered if first is None else numbered.where(F.col("line") < first)
    begins = F.trim("value").rlike("^(loop_|data_)")
    head = [r["value"].strip() for r in above.where(label | begins).orderBy("line").collect()]
    labels: list[str] = []
    for i, line in enumerate(head):
        if line.startswith("_rln"):
            labels = [line] if i and not head[i - 1].startswith("_rln") else [*labels, line]
    names = _header(labels)
    if len(names) < 2:
        raise ValueError("a particle file needs two labels at least")
    rows = numbered.where(row)
    if first is not None:
        end = numbered.where((F.col("line") > first) & (F.length("value") <= SHORTEST)).agg(F.min("line").alias("line")).first()["line"]
        rows = rows if end is None else rows.where(F.col("line") < end)
    cells = F.split(F.trim("value"), r"\s+")
    rows = rows.select("line", cells.alias("c"))
    known = [(i, n) for i, n in enumerate(names) if n in LABELS]
    other = [(i, n) for i, n in enumerate(names) if n not in LABELS]
    columns = []
    for i, n in known:
        kind, default = LABELS[n]
        cell = F.get("c", F.lit(i))
        columns.append(F.when(cell == '""', "").otherwise(cell).alias(n) if kind == _S else F.coalesce(cell.try_cast(kind), F.lit(0).cast(kind)).alias(n))
    extra = F.create_map(*[x for i, n in other for x in (F.lit(n), F.get("c", F.lit(i)))]) if other else F.expr("cast(map() as map<string,string>)")
    return rows.select(F.col("line").alias("inner_id"), *columns, extra.alias("extra"))


def grouped(df: DataFrame) -> DataFrame:
    """Rows with GroupNumber by the first appearance of the group in micrograph order; one group of several micrographs is replaced by them.

    Rows without a group are a group of their own.
    """
    from lumenfold.operators.particles import group_or_micrograph, number_by_first

    named = group_or_micrograph(df, "GroupName", "MicrographName").drop("GroupNumber")
    numbers = number_by_first(named, "GroupName", ["MicrographName", "inner_id"], "GroupNumber").withColumnRenamed("GroupName", "__name")
    return named.join(numbers, F.col("GroupName").eqNullSafe(F.col("__name"))).drop("__name")


def label_of(token: Column) -> Column:
    """The label of a header's token, with or without the underscore; null for other tokens."""
    return F.nullif(F.regexp_extract(F.trim(token), r"^_?rln(\w+)$", 1), F.lit(""))


def has_label(df: DataFrame, label: str) -> bool:
    """Whether a particle table holds a label, as a column or among the unknown ones of its first row."""
    if label in df.columns:
        return True
    row = df.select(F.map_contains_key("extra", F.lit(label))).first() if "extra" in df.columns else None
    return bool(row and row[0])


def reset_pose(df: DataFrame) -> DataFrame:
    """Particles whose images were moved and turned: shifts and the in-plane angle are 0 from now on."""
    return df.withColumns({c: F.lit(0.0) for c in ("OriginX", "OriginY", "AnglePsi")})


# What an iteration finds for each particle.
FOUND = ("AngleRot", "AngleTilt", "AnglePsi", "OriginX", "OriginY", "OriginZ", "ClassNumber", "LogLikeliContribution", "MaxValueProbDistribution", "NrOfSignificantSamples", "NormCorrection")


def with_found(df: DataFrame, found: DataFrame, key: str = "inner_id") -> DataFrame:
    """df with the eleven columns that an iteration found, by key; rows without a finding keep theirs."""
    named = found.select(key, *[F.col(c).alias(f"__{c}") for c in FOUND])
    met = df.join(named, key, "left")
    return met.withColumns({c: F.coalesce(F.col(f"__{c}").cast(LABELS[c][0]), F.col(c)) for c in FOUND}).drop(*[f"__{c}" for c in FOUND])


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines with the text .mrcs."""
    return spark.read.text(path).where(F.col("value").contains(".mrcs")).count()


def with_defaults(df: DataFrame) -> DataFrame:
    """df with all 43 columns; those that it lacks hold their defaults."""
    missing = {n: F.lit(d).cast(t) for n, (t, d) in LABELS.items() if n not in df.columns}
    return df.withColumns(missing)


def written_columns(df: DataFrame, read: list[str] | None = None) -> list[str]:
    """The known columns that are written: those that were read and those whose values differ from each other or from the default, found in one pass.

    The scale correction never is; with DefocusU goes DefocusAngle, and a table has its first two columns at least.
    """
    from lumenfold.operators.particles import present_columns

    known = [c for c in df.columns if c in LABELS and c != "ScaleCorrection"]
    found = {r["name"] for r in present_columns(df, {c: LABELS[c][1] for c in known}).where("present").collect()} | set(read or ())
    if "DefocusU" in found and "DefocusAngle" in known:
        found.add("DefocusAngle")
    return [c for i, c in enumerate(known) if c in found or (i < 2 and len(found) < 2)]


def star_lines(df: DataFrame, columns: list[str] | None = None, read: list[str] | None = None) -> DataFrame:
    """(place, value): the text lines of a particle table, its header first. Null and empty strings are written as two quotes."""
    columns = columns or written_columns(df, read)
    kinds = dict(df.dtypes)
    text = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", '""').otherwise(F.col(c))
    cells = [text(c) if kinds[c] == "string" else F.lpad(F.col(c).cast("string"), 12, " ") if kinds[c] in ("int", "bigint") else number_text(F.col(c)) for c in columns]
    order = "inner_id" if "inner_id" in df.columns else columns[0]
    body = df.select(F.struct(F.lit(1).alias("part"), F.col(order).cast("long").alias("i")).alias("place"), F.concat_ws(" ", *cells).alias("value"))
    head = ["", "data_", "", "loop_", *[f"_rln{c} #{i + 1}" for i, c in enumerate(columns)]]
    top = df.sparkSession.createDataFrame([(i, line) for i, line in enumerate(head)], "i long, value string")
    return top.select(F.struct(F.lit(0).alias("part"), F.col("i").alias("i")).alias("place"), "value").unionByName(body)


def write_star(df: DataFrame, path: str, columns: list[str] | None = None, read: list[str] | None = None) -> None:
    """Write a particle table as the one text file of a folder, in the order of inner_id; columns, or those that written_columns() names.

    Executors write ordered parts; the driver's file system client puts their bytes one after the other.
    """
    order = [F.col("place.part"), F.col("place.i")]
    lines = star_lines(df, columns, read).repartitionByRange(*order).sortWithinPartitions(*order)
    write_joined(lines.select("value"), path)


def write_joined(lines: DataFrame, path: str) -> None:
    """Write ordered partitions of text lines as one file in the folder path, which is replaced."""
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = f"{path.rstrip('/')}/_parts"
    lines.write.mode("overwrite").text(parts)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    for old in files.listStatus(folder):
        if old.getPath().getName() != "_parts":
            files.delete(old.getPath(), True)
    found = sorted(s.getPath().toString() for s in files.listStatus(jvm.org.apache.hadoop.fs.Path(parts)) if s.getPath().getName().startswith("part-"))
    out = files.create(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/part-00000.txt"), True)
    try:
        for name in found:
            part = files.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
    files.delete(jvm.org.apache.hadoop.fs.Path(parts), True)


def parse_blocks(text: str) -> dict[str, list[dict[str, str]]]:
    """The data_ blocks of a model file: a list of rows each; key-value blocks have one row."""
    blocks: dict[str, list[dict[str, str]]] = {}
    name, labels, loop = "", [], False
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("data_"):
            name, labels, loop = line, [], False
            blocks[name] = []
        elif line == "loop_":
            loop = True
        elif line.startswith("_rln"):
            parts = line.split()
            if loop:
                labels.append(parts[0][4:])
            else:
                if not blocks[name]:
                    blocks[name].append({})
                blocks[name][0][parts[0][4:]] = " ".join(parts[1:])
        elif line and not line.startswith("#") and labels:
            blocks[name].append(dict(zip(labels, line.split())))
    return blocks


def format_blocks(blocks: dict[str, list[dict[str, object]]]) -> str:
    """Model-file text; general blocks are written as key-value pairs, others as loops. All columns are written."""
    out = []
    for name, rows in blocks.items():
        out += ["", name, ""]
        if len(rows) == 1 and name.endswith("_general"):
            out += [f"_rln{k} {v}" for k, v in rows[0].items()]
        else:
            labels = list(rows[0]) if rows else []
            out += ["loop_", *[f"_rln{k} #{i + 1}" for i, k in enumerate(labels)], *[" ".join(str(r[k]) for k in labels) for r in rows]]
    return "\n".join(out) + "\n"


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One small DataFrame of strings for each block of a model, sampling or optimiser file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").orderBy("file").collect()
    text = "\n".join(r["value"] for r in files)
    found = {}
    for name, rows in parse_blocks(text).items():
        if rows:
            labels = list(rows[0])
            found[name] = spark.createDataFrame([tuple(r.get(k) for k in labels) for r in rows], ", ".join(f"`{k}` string" for k in labels))
    return found


def write_model(spark: SparkSession, blocks: dict[str, list[dict[str, object]]], path: str) -> None:
    lines = format_blocks(blocks).splitlines()
    spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i long, value string").repartition(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def read_class_list(spark: SparkSession, path: str) -> DataFrame:
    """(class_no, fine) from lines of two numbers with a comma; comments and other lines are skipped."""
    lines = spark.read.text(path).where(~F.ltrim("value").startswith("#") & F.col("value").contains(","))
    cells = F.split("value", ",")
    return lines.select(F.trim(cells[0]).cast("int").alias("class_no"), F.trim(cells[1]).cast("int").alias("fine"))


def write_class_counts(df: DataFrame, path: str, class_no: str = "class_no") -> None:
    """Lines of class and count, in order."""
    counts = df.groupBy(class_no).agg(F.count("*").alias("n"))
    one = counts.repartition(1).sortWithinPartitions(class_no)
    one.select(F.concat_ws(" ", F.col(class_no).cast("string"), F.col("n").cast("string")).alias("value")).write.mode("overwrite").text(path)

