"""Readers and writers of catalog tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.order import numbered
from sievework.session import stored

BATCH_SCHEMA = (
    "batchId string, editionId string, chapterId string, sourceDocumentId string, sourceDocumentTitle string, generatedAt string, "
    "generator struct<provider:string,model:string>, questions array<struct<externalId:string,prompt:string,selectionMode:string,instruction:string,"
    "options:array<struct<text:string>>,correctOptionIndexes:array<string>,publicExplanation:string,sourcePageStart:string,sourcePageEnd:string,"
    "sourceReference:string,groundingExcerpt:string,reviewNotes:string,tags:array<string>>>"
)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def scan(spark: SparkSession, root: str, name: str, where: dict | None = None, columns: Sequence[str] | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """A filtered, pruned, ordered scan; filter and columns reach the Parquet reader."""
    df = read_table(spark, root, name)
    for column, value in (where or {}).items():
        df = df.where(F.col(column) == value)
    if columns:
        df = df.select(*columns)
    return df.orderBy(*order) if order else df


def single(df: DataFrame) -> DataFrame:
    """df, or an error unless it has exactly one row."""
    n = df.limit(2).count()
    if n != 1:
        raise ValueError("no row where one was expected" if n == 0 else "several rows where one was expected")
    return df


def exists(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def has_table(spark: SparkSession, root: str, name: str) -> bool:
    """Whether a table can be read; only a missing path counts as absence."""
    try:
        read_table(spark, root, name).schema  # noqa: B018
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def schema_version(spark: SparkSession, root: str) -> str:
    """v1 has editions; legacy has questions only; else the seed serves."""
    if has_table(spark, root, "editions"):
        return "v1"
    return "legacy" if has_table(spark, root, "questions") else "seed"


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Import batches, a row a JSON document, with their file; numbers stay text, as they are checked later."""
    return spark.read.schema(BATCH_SCHEMA).option("multiLine", True).json(path).withColumn("source_file", F.col("_metadata.file_path"))


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType, defaults: DataFrame) -> DataFrame:
    """A JSON snapshot with defaults for absent fields; defaults alone where it is missing or corrupt."""
    try:
        # stored, as Spark can't ask raw JSON for its corrupt records alone
        df = stored(spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("multiLine", True).json(path), "snapshot")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return defaults
        raise
    good = df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    if not exists(good):
        return defaults
    filled = defaults.withColumnsRenamed({c: f"_default_{c}" for c in defaults.columns})
    joined = good.join(F.broadcast(filled.limit(1)), how="left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_default_{c}")).alias(c) for c in schema.names])


def salvaged(records: DataFrame, key: str, value: str, schema: str, defaults: dict[str, Column]) -> DataFrame:
    """A row a record of a key-value store: the key, the fields of schema from the record's JSON object, and status. A field that
    is missing, null or of another type takes its default (null without one), and the others keep what they have. status: ok;
    defaulted (some field took its default); corrupt (no JSON object: all defaults, the text stays in `raw`)."""
    fields = T.StructType.fromDDL(schema)
    parsed = records.select(key, F.col(value).alias("raw"), F.try_parse_json(value).alias("_v"))
    object_ = F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.lit(False))
    read = {f.name: F.try_variant_get("_v", f"$.{f.name}", f.dataType.simpleString()) for f in fields}
    typed = parsed.select(key, "raw", object_.alias("_ok"), *[F.when(object_, c).alias(n) for n, c in read.items()])
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f.name).isNull()
    status = F.when(~F.col("_ok"), "corrupt").when(missing, "defaulted").otherwise("ok")
    filled = typed.withColumn("status", status).withColumn("raw", F.when(~F.col("_ok"), F.col("raw")))
    return filled.select(key, *[F.coalesce(f.name, defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in fields], "status", "raw")


def write_indexed(df: DataFrame, root: str, name: str, keys: Sequence[str], lookups: Sequence[str] = (), rows_a_group: int = 100_000) -> str:
    """A snapshot in the order of its keys, so that the ranges kept for row groups let scans by key skip most of them, and with
    Bloom filters for look-ups by other columns."""
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    order = [F.col(c).asc_nulls_first() for c in keys]
    writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.row.count.limit", rows_a_group)
    for c in lookups:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
    return path


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, value of all files below a folder, a row a file."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def write_bundles(texts: DataFrame, folder: str, name: str, value: str) -> str:
    """Texts with their names as records of some files, as many as the table has tasks; the folder."""
    texts.select(F.col(name).alias("path"), F.col(value).alias("value")).write.option("compression", "zstd").parquet(folder)
    return folder


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """path, value of all texts of a folder of bundles: what read_texts gives of files."""
    return spark.read.schema("path string, value string").parquet(folder)


def extract_prompts(texts: DataFrame, col: str = "value") -> DataFrame:
    """The single-quoted prompt values of source texts, escapes undone."""
    found = F.explode(F.regexp_extract_all(col, F.lit(r"prompt:\s*'((?:[^'\\]|\\.)*)'"), F.lit(1)))
    return texts.select(found.alias("prompt")).withColumn("prompt", F.regexp_replace("prompt", r"\\(.)", "$1"))


def encoding_lint(texts: DataFrame, patterns: dict[str, str], allowed: Sequence[str] = ()) -> DataFrame:
    """path, pattern, n: files with suspicious patterns, but for those allowed."""
    kept = texts.where(~F.expr(f"exists(array({', '.join(repr(a) for a in allowed)}), a -> endswith(path, a))")) if allowed else texts
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.regexp_count("value", F.lit(p)).alias("n")) for k, p in patterns.items()]))
    return kept.select("path", named.alias("x")).select("path", "x.*").where("n > 0")


def published(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "published")


# --- writes: state is a set of immutable snapshots; a write makes a new one and never reads and overwrites a path ---


def write_snapshot(df: DataFrame, root: str, name: str) -> str:
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys; the others stay."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def upsert_keeping(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """As upsert, but columns of keep retain the old row's values."""
    held = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
    fresh = new.join(held, list(keys), "left").select(*[F.coalesce(F.col(f"_old_{c}"), F.col(c)).alias(c) if c in keep else F.col(c) for c in new.columns])
    return upsert(old, fresh, keys)


def _arrivals(new: DataFrame, key: str, by: Sequence[Column]) -> DataFrame:
    """A row a key of new, the one that arrived last, with _first and _last: when the key arrived first and last."""
    came = numbered(new, by, "_came")
    values = F.max_by(F.struct(*[c for c in new.columns if c != key]), "_came").alias("_v")
    return came.groupBy(key).agg(F.min("_came").alias("_first"), F.max("_came").alias("_last"), values).select(key, "_first", "_last", "_v.*")


def _placed(old: DataFrame, arrived: DataFrame, key: str, order: str, when: str, end: bool) -> DataFrame:
    """arrived with places that follow on from old's: before the lowest (the last arrival first), or after the highest."""
    edge = old.agg(F.max(order) if end else F.min(order)).first()[0]  # one number
    out = numbered(arrived, [F.col(when)], "_n").drop("_first", "_last", order)
    place = F.lit(0 if edge is None else edge) + (F.col("_n") if end else -F.col("_n"))
    return out.withColumn(order, place.cast(old.schema[order].dataType)).drop("_n").select(*old.columns)


def _upserted(old: DataFrame, new: DataFrame, key: str, order: str, by: Sequence[Column], end: bool) -> DataFrame:
    arrived = stored(_arrivals(new, key, by), "arrivals")
    at = old.select(key, F.col(order).alias("_at"))
    known = arrived.drop(order, "_first", "_last").join(at, key).withColumnRenamed("_at", order).select(*old.columns)
    fresh = _placed(old, arrived.join(at.select(key), key, "left_anti"), key, order, "_first", end)
    return old.join(arrived.select(key), key, "left_anti").unionByName(known).unionByName(fresh)


def prepend(old: DataFrame, new: DataFrame, key: str, order: str, by: Sequence[Column]) -> DataFrame:
    """Upserts of new, one after another in the order `by`: a known key keeps its place and takes the last value, an unknown
    one comes before all others. Places are consecutive downwards from the lowest of old."""
    return _upserted(old, new, key, order, by, end=False)


def append(old: DataFrame, new: DataFrame, key: str, order: str, by: Sequence[Column]) -> DataFrame:
    """As prepend, but unknown keys come last."""
    return _upserted(old, new, key, order, by, end=True)


def newest_first(old: DataFrame, new: DataFrame, key: str, order: str, by: Sequence[Column]) -> DataFrame:
    """Rows of new come first, one after another in the order `by`, and rows of the same key before go."""
    arrived = stored(_arrivals(new, key, by), "arrivals")
    rest = old.join(arrived.select(key), key, "left_anti")
    return rest.unionByName(_placed(rest, arrived, key, order, "_last", end=False))


def saved_questions(questions: DataFrame, events: DataFrame, written: DataFrame, happened: DataFrame, by: Sequence[Column], key: str = "id", order: str = "place") -> tuple[DataFrame, DataFrame]:
    """Questions and events after some are saved: questions are replaced in place or appended, events come first, newest first."""
    return append(questions, written, key, order, by), newest_first(events, happened, key, order, by)


def replace_children(children: DataFrame, new: DataFrame, parent: str, parents: DataFrame | None = None) -> DataFrame:
    """All children of the written parents go; the new ones stand instead."""
    written = parents if parents is not None else new.select(parent).distinct()
    return children.join(written, parent, "left_anti").unionByName(new)


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def seeded(old: DataFrame, seed: DataFrame, replace: bool = False) -> DataFrame:
    """The seed if the table is empty, or if it is to be replaced."""
    return seed if replace or not exists(old) else old


def migrated(df: DataFrame, added: dict[str, Column], backfill: dict[str, Column]) -> DataFrame:
    """New columns, and nulls of old columns filled."""
    out = df.withColumns({c: v for c, v in added.items() if c not in df.columns})
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in backfill.items()})


def violations(df: DataFrame, *, not_null: Sequence[str] = (), unique: Sequence[str] = (), allowed: dict[str, Sequence[str]] | None = None, references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """constraint, n for each constraint that rows break."""
    parts = [df.agg(F.count_if(F.col(c).isNull()).alias("n")).select(F.lit(f"not null: {c}").alias("constraint"), "n") for c in not_null]
    if unique:
        parts.append(df.groupBy(*unique).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"unique: {', '.join(unique)}").alias("constraint"), "n"))
    for c, values in (allowed or {}).items():
        parts.append(df.agg(F.count_if(~F.col(c).isin(*values)).alias("n")).select(F.lit(f"check: {c}").alias("constraint"), "n"))
    for c, (table, key) in (references or {}).items():
        orphans = df.where(F.col(c).isNotNull()).join(table.select(F.col(key).alias(c)).distinct(), c, "left_anti")
        parts.append(orphans.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"reference: {c}").alias("constraint"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")
