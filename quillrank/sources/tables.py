"""Stored tables: schema, upserts, cascade, listings and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = {
    "candidatos": "id INT, nombre STRING, archivo STRING, texto_cv STRING, embedding ARRAY<FLOAT>, fragmentos ARRAY<ARRAY<FLOAT>>, fecha_alta TIMESTAMP",
    "puestos": "id INT, titulo STRING, descripcion STRING, huella STRING, embedding ARRAY<FLOAT>, fecha_alta TIMESTAMP",
    "matches": "candidato_id INT, puesto_id INT, score FLOAT, fecha TIMESTAMP",
}
#: Key columns, and those an update of a known key leaves as they were.
POLICY = {
    "candidatos": (("archivo",), ("id", "fecha_alta")),
    "puestos": (("huella",), ("id", "descripcion", "fecha_alta")),
    "matches": (("candidato_id", "puesto_id"), ()),
    "archivos": (("archivo",), ()),
}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Idempotent; parents come before children."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def add_missing_columns(spark: SparkSession, table: str, columns: dict[str, str]) -> list[str]:
    """Add the columns that the table lacks; returns their names."""
    have = {c.name for c in spark.catalog.listColumns(table)}
    new = [c for c in columns if c not in have]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'{c} {columns[c]}' for c in new)})")
    return new


def latest(rows: DataFrame, keys: tuple[str, ...], order: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key by ``order``, with keep_first from its first.

    Aggregation by struct order combines before the shuffle, so a hot key
    sends a row per task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in keep_first]
    picked = [F.max(F.struct(order, *[c for c in rest if c != order])).alias("__new")]
    if keep_first:
        picked.append(F.min(F.struct(order, *keep_first)).alias("__old"))
    out = rows.groupBy(*keys).agg(*picked)
    return out.select(*[F.col(f"__old.{c}" if c in keep_first else c if c in keys else f"__new.{c}").alias(c) for c in rows.columns])


def upsert(stored: DataFrame, new: DataFrame, keys: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """stored with new rows merged by key; new holds one row per key (see
    latest). Known keys keep the columns in keep. The result is a new relation:
    write it beside the old one and swap, never over what is read."""
    rest = [c for c in stored.columns if c not in keys]
    n = new.select(*[F.col(c).alias(f"__n_{c}") for c in new.columns], F.lit(True).alias("__hit"))
    same = [F.col(k).eqNullSafe(F.col(f"__n_{k}")) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    both = stored.withColumn("__had", F.lit(True)).join(n, cond, "full")
    had, hit = F.col("__had").isNotNull(), F.col("__hit").isNotNull()
    cols = {k: F.when(had, F.col(k)).otherwise(F.col(f"__n_{k}")) for k in keys}
    for c in rest:
        use_new = hit & (~had if c in keep else F.lit(True)) if c in new.columns else F.lit(False)
        cols[c] = F.when(use_new, F.col(f"__n_{c}") if c in new.columns else F.lit(None)).otherwise(F.col(c))
    return both.select(*[cols[c].alias(c) for c in stored.columns])


def numbered(rows: DataFrame, order: str, name: str, sample: int = 4096, ranges: int = 256) -> DataFrame:
    """rows with their number in the order of a column without repeats, from 1.
    Ranges of the column, cut at quantiles of a bounded sample, are ordered each
    by itself; the rows of the ranges before are counted."""
    got = sorted(r[0] for r in rows.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(sample).collect())
    cuts = got[:: -(-len(got) // ranges)] if len(got) == sample else []
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= F.col(order))) if cuts else F.lit(0)
    held = rows.withColumn("__range", F.coalesce(below, F.lit(0)))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most ranges + 1 rows
    counts = held.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return held.join(F.broadcast(counts), "__range").withColumn(name, F.col("__before") + within).drop("__range", "__before")


def with_new_ids(merged: DataFrame, order: str, top: int | None = None) -> DataFrame:
    """Number the rows without an id in key order, behind the highest one or the
    one given."""
    if top is None:
        top = merged.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    fresh = numbered(merged.where("id is null"), order, "__n").withColumn("id", (F.col("__n") + top).cast("int"))
    return merged.where("id is not null").unionByName(fresh.drop("__n"))


def one_each(new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Of repeated new keys the last by fecha (matches) or fecha_alta; without
    either, or on equal ones, the same of them each time."""
    seq = next((c for c in ("fecha", "fecha_alta") if c in new.columns), None)
    rest = [F.col(c) for c in new.columns if c not in keys]
    order = F.struct(*([F.col(seq)] if seq else []), F.xxhash64(*rest) if rest else F.lit(0))
    return latest(new.withColumn("__order", order), keys, "__order").drop("__order")


def save(name: str, stored: DataFrame, new: DataFrame) -> DataFrame:
    """The table of that name with new rows merged by its own policy: known keys
    keep their id and what else it names, new ones are numbered. A new relation:
    bucketed.Table stores what it says, and rewrites only what changes."""
    keys, keep = POLICY[name]
    merged = upsert(stored, one_each(new, keys), keys, keep)
    return with_new_ids(merged, keys[0]) if "id" in merged.columns else merged


def described(spark: SparkSession, schemas: dict[str, StructType] | None = None) -> DataFrame:
    """(tabla, pos, columna, tipo) of schemas, as DESCRIBE tells it; of the stored
    tables unless others are given."""
    schemas = schemas or {t: StructType.fromDDL(ddl) for t, ddl in TABLES.items()}
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, schema in schemas.items() for i, f in enumerate(schema)]
    return spark.createDataFrame(rows, "tabla string, pos int, columna string, tipo string")


def describe(spark: SparkSession, database: str = "default") -> DataFrame:
    """The same of the tables as they are in a catalog."""
    out = None
    for t in TABLES:
        one = spark.sql(f"DESCRIBE TABLE {database}.{t}").select(F.lit(t).alias("tabla"), F.col("col_name").alias("columna"), F.col("data_type").alias("tipo"))
        out = one if out is None else out.unionAll(one)
    return out


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def scan_vectors(candidates: DataFrame) -> DataFrame:
    """Indexed candidates; null fragments become none."""
    none = F.array().cast(dict(candidates.dtypes)["fragmentos"])
    return candidates.where("embedding is not null").select("id", "nombre", "embedding", F.coalesce("fragmentos", none).alias("fragmentos"))


def texts_of(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    return candidates.join(ids.select("id"), "id", "left_semi").select("id", F.coalesce("texto_cv", F.lit("")).alias("texto"))


def listing(candidates: DataFrame) -> DataFrame:
    """All candidates, embedded or not, by name: accents and case do not count
    in the order."""
    chars = F.coalesce(F.char_length("texto_cv"), F.lit(0)).alias("caracteres")
    out = candidates.select("id", "nombre", "archivo", chars, F.date_format("fecha_alta", "yyyy-MM-dd'T'HH:mm:ss").alias("fecha_alta"))
    return out.orderBy(F.collate("nombre", "UNICODE_CI_AI"), "id")


def with_files(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """What a detail shows of each candidate, with indexado and pdf_disponible:
    whether the vector and the file are there."""
    there = files.select("archivo").distinct().withColumn("pdf_disponible", F.lit(True))
    text = F.coalesce("texto_cv", F.lit(""))
    return candidates.join(there, "archivo", "left").select(
        "id", "nombre", "archivo", text.alias("texto"), F.char_length(text).alias("caracteres"), F.date_format("fecha_alta", "yyyy-MM-dd'T'HH:mm:ss").alias("fecha_alta"),
        F.col("embedding").isNotNull().alias("indexado"), F.coalesce("pdf_disponible", F.lit(False)).alias("pdf_disponible"),
    )


def detail(candidates: DataFrame, files: DataFrame, id: int) -> DataFrame:
    """One candidate; no row means 404."""
    return with_files(candidates.where(F.col("id") == id), files)


def pdf_lookup(asked: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(id, archivo, status) for each id asked: 404 without such a candidate or
    without its file, 400 for a name that leaves the folder, else 200."""
    there = files.select("archivo").distinct().withColumn("__there", F.lit(True))
    both = asked.select("id").join(candidates.select("id", "archivo"), "id", "left").join(there, "archivo", "left")
    outside = F.col("archivo").contains("/") | F.col("archivo").contains("\\") | F.col("archivo").isin("", ".", "..")
    status = F.when(F.col("archivo").isNull(), 404).when(outside, 400).when(F.col("__there").isNull(), 404).otherwise(200)
    return both.select("id", "archivo", status.alias("status"))


def health(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count_if(F.col("embedding").isNotNull()).alias("candidatos"), F.max(F.size("embedding")).alias("dimension"))
