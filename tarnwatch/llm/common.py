"""What the corpus operators share: the shared folder, reading tables, text conventions."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only white space that separates words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key with more than this part of the rows of a join is dealt out over several tasks.
HOT_KEYS = 1000
#: Positions whose running values come from one start.
SCAN_BLOCK = 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A path without a scheme is
    one of Hadoop's default file system, and is named with it: pyarrow would take it for a local one.

    Where it is unset, a local session gets a temporary folder; a cluster session is
    refused, since its executors could not see it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return qualified(spark, named)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tarnwatch-")
    atexit.register(_remove_local, own)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path that begins with / with the scheme of the default file system; others as they are."""
    if path.startswith("/"):
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        path = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()
    return path.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: cuts the lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step and no result reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z only; lower() alone would also change other letters."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def ascii_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-space characters; empty for null or blank text."""
    body = ascii_strip(F.coalesce(text, F.lit("")))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_CLASS + "+"))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: a name in a lambda, which no rewrite of the
    plan replaces by the expression it stands for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def columns_but(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The columns of df, but those that go by one of the names: a result column of that name
    takes their place."""
    gone = {n.lower() for n in names}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in gone]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def skew_join(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], count: str, spread: Sequence[str]) -> DataFrame:
    """rows joined to keyed, which has one row for each keys, and in count how many rows meet it.

    A key that more than one in HOT_KEYS of the joined rows have gets several salts: fewer than
    HOT_KEYS such keys exist, so they are broadcast, and each row takes one of its key's salts
    by the hash of the columns in spread. keyed should be stored, as it is read three times.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 1
    salted = keyed.withColumn("_salts", F.greatest(F.ceil(F.col(count) * HOT_KEYS / F.lit(total)), F.lit(1)).cast("int"))
    hot = salted.filter("_salts > 1").select(*keys, "_salts")
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int")
    placed = rows.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", salt).drop("_salts")
    dealt = salted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return placed.join(dealt, [*keys, "_salt"]).drop("_salt")


def scan(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """At each position of an array, op over all values before it. Each block of positions
    starts from the values of the blocks before, so the work is in proportion to the array."""
    low = SCAN_BLOCK - 1
    shift = SCAN_BLOCK.bit_length() - 1

    def over(v: Column, first: Column, last: Column, start: Column) -> Column:
        return F.when(first > last, start).otherwise(F.aggregate(F.sequence(first, last), start, lambda a, j: op(a, F.get(v, j))))

    def build(v: Column) -> Column:
        blocks = F.shiftright(F.size(v) - 1, shift)
        heads = F.when(blocks < 1, F.array(zero)).otherwise(F.aggregate(
            F.sequence(F.lit(0), blocks - 1), F.array(zero), lambda a, b: F.concat(a, F.array(over(v, b * SCAN_BLOCK, b * SCAN_BLOCK + low, F.element_at(a, -1)))),
        ))
        return let(heads, lambda h: F.transform(v, lambda _, i: over(v, i - i.bitwiseAND(F.lit(low)), i - 1, F.get(h, F.shiftright(i, shift)))))

    return let(values, build)


def without(parts: Column, gone: Column, separator: str = "\n") -> Column:
    """The parts but those at the positions in gone (ascending), joined."""
    none = F.array().cast("array<string>")

    def build(both: Column) -> Column:
        p, out = both["p"], both["out"]

        def run(k: Column) -> Column:
            first = F.when(k == 0, F.lit(0)).otherwise(F.get(out, k - 1) + 1)
            last = F.when(k == F.size(out), F.size(p)).otherwise(F.get(out, k)) - 1
            return F.when(first > last, none).otherwise(F.transform(F.sequence(first, last), lambda j: F.get(p, j)))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(out)), run)), separator)

    return let(F.struct(parts.alias("p"), gone.alias("out")), build)
