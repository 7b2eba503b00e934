"""What the operators share: staged tables, checked broadcasts and hashed word shingles."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters other than space and the ASCII controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir); a local one only where Spark itself is local."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    _own = _own or "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own


_own = ""


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: this cuts the lineage and survives lost executors."""
    return Scratch(df.sparkSession).stage(df, name)


class Scratch:
    """The staged tables of one job. Those that no later step and no result reads can be dropped, so that disk is freed while the job runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.at = spark, f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}", {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.at)}-{name}"
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        self.at[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables. What was computed from them must be staged itself by now."""
        context = self.spark.sparkContext
        for df in tables:
            path, _ = self.at[id(df)]
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def _is_scan(docs: DataFrame) -> bool:
    """Whether the plan is one scan of files below projections and filters, so that a row of docs is a row of a file and no other row of docs is."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def placed_rows(docs: DataFrame) -> DataFrame:
    """_doc (a struct of the row), and two long columns that name the row whatever it holds: `_file` (a hash of its file's path) and `_at` (its place in the file).

    They come from the files that docs is read from, so they stay the same when docs is read again. Anything else than one scan below projections and
    filters (rows exploded, united, joined or made in memory) is staged once, as its rows may share a place or have none. No column of docs can clash with them.
    """
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    if _is_scan(docs):
        try:
            found = docs.select(F.struct(*docs.columns).alias("_doc"), *place)
            found.schema  # noqa: B018  (resolves the names)
            return found
        except AnalysisException:  # the files' format has no places
            pass
    docs = stage(docs, "rows")
    return docs.select(F.struct(*docs.columns).alias("_doc"), *place)


def bounded_sample(df: DataFrame, most: int) -> DataFrame:
    """About `most` rows of df (staged) at most, without repeats: those whose hash over all columns is below the share that a count gives. No row is sorted or sent to get there."""
    share = min(1.0, most / max(1, df.count()))
    return df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()


def small_side(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df, marked for broadcast only if a count proves that it has few rows; else Spark shuffles the join.

    df must be staged or cheap, as it is counted here. Its rows are some dozen bytes each.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of df with one more field."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def ascii_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased. bytes.split() and bytes.lower() know ASCII alone, as WORD does."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants), so that near inputs give unrelated outputs."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACES = odd_constants(64, 5)


def shingle_set(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, width)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h += w[j : n - k + 1 + j] * _PLACES[j]
    return np.unique(mix64(h))


def list_array(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column out of one numpy array per row."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], kind))
