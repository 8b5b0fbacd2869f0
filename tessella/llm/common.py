"""What the operators of this folder share: reading tables, cutting lineage, page and site keys, word forms."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where it is unset, a temporary folder of our own if the
    session runs on this machine alone, else an error: executors of a cluster would each write to their own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tessella-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table into the shared folder and read it back.

    Cuts the lineage so that a loop or a second use doesn't compute df again, survives the loss of executors, and
    is columnar and compressed, so smaller than an RDD checkpoint.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Remove the tables that cut has written so far; to be called when no result that reads them is needed any more.
    Returns their number."""
    jvm, n = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """df with a broadcast hint if its counted size is within the bound, else as it is: the join is then shuffled.  Size
    and bound are rows where rows are of fixed length, else bytes."""
    return F.broadcast(df) if rows <= max_rows else df


def page_url(base_url: Column, url: Column) -> Column:
    """base_url, or url without its fragment where base_url is null or blank."""
    base = F.when(F.trim(base_url) != "", base_url)
    return F.trim(F.coalesce(base, F.regexp_replace(url, "#.*$", "")))


def page_key(page: Column) -> Column:
    """Lower case, without scheme, leading www. and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(page), r"^([a-z][a-z0-9+.\-]*:)?//", ""), r"^www\.|/+$", "")


def site_key(page: Column) -> Column:
    """Host of a page in lower case without user, port and leading www."""
    host = F.regexp_extract(page_key(page), r"^([^/?#]*)", 1)
    return F.regexp_replace(host, r"^.*@|:\d*$", "")


def plain_words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case and without accents, whether these are composed or combining."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return WORD.findall(text.lower())
