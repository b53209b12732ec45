"""Small documents of a run: JSON reports and state, run logs, daily batches, cached samples, seeds, pasted requests.

Documents are written under another name and renamed, so that a reader sees the old one or the new one; tables go
through Spark's committers.  Paths may be of any file system that Spark knows.
"""

from __future__ import annotations

import json
import re
import shlex
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import channel_ref


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something under a path."""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_document(spark: SparkSession, path: str, value: object, tries: int = 6, pause: float = 0.1) -> None:
    """Replace a JSON document at once; a failed rename is tried again after ever longer pauses."""
    fs, target = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    out.close()
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    for n in range(1, tries + 1):
        try:
            context.rename(draft, target, over)
            return
        except Py4JJavaError:
            if n == tries:
                fs.delete(draft, False)
                raise
            time.sleep(pause * n)


def read_document(spark: SparkSession, path: str, default: object = None) -> object:
    """A JSON document, or the default if there is none."""
    if not exists(spark, path):
        return default
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one JSON document: a list of its rows, in their order."""
    write_document(df.sparkSession, path, [json.loads(x) for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]])


def write_day(df: DataFrame, path: str, date: str) -> None:
    """A day's batch as JSON lines; writing the day again replaces it, other days stay."""
    df.withColumn("batch_date", F.lit(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_date").json(path)


def log_run(spark: SparkSession, path: str, run: str, counts: DataFrame, by: str) -> None:
    """Counters of a run by a key, kept as one part a run: a repeated run replaces itself."""
    counts.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def cumulative(log: DataFrame, by: str, counters: list[str]) -> DataFrame:
    """(run, by, counter.., total_counter..): counters of every run with those of all runs up to it; the row with a null key is of all keys."""
    from pyspark.sql import Window

    each = log.select("run", by, *counters)
    both = each.unionByName(each.groupBy("run").agg(*[F.sum(c).alias(c) for c in counters]).withColumn(by, F.lit(None).cast(each.schema[by].dataType)))
    upto = Window.partitionBy(by).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return both.select("run", by, *counters, *[F.sum(c).over(upto).alias(f"total_{c}") for c in counters])


def cached_sample(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The sample under a path, made and written there if there is none."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def release(df: DataFrame, path: str, copy: str) -> None:
    """Write a result and, from what was written, the copy that is released."""
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.read.parquet(path).write.mode("overwrite").parquet(copy)


def vocabulary_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header and without an index; quotes doubled, so that other readers agree."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def fill_report(text: str, values: dict[str, str]) -> tuple[str, list[str]]:
    """(text, labels not found): the bold number in the first table row of each label replaced."""
    missing = []
    for label, value in values.items():
        text, n = re.subn(rf"(?m)^(\|[ \t]*{re.escape(label)}[ \t]*\|[^|\n]*?\*\*)[^*|\n]*(\*\*)", lambda m, v=value: m[1] + v + m[2], text, count=1)
        if not n:
            missing.append(label)
    return text, missing


def multiline_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON list that spans lines."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def seed_channels(spark: SparkSession, text: str, key: str = "channels") -> DataFrame:
    """(handle, channel_id, max_videos) of a YAML list of references, or of mappings with a reference and a cap."""
    import yaml

    rows = []
    for entry in (yaml.safe_load(text) or {}).get(key) or []:
        given = {"ref": entry} if isinstance(entry, str) else entry
        rows.append((given.get("ref"), given.get("handle"), given.get("channel_id"), given.get("max_videos")))
    raw = spark.createDataFrame(rows, "ref string, handle string, channel_id string, max_videos int")
    found = channel_ref(F.col("ref"))
    # A mapping names an id or, without one, a handle.
    one_handle = F.when(F.col("channel_id").isNull(), F.col("handle"))
    return raw.select(F.coalesce(one_handle, found["handle"]).alias("handle"), F.coalesce("channel_id", found["channel_id"]).alias("channel_id"), "max_videos")


def pasted_request(command: str) -> dict[str, str | None]:
    """Cookie header and user agent of a request pasted from a browser as a shell command; bodies and other headers are ignored."""
    words = shlex.split(command.replace("\\\r\n", " ").replace("\\\n", " "))
    found: dict[str, str | None] = {"cookie_header": None, "user_agent": None}
    for option, value in zip(words, words[1:]):
        if option in ("-b", "--cookie"):
            found["cookie_header"] = value
        elif option in ("-A", "--user-agent"):
            found["user_agent"] = value
        elif option in ("-H", "--header"):
            name, _, rest = value.partition(":")
            target = {"cookie": "cookie_header", "user-agent": "user_agent"}.get(name.strip().lower())
            if target:
                found[target] = rest.strip()
    return found


def cookies(header: str) -> dict[str, str]:
    """Name to value of a cookie header; parts without a sign are left out, the last of a name wins."""
    pairs = (part.partition("=") for part in header.split(";"))
    return {name.strip(): value.strip() for name, sign, value in pairs if sign and name.strip()}
