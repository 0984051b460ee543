"""Tables kept as whole versions: data files first, then a commit that names them.

A version is a commit file with the next free number. It lists the parts of the table, so a reader takes the newest whole
commit and never sees data that was not committed, nor half of a commit. Writers that come second find the number taken
and try the next one, on top of what the first has added; their data stay as they were written, as rows hold their place
in their part only and the commit says which number a part begins with. So ids go on without gaps, whoever writes.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"
PLACE = "_place"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share, ``spark.checkpoint.dir``. Only a local session that names
    none, as in tests, gets a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="numerant-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm.org.apache.hadoop.fs.Path


def _whole(spark: SparkSession, path: str, number: int) -> dict | None:
    fs, as_path = _store(spark, path)
    reader = spark._jvm.org.apache.commons.io.IOUtils
    stream = fs.open(as_path(f"{path}/{COMMITS}/{number:012d}"))
    try:
        return json.loads(reader.toString(stream, "UTF-8"))
    except ValueError:  # its writer was lost before the end
        return None
    finally:
        stream.close()


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, as_path = _store(spark, path)
    folder = as_path(f"{path}/{COMMITS}")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []


def newest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """The highest number taken, and the newest whole commit (None: there is no version yet)."""
    numbers = _numbers(spark, path)
    for n in reversed(numbers):
        if (found := _whole(spark, path, n)) is not None:
            return numbers[-1], found
    return (numbers[-1] if numbers else 0), None


def _committed(spark: SparkSession, path: str, change: Callable[[dict], dict | None]) -> dict:
    """The commit that ``change`` makes of the newest one, under the first number that is free; None leaves it as it is."""
    fs, as_path = _store(spark, path)
    while True:
        number, old = newest(spark, path)
        old = old or {"parts": [], "rows": 0, "batches": []}
        new = change(old)
        if new is None:
            return old
        try:
            out = fs.create(as_path(f"{path}/{COMMITS}/{number + 1:012d}"), False)
        except Exception as taken:  # noqa: BLE001 - py4j wraps what the file system says
            if "exist" in str(taken).lower():
                continue
            raise
        out.write(json.dumps(new).encode())
        out.close()
        return new


def written(rows: DataFrame, path: str, order: list[Column] | None = None) -> dict:
    """``rows`` as the files of a part that nothing refers to yet, in ``order`` if given: its name and the rows in each of
    its ranges. Ranges are numbered side by side, so no task sees all rows."""
    spark = rows.sparkSession
    name = f"data/{uuid.uuid4().hex}"
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.withColumn(PLACE, F.monotonically_increasing_id()).write.parquet(f"{path}/{name}")
    counts = spark.read.parquet(f"{path}/{name}").groupBy(F.shiftrightunsigned(PLACE, 33).alias("range")).agg(F.count(F.lit(1)).alias("n"))
    return {"name": name, "ranges": sorted([r.range, r.n] for r in counts.collect())}  # one for each range


def appended(rows: DataFrame, path: str, order: list[Column] | None = None, batch: int | None = None) -> dict:
    """Adds ``rows`` as one version. A ``batch`` (of a stream) that was added before is not added again."""
    spark = rows.sparkSession
    if batch is not None and batch in (newest(spark, path)[1] or {"batches": []})["batches"]:
        return newest(spark, path)[1]
    part = written(rows, path, order)

    def change(old: dict) -> dict | None:
        if batch is not None and batch in old["batches"]:
            return None
        added = sum(n for _, n in part["ranges"])
        return {"parts": [*old["parts"], part | {"first": old["rows"] + 1}], "rows": old["rows"] + added, "batches": old["batches"] + ([batch] if batch is not None else [])}

    return _committed(spark, path, change)


def replaced(rows: DataFrame, path: str, order: list[Column] | None = None) -> dict:
    """The table as ``rows`` alone, in one version; readers of older versions keep theirs."""
    part = written(rows, path, order)
    return _committed(rows.sparkSession, path, lambda old: {"parts": [part | {"first": 1}], "rows": sum(n for _, n in part["ranges"]), "batches": old["batches"]})


def current(spark: SparkSession, path: str, number: str = "number") -> DataFrame | None:
    """The newest whole version, with ``number``: places from 1, in the order of writing; None if there is none."""
    found = newest(spark, path)[1]
    if not found or not found["parts"]:
        return None
    out = None
    for part in found["parts"]:
        first, begins = part["first"], {}
        for k, n in part["ranges"]:
            begins[k] = first
            first += n
        rows = spark.read.parquet(f"{path}/{part['name']}")
        if begins:
            firsts = F.array(*[F.lit(begins.get(k, 0)).cast("long") for k in range(max(begins) + 1)])
            within = F.col(PLACE).bitwiseAND((1 << 33) - 1)
            rows = rows.withColumn(number, F.get(firsts, F.shiftrightunsigned(PLACE, 33).cast("int")) + within)
        else:
            rows = rows.withColumn(number, F.lit(0).cast("long"))
        rows = rows.drop(PLACE)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def with_ids(rows: DataFrame, prefix: str, name: str, number: str = "number") -> DataFrame:
    """``number`` as an id: W3 after W2."""
    return rows.withColumn(name, F.concat(F.lit(prefix), F.col(number).cast("string"))).drop(number)
