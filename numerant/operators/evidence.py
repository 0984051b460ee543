"""What stands behind a figure: from its citation through calculations to sources, however many levels there are."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerant.sources.tables import large
from numerant.sources.versions import fresh_folder

ASSUMPTION = "assumption"
MOST_LEVELS = 100


def _own_key(node: str = "node", owner: str = "figure_id") -> Column:
    """A node as the key of a join that tells what it is; assumptions are nothing else and have keys that few rows share."""
    return F.when(F.col(node) == ASSUMPTION, F.concat(F.lit(ASSUMPTION + " of "), F.col(owner).cast("string"))).otherwise(F.col(node))


def _in_parts(df: DataFrame, parts: int | None, *keys: str | Column) -> DataFrame:
    return df.repartition(parts, *keys) if parts else df


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the folder that driver and executors share, and read from there."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evidence(figures: DataFrame, inputs: DataFrame, most_levels: int = MOST_LEVELS, parts: int | None = None) -> DataFrame:
    """One row per thing that a figure rests on: figure_id, node, level (0: what it cites), at (the numbers of the inputs
    on the way there), calculation (the one it is an input of) and leaf (nothing is made of other inputs there).

    ``figures``: figure_id, cite; ``inputs``: calc_id, no, source_id (a block, another calculation or ``assumption``). A
    calculation that rests on itself is met once on every way. Figures without a citation have no rows. Assumptions are
    followed no further, so that they are no common key. ``parts``: how many parts joins have (it should grow with the tables).

    What is below a calculation that is an input of others is found once, by a recursive query of at most ``most_levels``
    levels, and not for every figure: a calculation that is nobody's input is on no way but as its first step. Those
    shared calculations and their inputs are stored, as each level would read the tables anew.
    """
    spark = figures.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", -1)  # evidence grows with the figures; levels are bounded
    cited = figures.filter("cite is not null").select("figure_id", "cite")
    steps = inputs.filter(F.col("calc_id") != ASSUMPTION).select("calc_id", F.col("no").cast("int").alias("no"), "source_id")
    sources = steps.filter(F.col("source_id") != ASSUMPTION).select(F.col("source_id").alias("id")).distinct()
    shared = _stored(steps.select(F.col("calc_id").alias("id")).distinct().join(large(sources), "id", "left_semi"), "shared")
    made = shared.withColumn("_made", F.lit(True))

    def told(rows: DataFrame, node: str, flag: str) -> DataFrame:
        """Whether ``node`` is a shared calculation."""
        known = rows.withColumn("_key", _own_key(node, "calc_id")).join(made.withColumnRenamed("id", "_key"), "_key", "left")
        return known.withColumn(flag, F.col("_made").isNotNull()).drop("_key", "_made")

    below = _stored(told(steps.join(shared.withColumnRenamed("id", "calc_id"), "calc_id", "left_semi"), "source_id", "goes_on"), "below")

    # Where ways into shared calculations begin: at what is cited, or at an input of it.
    own = steps.join(shared.withColumnRenamed("id", "calc_id"), "calc_id", "left_anti")
    entered = own.join(shared.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(large(cited.select(F.col("cite").alias("calc_id")).distinct()), "calc_id", "left_semi")
    entered = entered.select(F.col("source_id").alias("id")).unionByName(cited.select(F.col("cite").alias("id")).join(shared, "id", "left_semi")).distinct()
    mark = uuid.uuid4().hex
    entered.createOrReplaceTempView(f"entered_{mark}")
    below.createOrReplaceTempView(f"below_{mark}")
    walk = spark.sql(f"""
        WITH RECURSIVE walk(root, way, at, goes_on) MAX RECURSION LEVEL {most_levels} AS (
          SELECT id, array(id), CAST(array() AS ARRAY<INT>), true FROM entered_{mark}
          UNION ALL
          SELECT w.root, concat(w.way, array(i.source_id)), concat(w.at, array(i.no)), i.goes_on
          FROM walk w JOIN below_{mark} i ON i.calc_id = element_at(w.way, -1) WHERE w.goes_on AND NOT array_contains(w.way, i.source_id))
        SELECT root AS _key, element_at(way, -1) AS _node, at AS _at, try_element_at(way, -2) AS _calculation, NOT goes_on AS _leaf FROM walk
    """)

    # What is cited, and its inputs if no shared calculation is cited: the first input's row stands for the calculation too.
    first = F.row_number().over(Window.partitionBy("calc_id").orderBy("no")) == 1
    step = lambda no, source, of_itself: F.struct(no.cast("int").alias("no"), source.cast("string").alias("source_id"), F.lit(of_itself).alias("of_itself"))
    none = F.array().cast("array<struct<no:int,source_id:string,of_itself:boolean>>")
    itself = F.when(F.col("first"), F.array(step(F.lit(None), F.lit(None), True))).otherwise(none)
    its_own = F.when(~F.col("is_shared") & F.col("source_id").isNotNull(), F.array(step(F.col("no"), F.col("source_id"), False))).otherwise(none)
    each = told(_in_parts(steps, parts, "calc_id"), "calc_id", "is_shared").withColumn("first", first).select("calc_id", F.explode(F.concat(itself, its_own)).alias("s"))
    heads = _in_parts(cited, parts, "cite").join(large(each), F.col("cite") == F.col("calc_id"), "left")
    is_input = F.coalesce(~F.col("s.of_itself"), F.lit(False))
    heads = heads.select(
        "figure_id", F.when(is_input, F.col("s.source_id")).otherwise(F.col("cite")).alias("root"), F.when(is_input, F.array("s.no")).otherwise(F.array().cast("array<int>")).alias("at"),
        F.when(is_input, F.col("cite")).alias("calculation"), (is_input | F.col("s").isNull()).alias("leaf"),
    ).withColumn("_key", _own_key("root"))
    found = _in_parts(heads, parts, "_key").join(large(_in_parts(walk, parts, "_key")), "_key", "left")
    at = F.concat("at", F.coalesce("_at", F.array().cast("array<int>")))
    return found.select("figure_id", F.coalesce("_node", "root").alias("node"), F.size(at).alias("level"), at.alias("at"), F.coalesce("_calculation", "calculation").alias("calculation"), F.coalesce("_leaf", "leaf").alias("leaf"))


def evidence_lines(found: DataFrame, sources: DataFrame, parts: int | None = None) -> DataFrame:
    """figure_id and ``line``: the files and places a figure rests on, in the order of the inputs, as ``file · place, place;
    file · place``, and how many assumptions. ``sources``: source_id, file, place (may be null). Leaves that are no source
    are told by their id. Places of a file come once, where they are first met. ``parts``: how many parts figures are
    dealt out into, once for all sums."""
    keyed = _in_parts(found.filter("leaf").withColumn("_key", _own_key()), parts, "_key")
    leaves = _in_parts(keyed.join(sources.withColumnRenamed("source_id", "_key"), "_key", "left"), parts, "figure_id")
    file = F.when(F.col("node") != ASSUMPTION, F.coalesce("file", "node"))
    places = leaves.groupBy("figure_id", file.alias("file"), "place").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("at", "place")))), lambda p: p["place"]), ", ")
    files = places.groupBy("figure_id", "file").agg(F.min("at").alias("at"), F.sum("n").alias("n"), told.alias("_places"))
    line = F.when(F.col("_places") != "", F.concat("file", F.lit(" · "), "_places")).otherwise(F.col("file"))
    listed = F.array_sort(F.collect_list(F.when(F.col("file").isNotNull(), F.struct("at", line.alias("line")))))
    out = files.groupBy("figure_id").agg(F.array_join(F.transform(listed, lambda f: f["line"]), "; ").alias("_files"), F.coalesce(F.sum(F.when(F.col("file").isNull(), F.col("n"))), F.lit(0)).alias("_assumed"))
    some = F.when(F.col("_assumed") > 0, F.concat(F.col("_assumed").cast("string"), F.when(F.col("_assumed") == 1, " assumption").otherwise(" assumptions")))
    return out.select("figure_id", F.concat_ws("; ", F.when(F.col("_files") != "", F.col("_files")), some).alias("line"))
