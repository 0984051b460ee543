"""Joins of figures with what they cite: exact, by tolerance, near misses and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerant.functions.numeric import SIZE, close_enough, is_percent, last_digit, power_of_ten

#: What ``matches`` needs of a figure (f) and of a value in a block (b).
FIGURE_COLUMNS = ["value", "neg", "scale", "unit", "currency", "decimals", "size", "step"]
SHIFTS = [3, -3, 6, -6, 9, -9, 12, -12]
#: Units of the last digit that figures may have: 7 numbers of decimals, 5 scales and basis points make 42.
MOST_STEPS = 64


def _col(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def unit_fits(f: str = "f", b: str = "b") -> Column:
    """Percentages only with percentages; a stated unit must be the same; an amount is nothing with a unit of its own."""
    same_kind = is_percent(_col(f, "unit")) == is_percent(_col(b, "unit"))
    amount = _col(f, "currency").isNotNull() | (_col(f, "scale") > 0)
    stated = F.when(_col(f, "unit").isNotNull(), F.coalesce(_col(f, "unit") == _col(b, "unit"), F.lit(False))).otherwise(_col(b, "unit").isNull() | ~amount)
    return same_kind & (is_percent(_col(f, "unit")) | stated)


def currency_fits(f: str = "f", b: str = "b") -> Column:
    """No currency asked for, the same one, or a block that states none."""
    return _col(f, "currency").isNull() | _col(b, "currency").isNull() | (_col(f, "currency") == _col(b, "currency"))


def sign_fits(f: str = "f", b: str = "b", neg: Column | None = None) -> Column:
    """A negative figure needs a negative value; a positive one may stand for a bracketed cost."""
    return ~(_col(f, "neg") if neg is None else neg) | _col(b, "neg")


def block_size(f: str = "f", b: str = "b") -> Column:
    """What the value amounts to in the terms the figure is written in; null if it can't be compared."""
    amount = _col(f, "currency").isNotNull() | (_col(f, "scale") > 0)
    return F.when(is_percent(_col(f, "unit")) | amount, _col(b, "size")).when(_col(b, "scale") > 0, F.lit(None)).otherwise(_col(b, "value").cast(SIZE))


def matches(f: str = "f", b: str = "b", neg: Column | None = None) -> Column:
    """Whether figure ``f`` may stand for value ``b`` (aliases of joined DataFrames); ``neg`` is read for its sign, if given."""
    target = block_size(f, b)
    return unit_fits(f, b) & currency_fits(f, b) & sign_fits(f, b, neg) & F.coalesce(close_enough(_col(f, "size"), _col(f, "step"), target), F.lit(False))


def in_year(f: str = "f", b: str = "b") -> Column:
    """A year asked for holds only where the block has a column of that year."""
    asked = _col(f, "year").isNotNull() & F.coalesce(F.exists(_col(b, "years"), lambda y: y == _col(f, "year")), F.lit(False))
    return ~asked | F.coalesce(_col(b, "year") == _col(f, "year"), F.lit(False))


def cited_matches(figures: DataFrame, blocks: DataFrame, by: str, condition: Column | None = None) -> DataFrame:
    """One row per figure that cites a block: its columns, ``known`` (there is such a block) and ``hits``.

    ``figures`` has figure_id, ``by`` (the cited block) and the figure's columns; ``blocks`` a row per value. The join
    is on the block, so what it costs grows with what is cited; counts are summed before they are brought together.
    """
    b = blocks.withColumn("_there", F.lit(True)).alias("b")
    fits = matches() if condition is None else matches() & condition
    # Figures that cite nothing, which may be very many, have no part in the join; the others' columns come out of it.
    joined = figures.filter(F.col(by).isNotNull()).alias("f").join(b, F.col(f"f.{by}") == F.col(f"b.{by}"), "left")
    others = [F.any_value(f"f.{c}").alias(c) for c in figures.columns if c != "figure_id"]
    hits = joined.groupBy("f.figure_id").agg(*others, F.coalesce(F.bool_or("b._there"), F.lit(False)).alias("known"), F.count_if(fits).alias("hits"))
    bare = figures.filter(F.col(by).isNull()).withColumns({"known": F.lit(False), "hits": F.lit(0).cast("long")})
    return hits.unionByName(bare)


#: What a near miss differs in, by bit.
KINDS = ["unit", "currency", "sign", "scale"]


def near_kinds(f: str = "f", b: str = "b") -> Column:
    """What keeps figure ``f`` from standing for value ``b``, which has its digits: the sum of a bit for each of ``KINDS``;
    0 where they fit, or have nothing in common."""
    percent = is_percent(_col(f, "unit"))
    amount = _col(f, "currency").isNotNull() | (_col(f, "scale") > 0)
    unit = ~percent & ~_col(f, "unit").eqNullSafe(_col(b, "unit")) & (_col(f, "unit").isNotNull() | amount)
    currency = ~percent & ~unit & ~currency_fits(f, b)
    face, step = _col(f, "value").cast(SIZE), _col(f, "step")
    face_step = (step / power_of_ten(_col(f, "scale"))).cast(SIZE)
    as_shown = F.when(percent | amount, _col(b, "size")).otherwise(_col(b, "value").cast(SIZE))
    straight = F.when(unit, close_enough(face, face_step, _col(b, "value").cast(SIZE))).otherwise(close_enough(_col(f, "size"), step, as_shown))
    # The same digits at another scale: the one power of ten that may bring the sizes together.
    written = (_col(f, "value") / last_digit(_col(f, "decimals"))).cast("decimal(38,0)").cast("string")
    digits = F.when(written == "0", 0).otherwise(F.length(written))  # significant digits of the figure as written
    sized = (_col(f, "size") > 0) & (_col(b, "size") > 0)
    power = F.when(sized, F.rint(F.log10(_col(b, "size").cast("double") / _col(f, "size").cast("double"))).cast("int"))
    by = power_of_ten(F.abs(power))
    moved = lambda c: F.when(power > 0, (c * by).cast(SIZE)).otherwise((c / by).cast(SIZE))
    other_scale = F.when(power.isin(SHIFTS), close_enough(moved(_col(f, "size")), moved(step), _col(b, "size")))
    scale = ~percent & ~unit & ~straight & (digits >= 3) & F.coalesce(other_scale, F.lit(False))
    same_kind = percent == is_percent(_col(b, "unit"))
    bits = sum((F.coalesce(c, F.lit(False)).cast("int") * 2**k for k, c in enumerate([unit, currency, ~sign_fits(f, b), scale])), F.lit(0))
    return F.when(same_kind & F.coalesce(straight | scale, F.lit(False)), bits).otherwise(0)


def kinds_of(bits: Column) -> Column:
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(2**k) > 0, name) for k, name in enumerate(KINDS)]))


def nearest(b: str = "b") -> Column:
    """An order of near misses as a whole number: the fewest kinds, then the first value of the block, then the kinds."""
    bits = near_kinds("f", b)
    return F.when(bits > 0, F.bit_count(bits).cast("long") * 2**48 + _col(b, "pos").cast("long") * 16 + bits)


def near_misses(figures: DataFrame, blocks: DataFrame, by: str) -> DataFrame:
    """For figures that match nothing in the block they cite: the value that they almost are.

    figure_id, kinds (an array of unit, currency, sign, scale, the fewest possible) and the value's row (``near``);
    figures that are near nothing have no row. Equal numbers of kinds go to the first value of the block (``pos``).
    """
    joined = figures.alias("f").join(blocks.alias("b"), F.col(f"f.{by}") == F.col("b." + by)).select("f.figure_id", "b.value", nearest().alias("_near")).filter("_near is not null")
    best = joined.groupBy("figure_id").agg(F.min_by("value", "_near").alias("near"), F.min("_near").alias("_near"))
    return best.select("figure_id", kinds_of(F.col("_near").bitwiseAND(15)).alias("kinds"), "near")


def where_hints(figures: DataFrame, blocks: DataFrame, k: int = 3) -> DataFrame:
    """figure_id and ``found``: the first k blocks (by block order) that hold a value the figure may stand for.

    A figure fits values within half a unit of its own last digit, and there are few different units (``step``): a
    value is met in its place at each of them, so the join is an equi-join whose rows grow with what fits, not with
    pairs of like size. What is said the same way is looked for once. Figures that fit nothing have no row; null sizes
    fit nothing.
    """
    facts = [F.col(c) for c in FIGURE_COLUMNS]
    asked = figures.filter("size is not null").select("figure_id", F.struct(*facts).alias("f"))
    steps = [r.step for r in figures.filter("step is not null and step > 0").select("step").distinct().limit(MOST_STEPS + 1).collect()]
    if len(steps) > MOST_STEPS:
        raise ValueError(f"figures have more than {MOST_STEPS} different last digits")
    said = asked.select("f").distinct()
    reach = F.floor(F.abs(F.col("f.size")) / F.col("f.step"))
    said = said.select("f", F.col("f.step").alias("step"), F.explode(F.array(reach - 1, reach, reach + 1)).alias("place"))

    # The sizes a value may stand for: as scaled, and as written.
    held = blocks.select("block_no", F.struct(*facts).alias("b"))
    sizes = F.array_distinct(F.array(F.abs(F.col("b.size")), F.col("b.value").cast(SIZE)))
    each = held.filter("b.size is not null").select("block_no", "b", F.explode(sizes).alias("size"))
    each = each.withColumn("step", F.explode(F.array(*[F.lit(s).cast(SIZE) for s in steps])) if steps else F.lit(None).cast(SIZE))
    each = each.withColumn("place", F.floor(F.col("size") / F.col("step")))
    found = said.join(each, ["step", "place"]).filter((F.abs(block_size("f", "b")) == F.col("size")) & matches("f", "b")).select("f", "block_no")
    rank = F.dense_rank().over(Window.partitionBy("f").orderBy("block_no"))  # a limit of ranks is kept before rows are shuffled
    first = found.withColumn("_rank", rank).filter(F.col("_rank") <= k).groupBy("f").agg(F.sort_array(F.collect_set("block_no")).alias("found"))
    return asked.join(first, "f").select("figure_id", "found")
