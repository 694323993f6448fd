"""Equi-joins of one key a side, and spatial joins over a grid of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.errors import SchemaMismatch
from larkspur.functions import geo
from larkspur.operators.frame import require

#: Sides of up to so many rows and bytes, as Spark estimates them, may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
#: Binary logarithms of the sides of grid cells: the least and greatest.
FINEST, COARSEST = -30, 60
#: Rows of one geometry that are joined as one block; above so many rows of one geometry, they are dealt to several tasks before blocks are made.
BLOCK_ROWS, SHARE_ROWS = 256, 1 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is estimated and counted to be small; else as it is, for the planner to shuffle."""
    return F.broadcast(df) if estimated_bytes(df) <= most_bytes and df.limit(rows + 1).count() <= rows else df


def join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner") -> DataFrame:
    """inner, left, right, full, semi or anti. Null keys match nothing.

    Left columns, then right ones without the key; a clashing name gets ``_right``; right and full joins
    fill the key from whichever side has it.
    """
    require(left, [left_on])
    require(right, [right_on])
    if left.schema[left_on].dataType != right.schema[right_on].dataType:
        raise SchemaMismatch(f"{left_on} and {right_on} differ in type")
    a, b = left.alias("_l"), right.alias("_r")
    found = a.join(b, F.col(f"_l.{left_on}") == F.col(f"_r.{right_on}"), {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    if how in ("semi", "anti"):
        return found
    key = F.coalesce(F.col(f"_l.{left_on}"), F.col(f"_r.{right_on}")).alias(left_on) if how in ("right", "full") else F.col(f"_l.{left_on}")
    mine = [key if c == left_on else F.col(f"_l.{c}") for c in left.columns]
    theirs = [F.col(f"_r.{c}").alias(f"{c}_right" if c in left.columns else c) for c in right.columns if c != right_on]
    return found.select(*mine, *theirs)


def boxed(df: DataFrame, geometry: str) -> DataFrame:
    """The rows with a geometry that isn't empty, with its bounds and the level of the grid cells that fit it."""
    found = df.withColumn("_b", geo.bounds(F.col(geometry))).filter("_b IS NOT NULL")
    found = found.select(*df.columns, *(F.col(f"_b.{x}").alias(n) for x, n in zip(("min_x", "min_y", "max_x", "max_y"), ("_x0", "_y0", "_x1", "_y1"))))
    extent = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    level = F.when(extent > 0, F.ceil(F.log2(F.greatest(extent, F.lit(1e-300))))).otherwise(FINEST)
    return found.withColumn("_own", F.greatest(F.least(level, F.lit(COARSEST)), F.lit(FINEST)).cast("int"))


def cells(df: DataFrame, others: list[int]) -> DataFrame:
    """A row for each cell that the bounds touch, at most four at each level where it may meet one of the levels ``others``: the coarser of the two."""
    levels = F.array_distinct(F.transform(F.array(*(F.lit(x).cast("int") for x in others)), lambda x: F.greatest(x, F.col("_own")))) if others else F.array().cast("array<int>")
    df = df.withColumn("_level", F.explode(levels)).withColumn("_cell", F.pow(F.lit(2.0), "_level"))
    for axis in "xy":
        df = df.withColumn(f"_c{axis}", F.explode(F.sequence(*(F.floor(F.col(f"_{axis}{i}") / F.col("_cell")) for i in (0, 1)))))
    return df


def distinct(df: DataFrame, geometry: str) -> DataFrame:
    """Each geometry once, as ``_g``, with the number ``_n`` of its rows, boxed."""
    found = df.groupBy(F.col(geometry).alias("_g")).agg(F.count("*").alias("_n"))
    # a geometry that depends on the count, so that the optimizer doesn't ask bounds of every row before they are grouped
    return boxed(found.select(F.when(F.col("_n") > 0, F.col("_g")).alias("_g"), "_n"), "_g")


def key_of(geometry: str) -> Column:
    """A geometry's SHA-256, which stands for its bytes where rows are matched with it."""
    return F.unhex(F.sha2(F.col(geometry), 256))


def blocks(df: DataFrame, geometry: str, many: list[tuple[bytes, int]], side: str) -> DataFrame:
    """The rows without their geometry in arrays of up to BLOCK_ROWS of one geometry; ``many`` gives the shares of those of over SHARE_ROWS rows."""
    plain = [f for f in df.schema.fields if f.name != geometry]
    hashed = [F.col(f.name) for f in plain if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    row = F.struct(*(F.col(f.name) for f in plain)) if plain else F.struct(F.lit(True).alias("_"))
    # numbered in an order of their content, so that a task that is run again makes the same blocks
    rows = df.filter(F.col(geometry).isNotNull()).select(key_of(geometry).alias("_key"), row.alias("_row"), (F.xxhash64(*hashed) if hashed else F.lit(0).cast("long")).alias("_hash"))
    share = F.lit(0).cast("long")
    if many:
        rows = rows.join(F.broadcast(df.sparkSession.createDataFrame(many, "_key binary, _shares long")), "_key", "left")
        share = F.coalesce(F.pmod("_hash", "_shares"), share)
    rows = rows.withColumn("_share", share)
    number = F.row_number().over(Window.partitionBy("_key", "_share").orderBy("_hash")) - 1
    made = rows.withColumn("_at", F.floor(number / BLOCK_ROWS)).groupBy("_key", "_share", "_at").agg(F.collect_list("_row").alias("_rows"))
    return made.select(*(F.col(c).alias(f"{side}{c}") for c in ("_key", "_share", "_at", "_rows")))


def sjoin(left: DataFrame, right: DataFrame, left_geometry: str, right_geometry: str, predicate: str = "intersects") -> DataFrame:
    """Inner join of the pairs for which ``predicate`` (intersects, contains or within) holds of left and right.

    Geometries are paired first, each once however many rows it stands on, and the predicate is asked once of a pair; then
    come the rows, in blocks of up to BLOCK_ROWS of one geometry, and the pairs of blocks are dealt to tasks before they are
    unfolded, so that no task has more than its share of a result that grows with the product of rows.

    A geometry's level is that of grid cells no smaller than itself, so that it touches four at most. Of a pair the larger one
    is looked up in the cells of its own level and the smaller one comes there, whichever side it is on; where
    both touch several, they are paired in that of their bounds' common corner. So no geometry fills many
    cells, nothing is compared with everything, and no pair has to be made distinct; crowded cells are split by adaptive
    execution, as for any skewed join. The levels that there are, some 90 at most, and the geometries of very many rows are found
    beforehand in one pass over each side. The right geometry is dropped; clashing names get ``_right``.
    """
    require(left, [left_geometry])
    require(right, [right_geometry])
    a, b = distinct(left, left_geometry), distinct(right, right_geometry)
    shares = F.when(F.col("_n") > SHARE_ROWS, F.struct(key_of("_g"), F.ceil(F.col("_n") / SHARE_ROWS)))
    (levels, left_many), (other_levels, right_many) = (df.agg(F.collect_set("_own"), F.collect_list(shares)).first() for df in (a, b))
    looks, dealt = cells(a, sorted(other_levels)), cells(b, sorted(levels))
    other = dealt.select(*(F.col(c).alias(f"_r_{c}") for c in dealt.columns))
    met = looks.join(other, (F.col("_level") == F.col("_r__level")) & (F.col("_cx") == F.col("_r__cx")) & (F.col("_cy") == F.col("_r__cy")))
    met = met.filter(F.col("_level") == F.greatest("_own", "_r__own"))
    corner = (F.floor(F.greatest("_x0", "_r__x0") / F.col("_cell")) == F.col("_cx")) & (F.floor(F.greatest("_y0", "_r__y0") / F.col("_cell")) == F.col("_cy"))
    overlap = (F.col("_x0") <= F.col("_r__x1")) & (F.col("_r__x0") <= F.col("_x1")) & (F.col("_y0") <= F.col("_r__y1")) & (F.col("_r__y0") <= F.col("_y1"))
    pairs = met.filter(corner & overlap).filter(geo.relate(predicate)(F.col("_g"), F.col("_r__g"))).select("_g", key_of("_g").alias("_l_key"), key_of("_r__g").alias("_r_key"))
    both = pairs.join(blocks(left, left_geometry, left_many, "_l"), "_l_key").join(blocks(right, right_geometry, right_many, "_r"), "_r_key")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(tasks, *(f"{side}_{c}" for side in ("_l", "_r") for c in ("key", "share", "at")))
    found = both.select("_g", F.explode("_l_rows").alias("_l"), "_r_rows").select("_g", "_l", F.explode("_r_rows").alias("_r"))
    named = lambda c, df, old, new: c.alias(new, metadata=df.schema[old].metadata)
    mine = [named(F.col("_g") if c == left_geometry else F.col("_l")[c], left, c, c) for c in left.columns]
    theirs = [named(F.col("_r")[c], right, c, f"{c}_right" if c in left.columns else c) for c in right.columns if c != right_geometry]
    return found.select(*mine, *theirs)
