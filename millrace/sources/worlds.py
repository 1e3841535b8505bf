"""A synthetic world per seed: entities whose attributes are hashes of (seed, slot), so that any partition can make its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = [("country", 6), ("feature", 5), ("city", 6), ("organisation", 8), ("person", 10), ("work", 3)]
_HEADS = ["Bal", "Cor", "Dun", "Esk", "Fal", "Gor", "Hal", "Ist", "Jun", "Kel", "Lor", "Mar", "Nor", "Osk", "Pel", "Quor"]
_TAILS = ["adin", "ebor", "iland", "omere", "uven", "atha", "essin", "ivorn", "ombra", "ustil", "andel", "ercot", "inore", "olwen", "urbeck", "yston"]


def draw(seed: Column, slot: Column, what: str, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, slot, F.lit(what)), F.lit(n))


def entities(spark: SparkSession, seeds: DataFrame) -> DataFrame:
    """seed, id, name, kind, attrs of every entity of the seeds (column ``seed``); 38 a seed, names unique within it."""
    slots = spark.createDataFrame([(k, i, sum(n for _, n in KINDS[:j]) + i) for j, (k, n) in enumerate(KINDS) for i in range(n)], "kind string, i int, slot int")
    e = seeds.select("seed").distinct().join(F.broadcast(slots))
    # 256 names; an odd stride and a per-seed start make the 38 slots of a seed different ones.
    number = F.pmod(F.col("slot") * (2 * draw(F.col("seed"), F.lit(0), "stride", 64) + 1) + draw(F.col("seed"), F.lit(0), "start", 256), F.lit(256))
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in _HEADS]), (number % 16 + 1).cast("int")), F.element_at(F.array(*[F.lit(x) for x in _TAILS]), (F.floor(number / 16) + 1).cast("int")))
    s, k = F.col("seed"), F.col("slot")
    year, size = (1500 + draw(s, k, "year", 500)).cast("string"), (1000 + draw(s, k, "size", 900_000)).cast("string")
    link = lambda kind, n, what: F.concat(F.lit(kind), draw(s, k, what, n).cast("string"))
    attrs = (
        F.when(F.col("kind") == "country", F.create_map(F.lit("capital"), F.concat(F.lit("city"), F.col("i").cast("string")), F.lit("population"), size))
        .when(F.col("kind") == "feature", F.create_map(F.lit("located_in"), link("country", 6, "in"), F.lit("length_km"), size))
        .when(F.col("kind") == "city", F.create_map(F.lit("country"), F.concat(F.lit("country"), F.col("i").cast("string")), F.lit("founded_in"), year))
        .when(F.col("kind") == "organisation", F.create_map(F.lit("headquartered_in"), link("city", 6, "seat"), F.lit("founder"), link("person", 10, "founder")))
        .when(F.col("kind") == "person", F.create_map(F.lit("born_in"), link("city", 6, "born"), F.lit("year_of_birth"), year))
        .otherwise(F.create_map(F.lit("author"), link("person", 10, "author"), F.lit("published_in"), year))
    )
    return e.select("seed", F.concat("kind", F.col("i").cast("string")).alias("id"), name.alias("name"), "kind", attrs.alias("attrs"))


def walk(world: DataFrame, start_kind: str, route: list[str]) -> DataFrame:
    """Every chain of ids from an entity of ``start_kind`` along the attributes of ``route``, without visiting one twice."""
    at = world.filter(F.col("kind") == start_kind).select("seed", F.array("id").alias("chain"), "attrs")
    for step in route:
        nxt = world.select("seed", F.col("id").alias("_to"), F.col("attrs").alias("_attrs"))
        at = at.withColumn("_to", F.col("attrs")[step]).drop("attrs").join(nxt, ["seed", "_to"]).filter(~F.array_contains("chain", F.col("_to")))
        at = at.select("seed", F.concat("chain", F.array("_to")).alias("chain"), F.col("_attrs").alias("attrs"))
    return at.select("seed", "chain")
