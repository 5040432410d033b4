"""Store, load and sample join results; S4: GeoJSON export.

Results are nested Parquet (one row per left row, ``neighbours`` array), any
Hadoop file system path.  Writing keeps the job's own partitioning; a single
output file (``coalesce(1)``) is an opt-in for small results only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import shared_dir


def write_results(result: DataFrame, path: str, mode: str = "error", single_file: bool = False) -> str:
    out = result.coalesce(1) if single_file else result
    out.write.mode(mode).parquet(path)
    return path


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def store_and_reload(result: DataFrame, name: str = "knn-results") -> DataFrame:
    """Write to a fresh folder under the session's shared checkpoint folder and
    read it back (cuts the lineage like a checkpoint, keeps a copy)."""
    spark = result.sparkSession
    return read_results(spark, write_results(result, shared_dir(spark, name)))


def sample_results(results: DataFrame, n: int = 10, seed: int | None = None, id_col: str = "l_id") -> DataFrame:
    """N result rows picked at random without replacement.  With a seed
    the pick is repeatable (rows ranked by the MD5 of id and seed); each task
    keeps only its best n (TakeOrderedAndProject), so nothing big moves."""
    key = F.rand() if seed is None else F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return results.orderBy(key).limit(n)


def _feature(geometry_json) -> F.Column:
    return F.concat(F.lit('{"type": "Feature", "geometry": '), geometry_json, F.lit(', "properties": {}}'))


def geojson_collections(nested: DataFrame, left_has_geom: bool = False, right_has_geom: bool = False,
                        id_col: str = "l_id") -> DataFrame:
    """Per result row, a FeatureCollection string: the query geometry
    first, then each neighbour geometry in rank order (no properties).
    Columns: ``id_col, geojson``."""
    left = G.Side("l_", left_has_geom)
    nb = F.transform(F.col("neighbours"), lambda s: _feature(_nb_geometry(s, right_has_geom)))
    feats = F.concat(F.array(_feature(G.geojson_geometry(left))), nb)
    text = F.concat(F.lit('{"type": "FeatureCollection", "features": ['),
                    F.array_join(feats, ", "), F.lit("]}"))
    return nested.select(F.col(id_col), text.alias("geojson"))


def _nb_geometry(s, has_geom: bool):
    return G.geojson_geometry(G.Side.of_struct(s, has_geom))


def write_geojson(collections: DataFrame, path: str, mode: str = "error") -> None:
    collections.select("geojson").write.mode(mode).text(path)
