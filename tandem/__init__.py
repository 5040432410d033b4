"""tandem: spatio-temporal kNN and companion operators on Spark DataFrames.

Main entry points (see README.md):

    st_knn_join        k nearest S rows per R row within a time tolerance (J1)
    st_distance_join   all pairs within a distance and time tolerance (J3)
    st_knn_query       k nearest rows to one query point (J4)
    interval_overlap_join, cell_summary_join, assign_to_tiles   (J5-J7)
    read_wkt_tsv, write_results, read_results, geojson_collections, sample_results
"""

from .operators.joins import assign_to_tiles, cell_summary_join, interval_overlap_join
from .operators.knn import knn_bound, st_distance_join, st_knn_join, st_knn_query
from .sources.results import geojson_collections, read_results, sample_results, write_results
from .sources.tsv import read_wkt_tsv

__all__ = [
    "st_knn_join", "st_distance_join", "st_knn_query", "knn_bound",
    "interval_overlap_join", "cell_summary_join", "assign_to_tiles",
    "read_wkt_tsv", "write_results", "read_results", "geojson_collections", "sample_results",
]
