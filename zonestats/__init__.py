"""zonestats: descriptive analytics over star-schema service tables, on Spark.

Every operator takes DataFrames and column names and returns a lazy
DataFrame; see README.md for the catalogue and the scale notes.
"""

from zonestats.operators.clean import (
    distinct_first,
    distinct_rows,
    drop_columns,
    dropna_any,
    filter_eq,
    float_to_int,
    nan_to_null_all,
    null_rows,
    parse_timestamp,
    recode,
    rename_columns,
    select_columns,
    semi_filter,
    strict_int_cast,
    unpivot_pair,
    with_complement,
    with_day_name,
)
from zonestats.operators.cluster import (
    classify,
    cluster_input,
    cluster_summary,
    elbow,
    kmeans_labels,
    label_members,
    pca2,
    standardize,
)
from zonestats.operators.dims import (
    add_serial,
    append_rows,
    apply_overrides,
    dim_build,
    dim_encode,
    fact_build,
)
from zonestats.operators.dist import frequency_table, kde
from zonestats.operators.geo import map_aggregate, map_centre, map_measures, map_view_point
from zonestats.operators.joins import join_null_safe, left_join_keys
from zonestats.operators.lookup import (
    child_options,
    lookup_id,
    lookup_id_sql,
    lookup_ids,
    time_series,
    time_series_mean,
)
from zonestats.operators.order_stats import exact_median, exact_quantiles
from zonestats.operators.quality import (
    audit_keys,
    has_values,
    missing_keys,
    profile_columns,
    table_shape,
)
from zonestats.operators.rank import head_n, rank_by, rank_levels, share_of_total, tail_n, top_k
from zonestats.operators.stats import (
    box_stats,
    centre_stats,
    mode_all,
    position_stats,
    shape_stats,
    spread_stats,
)
from zonestats.plans.star import REFERENCE_LABELS, SHORT_LABELS, ViewLabels, star_view

__version__ = "0.1.0"

__all__ = [name for name in dir() if not name.startswith("_")]
