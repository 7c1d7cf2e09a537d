"""Listing, market-data and segmentation operators as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the Python workers themselves, so that executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tidemark.functions.calendar import month_starts, parse_date, parse_time, seconds_between, stepped
from tidemark.functions.events import (
    decode_price_change, decode_price_guide, encode_events, price_change_text, price_guide_text,
)
from tidemark.functions.numeric import floor_mod, fraction, half_even, l1
from tidemark.functions.text import (
    archive_path, drop_last, first_digits, first_match, item_id, leading, page_count, path_segment, result_count,
    seller, slug_address, split_field, strip_price, thousands,
)
from tidemark.operators.aggregate import (
    concat_distinct, corr_matrix, distinct_count, distinct_per_group, exact_quartiles, group_means, group_stats, margins, profile,
    quartiles, scoreboard, shape, time_stats, top_rows,
)
from tidemark.operators.clean import (
    bin_values, case_when, cast_columns, derive, drop_columns, drop_constant, drop_low_variance, drop_missing,
    fill_missing, keyword_grade, lower_names, map_values, pick, variances, where_conditions, with_constant,
)
from tidemark.operators.compare import (
    append_history, common_values, frame_diffs, frames_equal, keyed_zip, union_by_name,
)
from tidemark.operators.distance import nearest_l1, pairwise_l1
from tidemark.operators.expand import explode_list, explode_range, offset_plan, page_url_plan, year_months
from tidemark.operators.facets import cascade_options, facet_filter, facet_options
from tidemark.operators.pages import (
    Selector, all_text, first_text, json_or, jsonld_items, listing_cards, page_fields, page_links, page_links_by,
    price_history, property_details, script_call, script_value, sibling_text,
)
from tidemark.operators.page_functions import register_page_functions
from tidemark.operators.rounding import (
    controlled_round, controlled_round_1col, feasible_round_1col, rounding_audit,
)
from tidemark.operators.semi_filter import bloom_candidates, bloom_semi_join
from tidemark.operators.user_aggregate import UserAggregate, aggregate_by, distinct_texts, skewness
from tidemark.operators.windows import early_stop, head_tail, last_of, numbered, running_total
from tidemark.plans.features import (
    binned_mutual_info, f_scores, lasso, permutation_importance, rfe, tree_importance, vif,
)
from tidemark.plans.listings import listing_details, listing_items, listing_report, listing_table, rent_report
from tidemark.plans.rfm import cluster_profile, kmeans_predict, kmeans_sweep, rfm, scaled_columns, standardize
from tidemark.session import build_session, scratch_path, shared_dir, spread, stored
from tidemark.sources.archives import read_archive_tables, register_archives, scan_archives
from tidemark.sources.files import (
    dated_path, file_inventory, frame_from_rows, read_lines, scan_csv, scan_csv_range, scan_parquet, size_mb, sql_over,
    write_csv, write_parquet,
)
from tidemark.sources.sections import (
    read_sections, read_zip_lines, read_zip_tables, section_ranges, tag_sections, unzip_lines,
)
from tidemark.sources.synth import random_columns, random_table
from tidemark.streaming.history import read_distinct_history, read_history, stream_distinct_history, stream_history

__all__ = sorted(n for n, v in dict(globals()).items() if not n.startswith("_") and callable(v))
