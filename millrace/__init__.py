"""millrace: preparing and exploring tables with Spark.

Everything is a function from DataFrame to DataFrame. See the README for the contract on missing
values, row order and types.
"""

from millrace.functions.predicates import (
    Condition, all_of, any_of, between, chain, cmp, contains, ends_with, formula, is_false, is_missing,
    is_present, is_true, isin, not_in, predicates_for, starts_with,
)
from millrace.operators.binning import bin_custom, bin_equal, bin_quantile, bin_width
from millrace.operators.columns import (
    capitalize, cast_column, cast_columns, date_attribute, length, lower, replace_text, slice_text, split_text,
    strip, title, upper,
)
from millrace.operators.encode import label_encode, one_hot
from millrace.operators.grouping import group_agg
from millrace.operators.joins import common_keys, join
from millrace.operators.missing import drop_missing_columns, drop_missing_rows, fill_missing
from millrace.operators.pivot import explode_rows, melt, pivot_table, pivot_wide
from millrace.operators.project import (
    clean_column_names, copy_column, drop_columns, move_columns, normalize_names, rename, select_columns,
    with_formula, with_udf,
)
from millrace.operators.quantiles import quantiles
from millrace.operators.resample import resample
from millrace.operators.rows import (
    filter_report, filter_rows, first_rows, keep_in, keep_top_values, page, repeat_rows, sample_rows, sort_rows,
    top_values,
)
from millrace.operators.sets import concat_columns, concat_rows, drop_duplicates
from millrace.operators.states import column_states, merge_states, state_facts
from millrace.operators.values import replace_value, set_values
from millrace.operators.windows import cumulative_product, cumulative_sum, pct_change
from millrace.selectors import all_columns, cols, containing, ending_with, matching, of_type, starting_with
from millrace.session import local_session, pin
from millrace.sources.readers import (
    list_catalogs, list_databases, list_tables, load, read_csv, read_parquet, read_table, register_source,
)
from millrace.sources.ranged import parquet_ranges, ranged_source, read_parquet_range
from millrace.sources.sinks import register, write_csv, write_table

__all__ = [name for name in dir() if not name.startswith("_")]
