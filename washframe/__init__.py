"""washframe: data-quality and preparation operators for Spark DataFrames.

Operators are DataFrame -> DataFrame functions; those that depend on the data
fit small statistics in bounded aggregations and apply them as projections.
"""

from washframe.operators.charts import (bar_data, box_data, box_outliers, create_plot, group_mean_topn,
                                        heatmap_data, histogram_data, kde_data, line_data, pair_data,
                                        pair_diagonal, scatter_data, violin_data)
from washframe.operators.coerce import (clean_number_text, coerce_datetime, coerce_numeric,
                                        detect_and_convert, detect_types, parse_dates)
from washframe.operators.columns import (drop_empty_columns, drop_high_null_columns,
                                         remove_constant_columns, require_columns, select_by_type,
                                         standardize_columns)
from washframe.operators.dedup import drop_duplicates, duplicate_count
from washframe.operators.missing import (drop_null_rows, fill_bfill, fill_constant, fill_ffill, fill_mean,
                                         fill_median, fill_missing, fill_mode, null_counts, replace_na_tokens)
from washframe.operators.outliers import cap_iqr, cap_zscore, outliers_to_median
from washframe.operators.profile import (column_summary, correlation_matrix, data_summary, describe,
                                         describe_text, table_summary)
from washframe.operators.quantiles import column_quantiles, exact_quantiles
from washframe.operators.strings import clean_strings, strip_whitespace
from washframe.operators.transforms import (apply_transformation, log_transform, min_max_scale, normalize,
                                            sqrt_transform, standardize)
from washframe.plans.cleaning import CleaningOptions, CleaningResult, clean_data
from washframe.sources.files import file_manifest, preview, read_csv, write_csv
from washframe.streaming.fitted import StreamCleaner, dedup_stream

__all__ = [name for name in dir() if not name.startswith("_")]
