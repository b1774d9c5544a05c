from tally.functions.stats import (  # noqa: F401
    equal_width_bin,
    finalize,
    masked_pearson,
    numeric_columns,
    running_sums,
    rsig,
    rsig_sql,
)
