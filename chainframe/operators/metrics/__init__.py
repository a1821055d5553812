"""Time-series metric functions over long sample frames
(``name, labels MAP<STRING,STRING>, series_key, ts, value``) on a fixed evaluation grid."""

from chainframe.operators.metrics.ranges import (  # noqa: F401
    Grid, avg_over_time, changes, deriv, increase, instant, irate, max_over_time, min_over_time,
    predict_linear, rate, select,
)
from chainframe.operators.metrics.vector import (  # noqa: F401
    absent, aggregate, binary_op, compare, count_values, label_replace, record, vector_and, vector_or,
)
