"""A dataframe engine on Spark: lazy frames over text tables, and operators for large data pipelines."""

from .errors import OperationError, TypeNameError
from .frame import Frame, check_data, disable_debug, enable_debug
from .operators.bind import cbind, cbind_csv, rbind, rbind_csv
from .operators.joins import JoinedFrame, inner_join, left_join, outer_join, right_join, rolling_join_backward, rolling_join_forward
from .operators.reshape import dcast, melt
from .sources.files import Source, dataframe, size_in_bytes

__all__ = [
    "Frame", "JoinedFrame", "OperationError", "Source", "TypeNameError", "cbind", "cbind_csv", "check_data", "dataframe", "dcast", "disable_debug", "enable_debug", "inner_join",
    "left_join", "melt", "outer_join", "rbind", "rbind_csv", "right_join", "rolling_join_backward", "rolling_join_forward", "size_in_bytes",
]
