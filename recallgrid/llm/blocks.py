"""The library's meeting of dealt rows, as the operators of this subpackage use it."""

from recallgrid.operators.meeting import Columns, dense, labels, matrix, meet, packed

__all__ = ["Columns", "dense", "labels", "matrix", "meet", "packed"]
