"""Sources and sinks of flows."""

from .readers import from_items, parquet, points_text, random_points, rectangles_text, scan_ints, serialized, text_lines, zero
from .readers import integer_range as range_source
from .writers import foreach, noop, output, print_ints, to_iterator, to_vector, write_sorted

__all__ = ["foreach", "from_items", "noop", "output", "parquet", "points_text", "print_ints", "random_points", "range_source", "rectangles_text", "scan_ints", "serialized", "text_lines", "to_iterator", "to_vector", "write_sorted", "zero"]
