"""Column functions: rectangles, orientation, bits, space-filling curves."""

from .bits import bit_matrix_apply, get_bits, packed, parity
from .curves import hilbert
from .rectangles import area, ccw, cw, extended_area, height, intersects, overlap_area, width, x_overlaps, y_overlaps

__all__ = ["area", "bit_matrix_apply", "ccw", "cw", "extended_area", "get_bits", "height", "hilbert", "intersects", "overlap_area", "packed", "parity", "width", "x_overlaps", "y_overlaps"]
