"""Functions of columns."""

from .geometry import register, shp_to_wkb, wkb_to_shp

__all__ = ["register", "shp_to_wkb", "wkb_to_shp"]
