"""Band ratios and quality bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps the ratios below from dividing by zero, a fixed value.
EPS = 1e-8
#: Scene classes that are kept, and cloud bits of the two sensors, fixed values.
CLEAR_CLASSES = (4, 5, 6, 7)
CLOUD_BITS = (10, 11)
OTHER_CLOUD_BITS = (1, 3, 4)


def ratio(a: Column, b: Column, eps: float = 0.0) -> Column:
    return F.try_divide(a - b, a + b + eps)


def ndvi(nir: Column, red: Column, eps: float = EPS) -> Column:
    return ratio(nir, red, eps)


def nbr(nir: Column, swir2: Column, eps: float = EPS) -> Column:
    return ratio(nir, swir2, eps)


def ndwi(green: Column, nir: Column, eps: float = EPS) -> Column:
    return ratio(green, nir, eps)


def ndmi(nir: Column, swir1: Column) -> Column:
    return ratio(nir, swir1)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return F.try_divide(F.lit(2.5) * (nir - red), nir + red * 6.0 - blue * 7.5 + 1.0)


def savi(nir: Column, red: Column) -> Column:
    return F.try_divide(F.lit(1.5) * (nir - red), nir + red + 0.5)


def bits_clear(flags: Column, bits: tuple[int, ...] = CLOUD_BITS) -> Column:
    return flags.bitwiseAND(F.lit(sum(1 << b for b in bits))) == 0


def scl_keep(scene_class: Column) -> Column:
    return scene_class.isin(*CLEAR_CLASSES)


def scale_reflectance(value: Column, patch_max: Column) -> Column:
    """To 0..1 if the patch holds raw numbers (maximum over 2); missing becomes 0."""
    scaled = F.least(F.greatest(value, F.lit(0.0)), F.lit(10000.0)) / 10000.0
    return F.coalesce(F.when(patch_max > 2, scaled).otherwise(value), F.lit(0.0))
