"""Boxes and colours as column expressions; boxes are structs or four columns (left, top, right, bottom)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Edges of a rectangle as columns."""

    left: Column
    top: Column
    right: Column
    bottom: Column

    @classmethod
    def of(cls, prefix: str = "box_", alias: str = "") -> Box:
        dot = f"{alias}." if alias else ""
        return cls(*(F.col(f"{dot}{prefix}{e}") for e in ("left", "top", "right", "bottom")))

    @classmethod
    def sized(cls, left: Column, top: Column, width: Column, height: Column) -> Box:
        return cls(left, top, left + width, top + height)

    @property
    def area(self) -> Column:
        return (self.right - self.left) * (self.bottom - self.top)

    @property
    def centre(self) -> tuple[Column, Column]:
        return (self.left + self.right) / 2, (self.top + self.bottom) / 2

    def moved(self, dx: Column | float, dy: Column | float) -> Box:
        return Box(self.left + dx, self.top + dy, self.right + dx, self.bottom + dy)

    def intersection(self, other: Box) -> Column:
        """Area in common; null where the boxes are apart."""
        return F.when(self.intersects(other), self.shared(other))

    def near(self, other: Box, across: float = 100, down: float = 75) -> Column:
        """Whether the gaps between two boxes are at most so wide."""
        gap = lambda a, b, c, d: F.greatest(F.lit(0.0), a - b, c - d)
        return (gap(other.left, self.right, self.left, other.right) <= across) & (gap(other.top, self.bottom, self.top, other.bottom) <= down)

    def shared(self, other: Box) -> Column:
        """Area of the intersection, 0 where the boxes are apart."""
        w = F.least(self.right, other.right) - F.greatest(self.left, other.left)
        h = F.least(self.bottom, other.bottom) - F.greatest(self.top, other.top)
        return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))

    def intersects(self, other: Box, edges: bool = False) -> Column:
        """Whether boxes share an area; with edges, whether they touch at least."""
        if edges:
            return (self.left <= other.right) & (other.left <= self.right) & (self.top <= other.bottom) & (other.top <= self.bottom)
        return (self.left < other.right) & (other.left < self.right) & (self.top < other.bottom) & (other.top < self.bottom)

    def contains(self, other: Box, edges: bool = True) -> Column:
        """Whether the other box lies inside; without edges, strictly."""
        if not edges:
            return (self.left < other.left) & (self.top < other.top) & (self.right > other.right) & (self.bottom > other.bottom)
        return (self.left <= other.left) & (self.top <= other.top) & (self.right >= other.right) & (self.bottom >= other.bottom)

    def iou(self, other: Box) -> Column:
        union = self.area + other.area - self.shared(other)
        return F.when(union > 0, self.shared(other) / union).otherwise(F.lit(0.0))

    def overlap(self, other: Box) -> Column:
        """Intersection over the smaller area; 0 where that is empty."""
        least = F.least(self.area, other.area)
        return F.when(least > 0, self.shared(other) / least).otherwise(F.lit(0.0))


def luminance(red: Column, green: Column, blue: Column) -> Column:
    """Relative luminance of channels in 0 to 1."""
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(red) + 0.7152 * linear(green) + 0.0722 * linear(blue)


def contrast(one: Column, other: Column) -> Column:
    """Contrast ratio of two luminances."""
    return (F.greatest(one, other) + 0.05) / (F.least(one, other) + 0.05)


def hex_colour(red: Column, green: Column, blue: Column, alpha: Column | None = None) -> Column:
    """#RRGGBB, or with an alpha under 1 #RRGGBBAA."""
    two = lambda c: F.lpad(F.hex(F.round(c * 255).cast("int")), 2, "0")
    last = F.lit("") if alpha is None else F.when(alpha < 1, two(alpha)).otherwise("")
    return F.concat(F.lit("#"), two(red), two(green), two(blue), last)
