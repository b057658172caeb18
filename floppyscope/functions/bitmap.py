"""Any bytes seen as pixels, in the layouts of the video memory. Bytes past the end read as 0."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from floppyscope.functions import pictures

#: Layouts: bits of a pixel and pixels of a step, or a tile's kind.
LAYOUTS = {"1bpp": 1, "2bpp": 2, "4bpp": 4, "8bpp": 8, "yjk": 8, "yae": 8, "tiles8": "tile", "sprites16": "sprite"}
PALETTES = {"first": np.array(pictures.FIRST_CHIP), "second": pictures.palette(pictures.DEFAULT), "four": np.array(pictures.FOUR), "grb332": pictures.grb332(), "grey": np.arange(256) * 0x010101, "mono": np.array([0, 0xFFFFFF])}


@dataclass(frozen=True)
class View:
    layout: str = "1bpp"
    palette: str = "mono"
    offset: int = 0
    width: int = 256
    height: int = 192

    @property
    def step(self) -> int:
        bits = LAYOUTS[self.layout]
        return {"tile": 8, "sprite": 16}.get(bits) or (4 if self.layout in ("yjk", "yae") else max(1, 8 // bits))


def height_for(view: View, available: int, most: int) -> int:
    """Rows that ``available`` bytes give, ``most`` at most."""
    width = max(view.step, view.width // view.step * view.step)
    bits = LAYOUTS[view.layout]
    if bits in ("tile", "sprite"):
        side = 8 if bits == "tile" else 16
        tiles = -(-available // (side * side // 8))
        return min(most, -(-tiles // (width // side)) * side)
    return min(most, -(-available // max(1, width * bits // 8)))


def render(data: bytes, view: View) -> np.ndarray:
    """The pixels of a view; its width is rounded down to whole steps."""
    width = max(view.step, view.width // view.step * view.step)
    bits, colours = LAYOUTS[view.layout], PALETTES[view.palette]
    if bits in ("tile", "sprite"):
        side = 8 if bits == "tile" else 16
        rows, across = -(-view.height // side), width // side
        size = side * side // 8
        raw = pictures._bytes(data, view.offset, rows * across, size)
        pixels = pictures._parts(raw, 1).reshape(rows, across, side * side)
        if side == 8:
            image = pixels.reshape(rows, across, 8, 8)
        else:  # the left half stands before the right
            image = pixels.reshape(rows, across, 2, 16, 8).transpose(0, 1, 3, 2, 4).reshape(rows, across, 16, 16)
        image = image.transpose(0, 2, 1, 3).reshape(rows * side, width)[: view.height]
        return colours[image * (len(colours) - 1)]
    raw = pictures._bytes(data, view.offset, view.height, width * bits // 8)
    if view.layout in ("yjk", "yae"):
        return pictures.yjk(raw, PALETTES["second"] if view.layout == "yae" else None)
    values = pictures._parts(raw, bits)
    return colours[values % len(colours)]
