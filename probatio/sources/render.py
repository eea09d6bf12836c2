"""Pages as images and symbols in images, where the libraries for it are installed on the executors.

Nothing else in the package needs these libraries: a function that does raises a plain error when it is called
without them. Rasterisers and decoders are ordinary functions, so others can be handed in.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

import numpy as np

#: A decoder takes gray levels and returns the payloads of the symbols in them.
Decoder = Callable[[np.ndarray], list[str]]
#: A rasteriser takes a file, a page from 0 and dots per inch, and returns gray levels, or None beyond the last page.
Rasteriser = Callable[[bytes, int, int], "np.ndarray | None"]
#: Milliseconds after which the decoder of two-dimensional codes gives up.
TIMEOUT = 1500


def _library(name: str):
    try:
        return importlib.import_module(name)
    except ImportError as missing:
        raise RuntimeError(f"{name} is not installed on this machine") from missing


def rasterise(data: bytes, page: int, dpi: int) -> np.ndarray | None:
    """A page drawn by MuPDF."""
    fitz = _library("fitz")
    with fitz.open(stream=data, filetype="pdf") as document:
        if page >= len(document):
            return None
        drawn = document[page].get_pixmap(dpi=dpi, colorspace=fitz.csGRAY)
        return np.frombuffer(drawn.samples, np.uint8).reshape(drawn.height, drawn.stride)[:, : drawn.width]


def decode_symbols(image: np.ndarray) -> list[str]:
    """QR codes and bar codes."""
    return [found.data.decode("utf-8", "replace") for found in _library("pyzbar.pyzbar").decode(image)]


def decode_matrix(image: np.ndarray) -> list[str]:
    """Data matrix codes, one byte a character."""
    return [found.data.decode("latin-1") for found in _library("pylibdmtx.pylibdmtx").decode(image, timeout=TIMEOUT, max_count=1)]
