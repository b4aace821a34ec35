"""decoded pictures as model inputs.  Decoding is left to the caller; what is here is numpy."""

from __future__ import annotations

import math

import numpy as np

#: Input sizes, means and deviations of the models.
COARSE = (224, (0.5, 0.5, 0.5), (0.5, 0.5, 0.5))
DOCUMENT = (224, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
KINDS_SIZE = 320


def _weights(before: int, after: int) -> np.ndarray:
    """Rows of a triangle filter that is as wide as a step of the coarser grid."""
    scale = before / after
    width = max(scale, 1.0)
    centre = (np.arange(after) + 0.5) * scale - 0.5
    distance = np.abs(np.arange(before)[None, :] - centre[:, None]) / width
    rows = np.maximum(1 - distance, 0)
    return rows / rows.sum(axis=1, keepdims=True)


def resized(rgb: np.ndarray, size: int) -> np.ndarray:
    """(size, size, 3) bytes of an (h, w, 3) picture, bilinear, averaging where it shrinks."""
    h, w = rgb.shape[:2]
    out = np.einsum("ih,hwc->iwc", _weights(h, size), rgb.astype(np.float64))
    out = np.einsum("jw,iwc->ijc", _weights(w, size), np.floor(out + 0.5))
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def tensor(rgb: np.ndarray, size: int, mean, std) -> np.ndarray:
    """(3, size, size) of normalised channels."""
    x = resized(rgb, size).astype(np.float32) / 255.0
    return ((x - np.array(mean, np.float32)) / np.array(std, np.float32)).transpose(2, 0, 1)


def ensemble_inputs(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inputs of the two document models: channels first, and rows of pixels from 0 to 1."""
    return tensor(rgb, *DOCUMENT), resized(rgb, KINDS_SIZE).astype(np.float32) / 255.0


def pixels(raw: bytes, width: int) -> np.ndarray:
    """An (h, w, 3) picture from its raw bytes, row by row."""
    return np.frombuffer(raw, np.uint8).reshape(math.ceil(len(raw) / (3 * width)), width, 3)
