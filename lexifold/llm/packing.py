"""Arrays of 64-bit numbers as bytes, for rows that hold many of them."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(tokens: np.ndarray, bits: int) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    out = np.zeros((len(data) * 8 // bits, 8), np.uint8)
    out[:, : bits // 8] = np.frombuffer(data, np.uint8).reshape(-1, bits // 8)
    return out.view("<u8").ravel()


def squeeze(tokens: np.ndarray, width: int) -> bytes:
    """Sorted numbers by byte planes, whose higher ones hardly change."""
    return zstandard.compress(np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def unsqueeze(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()
