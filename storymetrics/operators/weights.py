"""A small picture model whose weights come from a file: loaded once in each Python process, its version in the output."""

from __future__ import annotations

import io
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..sources.archives import opened

#: What a file of weights (NPZ) holds: kernels (k, k, 3, n) with their biases, and a logistic layer over their mean responses.
ARRAYS = ("kernel", "bias", "dense", "dense_bias", "version")
STRIDE = 4
_loaded: dict[str, dict[str, np.ndarray]] = {}


def loads() -> int:
    """How many files of weights this process has loaded."""
    return len(_loaded)


def save(path: str, kernel: np.ndarray, bias: np.ndarray, dense: np.ndarray, dense_bias: float, version: str) -> None:
    """Writes a file of weights to any store that Arrow knows."""
    from pyarrow import fs

    held = io.BytesIO()
    np.savez(held, kernel=kernel, bias=bias, dense=dense, dense_bias=dense_bias, version=version)
    store, name = fs.FileSystem.from_uri(path)
    with store.open_output_stream(name) as out:
        out.write(held.getvalue())


@dataclass(frozen=True)
class Weights:
    """A scorer by the weights in a file. Only the path travels with a task; a path that isn't there gives null scores."""

    path: str
    opener: Callable[[str], pa.NativeFile] = opened

    def model(self) -> dict[str, np.ndarray] | None:
        if self.path not in _loaded:
            try:
                with self.opener(self.path) as file:
                    found = np.load(io.BytesIO(file.read()), allow_pickle=False)
                    _loaded[self.path] = {a: found[a] for a in ARRAYS}
            except FileNotFoundError:  # a missing model is known to the job by its null scores
                return None
        return _loaded[self.path]

    @property
    def version(self) -> str | None:
        held = self.model()
        return None if held is None else str(held["version"])

    def __call__(self, pixels: np.ndarray) -> float | None:
        """The probability of a good picture: one convolution, rectified and averaged, then a logistic layer."""
        held = self.model()
        if held is None:
            return None
        kernel = held["kernel"]
        k, n = kernel.shape[0], kernel.shape[3]
        views = np.lib.stride_tricks.sliding_window_view(pixels, (k, k), axis=(0, 1))[::STRIDE, ::STRIDE]
        seen = np.maximum(views.transpose(0, 1, 3, 4, 2).reshape(-1, k * k * pixels.shape[2]) @ kernel.reshape(-1, n) + held["bias"], 0).mean(axis=0)
        return float(1 / (1 + np.exp(-(seen @ held["dense"] + held["dense_bias"]))))
