"""Tile encoders as a plug-in for Arrow batches.

An encoder is a callable ``[b, h, w, c] -> [b, d]``; it is created once per Python worker from a name or a dotted class
path, so a model can be loaded there. Filter tiles before encoding: Catalyst does not push filters through Python.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


# Channel means and standard deviations of the common input normalisations.
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
HALF_MEAN, HALF_STD = (0.5, 0.5, 0.5), (0.5, 0.5, 0.5)


class Normaliser:
    """Intensity normalisation of 8-bit patches and its inverse: '01', '-11', 'imagenet', 'half', or None."""

    def __init__(self, name: str | None):
        self.name = name
        stats = {"imagenet": (IMAGENET_MEAN, IMAGENET_STD), "half": (HALF_MEAN, HALF_STD)}.get(name or "")
        if stats is None and name not in (None, "01", "-11"):
            raise ValueError(f"unknown normalisation {name}")
        self.mean, self.std = (np.asarray(s, np.float32) for s in stats) if stats else (None, None)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.name is None:
            return x.astype(np.float32)
        x = x.astype(np.float64) / 255.0
        if self.name == "-11":
            x = x * 2 - 1
        elif self.mean is not None:
            x = (x.astype(np.float32) - self.mean) / self.std
        return x.astype(np.float32)

    def reverse(self, x: np.ndarray) -> np.ndarray:
        if self.name is None:
            return x
        x = x.astype(np.float64)
        if self.name == "-11":
            x = (x + 1) / 2
        elif self.mean is not None:
            x = x * self.std + self.mean
        return np.clip(x * 255 + 0.5, 0, 255).astype(np.uint8)


class ConstantEncoder:
    """One constant feature per tile, for trying a job without a model."""

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.ones((len(x), 1), np.float32)


class BandStatistics:
    """Mean, standard deviation, minimum and maximum of each channel, then a histogram over all channels."""

    def __init__(self, bins: int = 8, low: float = 0.0, high: float = 1.0):
        self.edges = np.linspace(low, high, bins + 1)[1:-1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        flat = x.reshape(len(x), -1, x.shape[-1])
        stats = [flat.mean(1), flat.std(1), flat.min(1), flat.max(1)]
        place = np.searchsorted(self.edges, x.reshape(len(x), -1), side="right")
        hist = np.stack([(place == b).mean(1) for b in range(len(self.edges) + 1)], axis=1)
        return np.concatenate([*stats, hist], axis=1).astype(np.float32)


class RandomProjection:
    """A fixed Gaussian projection of the flattened tile; the same seed gives the same encoder on every worker."""

    def __init__(self, size: int = 16, seed: int = 1):
        self.size, self.seed, self.matrix = size, seed, None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        flat = x.reshape(len(x), -1)
        if self.matrix is None:
            self.matrix = np.random.default_rng(self.seed).standard_normal((flat.shape[1], self.size)) / np.sqrt(flat.shape[1])
        return (flat @ self.matrix).astype(np.float32)


ENCODERS: dict[str, type] = {"constant": ConstantEncoder, "bands": BandStatistics, "projection": RandomProjection}


def create_encoder(name: str, **options) -> Callable[[np.ndarray], np.ndarray]:
    """By short name or dotted class path."""
    if name in ENCODERS:
        return ENCODERS[name](**options)
    module, _, cls = name.rpartition(".")
    if not module:
        raise ValueError(f"unknown encoder {name}")
    return getattr(importlib.import_module(module), cls)(**options)


def eight_views(x: np.ndarray) -> Iterator[np.ndarray]:
    """The eight flips and quarter turns of square tiles."""
    for turns in range(4):
        r = np.rot90(x, turns, axes=(1, 2))
        yield r
        yield r[:, ::-1]


def augmented(encoder: Callable, augment: str | None) -> Callable[[np.ndarray], np.ndarray]:
    """Test-time augmentation: 'rot8m' is the mean encoding over the eight views."""
    if augment is None:
        return encoder
    if augment != "rot8m":
        raise ValueError(f"unknown augmentation {augment}")
    return lambda x: np.mean([encoder(np.ascontiguousarray(v)) for v in eight_views(x)], axis=0)


def encode_tiles(tiles: DataFrame, encoder: str, shape: tuple[int, int, int], pixels: str = "pixels", batch_size: int = 512,
                 normalise: str | None = None, augment: str | None = None, out: str = "feat", **options) -> DataFrame:
    """Replace the flat pixel array by its encoding. Tiles go through the encoder ``batch_size`` at a time."""
    keep = [f for f in tiles.schema.fields if f.name != pixels]
    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = augmented(create_encoder(encoder, **options), augment)
        norm = Normaliser(normalise)
        for pdf in batches:
            for a in range(0, len(pdf), batch_size):
                part = pdf.iloc[a:a + batch_size]
                x = norm(np.stack(part[pixels].to_numpy()).reshape(len(part), *shape))
                code = np.asarray(encode(x), np.float32)
                if code.ndim != 2:
                    raise ValueError(f"an encoder must return [batch, features], not {code.shape}")
                yield part.drop(columns=[pixels]).assign(**{out: list(code)})

    return tiles.mapInPandas(run, schema)
