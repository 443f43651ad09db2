"""Learned image extractors from local weights, and the identity of weights.

No weights are downloaded, and torch is only imported where a model is run. A model can also be given as a function from an
NCHW float32 array to an array of embeddings.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from provena.errors import BackendUnavailable, IncompatibleWeights, WeightsNotFound
from provena.sources.features import BatchInfo, Extractor, FeatureBatch, extract_with_fallback
from provena.sources.images import CROP, DEVIATION, MEAN, SHORT, center_crop_tensor

Forward = Callable[[np.ndarray], np.ndarray]
BATCH = 16
DEVICES = ("auto", "cpu", "cuda")

# What a checkpoint's configuration must say, and dimensions.
DINO_CONFIG = {"model_type": "dinov2", "hidden_size": 384, "patch_size": 14}
DIMS = {"dinov2": 384, "resnet50": 2048}
WEIGHT_SUFFIXES = (".safetensors", ".bin")
INDEX_SUFFIXES = (".safetensors.index.json", ".bin.index.json")


def preprocessing_metadata() -> dict:
    """What is done to pixels before a model sees them, as recorded in a batch."""
    return {
        "loader": "rgb-exif-transpose",
        "resize": {"shortest_edge": SHORT, "resample": "bicubic"},
        "center_crop": {"height": CROP, "width": CROP, "rounding": "nearest-even"},
        "color": "RGB",
        "scale": "uint8-div-255",
        "normalization_mean": list(MEAN),
        "normalization_std": list(DEVIATION),
        "layout": "NCHW",
        "interpolation_implementation": "provena-antialiased",
        "augmentation": "none",
    }


def _hash_files(paths: list[str], with_names: bool) -> str:
    digest = hashlib.sha256()
    for path in paths:
        if with_names:
            digest.update(os.path.basename(path).encode())
        try:
            with open(path, "rb") as f:
                while chunk := f.read(1 << 20):
                    digest.update(chunk)
        except OSError as e:
            raise WeightsNotFound(f"cannot read {path}") from e
    return "sha256:" + digest.hexdigest()


def check_config(config: object) -> None:
    """A configuration, as a mapping or an object, that is that of the small model with patches of 14."""
    if config is None:
        raise IncompatibleWeights("the model has no configuration")
    found = {k: config.get(k) if isinstance(config, dict) else getattr(config, k, None) for k in DINO_CONFIG}
    if found != DINO_CONFIG:
        raise IncompatibleWeights(f"expected {DINO_CONFIG}, got {found}")


def folder_identity(path: str) -> str:
    """Identity of a checkpoint folder: its configuration and weight files, by name and bytes."""
    if not os.path.isdir(path):
        raise WeightsNotFound(f"no folder {path}")
    config = os.path.join(path, "config.json")
    if not os.path.isfile(config):
        raise WeightsNotFound(f"no config.json in {path}")
    names = sorted(n for n in os.listdir(path) if n.endswith(WEIGHT_SUFFIXES + INDEX_SUFFIXES) and os.path.isfile(os.path.join(path, n)))
    if not any(n.endswith(WEIGHT_SUFFIXES) for n in names):
        raise WeightsNotFound(f"no weights in {path}")
    try:
        with open(config, encoding="utf-8") as f:
            told = json.load(f)
    except (OSError, ValueError) as e:
        raise IncompatibleWeights(f"cannot read {config}") from e
    if not isinstance(told, dict):
        raise IncompatibleWeights("config.json is no JSON object")
    check_config(told)
    return _hash_files([config, *(os.path.join(path, n) for n in names)], True)


def file_identity(path: str) -> str:
    """Identity of a checkpoint of one file: its bytes."""
    if not os.path.isfile(path):
        raise WeightsNotFound(f"no file {path}")
    return _hash_files([path], False)


def resolve_device(wanted: str, cuda: bool | None) -> str:
    """``cuda``: whether it can be used; None where torch is missing."""
    if wanted not in DEVICES:
        raise BackendUnavailable(f"device is one of {', '.join(DEVICES)}")
    if wanted == "cuda" and not cuda:
        raise BackendUnavailable("cuda is asked for but cannot be used")
    return "cuda" if cuda and wanted != "cpu" else "cpu"


def _torch():
    try:
        import torch
    except (ImportError, OSError) as e:
        raise BackendUnavailable("torch is not installed here") from e
    return torch


def load_transformer(path: str, device: str) -> Forward:
    """Embedding of the class token by a local checkpoint folder; nothing is fetched, no remote code is run."""
    torch = _torch()
    try:
        from transformers import AutoConfig, AutoModel
    except ImportError as e:
        raise BackendUnavailable("transformers is not installed here") from e
    try:
        config = AutoConfig.from_pretrained(path, local_files_only=True, trust_remote_code=False)
        check_config(config)
        model = AutoModel.from_pretrained(path, config=config, local_files_only=True, trust_remote_code=False)
    except (OSError, ValueError, RuntimeError) as e:
        raise IncompatibleWeights(f"cannot load {path}") from e
    where = resolve_device(device, torch.cuda.is_available())
    model = model.to(where).eval()

    def forward(pixels: np.ndarray) -> np.ndarray:
        with torch.inference_mode():
            return model(pixel_values=torch.from_numpy(pixels).to(where)).last_hidden_state[:, 0].float().cpu().numpy()

    return forward


def load_residual(path: str, device: str) -> Forward:
    """Pooled features before the last layer by a local state file; only tensors are unpickled, every key must fit."""
    torch = _torch()
    try:
        from torchvision import models
    except ImportError as e:
        raise BackendUnavailable("torchvision is not installed here") from e
    try:
        state = torch.load(path, map_location="cpu", weights_only=True)
        state = state.get("state_dict", state)
        model = models.resnet50(weights=None)
        model.load_state_dict({k.removeprefix("module."): v for k, v in state.items()}, strict=True)
        model.fc = torch.nn.Identity()
    except (OSError, RuntimeError, ValueError, TypeError, AttributeError) as e:
        raise IncompatibleWeights(f"cannot load {path}") from e
    where = resolve_device(device, torch.cuda.is_available())
    model = model.to(where).eval()

    def forward(pixels: np.ndarray) -> np.ndarray:
        with torch.inference_mode():
            return model(torch.from_numpy(pixels).to(where)).float().cpu().numpy()

    return forward


@dataclass
class LocalModel:
    """An extractor over RGB arrays. The model is loaded once a worker, on its first batch, and is never pickled."""

    load: Callable[[], Forward]
    dim: int
    _forward: Forward | None = field(default=None, repr=False)

    def __call__(self, images: list[np.ndarray]) -> np.ndarray:
        if self._forward is None:
            self._forward = self.load()
        out = np.asarray(self._forward(np.stack([center_crop_tensor(x) for x in images])), np.float32)
        if out.shape != (len(images), self.dim):
            raise ValueError(f"the model gave {out.shape}, not {(len(images), self.dim)}")
        return out

    def __getstate__(self) -> dict:
        return {"load": self.load, "dim": self.dim, "_forward": None}


def _info(name: str, backend: str, model_id: str, identity: str, device: str) -> BatchInfo:
    return BatchInfo(name, backend, model_id, identity, DIMS[backend], preprocessing_metadata(), {"method": "none"}, device=device)


def transformer_extractor(dataset_name: str, path: str, device: str = "auto", forward: Forward | None = None) -> tuple[BatchInfo, Extractor]:
    """The 384-dimensional extractor. ``forward`` stands in for the loaded model."""
    info = _info(dataset_name, "dinov2", "dinov2-vits14", folder_identity(path), device)
    return info, LocalModel((lambda: forward) if forward else (lambda: load_transformer(path, device)), info.embedding_dim)


def residual_extractor(dataset_name: str, path: str, device: str = "auto", forward: Forward | None = None) -> tuple[BatchInfo, Extractor]:
    """The 2048-dimensional extractor. ``forward`` stands in for the loaded model."""
    info = _info(dataset_name, "resnet50", "resnet50", file_identity(path), device)
    return info, LocalModel((lambda: forward) if forward else (lambda: load_residual(path, device)), info.embedding_dim)


def extract_features(
    images, dataset_name: str, transformer_path: str, residual_path: str, device: str = "auto", allow_fallback: bool = False,
    forwards: tuple[Forward | None, Forward | None] = (None, None),
) -> FeatureBatch:
    """Both extractors by their weight paths: the second takes the whole run over if the first fails and this is allowed."""
    primary = transformer_extractor(dataset_name, transformer_path, device, forwards[0])
    fallback = residual_extractor(dataset_name, residual_path, device, forwards[1]) if allow_fallback else None
    return extract_with_fallback(images, primary, fallback)
