"""Samples of images: unpacking, Decode arrays, colour, masks and alpha."""

from __future__ import annotations

import numpy as np

from .colors import of_image
from .syntax import Document, PdfError, Stream

MOST = 1 << 28


def unpack(data: bytes, width: int, height: int, n: int, bits: int) -> np.ndarray:
    """height x width x n samples; each row begins at a byte. Data too short is filled with zeros, too long is cut."""
    if bits not in (1, 2, 4, 8, 16) or width < 1 or height < 1 or n < 1 or width * height * n > MOST:
        raise PdfError("image")
    row = (width * n * bits + 7) // 8
    raw = np.frombuffer(data[: row * height].ljust(row * height, b"\0"), dtype=np.uint8).reshape(height, row)
    if bits == 8:
        out = raw[:, : width * n]
    elif bits == 16:
        out = raw.view(">u2")[:, : width * n]
    else:
        ones = np.unpackbits(raw, axis=1)[:, : width * n * bits].reshape(height, width * n, bits)
        out = (ones << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2)
    return out.reshape(height, width, n).astype(np.uint16)


def decoded(samples: np.ndarray, bits: int, decode: list[float]) -> np.ndarray:
    lo, hi = np.array(decode[::2]), np.array(decode[1::2])
    return lo + samples * ((hi - lo) / ((1 << bits) - 1))


def alpha(doc: Document, x: Stream, width: int, height: int) -> np.ndarray | None:
    """Coverage, 0..255, of an image's soft mask, stencil mask or colour key; None if it has none of them."""
    soft, mask = doc.get(x.dict.get("SMask")), doc.get(x.dict.get("Mask"))
    m = soft if isinstance(soft, Stream) else mask if isinstance(mask, Stream) else None
    if m is not None:
        w, h = int(doc.get(m.dict.get("Width"))), int(doc.get(m.dict.get("Height")))
        bits = 1 if m is mask else int(doc.get(m.dict.get("BitsPerComponent", 8)))
        d = [float(doc.get(v)) for v in doc.get(m.dict.get("Decode")) or (0, 1)]
        values = decoded(unpack(doc.decoded(m), w, h, 1, bits)[..., 0][..., None], bits, d)[..., 0]
        if m is mask:
            values = 1 - values  # a stencil's ones are left out
        return np.rint(np.clip(values, 0, 1) * 255).astype(np.uint8)[np.arange(height) * h // height][:, np.arange(width) * w // width]
    return None


def rgb(doc: Document, x: Stream, defaults: dict) -> bytes:
    """Row by row three bytes a pixel, or four with alpha where the image is masked; for image masks one byte of coverage."""
    get = lambda k, other=None: doc.get(x.dict.get(k, other))
    width, height = int(get("Width")), int(get("Height"))
    if width < 1 or height < 1 or width * height > MOST:
        raise PdfError("image")
    data = doc.decoded(x)
    decode = [float(doc.get(v)) for v in get("Decode") or ()]
    if get("ImageMask") is True:
        ones = unpack(data, width, height, 1, 1)[..., 0]
        return np.where(ones == (1 if decode[:2] == [1.0, 0.0] else 0), 255, 0).astype(np.uint8).tobytes()
    space, bits = of_image(doc, x.dict.get("ColorSpace"), defaults), int(get("BitsPerComponent", 8))
    samples = unpack(data, width, height, space.n, bits)
    values = decoded(samples, bits, decode if len(decode) == 2 * space.n else space.default_decode(bits))
    if space.family in ("DeviceGray", "DeviceRGB", "DeviceCMYK"):
        v = np.clip(values, 0, 1)
        out = np.repeat(v, 3, axis=2) if space.n == 1 else v if space.n == 3 else (1 - v[..., :3]) * (1 - v[..., 3:])
    else:  # each colour once
        flat, back = np.unique(values.reshape(-1, space.n), axis=0, return_inverse=True)
        out = np.array([space.rgb([float(c) for c in row]) for row in flat]).reshape(-1, 3)[back.ravel()].reshape(height, width, 3)
    out = np.rint(out * 255).astype(np.uint8)
    cover = alpha(doc, x, width, height)
    key = get("Mask")
    if cover is None and isinstance(key, list) and len(key) == 2 * space.n:
        limits = [int(doc.get(v)) for v in key]
        hidden = np.all([(samples[..., i] >= limits[2 * i]) & (samples[..., i] <= limits[2 * i + 1]) for i in range(space.n)], axis=0)
        cover = np.where(hidden, 0, 255).astype(np.uint8)
    return out.tobytes() if cover is None else np.dstack([out, cover]).tobytes()
