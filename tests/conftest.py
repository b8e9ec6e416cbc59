from __future__ import annotations

import os
import struct
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from framesift.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session(
        "framesift-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"},
    )


def write_png(path, pixels: np.ndarray) -> None:
    """Plain 8-bit PNG: h x w grey, h x w x 3 RGB or h x w x 4 RGBA."""
    pixels = np.ascontiguousarray(pixels, dtype=np.uint8)
    h, w = pixels.shape[:2]
    channels = 1 if pixels.ndim == 2 else pixels.shape[2]
    colour = {1: 0, 3: 2, 4: 6}[channels]
    lines = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    header = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    with open(path, "wb") as out:
        out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def noise(seed: int, h: int = 64, w: int = 64) -> np.ndarray:
    """Smooth random picture: 8 x 8 random colours enlarged, so that its hash is stable."""
    rng = np.random.default_rng(seed)
    small = rng.integers(0, 256, size=(8, 8, 3))
    return np.kron(small, np.ones((h // 8, w // 8, 1))).astype(np.uint8)


@pytest.fixture(scope="session")
def picture_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("set")
    a, b = noise(1), noise(2)
    write_png(root / "a.png", a)
    write_png(root / "a_copy.png", a)
    write_png(root / "a_big.png", np.kron(a, np.ones((2, 2, 1))).astype(np.uint8))
    write_png(root / "b.PNG", b)
    write_png(root / "grey.png", noise(3)[:, :, 0])
    write_png(root / "alpha.png", np.dstack([noise(4), np.full((64, 64), 255)]))
    write_png(root / "flat.png", np.full((32, 32, 3), 90))
    write_png(root / "wide.png", np.random.default_rng(5).integers(0, 256, (10, 3000, 3)))
    (root / "bad.jpg").write_bytes(b"not a picture")
    (root / "note.txt").write_text("not scanned")
    (root / "sub").mkdir()
    write_png(root / "sub" / "c.png", a)
    return root
