"""Layers nested far deeper than the interpreter's stack."""

import base64
import time
import zlib

import pytest

pytest.importorskip("barloom.llm")

from barloom.llm.secret_scan import scan_text  # noqa: E402

SECRET = b"password=hunter2hunter2"


def test_deep_compression():
    data = SECRET
    for _ in range(1500):
        data = zlib.compress(data)
    text = "x " + base64.b64encode(data).decode() + " y"
    t0 = time.time()
    out = scan_text(text, 64 << 20)
    kinds = [s.rsplit(":", 2)[0] for s in out[4].split(",")]
    assert any(k.startswith("base64+zlib+zlib") and k.endswith("-assign") for k in kinds)
    assert time.time() - t0 < 60 and not out[6]


def test_levels_larger_than_the_window_are_read_again():
    data = b"\n".join([b"line %d of plain words" % k for k in range(20_000)] + [SECRET])
    for _ in range(3):
        data = zlib.compress(data, 0)
    out = scan_text(base64.b64encode(data).decode(), 1 << 16)
    assert any(s.startswith("base64+zlib+zlib+zlib-assign") for s in out[4].split(","))


def test_alternating_layers():
    data = SECRET
    for _ in range(300):
        data = base64.b64encode(zlib.compress(data))
    out = scan_text(data.decode(), 64 << 20)
    assert out[5] >= 300 and "-assign" in out[4]
