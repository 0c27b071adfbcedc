"""Spectra of any size, headers and records, against numpy and images with a known past."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frametally.operators import headers, provenance, quant, spectrum
from frametally.sources import images, pages


def pixels(spark, pictures):
    rows = [(i, x, y, float(v)) for i, p in pictures.items() for y, row in enumerate(p) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "image int, x int, y int, value double").repartition(8)


def axis(a, n):
    """One axis (rows) of an array resampled to n: means of what is covered, or lines between centres."""
    size, ratio = len(a), len(a) / n
    if size > n:
        out = []
        for t in range(n):
            lo, hi = t * ratio, (t + 1) * ratio
            cover = [(i, min(i + 1, hi) - max(i, lo)) for i in range(int(lo), min(int(np.ceil(hi)), size))]
            out.append(sum(a[i] * c for i, c in cover) / ratio)
        return np.array(out)
    at = np.clip((np.arange(n) + 0.5) * ratio - 0.5, 0, size - 1)
    lo = at.astype(int)
    hi = np.minimum(lo + 1, size - 1)
    f = (at - lo)[:, None]
    return a[lo] * (1 - f) + a[hi] * f


def rings(p):
    """The 64 rings by one transform of the whole plane."""
    h, w = p.shape
    n = 256 if max(h, w) <= 256 else 512 if max(h, w) <= 512 else 1024
    plane = axis(axis(p, n).T, n).T
    win = np.outer(np.hanning(n), np.hanning(n))
    power = np.abs(np.fft.fft2((plane - (plane * win).sum() / win.sum()) * win)) ** 2
    f = np.fft.fftfreq(n)
    r = np.hypot(f[:, None], f[None])
    ring = np.minimum((r / 0.5 * 64).astype(int), 63)
    return np.array([power[(ring == b) & (r <= 0.5)].mean() for b in range(64)])


def test_spectra_of_any_size_equal_one_transform(spark):
    rng = np.random.default_rng(3)
    pictures = {i: rng.integers(0, 256, s) for i, s in enumerate([(16, 16), (40, 24), (300, 20), (17, 1100), (256, 256)])}
    got = {r.image: r.spectrum for r in spectrum.spectra(pixels(spark, pictures), "image").collect()}
    assert set(got) == set(pictures)
    for i, p in pictures.items():
        np.testing.assert_allclose(got[i], rings(p.astype(float)), rtol=1e-9, atol=1e-6)


def test_resolution_of_known_pictures(spark):
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, (96, 128)).astype(float)
    twice = axis(axis(noise, 192).T, 256).T
    wide = rng.integers(0, 256, (32, 1536)).astype(float)
    pictures = {1: noise, 2: twice, 3: np.full((20, 20), 7.0), 4: np.ones((9, 40)), 5: wide}
    got = {r.image: r for r in spectrum.resolution(pixels(spark, pictures), "image").collect()}
    assert got[1].share == 1 and (got[1].effective_w, got[1].effective_h, got[1].certified_w) == (128, 96, 128)
    assert 0.45 < got[2].share < 0.625
    assert got[3].share == 1 / 64 and got[4].share is None and got[4].certified_w is None
    # a plane of 1,024 can't tell more, which makes no native picture an enlarged one
    assert (got[5].effective_w, got[5].certified_w, got[5].certified_h) == (1024, 1024, 21)


def record(spark, **over):
    base = {"container": "jpeg", "width": 1536, "height": 1024, "quality": 90, "encoder": None, "subsampling": None, "generations": 1, "seams": 1.0, "effective_w": 1024, "effective_h": 683, "certified_w": 1024, "certified_h": 683, "p95": 200.0} | over
    schema = "container string, width int, height int, quality int, encoder string, subsampling string, generations int, seams double, effective_w int, effective_h int, certified_w int, certified_h int, p95 double"
    row = spark.createDataFrame([tuple(base.values())], schema).withColumn("said", F.array(F.lit("quality about 90")))
    return provenance.records(row).first()


def test_enlarged_goes_by_what_can_be_certified(spark):
    native = record(spark)
    assert not native.upscaled and native.softness == "sharp" and native.evidence[:2] == ["container jpeg, 1536x1024", "quality about 90"]
    assert record(spark, effective_w=639, effective_h=426).upscaled and not record(spark, effective_w=641, effective_h=427).upscaled
    none = record(spark, effective_w=None, effective_h=None, certified_w=None, certified_h=None, p95=None)
    assert not none.upscaled and none.softness == "unknown" and "no spectrum to go by" in none.evidence


def jpeg(*segments, factors=(0x22, 0x11, 0x11), bits=8):
    frame = bytes([0xFF, 0xC2, 0, 8 + 3 * len(factors), bits, 0, 30, 0, 40, len(factors)]) + b"".join(bytes([i + 1, f, min(i, 1)]) for i, f in enumerate(factors))
    return b"\xff\xd8" + b"".join(segments) + frame + b"\xff\xda\x00\x02\xff\xd9"


def table(ident, values, wide=False):
    stored = [values[i] for i in images.ZIGZAG]
    body = bytes([wide << 4 | ident]) + (b"".join(v.to_bytes(2, "big") for v in stored) if wide else bytes(stored))
    return b"\xff\xdb" + (len(body) + 2).to_bytes(2, "big") + body


def scaled(base, q, limit=255):
    s = 5000 // q if q < 50 else 200 - 2 * q
    return [min(limit, max(1, (b * s + 50) // 100)) for b in base]


def test_headers_from_bytes(spark):
    luma, chroma = quant.STANDARD_LUMA, quant.STANDARD_CHROMA
    files = {
        "standard": jpeg(table(0, scaled(luma, 60)), table(1, scaled(chroma, 60))),
        # at low quality 16-bit tables go beyond 255, and the families are scaled as far
        "wide": jpeg(table(0, scaled(luma, 5, 32767), True), table(1, scaled(chroma, 5, 32767), True), factors=(0x21, 0x11, 0x11)),
        "mixed": jpeg(table(0, scaled(luma, 60)), table(1, scaled(chroma, 90))),
        "grey": jpeg(table(0, scaled(luma, 85)), factors=(0x11,)),
        "other": jpeg(table(0, scaled(quant.PSYCHOVISUAL, 75)), table(1, scaled(quant.PSYCHOVISUAL, 75)), factors=(0x12, 0x11, 0x11)),
        "cut": jpeg(table(0, scaled(luma, 85)))[:90],
        "gif": b"GIF89a....",
        "text": b"hello",
        "empty": b"",
        "none": None,
    }
    got = {r.name: r for r in headers.evidence(spark.createDataFrame(list(files.items()), "name string, content binary"), "name").collect()}
    assert (got["standard"].quality, got["standard"].encoder, got["standard"].headroom, got["standard"].subsampling) == (60, "standard", "low", "4:2:0")
    assert (got["standard"].width, got["standard"].height, got["standard"].bits, got["standard"].progressive) == (40, 30, 8, True)
    assert (got["wide"].quality, got["wide"].headroom, got["wide"].subsampling) == (5, "none", "4:2:2")
    assert got["mixed"].quality is None and any("no known family: luma " in e and ", chroma " in e for e in got["mixed"].evidence)
    assert (got["grey"].quality, got["grey"].subsampling) == (85, "none")
    assert (got["other"].family, got["other"].quality, got["other"].subsampling) == ("psychovisual", 75, None)
    assert got["cut"].truncated and got["cut"].quality == 85 and "header cut short" in got["cut"].evidence
    assert got["gif"].container == "gif" and got["gif"].headroom is None and got["text"].container is None and got["empty"].container is None and got["none"].container is None


def test_record_of_pixels_and_file(spark):
    rng = np.random.default_rng(1)
    pictures = {1: rng.integers(0, 256, (24, 32)), 2: np.kron(rng.integers(0, 256, (3, 4)), np.ones((8, 8))), 3: rng.integers(0, 256, (2, 5))}
    files = spark.createDataFrame([(1, jpeg(table(0, scaled(quant.STANDARD_LUMA, 70)), table(1, scaled(quant.STANDARD_CHROMA, 70))))], "image int, content binary")
    got = {r.image: r for r in provenance.measured(pixels(spark, pictures), files, "image").collect()}
    assert (got[1].container, got[1].quality, got[1].subsampling, got[1].headroom) == ("jpeg", 70, "4:2:0", "low")
    # flat blocks of eight pixels in a lossless file once were a JPEG
    assert (got[2].container, got[2].headroom) == ("png", "none") and got[2].blocking_score > 0.9
    assert got[3].softness == "unknown" and got[3].effective_w is None


def test_bad_addresses_give_no_image():
    assert pages.images_of("<img src='//[foo/a.jpg'><img src='/b.jpg' srcset='//[x/c.jpg 2x, /d.jpg 3x'>", "https://e.example/") == [
        {"url": "https://e.example/b.jpg", "kind": "img", "lazy": False, "attr_w": None, "attr_h": None, "css_w": None, "css_h": None, "srcset": [{"url": "https://e.example/d.jpg", "descriptor": "3x"}]}
    ]


@pytest.mark.parametrize("size, target", [(24, 256), (256, 256), (1200, 1024), (3000, 1024), (1, 16)])
def test_resampling_rows_sum_to_one(size, target):
    m = spectrum.resampling(size, target)
    np.testing.assert_allclose(m.sum(axis=1), 1)
    np.testing.assert_allclose(m @ np.arange(size)[:, None], axis(np.arange(size, dtype=float)[:, None], target), atol=1e-9)
