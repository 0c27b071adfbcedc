import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from frametally.functions import addresses, containers, layout, rates, urls
from frametally.operators import decide, history, hull, pixels, quant, resize, sweep, verify
from frametally.plans import apply
from frametally.sources import images, pages, receipts
from frametally.streaming import limits

POINT = "asset_id int, bytes long, distortion double, ord long, format string, quality int, ssim double"


def clouds(rng, n):
    return [[(rng.randint(1, 40) * 25, rng.randint(0, 64) / 64) for _ in range(rng.randint(1, 8))] for _ in range(n)]


def frame(spark, clouds_):
    rows = [(i, b, d, k, "webp", 75, 1.0) for i, c in enumerate(clouds_) for k, (b, d) in enumerate(c)]
    return spark.createDataFrame(rows, POINT)


def test_hull_keeps_the_best_point_at_every_rate(spark):
    rng = random.Random(20)
    cs = clouds(rng, 200)
    got = {r.asset_id: [(p.bytes, p.distortion) for p in r.hull] for r in hull.hulls(frame(spark, cs), "asset_id").collect()}
    for i, c in enumerate(cs):
        h = got[i]
        assert set(h) <= set(c) and all(a[0] < b[0] and a[1] > b[1] for a, b in zip(h, h[1:]))
        for mu in (0, 1e-5, 1e-4, 1e-3, 1e-2, 1):
            assert min(d + mu * b for b, d in h) == min(d + mu * b for b, d in c)


def test_hull_refuses_values_that_are_not_finite(spark):
    with pytest.raises(Exception, match="finite"):
        hull.hulls(frame(spark, [[(1, float("nan"))]]), "asset_id").collect()


def test_budget_allocation_by_trying_every_rate(spark):
    rng = random.Random(3000)
    cs, page, weight = clouds(rng, 300), [i // 5 for i in range(300)], [rng.randint(0, 8) / 8 for _ in range(300)]
    h = hull.hulls(frame(spark, cs), "asset_id")
    w = spark.createDataFrame([(i, page[i], weight[i]) for i in range(300)], "asset_id int, page int, weight double")
    budgets = {p: rng.randint(100, 4000) for p in set(page)}
    got = hull.allocate_in_budget(h.join(w, "asset_id"), "page", spark.createDataFrame(list(budgets.items()), "page int, budget long")).collect()
    hulls = {r.asset_id: [(p.bytes, p.distortion) for p in r.hull] for r in got}
    for p, budget in budgets.items():
        own = [i for i in range(300) if page[i] == p]
        steps = {i: [(weight[i] * (a[1] - b[1])) / (b[0] - a[0]) for a, b in zip(hulls[i], hulls[i][1:])] for i in own}

        def spent(rate):
            return sum(hulls[i][sum(r > rate for r in steps[i])][0] for i in own)

        tried = sorted({r for s in steps.values() for r in s if r > 0})
        rate = next((r for r in [0.0, *tried] if spent(r) <= budget), tried[-1] if tried else 0.0)
        for r in got:
            if r.page == p:
                assert r.rate == rate and r.choice.bytes == hulls[r.asset_id][sum(x > rate for x in steps[r.asset_id])][0]


def test_floor_is_inclusive_and_checked(spark):
    c = spark.createDataFrame([(0.97,), (0.96999,)], "ssim double")
    assert hull.at_or_above_floor(c, 0.97).count() == 1
    with pytest.raises(Exception, match="floor"):
        hull.at_or_above_floor(c, 1.5).collect()


def test_refusal_comes_before_candidates(spark):
    cols = "asset_id int, container string, classification string, generations int, quality int, blocking_score double, above_fold boolean"
    rows = [(1, "jpeg", None, 2, 90, 0.0, False), (2, "svg", None, None, None, 0.0, False), (3, "svg", "photo", None, None, 0.0, False), (4, "png", None, None, None, 0.4, False), (5, "webp", None, 1, 90, 0.0, False), (6, "webp", None, 1, 90, 0.0, False)]
    points = [(5, 960, 0.0, 1, "webp", 90, 0.999), (5, 1000, 0.0, 0, "keep-original", None, 1.0), (6, 500, 0.01, 1, "webp", 60, 0.98), (6, 1000, 0.0, 0, "keep-original", None, 1.0), (1, 1, 0.0, 1, "webp", 60, 1.0)]
    got = {r.asset_id: r.tag for r in decide.decide(spark.createDataFrame(rows, cols), spark.createDataFrame(points, POINT)).collect()}
    assert got == {1: "refused", 2: "skipped-class", 3: "skipped-unmeasured", 4: "refused", 5: "kept-no-op", 6: "encoded"}


def grid(spark, planes):
    rows = [(i, x, y, float(p[y][x])) for i, p in enumerate(planes) for y in range(len(p)) for x in range(len(p[0]))]
    return spark.createDataFrame(rows, "image int, x int, y int, value double")


def test_ssim_facts(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (20, 20)).astype(float)
    flat = [(0, a, a), (1, np.full((32, 32), 100.0), np.full((32, 32), 120.0)), (2, a, a.T)]
    rows = [(i, x, y, float(p[y, x]), float(q[y, x])) for i, p, q in flat for y in range(p.shape[0]) for x in range(p.shape[1])]
    got = {r.image: r.ssim for r in pixels.ssim(spark.createDataFrame(rows, "image int, x int, y int, a double, b double"), "image").collect()}
    assert got[0] == 1.0 and abs(got[1] - 24006.5025 / 24406.5025) < 1e-12 and got[2] < 0.9


def test_white_and_black_are_a_hundred_apart(spark):
    d = spark.createDataFrame([(1, 255, 255, 255, 0, 0, 0)], "k int, r1 int, g1 int, b1 int, r2 int, g2 int, b2 int")
    r = pixels.delta_e(d, "k").first()
    assert abs(r.mean - 100) < 0.01 and r.p95 == r.mean


def test_flat_images_have_no_seams_and_narrow_ones_count_as_one(spark):
    got = {r.image: r for r in pixels.blocking(grid(spark, [np.full((20, 20), 7.0), np.add.outer(np.zeros(20), np.arange(12.0)), np.kron(np.arange(16.0).reshape(4, 4) * 9, np.ones((8, 8)))]), "image").collect()}
    assert got[0].combined == 1.0 and got[1].horizontal == 1.0 and got[2].combined > 1000


def test_dct_of_a_block(spark):
    rng = np.random.default_rng(2)
    p = rng.integers(0, 256, (9, 17)).astype(float)
    k = np.arange(8)
    m = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5)
    got = pixels.dct_blocks(grid(spark, [p]), "image").collect()
    assert len(got) == 2 * 64
    for r in got:
        want = m @ (p[:8, 8 * r.block_x : 8 * r.block_x + 8] - 128) @ m.T
        assert abs(r.coefficient - want[r.v, r.u]) < 1e-9


def test_double_quantisation_is_told_from_single(spark):
    rng = np.random.default_rng(9)
    k = np.arange(8)
    m = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5)
    coefficients = rng.laplace(0, 60, (1500, 8, 8))
    rows = []
    for image, steps in ((1, (6,)), (2, (14, 6))):
        c = coefficients
        for s in steps:
            c = np.floor(c / s + 0.5) * s
        rows += [(image, int(u), int(v), float(c[b, v, u])) for b in range(1500) for u, v in ((1, 0), (0, 1), (1, 1), (2, 0))]
    blocks = spark.createDataFrame(rows, "image int, u int, v int, coefficient double")
    bands = pixels.periodicity(pixels.quantised_histogram(blocks, F.lit(6.0), "image"), "image")
    got = {r.image: r.generations for r in pixels.generations(bands, "image").collect()}
    assert got == {1: 1, 2: 2} and m.shape == (8, 8)


def test_quality_of_a_table(spark):
    base = F.array(*map(F.lit, quant.STANDARD_LUMA))
    t = spark.range(1, 101).withColumn("luma", quant.scale_table(base, F.col("id")))
    got = {r.id: r for r in quant.estimate_quality(t, quant.families(spark), "id").collect()}
    assert all(got[q].quality == q and got[q].exact for q in range(10, 100)) and got[85].encoder == "standard"
    fnv = spark.range(1).select(quant.signature(F.array(F.lit(0x6162), F.lit(0x6300)), 0).alias("s")).first().s
    h = 2166136261
    for b in b"\0abc\0":
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    assert fnv == f"{h:08x}"


def jpeg(tables, components=((1, 0x22, 0), (2, 0x11, 1), (3, 0x11, 1)), end=b"\xff\xda\x00\x02"):
    def segment(marker, body):
        return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body

    dqt = b"".join(segment(0xDB, bytes([i]) + bytes(v[z] for z in images.ZIGZAG)) for i, v in tables)
    sof = segment(0xC0, struct.pack(">BHHB", 8, 48, 64, len(components)) + b"".join(map(bytes, components)))
    return b"\xff\xd8" + dqt + sof + end


def test_jpeg_headers(spark):
    luma, chroma = quant.STANDARD_LUMA, [17] * 64
    rows = [(1, jpeg([(0, luma), (1, chroma)])), (2, jpeg([(0, chroma), (0, luma)])[:-4]), (3, b"nope"), (4, None)]
    h = spark.createDataFrame(rows, "id int, content binary").withColumn("h", images.jpeg_header(F.col("content")))
    got = {r.id: r for r in h.select("id", "h", quant.bound_tables("h.tables", "h.components").alias("t"), quant.subsampling(F.transform("h.components", lambda c: F.struct(c["h"], c["v"]))).alias("s")).collect()}
    assert (got[1].h.width, got[1].h.height, got[1].h.truncated, got[1].s) == (64, 48, False, "4:2:0")
    assert got[1].t.luma.values == luma and got[1].t.chroma.values == chroma
    assert got[2].h.truncated and got[2].t.luma.values == luma and got[3].h is None and got[4].h is None


def test_scan_and_examine(spark, tmp_path):
    for name, data in (("a.JPG", jpeg([(0, [1] * 64)])), ("b.png", b"\x89PNG\r\n\x1a\nxxxx"), ("c.svg", b"  <svg></svg>"), ("d.txt", b"x"), ("node_modules/e.png", b"x"), ("f.gif", b""), ("g.webp", b"RIFFxxxxWEBP")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.container, r.note) for r in images.examine(images.scan(spark, str(tmp_path))).collect()}
    assert got == {"a.JPG": ("jpeg", None), "b.png": ("png", None), "c.svg": ("svg", "not decoded: svg"), "f.gif": (None, "empty"), "g.webp": ("webp", None)}


def test_sniffing_by_compatible_brand(spark):
    box = struct.pack(">I", 28) + b"ftypmif1\0\0\0\0miafavifxxxx"
    r = spark.createDataFrame([(box,)], "c binary").select(*[containers.sniff(F.col("c"), m).alias(m) for m in containers.MODES]).first()
    assert (r.scan, r.probe, r.ingest) == (None, None, "avif")


def test_urls_keep_what_they_do_not_touch(spark):
    tries = {
        "https://s.example/a-150x150-scaled.jpg": [],
        "https://s.example/a-scaled-150x150.jpg?x=%20#f": ["https://s.example/a.jpg?x=%20#f", "https://s.example/a-scaled.jpg?x=%20#f"],
        "/_next/image?url=https%3A%2F%2Fx%2Fa%2Bb.png": ["https://x/a+b.png"],
        "/_next/image?url=%ZZ": [],
        "https://q.example/cdn/shop/f_1x2_large_crop_top@2x.png": ["https://q.example/cdn/shop/f.png"],
        "https://c.example/image/upload/w_1/h_2": ["https://c.example/image/upload/h_2"],
        "https://c.example/image/upload/my_photos/a.jpg?keep=1": [],
    }
    d = spark.createDataFrame([(k,) for k in tries], "url string")
    builders = F.concat(urls.wordpress(F.col("url")), urls.nextjs(F.col("url")), urls.shopify(F.col("url")), urls.cdn(F.col("url")))
    got = {r.url: [p.url for p in r.p] for r in d.select("url", builders.alias("p")).collect()}
    tries["https://s.example/a-150x150-scaled.jpg"] = ["https://s.example/a-150x150.jpg"]
    assert got == tries


def test_srcset_larger_first(spark):
    e = [("a", "400w"), ("b", "800w"), ("c", "2x"), ("d", "1200w"), ("b", "900w")]
    d = spark.createDataFrame([("a", e), ("z", e), ("a", None)], "url string, s array<struct<url:string,descriptor:string>>")
    got = [[p.url for p in r.p] for r in d.select(urls.srcset(F.col("url"), F.col("s")).alias("p")).collect()]
    assert got == [["d", "b"], ["d", "b", "a", "c"], []]
    assert pages.srcset_entries("a.png, b.png 2x,c.png 10w , d.png 5q, data:x,y 3x") == [{"url": "c.png", "descriptor": "10w"}, {"url": "data:x,y", "descriptor": "3x"}, {"url": "b.png", "descriptor": "2x"}, {"url": "a.png", "descriptor": "1x"}]


def test_images_of_a_page(spark):
    html = """<style>/* x */ img { width: 10px } .w { width: 20px } @media print { img { width: 1px } } div p { width: 2px }</style>
    <picture><source srcset="big.avif 2x"><img class=w src=a.jpg height="30" style="height: 5vh"></picture><img src="data:x"><p style="background-image:url( 'b.png' )">"""
    got = pages.images(spark.createDataFrame([(1, "https://h.example/d/", html), (2, None, None)], "page_id int, url string, html string")).collect()
    assert [(r.idx, r.url, r.kind, r.css_w, r.css_h, r.attr_h) for r in got] == [(0, "https://h.example/d/a.jpg", "img", "20px", "5vh", 30), (1, "https://h.example/d/b.png", "background", None, None, None)]
    assert got[0].srcset[0].url == "https://h.example/d/big.avif"


def test_robots(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\nUser-agent: tally\nDisallow: /x$\n"
    d = spark.createDataFrame([(text, "/a/c"), (text, "/a/b/c"), (text, "/x"), (text, "/xy"), (None, "/a"), ("", "/a")], "r string, p string")
    any_, own = (pages.robots_allow(F.col("r"), F.col("p"), a) for a in ("other/1.0", "Tally/2"))
    assert [tuple(r) for r in d.select(any_.alias("any"), own.alias("own")).collect()] == [(False, True), (True, True), (True, False), (True, True), (True, True), (True, True)]


def test_addresses(spark):
    tries = {"127.1": "loopback", "0x7f.1": "loopback", "0177.0.0.1": "loopback", "2130706433": "loopback", "8.8.8.8": None, "256.1.1.1": "none", "1.2.3.4.5": "none", "08.1.1.1": "none", "": "none", "169.254.1.1": "link-local"}
    d = spark.createDataFrame([(k,) for k in tries], "t string").withColumn("n", addresses.ipv4_number(F.col("t")))
    got = {r.t: "none" if r.n is None else r.reason for r in addresses.check_ipv4(d, "n").collect()}
    assert got == tries
    hops = spark.createDataFrame([("http", "", "a.example", [None]), ("ftp", "", "a", [None]), ("https", "u", "a", [None]), ("https", "", "LocalHost.", [None]), ("https", "", "a", [None, "private"]), ("https", "", "a", [])], "s string, c string, h string, r array<string>")
    assert [r[0] for r in hops.select(addresses.hop_allowed(*map(F.col, "schr"))).collect()] == [None, "scheme", "credentials", "host", "address", "unresolved"]


def test_scalars(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    assert [value(layout.css_length(F.lit(v), "height")) for v in ("50%", "10.5px", "1vw", "0px", "3em", "-2px")] == [450, 11, 14, None, None, None]
    assert value(rates.viewport_factor(F.lit(1.0))) == pytest.approx(0.65) and value(rates.role_factor(F.lit("lcp"))) == 1.5
    assert value(rates.clamp_quality(F.lit(float("nan")), 75)) == 75 and value(rates.clamp_quality(F.lit(140.0), 75)) == 100
    assert value(rates.softness(F.lit(120.0), F.lit(1025))) == "unknown" and value(rates.blocking_score(F.lit(1.5))) == pytest.approx(1 / 3)
    with pytest.raises(Exception, match="ssim"):
        value(rates.distortion(F.lit(1.1), F.lit(0.0)))
    assert value(containers.output_path(F.lit("a.b/c"), F.lit("jpeg"))) == "a.b/c.jpg" and value(containers.format_name(F.lit("JPG"))) == "jpeg"
    assert value(containers.bytes_1024(F.lit(2048))) == "2.0 kB" and value(containers.bytes_1000(F.lit(156200))) == "156 kB"
    assert value(addresses.client_ip(F.lit(" 1.2.3.4 , 5.6.7.8"), F.lit(None).cast("string"))) == "1.2.3.4"
    assert value(containers.image_content_type(F.lit("IMAGE/png; q=1"))) and not value(containers.image_content_type(F.lit("text/html")))


def test_sweep_sizes(spark):
    assert sweep.plan(spark).count() == 37 and sweep.plan(spark, fast=True).count() == 25
    assert sweep.capped_plan(spark, {"jpeg": False, "webp": True, "png": True, "avif": True}).count() == 32


def test_receipts_round_trip_and_tampering(spark, tmp_path):
    cols = "asset string, source_hash string, output_hash string, reference_w int, reference_h int, reference_hash string, decision string, reason string, container string, file_bytes long, chosen_format string, chosen_quality int, chosen_bytes long, ssim double, delta_e double, distortion double, generations int, quality int, headroom string"
    rows = [
        ("i\\a.jpg", "sha256:s1", "sha256:o1", 10, 20, "sha256:r", "encoded", "x", "jpeg", 100, "webp", 75, 50, 0.98, 0.5, 0.1, 1, 85, "normal"),
        ("i/b.png", "sha256:s2", None, 10, 20, "sha256:r", "kept", "why", "png", 100, None, None, None, None, None, None, None, None, "low"),
        ("i/c.png", "sha256:s3", None, 10, 20, None, "kept", "why", "png", 100, None, None, None, None, None, None, None, None, "low"),
    ]
    lines = apply.entries(spark.createDataFrame(rows, cols), "2026-01-01T00:00:00Z")
    path = str(tmp_path / "ledger")
    assert apply.append(lines, path) == 2 and not (tmp_path / "ledger").exists()
    assert apply.append(lines, path, confirm=True) == 2
    good = receipts.parse(receipts.read_lines(spark, path))
    assert sorted((r.asset, r.reason) for r in good.collect()) == [("i/a.jpg", None), ("i/b.png", None)]
    files = spark.createDataFrame([(1, "A.JPG", "sha256:o1"), (2, "src", "sha256:s1"), (3, "b.png", "sha256:tampered")], "file_ord int, name string, hash string")
    got = {r.asset: (r.classification, r.verdict) for r in verify.match(good, files, "line").collect()}
    assert got == {"i/a.jpg": ("verifiable", None), "i/b.png": ("not-applicable", "refuted")}


def test_receipts_name_the_first_problem(spark):
    ok = '"v":1,"ts":"t","asset":"a","sourceHash":"s","outputHash":null,"sourceRecovered":null,"reference":{"w":1,"h":1,"hash":"r"},"decision":"kept","reason":"x","output":null,"before":{"format":"jpeg","bytes":1},"metrics":null,"weight":null,"lambda":null,"provenance":null,"encoder":null,"tool":"t"'
    tries = {
        "{" + ok + "}": None,
        "{" + ok + ',"extra":1}\r': None,
        "[1]": "not an object",
        "{": "invalid JSON",
        "{" + ok.replace('"weight":null,', "") + "}": "weight must be a number or null",
        "{" + ok.replace('"w":1', '"w":1.5') + "}": "reference must have w, h and hash",
        "{" + ok.replace('"kept"', '"encoded"') + "}": "an encoded entry must have outputHash, output and metrics",
    }
    lines = spark.createDataFrame([(i, k) for i, k in enumerate([*tries, "", "  "])], "line int, raw string")
    got = {r.line: r.reason for r in receipts.parse(lines).collect()}
    assert got == dict(enumerate(tries.values()))


def test_tolerances(spark):
    d = spark.createDataFrame([(0.98, 0.5, 0.1, 0.9795, 0.55, 0.11), (0.98, 0.5, 0.1, 0.975, 0.5, 0.1)], "s double, e double, d double, s2 double, e2 double, d2 double")
    ok = verify.within({"ssim": F.col("s"), "delta_e": F.col("e"), "distortion": F.col("d")}, {"ssim": F.col("s2"), "delta_e": F.col("e2"), "distortion": F.col("d2")})
    assert [r[0] for r in d.select(ok).collect()] == [True, False]


@pytest.fixture(scope="module")
def replayed(spark):
    """Requests, and what a replay of the step decides."""
    rng = random.Random(4)
    rows = sorted((rng.randint(0, 5000), i, rng.randint(1, 3)) for i in range(300))
    windows = ((300, 3), (2000, 9))
    want, hits = {}, {}
    for at, i, client in rows:
        hits[client], ok, wait = limits.step(hits.get(client, []), at, windows)
        want[i] = (ok, wait)
    assert sum(ok for ok, _ in want.values()) < 300
    return spark.createDataFrame([(c, i, at) for at, i, c in rows], "client long, event_id long, at long"), windows, want, rows[150][0]


def test_limiter_batch_agrees_with_a_replay(replayed):
    requests, windows, want, _ = replayed
    assert {r.event_id: (r.allowed, r.retry_after) for r in limits.limit_batch(requests, windows).collect()} == want


def test_limiter_stream_agrees_with_a_replay(spark, replayed, tmp_path):
    """Two runs on one checkpoint, each over what has come by then."""
    requests, windows, want, cut = replayed
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for half in (requests.where(F.col("at") < cut), requests.where(F.col("at") >= cut)):
        half.coalesce(1).write.mode("append").parquet(source)
        stream = limits.limit_stream(spark.readStream.schema(requests.schema).parquet(source), windows)
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        try:
            assert run.awaitTermination(90)
        finally:
            run.stop()
    assert {r.event_id: (r.allowed, r.retry_after) for r in spark.read.parquet(out).collect()} == want


def test_cache_entries_expire(spark):
    r = spark.createDataFrame([("u", 1, 0), ("u", 2, 99), ("u", 3, 100), ("u", 4, 150), ("v", 5, 120)], "url string, event_id long, at long")
    assert {x.event_id: x.hit for x in limits.cache_batch(r, 100).collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_fold_and_caps(spark):
    rows = [(1, 0, 100, 800, False), (1, 1, 300, 200, True), (1, 2, 900, 50, False), (1, 3, None, None, False), (1, 4, 9000, 9000, False)]
    i = spark.createDataFrame(rows, "page int, idx int, width long, height long, lazy boolean")
    got = {r.idx: (r.above_fold, r.role) for r in layout.fold(i, "page", "idx").collect()}
    assert got == {0: (True, "lcp"), 1: (False, "content"), 2: (False, "content"), 3: (False, "content"), 4: (False, "content")}


def test_batches_fold_no_arrays(spark):
    """Requests of a key are a sorted stream, not one row's array; both steps agree with a replay."""
    rows = [(c, i, i * 700 % 90_000, f"u{c}") for c in range(3) for i in range(500)]
    r = spark.createDataFrame(rows, "client long, event_id long, at long, url string")
    allowed, hit = {}, {}
    for c in range(3):
        hits, until = [], -1
        for at, i in sorted((at, i) for k, i, at, _ in rows if k == c):
            hits, ok, wait = limits.step(hits, at, ((60_000, 10),))
            allowed[c, i] = (ok, wait)
            hit[f"u{c}", i] = at < until
            until = until if at < until else at + 5000
    limited, cached = limits.limit_batch(r, ((60_000, 10),)), limits.cache_batch(r, 5000)
    assert {(x.client, x.event_id): (x.allowed, x.retry_after) for x in limited.collect()} == allowed
    assert {(x.url, x.event_id): x.hit for x in cached.collect()} == hit
    for df in (limited, cached):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_ipv6_addresses(spark):
    tries = {
        "::": "unspecified", "[::1]": "loopback", "fe80::1%eth0": "link-local", "febf::": "link-local", "fec0::": None, "fdff::1": "unique-local", "ff02::1": "multicast", "2001:db8:1::": "documentation",
        "::ffff:10.0.0.1": "mapped: private", "::ffff:8.8.8.8": None, "64:ff9b::7f00:1": "nat64: loopback", "::192.168.0.1": "compatible: private", "2002:7f00:1::": "6to4: loopback", "2606:4700::1111": None,
        "1:2:3:4:5:6:7": "no address", "1::2::3": "no address", "::ffff:010.0.0.1": "no address", "1:2:3:4:5:6:7::8": "no address", "::12345": "no address", "0x7f.1": "loopback", "8.8.8.8": None, "name": "no address",
    }
    r = spark.createDataFrame([(k,) for k in tries], "t string").select("t", addresses.address_reason(F.col("t")).alias("r")).collect()
    assert {x.t: x.r for x in r} == tries


def test_resizing(spark):
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (7, 11)).astype(float)
    p = spark.createDataFrame([(1, x, y, float(image[y, x])) for y in range(7) for x in range(11)], "image int, x int, y int, value double")
    size = spark.createDataFrame([(1, 11, 7, 4, 3)], "image int, w int, h int, tw int, th int")

    def shares(n, t):
        return np.array([[max(0.0, min(i + 1, (k + 1) * n / t) - max(i, k * n / t)) for i in range(n)] for k in range(t)])

    want = shares(7, 3) @ image @ shares(11, 4).T / (7 / 3 * 11 / 4)
    got = {(r.x, r.y): r.value for r in resize.area(p, size, "image").collect()}
    assert len(got) == 12 and all(abs(got[x, y] - want[y, x]) < 1e-9 for x, y in got)
    same = {(r.x, r.y): r.value for r in resize.bilinear(p, size.selectExpr("image", "w", "h", "w AS tw", "h AS th"), "image").collect()}
    assert all(abs(same[x, y] - image[y, x]) < 1e-9 for x, y in same) and len(same) == 77
    small = resize.normalised(p, "image", edge=5).agg(F.max("x"), F.max("y")).first()
    assert tuple(small) == (4, 2) and resize.normalised(p, "image").count() == 77
    one = spark.createDataFrame([(100.0, 255, 300.5, 0.5), (100.0, 0, -3.0, 2.0)], "v double, a int, c double, s double")
    assert [tuple(r) for r in one.select(resize.flatten_onto_white(F.col("v"), F.col("a")), resize.clamp_byte(F.col("c")), resize.smoothstep(F.col("s"))).collect()] == [(100.0, 255.0, 0.5), (255.0, 0.0, 1.0)]
    assert resize.has_transparency(one, alpha="a").first()[0]


def test_version_history(spark):
    h = ["a" * 40, "b" * 40, "c" * 40, "d" * 40]
    text = f"{h[0]}\n\nimg/new name.png\n{h[1]}\n\nimg/old.png\n{h[2]}\n{h[3]}\r\n\r\nimg/old.png\r\n"
    r = spark.createDataFrame([(text,)], "t string").select(history.parse_log(F.col("t")).alias("e")).first().e
    assert [tuple(e) for e in r] == [(h[0], "img/new name.png"), (h[1], "img/old.png"), (h[3], "img/old.png")]
    p = spark.createDataFrame([("C:\\Repo\\img\\a.png", "c:/repo"), ("/other/a.png", "/repo"), ("/repo", "/repo/")], "p string, t string").select(history.relative_path(F.col("p"), F.col("t")).alias("r")).collect()
    assert [x.r for x in p] == ["img/a.png", None, None]
    log = spark.createDataFrame([(1, 0, h[0], "n.png", 120000), (1, 1, h[1], "o.png", 480000), (1, 2, h[2], "o.png", 910000), (1, 3, h[3], "o.png", None)], "k int, ord int, hash string, path string, size long")
    for known, want in ((None, [910000, 480000]), (500000, [910000]), (910000, [])):
        a = spark.createDataFrame([(1, "u", "n.png", known)], "k int, url string, local_path string, bytes long")
        assert [x.size for x in history.proposals(a, log, "k").orderBy("ord").collect()] == want
    s = spark.createDataFrame([(" M a.png\nR  b.png -> c.png\n?? d.png\n", list(map(str, range(12))))], "s string, l array<string>")
    x = s.select(history.dirty_files(F.col("s")).alias("d"), history.more_than(F.col("l")).alias("m")).first()
    assert x.d == ["a.png", "c.png", "d.png"] and x.m.endswith("9\nand 2 more")


def test_normal_urls(spark):
    tries = {
        "HTTP://u:p@Ex.Example:80/A b?b=2&a=1&b=1#x": "http://ex.example/A b?a=1&b=2&b=1", "https://e.example:443": "https://e.example/", "https://e.example:8443/?": "https://e.example:8443/", "/local?b&a": "/local?b&a",
    }
    r = spark.createDataFrame([(k,) for k in tries], "u string").select("u", urls.normalised(F.col("u")).alias("n")).collect()
    assert {x.u: x.n for x in r} == tries
