"""Image files: decoding against the JVM's decoder, resampling against a direct
double sum, jobs by path and by bytes."""
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortbeam.constants import LABELS
from cohortbeam.operators import bulk, file_scoring as fs, resample, scoring as sc
from cohortbeam.sources import imagefile as imf, readers as rd
from cohortbeam.sources.pngwrite import SIGNATURE, _chunk, encode_png

DAY = "2026-02-09"


def picture(h, w, seed=1):
    y, x = np.mgrid[:h, :w]
    noise = np.random.default_rng(seed).integers(0, 12, (h, w, 3))
    return np.clip(np.stack([x * 255 / w, y * 255 / h, 128 + 100 * np.sin(x / 5 + y / 7)], axis=2) + noise, 0, 255).astype(np.uint8)


# ------------------------------------------------------------------ decoding
def jvm_file(spark, path, kind, fmt, progressive=False, h=37, w=45):
    """Written by the JVM's image writer: (BufferedImage type) ``kind``."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(w, h, kind)
    px = picture(h, w).astype(int)
    for y in range(h):
        for x in range(w):
            r, g, b = px[y, x].tolist()
            image.setRGB(x, y, (0xFF000000 | r << 16 | g << 8 | b) - (1 << 32))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(fmt).next()
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(1)  # MODE_DEFAULT
    out = jvm.javax.imageio.stream.FileImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    out.close()
    writer.dispose()


#: BufferedImage types: 1 RGB, 2 ARGB, 10 gray, 11 gray of 16 bits, 12 two colours, 13 palette.
@pytest.mark.parametrize("kind, fmt, progressive, off", [
    (1, "png", False, 0), (1, "png", True, 0), (2, "png", False, 0), (10, "png", False, 0), (10, "png", True, 0), (12, "png", False, 0),
    (12, "png", True, 0), (13, "png", False, 0), (1, "jpg", False, 3), (1, "jpg", True, 3), (10, "jpg", False, 2), (10, "jpg", True, 2)])
def test_decodes_as_the_jvm_does(spark, tmp_path, kind, fmt, progressive, off):
    path = tmp_path / f"x.{fmt}"
    jvm_file(spark, path, kind, fmt, progressive)
    im = rd.image_table(spark, str(path), f"*.{fmt}").first().image
    want = np.frombuffer(im.data, dtype=np.uint8).reshape(im.height, im.width, im.nChannels).astype(int)
    want = np.repeat(want, 3, axis=2) if im.nChannels == 1 else want[:, :, 2::-1]
    got = imf.decode_image(path.read_bytes()).astype(int)
    assert got.shape == want.shape and np.abs(got - want).max() <= off


def test_sixteen_bit_gray_by_its_high_byte(spark, tmp_path):
    jvm_file(spark, tmp_path / "x.png", 11, "png")
    got = imf.decode_image((tmp_path / "x.png").read_bytes())
    assert got.shape == (37, 45, 3) and len(np.unique(got)) > 50


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3]), st.integers(0, 2 ** 32 - 1))
def test_row_filters(h, w, n, seed):
    """Rows filtered one byte at a time come back."""
    rng = np.random.default_rng(seed)
    px, kinds = rng.integers(0, 256, (h, w * n), dtype=np.uint8), rng.integers(0, 5, h)
    raw = b""
    for y in range(h):
        row = []
        for i in range(w * n):
            a = int(px[y, i - n]) if i >= n else 0
            b = int(px[y - 1, i]) if y else 0
            c = int(px[y - 1, i - n]) if y and i >= n else 0
            p = a + b - c
            near = min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]
            row.append((int(px[y, i]) - (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256)
        raw += bytes([kinds[y]]) + bytes(row)
    data = (SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if n == 1 else 2, 0, 0, 0))
            + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b""))
    assert (imf.decode_image(data) == np.broadcast_to(px.reshape(h, w, n), (h, w, 3))).all()


def test_messages(spark, tmp_path):
    good = encode_png(picture(9, 9))
    jvm_file(spark, tmp_path / "a.jpg", 1, "jpg")
    jpeg = (tmp_path / "a.jpg").read_bytes()
    flipped = bytearray(good)
    flipped[60] ^= 1
    huge = SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", 10 ** 6, 10 ** 6, 8, 2, 0, 0, 0)) + _chunk(b"IEND", b"")
    cases = {b"": "Could not read image: cannot identify image file", None: "Could not read image: cannot identify image file",
             b"text": "Could not read image: cannot identify image file", b"GIF89a...": "Invalid image format: GIF. Must be PNG or JPEG.",
             b"BM1234": "Invalid image format: BMP. Must be PNG or JPEG.", b"RIFF0000WEBPVP8 ": "Invalid image format: WEBP. Must be PNG or JPEG.",
             bytes(flipped): "Could not read image: broken image file", huge: "Could not read image: 1000000 x 1000000 pixels are too many"}
    for cut in (8, 20, 40, len(good) // 2, len(good) - 12, len(good) - 1):
        cases[good[:cut]] = "Could not read image: image file is truncated"
    for cut in (2, 30, len(jpeg) // 2, len(jpeg) - 40):
        cases[jpeg[:cut] if cut > 2 else jpeg[:3]] = "Could not read image: image file is truncated"
    for data, message in cases.items():
        with pytest.raises(imf.ImageError) as e:
            imf.decode_image(data)
        assert str(e.value) == message, (data or b"")[:20]
    rng = np.random.default_rng(0)
    for base in (good, jpeg):  # damaged anywhere: pixels or a message, never another error
        for _ in range(150):
            bad = bytearray(base)
            for at in rng.integers(2, len(bad), 3):
                bad[at] = rng.integers(0, 256)
            try:
                imf.decode_image(bytes(bad))
            except imf.ImageError:
                pass


# ---------------------------------------------------------------- resampling
def direct(line, n_out):
    """Double sums of the widened window, sample by sample."""
    n, out = len(line), []
    scale = n / n_out
    wide = max(scale, 1.0)
    for i in range(n_out):
        c = (i + 0.5) * scale
        ws = {}
        for x in range(max(0, int(c - 3 * wide + 0.5)), min(n, int(c + 3 * wide + 0.5))):
            t = (x + 0.5 - c) / wide
            ws[x] = 0.0 if abs(t) >= 3 else 1.0 if t == 0 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2
        out.append(min(255, max(0, round(sum(w * line[x] for x, w in ws.items()) / sum(ws.values())))))
    return out


@pytest.mark.parametrize("h, w, out_h, out_w", [(8, 8, 32, 32), (64, 48, 16, 12), (40, 9, 17, 30), (5, 5, 5, 11), (1, 1, 4, 4), (300, 7, 3, 7)])
@pytest.mark.parametrize("gray", [False, True])
def test_resize_equals_direct_sums_within_one_level(h, w, out_h, out_w, gray):
    img = picture(h, w)
    img = np.repeat(img[:, :, :1], 3, axis=2) if gray else img
    got = resample.resize_lanczos(img, out_h, out_w).astype(int)
    for c in range(3):
        rows = np.array([direct(line, out_w) for line in img[:, :, c].tolist()])
        want = np.array([direct(line, out_h) for line in rows.T.tolist()]).T
        assert np.abs(got[:, :, c] - want).max() <= 1
    assert not gray or (got[:, :, 0] == got[:, :, 2]).all()


def test_constant_images_stay_and_shrinking_does_not_alias():
    assert (resample.resize_lanczos(np.full((31, 17, 3), 77, np.uint8), 256, 256) == 77).all()
    stripes = np.repeat((np.arange(1024) % 2 * 255).astype(np.uint8)[None, :, None], 3, axis=2)
    assert np.abs(resample.resize_lanczos(stripes, 1, 256)[0, 4:-4].astype(int) - 128).max() <= 2


# ---------------------------------------------------------------------- jobs
def files(tmp_path):
    a, b = encode_png(np.full((8, 8), 10, np.uint8)), encode_png(np.full((8, 8), 200, np.uint8))
    for name, data in {"a/scan.png": a, "b/scan.png": b, "a/cut.png": b[:50], "a/x y%20.png": a, "a/foreign.png": b"BM" + bytes(60)}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return a, b


def test_every_row_is_scored_on_its_own_path(spark, tmp_path):
    """Equal names in two folders, one path in two rows, odd names, no file."""
    a, b = files(tmp_path)
    rows = [("a/scan.png", 0.1), ("b/scan.png", 0.1), ("a/scan.png", 0.9), ("a/x y%20.png", 0.1), (f"file:{tmp_path}/b/scan.png", 0.5),
            ("a/none.png", 0.1), ("a/cut.png", 0.1), ("a", 0.1), (None, 0.1), ("", 0.1), ("a/foreign.png", 0.2)]
    df = spark.createDataFrame([(p, v, 0.0, 0.0, 1.0) for p, v in rows],
                               "image_path string, age_norm double, sex_bin double, view_AP double, view_PA double")
    meta = ["age_norm", "sex_bin", "view_AP", "view_PA"]
    job = bulk.batch_score_images(df, sc.channel_meta_factory(), 14, meta, root=str(tmp_path), size=(16, 16))
    got = job.collect()
    model = sc.channel_meta_factory()()

    def score(level, age):
        x = np.full((1, 16 * 16 * 3), level / 127.5 - 1.0, np.float32)
        return np.round(model(x, np.array([[age, 0.0, 0.0, 1.0]]))[0], 5).tolist()

    want = [(p, score({"a": 10, "b": 200}[p.split("/")[-2] if p.startswith("file") else p[0]], v), None) for p, v in rows[:5]]
    want += [(p, None, "Could not read image: " + m) for p, m in (
        ("a/none.png", "no such file"), ("a/cut.png", "image file is truncated"), ("a", "no such file"), (None, "no such file"),
        ("", "no such file"))] + [("a/foreign.png", None, "Invalid image format: BMP. Must be PNG or JPEG.")]
    seen = [(r.image_path, r.predictions and [round(r.predictions[x], 5) for x in LABELS], r.error) for r in got]
    for s, w in zip(sorted(seen, key=str), sorted(want, key=str)):
        assert s[0] == w[0] and s[2] == w[2] and (s[1] == w[1] or np.allclose(s[1], w[1], atol=2e-5))
    plan = job._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "binaryFile" not in plan


def test_tasks_are_cut_by_size(spark, tmp_path):
    """A large file has a task of its own, and one path in very many rows spreads."""
    class Sizes:
        def size(self, path):
            return {"big": 10_000, "none": None}.get(path, 100)

    rows = [("big",)] + [(f"f{i:03d}",) for i in range(200)] + [("hot",)] * 3000 + [("none",), (None,)]
    df = spark.createDataFrame(rows, "p string").repartition(7)
    dealt = fs.dealt_by_size(df, "p", Sizes(), task_bytes=5000, row_cost=10).withColumn("t", F.spark_partition_id())
    got = dealt.collect()
    assert sorted((r.p or "") for r in got) == sorted((r[0] or "") for r in rows)
    cost, seen = {}, set()
    for r in got:
        size = 0 if (r.t, r.p) in seen else Sizes().size(r.p) or 0
        seen.add((r.t, r.p))
        cost[r.t] = cost.get(r.t, 0) + 10 + size
    assert max(c for t, c in cost.items() if t not in {r.t for r in got if r.p == "big"}) <= 5000 + 110 + 200
    assert len({r.t for r in got if r.p == "hot"}) >= 6
    assert fs.dealt_by_size(df.where("false"), "p", Sizes()).count() == 0


@pytest.mark.parametrize("by", ["image_path", "content"])
def test_uploads_by_path_and_by_bytes(spark, tmp_path, by):
    a, b = files(tmp_path)
    jvm_file(spark, tmp_path / "c.jpg", 1, "jpg")
    up = [(1, "Ann", 40, "F", "PA", f"{tmp_path}/a/scan.png"), (2, "Bob", 40, "M", "AP", f"{tmp_path}/b/scan.png"),
          (3, "Cy", 40, "M", "AP", f"{tmp_path}/a/cut.png"), (4, "Di", 400, "F", "PA", f"{tmp_path}/a/scan.png"),
          (5, "Ed", None, "X", "LL", f"{tmp_path}/a/foreign.png"), (6, "Flo", 40, "F", "PA", f"{tmp_path}/c.jpg"),
          (7, "Gus", 40, "F", "PA", f"{tmp_path}/a/scan.png")]
    schema = "idx long, name string, age int, gender string, view string, "
    if by == "content":
        df = spark.createDataFrame([(*u[:5], bytearray(open(u[5], "rb").read())) for u in up], schema + "content binary")
        job = bulk.bulk_image_job(df, sc.channel_meta_factory(), F.lit(DAY).cast("date"), content="content", size=(16, 16))
        assert "Exchange" not in job._jdf.queryExecution().executedPlan().toString()
    else:
        job = bulk.bulk_image_job(spark.createDataFrame(up, schema + "image_path string"), sc.channel_meta_factory(), F.lit(DAY).cast("date"), size=(16, 16))
    rows = job.collect()
    got = {r.idx: r for r in rows}
    assert len(rows) == 7 and [got[i].success for i in range(1, 8)] == [True, True, False, False, False, True, True]
    assert got[1].predictions == got[7].predictions != got[2].predictions and len(got[1].predictions) == 14
    assert got[3].message == "Could not read image: image file is truncated"
    assert got[4].message == "Invalid age: 400. Must be between 0 and 150."
    assert got[5].message == ("Invalid age: None. Must be between 0 and 150.; Invalid gender: X. Must be 'M' or 'F'.; "
                              "Invalid view: LL. Must be 'AP' or 'PA'.; Invalid image format: BMP. Must be PNG or JPEG.")
    image = up[0][5] if by == "image_path" else a
    one = bulk.single_image(spark, image, "Ann", 40, "F", "PA", sc.channel_meta_factory(), "2026-02-09", size=(16, 16)).first()
    assert one.predictions == got[1].predictions and one.source == "web_upload"


def test_scores_that_are_not_finite(spark):
    def nan_factory():
        return sc.with_arity(lambda x, m: np.full((len(x), 14), np.nan), 2)

    bad = bulk.single_image(spark, encode_png(np.zeros((3, 3), np.uint8)), "Ann", 40, "F", "PA", nan_factory, "2026-02-09",
                            size=(16, 16)).first()
    assert not bad.success and bad.message == "The model returned no usable scores"
