import struct

from detframe.sources.files import image_sizes
from detframe.sources.headers import ImageHeaders


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02\x00\x00\x00" + bytes(3_000_000)


def jpeg(w, h, blocks=3):
    parts = b"".join(b"\xff\xe1" + struct.pack(">H", 65_000) + bytes(64_998) for _ in range(blocks))
    return b"\xff\xd8" + parts + b"\xff\xff\xff\xc2" + struct.pack(">HBHH", 11, 8, h, w) + bytes(2_000_000)


def test_sizes_come_from_a_few_bytes(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    files = {"a.png": png(640, 480), "deep/b.jpg": jpeg(31, 17, 8), "deep/er/c.JPG": jpeg(5, 6, 0), "d.txt": b"no image", "e.png": b"", "f.jpg": b"\xff\xd8\xff\xe1\x00"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = {"a.png": (640, 480), "b.jpg": (31, 17), "c.JPG": (5, 6), "d.txt": (-1, -1), "e.png": (-1, -1), "f.jpg": (-1, -1)}
    spark.dataSource.register(ImageHeaders)
    for per_task in ("1", "256"):
        rows = spark.read.format("image_headers").option("filesPerTask", per_task).load(str(tmp_path)).collect()
        assert {r.file_name: (r.width, r.height) for r in rows} == want
        assert max(r.bytes_read for r in rows) <= 24 + 9 * 12, "nothing but marker heads is read"
    assert {r.file_name for r in spark.read.format("image_headers").option("suffixes", ".jpg").load(str(tmp_path)).collect()} == {"b.jpg", "c.JPG", "f.jpg"}
    assert spark.read.format("image_headers").option("suffixes", ".gif").load(str(tmp_path)).count() == 0


def test_name_lists(spark, tmp_path):
    (tmp_path / "images").mkdir()
    for k in range(3):
        (tmp_path / "images" / f"{k}.png").write_bytes(png(10 + k, 20))
    (tmp_path / "names.txt").write_text("0.png\n\n2.png\n")
    (tmp_path / "names.csv").write_text("file,label\n1.png,x\n0.png,y\n")
    got = lambda names: {(r.file_name, r.width, r.height) for r in image_sizes(spark, str(tmp_path / "images"), str(tmp_path / names)).collect()}
    assert got("names.txt") == {("0.png", 10, 20), ("2.png", 12, 20)} and got("names.csv") == {("1.png", 11, 20), ("0.png", 10, 20)}
    assert image_sizes(spark, str(tmp_path / "images")).count() == 3
