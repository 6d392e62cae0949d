import gzip
import random
import time

from oracle import compare

from hushframe.llm.warc import MAGIC, Memory, Window, files_in, pages_of, read_warc, record, write_warc

INNER = record(99, "u", "inner").decode()


def sequential(data: bytes):
    """(offset, length) of records walked from the start."""
    out, at = [], 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        n = int([ln for ln in data[at:head].split(b"\r\n") if ln.lower().startswith(b"content-length")][0].split(b":")[1])
        out.append((at, head + 4 + n + 4 - at))
        at += out[-1][1]
    return out


def test_query_matches_sql(spark):
    assert compare(spark, "op10_warc") > 0


ROWS = [(1, "http://a/å b", "x", "e"), (1, "http://a/å b", "x", "e"), (2, None, INNER * 3, "e"), (None, "u", None, "e"), (3, "", "", "e"), (4, "u", "y" * 300_000 + INNER + "z", "e"), (5, "u", "WARC/1.0\r\nContent-Length: 5\r\n\r\n", None), (6, "u", "\r\n\r\nWARC/1.0\r\n", "e")]


def test_small_ranges_against_sequential_walk(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, meta string").repartition(2)
    folder = str(tmp_path / "w")
    write_warc(df, folder).collect()
    files = files_in(spark, folder)
    for split in (97, 4096, 1 << 23):
        got = read_warc(files, split_bytes=split).collect()
        for f in files.collect():
            data = open(f.file, "rb").read()
            assert data.count(MAGIC) >= len(sequential(data))
            assert sorted((r.offset, r.length) for r in got if r.file == f.file) == sequential(data)
        pages = pages_of(read_warc(files, split_bytes=split)).collect()
        assert sorted(map(tuple, pages), key=repr) == sorted([r[:3] for r in ROWS], key=repr)


def test_edges(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, meta string")
    folder = str(tmp_path / "w")
    write_warc(df.where("false").coalesce(1), folder).collect()
    (tmp_path / "w").mkdir(exist_ok=True)  # no rows can mean no task and so no folder
    (tmp_path / "w" / "empty.warc").write_bytes(b"")
    (tmp_path / "w" / "other.warc").write_bytes(b"no record\r\n" + record(1, "u", "t"))
    (tmp_path / "w" / "cut.warc").write_bytes(record(1, "u", "t") + record(2, "u", "t" * 50)[:-20])
    pages = pages_of(read_warc(files_in(spark, folder), split_bytes=64)).collect()
    assert [tuple(r) for r in pages] == [(1, "u", "t")]
    assert files_in(spark, str(tmp_path / "none")).count() == 0


def test_gzip_members_against_plain_files(spark, tmp_path):
    rng = random.Random(1)
    quoted = gzip.compress(record(98, "u", "quoted")).decode("latin-1")
    rows = [*ROWS, (7, "u", "".join(rng.choice(quoted) for _ in range(4000)), "e"), (8, "u", quoted * 20, "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, meta string").repartition(2)
    folder = str(tmp_path / "z")
    write_warc(df, folder, compress=True).collect()
    both = gzip.compress(record(9, "u", "first") + record(10, "u", "second")) + gzip.compress(b"no record") + gzip.compress(record(11, "u", "after what isn't one"))
    (tmp_path / "z" / "stored.warc.gz").write_bytes(gzip.compress(record(12, "u", quoted), 0) + both)
    for split in (61, 1000, 1 << 23):
        pages = pages_of(read_warc(files_in(spark, folder), split_bytes=split)).collect()
        assert sorted(map(tuple, pages), key=repr) == sorted([*[r[:3] for r in rows], (12, "u", quoted), (9, "u", "first"), (10, "u", "second")], key=repr)


def test_hostile_magic_takes_time_in_proportion():
    for payload in (b"WARC/1." * 1_200_000, b"WARC/1.0\r\n" * 800_000, b"WARC/1.0\r\nA: b\r\n" * 500_000, b"WARC/1.0\r\nA: " + b"x" * (8 << 20)):
        w, began, i, n = Window(Memory(payload), 0, len(payload), len(payload)), time.time(), 0, 0
        while (i := payload.find(MAGIC, i)) >= 0:
            n += w.header(i) is not None
            i += 1
        assert n == 0 and time.time() - began < 30
