import base64
import gzip
import hashlib

from inkmark.llm.arrow import file_system
from inkmark.llm.warc import op2_warc, read_warc, write_warc
from inkmark.session import scratch_path


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def want(pages, min_bytes=0):
    largest = {}
    for page, _, html in pages:
        if page is not None:
            largest[html or ""] = max(page, largest.get(html or "", page))
    out = []
    for page, _, html in pages:
        payload = (html or "").encode()
        first = largest.get(html or "")
        revisit = len(payload) >= min_bytes and first is not None and first != page
        out.append((page is None, page or 0, len(payload), sha(payload), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def got(rows):
    return sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


PAGES = [
    (None, "u", "a b"), (5, None, "a b"), (5, "v", "a b"), (7, "x", ""), (8, "y\r\nz", None), (3, "q", "a b"), (9, "t", "ü" * 5),
    (10, "h", "WARC/1.1\r\n\r\nnested\r\n\r\n"), (11, "long", "<p>x</p>" * 200_000), (-4, "n", "only"), (None, None, None),
]


def test_records_of_odd_rows(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 AS sha", "2 AS shard", "3 AS first")
    for min_bytes in (0, 3, 4):
        path = scratch_path(spark, "warc")
        manifest = write_warc(pages, path, range_bytes=3, roll_bytes=100, min_bytes=min_bytes)
        assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
        assert got(read_warc(spark, path).collect()) == want(PAGES, min_bytes)
    empty = scratch_path(spark, "warc")
    write_warc(pages.limit(0), empty)
    assert read_warc(spark, empty).collect() == []


def test_equal_input_gives_equal_files(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    contents = []
    for parts in (1, 5):
        path = scratch_path(spark, "warc")
        names = [r.file for r in write_warc(pages.repartition(parts), path, range_bytes=4000, roll_bytes=600).collect()]
        system, root = file_system(f"{path}/files")
        contents.append({n: system.open_input_file(f"{root}/{n}").read() for n in names})
    assert contents[0] == contents[1]
    assert len(contents[0]) > 1
    assert all(gzip.decompress(c).startswith(b"WARC/1.1\r\n") for c in contents[0].values())


def test_op2_equals_brute_force(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(op2_warc(spark, sf_dir).collect()) == want(pages)
