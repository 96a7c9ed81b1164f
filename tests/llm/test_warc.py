import hashlib
import io
from collections import Counter

import zstandard

from lexloom.llm import files, warc
from lexloom.plans import scale

SCHEMA = "page_id bigint, url string, html string, payload string, keep int"


def pages(spark):
    big, other = "<p>copy</p>" * 200, "é" * 600
    rows = [(i, f"http://h/{i}", big) for i in (3, 9, 1, 7)] + [(i, None, other) for i in (20, 21)]
    rows += [(30, "http://x/%0A\n y", "small"), (31, "u", "small"), (32, "u", None), (33, "u", ""), (None, None, None), (None, "u", big)]
    rows += [(9, "again", big), (40, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 90), (41, "u", "z" * 3_000_000)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3), rows


def test_archives_read_back(spark):
    df, rows = pages(spark)
    index = warc.write_archives(df, scale.scratch_path(spark, "warc"), frame_bytes=5000, bundle_bytes=2000)
    got = warc.read_archives(index).collect()
    keep = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            keep[data] = max(i, keep.get(data, i))
    several = Counter((html or "").encode() for _, _, html in rows)
    want = Counter()
    for i, url, html in rows:
        data = (html or "").encode()
        refers = keep.get(data) if several[data] > 1 and keep.get(data) != i else None
        kind = "response" if refers is None else "revisit"
        want[(i, len(data), hashlib.sha1(data).hexdigest(), kind, refers, url)] += 1
    assert Counter(map(tuple, got)) == want


def test_one_record_costs_one_frame(spark):
    df, _ = pages(spark)
    index = warc.write_archives(df, scale.scratch_path(spark, "warc"), frame_bytes=3000)
    some = spark.createDataFrame([(7,), (30,), (41,), (99,)], "page_id bigint")
    assert sorted(r.page_id for r in warc.read_records(index, some).collect()) == [7, 30, 41]
    for r in index.select("bundle").distinct().collect():
        # Any Zstandard reader can read a bundle: the seek table is a skippable frame.
        raw = files.read_range(r.bundle)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        places = warc.frame_places(r.bundle)
        assert len(whole) == sum(p[2] for p in places)
        assert sum(1 for _ in warc.parse(whole)) == index.where(index.bundle == r.bundle).count()


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    index = warc.write_archives(none, scale.scratch_path(spark, "warc"))
    assert warc.read_archives(index).count() == 0
