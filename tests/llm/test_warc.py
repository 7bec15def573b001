import hashlib

from quern.llm import store, warc

HTML = "<html>" + "payload " * 30 + "</html>"


def rows():
    out = [(5, "http://a/1", HTML, 1), (3, "http://a/2", HTML, 1), (9, "http://b/3", HTML, 1), (1, "http://c", "tiny", 1), (2, "http://c\n", "tiny", 1), (4, None, None, 1), (6, "u", "", 1), (None, "n", HTML, 1), (3, "http://a/2", HTML, 1)]
    out += [(20 + k, f"http://x/{k}", ("é" * 70000 if k % 5 == 0 else f"page {k} " * 200), 1) for k in range(40)]
    return out


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string, digest int").repartition(3)
    index = warc.write_archive(pages, store.new_dir(spark, "test"))
    got = warc.read_archive(index).collect()
    assert len(got) == len(rows())
    low: dict = {}
    for i, _, h, _ in rows():
        if i is not None and len((h or "").encode()) >= 100:
            low[h] = min(low.get(h, i), i)
    for i, _, h, _ in rows():
        r = next(x for x in got if x.page_id == i)
        data = (h or "").encode()
        other = low[h] if h in low and (i is None or i > low[h]) else None
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if other is not None else "response", other)
        assert bytes(r.payload or b"") == (b"" if other is not None else data)
    # one record by its place, without reading the others
    for place in index.collect()[:10]:
        fields, _ = warc.read_record(place.bundle, place.frame, place.at)
        assert fields.get("Page-ID") == (None if place.page_id is None else str(place.page_id))


def test_payload_without_ids(spark):
    """Rows without an id revisit the smallest one; where no row has an id, all are responses."""
    pages = spark.createDataFrame([(None, "u", HTML), (None, "u", HTML), (None, "v", HTML + "x"), (7, "w", HTML + "x")], "page_id long, url string, html string")
    got = warc.read_archive(warc.write_archive(pages, store.new_dir(spark, "test"))).collect()
    assert sorted((r.payload_bytes - len(HTML), r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (0, "response", 0), (1, "response", 0), (1, "revisit", 7)]


def test_whole_file_is_plain_zstd(spark):
    import io

    import zstandard

    pages = spark.createDataFrame(rows()[:4], "page_id long, url string, html string, digest int").coalesce(1)
    name = warc.write_archive(pages, store.new_dir(spark, "test")).first().bundle
    data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(store.get(name)), read_across_frames=True).read()
    at, n = 0, 0
    while at < len(data):
        _, _, at = warc.parse(data, at)
        n += 1
    assert n == 4


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write_archive(pages, store.new_dir(spark, "test"))
    assert index.count() == 0 and warc.read_archive(index).count() == 0
