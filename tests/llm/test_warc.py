import base64
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from tarnwatch.llm import warc
from tarnwatch.llm.common import new_folder


def brute(rows, least=0):
    first = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if page is not None and len(payload) >= least:
            first[payload] = min(page, first.get(payload, page))
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        again = len(payload) >= least and payload in first and first[payload] != page
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "revisit" if again else "response", first[payload] if again else None))
    return sorted(out, key=str)


def rows():
    rng = random.Random(4)
    out = [(1, None, None), (2, "http://a.com/", ""), (3, "no scheme", "<p>é\r\n\r\nx</p>"), (None, "http://a.com/", "<p>null id</p>"), (5, "http://u ser@B.com:80/x y\n?q#f", "z" * 300_000), (6, "http://a.com/", "<p>null id</p>")]
    out += [(-7, "http://a.com/", "neg"), (8, "http://c.org/", "dup row"), (8, "http://c.org/", "dup row")]
    out += [(100 + i, "http://hot.org/same", rng.choice(["same page", f"own {i}"])) for i in range(120)]
    out += [(1000 + i, f"http://h{rng.randrange(9)}.x.com/{i}", f"body {rng.random()}") for i in range(80)]
    rng.shuffle(out)
    return out


def read_back(spark, df, lines=7, **more):
    folder = new_folder(spark, "warc-test")
    captures = warc.write_archive(df, folder, **more)
    index = warc.build_index(captures, lines_each=lines)
    wanted = df.select("page_id", "url").distinct().mapInArrow(warc._keys, "key string")
    return folder, captures, index, warc.fetch(warc.lookup(index, wanted), folder)


def test_round_trip_through_the_index(spark):
    data = rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "'x' AS key", "1 AS first", "2 AS digest")
    _, captures, index, out = read_back(spark, df)
    got = out.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(data)
    assert sorted(bytes(r.payload) for r in got if r.record_type == "response") == sorted((h or "").encode() for (p, _, h), b in zip(sorted(data, key=str), [0] * len(data)) if any(x[0] == p and x[3] == "response" and x[1] == len((h or "").encode()) for x in brute(data)))
    blocks = index.orderBy("first_key").collect()
    assert len(blocks) > 20 and sum(b.n for b in blocks) == len(data) and max(b.n for b in blocks) == 7
    assert captures.count() == len(data)


def test_least_bytes_missing_keys_and_empty_table(spark):
    data = rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    _, _, index, out = read_back(spark, df, revisit_from=9)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()), key=str) == brute(data, 9)
    none = spark.createDataFrame([("zz,nowhere)/ 1",), ("",), ("com,a)/ ",)], "key string")
    assert warc.lookup(index, none).count() == 0
    _, _, index, out = read_back(spark, df.limit(0))
    assert index.count() == 0 and out.count() == 0


def test_files_are_gzip_members_of_warc_records(spark):
    df = spark.createDataFrame([(1, "http://a.com/", "x"), (2, "http://b.com/", "x")], "page_id long, url string, html string").coalesce(1)
    folder, captures, _, _ = read_back(spark, df)
    files, path = warc.filesystem(folder)
    raw = b""
    for name in {r.file for r in captures.collect()}:
        raw += gzip.decompress(files.open_input_stream(f"{path}/{name}", compression=None).read())
    assert raw.count(b"WARC/1.1\r\n") == 2 and b"WARC-Type: revisit" in raw and b"WARC-Refers-To: <urn:page:1>" in raw
    assert captures.filter(F.col("at") == 0).count() >= 1


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a b?c#d") == "com,example,www:80)/a%20b?c"
    assert warc.url_key(None) == ")" and warc.url_key("x") == "x)"
    assert warc.capture_key("http://a.b/", -1) < warc.capture_key("http://a.b/", 0) < warc.capture_key("http://a.b/", 5)


def test_a_lookup_reads_its_blocks_only(spark):
    data = rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    _, _, index, _ = read_back(spark, df)
    key = warc.capture_key("http://hot.org/same", 150)
    ask = spark.createDataFrame([(key,), (key,), ("zz,nowhere)/ 1",), (None,)], "key string")
    blocks = warc.blocks_of(index, ask).collect()
    assert len(blocks) == 1 and blocks[0].asks == 2 and blocks[0].key == key
    found = warc.lookup(index, ask).collect()
    assert len(found) == 2 and {r.key for r in found} == {key}
    assert "data" not in index.columns and index.count() > 20


def test_a_bare_path_is_one_of_the_default_file_system(spark, tmp_path):
    from tarnwatch.llm.common import qualified

    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.store.link./shared", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://store/")
    try:
        assert qualified(spark, "/shared/ckpt/") == "viewfs://store/shared/ckpt"
        assert qualified(spark, "s3a://bucket/x") == "s3a://bucket/x"
    finally:
        conf.set("fs.defaultFS", before)
    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_html_stays_where_it_is_read(spark, monkeypatch):
    """Both ways to tell revisits give the same records; the broadcast one shuffles no html."""
    data = rows() + [(None, "http://n.com/", "same page"), (None, None, "same page"), (100, "http://other.org/", "same page")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(5)
    seen, made = [], warc.responses

    def watched(*tables):
        seen.append(made(*tables))
        return seen[-1]

    monkeypatch.setattr(warc, "responses", watched)
    digests = []
    for bound in (1_000_000, 1):
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", bound)
        out = read_back(spark, df)[3].collect()
        digests.append(sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str))
    assert digests[0] == digests[1] == brute(data)
    source = plan(df).count("Exchange")
    assert "BroadcastHashJoin" in plan(seen[0]) and plan(seen[0]).count("Exchange hashpartitioning") == 0 and source == 1
    assert "Exchange hashpartitioning" in plan(seen[1])
