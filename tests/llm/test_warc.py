import gzip
import hashlib
import random

from ridgeline.llm import warc
from ridgeline.llm.queries import op9_warc


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    bodies = ["", "x", "same", "é" * 500, *("".join(rng.choices("abc<>\n\0é", k=rng.randrange(3000))) for _ in range(300))]
    rows = [(i, f"http://a/{i}\r\nx", rng.choice(bodies)) for i in range(1500)] + [(None, None, "same"), (2000, "u", None), (2001, "u", "only"), (2001, "u", "only")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    for least in (0, 1, 600):
        path = str(tmp_path / f"w{least}")
        warc.write_warc(pages, path, least=least)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        got = warc.read_warc(spark, path).collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(got) == len(rows)
        largest = {}
        for i, _, body in rows:
            if i is not None:
                largest[body or ""] = max(largest.get(body or "", -1), i)
        by_id = {}
        for r in got:
            by_id.setdefault(r.record_id, []).append(r)
        for i, _, body in rows:
            data = (body or "").encode()
            for r in by_id[f"urn:x-page:{'' if i is None else i}"]:
                assert r.payload_bytes == len(data) and r.payload_digest == warc.base32_sha1(data)
                keeper = largest.get(body or "")
                if len(data) >= least and keeper is not None and keeper != i:
                    assert r.record_type == "revisit" and r.refers_to == f"urn:x-page:{keeper}"
                else:
                    assert r.record_type == "response" and bytes(r.payload) == data and r.refers_to is None


def test_large_ids_and_standard_names(spark, tmp_path):
    """Ids of both signs up to 64 bits; archives of the standard name, read in ranges of 1 KB, from any folder, by any name."""
    ids = [9100000000000000001, 9100000000000000002, -9223372036854775808, 9223372036854775807, -1, 0]
    rows = [(i, f"http://a/{i}", "x" * (300 * (k // 2 + 1))) for k, i in enumerate(ids)]
    noise = random.Random(4)
    rows += [(k, "u", "".join(noise.choices("abcdefgh\n", k=2000))) for k in range(1, 60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    got = {r.page_id: r for r in op9_warc(spark, str(tmp_path)).collect()}
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), str(tmp_path / "w"))
    names = sorted(f.name for f in (tmp_path / "w").iterdir() if f.name.startswith("part-"))
    assert names and all(n.endswith(".warc.gz") for n in names)
    one = b"".join((tmp_path / "w" / n).read_bytes() for n in names)
    for name in ("a.warc.gz", "!.gz", "CC-MAIN-2024~é.warc.gz"):
        (tmp_path / name).write_bytes(one)
        found = warc.read_warc(spark, str(tmp_path / name))
        assert found.count() == len(rows)
    assert found.rdd.getNumPartitions() > 20
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert set(got) == {r[0] for r in rows}
    for k in (0, 2, 4):
        keeper = max(ids[k], ids[k + 1])
        other = min(ids[k], ids[k + 1])
        assert got[other].refers_to == keeper and got[other].record_type == "revisit" and got[keeper].record_type == "response"


def test_very_long_payload(spark, tmp_path):
    body = "".join(random.Random(6).choices("abcdefghijklmnop\n<>é", k=6_000_000))
    warc.write_warc(spark.createDataFrame([(1, "u", body), (2, "u", None)], "page_id long, url string, html string"), str(tmp_path / "w"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert bytes(got["urn:x-page:1"].payload) == body.encode() and got["urn:x-page:2"].payload_bytes == 0


def test_chance_magic_and_damage(spark, tmp_path):
    """Stored (level 0) members whose payload holds the magic, cut by every range."""
    noise = hashlib.sha256(b"1").digest() * 40
    out = b""
    for i in range(40):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + noise + warc.MAGIC + noise + warc.MAGIC * 3
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{i}>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        out += gzip.compress(head + block + b"\r\n\r\n", 0)
    path = tmp_path / "a.warc.data"
    path.write_bytes(out)
    for size in ("997", "2600", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = warc.read_warc(spark, str(path)).collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(r.record_id for r in got) == sorted(f"urn:x-page:{i}" for i in range(40))
    path.write_bytes(out[: len(out) // 2])
    kinds = [r.record_type for r in warc.read_warc(spark, str(path)).collect()]
    assert kinds.count("response") == 20 or kinds.count("corrupt") >= 1


def test_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).collect() == []
