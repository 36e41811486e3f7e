import gzip
import hashlib
import random
from collections import Counter

import duckdb

from gatewright.llm import warc
from gatewright.llm.queries import ORACLE_SQL

LONG = "<p>" + "ä" * 700
SCHEMA = "page_id long, url string, html string, shard int"
ROWS = [(i, f"http://x/{i}?a=b c\n", f"<html>{i}" + "y" * (i * 37 % 1500), 1) for i in range(60)]
ROWS += [(100 + i, "u", LONG, 1) for i in range(9)] + [(108, "v", LONG, 1), (108, "v", LONG, 1)]
ROWS += [(200, None, None, 1), (201, "u", "", None), (None, None, LONG, 1), (None, "n", "short", 1), (202, "s", "short", 1), (203, "t", "short", 1)]


def expected():
    top = max(r[0] for r in ROWS if r[2] == LONG and r[0] is not None)
    first = True
    for i, _, html, _ in ROWS:
        data = (html or "").encode()
        revisit = html == LONG
        if revisit and i == top and first:
            revisit = first = False
        yield i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    bytes_of = []
    for name, options, parts in (("a", {}, 3), ("b", {}, 5), ("c", {"shard_bytes": 3000, "roll_bytes": 700}, 3)):
        folder = f"file://{tmp_path}/{name}"
        manifest = warc.write_archives(spark, df.repartition(parts), folder, **options).collect()
        got = warc.read_archives(spark, folder).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(expected())
        assert sum(m.records for m in manifest) == len(ROWS) and len({m.file for m in manifest}) == len(manifest)
        files = {m.file: (tmp_path / name / m.file).read_bytes() for m in manifest}
        assert all(hashlib.sha256(files[m.file]).hexdigest() == m.sha256 for m in manifest)
        assert not (tmp_path / name / "_temporary").exists()
        bytes_of.append({m.file: m.sha256 for m in manifest})
        ids = [line for f in files.values() for line in gzip.decompress(f).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
        assert len(ids) == len(ROWS)
    assert bytes_of[0] == bytes_of[1] and len(bytes_of[2]) > 10


def test_order_within_files(spark, tmp_path):
    warc.write_archives(spark, spark.createDataFrame(ROWS[:60], SCHEMA), f"file://{tmp_path}/o", shard_bytes=20_000)
    seen = []
    for file in sorted((tmp_path / "o").glob("*.warc.gz")):
        with file.open("rb") as stream:
            seen += [warc.parse(m)["page_id"] for m in warc.members(stream)]
    assert seen == sorted(seen) == list(range(60))


def ids_by_file(folder):
    for file in sorted(folder.glob("*.warc.gz")):
        with file.open("rb") as stream:
            yield [warc.parse(m)["page_id"] for m in warc.members(stream)]


def test_files_follow_ids_whatever_their_span(spark, tmp_path):
    """One id far from the rest, and ids over all 64 bits, leave files in the order of ids; sizes stay even."""
    for name, ids in (("far", [*range(4000), 10**15]), ("wide", [-(2**63), *range(-500, 500), 2**63 - 1])):
        df = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}" + "z" * 200) for i in ids], "page_id long, url string, html string")
        manifest = warc.write_archives(spark, df, f"file://{tmp_path}/{name}", shard_bytes=100_000).collect()
        seen = list(ids_by_file(tmp_path / name))
        assert sum(seen, []) == sorted(ids)
        assert len(seen) == len(manifest) > 5 and max(map(len, seen)) < 4 * len(ids) / len(seen)


def test_a_hot_id_is_spread(spark, tmp_path):
    """Records of one id and rows alike in all are divided between shards, with equal bytes under any partitioning."""
    rows = [(None, f"u{i}", f"<p>{i}" + "q" * 300) for i in range(1500)] + [(7, "same", "short")] * 2500 + [(8, "long", "w" * 1200)] * 2100 + [(i, "u", f"{i}") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = []
    for name, parts in (("a", 2), ("b", 7)):
        folder = f"file://{tmp_path}/{name}"
        manifest = warc.write_archives(spark, df.repartition(parts), folder, shard_bytes=200_000).collect()
        kept.append({m.file: m.sha256 for m in manifest})
        got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect())
        assert got[7, 5, "response", None] == 2500 and got[8, 1200, "response", None] == 1 and got[8, 1200, "revisit", 8] == 2099 and got.total() == len(rows)
        names = [line for f in (tmp_path / name).glob("*.gz") for line in gzip.decompress(f.read_bytes()).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
        assert len(set(names)) == len(rows)
    assert kept[0] == kept[1] and max(len([i for i in x if i == 7]) for x in ids_by_file(tmp_path / "a")) <= 2000


def test_rolls_by_compressed_size_with_the_defaults(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "u", rng.randbytes(3000).hex()) for i in range(1300)]
    manifest = warc.write_archives(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/r").collect()
    assert len(manifest) > len({m.file.split("-")[1] for m in manifest}) and all(m.bytes < warc.ROLL_BYTES[0] + 10_000 for m in manifest)


def test_a_long_payload_and_clashing_columns(spark, tmp_path):
    long = "<p>ä" + "xyz " * 700_000
    df = spark.createDataFrame([(1, "u", long, "a", 1), (2, "u", long, "b", 2)], "page_id long, url string, html string, content string, place int")
    warc.write_archives(spark, df, f"file://{tmp_path}/l")
    got = {r.page_id: r for r in warc.read_archives(spark, f"file://{tmp_path}/l").collect()}
    assert got[2].payload == long and got[1].refers_to == 2 and got[1].payload_digest == hashlib.sha1(long.encode()).hexdigest()


def test_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.write_archives(spark, empty, f"file://{tmp_path}/e").count() == 0
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet'")
        assert sorted(map(tuple, warc.op10_warc(spark, sf).collect()), key=str) == sorted(con.sql(ORACLE_SQL["op10_warc"]).fetchall(), key=str)
