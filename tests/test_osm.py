import gzip
import random

import pytest
from pyspark.sql import functions as F

from netresil.sources import osm as O
from netresil.sources.networks import read_osm


def extract(seed: int, n: int = 60) -> tuple[str, list, list]:
    """An extract with elements in all the shapes OSM files have; its nodes and ways."""
    rnd = random.Random(seed)
    text, nodes, ways = ['<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6">\n <!-- nodes & ways -->\n <bounds minlat="1"/>\n'], [], []
    for i in range(n):
        lat, lon = (None, None) if rnd.random() < 0.1 else (round(rnd.uniform(22, 24), 5), round(rnd.uniform(71, 73), 5))
        at = "" if lat is None else f" lat='{lat}' lon=\"{lon}\""
        text.append(f' <node id="{i}"{at}' + rnd.choice(["/>", " />\n", '>\n  <tag k="name" v="café &lt;way &gt; &#10;अ"/>\n </node>\n', "></node>"]))
        nodes.append((i, lat, lon))
    for i in range(n // 2):
        refs = [rnd.randrange(n) for _ in range(rnd.choice([0, 1, 2, 5, 40]))]
        tags = rnd.choice([[], [("highway", "primary")], [("name", "A & B"), ("highway", "residential")]])
        body = "".join(f'\n  <nd ref="{r}"/>' for r in refs) + "".join(f'<tag k="{k}" v="{v.replace("&", "&amp;")}"/>' for k, v in tags)
        text.append(f' <way\n id="{i}">{body}</way>' if body else f'<way id="{i}"/>')
        ways.append((i, refs, tags))
        if rnd.random() < 0.2:
            text.append(f'<relation id="{i}"><member type="node" ref="1" role=""/><member type="way" ref="2" role=""/></relation>\n')
    text.append("</osm>\n")
    return "".join(text), nodes, ways


def rows(reader) -> list[dict]:
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("chunk", [1, 13, 64, 1 << 20])
def test_every_cut_gives_every_element_once(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(O, "CHUNK_BYTES", chunk)
    text, nodes, ways = extract(chunk, 20)
    (tmp_path / "a.osm").write_text(text)
    for step in (7, 50, 333, 1 << 20):
        got = rows(O.OsmReader(str(tmp_path), "node", step))
        assert [(r["id"], r["lat"], r["lon"]) for r in got] == nodes
        got = rows(O.OsmReader(str(tmp_path), "way", step))
        assert [(r["id"], r["refs"], [(t["k"], t["v"]) for t in r["tags"]]) for r in got] == ways


def test_one_file_takes_many_tasks_and_agrees_with_one(spark, tmp_path):
    (tmp_path / "a.osm").write_text(extract(1)[0])
    spark.dataSource.register(O.OsmSource)
    raw = spark.read.format("osm_xml").option("path", str(tmp_path)).option("element", "way").option("rangeBytes", 500).load()
    assert raw.rdd.getNumPartitions() > 5
    assert raw.select(F.spark_partition_id()).distinct().count() > 3
    frames = [read_osm(spark, str(tmp_path), range_bytes=step) for step in (300, 1 << 26)]
    for few, many in zip(*frames):
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and not few.isEmpty()


def test_same_elements_as_the_xml_reader(spark, tmp_path):
    (tmp_path / "a.osm").write_text(extract(2)[0])
    spark.dataSource.register(O.OsmSource)
    got = spark.read.format("osm_xml").option("rangeBytes", 400).load(str(tmp_path)).collect()
    want = spark.read.format("xml").option("rowTag", "node").schema("_id BIGINT, _lat DOUBLE, _lon DOUBLE").load(str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))


def test_folders_patterns_compressed_and_empty_files(tmp_path):
    for name, seed in (("a.osm", 1), ("sub/b.osm", 2)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(extract(seed, 10)[0])
    (tmp_path / "c.osm.gz").write_bytes(gzip.compress(extract(3, 10)[0].encode()))
    for name, text in (("_SUCCESS", "no"), (".x.crc", "no"), ("empty.osm", ""), ("none.osm", "<osm></osm>")):
        (tmp_path / name).write_text(text)
    count = lambda path: len(rows(O.OsmReader(path, "node", 100)))
    assert count(str(tmp_path)) == 30 and count(f"{tmp_path}/*.gz") == 10 and count(f"file://{tmp_path}/a.osm") == 10
    assert count(f"{tmp_path}/none.osm") == 0 and count(f"{tmp_path}/*.nothing") == 0
    with pytest.raises(FileNotFoundError):
        count(f"{tmp_path}/missing.osm")
    (tmp_path / "bad.osm").write_text('<osm><node id="1"><tag></node></osm>')
    with pytest.raises(ValueError, match="bad.osm"):
        count(f"{tmp_path}/bad.osm")
    (tmp_path / "bad.osm").write_text('<osm><node id="x" lat="?"/></osm>')
    assert rows(O.OsmReader(f"{tmp_path}/bad.osm", "node", 100)) == [{"id": None, "lat": None, "lon": None}]


def test_small_files_share_a_task(tmp_path, monkeypatch):
    monkeypatch.setattr(O, "CHUNK_BYTES", 4096)
    want = []
    for i in range(300):
        text, nodes, _ = extract(i, 3)
        (tmp_path / f"{i:03d}.osm").write_text(text)
        want += nodes
    (tmp_path / "empty.osm").write_text("")
    size = sum(f.stat().st_size for f in tmp_path.iterdir())
    reader = O.OsmReader(str(tmp_path), "node", 1 << 26)
    assert len(reader.partitions()) <= 2 * size // 4096 + 1
    assert [(r["id"], r["lat"], r["lon"]) for r in rows(reader)] == want
    # a large file is cut as before, a compressed one has a task of its own
    with gzip.open(tmp_path / "zz.osm.gz", "wt") as f:
        f.write(extract(5, 4)[0])
    shares = O.OsmReader(str(tmp_path), "node", 500).partitions()
    assert all(sum((r.end or 500) - r.start for r in s.ranges) <= 500 for s in shares)
    assert [r.path for r in shares[-1].ranges] == [str(tmp_path / "zz.osm.gz")]
