"""Readers on real files: byte ranges of block gzip and of records, and the order of lines."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from contactspark.genome import Genome
from contactspark.operators import contacts
from contactspark.plans import catalog
from contactspark.sources import ranges, text

GENOME = Genome((("chr1", 1_000_000), ("chr2", 2_000_000)))


def bgzf(path, raw, block=100):
    parts = [ranges.bgzf_block(raw[k : k + block]) for k in range(0, len(raw), block)]
    path.write_bytes(b"".join(parts) + ranges._LAST)
    assert gzip.decompress(path.read_bytes()) == raw  # any gzip reader reads it
    return str(path)


def texts():
    r = random.Random(1)
    line = lambda n: "".join(r.choice("abc \té") for _ in range(n)) + "x"
    yield "one line without end"
    yield "\n"
    yield "\n\n\na\n\n"
    yield "a\n" * 500
    yield "\n".join(line(r.choice([0, 3, 40, 700])) for _ in range(200)) + "\n"
    yield "\n".join(line(r.choice([5000, 3])) for _ in range(20))
    yield "x" * 99 + "\n" + "y" * 99 + "\n" + "z" * 100  # line feeds at blocks' ends


@pytest.mark.parametrize("size", [1, 50, 137, 1000, 1 << 20])
def test_ranges_give_each_line_once(tmp_path, size):
    for k, t in enumerate(texts()):
        path = bgzf(tmp_path / f"{k}.gz", t.encode())
        n = (tmp_path / f"{k}.gz").stat().st_size
        got = [x for at in range(0, n, size) for run in ranges.range_lines(path, at, min(at + size, n), together=64) for x in run]
        assert got == t.removesuffix("\n").encode().split(b"\n") if t.strip("\n") else [x for x in got if x] == [], k


def test_bgzf_is_told_from_gzip(tmp_path):
    assert ranges.is_bgzf(bgzf(tmp_path / "a.gz", b"text"))
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"text"))
    assert not ranges.is_bgzf(str(tmp_path / "b.gz"))
    noise = random.Random(2).randbytes(70_000)  # what can't be compressed still fits a block
    assert gzip.decompress(ranges.bgzf_block(noise[:65_280])) == noise[:65_280]


def test_a_bgzf_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE", 2000)
    monkeypatch.setattr(ranges.read_lines, "__defaults__", (2000,))
    r = random.Random(3)
    lines = ["# comment", ""] + [f"0 chr{r.randint(1, 3)} {r.randrange(10**6)} {k} 1 chr2 {r.randrange(10**6)} 1" for k in range(3000)]
    raw = ("\n".join(lines) + "\n").encode()
    (tmp_path / "plain.mnd").write_bytes(raw)
    path = bgzf(tmp_path / "packed.mnd.gz", raw, 3000)
    plain, packed = (text.read_pairs(spark, p, GENOME) for p in (f"{tmp_path}/plain.mnd", path))
    assert packed.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, plain.collect())) and plain.count() > 1500
    order = text.read_pairs(spark, path, GENOME, ordinal=True).orderBy("ordinal").select("frag1").collect()
    assert [x.frag1 for x in order] == [int(x.split()[3]) for x in lines[2:] if x.split()[1] != "chr3"]


def test_lines_are_written_as_bgzf(spark, tmp_path):
    rows = [f"{k} {'é' * (k % 50)}" for k in range(20_000)]
    (tmp_path / "out").mkdir()
    ranges.write_lines(spark.createDataFrame([(x,) for x in rows], "value string").repartition(3), f"{tmp_path}/out")
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == 3 and all(ranges.is_bgzf(str(f)) for f in files)
    assert sorted(x for f in files for x in gzip.decompress(f.read_bytes()).decode().splitlines()) == sorted(rows)


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "200b", "spark.sql.files.openCostInBytes": "1b"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_ordinals_follow_files_and_their_lines(spark, tmp_path, small_splits):
    want = []
    for name, n in (("b", 40), ("a", 90), ("c", 1)):
        (tmp_path / f"{name}.txt").write_text("".join(f"chr1 {k} chr2 {len(want)}\n" for k in range(n)))
    for name, n in (("a", 90), ("b", 40), ("c", 1)):
        want += [(name, k) for k in range(n)]
    read = text.read_pairs(spark, str(tmp_path), GENOME, "short", ordinal=True)
    assert read.rdd.getNumPartitions() > 5
    got = [(r.file.rsplit("/", 1)[1][0], r.pos1) for r in read.orderBy("ordinal").select("ordinal.file", "pos1").collect()]
    assert got == want


def test_contiguity_in_the_order_of_a_file(spark, tmp_path, small_splits):
    lines = lambda keys: "".join(f"0 chr{a} 5 0 0 chr{b} 9 1\n" for a, b in keys)
    read = lambda name, keys: contacts.canonical(text.read_pairs(spark, _written(tmp_path / f"{name}.mnd", lines(keys)), GENOME, ordinal=True))
    runs = [(1, 1)] * 40 + [(1, 2)] * 3 + [(2, 2)] * 60
    contacts.require_contiguous(read("good", runs))
    contacts.require_contiguous(read("turned", [(2, 1) if k == (1, 2) and n % 2 else k for n, k in enumerate(runs)]))
    with pytest.raises(ValueError, match="1-1 appears in multiple blocks"):
        contacts.require_contiguous(read("bad", [(1, 1), (1, 2), (1, 1)]))
    with pytest.raises(ValueError, match="1-2 appears in multiple blocks"):
        contacts.require_contiguous(read("late", runs + [(1, 2)] * 30 + [(2, 2)]))
    first = contacts.first_appearance(read("order", [(2, 2), (1, 2), (1, 1), (2, 2)])).orderBy("place").collect()
    assert [tuple(r) for r in first] == [(2, 2, 1), (1, 2, 2), (1, 1, 3)]
    assert contacts.scattered_groups(read("none", [])).count() == 0


def test_first_appearance_sorts_no_lines(spark, tmp_path):
    read = text.read_pairs(spark, _written(tmp_path / "x.mnd", "0 chr1 5 0 0 chr2 9 1\n"), GENOME, ordinal=True)
    plan = contacts.first_appearance(read)._jdf.queryExecution().executedPlan().toString()
    nodes = [line for line in plan.split("\n") if "Aggregate(" in line]
    assert "HashAggregate" in nodes[-1] and "partial_min(" in nodes[-1]  # the one next to the lines


def test_files_of_a_larger_table_are_more_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 200, raising=False)  # of some 6000
    read = catalog._sorted_file(spark, "/root/testdata/sf0.001")
    per = [r["count"] for r in read.groupBy("ordinal.file").count().collect()]
    assert len(per) > 20 and max(per) < 600
    key = ("pos1", "pos2", "chr1", "chr2")
    got = [tuple(r) for r in read.orderBy("ordinal").select(*key).collect()]
    assert got == sorted(got) and len(got) == sum(per)


def _written(path, content):
    path.write_text(content)
    return str(path)


def test_records_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE", 1000)
    rows = [(1 + k % 2, k, 2, 7 * k, float(k)) for k in range(500)]
    (tmp_path / "a.bn").write_bytes(b"".join(struct.pack("<iiiif", *r) for r in rows[:333]))
    (tmp_path / "b.bn").write_bytes(b"".join(struct.pack("<iiiif", *r) for r in rows[333:]))
    (tmp_path / "empty.bn").write_bytes(b"")
    read = text.read_pairs(spark, f"{tmp_path}/*.bn", GENOME)
    assert read.rdd.getNumPartitions() > 5
    assert sorted(tuple(r) for r in read.select("chr1", "pos1", "chr2", "pos2", "score").collect()) == sorted(rows)
    for bad, why in ((struct.pack("<iiiif", 3, 1, 1, 1, 1.0), "no such chromosome index: 3"), (b"x" * 19, "cut short")):
        (tmp_path / "bad.bn").write_bytes(bad)
        with pytest.raises(Exception, match=why):
            text.read_pairs(spark, f"{tmp_path}/bad.bn", GENOME).count()
    with pytest.raises(ValueError, match="no ordinal"):
        text.read_pairs(spark, f"{tmp_path}/a.bn", GENOME, ordinal=True)


def test_comments_and_short_lines_cost_only_themselves(spark, tmp_path):
    path = _written(tmp_path / "x.mnd", "# c\n\n \t \n0 chr1 5 0 1 chr2 7\n0 chr1 5 0 1 chr2 7 1\n\r\n#\n")
    assert text.read_pairs(spark, path, GENOME).agg(F.count("*")).first()[0] == 1
