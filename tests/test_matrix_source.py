"""The container as a data source, damaged containers, and normalising a container in place."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactspark.genome import Genome
from contactspark.operators import compare, matrix
from contactspark.plans import build
from contactspark.sources import container, matrix_source
from tests.test_engine import random_contacts

GENOME = Genome((("a", 30_000_000), ("b", 20_000_000)))
SIZES = [10_000, 100_000]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """A container with matrices of many blocks, and the cells in it."""
    r = random.Random(3)
    rows = []
    for _ in range(30_000):
        c = r.choice([(1, 1), (1, 1), (1, 2), (2, 2)])
        p = r.randrange(GENOME.lengths()[c[0]])
        q = min(GENOME.lengths()[c[1]], int(p + r.expovariate(1 / 3e6))) if c[0] == c[1] else r.randrange(GENOME.lengths()[c[1]])
        rows.append((c[0], min(p, q) if c[0] == c[1] else p, c[1], max(p, q) if c[0] == c[1] else q, 1.0))
    contacts = spark.createDataFrame(rows, "chr1 int, pos1 int, chr2 int, pos2 int, score float")
    path = f"{tmp_path_factory.mktemp('matrix')}/m.hic"
    cells = matrix.union(matrix.multi_resolution(contacts, SIZES)).select("chr1", "chr2", "bin_size", "bin1", "bin2", F.col("count").cast("float").alias("count"))
    container.write(spark, path, GENOME, cells, matrix.whole_genome(contacts, GENOME), depth_base=3)
    matrix_source.register(spark)
    return path, {tuple(r) for r in cells.collect()}, contacts


def read(spark, path, **options):
    return spark.read.format("contact_matrix").options(**options).load(path)


@pytest.mark.parametrize("where", [
    "true", "chr1 = 1 and chr2 = 2", "bin_size = 100000 and chr1 = chr2", "bin_size = 10000 and chr1 = 1 and chr2 = 1 and bin1 >= 1000 and bin1 < 1100 and bin2 between 1000 and 1400",
    "bin_size = 10000 and chr1 = 1 and chr2 = 2 and bin1 = 1500", "bin2 > 2500", "chr1 in (2) and bin_size in (10000, 5)", "bin1 <= 3 or bin2 = 7", "bin1 > 5 and bin1 < 5",
])
def test_filters_leave_the_right_cells(spark, written, where):
    path, cells, _ = written
    got = [tuple(r) for r in read(spark, path, blocks_per_task="3").where(where).collect()]
    frame = spark.createDataFrame(sorted(cells), container.CELLS)
    assert sorted(got) == sorted(tuple(r) for r in frame.where(where).collect())


def test_blocks_that_cannot_hold_a_cell_are_not_read(spark, written):
    path, cells, _ = written

    def blocks(**limits):
        r = matrix_source.Reader(path, "cells", 4, False)
        for column, (low, high) in limits.items():
            list(r.pushFilters([matrix_source.GreaterThanOrEqual((column,), low), matrix_source.LessThanOrEqual((column,), high)]))
        found = [e for p in r.partitions() for e in r.chosen(p)]
        assert len(set(found)) == len(found)
        return found

    every = blocks()
    assert len(every) == container.read_index(spark, path).where("chr1 > 0").count() == read(spark, path, table="blocks").count() > 20
    fine = {"chr1": (1, 1), "chr2": (1, 1), "bin_size": (10_000, 10_000)}
    whole, near, far = blocks(**fine), blocks(**fine, bin1=(100, 300), bin2=(100, 300)), blocks(**fine, bin1=(0, 100), bin2=(2500, 3000))
    assert 0 < len(near) < len(whole) / 2 and len(far) < len(whole) / 2
    between = {"chr1": (1, 1), "chr2": (2, 2), "bin_size": (10_000, 10_000)}
    assert 0 < len(blocks(**between, bin1=(0, 10), bin2=(0, 10))) <= len(blocks(**between)) / 2 or len(blocks(**between)) == 1


def test_no_block_that_holds_a_cell_is_pruned():
    r = np.random.default_rng(1)
    from contactspark.functions.blocks import block_shape_of

    for base in (2, 5):
        for intra in (True, False):
            columns, side = block_shape_of(240_000_000, 5000, intra)
            x, y = np.sort(r.integers(0, 48_000, (2, 400)), axis=0)
            number = np.floor(np.log(1 + np.abs(x - y) / (np.sqrt(2) * side)) / np.log(base)).astype(int) * columns + (x + y) // 2 // side if intra else columns * (y // side) + x // side
            for a, b, n in zip(x.tolist(), y.tolist(), number.tolist()):
                one, two = matrix_source.Limits(a - r.integers(3), a + r.integers(3)), matrix_source.Limits(b, b)
                assert matrix_source.may_hold(np.array([n]), intra, side, columns, base, one, two)[0]


def test_other_tables(spark, written):
    path, _, contacts = written
    assert {tuple(r)[:2] for r in read(spark, path, table="matrices").collect()} == {(1, 1), (1, 2), (2, 2)}
    assert read(spark, path, table="matrices", whole_genome="true").where("chr1 = 0").count() == 1
    whole = {(r.bin1, r.bin2): r["count"] for r in read(spark, path, whole_genome="true").where("chr1 = 0").collect()}
    assert whole == {(r.bin1, r.bin2): r["count"] for r in matrix.whole_genome(contacts, GENOME).collect()}
    with pytest.raises(Exception, match="no such table"):
        read(spark, path, table="x").count()


# --- damage, and normalising in place ----------------------------------------


@pytest.fixture
def small(spark, tmp_path):
    g, c = random_contacts(spark)
    p = c.selectExpr("chr1", "pos1", "chr2", "pos2", "score", "1000 mapq1", "1000 mapq2", "0 frag1", "1 frag2")
    store = build.build(p, g, resolutions=[100_000, 200_000])
    build.export(store, f"{tmp_path}/m.hic")
    return f"{tmp_path}/m.hic", store


def spoil(path, at, size):
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(b"\xff" * size)


def test_a_container_is_normalised_in_place(spark, small):
    path, store = small
    bare = container.inspect(path)
    assert bare["vectors"] == bare["norm_expected"] == 0
    told = build.normalise_container(spark, path).collect()
    want = build.normalise(store)
    assert {tuple(r) for r in told} == {tuple(r) for r in want.status.collect()}
    met = compare.compare_vectors(want.vectors, container.read_vectors(spark, path)).collect()
    assert len(met) == 12 and all(r.max_relative_error < 1e-5 and r.length_left == r.length_right for r in met)
    after = container.inspect(path)
    assert after["vectors"] == 12 and after["norm_expected"] == 6 and after["expected"] == bare["expected"]
    held = {(e.norm, e.bin_size): e for e in container.read_expected(path)}
    for r in want.density.where("norm = 'VC' and bin_size = 200000").collect():
        assert held["VC", 200_000].values[r.dist] == pytest.approx(r.density, rel=1e-4)
    cells = store.cells.select("chr1", "chr2", "bin_size", "bin1", "bin2", F.col("count").cast("float").alias("count"))
    assert container.read_cells(spark, path).exceptAll(cells).isEmpty()


def test_one_bad_block_costs_its_matrix_only(spark, small):
    path, _ = small
    block = container.read_index(spark, path).where("chr1 = 2 and chr2 = 2 and bin_size = 100000").first()
    spoil(path, block.position, block["size"])
    with pytest.raises(Exception, match="can't be read"):
        container.read_cells(spark, path).count()
    cells, problems = container.read_checked(spark, path)
    assert [tuple(r)[:4] for r in problems.collect()] == [(2, 2, 100_000, block.position)]
    assert cells.where("chr1 = 2 and bin_size = 100000").isEmpty() and cells.where("chr1 = 2 and bin_size = 200000").count() > 0
    told = {(r.norm, r.chr, r.bin_size): r.status for r in build.normalise_container(spark, path).collect()}
    assert {k for k, v in told.items() if v == "unreadable"} == {(n, 2, 100_000) for n in ("VC", "VC_SQRT", "SCALE")}
    assert sum(v == "made" for v in told.values()) == 9 and container.inspect(path)["vectors"] == 9


def test_a_bad_index_costs_its_chromosome_only(spark, small):
    path, _ = small
    key, at, length = next(m for m in container.matrices(path) if m[0] == "1_1")
    spoil(path, at, length)
    told = {(r.norm, r.chr, r.bin_size): r.status for r in build.normalise_container(spark, path, ("VC",)).collect()}
    assert told == {("VC", 1, 100_000): "unreadable", ("VC", 1, 200_000): "unreadable", ("VC", 2, 100_000): "made", ("VC", 2, 200_000): "made"}


def test_rows_far_from_the_diagonal_can_be_masked(spark, small):
    """As an option of normalising: it reaches the search."""
    _, store = small
    plain, masked = (build.normalise(store, ("SCALE",), diagonal_width=w).vectors.where("value is not null and not isnan(value)").count() for w in (-1, 1))
    assert masked <= plain
