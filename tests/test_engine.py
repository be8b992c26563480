"""The contact engine on small fixtures, against worked values and plain versions."""

import gzip
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactspark import genome as genomes
from contactspark.functions.blocks import block_number, block_shape, block_shape_of
from contactspark.functions.parse import leading_float, leading_int, leading_long
from contactspark.genome import Genome
from contactspark.operators import compare, contacts, expected, matrix, norms, region, scale
from contactspark.plans import build
from contactspark.sources import container, text

SMALL = Genome((("chr1", 1000), ("chr2", 2000)))


def lines(path, *rows, compressed=False):
    data = "\n".join(rows) + "\n"
    path.write_bytes(gzip.compress(data.encode()) if compressed else data.encode())
    return str(path)


def read(spark, path, genome=SMALL, **kw):
    return [tuple(r) for r in text.read_pairs(spark, path, genome, **kw).select("chr1", "pos1", "strand1", "frag1", "mapq1", "chr2", "pos2", "strand2", "frag2", "mapq2", "score").collect()]


# --- genomes ---------------------------------------------------------------


def test_built_in_genomes():
    assert {k: len(genomes.built_in(k).chromosomes) for k in ("hg19", "HG38", "mm9", "mm10")} == {"hg19": 25, "HG38": 25, "mm9": 22, "mm10": 22}
    totals = {"hg19": (3_095_693_981, 6191), "hg38": (3_088_286_401, 6176), "mm9": (2_654_911_518, 5309), "mm10": (2_725_537_669, 5451)}
    for k, (total, step) in totals.items():
        g = genomes.built_in(k)
        assert (g.total, g.whole_genome_bin) == (total, step)
    name = lambda k, i: genomes.built_in(k).chromosomes[i - 1][0]
    assert (name("hg38", 25), name("hg19", 25), name("mm9", 22), name("mm10", 20)) == ("chrM", "MT", "chrM", "chrM")
    with pytest.raises(ValueError):
        genomes.built_in("hg99")


def test_aliases():
    a = genomes.built_in("hg38").aliases()
    assert a["1"] == a["chr1"] == 1 and a["all"] == 0 and "mt" not in a
    assert Genome((("chr1", 5), ("1", 6))).aliases()["1"] == 2


def test_sizes_file(spark, tmp_path):
    path = lines(tmp_path / "g.sizes", "# c", "a 10", "", "b\t20 x", "bad", "c x")
    assert genomes.genome(spark, path).chromosomes == (("a", 10), ("b", 20))
    with pytest.raises(ValueError):
        genomes.genome(spark, lines(tmp_path / "e.sizes", "# none"))


def test_offsets(spark):
    assert [(r["index"], r.offset) for r in SMALL.table(spark).orderBy("index").collect()] == [(1, 0), (2, 1000)]


# --- reading pairs ---------------------------------------------------------


def test_pairs_with_reordered_columns(spark, tmp_path):
    path = lines(tmp_path / "x.pairs", "## pairs format v1.0", "#columns: readID chr1 pos1 chr2 pos2 strand1 strand2 pair_type mapq2 mapq1 frag2 frag1", "", "r0 chrX 1 chr1 2 + +", "r1 chr1 100 chr2 200 + - UU 17 42 8 7", "r2 1 5 CHR2 -6", "r3 chr1 1 chr2 2 - - UU 9")
    assert read(spark, path) == [(1, 100, 0, 7, 42, 2, 200, 1, 8, 17, 1.0), (1, 5, 0, 0, 1000, 2, 0, 0, 1, 1000, 1.0), (1, 1, 1, 0, 1000, 2, 2, 1, 1, 1000, 1.0)]


def test_mnd_layouts(spark, tmp_path):
    rows = [
        "0 chr1 10 3 1 chr2 20 4", "0 chr1 10 3 - chr2 20 4 2.5", "0 chr1 10 3 1 chr2 20 4 30 40", "0 chr1 10 3 1 chr2 20 4 30 40 0.5",
        "name 0 chr1 10 3 1 chr2 20 4 30 40", "0 chr1 10 3 1 chr2 20 4 30 c s 40 c s a b", "  0\tchr1  12abc 3 1 chr2 x 4", "16 chr1 10 3 1 chr2 20 4", "0 chr9 1 1 0 chr1 1 1", "0 chr1 1",
    ]
    got = read(spark, lines(tmp_path / "a.mnd", *rows))
    base = (1, 10, 0, 3, 1000, 2, 20, 1, 4, 1000, 1.0)
    alter = lambda **k: tuple(k.get(f"c{i}", x) for i, x in enumerate(base))
    assert got == [base, alter(c10=2.5), alter(c4=30, c9=40), alter(c4=30, c9=40, c10=0.5), alter(c4=30, c9=40), alter(c4=30, c9=40), alter(c1=12, c6=0)]
    assert len(read(spark, f"{tmp_path}/a.mnd", sam_flag_strands=True)) == 8


def test_short_and_detection(spark, tmp_path):
    path = lines(tmp_path / "s.txt", "# x", "chr1 5 chr2 7", "chr2 1 chr1 9 0.25 more", "chr1 5 chr2")
    assert text.detect_format(spark, path) == "short"
    assert [r[-1] for r in read(spark, path)] == [1.0, 0.25]
    gz = lines(tmp_path / "m.mnd.gz", "0 1 10 0 0 2 20 1", compressed=True)
    assert text.detect_format(spark, gz) == "mnd" and len(read(spark, gz)) == 1
    assert text.detect_format(spark, lines(tmp_path / "p.txt", "## pairs format v1.0", "a chr1 1 chr1 2")) == "pairs"
    assert text.detect_format(spark, lines(tmp_path / "q.txt", "a b c d e f g h")) == "mnd"
    assert text.detect_format(spark, "z.bin") == "bin" and text.detect_format(spark, "z.bn") == "bn"
    with pytest.raises(ValueError):
        text.read_pairs(spark, path, SMALL, "what")


def test_binary(spark, tmp_path):
    one, two = tmp_path / "a.bin", tmp_path / "a.bn"
    one.write_bytes(struct.pack("<BiiiBiii", 1, 1, 123, 4, 0, 2, 456, 5))
    two.write_bytes(struct.pack("<iiiif", 2, 789, 1, -987, 2.5) + struct.pack("<iiiif", 1, 1, 1, 1, -0.1))
    assert read(spark, str(one)) == [(1, 123, 0, 4, 1000, 2, 456, 1, 5, 1000, 1.0)]
    assert [r[:2] + r[5:7] + r[10:] for r in read(spark, str(two))] == [(2, 789, 1, -987, 2.5), (1, 1, 1, 1, struct.unpack("<f", struct.pack("<f", -0.1))[0])]
    many = [(1 + i % 2, i - 3, 2 - i % 2, 2**31 - 1 - i, i / 8) for i in range(200_000)]
    (tmp_path / "n.bn").write_bytes(b"".join(struct.pack("<iiiif", *m) for m in many))
    got = text.read_pairs(spark, f"{tmp_path}/n.bn", SMALL).select("chr1", "pos1", "chr2", "pos2", "score").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == many
    cut = tmp_path / "b.bn"
    cut.write_bytes(two.read_bytes()[:-3])
    with pytest.raises(ValueError):
        read(spark, str(cut))
    bad = tmp_path / "c.bn"
    bad.write_bytes(struct.pack("<iiiif", 0, 1, 1, 1, 1.0))
    with pytest.raises(Exception, match="no such chromosome"):
        read(spark, str(bad))


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("12abc",), ("abc",), ("-7",), ("",), ("1e2x",), (".5",)], "s string")
    assert [r[0] for r in df.select(leading_long(F.col("s"))).collect()] == [12, 0, -7, 0, 1, 0]
    assert [r[0] for r in df.select(leading_float(F.col("s"))).collect()] == [12.0, 0.0, -7.0, 0.0, 100.0, 0.5]


def test_numbers_beyond_the_range_are_held(spark):
    df = spark.createDataFrame([("3000000000",), ("-3000000000x",), ("99999999999999999999",), ("-99999999999999999999 z",), (None,), (" +7",), ("1.9",)], "s string")
    assert [r[0] for r in df.select(leading_int(F.col("s"))).collect()] == [2**31 - 1, -(2**31), 2**31 - 1, -(2**31), 0, 7, 1]
    assert [r[0] for r in df.select(leading_long(F.col("s"))).collect()] == [3_000_000_000, -3_000_000_000, 2**63 - 1, -(2**63), 0, 7, 1]


def test_a_bad_line_costs_only_itself(spark, tmp_path):
    path = lines(tmp_path / "m.mnd", "0 chr1 3000000000 99999999999 0 chr2 5 1 99999999999 -99999999999", "0 chr1 1 0 0 chr2 2 1", "0 chr1", "\t 0\tchr1  7 0 0 chr2 8 1 \r")
    assert [r[1:5] + r[6:7] for r in read(spark, path)] == [(2**31 - 1, 0, 2**31 - 1, 2**31 - 1, 5), (1, 0, 0, 1000, 2), (7, 0, 0, 1000, 8)]


def test_each_pairs_file_has_its_own_header(spark, tmp_path):
    folder = tmp_path / "with blank.pairs"
    folder.mkdir()
    lines(folder / "a.pairs", "## pairs format v1.0", "#columns: readID chr1 pos1 chr2 pos2 strand1 strand2 mapq1 mapq2", "r chr1 1 chr2 2 + - 11 12")
    lines(folder / "b.pairs.gz", "#columns: readID chr1 pos1 chr2 pos2 strand1 strand2 mapq2 mapq1", "r chr1 3 chr2 4 - + 22 21", compressed=True)
    lines(folder / "c.pairs", "r chr1 5 chr2 6 - + 31 32", "#columns: too late", "r chr1 7 chr2 8 - + 31 32")
    got = sorted(r[1:2] + r[4:5] + r[9:10] for r in read(spark, str(folder), fmt="pairs"))
    assert got == [(1, 11, 12), (3, 21, 22), (5, 1000, 1000), (7, 1000, 1000)]


# --- contacts --------------------------------------------------------------


def pairs(spark, rows, mapq=(1000, 1000)):
    return spark.createDataFrame([(*r, *mapq, 0, 1) if len(r) == 5 else r for r in rows], "chr1 int, pos1 int, chr2 int, pos2 int, score float, mapq1 int, mapq2 int, frag1 int, frag2 int")


def test_mapq_filter(spark, tmp_path):
    path = lines(tmp_path / "f.pairs", "## pairs format v1.0", "#columns: readID chr1 pos1 chr2 pos2 strand1 strand2 pair_type mapq1 mapq2 frag1 frag2", "pass chr1 100000 chr1 200000 + - UU 40 40 0 1", "fail chr1 300000 chr1 400000 + - UU 40 10 2 3")
    g = genomes.built_in("hg38")
    p = text.read_pairs(spark, path, g)
    assert tuple(contacts.counters(p, mapq=30).first()) == (2, 1)
    cell = matrix.cells(contacts.contacts(p, g, mapq=30), 100_000).collect()
    assert [(r.chr1, r.chr2, r.bin1, r.bin2, r["count"]) for r in cell] == [(1, 1, 1, 2, 1.0)]


def test_order_clamp_and_near_diagonal(spark):
    g = Genome((("a", 50_000_000), ("b", 100)))
    rows = [(2, 500, 1, 7, 1.0), (1, 9, 1, 3, 1.0), (1, 0, 1, 10_000_000, 1.0), (1, 0, 1, 10_000_001, 1.0)]
    got = sorted(tuple(r)[:4] for r in contacts.contacts(pairs(spark, rows), g, near_diagonal_only=True, scaling_factor=2.0).collect())
    assert got == [(1, 0, 1, 10_000_000), (1, 3, 1, 9), (1, 7, 2, 100)]
    assert contacts.contacts(pairs(spark, rows), g, intra_only=True).count() == 3
    same = spark.createDataFrame([(1, 1, 1, 2, 1.0, 9, 9, 4, 4)], pairs(spark, rows).schema)
    assert contacts.contacts(same, g, drop_same_fragment=True).count() == 0


def test_coverage_bound_where_mean_less_deviation_is_whole(spark):
    """Rows of 3, 2, 2, 2, 2, 1, 1, 1, 1 cells: the mean is 5/3, the deviation 2/3; in doubles their difference comes out above 1."""
    pairs = [(0, 1), (0, 2), (0, 3), (8, 8), (4, 4), (5, 5), (6, 6), (7, 7), (4, 5), (6, 7)]
    own = spark.createDataFrame([(1, 10, a, b, 1.0) for a, b in pairs], "chr int, bin_size int, bin1 int, bin2 int, count double")
    r = norms.coverage_stats(own).first()
    assert (r.n_rows, round(r["mean"], 12), round(r.deviation, 12), r.fifth, r.bound) == (9, round(5 / 3, 12), round(2 / 3, 12), 1, 1)


def test_contiguous_groups(spark):
    def frame(keys):
        return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(keys)], "chr1 int, chr2 int, n long")

    many = [(i, j) for i in range(1, 13) for j in range(i, 13)]
    contacts.require_contiguous(frame([k for k in many for _ in range(5)]), ["n"])
    with pytest.raises(ValueError, match="1-1 appears in multiple blocks"):
        contacts.require_contiguous(frame([(1, 1), (1, 2), (1, 1)]), ["n"])


# --- matrices --------------------------------------------------------------

SHAPES = [(2_500_000, 100, (1, 101), (1, 101)), (250_000, 996, (1, 997), (1, 997)), (100_000, 2490, (3, 831), (3, 831)), (25_000, 9959, (10, 996), (10, 996)), (5_000, 49_792, (50, 996), (50, 996)), (1_000, 248_957, (249, 1000), (50, 4980))]


@pytest.mark.parametrize("size, bins, intra, inter", SHAPES)
def test_block_shapes(size, bins, intra, inter):
    assert 248_956_422 // size + 1 == bins
    assert block_shape_of(248_956_422, size, True) == intra and block_shape_of(248_956_422, size, False) == inter


def test_shapes_as_columns(spark):
    for length in (100, 10**6, 248_956_422, 2 * 10**9):
        for size in (1, 10, 499, 500, 4999, 5000, 10**6):
            for intra in (True, False):
                if length // size < 2**31:
                    c, s = block_shape(F.lit(length), F.lit(size), F.lit(intra))
                    got = spark.range(1).select(c.alias("c"), s.alias("s")).first() if (length, size) in ((100, 10), (248_956_422, 1000), (2 * 10**9, 1)) else None
                    assert got is None or tuple(got) == block_shape_of(length, size, intra)


def test_block_numbers(spark):
    rows = [(x, y) for x in (0, 5, 1000, 2400) for y in (0, 7, 999, 1900, 2489) if x <= y]
    df = spark.createDataFrame(rows, "x int, y int")
    got = df.select("x", "y", block_number(F.col("x"), F.col("y"), F.lit(True), F.lit(3), F.lit(831)).alias("d"), block_number(F.col("x"), F.col("y"), F.lit(False), F.lit(3), F.lit(831)).alias("g")).collect()
    for r in got:
        depth = int(math.log(1 + abs(r.x - r.y) / (math.sqrt(2) * 831)) / math.log(2))
        assert r.d == depth * 3 + (r.x + r.y) // 2 // 831 and r.g == 3 * (r.y // 831) + r.x // 831


def random_contacts(spark, n=4000, seed=0, genome=Genome((("a", 3_000_000), ("b", 2_000_000)))):
    r = np.random.default_rng(seed)
    c = np.sort(r.integers(1, 3, (n, 2)), axis=1)
    limit = np.array([0, 3_000_000, 2_000_000])
    p = (r.random((n, 2)) * limit[c]).astype(int)
    same = c[:, 0] == c[:, 1]
    p[same] = np.sort(p[same], axis=1)
    s = r.choice([1.0, 2.0, -1.0, 0.0], n, p=[0.7, 0.2, 0.05, 0.05])
    rows = [(int(a), int(x), int(b), int(y), float(z)) for (a, b), (x, y), z in zip(c, p, s)]
    return genome, spark.createDataFrame(rows, "chr1 int, pos1 int, chr2 int, pos2 int, score float")


def test_roll_up_is_direct_binning(spark):
    _, c = random_contacts(spark)
    made = matrix.multi_resolution(c, [10_000, 20_000, 30_000, 50_000])
    for size, got in made.items():
        direct = matrix.cells(c, size)
        assert got.exceptAll(direct).isEmpty() and direct.exceptAll(got).isEmpty()
        assert got.agg(F.sum("count")).first()[0] == c.agg(F.sum("score")).first()[0]


def test_whole_genome_matrix(spark):
    g, c = random_contacts(spark)
    got = {(r.bin1, r.bin2): r["count"] for r in matrix.whole_genome(c, g).collect()}
    want = {}
    for r in c.collect():
        a, b = (((0 if ch == 1 else 3_000_000) + p) // 1000 // g.whole_genome_bin for ch, p in ((r.chr1, r.pos1), (r.chr2, r.pos2)))
        want[min(a, b), max(a, b)] = want.get((min(a, b), max(a, b)), 0) + r.score
    assert got == want


# --- distance model --------------------------------------------------------


def test_smoothing_by_hand():
    """A window that holds enough from the start, and one that widens, narrows and stops at the end."""
    one = expected.smooth(np.array([500.0, 10, 20, 30]), np.array([10.0, 9, 8, 7]), 4)
    assert one.tolist() == pytest.approx([50, 530 / 27, 560 / 34, 560 / 34])
    two = expected.smooth(np.full(6, 100.0), np.arange(6.0, 0, -1), 6, enough=300)
    assert two.tolist() == pytest.approx([20, 25, 300 / 9, 40, 40, 40])
    assert expected.smooth(np.array([1.0, 2, 3]), np.array([3.0, 2, 1]), 2).tolist() == pytest.approx([6 / 6, 6 / 6])


def test_density_and_conservation(spark):
    g, c = random_contacts(spark, 6000)
    own = matrix.cells(c, 20_000)
    by_chr = expected.distances(own)
    hist, totals = expected.histogram(by_chr, g), expected.chromosome_totals(by_chr)
    possible = expected.possible_distances(totals, g)
    rooms = {r.dist: r.possible for r in possible.collect()}
    assert rooms == {d: max(0, 150 - d) + max(0, 100 - d) for d in range(150)}
    dense = expected.density(hist, possible, g)
    got = [r.density for r in dense.orderBy("dist").collect()]
    assert len(got) == 150 and min(got) > 0
    doubled = expected.density(hist, possible.withColumn("possible", F.col("possible") * 2), g)
    assert [2 * r.density for r in doubled.orderBy("dist").collect()] == pytest.approx(got, rel=1e-6)
    factors = {r.chr: r.factor for r in expected.scale_factors(dense, totals, g).collect()}
    for r in totals.collect():
        n = {1: 150, 2: 100}[r.chr]
        assert sum((n - d) * got[d] for d in range(n)) / factors[r.chr] == pytest.approx(r.total, rel=1e-5)
    assert list(expected.smooth(np.zeros(3), np.zeros(3), 0)) == [0.0]


# --- normalisation ---------------------------------------------------------


def chain():
    row = [0, *range(1, 101), *range(1, 100)]
    col = [0, *range(1, 101), *range(2, 101)]
    return np.array(row), np.array(col), np.array([2.0] * 101 + [0.25] * 99)


def test_balancing_keeps_a_sparse_row():
    row, col, value = chain()
    multiply = scale.local_multiply(row, col, value, 101)
    nonzeros = np.bincount(row, minlength=101) + np.bincount(col[row != col], minlength=101)
    assert scale.nonzero_bound(nonzeros) == 3
    b = scale.search(multiply, nonzeros)
    assert np.isfinite(b[0]) and b[0] > 0 and np.abs(b * multiply(b) - 1).max() <= scale.ROW_TOLERANCE


def test_balancing_masks_what_cannot_be_balanced():
    r = np.random.default_rng(2)
    dense = r.random((60, 60)) + 0.2
    dense = np.triu(dense + dense.T)
    dense[:, 57:] = 0
    dense[3, 57] = 5.0  # a row that hangs on one other only
    row, col = np.nonzero(dense)
    b = scale.balance(row, col, dense[row, col], 60)
    assert np.isnan(b[58]) and np.isnan(b[59]) and np.isfinite(b[:40]).sum() > 35
    hubs = np.zeros((51, 51))
    hubs[::10, :] = 1
    hubs = np.triu(hubs + hubs.T)
    row, col = np.nonzero(hubs)
    assert scale.balance(row, col, hubs[row, col], 51) is None
    assert scale.search(lambda v: v * 0, np.zeros(5, dtype=int)) is None


def test_rows_far_from_the_diagonal_are_masked(spark):
    row, col, value = chain()
    near = scale.near_enough(np.array([0.0, 1.0, 500.0, 600.0, 700.0]))
    assert near.tolist() == [False, False, True, True, True] and scale.near_enough(np.zeros(3)).all()
    value = np.where(row == 0, 0.001, value * 200)
    far_row, far_col = np.append(row, 0), np.append(col, 50)
    masked = scale.balance(far_row, far_col, np.append(value, 3.0), 101, diagonal_width=2)
    assert np.isnan(masked[0]) and np.isfinite(masked[1:]).all()
    df = spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(far_row, far_col, np.append(value, 3.0))], "bin1 int, bin2 int, count double")
    assert scale.balance_distributed(df, 101, diagonal_width=2) == pytest.approx(masked, rel=1e-6, nan_ok=True)


def test_distributed_balancing_is_the_same(spark):
    row, col, value = chain()
    df = spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(row, col, value)], "bin1 int, bin2 int, count double")
    assert scale.balance_distributed(df, 101) == pytest.approx(scale.balance(row, col, value, 101), rel=1e-6)


def test_many_matrices_take_as_many_jobs_as_one(spark, monkeypatch):
    """Matrices of which one is done before others, one can't be balanced, and one has rows that are masked."""
    r = np.random.default_rng(5)
    made = {(1, 10): chain()}
    for c, n in ((1, 20), (2, 20)):
        dense = np.triu(r.random((40, 40)) + 0.1 * n)
        dense[:, 38:] = 0
        made[c, n] = (*np.nonzero(dense), dense[np.nonzero(dense)])
    hubs = np.zeros((51, 51))
    hubs[::10, :] = 1
    hubs = np.triu(hubs + hubs.T)
    made[3, 10] = (*np.nonzero(hubs), hubs[np.nonzero(hubs)])
    sizes = {key: 101 if key == (1, 10) else 51 for key in made}
    rows = [(*key, int(a), int(b), float(v)) for key, m in made.items() for a, b, v in zip(*m)]
    df = spark.createDataFrame(rows, "chr int, bin_size int, bin1 int, bin2 int, count double").repartition(3)
    rounds, plain = [], scale.distributed_multiply
    monkeypatch.setattr(scale, "distributed_multiply", lambda *a: (lambda m, d: (lambda w: rounds.append(len(w)) or m(w), d))(*plain(*a)))
    together = scale.balance_many(df, sizes)
    n_together, longest = len(rounds), 0
    for key, (row, col, value) in made.items():
        alone = scale.balance(row, col, value, sizes[key])
        assert together[key] is None if alone is None else together[key] == pytest.approx(alone, rel=1e-6, nan_ok=True)
        rounds.clear()
        scale.balance_many(df.where(f"chr = {key[0]} and bin_size = {key[1]}"), {key: sizes[key]})
        longest = max(longest, len(rounds))
    assert n_together == longest and sum(together[k] is None for k in made) == 1


def test_large_matrices_are_balanced_alike(spark):
    g, c = random_contacts(spark)
    own = norms.intra(matrix.cells(c, 100_000))
    key = lambda df: {(r.chr, r.bin): r.value for r in df.where("not isnan(value)").collect()}
    small, large = key(norms.scaled(own, g)), key(norms.scaled(own, g, group_cells=100))
    assert small.keys() == large.keys() and len(small) > 40
    assert all(small[k] == pytest.approx(large[k], rel=1e-4) for k in small)


def test_vectors(spark):
    g, c = random_contacts(spark)
    own_cells = matrix.cells(c, 100_000)
    v = {(r.norm, r.chr, r.bin): r.value for r in norms.vectors(own_cells, g).collect()}
    dense = np.zeros((31, 31))
    for r in own_cells.where("chr1 = 1 and chr2 = 1 and count > 0").collect():
        dense[r.bin1, r.bin2] += r["count"]
        dense[r.bin2, r.bin1] += r["count"] if r.bin1 != r.bin2 else 0
    raw = dense.sum(axis=1)

    def rescaled(w):
        ok = w > 0
        div = np.outer(np.where(ok, w, 1), np.where(ok, w, 1))
        keep = np.outer(ok, ok)
        return w * math.sqrt((dense / div)[keep].sum() / dense[keep].sum())

    for name, w in (("VC", raw), ("VC_SQRT", np.sqrt(raw))):
        assert [v[name, 1, i] for i in range(31)] == pytest.approx(list(rescaled(w)), rel=1e-5)
    balanced = np.array([v["SCALE", 1, i] for i in range(31)])
    ok = np.isfinite(balanced)
    assert ok.sum() >= 30
    rows = (dense / np.outer(np.where(ok, balanced, np.inf), np.where(ok, balanced, np.inf))).sum(axis=1)[ok]
    assert rows.max() / rows.min() < 1.1


# --- container -------------------------------------------------------------


@pytest.mark.parametrize("seed, spread, whole", [(0, 50, True), (1, 50_000, True), (2, 50, False), (3, 10**6, False)])
def test_block_round_trip(seed, spread, whole):
    r = np.random.default_rng(seed)
    cells = {(int(x), int(y)): float(v) for x, y, v in zip(r.integers(5, 5 + spread, 300), r.integers(9, 9 + spread, 300), r.integers(1, 40_000 if seed == 1 else 300, 300) * (1 if whole else 0.37))}
    x, y = np.array(list(cells)).T
    raw = container.encode_block(x, y, np.array(list(cells.values())))
    a, b, v = container.decode_block(raw)
    assert {(i, j): k for i, j, k in zip(a.tolist(), b.tolist(), v.tolist())} == {k: float(np.float32(w)) for k, w in cells.items()}


def test_dense_blocks_are_read():
    raw = struct.pack("<iii4Bih", 3, 10, 20, 0, 0, 0, 2, 6, 3) + struct.pack("<6h", 1, 0, -32768, 4, 5, 0)
    assert [a.tolist() for a in container.decode_block(raw)] == [[10, 10, 11], [20, 21, 21], [1.0, 4.0, 5.0]]
    raw = struct.pack("<iii4Bih", 1, 0, 0, 1, 0, 0, 2, 2, 2) + struct.pack("<2f", float("nan"), 1.5)
    assert [a.tolist() for a in container.decode_block(raw)] == [[1], [0], [1.5]]


def test_build_normalise_query_export_import(spark, tmp_path):
    g, c = random_contacts(spark)
    p = c.selectExpr("chr1", "pos1", "chr2", "pos2", "score", "1000 mapq1", "1000 mapq2", "0 frag1", "1 frag2")
    store = build.build(p, g, resolutions=[100_000, 200_000], depth_base=2)
    store = build.normalise(store)
    assert tuple(store.counters.first()) == (4000, 0)
    status = {(r.norm, r.chr, r.bin_size): r.status for r in store.status.collect()}
    assert len(status) == 12 and set(status.values()) == {"made"}
    late = build.normalise(store, ("VC", "SCALE"), min_scale_res=150_000)
    assert {(r.norm, r.bin_size): r.status for r in late.status.collect()} == {("VC", 100_000): "made", ("VC", 200_000): "made", ("SCALE", 200_000): "made", ("SCALE", 100_000): "not asked for"}
    path = f"{tmp_path}/m.hic"
    build.export(store, path)
    told = container.inspect(path)
    assert told["resolutions"] == [200_000, 100_000] and told["matrices"] == 4 and told["version"] == 9 and told["vectors"] == 12
    back = container.read_cells(spark, path)
    want = store.cells.select("chr1", "chr2", "bin_size", "bin1", "bin2", F.col("count").cast("float").alias("count"))
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
    assert container.read_cells(spark, path, "chr1 = 1 and chr2 = 1 and bin_size = 100000").where("chr2 = 2").isEmpty()
    read = container.read_vectors(spark, path)
    assert compare.key_sets(store.vectors, read).where("side <> 'both'").isEmpty()
    m = compare.compare_vectors(store.vectors, read).collect()
    assert len(m) == 12 and all(r.max_relative_error < 1e-6 for r in m)
    names = {(e.norm, e.bin_size) for e in container.read_expected(path)}
    assert ("NONE", 100_000) in names and ("VC", 200_000) in names
    only = store.vectors.where("norm = 'VC'")
    build.export(store, f"{path}.2")
    container.replace_vectors(spark, path, only, [])
    report = compare.compare_containers(spark, f"{path}.2", path)
    assert report["structure"]["genome_equal"] and report["structure"]["vectors_left"] == 12 and len(report["only_left"]) == 8 and not report["only_right"]
    assert len(report["vectors"]) == 4 and all(v["max_relative_error"] == 0 for v in report["vectors"])
    assert json.loads(compare.as_json(report)) == report
    assert container.inspect(path)["vectors"] == 4
    assert container.read_cells(spark, path).exceptAll(want).isEmpty()
    raw = build.query(store, "a:500000:1500000", "a", 100_000)
    norm = build.query(store, "a:500000:1500000", "a", 100_000, norm="VC")
    ratio = build.query(store, "a:500000:1500000", "a", 100_000, observed=False)
    assert raw.count() > 0 and norm.count() <= raw.count() and ratio.where("value > 0").count() > 0
    with pytest.raises(ValueError):
        build.query(store, "a", "a", 100_000, norm="KR")
    folder = f"{tmp_path}/store"
    build.save(store, folder)
    again = build.load(spark, folder, g)
    assert again.cells.count() == store.cells.count()
    assert build.query(again, "a:500000:1500000", "a", 100_000).exceptAll(raw).isEmpty()
    build.register(again, "x")
    assert spark.sql("select count(*) from x_cells").first()[0] == store.cells.count()


def test_broken_containers_are_refused(spark, tmp_path):
    g, c = random_contacts(spark, 200)
    path = f"{tmp_path}/m.hic"
    container.write(spark, path, g, matrix.cells(c, 500_000))
    good = open(path, "rb").read()
    for bad in (b"XYZ" + good[3:], good[:4] + struct.pack("<i", 8) + good[8:], good[:8] + struct.pack("<q", 1 << 40) + good[16:], good[:200]):
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(ValueError):
            container.inspect(path)


# --- comparing and regions -------------------------------------------------


def test_regions():
    g = genomes.built_in("hg38")
    assert region.parse_region("1:5:10", g) == (1, 5, 10) and region.parse_region("chrX", g) == (23, 0, 156_040_895)
    for bad in ("chr99", "1:5"):
        with pytest.raises(ValueError):
            region.parse_region(bad, g)


def test_dumps(spark, tmp_path):
    df = spark.createDataFrame([(10, 5, 1.25), (0, 5, 3.0), (0, 0, 1 / 3)], "x int, y int, value float")
    region.write_dump(df, f"{tmp_path}/d")
    back = region.read_dump(spark, f"{tmp_path}/d")
    assert compare.same_coordinates(df, back)
    assert sorted(x.value for x in spark.read.text(f"{tmp_path}/d").collect()) == ["0\t0\t0.333333343267", "0\t5\t3", "10\t5\t1.25"]
    assert json.loads(compare.as_json(compare.compare_dumps(df, back)))["exact_values_equal"] is True
    assert not compare.compare_dumps(df, df.limit(2)).first().exact_values_equal
    r = compare.compare_dumps(df, back).first()
    assert r.coordinates_equal and r.max_relative_error == 0 and r.pearson == pytest.approx(1)
    flat = df.withColumn("value", F.lit(2.0))
    assert compare.compare_dumps(flat, flat).first().pearson == 1.0
    assert math.isnan(compare.compare_dumps(flat, df).first().pearson)
    assert not compare.same_coordinates(df, df.limit(2))
    assert compare.fingerprint(spark, f"{tmp_path}/d").count() >= 1


def test_numbers_as_c_prints_them(spark):
    values = [0.0, 1.0, 100.0, 1.5, -2.25, 1e-5, 123456789012.0, 1234567890123.0, 1e300, 0.1, 1 / 3, 1e-300, float("inf"), float("-inf"), float("nan"), 120.0, 1e20]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(region.shortest(F.col("v"))).collect()]
    assert got == ["%.12g" % v for v in values]


def test_region_cases_are_reproducible():
    g = genomes.built_in("hg19")
    cases = region.random_cases(g, list(matrix.RESOLUTIONS))
    assert len(cases) == 160 and cases == region.random_cases(g, list(matrix.RESOLUTIONS))
    assert len({c.name for c in cases}) == 160 and {c.norm for c in cases} == {"NONE", "VC", "VC_SQRT", "SCALE"}
    for c in cases:
        (c1, s1, e1), (c2, s2, e2) = (region.parse_region(r, g) for r in (c.region1, c.region2))
        assert s1 % c.resolution == s2 % c.resolution == 0 and s1 < e1 <= g.lengths()[c1] and s2 < e2 <= g.lengths()[c2]
        assert (c1 == c2) == c.name.startswith("within")
    assert len(region.random_cases(g, [1000], ("NONE",), pairs=3)) == 12


def test_catalog_is_consistent():
    import __spark_entry__ as entry
    from contactspark.plans import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert "cells_1mb" in entry.queries()
