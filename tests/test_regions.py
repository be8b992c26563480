"""Region queries one by one and many at once, between chromosomes too, and the comparison of two stores."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from contactspark.genome import Genome
from contactspark.operators import matrix, region
from contactspark.plans import build

GENOME = Genome((("a", 3_000_000), ("b", 2_000_000), ("c", 900_000)))


def made(spark, seed, resolutions=matrix.RESOLUTIONS, names=("VC", "VC_SQRT")):
    r = random.Random(seed)
    ends = lambda: (c := r.choice([1, 1, 1, 2, 2, 3]), r.randrange(GENOME.lengths()[c]))
    rows = [(*ends(), *ends(), r.choice([1.0, 1.0, 0.5, -0.25, 2.0])) for _ in range(6000)]
    pairs = spark.createDataFrame(rows, "chr1 int, pos1 int, chr2 int, pos2 int, score float").selectExpr("*", "1000 mapq1", "1000 mapq2", "0 frag1", "1 frag2")
    return build.normalise(build.build(pairs, GENOME, resolutions=resolutions), names)


@pytest.fixture(scope="module")
def store(spark):
    return made(spark, 1)


def rows_of(df):
    return sorted((r.x, r.y, round(r.value, 6)) for r in df.collect())


def test_expected_between_chromosomes(spark, store):
    size = 100_000
    cells = [(r.chr1, r.chr2, r.bin1, r.bin2, r["count"], r.pos_count) for r in store.cells.where(F.col("bin_size") == size).collect()]
    lengths = GENOME.lengths()
    for norm in ("NONE", "VC"):
        value = {(r.chr, r.bin): r.value for r in store.vectors.where((F.col("norm") == norm) & (F.col("bin_size") == size)).collect()}
        # as for distances, the raw model adds scores above 0, the others cells above 0
        usable = [(a, b, i, j, n, p) for a, b, i, j, n, p in cells if norm == "NONE" or (value[a, i] and value[b, j])]
        shown = {(a, b, i, j): n if norm == "NONE" else n / (value[a, i] * value[b, j]) for a, b, i, j, n, _ in usable}
        weight = {(a, b, i, j): p if norm == "NONE" else shown[a, b, i, j] for a, b, i, j, n, p in usable if norm == "NONE" or n > 0}
        for one, two in ((1, 2), (1, 3), (2, 3)):
            mean = sum(w for (a, b, _, _), w in weight.items() if (a, b) == (one, two)) / (lengths[one] // size) / (lengths[two] // size)
            want = sorted((i * size, j * size, round(w / mean, 4)) for (a, b, i, j), w in shown.items() if (a, b) == (one, two) and i <= 8)
            names = [GENOME.chromosomes[k - 1][0] for k in (one, two)]
            got = build.query(store, f"{names[0]}:0:{8 * size}", names[1], size, norm, observed=False)
            assert [(x, y) for x, y, _ in rows_of(got)] == [(x, y) for x, y, _ in want] and want
            assert [v for _, _, v in rows_of(got)] == pytest.approx([v for _, _, v in want], rel=1e-4, abs=1e-4)
    with pytest.raises(ValueError, match="between chromosomes"):
        region.query(store.cells, (1, 0, 10), (2, 0, 10), size, density=store.density, factors=store.factors, between=store.between.limit(0))


def test_many_regions_are_as_one_by_one(spark, store):
    cases = region.random_cases(GENOME, [2_500_000, 250_000, 50_000], ("NONE", "VC", "VC_SQRT"), bins=7, least=300_000)
    got = collections.defaultdict(list)
    for r in build.query_many(store, cases).collect():
        got[r.case].append((r.x, r.y, round(r.value, 6)))
    for c in cases[::3]:
        assert sorted(got[c.name]) == rows_of(build.query(store, c.region1, c.region2, c.resolution, c.norm, c.observed)), c.name
    assert len(got) > len(cases) / 2


@pytest.mark.parametrize("few", [5000, 0])
def test_every_cell_of_a_region_is_found_once(spark, store, few, monkeypatch):
    """Widths from one bin to whole chromosomes, mirrored and overlapping regions, equal cases; tiles broadcast or dealt."""
    monkeypatch.setattr(region, "FEW", few)
    size, spans = 10_000, []
    for c, n in GENOME.lengths().items():
        spans += [(c, 0, n), (c, 0, 0), (c, n // 3, n // 3 + 45_000), (c, n // 2, n)]
    rows = [(f"{k}", size, *a, *b, "NONE", True) for k, (a, b) in enumerate((a, b) for a in spans for b in spans)]
    rows += [("again", *rows[0][1:])]
    cases = spark.createDataFrame(rows, "case string, bin_size int, chr1 int, start1 bigint, end1 bigint, chr2 int, start2 bigint, end2 bigint, norm string, observed boolean")
    got = collections.Counter((r.case, r.x, r.y) for r in region.query_many(store.cells, cases).collect())
    assert set(got.values()) == {1}
    cells = [(r.chr1, r.chr2, r.bin1, r.bin2) for r in store.cells.where(F.col("bin_size") == size).collect()]
    want = set()
    for name, _, *ends, _, _ in rows:
        (c1, s1, e1), (c2, s2, e2) = sorted([tuple(ends[:3]), tuple(ends[3:])], key=lambda r: r[0])
        inside = lambda i, s, e: s // size <= i <= e // size
        for a, b, i, j in cells:
            if (a, b) == (c1, c2) and ((inside(i, s1, e1) and inside(j, s2, e2)) or (a == b and inside(i, s2, e2) and inside(j, s1, e1))):
                want.add((name, i * size, j * size))
    assert set(got) == want


def test_what_no_model_has_is_an_error(spark, store):
    for c, what in ((region.RegionCase("x", 100_000, "a", "a", True, "SCALE"), "vector"), (region.RegionCase("x", 7, "a", "b", False, "NONE"), "expected value between chromosomes")):
        with pytest.raises(ValueError, match=f"there is no {what} for"):
            build.query_many(store, [c])


def test_the_set_of_cases_is_run_and_reported(spark, store, tmp_path):
    """All 160 cases (here with two stores of as many cells) but for norms that a small matrix has not."""
    other = made(spark, 2)
    cases = region.random_cases(GENOME, list(matrix.RESOLUTIONS), bins=3, least=200_000)
    assert len(cases) == 160 and len({c.name for c in cases}) == 160
    cases = [c for c in cases if c.norm != "SCALE"]
    report = {r.case: r for r in build.run_cases(store, other, cases, f"{tmp_path}/run").collect()}
    assert set(report) == {c.name for c in cases}
    told = {r.case: r for r in build.compare_stores(store, other, cases).collect()}
    for name, r in report.items():
        assert (r.rows_left, r.rows_right, r.coordinates_equal, r.common_positive_finite) == (told[name].rows_left, told[name].rows_right, told[name].coordinates_equal, told[name].common_positive_finite)
    same = build.compare_stores(store, store, cases).where("not exact_values_equal").count()
    assert same == 0 and any(r.rows_left and not r.coordinates_equal for r in report.values())
    one = next(c for c in cases if report[c.name].rows_left)
    assert rows_of(region.read_dump(spark, f"{tmp_path}/run/left/case={one.name}")) == rows_of(build.query(store, one.region1, one.region2, one.resolution, one.norm, one.observed))


def test_a_kept_store_has_its_model_between_chromosomes(spark, store, tmp_path):
    build.save(store, f"{tmp_path}/store")
    again = build.load(spark, f"{tmp_path}/store", GENOME)
    assert rows_of(build.query(again, "b", "a:0:500000", 50_000, "VC", observed=False)) == rows_of(build.query(store, "b", "a:0:500000", 50_000, "VC", observed=False))


def test_resolutions_are_read_coarsest_first():
    assert matrix.parse_resolutions("5000,,1000000, 100000 ,") == [1_000_000, 100_000, 5000] and matrix.parse_resolutions("") == []
