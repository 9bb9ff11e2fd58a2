import random

import pytest

from tessera.operators import matrix
from tessera.plans import render
from tessera.sources import matrices


def coo(spark, rows):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(rows) for j, v in enumerate(row)], "i long, j long, v double")


def multiply(a, b):
    return [[sum(x * b[k][j] for k, x in enumerate(row)) for j in range(len(b[0]))] for row in a]


CASES = [
    ([[1, 2], [0, 3], [-1, 4]], [[2, 3, 4], [1, 0, -1]]),
    ([[1, 0], [2, -1], [0, 3], [1, 1]], [[1, 2], [0, 1]]),
    ([[3, 1, 4]], [[1, 0, -1, 2], [0, 2, 0, 1], [2, 1, 0, 3]]),
    ([[5], [-2], [0]], [[2, 0, -1, 4]]),
    ([[-2]], [[3]]),
    matrices.generated(10, 10, 10, 103, 0.4),
    matrices.generated(7, 1, 5, 104, 1),
    matrices.generated(16, 16, 16, 107, 0.05),
]


@pytest.mark.parametrize("cells", [10**6, 0])
@pytest.mark.parametrize(("a", "b"), CASES)
def test_products(spark, a, b, cells):
    c = matrix.product(coo(spark, a), coo(spark, b), broadcast_cells=cells)
    want = multiply(a, b)
    assert render.dense(c, len(want), len(want[0])) == "".join(" ".join(f"{v:.10g}" for v in row) + "\n" for row in want)
    assert render.sparse(c) == "".join(f"{i}\t{j}\t{v:.10g}\n" for i, row in enumerate(want) for j, v in enumerate(row) if v)


@pytest.mark.parametrize("whole", [True, False])
def test_files(spark, tmp_path, whole):
    a, b = CASES[0]
    (tmp_path / "a").write_text("\n".join(" ".join(map(str, r)) for r in a) + "\n\n")
    (tmp_path / "b").write_text("".join(f"{i}\t{j}\t{v}\n" for i, r in enumerate(b) for j, v in enumerate(r)))
    assert not matrices.is_sparse(spark, str(tmp_path / "a"))
    assert matrices.is_sparse(spark, str(tmp_path / "b"))
    left, size = matrices.read_dense(spark, str(tmp_path / "a"), whole)
    right = matrices.read_sparse(spark, str(tmp_path / "b"))
    assert size == (3, 2)
    matrix.check_product(left, right, size)
    assert render.dense(matrix.product(left, right), 3, 3) == "4 3 2\n3 0 -3\n2 -3 -8\n"
    (tmp_path / "r").write_text("1 2\n3\n")
    with pytest.raises(ValueError, match="ragged"):
        matrices.read_dense(spark, str(tmp_path / "r"), whole)


def test_checks(spark):
    a = coo(spark, [[1, 2], [3, 4]])
    with pytest.raises(ValueError, match="mismatch"):
        matrix.check_product(a, coo(spark, [[1], [2], [3]]))
    twice = a.union(a)
    with pytest.raises(ValueError, match="twice"):
        matrix.checked(twice)
    assert sorted(matrix.checked(twice, "sum").collect())[0] == (0, 0, 2.0)
    none = a.where("false")
    assert tuple(matrix.dims(none).first()) == (0, 0)
    assert matrix.product(none, a).count() == 0
    assert matrix.reducer_count(none).first()[0] == 1
    assert render.dense(none, 2, 2) == "0 0\n0 0\n"


def test_files_of_either_format(spark, tmp_path):
    a, b = matrices.generated(3, 4, 2, 7, 0.6)
    paths = [str(tmp_path / n) for n in ("a1", "a2", "b")]
    matrices.write_file(paths[0], a[:2])
    matrices.write_file(paths[1], a[2:])
    matrices.write_file(paths[2], b, sparse=True)
    whole = {(i, j): float(v) for i, row in enumerate(a) for j, v in enumerate(row) if v}
    assert {(r.i, r.j): r.v for r in matrices.read(spark, *paths[:2]).collect()} == whole
    made = matrix.product(matrices.read(spark, *paths[:2]), matrices.read(spark, paths[2]))
    want = {(i, j): float(sum(a[i][k] * b[k][j] for k in range(4))) for i in range(3) for j in range(2)}
    assert {(r.i, r.j): r.v for r in made.collect()} == {k: v for k, v in want.items() if v}
    inferred = {r.i: list(r.row) for r in matrix.to_rows(made).collect()}
    assert all(inferred[i][j] == v for (i, j), v in want.items() if v)


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_rows_are_numbered_over_splits_and_files(spark, tmp_path, split):
    rng = random.Random(split)
    rows = [[rng.randint(-5, 5) for _ in range(6)] for _ in range(300)]
    for f in range(3):
        lines = [("\t " if k % 2 else "") + " ".join(map(str, r)) + "\n" + "\n \t\n" * (k % 3 == 0) for k, r in enumerate(rows[100 * f : 100 * f + 100])]
        (tmp_path / f"{f}.txt").write_text("".join(lines))
    (tmp_path / "3.txt").write_text("\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        held, splits = matrices.split_rows(spark, str(tmp_path))
        assert (splits.count() > 50) == (split == 40)
        got = {r["i"]: list(r["row"]) for r in matrices._numbered(held, splits).collect()}
        cells, size = matrices.read_dense(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: [float(v) for v in r] for k, r in enumerate(rows)}
    assert size == (300, 6) and cells.count() == sum(v != 0 for r in rows for v in r)


def test_empty_dense_file(spark, tmp_path):
    (tmp_path / "e").write_text("\n")
    cells, size = matrices.read_dense(spark, str(tmp_path / "e"))
    assert (cells.count(), size) == (0, (0, 0))


@pytest.mark.parametrize("tile", [1, 3, 8, 256])
def test_tiles(spark, tile):
    rng = random.Random(tile)
    a = [[rng.randint(-3, 3) if k != 5 or i == 0 else 1 for k in range(13)] for i in range(11)]  # one dense inner index
    b = [[rng.randint(-3, 3) if k % 4 else 0 for _ in range(7)] for k in range(13)]
    want = {(i, j): float(v) for i, row in enumerate(multiply(a, b)) for j, v in enumerate(row) if v}
    assert {(r.i, r.j): r.v for r in matrix.tiled_product(coo(spark, a), coo(spark, b), tile).collect()} == want
    twice = coo(spark, a).union(coo(spark, a))  # repeated cells add up, as in the other form
    assert {(r.i, r.j): r.v for r in matrix.tiled_product(twice, coo(spark, b), tile).collect()} == {k: 2 * v for k, v in want.items()}
    assert matrix.tiled_product(coo(spark, a).where("false"), coo(spark, b), tile).count() == 0


def test_product_checks_sizes(spark):
    a, b = coo(spark, [[1, 2], [3, 4]]), coo(spark, [[1, 0], [0, 1]])
    assert matrix.product(a, b, sizes=((2, 2), (2, 2))).count() == 4
    with pytest.raises(ValueError, match="mismatch"):
        matrix.product(a, b, sizes=((2, 2), (3, 2)))


def test_texts_of_parts_and_settings(spark):
    from pyspark.sql import functions as F

    from tessera.functions import parts_of, setting

    df = spark.createDataFrame([("3:4:0.5",), ("3:4",), ("3:x:1",), ("3:4:5:6",), ("K=12",), ("KK=1",), ("K=",), ("",), (None,)], "t string")
    got = [(tuple(r["c"]) if r["c"] else None, r["k"]) for r in df.select(parts_of(F.col("t"), ["long", "long", "double"]).alias("c"), setting(F.col("t"), "K").alias("k")).collect()]
    assert got == [((3, 4, 0.5), None), *[(None, None)] * 3, (None, "12"), (None, None), (None, ""), (None, None), (None, None)]
