"""Connected places of grids against a plain search."""

import numpy as np

from docframe.operators import merges

KIND = "page long, row int, col int, open_right boolean, open_down boolean"


def plain(grid):
    """{(page, row, col): set of places} by flooding."""
    known = {(p, r, c) for p, r, c, _, _ in grid}
    next_to = {k: set() for k in known}
    for p, r, c, right, down in grid:
        for is_open, other in ((right, (p, r, c + 1)), (down, (p, r + 1, c))):
            if is_open and other in known:
                next_to[p, r, c].add(other)
                next_to[other].add((p, r, c))
    cells = []
    while known:
        todo, cell = [min(known)], set()
        while todo:
            k = todo.pop()
            if k not in cell:
                cell.add(k)
                todo += next_to[k]
        known -= cell
        rows, cols = [k[1] for k in cell], [k[2] for k in cell]
        h, w = max(rows) - min(rows) + 1, max(cols) - min(cols) + 1
        cells.append((min(cell)[0], min(rows), min(cols), h, w, len(cell), h * w == len(cell)))
    return sorted(cells)


def test_merged_cells_equal_flooding(spark):
    rng = np.random.default_rng(6)
    grid = []
    for page in range(12):
        h, w = rng.integers(1, 9, 2).tolist()
        grid += [(page, r, c, bool(rng.random() < 0.3), bool(rng.random() < 0.25)) for r in range(h) for c in range(w)]
    grid += [(50, 0, c, True, False) for c in range(300)]  # one cell of 300 places
    got = merges.merged(spark.createDataFrame(grid, KIND).repartition(3))
    assert sorted(tuple(r) for r in got.select("page", "row", "col", "rowspan", "colspan", "places", "rectangular").collect()) == plain(grid)


def test_pages_with_a_cell_that_is_no_rectangle_have_no_table(spark):
    corner = [(1, 0, 0, True, True), (1, 0, 1, False, False), (1, 1, 0, False, False), (1, 1, 1, False, False)]
    head = [(2, 0, 0, True, False), (2, 0, 1, False, False), (2, 1, 0, None, None), (2, 1, 1, False, False)]
    got = merges.tables(spark.createDataFrame(corner + head, KIND)).collect()
    assert sorted(map(tuple, got)) == [(2, 0, 0, 1, 2), (2, 1, 0, 1, 1), (2, 1, 1, 1, 1)]
    assert merges.tables(spark.createDataFrame([], KIND)).collect() == []


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, 5, 5), (1, None, 2), (None, 1, 2), (1, 9, 4), (1, 4, 9), (2, 9, 1)], "page long, a long, b long")
    assert sorted(map(tuple, merges.components(edges).collect())) == [(1, 4, 4), (1, 9, 4), (2, 1, 1), (2, 9, 1)]
