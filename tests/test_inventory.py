"""Every row of the inventory has a query, a test, or a stated reason."""

from loomspark import catalog, registry

ROWS = {"SC": 22, "SK": 12, "PF": 20, "J": 16, "A": 36, "W": 14, "T": 17, "DD": 14, "ST": 39, "HA": 2, "MA": 7, "DT": 3, "JS": 3, "ML": 6, "G": 9, "R": 12, "GR": 4, "TR": 1, "IX": 4, "STR": 10, "U": 8}


def test_inventory():
    rows = {f"{p}{i}" for p, n in ROWS.items() for i in range(1, n + 1)}
    covered = {x for v in catalog.COVERS.values() for x in v}
    assert rows - covered - set(registry.TESTED) - set(registry.LEFT_OUT) == set()
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
