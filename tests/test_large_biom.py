"""One large document read in parts, against the whole document."""

import json

import pytest

from taxatally.session import new_path
from taxatally.sources import biom


def document(rows, columns, cells, indent=None):
    return json.dumps({
        "id": "made up", "format": "Biological Observation Matrix 1.0.0", "type": "OTU table", "matrix_type": "sparse", "matrix_element_type": "int", "shape": [rows, columns],
        "rows": [{"id": f"otu {i} [x]", "metadata": None if i % 7 == 0 else {"taxonomy": ["Life", f"[Genus] {i % 5}", "a \"b\""]}} for i in range(rows)],
        "columns": [{"id": f"s{j}", "metadata": None} for j in range(columns)],
        "data": [[i, j, (i * j) % 97 + 1] for i, j in cells],
    }, indent=indent)


@pytest.mark.parametrize("indent", [None, 1])
def test_parts_against_whole(spark, tmp_path, indent):
    cells = [(i, j) for i in range(300) for j in range(40) if (i + j) % 3]
    path = str(tmp_path / "table.biom")
    (tmp_path / "table.biom").write_text(document(300, 40, cells, indent))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        df = biom.read_large_biom(spark, path)
        assert spark.read.option("lineSep", "]").text(path).rdd.getNumPartitions() > 3
        got = sorted((r.otu, r.sample, r.reads, r.taxonomy) for r in df.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted((r.otu, r.sample, r.reads, r.taxonomy) for r in biom.read_biom_file(spark, path).collect())
    assert got == want and len(got) == len(cells)


def test_names_with_braces_are_an_error(spark, tmp_path):
    (tmp_path / "odd.biom").write_text(document(3, 2, [(0, 0)]).replace("otu 1", 'otu } {\\"id\\": \\"1'))
    with pytest.raises(ValueError):
        biom.read_large_biom(spark, str(tmp_path / "odd.biom"))
    (tmp_path / "no.biom").write_text("{}")
    with pytest.raises(ValueError):
        biom.read_large_biom(spark, str(tmp_path / "no.biom"))


def test_empty_table(spark, tmp_path):
    (tmp_path / "e.biom").write_text(document(2, 1, []))
    assert biom.read_large_biom(spark, str(tmp_path / "e.biom")).collect() == []
    assert new_path(spark, "x")
