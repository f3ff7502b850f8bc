"""Findings of the reviews: odd inputs of the registered queries, and what must not grow with tables."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill import catalog
from corpusmill.functions.arrow import SLICE_ROWS
from corpusmill.operators import strip
from corpusmill.sources import html


def _as_oracle(spark, folder, table, rows, name):
    """The registered query over the rows, and its SQL over the same."""
    rows.write.parquet(f"{folder}/{table}.parquet")
    df = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    res = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    return sorted(tuple(str(r[c]) for c in names) for r in df.collect()), sorted(tuple(map(str, r)) for r in res.fetchall())


def test_resume_keeps_pages_that_share_an_address(spark, tmp_path):
    pages = spark.createDataFrame([(5, "https://e.com/a", "x"), (6, "https://e.com/a", "x"), (7, "https://e.com/b", "x"), (10, "https://e.com/a", "x")], "page_id long, url string, html string")
    got, want = _as_oracle(spark, tmp_path, "pages", pages, "resume_upsert")
    assert got == want and len(got) == 4


def test_index_lines_do_not_grow_with_page_ids(spark, tmp_path):
    ids = [0, 1, 2, 900_000_000, 900_000_001, 900_000_002, (1 << 40) + 1]
    pages = spark.createDataFrame([(i, f"https://e.com/en/{i}", "x") for i in ids], "page_id long, url string, html string")
    got, want = _as_oracle(spark, tmp_path, "pages", pages, "index_lines")
    assert got == want and len(got) == len(ids)


class _Step:
    """Stands for a DataFrame and keeps the function over its batches."""

    columns = ("page_ord", "content")
    schema = type("S", (), {"__getitem__": lambda self, k: type("F", (), {"dataType": type("T", (), {"simpleString": lambda self: "bigint"})()})()})()

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


@pytest.mark.parametrize("make", [lambda p: strip.strip_pages(p, "mkdocs"), lambda p: strip.strip_pages(p), lambda p: strip.strip_pages(p, "mintlify"), html.html_to_markdown], ids=["mkdocs", "generic", "mintlify", "html"])
def test_python_steps_hold_a_slice_of_a_batch(make):
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([f"# T {i}\n\nwords" for i in range(1000)])], names=["page_ord", "content"])
    made = list(make(_Step())(iter([batch])))
    assert all(b.num_rows <= SLICE_ROWS for b in made) and [x for b in made for x in b.column(0).to_pylist()] == list(range(1000))


def test_cells_are_made_by_methods_that_the_jvm_compiles(spark):
    simhash = pytest.importorskip("corpusmill.llm.simhash")
    classes = spark.range(50).select(F.xxhash64("id").alias("fp"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = simhash.linked_classes(classes, 12)._jdf.queryExecution()
        plan.executedPlan()
        parts = plan.debug().codegenToSeq()
        sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) <= 8000  # HotSpot compiles no method of more bytes
