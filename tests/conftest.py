import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def raw(spark):
    """Segments over whole texts, with ids from 0."""
    from marginalia.schema import raw_segments

    return lambda *texts: raw_segments(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


@pytest.fixture
def ents(spark):
    """Entity rows of (doc_id, label, start, end)."""
    from marginalia.operators.kernel import arrow_schema
    from marginalia.schema import ANN

    def make(*rows, text=""):
        import pyarrow as pa

        out = []
        for n, (doc, label, a, b) in enumerate(rows):
            span = {"start": a, "end": b, "length": None, "replaced": None}
            out.append(dict.fromkeys(arrow_schema(ANN).names) | {"doc_id": doc, "uid": f"e{n}", "kind": "entity", "label": label, "text": text[a:b], "spans": [span], "n_start": a, "n_end": b, "seq": n})
        return spark.createDataFrame(pa.Table.from_pylist(out, arrow_schema(ANN)))

    return make
