import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: Column names that operators use inside; as extra columns they must pass through or be ignored.
CLASHES = ("id", "key", "cls", "row", "n", "_gone", "cut", "size", "block", "h", "_cell", "_tokens", "digest", "payload", "_few", "root")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (id, text) pairs, with extra columns of clashing names."""

    def make(rows, id_col="doc_id", text_col="text"):
        extra = [c for c in CLASHES if c not in (id_col, text_col)]
        schema = f"{id_col} bigint, {text_col} string, source string, lang string, " + ", ".join(f"`{c}` int" for c in extra)
        full = [(i, t, "s", "en", *range(len(extra))) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make
