import pytest

# Names that operators use inside; as columns of the input they must not get in the way.
CLASHING = (
    "n size kept fp h doc pos other score row rank words hits places label base share copies taken target weight "
    "node rep component carried lang_ key bin low high tie file path chunk members list_rows text_ begin part left"
).split()


@pytest.fixture
def documents(spark):
    """Make a documents table of (doc_id, text, lang, source) rows with columns of clashing names."""

    def make(rows):
        rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
        df = spark.createDataFrame(
            [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows],
            "doc_id bigint, text string, lang string, source string, n_chars bigint",
        )
        return df.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHING])

    return make


def by(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
