"""Small corpora with every awkward case, and a session as in the other tests."""

import pytest

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use themselves
    "key long, shingle long, component long, component_id long, place long, part int, size long, rank double, target double, "
    "copies int, spans string, score double, lang_pred string, gram long, wanted string, first long, copy boolean"
)
_EXTRA = (7, 7, 7, 7, 7, 7, 7, 7.0, 7.0, 7, "x", 7.0, "x", 7, "x", 7, True)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)``, with columns of clashing names."""

    def build(rows, partitions=3):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), *_EXTRA) for r in rows
        ]
        return spark.createDataFrame(full, COLUMNS).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def make_vectors(spark):
    def build(rows, kind="float"):
        return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, score double, rank int, shard int, v string") if rows and len(rows[0]) > 2 else (
            spark.createDataFrame([(*r, 1.0, 1, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, score double, rank int, shard int, v string")
        )

    return build
