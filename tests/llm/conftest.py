import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _n_words string, spans int, length string"


@pytest.fixture
def documents(spark):
    """Frame of documents from texts or (id, text) pairs, with further columns whose names the operators use themselves."""
    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "w", 7, "l") for i, t in rows], COLUMNS)

    return make


@pytest.fixture
def folder(tmp_path, spark):
    """A folder with the given frames as tables."""
    def make(**frames):
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
