"""Small document tables that hold the awkward cases."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward() -> list[tuple]:
    prose = " ".join(f"word{i}" for i in range(60))
    texts = [
        prose,
        prose,
        prose + " tail",
        None,
        "",
        " \t\n ",
        "one",
        "ÄÖ straße naïve\nzwei drei\n\nzwei drei\n",
        "a b c d e f g h a b c d e f g h a b c d e f g h",
        ("line of repeated words here\n" * 40),
        "x" * 5000,
        " ".join(["very"] * 30000),
        "### $$$ %%% |||" * 30,
        "emoji 😀 and 中文 text   sep",
    ]
    rows = [(i, t, "en", "src", None) for i, t in enumerate(texts)]
    return rows + [(3, None, None, None, None), (0, prose, "en", "src", 1), (None, "null id text", None, None, 1)]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
