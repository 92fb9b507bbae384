"""Small awkward tables that every operator must take."""

ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (6, "same text of some words here"), (7, "same text of some words here"),
    (8, "Ünïcode ß   nbsp 漢字 text"), (9, "x" * 5000), (9, "x" * 5000), (10, "a b c d e f g h " * 400), (None, "no id at all"), (11, "!!! ??? 123"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, shard int, slot long, target double"


def odd_docs(spark, rows=ODD):
    return spark.createDataFrame([(d, t, None, None, None, None, None, None, None, None) for d, t in rows], SCHEMA)
