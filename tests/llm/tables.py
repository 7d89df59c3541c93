"""Small tables in the shape of the driver's."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, parts=3):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def rows_by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
