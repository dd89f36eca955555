"""Small tables for the tests of this folder, with clashing extra columns."""

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ", score double, fp bigint, ids array<int>, component_id bigint, block bigint, `order` string"


def documents(spark, texts, ids=None, lang="en", clash=False):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang, "src", None if t is None else len(t)) for i, t in zip(ids, texts)]
    if clash:
        rows = [(*r, 0.5, 1, [1], 2, 3, "x") for r in rows]
    return spark.createDataFrame(rows, DOC + (CLASH if clash else ""))


ODD_TEXTS = [None, "", " \n\t ", "a", "a b", "Ünïcode 日本 😀", "same same same", "same same same", "word " * 20_000]
