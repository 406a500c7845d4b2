from collections import Counter

from quillon.llm import language_id


def test_counts_brute():
    texts = ["Ab ab, c1d", "", "123 --", "Éà ñ", "a" * 50, "日本 語 ab"]
    for lo, kinds, counts in language_id._count(texts):
        for k, row in enumerate(counts):
            import regex

            want = Counter()
            for w in regex.findall(r"\p{L}+", texts[lo + k].lower()):
                p = f" {w} "
                want.update(w)
                want.update(p[i : i + 2] for i in range(len(p) - 1))
                want.update(p[i : i + 3] for i in range(len(p) - 2))
            code = lambda g: sum(ord(c) << 21 * j for j, c in enumerate(reversed(g)))
            assert {int(g): int(n) for g, n in zip(kinds, row) if n} == {code(g): n for g, n in want.items()}


def test_ranks_break_ties_by_ngram():
    import numpy as np

    assert language_id._ranked(np.array([[1, 3, 1, 0], [0, 0, 0, 0]]), 3).tolist() == [[1, 0, 2], [-1, -1, -1]]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from quillon.llm.common import remainder

    held = remainder("doc_id", 5) == 0
    got = language_id.predict(docs, language_id.profiles(docs.where(~held))).where(held).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "der hund und die katze", "de", 2), (3, None, "en", 3), (4, "12 3", "de", 4), (5, "the the dog", None, 5), (5, "the the dog", None, 5), (None, "die katze", "xx", 6), (7, "", "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.profiles(docs)).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[5][0] == "en"
    assert got[3] == got[4] == got[7] == ("und", 0.0)
    none = language_id.predict(docs, language_id.profiles(docs.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(rows)
    assert language_id.predict(docs.limit(0), language_id.profiles(docs)).count() == 0
