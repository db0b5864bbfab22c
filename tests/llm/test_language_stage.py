"""The pipeline's language stage on planted texts that are no language's, beside clean ones of any length."""

import random

from strataforge.llm import pipeline as corpus_pipeline
from strataforge.storage import table

DATA = "/root/testdata/sf0.001"
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x5600)))]


def test_foreign_scripts_and_gibberish_go_and_clean_texts_stay(spark):
    rng = random.Random(5)
    docs = table(spark, DATA, "documents").select(*corpus_pipeline.COLUMNS)
    planted = []
    for k in range(72):  # each alphabet in each length under each label; few beside the documents, which are all learned from
        letters = ALPHABETS[k % 4]
        words = ("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range((8, 30, 200)[k // 12 % 3]))
        planted.append((10_000_000 + k, " ".join(words), (None, "en", "de")[k // 4 % 3], "planted"))
    planted += [(20_000_000, "Сегодня хорошая погода, и мы идём гулять в парк. " * 5, "en", "planted")]
    clean = [r["text"].split() for r in docs.filter("length(text) > 300").orderBy("doc_id").limit(40).collect()]
    short = [(30_000_000 + k, " ".join(w[5 : 5 + k % 8 + 3]), None, "short") for k, w in enumerate(clean)]
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s in planted + short]
    every = docs.unionByName(spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, every, DATA).select("doc_id").collect()}
    assert not kept & {p[0] for p in planted}
    assert kept >= {s[0] for s in short}
    assert kept >= {r["doc_id"] for r in docs.filter("text rlike '[a-zA-Z]'").select("doc_id").collect()}
