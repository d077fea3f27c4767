"""The language filter grows with the grams of its fullest language."""

import random

from marlstone.llm import langid


def test_a_language_of_many_grams_does_not_fill_the_table(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_SLOTS", langid.MIN_SLOTS)
    rnd = random.Random(7)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    many = [(" ".join("".join(rnd.choices(signs, k=12)) for _ in range(50)), "zh") for _ in range(100)]
    words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(200)]
    few = [(" ".join(rnd.choices(words, k=60)), "xx") for _ in range(40)]
    docs = spark.createDataFrame(many + few, "text string, lang string")
    model = langid.fit(docs)
    assert model.langs == ["zh", "xx"] and max(model.false_rate) < 0.2
    told = langid.identify(docs, model).collect()
    assert all(r["lang_pred"] == r["lang"] and r["cover"] > 0.9 for r in told)
