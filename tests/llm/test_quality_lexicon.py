"""op6's lexicon is whole: no words fall out because others are more frequent."""

import random

from pyspark.sql import functions as F

from hushframe.llm.quality_rules import calibrate, fit_lexicon, quality_filter


def letters(k):
    return "".join(chr(97 + int(d)) for d in f"{k:03d}")


def test_lexicon_has_every_word_with_support(spark):
    words = ["bad" + letters(k) for k in range(260)]
    rows = [(i, " ".join(words[j] for j in range(260) if (i + j) % 4) + f" x{i}", 1) for i in range(16)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "id long, toxic int").withColumn("order", F.col("id")).withColumn("fit", F.lit(True))
    assert set(words) <= set(fit_lexicon(docs, labels, 100))


def test_bad_documents_are_caught_in_every_certified_language(spark):
    rng = random.Random(6)
    lists = {"en": ["vile" + letters(k) for k in range(220)], "sv": ["elak" + letters(k) for k in range(12)]}
    docs, labels, bad = [], [], {s: set() for s in lists}
    for s, vile in lists.items():
        for k in range(1500):
            i, toxic = len(docs), k % 3 == 0
            text = [f"word{letters(rng.randrange(400))}" for _ in range(30)]
            if toxic:
                text += vile if s == "en" else rng.sample(vile, 6)
                bad[s].add(i)
            docs.append((i, " ".join(text), s))
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    policy, _ = calibrate(docs, labels)
    assert {s for s, rule in policy.cutoffs if rule == "lexicon_hits"} == set(lists)
    kept = {r.doc_id for r in quality_filter(docs, labels).select("doc_id").collect()}
    for s, ids in bad.items():
        assert len(ids - kept) > 0.9 * len(ids), s
