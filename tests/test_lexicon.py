"""One automaton for all names equals one search a name, and takes no longer for many."""

import random
import time

from pyspark.sql import functions as F

from quillon.functions import lexicon
from quillon.functions.text import lexicon_refs
from quillon.schemas import LEXICON, STANDALONE


def texts(spark, r, names, n):
    def text():
        words = [r.choice(names) if r.random() < 0.1 else f"word{r.randrange(500)}" for _ in range(60)]
        words += r.choice([[], ["NATS"], ["xNATS"], ["(nats)"], ["hetzner."]])
        return " ".join(r.choice([w, w.upper(), w.lower()]) for w in words)

    return spark.createDataFrame([(k, r.choice([None, "", "é ß"]) if r.random() < 0.02 else text()) for k in range(n)], "id int, payload string").repartition(2)


def test_automaton_equals_search_by_name(spark, monkeypatch):
    r = random.Random(4)
    names = [*LEXICON, "kafka", "Zeta", "Zeta Prime", "tab\tname", ".", "Émile"]
    df = texts(spark, r, names, 400).cache()
    want = {x["id"]: x["refs"] or [] for x in df.select("id", lexicon_refs(F.col("payload"), tuple(names), STANDALONE).alias("refs")).collect()}
    monkeypatch.setattr(lexicon, "FEW", 0)
    got = {x["id"]: x["refs"] for x in df.select("id", lexicon.references(F.col("payload"), names).alias("refs")).collect()}
    assert got == want and any(len(x) > 2 for x in want.values())


def test_ten_thousand_names_take_no_longer_than_forty(spark):
    r = random.Random(5)
    names = [f"Name{k:05d}" for k in range(10_000)]
    df = texts(spark, r, names, 4000).cache()
    df.count()

    def seconds(some):
        best = 1e9
        for _ in range(2):
            start = time.time()
            df.select(F.sum(F.size(lexicon.references(F.col("payload"), some)))).collect()
            best = min(best, time.time() - start)
        return best

    assert seconds(names) < 3 * seconds(names[:40]) + 1
