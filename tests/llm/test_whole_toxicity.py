import random

import pytest

from larkspur.llm import toxicity


def labelled(wording):
    """3,000 texts, half of them toxic; wording(i, toxic): what text i holds besides words of its own."""
    r = random.Random(4)
    alone = lambda i: "own" + "".join(chr(97 + int(c)) for c in str(i))
    out = []
    for i in range(3000):
        words = [alone(i) + x for x in "abcdefghijklmnopqrstuvwxyz"] + wording(i // 2, i % 2)
        r.shuffle(words)
        out.append((i, " ".join(words), i % 2))
    return out


def many_rare_words(i, toxic):
    return [f"nasty{chr(97 + random.Random(i).randrange(26))}"] if toxic else []


def rare_language(i, toxic):
    own = [f"lingo{x}" for x in "abcdefg"] if i % 33 == 0 else []
    return own + ((["zounds", "knave"] if own else ["idiot", "scum"]) if toxic else [])


@pytest.mark.parametrize(("wording", "rare"), [(many_rare_words, lambda i: True), (rare_language, lambda i: i // 2 % 33 == 0)])
def test_toxic_words_of_few_documents_count(spark, wording, rare):
    rows = labelled(wording)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    held = docs.where(toxicity.held_out(docs.doc_id))
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score_documents(held, toxicity.train(docs, labels)).collect()}
    caught = [p for i, p in got.items() if i % 2 and rare(i)]
    assert len(caught) > 5 and sum(caught) / len(caught) >= 0.9
    assert sum(p for i, p in got.items() if not i % 2) <= 0.02 * len(got)
