"""The similarity join's signatures go to shuffle files in parts."""

import random

from cytofabric.llm import partenum


def test_classes_and_signatures_travel_in_parts(spark, monkeypatch):
    rng, written, plain = random.Random(11), [], partenum.cut

    def noted(df):
        out = plain(df)
        written.append((df.columns, out.count()))
        return out

    monkeypatch.setattr(partenum, "cut", noted)
    words = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(60, 120))] for _ in range(150)]
    words += [w[:-1] for w in words[:40]] + words[:30] + [[], ["one"]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in partenum.jaccard_components(docs, 4, 85).collect()}
    assert got == {i: i if i < 150 or i >= 220 else i - 150 if i < 190 else i - 190 for i in range(len(words))}
    classes = [n for columns, n in written if {"sigs", "cls"} <= set(columns)]
    assert sum(classes) == 191 and max(classes) < 0.5 * 191
    pairs = [n for columns, n in written if columns == ["sig", "cls"]]
    assert max(pairs) < 0.75 * sum(pairs)
